"""Queries: scalar and array functions."""

from pyspark.sql import functions as F

from tablewright.functions import arrays as ar
from tablewright.functions import numbers as nm
from tablewright.operators import signals
from tablewright.operators import statistics as st
from tablewright.plans.registry import query


def joined(arr):
    return F.array_join(F.transform(arr, lambda v: F.format_string("%.6f", v)), ",")


def joined_sql(expr):
    return f"array_to_string(list_transform({expr}, lambda v: format('{{:.6f}}', v)), ',')"


@query("normalize_probs", "SELECT id, a / (a + b + c) AS a, b / (a + b + c) AS b, c / (a + b + c) AS c FROM multi", ("multi",))
def normalize_probs(t):
    return t.multi.select("id", *nm.normalize_probs(["a", "b", "c"]))


@query("softmax_argmax", """SELECT id, round(exp(a) / (exp(a) + exp(b) + exp(c)), 9) AS p0, round(exp(b) / (exp(a) + exp(b) + exp(c)), 9) AS p1,
    round(exp(c) / (exp(a) + exp(b) + exp(c)), 9) AS p2, CASE WHEN a >= b AND a >= c THEN 0 WHEN b >= c THEN 1 ELSE 2 END AS best FROM multi""", ("multi",))
def softmax_argmax(t):
    s = nm.softmax(F.array("a", "b", "c"))
    got = t.multi.select("id", s.alias("s"))
    return got.select("id", *[F.round(F.col("s")[i], 9).alias(f"p{i}") for i in range(3)], nm.argmax(F.col("s")).alias("best"))


@query("sigmoid", "SELECT id, round(1 / (1 + exp(-(x - 1500) / 1500)), 9) AS p FROM scored", ("scored",))
def sigmoid(t):
    return t.scored.select("id", F.round(nm.sigmoid((F.col("x") - 1500) / 1500), 9).alias("p"))


@query("focal_loss", """SELECT y, round(avg(-((1 - pt) ** 2) * ln(pt)), 9) AS mean_loss, round(max(-((1 - pt) ** 2) * ln(pt)), 9) AS max_loss
    FROM (SELECT y, CASE y WHEN 0 THEN a WHEN 1 THEN b ELSE c END / (a + b + c) AS pt FROM multi) GROUP BY 1""", ("multi",))
def focal_loss(t):
    loss = nm.focal_loss(F.element_at(F.array(*nm.normalize_probs(["a", "b", "c"])), (F.col("y") + 1).cast("int")))
    return t.multi.select("y", loss.alias("l")).groupBy("y").agg(F.round(F.avg("l"), 9).alias("mean_loss"), F.round(F.max("l"), 9).alias("max_loss"))


@query("weighted_bce", """WITH w AS (SELECT count(*) FILTER (WHERE y = 0) / count(*) FILTER (WHERE y = 1) AS w FROM pred)
    SELECT id, round(w * y * ln(1 + exp(-z)) + (1 - y) * ln(1 + exp(z)), 9) AS loss FROM (SELECT id, y, (x - 1500) / 1500 AS z FROM pred), w""", ("pred",))
def weighted_bce(t):
    w = st.class_weights(t.pred, "y").select("pos_weight").scalar()
    logit = (F.col("x") - 1500) / 1500
    return t.pred.select("id", F.round(nm.weighted_bce(logit, F.col("y"), w), 9).alias("loss"))


@query("array_minmax", f"""SELECT id, {joined_sql('list_transform(wave, lambda v: (v - lo) / (hi - lo + 1e-10))')} AS wave
    FROM (SELECT id, wave, list_min(wave) AS lo, list_max(wave) AS hi FROM sig)""", ("sig",))
def array_minmax(t):
    return t.sig.select("id", joined(ar.minmax(F.col("wave"))).alias("wave"))


@query("array_pad", f"""SELECT id, {joined_sql('list_concat(wave, list_transform(range(16), lambda i: 0.0::double))')} AS longer,
    {joined_sql('wave[1:40]')} AS shorter FROM sig""", ("sig",))
def array_pad(t):
    return t.sig.select("id", joined(ar.pad(F.col("wave"), 80)).alias("longer"), joined(ar.pad(F.col("wave"), 40)).alias("shorter"))


@query("array_db", f"SELECT id, {joined_sql('list_transform(wave, lambda v: 10 * log10(v * v + 1e-10))')} AS db FROM sig", ("sig",))
def array_db(t):
    return t.sig.select("id", joined(ar.decibel(F.transform("wave", lambda v: v * v))).alias("db"))


@query("array_resample", f"""SELECT id, {joined_sql('''list_transform(range(100), lambda i:
      wave[least(floor(i * n / 99.0::double), n - 1)::INTEGER + 1] + (i * n / 99.0::double - least(floor(i * n / 99.0::double), n - 1)) *
      (wave[least(least(floor(i * n / 99.0::double), n - 1) + 2, n)::INTEGER] - wave[least(floor(i * n / 99.0::double), n - 1)::INTEGER + 1]))''')} AS wave
    FROM (SELECT id, wave, len(wave)::DOUBLE AS n FROM sig)""", ("sig",))
def array_resample(t):
    return t.sig.select("id", joined(ar.resample(F.col("wave"), 100)).alias("wave"))


@query("array_stack_mask", f"""SELECT id, 3 AS channels, {joined_sql('list_concat(list_concat(wave, wave), wave)')} AS stacked,
    array_to_string(list_transform(range(1, 81), lambda i: CASE WHEN i <= len(wave) THEN 1 ELSE 0 END), '') AS mask FROM sig""", ("sig",))
def array_stack_mask(t):
    s = ar.stack(F.col("wave"), 3)
    mask = F.transform(ar.real_mask(F.col("wave"), 80), lambda v: v.cast("string"))
    return t.sig.select("id", F.size(s).alias("channels"), joined(F.flatten(s)).alias("stacked"), F.array_join(mask, "").alias("mask"))


@query("missing_signal_default", """SELECT p_partkey AS id, coalesce(len(wave), 8) AS width,
    round(coalesce(list_sum(wave), 0), 6) AS total FROM part LEFT JOIN sig ON sig.id = p_partkey""", ("sig",))
def missing_signal_default(t):
    wave = ar.or_silence(F.col("wave"), 8)
    both = t.part.select(F.col("p_partkey").alias("id")).join(t.sig, "id", "left")
    total = F.aggregate(wave, F.lit(0.0), lambda a, v: a + v)
    return both.select("id", F.size(wave).cast("long").alias("width"), F.round(total, 6).alias("total"))


def spectrogram_sql(n=16, hop=8, frames=7, width=10, digits=4):
    """Power by plain cosine and sine sums, decibels, one scale per picture."""
    edge = 0.25 * (n - 1) / 2
    window = f"CASE WHEN least(i, {n - 1} - i) < {edge} THEN 0.5 * (1 - cos(pi() * least(i, {n - 1} - i) / {edge})) ELSE 1.0::double END"
    return f"""WITH win AS (SELECT i, {window} AS w FROM range({n}) r(i)), total AS (SELECT sum(w * w) AS t FROM win),
      x AS (SELECT id, f, i, wave[f * {hop} + i + 1] AS v, avg(wave[f * {hop} + i + 1]) OVER (PARTITION BY id, f) AS m FROM sig, range({frames}) a(f), range({n}) b(i)),
      p AS (SELECT id, f, k, (CASE WHEN k BETWEEN 1 AND {n // 2 - 1} THEN 2 ELSE 1 END) * (sum((v - m) * w * cos(2 * pi() * k * i / {n}::double)) ** 2
        + sum((v - m) * w * sin(2 * pi() * k * i / {n}::double)) ** 2) / any_value(t) AS power FROM x JOIN win USING (i), total, range({n // 2 + 1}) c(k) GROUP BY id, f, k),
      d AS (SELECT id, f, k, 10 * log10(power + 1e-10) AS db, min(10 * log10(power + 1e-10)) OVER (PARTITION BY id) AS lo,
        max(10 * log10(power + 1e-10)) OVER (PARTITION BY id) AS hi FROM p)
      SELECT id, k AS bin, {width} AS frames, array_to_string(list_transform(list_concat(list(round((db - lo) / (hi - lo + 1e-10), {digits}) ORDER BY f),
        list_transform(range({width - frames}), lambda j: 0.0::double)), lambda v: format('{{:.{digits}f}}', v)), ',') AS values FROM d GROUP BY id, k"""


@query("spectrogram", spectrogram_sql(), ("sig",))
def spectrogram(t):
    rows = signals.log_spectrogram(t.sig, "wave", 16, 8, 10).select("id", F.posexplode("spectrogram").alias("bin", "row"))
    text = F.array_join(F.transform("row", lambda v: F.format_string("%.4f", F.round(v, 4))), ",")
    return rows.select("id", F.col("bin").cast("long").alias("bin"), F.size("row").alias("frames"), text.alias("values"))


@query("image_normalize", f"""SELECT id, {joined_sql('''list_transform(range(48), lambda j:
      ((floor((wave[(j // 12) * 16 + (j // 3 % 4) * 2 + 1] - lo) / (hi - lo) * 255)) / 255.0::double - [0.485::double, 0.456, 0.406][j % 3 + 1])
        / [0.229::double, 0.224, 0.225][j % 3 + 1])''')} AS pixels
    FROM (SELECT id, wave, list_min(wave) AS lo, list_max(wave) AS hi FROM sig)""", ("sig",))
def image_normalize(t):
    # every 64-sample signal is seen as a grey 8 x 8 picture
    w = F.col("wave")
    lo, hi = F.array_min(w), F.array_max(w)
    grey = F.transform(w, lambda v: F.floor((v - lo) / (hi - lo) * 255).cast("int"))
    data = F.unhex(F.array_join(F.transform(grey, lambda v: F.lpad(F.hex(v), 2, "0")), ""))
    pics = t.sig.select("id", F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(1).alias("nChannels"), data.alias("data"))
    out = signals.normalize_images(pics, "id", 4, (0.485, 0.456, 0.406), (0.229, 0.224, 0.225))
    return out.select("id", joined(F.col("pixels")).alias("pixels"))
