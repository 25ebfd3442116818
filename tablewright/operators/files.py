"""Dataset layout, file audits and path resolution over listing tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright import fixed
from tablewright.functions.strings import any_keyword, extension, path_like, stem


def _pick(path: Column, names) -> Column:
    """The path of the first listed name that exists."""
    rank = F.array_position(F.array(*[F.lit(n) for n in names]), path)
    return F.min_by(F.when(rank > 0, path), F.when(rank > 0, rank))


def is_image(path: Column) -> Column:
    return F.lower(path).rlike("(" + any_keyword(fixed.LISTED_IMAGE_EXTENSIONS) + ")$")


def parent(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_extract(path, r"^(.*)/[^/]*$", 1)).otherwise("")


def dataset_layout(files: DataFrame) -> DataFrame:
    """One row per dataset: which files play which part. Input (dataset, path relative to the dataset).

    Every choice is a minimum, so a dataset with very many files is combined before the shuffle.
    """
    p = F.col("path")
    folder = parent(p)
    csv_in = lambda d: F.min(F.when((folder == d) & p.endswith(".csv"), p))
    image_dirs = {"train": [a for a, _ in fixed.IMAGE_DIRECTORIES], "test": [b for _, b in fixed.IMAGE_DIRECTORIES]}

    def image_dir(dirs):
        # the last candidate that holds images wins
        rank = F.array_position(F.array(*[F.lit(x) for x in dirs]), folder)
        return F.max_by(folder, F.when((rank > 0) & is_image(p), rank))

    g = files.groupBy("dataset").agg(
        F.max(p.startswith("train/")).alias("has_train_dir"),
        F.max(p.startswith("test/")).alias("has_test_dir"),
        _pick(p, fixed.TRAIN_FILES).alias("train_root"),
        _pick(p, fixed.TEST_FILES).alias("test_root"),
        csv_in("train").alias("train_inner"),
        csv_in("test").alias("test_inner"),
        F.when(F.max(is_image(p) & folder.isin(image_dirs["train"])), image_dir(image_dirs["train"])).alias("train_images_dir"),
        F.when(F.max(is_image(p) & folder.isin(image_dirs["test"])), image_dir(image_dirs["test"])).alias("test_images_dir"),
        _pick(p, fixed.SAMPLE_FILES).alias("sample_submission"),
        _pick(p, fixed.METADATA_FILES).alias("metadata_file"),
    )
    return g.select(
        "dataset",
        F.when(F.col("has_train_dir"), "train").alias("train_path"),
        F.when(F.col("has_test_dir"), "test").alias("test_path"),
        F.coalesce("train_inner", "train_root").alias("train_csv"),
        F.coalesce("test_inner", "test_root").alias("test_csv"),
        "train_images_dir", "test_images_dir", "sample_submission", "metadata_file",
        F.when(F.col("train_images_dir").isNotNull(), "image_dataset")
        .when(F.col("has_train_dir"), "folder_structure")
        .when(F.col("train_root").isNotNull(), "flat_csv")
        .otherwise("unknown").alias("structure_type"),
    )


def first_file(files: DataFrame, suffix: str = ".csv") -> DataFrame:
    """Smallest matching path per dataset and folder."""
    return (
        files.where(F.col("path").endswith(suffix))
        .groupBy("dataset", parent(F.col("path")).alias("folder")).agg(F.min("path").alias("first_path"))
    )


def image_dirs(files: DataFrame) -> DataFrame:
    """Image files per dataset and folder."""
    return (
        files.where(is_image(F.col("path")))
        .groupBy("dataset", parent(F.col("path")).alias("folder")).agg(F.count("*").alias("images"))
    )


def missing_inputs(files: DataFrame, expected: DataFrame, folders) -> DataFrame:
    """(dataset, folder) for every expected folder that no file lies in; ``expected`` names the datasets, also those without any file."""
    have = files.select("dataset", F.split_part("path", F.lit("/"), F.lit(1)).alias("folder")).distinct()
    want = expected.select("dataset").distinct().select("dataset", F.explode(F.array(*[F.lit(f) for f in folders])).alias("folder"))
    return want.join(have, ["dataset", "folder"], "left_anti")


def file_audit(refs: DataFrame, listing: DataFrame, keep: int = 10) -> DataFrame:
    """Do the named files exist? Totals over all mentions, and the ``keep`` smallest missing names as one joined text.

    Mentions are counted per name before the join, so a name that very many rows mention is one row there. The report
    keeps ten names: a distributed top-k.
    """
    named = refs.groupBy("path").agg(F.count("*").alias("n"))
    found = named.join(listing.select("path", F.lit(True).alias("exists")).distinct(), "path", "left")
    totals = found.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_files"),
        F.coalesce(F.sum(F.when(F.col("exists"), F.col("n"))), F.lit(0)).alias("verified_files"),
    )
    missing = found.where(F.col("exists").isNull()).select("path").orderBy("path").limit(keep)
    names = missing.agg(F.array_join(F.array_sort(F.collect_list("path")), ",").alias("m"))
    return totals.select(
        (F.col("total_files") == F.col("verified_files")).alias("all_exist"),
        names.scalar().alias("missing_files"), "total_files", "verified_files",
    )


def resolve_paths(refs: DataFrame, listing: DataFrame) -> DataFrame:
    """(id, path, resolved): the name as given (with the default ending when it has none), else the first alternative.

    Every name opens at most seven candidates; the best existing one is a minimum per id.
    """
    p = F.col("path")
    known = p.rlike("(" + any_keyword(fixed.RESOLVE_KNOWN) + ")$")
    main = F.when(known, p).otherwise(F.concat(p, F.lit(fixed.RESOLVE_DEFAULT)))
    alts = [F.concat(stem(F.col("main")), F.lit(e)) for e in fixed.RESOLVE_ALTERNATIVES]
    tried = refs.select("id", "path", main.alias("main")).select(
        "id", "path", F.posexplode(F.array(F.col("main"), *alts)).alias("priority", "candidate")
    )
    hits = tried.join(listing.select(F.col("path").alias("candidate")).distinct().withColumn("hit", F.lit(True)), "candidate", "left")
    return hits.groupBy("id", "path").agg(
        F.min_by("candidate", F.when(F.col("hit"), F.col("priority"))).alias("best"), F.max("hit").alias("any_hit")
    ).select("id", "path", F.when(F.col("any_hit"), F.col("best")).alias("resolved"))


def path_like_columns(df: DataFrame, extensions) -> DataFrame:
    """(column, path_like) over all string columns: does any value look like such a file? One aggregate."""
    cols = [f.name for f in df.schema if f.dataType.typeName() == "string"]
    row = df.agg(*[F.coalesce(F.max(path_like(F.col(c), extensions)), F.lit(False)).alias(c) for c in cols])
    return row.unpivot([], cols, "column", "path_like")


def path_parts(df: DataFrame) -> DataFrame:
    p = F.replace(F.col("path"), F.lit("\\"), F.lit("/"))
    return df.select("id", p.alias("path"), stem(p).alias("stem"), extension(p).alias("extension"))
