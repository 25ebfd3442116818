"""Main text of web pages through wrappers: union-free regular expressions over the tags of a host's pages.

A page is read as a tree of elements and texts. Neighbouring repeats fold into repeated groups. A host's pages are aligned one after the
other with the wrapper so far: what only one side has becomes optional, texts that differ become slots, texts that agree stay
constant. The places of the final wrapper are judged once per host; a page's texts are then kept or
dropped by their place in the wrapper. A place that the host's wrapper does not know is judged on its own page. Pages without
an article or main element also lose the texts that the host's pages repeat at the same place, counted over all of its pages.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Generator, Iterator
from difflib import SequenceMatcher
from html import unescape

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablewright.llm.common import id_type, table, whole_text, written
from tablewright.llm.registry import query
from tablewright.llm.url_rules import url_parts

#: Different pages of a host that its wrapper is inferred from.
PAGES = 16
#: Contents that share a text at a place make it a constant if they are more than half of the host's, or if the place has so many contents to a text.
CONTENTS = 3
#: Share of a page's text that names its content: pages that differ in less are copies.
COPY = 0.8
#: Fixed values of HTML: elements without content, with raw content, inside lines, and what a start tag closes.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe xmp noframes template".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = set("article main body html table ul ol dl section div td blockquote".split())
#: Elements, and words of class, id or role, that are not the article's own text.
ASIDE = set("nav footer aside form script style noscript template button select textarea iframe svg head title menu dialog".split())
ASIDE_WORDS = set(
    "ad ads advert advertisement adverts sponsor sponsored promo cookie cookies consent notice notices menu nav navbar navigation breadcrumb breadcrumbs sidebar "
    "footer contentinfo complementary comment comments reply replies disqus share sharing social related recommended newsletter subscribe signup login search popup modal "
    "widget copyright pagination pager toolbar".split()
)
#: Words that class names add to those without naming anything else: ``related-posts`` is an aside, ``related-work`` is not.
PART_WORDS = set(
    "active area bar block body bottom box button buttons card col column container content fixed footer form global group header icon inline inner item items label large left "
    "link links list main message mobile module nested outer overlay page panel post posts right row section site slot small sticky text title top unit wrap wrapper zone".split()
)
#: Articles and mains with such names are reader comments.
COMMENT_WORDS = set("comment comments reply replies disqus".split())
#: These are the page's outside an article, and the article's inside it.
OUTSIDE = {"header", "banner", "alert"}
CORE = {"article", "main"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(?=[/A-Za-z])[^>]*(?:>|\Z)", re.S)
NAMES = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
SPACE = re.compile(r"\s+")
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


ALWAYS, NOT_INSIDE = 2, 1


class Node:
    """An element, or a text (sign ``#``) whose ``text`` is None once it is a slot. ``many`` is one of 1 ? + *."""

    __slots__ = ("tag", "sign", "aside", "kids", "text", "many", "chars", "linked")

    def __init__(self, tag: str, sign: str, aside: int = 0, text: str | None = None):
        self.tag, self.sign, self.aside, self.text = tag, sign, aside, text
        self.kids: list[Node] = []
        self.many, self.chars, self.linked = "1", len(text or ""), 0


def names(name: str, words: set[str]) -> bool:
    """Does a whole class name say one of the words, alone or with words for parts of a page?"""
    if name.lower() in words:
        return True
    parts = {p.lower() for p in PARTS.findall(name) if len(p) > 1}
    return not words.isdisjoint(parts) and parts <= words | PART_WORDS


def _element(tag: str, attributes: str) -> Node:
    words, tokens, core = [], [], False
    if attributes:
        for name, a, b, c in NAMES.findall(attributes):
            found = re.findall(r"[A-Za-z]+", a or b or c)
            words += [w.lower() for w in found]
            if name.lower() != "id" or tag not in HEADINGS:  # there it is a link's target, made of the heading's words
                tokens += (a or b or c).split()
            core |= name.lower() == "itemprop" and "articleBody" in found or name.lower() == "role" and "main" in found
    sign = ".".join([tag, *sorted(set(words))])
    meant = COMMENT_WORDS if tag in CORE else set() if tag in ("body", "html") else ASIDE_WORDS
    aside = tag in ASIDE or any(names(t, meant) for t in tokens)
    outside = tag in OUTSIDE or tag not in ("body", "html", *CORE) and any(names(t, OUTSIDE) for t in tokens)
    return Node("main" if core else tag, sign, ALWAYS if aside else NOT_INSIDE if outside else 0)


def parse(html: str) -> Node:
    """The tree of a page; end tags that are missing are supplied, stray ones ignored, comments left out."""
    root = Node("html", "page")
    stack = [root]
    opened: Counter = Counter()
    pos = 0

    def close(k: int) -> None:
        opened.subtract(x.sign.split(".")[0] for x in stack[k:])
        del stack[k:]

    while True:
        m = TOKEN.search(html, pos)
        text = html[pos : m.start() if m else len(html)]
        if text:
            stack[-1].kids.append(Node("#", "#", text=unescape(text)))
        if not m:
            return root
        pos = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            for k in range(len(stack) - 1 if opened[tag] > 0 else 0, 0, -1):
                if stack[k].sign.split(".")[0] == tag:
                    close(k)
                    break
                if tag in INLINE and stack[k].tag in SCOPE:
                    break
            continue
        closing = CLOSES.get(tag) or (set() if tag in INLINE or tag in VOID else {"p"})
        for k in range(len(stack) - 1 if any(opened[x] > 0 for x in closing) else 0, 0, -1):
            if stack[k].tag in closing:
                close(k)
                break
            if stack[k].tag in SCOPE and not (tag == "tr" and stack[k].tag == "td"):
                break
        node = _element(tag, m[3])
        stack[-1].kids.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(html, pos)
            if not end:
                return root
            pos = end.end()
        elif tag not in VOID and not m[3].endswith("/"):
            stack.append(node)
            opened[tag] += 1


def finished(steps: Generator):
    """The result of steps that yield the steps they wait for: a stack of its own, so that pages nest as deep as they like."""
    stack, value = [steps], None
    while stack:
        try:
            stack.append(stack[-1].send(value))
            value = None
        except StopIteration as e:
            stack.pop()
            value = e.value
    return value


def fold(kids: list[Node]) -> Generator:
    """Neighbouring groups of one to three equal signs become one repeated group."""
    out = [k for k in kids if k.sign != "#" or k.text is None or k.text.strip()]
    for size in (1, 2, 3):
        i = 0
        while i + 2 * size <= len(out):
            a, b = out[i : i + size], out[i + size : i + 2 * size]
            if [k.sign for k in a] == [k.sign for k in b] and (size > 1 or a[0].sign != "#"):
                group = []
                for x, y in zip(a, b, strict=True):
                    group.append((yield join(x, y, repeat=True)))
                out[i : i + 2 * size] = group
            else:
                i += 1
    return out


def join(a: Node, b: Node, repeat: bool = False) -> Generator:
    """One node that stands for both: ``repeat`` for two neighbours of a page, else the same place of two pages."""
    out = Node(a.tag, a.sign, a.aside)
    out.text = a.text if a.text is not None and b.text is not None and a.text.strip() == b.text.strip() else None
    out.chars, out.linked = a.chars + b.chars, a.linked + b.linked
    more, less = repeat or "+" in (a.many, b.many) or "*" in (a.many, b.many), a.many in "?*" or b.many in "?*"
    out.many = "*" if more and less else "+" if more else "?" if less else "1"
    if a.kids or b.kids:
        out.kids = yield fold((yield align(a.kids, b.kids)))
    return out


def align(a: list[Node], b: list[Node]) -> Generator:
    """Equal signs in the same order are joined, the rest becomes optional."""
    out: list[Node] = []
    for what, i, j, k, m in SequenceMatcher(None, [x.sign for x in a], [x.sign for x in b], False).get_opcodes():
        if what == "equal":
            for x, y in zip(a[i:j], b[k:m], strict=True):
                out.append((yield join(x, y)))
            continue
        for node in a[i:j] + b[k:m]:
            node.many = "*" if node.many in "+*" else "?"
            out.append(node)
    return out


def folded_page(page: Node) -> Node:
    """A page as a wrapper: repeats folded from the leaves up, lengths of texts and of link texts noted."""
    order, todo = [], [(page, False)]
    while todo:
        node, link = todo.pop()
        link = link or node.tag == "a"
        order.append(node)
        for k in node.kids:
            if k.sign == "#":
                k.chars = len(k.text.strip())
                k.linked = k.chars if link else 0
            else:
                todo.append((k, link))
    for node in reversed(order):
        node.kids = finished(fold(node.kids))
    return page


def infer(pages: list[str]) -> Node:
    """The wrapper of a host's pages."""
    wrapper = None
    for html in pages:
        page = folded_page(parse(html))
        wrapper = page if wrapper is None else finished(join(wrapper, page))
    return wrapper


def expression(wrapper: Node) -> str:
    """The wrapper as a regular expression: constants quoted, slots as #."""
    out: list[str] = []
    todo: list[Node | str] = [wrapper]
    while todo:
        node = todo.pop()
        if isinstance(node, str):
            out.append(node)
        elif node.sign == "#":
            out.append("#" if node.text is None else repr(node.text.strip()))
        else:
            out.append(f"<{node.sign}>(")
            todo.append(f"){node.many if node.many != '1' else ''}")
            for n, k in enumerate(reversed(node.kids)):
                todo += [" ", k] if n else [k]
    return "".join(out)


def inside(path: int, sign: str) -> int:
    """The place of an element: a hash of the place around it and its sign."""
    return int.from_bytes(xxhash.xxh3_64_digest(f"{path}>{sign}".encode("utf-8", "surrogatepass")), "big", signed=True)


CORE_TEXT, OTHER_TEXT = 1, 2


def judged(wrapper: Node) -> dict[int, int]:
    """What the texts at each place of a wrapper are: CORE_TEXT inside an article or main element, OTHER_TEXT, or 0 for asides.

    Other text is what stands outside asides and is links in at most half of its length; without the host's constants it
    is the article of pages without an article or main element.
    """
    out: dict[int, int] = {}
    todo: list[tuple[Node, int, bool, bool]] = [(wrapper, inside(0, wrapper.sign), False, False)]
    while todo:
        node, path, aside, core = todo.pop()
        if node.sign != "#":
            core = core or node.tag in CORE and not aside
            aside = aside or node.aside == ALWAYS or node.aside == NOT_INSIDE and not core
            todo += [(k, path if k.sign == "#" else inside(path, k.sign), aside, core) for k in reversed(node.kids)]
        elif not aside:
            other = node.linked * 2 <= node.chars
            out[path] = out.get(path, 0) or (CORE_TEXT if core else OTHER_TEXT if other else 0)
        else:
            out.setdefault(path, 0)
    return out


def _has_core(page: Node) -> bool:
    todo = [page]
    while todo:
        for k in todo.pop().kids:
            if k.sign != "#" and not k.aside:
                if k.tag in CORE:
                    return True
                todo.append(k)
    return False


def text_key(path: int, text: str) -> int:
    return inside(path, "#" + SPACE.sub(" ", text).strip())


def walked(page: Node, html: str, places: dict[int, int], wanted: int) -> Iterator[tuple[int, str] | None]:
    """(place, text) of the wanted texts in their order, and None where a block begins or ends."""
    own: dict[int, int] | None = None
    todo: list[tuple[Node, int, bool]] = [(page, inside(0, page.sign), False)]
    while todo:
        node, path, ended = todo.pop()
        if node.sign == "#":
            keep = places.get(path)
            if keep is None:
                if own is None:
                    own = judged(folded_page(parse(html)))
                keep = own.get(path, 0)
            if keep == wanted:
                yield path, node.text
            continue
        if node.tag not in INLINE:
            yield None
        if not ended:
            todo.append((node, path, True))
            todo += [(k, path if k.sign == "#" else inside(path, k.sign), False) for k in reversed(node.kids)]


def main_text(html: str, places: dict[int, int], constants: frozenset[int] = frozenset()) -> str:
    """Texts of the places that belong to the article, blocks joined by one blank."""
    page = parse(html)
    wanted = CORE_TEXT if _has_core(page) else OTHER_TEXT
    blocks: list[str] = []
    line: list[str] = []
    for found in walked(page, html, places, wanted):
        if found is None:
            block = SPACE.sub(" ", "".join(line)).strip()
            if block:
                blocks.append(block)
            line.clear()
        elif wanted == CORE_TEXT or not constants or text_key(*found) not in constants:
            line.append(found[1])
    return " ".join(blocks)


def other_texts(html: str, places: dict[int, int]) -> tuple[set[tuple[int, int]], int] | None:
    """(place, key) of the other texts of a page without an article or main element, and its content.

    The content is a hash of the longest texts that make up COPY of the page. Pages that differ in a date or a counter have the same content, so that copies of a
    page are not taken for pages that repeat its text; pages that share a text longer than their own have contents of their own.
    """
    page = parse(html)
    if _has_core(page):
        return None
    found: dict[tuple[int, int], int] = {}
    for place in walked(page, html, places, OTHER_TEXT):
        if place and place[1].strip():
            found[place[0], text_key(*place)] = len(place[1].strip())
    if not found:
        return None
    left, content = COPY * sum(found.values()), 0
    for size, key in sorted(((n, key) for (_, key), n in found.items()), reverse=True):
        if left <= 0:
            break
        left -= size
        content = inside(content, str(key))
    return set(found), content


def _places(b: pa.RecordBatch, known: dict) -> list[dict[int, int]]:
    """The places of each row's host; some are kept from batch to batch."""
    out, places = [], b.column("places")
    for r, host in enumerate(b.column("host").to_pylist()):
        if host not in known:
            if len(known) > 500:
                known.clear()
            known[host] = {x["path"]: x["keep"] for x in places[r].as_py() or []}
        out.append(known[host])
    return out


def constants(rows: DataFrame) -> DataFrame:
    """(host, constants): keys of the texts that at least CONTENTS contents of a host have at the same place; written.

    Either more than half of the host's contents have the text, or the place holds CONTENTS contents or more to each of its texts, as the banners of several
    templates do. ``rows`` (host, html, places) are all pages. A host's contents are counted in many tasks, only its constants come to one. One or two contents
    of a host show no repeats; their texts are kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, dict[int, int]] = {}
        for b in batches:
            row, paths, keys, contents = [], [], [], []
            for r, (html, places) in enumerate(zip(b.column("html").to_pylist(), _places(b, known), strict=True)):
                for path, key in (found := other_texts(html, places) or ((), 0))[0]:
                    row.append(r)
                    paths.append(path)
                    keys.append(key)
                    contents.append(found[1])
            columns = [pa.array(x, pa.int64()) for x in (paths, keys, contents)]
            yield pa.RecordBatch.from_arrays([b.column("host").take(pa.array(row, pa.int64())), *columns], ["host", "path", "key", "content"])

    found = rows.select("host", "html", "places").mapInArrow(run, "host string, path long, key long, content long")
    seen = written(found.distinct(), "place-texts")
    counted = seen.groupBy("host", "path", "key").agg(F.count("*").alias("n"))
    texts = counted.groupBy("host", "path").agg(F.count("*").alias("texts"))
    held = seen.select("host", "path", "content").distinct().groupBy("host", "path").agg(F.count("*").alias("held"))
    total = seen.select("host", "content").distinct().groupBy("host").agg(F.count("*").alias("total"))
    repeated = counted.where(F.col("n") >= CONTENTS).join(texts, ["host", "path"]).join(held, ["host", "path"]).join(total, "host")
    common = repeated.where((2 * F.col("n") > F.col("total")) | (CONTENTS * F.col("texts") <= F.col("held")))
    return written(common.groupBy("host").agg(F.collect_list("key").alias("constants")), "constants")


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, places, wrapper) for each host, inferred from PAGES of its different pages, those with the smallest hashes; written.

    Equal pages are combined and PAGES rows per host kept in every task before the shuffle, so a host with very many pages is no burden.
    """
    host, _ = url_parts(F.col("url"))
    named = pages.select(host.alias("host"), whole_text("html").alias("html")).withColumn("mark", F.xxhash64("html"))
    marks = named.select("host", "mark").distinct()
    chosen = marks.withColumn("n", F.row_number().over(Window.partitionBy("host").orderBy("mark"))).where(F.col("n") <= PAGES)
    sample = named.join(written(chosen, "wrapper-sample"), ["host", "mark"]).groupBy("host", "n").agg(F.min("html").alias("html"))

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        wrapper = infer(rows.sort_values("n")["html"].tolist())
        return pd.DataFrame({"host": [key[0]], "places": [list(judged(wrapper).items())], "wrapper": [expression(wrapper)]})

    out = sample.groupBy("host").applyInPandas(one, "host string, places array<struct<path:long,keep:int>>, wrapper string")
    return written(out, "wrappers")


def extract(pages: DataFrame) -> DataFrame:
    """One row per row of ``pages`` (page_id, url, html): page_id, url, text, n_chars.

    ``text`` is the article's whole text with character references decoded, white space inside a block as one blank, and blocks joined by one blank. A
    null or empty page has the empty text; pages with a null url form a host of their own. Cut-off and badly nested
    pages are read as far as they go. Repeated rows and null ids are kept; other columns are ignored. Wrappers (one row per host) are
    a written table, broadcast only when Spark measures it to be small, else joined by host.
    """
    kinds = f"page_id {id_type(pages, 'page_id')}, url string, text string"
    host, _ = url_parts(F.col("url"))
    known = wrappers(pages).select("host", "places")
    rows = pages.select("page_id", "url", whole_text("html").alias("html"), host.alias("host")).join(known, "host", "left")
    rows = rows.join(constants(rows), "host", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, dict[int, int]] = {}
        repeated: dict[str, frozenset[int]] = {}
        for b in batches:
            texts = []
            hosts, repeats = b.column("host").to_pylist(), b.column("constants")
            for r, (html, places) in enumerate(zip(b.column("html").to_pylist(), _places(b, known), strict=True)):
                if hosts[r] not in repeated:
                    if len(repeated) > 500:
                        repeated.clear()
                    repeated[hosts[r]] = frozenset(repeats[r].as_py() or [])
                texts.append(main_text(html, places, repeated[hosts[r]]))
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    out = rows.select("page_id", "url", "html", "host", "places", "constants").mapInArrow(run, kinds)
    return out.withColumn("n_chars", F.length("text").cast("long"))


SQL = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(?:</article>|$)', 1) AS h FROM pages),
b AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(h, '</?b>', '', 'g'), '<[^>]*>', ' ', 'g'), '<[^>]*$', '') AS t FROM a),
c AS (SELECT page_id, url, trim(regexp_replace(regexp_replace(regexp_replace(t, '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS text FROM b)
SELECT page_id, url, text, length(text) AS n_chars FROM c"""


@query("op4_page_wrappers", SQL)
def op4(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages"))
