"""HTML pages as tables of tags, as cells and as links. Pages are cut into tags and texts by expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliowork.functions.text import col, let

#: What is dropped with all its content, and tags that stand for a plain block or a plain inline part.
DROPPED = ("script", "style", "head", "noscript", "template", "svg")
BLOCK_FOLDS = ("figure", "figcaption", "section", "article", "main", "aside", "nav", "header", "footer", "details", "summary", "dialog", "hgroup", "search")
INLINE_FOLDS = ("mark", "time", "data", "bdi", "output")
CONTAINERS = (*BLOCK_FOLDS, "div", "form", "fieldset", "address", "body", "html")
TOKEN = r"(?s)<!--.*?-->|</?[A-Za-z][^>]*>|<![^>]*>|[^<]+|<"
_TOKENS, _TAG = re.compile(TOKEN), re.compile(r"</?([A-Za-z][A-Za-z0-9-]*)")
#: Cells that a task gathers before it gives them on.
CELLS_AT_ONCE = 100_000
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&"))


def visible(html: Column | str) -> Column:
    """The page without comments and without dropped elements and their content."""

    def without(x: Column) -> Column:
        bare = x
        for tag in DROPPED:
            bare = F.regexp_replace(bare, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "")
        return F.when(F.regexp_like(x, F.lit(rf"(?i)<(?:{'|'.join(DROPPED)})\b")), bare).otherwise(x)

    return let(F.when(F.contains(col(html), F.lit("<!--")), F.regexp_replace(col(html), r"(?s)<!--.*?-->", "")).otherwise(col(html)), without)


def unescape(x: Column) -> Column:
    for name, char in ENTITIES:
        x = F.replace(x, F.lit(name), F.lit(char))
    return x


def attribute(tag: Column, name: str) -> Column:
    """The value of an attribute in a tag token; empty without it."""
    return unescape(_unquoted(F.regexp_extract(tag, rf"""(?is)\s{name}\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", 1)))


def _unquoted(x: Column) -> Column:
    return F.regexp_replace(x, r"""^["']|["']$""", "")


def tag_name(token: Column) -> Column:
    return F.lower(F.regexp_extract(token, r"^</?([A-Za-z][A-Za-z0-9-]*)", 1))


def tokens(html: Column | str) -> Column:
    return F.regexp_extract_all(visible(html), F.lit(TOKEN), F.lit(0))


def tag_stream(pages: DataFrame, id_column: str = "page_id", html: str = "html") -> DataFrame:
    """(page_id, pos, tag, close, attrs, text): tags and texts in order; a text has no tag, a tag no text."""
    rows = pages.select(id_column, F.posexplode(tokens(html)).alias("pos", "token"))
    name = tag_name(F.col("token"))
    is_tag = name != ""
    return rows.select(
        id_column, "pos", F.when(is_tag, name).alias("tag"), F.when(is_tag, F.col("token").startswith("</")).alias("close"),
        F.when(is_tag, F.regexp_extract("token", r"(?s)^</?[A-Za-z][A-Za-z0-9-]*\s*(.*?)/?>$", 1)).alias("attrs"), F.when(~is_tag, F.col("token")).alias("text"),
    )


def fold_tags(tags: DataFrame) -> DataFrame:
    """The tag stream with sectioning tags as div and semantic inline tags as span; exact names only."""
    return tags.withColumn("tag", F.when(F.col("tag").isin(*BLOCK_FOLDS), "div").when(F.col("tag").isin(*INLINE_FOLDS), "span").otherwise(F.col("tag")))


def _collapsed(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(x, "[ \\t\\n\\r\\f]+", " "), r"^[ \t]+|[ \t]+$", "")


def page_tables(pages: DataFrame, id_column: str = "page_id", html: str = "html") -> DataFrame:
    """(page_id, table_id, row, col, value, colspan, rowspan), all counted from 0, in document order; th is a cell.

    Counters go along with a page's tags where the page lies; a table inside a table is counted as one after it.
    """
    kind = pages.schema[id_column].dataType
    counters = ("table_id", "row", "col")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []

            def rows() -> pa.RecordBatch:
                at, *numbers, value, opening = zip(*found, strict=True)
                return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *(pa.array(n, pa.int64()) for n in numbers), pa.array(value, pa.string()), pa.array(opening, pa.string())], ["id", *counters, "value", "opening"])

            for k, x in enumerate(batch.column(1).to_pylist()):
                for cell in _cells(x):
                    found.append((k, *cell))
                    if len(found) >= CELLS_AT_ONCE:
                        yield rows()
                        found.clear()
            if found:
                yield rows()

    fields = [T.StructField("id", kind), *(T.StructField(c, T.LongType()) for c in counters), T.StructField("value", T.StringType()), T.StructField("opening", T.StringType())]
    cells = pages.select(F.col(id_column).alias("id"), visible(html).alias("html")).mapInArrow(cut, T.StructType(fields))
    attrs = F.regexp_extract("opening", r"(?s)^</?[A-Za-z][A-Za-z0-9-]*\s*(.*?)/?>$", 1)

    def span(name: str) -> Column:
        number = F.regexp_extract(F.concat(F.lit(" "), attrs), rf"(?i)\s{name}\s*=\s*[\"']?(\d+)", 1)
        given = F.greatest(F.coalesce(F.try_to_number(number, F.lit("999999")).cast("int"), F.lit(1)), F.lit(1))
        return F.when(F.contains("opening", F.lit("=")), given).otherwise(1)

    value = F.when(F.contains("value", F.lit("&")), unescape(F.col("value"))).otherwise(F.col("value"))
    return cells.select(F.col("id").alias(id_column), *counters, _collapsed(value).alias("value"), span("colspan").alias("colspan"), span("rowspan").alias("rowspan"))


def _cells(html: str) -> Iterator[tuple[int, int, int, str, str | None]]:
    """(table, row, col, text, opening tag) of the cells of a page; an opening tag that an end without a start took away is null."""
    table = row = col = ended = depth = 0
    texts, opening, inside = [], None, False
    for token in _TOKENS.findall(html):
        name = _TAG.match(token)
        tag, close = (name[1].lower(), token[1] == "/") if name else ("", False)
        cell = tag == "td" or tag == "th"
        if tag == "table":
            depth += -1 if close else 1
        starts = not close and (cell or tag in ("table", "tr"))
        if starts and inside:
            yield table - 1, row - 1, col - 1, "".join(texts), opening
        if starts:
            texts, opening, inside = [], None, False
        if tag == "table" and starts:
            table, row, col, ended = table + 1, 0, 0, 0
        elif tag == "tr" and starts:
            row, col, ended = row + 1, 0, 0
        elif cell:
            col, ended = col + starts, ended + close
        if depth > 0 and row > 0 and col > 0 and (ended < col or (close and cell)):
            inside = True
            if not name:
                texts.append(token)
            elif starts and cell:
                opening = token
    if inside:
        yield table - 1, row - 1, col - 1, "".join(texts), opening


def page_links(pages: DataFrame, id_column: str = "page_id", html: str = "html") -> DataFrame:
    """(page_id, kind, label, target): anchors with a visible text and a target, and images with a source."""
    x = visible(html)
    anchors = F.regexp_extract_all(x, F.lit(r"(?is)<a\b[^>]*>.*?</a\s*>"), F.lit(0))
    label = lambda a: _collapsed(unescape(F.regexp_replace(a, r"(?s)<[^>]*>", "")))
    opening = lambda a: F.regexp_extract(a, r"(?s)^(<[^>]*>)", 1)
    as_links = F.transform(anchors, lambda a: F.struct(F.lit("link").alias("kind"), label(a).alias("label"), attribute(opening(a), "href").alias("target")))
    images = F.transform(F.regexp_extract_all(x, F.lit(r"(?is)<img\b[^>]*>"), F.lit(0)), lambda t: F.struct(F.lit("image").alias("kind"), attribute(t, "alt").alias("label"), attribute(t, "src").alias("target")))
    kept = F.filter(F.concat(as_links, images), lambda r: (r["target"] != "") & ((r["kind"] == "image") | (r["label"] != "")))
    return pages.select(id_column, F.inline(kept))
