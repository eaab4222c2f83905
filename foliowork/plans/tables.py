"""Inputs that the registered queries share: the given tables, and structured documents derived from them.

The given documents hold hardly any mark-up, so `structured` marks lines as a heading, a list item or a table row with a cell for
each word, and puts a table rule or a blank line before others; every word of a text stays. A converted version has lost or
changed some of these. The SQL beside it says the same for the oracles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliowork.functions import text as X


def book():
    """A decorator that registers a query with its SQL, and the two tables it fills.

    Whole numbers are given as long, as the SQL engine does.
    """
    queries, oracles = {}, {}

    def query(sql: str | None = None):
        def add(f):
            def widened(spark: SparkSession, sf_dir: str) -> DataFrame:
                df = f(spark, sf_dir)
                return df.withColumns({c: F.col(f"`{c}`").cast("long") for c, kind in df.dtypes if kind in ("int", "smallint", "tinyint")})

            widened.__name__, widened.__doc__ = f.__name__, f.__doc__
            queries[f.__name__] = widened
            if sql:
                oracles[f.__name__] = sql
            return widened

        return add

    return query, queries, oracles


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _row(line: Column) -> Column:
    return F.concat(F.lit("| "), F.replace(line, F.lit(" "), F.lit(" | ")), F.lit(" |"))


def _original(line: Column, i: Column) -> Column:
    level = F.repeat(F.lit("#"), (F.floor(i / 6) % 3 + 1).cast("int"))
    return (
        F.when(i % 6 == 0, F.concat(level, F.lit(" "), line))
        .when(i % 6 == 2, F.concat(F.lit("- "), line))
        .when(i % 6 == 3, _row(line))
        .when(i % 6 == 4, F.concat(F.lit("| --- | --- | --- |\n"), line))
        .when(i % 6 == 5, F.concat(F.lit("\n"), line))
        .otherwise(line)
    )


def _converted(line: Column, i: Column) -> Column:
    return F.when(i % 12 == 6, F.concat(F.lit("#### "), line)).when(i % 18 == 2, F.lit("")).when(i % 30 == 3, line).otherwise(_original(line, i))


def structured(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, original, converted)"""
    own = F.split(X.col("text"), "\n", -1)
    return docs.select(
        "doc_id", "lang", "source", F.array_join(F.transform(own, _original), "\n").alias("original"), F.array_join(F.transform(own, _converted), "\n").alias("converted")
    )


_ROW = "'| ' || replace(x, ' ', ' | ') || ' |'"
_ORIGINAL = (
    "CASE WHEN (i-1) % 6 = 0 THEN repeat('#', (((i-1) // 6) % 3 + 1)::INT) || ' ' || x WHEN (i-1) % 6 = 2 THEN '- ' || x "
    f"WHEN (i-1) % 6 = 3 THEN {_ROW} WHEN (i-1) % 6 = 4 THEN '| --- | --- | --- |' || chr(10) || x WHEN (i-1) % 6 = 5 THEN chr(10) || x ELSE x END"
)
STRUCTURED = f"""structured AS (
  SELECT doc_id, lang, source,
    array_to_string(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x, i: {_ORIGINAL}), chr(10)) AS original,
    array_to_string(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x, i:
      CASE WHEN (i-1) % 12 = 6 THEN '#### ' || x WHEN (i-1) % 18 = 2 THEN '' WHEN (i-1) % 30 = 3 THEN x ELSE {_ORIGINAL} END), chr(10)) AS converted
  FROM documents)"""

#: Lines of a page of a document, when documents are read as pages.
PAGE_LINES = 8


def doc_pages(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, page, text): a text's lines in pages of eight, numbered from 0."""
    own = F.split(X.col("text"), "\n", -1)
    count = F.ceil(F.size(own) / PAGE_LINES).cast("int")
    pages = F.transform(F.sequence(F.lit(0), count - 1), lambda p: F.struct(p.alias("page"), F.array_join(F.slice(own, p * PAGE_LINES + 1, PAGE_LINES), "\n").alias("text")))
    return docs.select("doc_id", "lang", "source", F.inline(pages))


PAGES = f"""doc_pages AS (
  SELECT doc_id, lang, source, p AS page, array_to_string(list_slice(ls, p * {PAGE_LINES} + 1, p * {PAGE_LINES} + {PAGE_LINES}), chr(10)) AS text
  FROM (SELECT doc_id, lang, source, ls, unnest(range(0, CAST(ceil(len(ls) / {PAGE_LINES}.0) AS BIGINT))) AS p
        FROM (SELECT doc_id, lang, source, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)))"""


def sql_tokens(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '\\s+'), lambda t: t <> '')"


def sql_trim(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def sql_set(x: str, longer_than: int = 2) -> str:
    return f"list_distinct(list_filter(string_split_regex(lower({x}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: length(t) > {longer_than}))"


def sql_lines(x: str) -> str:
    return f"string_split({x}, chr(10))"
