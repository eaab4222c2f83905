"""Findings of round 4, each with the input that was wrong before."""

from collections import Counter

import duckdb

import __spark_entry__
from foliowork.operators import tables as T


def both(spark, folder: str, name: str, texts: list[str | None]) -> tuple[Counter, Counter]:
    """The rows of a query and those of its SQL over documents with these texts, numbered from 0."""
    rows = [(k, t, "en", "s", None if t is None else len(t)) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    mine = __spark_entry__.queries()[name](spark, folder).collect()
    return Counter(map(tuple, mine)), Counter(db.execute(__spark_entry__.oracle_sql()[name]).fetchall())


def test_joined_pages_are_null_where_all_are_blank(spark, tmp_path):
    page = "\n".join("abcdefgh")
    texts = [None, "", " \t\n\f\r", "\n" * 20, page + "\n" * 9 + "z", "\x0b", "\n" * 8 + "\x0b\n" + "\n" * 8 + "z", " ", "\x85\n ", page]
    mine, sql = both(spark, str(tmp_path), "page_join", texts)
    assert mine == sql
    rows = dict(mine.keys())
    assert [rows[k] for k in range(5)] == [None] * 4 + [f"{page}\n\n---\n\nz"] and rows[5] == "\x0b"


def test_tables_without_rows_are_found(spark, tmp_path):
    texts = [None, "", "\n\n\n", "a b\nc\n\nd e", " \n  ", "　\n", "a\n", "x y\nz w\nq", " ", "\n\n.\n", "\n\n \n", "\t", "\x0b\n\f"]
    mine, sql = both(spark, str(tmp_path), "table_integrity", texts)
    assert mine == sql
    assert {k for k, finding, _ in mine if finding == "no rows"} == {0, 1, 2}
    assert {k for k, finding, _ in mine if finding == "no content"} == {0, 1, 2, 4, 5, 8, 10}
    assert {(k, row) for k, finding, row in mine if finding == "uneven row"} >= {(3, 1)}


def test_tables_without_rows_take_one_pass_over_the_cells(spark):
    cells = spark.createDataFrame([(1, 0, 0, "a"), (1, 1, 0, "b"), (1, 1, 1, "c"), (2, 0, 0, None), (None, 0, 0, "d")], "doc_id int, row int, col int, value string")
    tables = spark.createDataFrame([(1,), (2,), (3,), (3,), (None,)], "doc_id int")
    found = T.table_integrity(cells, tables, ("doc_id",))
    assert Counter(map(tuple, found.collect())) == Counter([(1, "uneven row", 1), (2, "no content", None), (3, "no rows", None), (3, "no content", None)])
    assert Counter(map(tuple, T.table_integrity(cells, keys=("doc_id",)).collect())) == Counter([(1, "uneven row", 1), (2, "no content", None)])
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
