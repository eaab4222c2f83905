"""Steps that must grow with the input and not with the square of a text's length or with a call for each key."""

import time

from pyspark.sql import functions as F

from foliowork.functions import text as X
from foliowork.operators import evidence as E
from foliowork.operators import quality as Q
from foliowork.operators import rules as R
from foliowork.operators import structure as S
from foliowork.streaming import ordered


def timed(f):
    start = time.monotonic()
    return f(), time.monotonic() - start


def test_labels_are_paired_from_the_first_on_in_linear_time(spark):
    d = spark.createDataFrame([("a b c xx d e\n f \n",), ("",), (None,)], "text string")
    pairs = d.select(S.repair_labels(F.split("text", " ", -1)).alias("x"))
    assert [r.x for r in pairs.collect()] == [["ab", "c", "xx", "de\n", "f", "\n"], [""], None]
    long = spark.range(1).select(F.size(S.repair_labels(F.split(F.repeat(F.lit("ab a b "), 50_000), " ", -1))).alias("n"))
    n, seconds = timed(lambda: long.first().n)
    assert n == 100_001 and seconds < 30


def test_headings_take_their_levels_in_linear_time(spark):
    d = spark.createDataFrame([("lead\r\n ### a\nx\n#\n## b\n# c", "# A\n## B\n#\n### C"), ("## a", ""), ("", "# A")], "c string, o string")
    assert [r.x for r in d.select(S.repair_headings("c", "o").alias("x")).collect()] == ["lead\n\n\n# a\nx\n## \n### b\n\n\n# c".replace("## \n", "\n\n## \n").replace("### b", "\n\n### b"), "## a", ""]


def test_lines_with_marks_are_found_in_the_whole_text(spark):
    texts = ["x\r # a", "x\n-  b", "- ", "1. c", "x 1. c", "| - | : |", " | - |", "|--|\r\nx", "```", ""]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(F.round(Q.structure_score(F.col("t")), 2).alias("s")).collect()
    assert [r.s for r in got] == [0.63, 0.55, 0.45, 0.55, 0.45, 0.67, 0.45, 0.67, 0.53, 0.45]


def test_letter_runs_vote_for_languages(spark):
    d = spark.createDataFrame([("The cat, the dog_and THE therapy; une",), ("...",), (None,)], "t string")
    got = [r.l for r in d.select(E.detect_language("t").alias("l")).collect()]
    assert [(x.lang, round(x.confidence, 2)) for x in got] == [("en", 0.8), (None, 0.35), (None, 0.35)]


def test_confidence_of_a_heading_is_computed_once(spark):
    c = R.heading_confidence("t", ("tion",), ("is",))
    plan = spark.createDataFrame([("Der Station",)], "t string").select(c.alias("h")).select("h.*")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("tion") <= 2


def test_white_space_is_trimmed_without_a_pattern(spark):
    d = spark.createDataFrame([(" \t\n\x0b\f\ra b\r\n ",)], "t string").select(X.trim_all(F.col("t")).alias("t"))
    assert d.first().t == "a b" and "regexp" not in d._jdf.queryExecution().optimizedPlan().toString()


def test_a_bucket_holds_many_keys(spark):
    assert ordered.BUCKETS < 10_000
    fold = lambda rows, last: (rows.groupby("run").tail(1)[["run", "n"]], rows[["k"]])
    p = ordered._InOrder(["k"], ["time_us", "n", "k"], ["k", "last_us", "n"], [], fold, 1000)
    calls = []

    class List:
        def __init__(self):
            self.rows = []

        def get(self):
            return iter(self.rows)

        def put(self, rows):
            calls.append(1)
            self.rows = rows

        def appendList(self, rows):
            calls.append(1)
            self.rows = self.rows + rows

        def clear(self):
            self.rows = []

    import pandas as pd

    class Handle:
        def getListState(self, *_):
            return List()

        def registerTimer(self, at):
            pass

    class Watermark:
        def getCurrentWatermarkInMs(self):
            return 10

    p.init(Handle())
    rows = pd.DataFrame({"time_us": range(1000), "n": range(1000), "k": [f"k{i}" for i in range(1000)]})
    assert list(p.handleInputRows((0,), iter([rows]), None)) == []
    out = list(p.handleExpiredTimer((0,), Watermark(), None))
    assert len(out[0]) == 1000 and len(calls) == 2  # a call for a table of rows, not for each key
