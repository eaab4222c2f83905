"""Composite jobs against plain versions: selection, repair, evaluation, samples, table trees and phrases."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from foliowork.operators import evaluate as V
from foliowork.operators import evidence as E
from foliowork.operators import quality as Q
from foliowork.operators import tables as T
from foliowork.plans import jobs
from foliowork.sources.readers import read_results


def test_the_second_engine_runs_only_where_it_is_needed_and_the_better_output_stays(spark):
    good = "# Title\n\n" + "the cat and the dog are in the house with a man. " * 30
    rows = [(1, good, 1, False, False), (2, "x", 1, False, False), (3, good, 1, True, False), (4, "", 1, False, False), (5, None, 1, False, False)]
    basic = spark.createDataFrame(rows, "doc_id int, markdown string, pages int, scanned boolean, special boolean")
    asked = []

    def second(needy):
        asked.extend(r.doc_id for r in needy.collect())
        return needy.withColumn("markdown", F.when(F.col("doc_id") == 3, "bad").otherwise(F.lit(good)))

    got = {r.doc_id: (r.ord, r.markdown) for r in Q.quality_select(basic, second).collect()}
    from foliowork.operators.rules import needs_secondary

    scored = {r.doc_id: r for r in Q.quality_score(basic).withColumn("n", needs_secondary(F.col("pages"), F.col("scanned"), F.col("special"), F.col("overall"))).collect()}
    assert set(asked) == {k for k, r in scored.items() if r.n} and 1 not in asked and {2, 4, 5} <= set(asked)
    for k, r in scored.items():
        other = 0.0 if k not in asked else Q.quality_score(spark.createDataFrame([("bad" if k == 3 else good, 1)], "markdown string, pages int")).first().overall
        assert got[k] == ((1, "bad" if k == 3 else good) if other > r.overall else (0, r.markdown))
    union = Q.union_candidates(basic.select("doc_id", "markdown"), basic.select("doc_id", "pages")).collect()
    assert len(union) == 10 and {(r.ord, r.markdown is None) for r in union if r.doc_id == 1} == {(0, False), (1, True)}


def test_repair_brings_back_levels_and_tables(spark):
    original = "# One\n\ntext\n\n| a | b |\n| --- | --- |\n| 1 | 2 |\n\n## Two\n\nmore\n\n- x\n- y"
    converted = "### One\n\ntext\n\n## Two\n\nmore\n\n- x\n- y"
    rows = [(1, original, converted), (2, original, original), (3, None, "a"), (4, "", "")]
    got = {r.doc_id: r for r in jobs.repair(spark.createDataFrame(rows, "doc_id int, original string, converted string")).collect()}
    lines = got[1].markdown.split("\n")
    assert "# One" in lines and "### One" not in lines and "## Two" in lines and [x for x in lines if x.startswith("|")] == ["| a | b |", "| --- | --- |", "| 1 | 2 |"]
    assert got[1].before < 1.0 == got[1].after and got[2].after == 1.0 and len(got) == 4
    assert [x for x in got[2].markdown.split("\n") if x] == [x for x in original.split("\n") if x]


def test_an_evaluation_run_compares_what_is_open_and_sums_it_up(spark, tmp_path):
    truth = spark.createDataFrame([(k, f"the words of passage number {k} here") for k in range(6)], "key long, text string")
    outputs = spark.createDataFrame([(0, "the words of passage number 0 here"), (1, "the words of passage number one"), (2, "x"), (3, ""), (4, "the words of passage number 4 here")], "key long, markdown string")
    done = spark.createDataFrame([(4, "e", "ok"), (3, "e", "ok"), (2, "f", "ok"), (1, "e", "low_content")], "key long, engine string, status string")
    asked = spark.createDataFrame([(0, "q", "number 0"), (2, "q", "passage"), (4, "q", "passage")], "key long, question string, answer string")
    sure = spark.createDataFrame([(0, 0.5), (2, 0.7), (4, 0.1)], "key long, confidence double")
    cell = lambda *own: [[(c, 1, 1) for c in own]]
    tables = spark.createDataFrame([(0, cell("a", "b"), cell("a", "b")), (2, cell("a", "b"), None), (4, cell("a"), cell("a"))], "key long, truth array<array<struct<value:string,colspan:int,rowspan:int>>>, other array<array<struct<value:string,colspan:int,rowspan:int>>>")
    run = jobs.evaluate(truth, outputs, done, "e", 6, asked, sure, tables, log=str(tmp_path / "log"))
    rows = {r.key: r for r in run.rows.collect()}
    assert set(rows) == {0, 2, 3, 5}  # 4 is done, 1 is final; 3 was ok without a word
    assert (rows[0].sim, rows[0].ned, rows[0].cer, rows[0].completeness, rows[0].f1) == (1.0, 0.0, 0.0, 1.0, 1.0) and rows[5].status == "missing" and rows[2].cer == 1.0
    assert {(r.key, r.status, r.md_words) for r in read_results(spark, str(tmp_path / "log")).select(F.col("key").cast("long").alias("key"), "status", "md_words").collect()} == {(0, "ok", 7), (2, "ok", 1), (3, "ok", 0), (5, "missing", 0)}
    assert (run.similarity.first().n, run.fidelity.first().total) == (4, 4)
    answers, seen, board = run.answers.first(), run.recognition.first(), run.tables.first()
    assert (answers.questions, answers.answered, answers.hit_rate) == (2, 1, 0.5)
    assert (seen.total, seen.min_confidence, seen.max_confidence) == (4, 0.5, 0.7)
    assert (board.n, board.missing, board.total) == (2, 1, 50.0)
    assert jobs.evaluate(truth, outputs, done, "e", 6).answers.first().questions == 0


@pytest.mark.parametrize("n", [0, 1, 50, 1999, 2000, 5000])
def test_samples_are_the_least_hashes(spark, n):
    want = sorted(range(2000), key=lambda k: (hashlib.md5(f"7:{k}".encode()).hexdigest(), k))[:n]
    got = V.stable_sample(spark.range(2000).withColumnRenamed("id", "key").repartition(5), n).collect()
    assert sorted(r.key for r in got) == sorted(want)


def plain_tree_distance(a, b, structural):
    """Edit distance of two forests of (label, children), by the definition."""
    from functools import cache

    def edit(x, y):
        line = list(range(len(y) + 1))
        for i, p in enumerate(x, 1):
            last, line[0] = line[0], i
            for j, q in enumerate(y, 1):
                last, line[j] = line[j], min(line[j] + 1, line[j - 1] + 1, last + (p != q))
        return line[-1]

    def rename(x, y):
        if x[0] != y[0] or x[2:] != y[2:]:
            return 1.0
        return 0.0 if structural or x[1] == y[1] else edit(x[1], y[1]) / max(len(x[1]), len(y[1]))

    size = lambda forest: sum(1 + size(t[1]) for t in forest)

    @cache
    def distance(f, g):
        if not f or not g:
            return float(size(f) + size(g))
        (x, own), (y, other) = f[-1], g[-1]
        return min(distance(f[:-1] + own, g) + 1, distance(f, g[:-1] + other) + 1, distance(own, other) + distance(f[:-1], g[:-1]) + rename(x, y))

    def tree(rows):
        return ((("table", "", 1, 1), tuple((("row", "", 1, 1), tuple((("cell", *c), ()) for c in r)) for r in rows)),)

    x, y = tree(a), tree(b)
    return 1 - distance(x, y) / max(size(x), size(y))


def test_table_trees_are_compared_by_their_definition():
    draw = random.Random(2)
    table = lambda: [[("".join(draw.choices("abc", k=draw.randint(0, 3))), draw.choice([1, 1, 2]), 1) for _ in range(draw.randint(0, 3))] for _ in range(draw.randint(0, 4))]
    for k in range(150):
        a, b = table(), table()
        if k % 3 == 0:
            b = [list(r) for r in a] + table()[:1]
        for structural in (True, False):
            assert abs(T.tree_similarity(a, b, structural) - plain_tree_distance(a, b, structural)) < 1e-9, (a, b)
    large = [[[(f"cell {i} {j % m}", 1, 1) for j in range(20)] for i in range(95)] for m in (5, 7)]
    assert 0.5 < T.tree_similarity(*large) < 1.0  # 1,996 nodes each


def test_phrases_are_ranked_runs_between_stop_words(spark):
    text = "Big red house of the big red house, and small dog. The small dog! big red house one"
    rows = spark.createDataFrame([(1, text), (2, None), (3, "the of and"), (4, "alpha beta")], "doc_id int, text string")
    got = sorted((r.doc_id, r.rank, r.phrase, r.n) for r in E.key_phrases(rows).collect())
    assert got == [(1, 1, "big red house", 2), (1, 2, "small dog", 2), (1, 3, "big red house one", 1), (4, 1, "alpha beta", 1)]
    assert [r.rank for r in E.key_phrases(rows, most=1).collect()] == [1, 1]


def test_matching_blocks_are_those_of_the_definition(monkeypatch):
    import difflib

    draw = random.Random(8)
    pairs = [([], []), (["a"], []), (["a"] * 300, ["a"] * 300)]
    for _ in range(250):
        words = [f"w{k}" for k in range(draw.choice([2, 5, 40, 400]))]
        a = draw.choices(words, k=draw.randint(0, 320))
        b = list(a)
        for _ in range(draw.randint(0, 40)):
            at = draw.randint(0, len(b))
            b[at : at + draw.randint(0, 9)] = draw.choices(words, k=draw.randint(0, 9))
        pairs.append((a, b if draw.random() < 0.7 else draw.choices(words, k=draw.randint(0, 320))))
    want = [sum(m.size for m in difflib.SequenceMatcher(None, a, b).get_matching_blocks()) for a, b in pairs]
    assert [T.matched_words(a, b) for a, b in pairs] == want
    monkeypatch.setattr(T, "PAIRS_AT_ONCE", 100)  # row by row
    assert [T.matched_words(a, b) for a, b in pairs[:120]] == want[:120]


def test_a_lexicon_is_learned_and_gives_the_tone_of_lines(spark):
    docs = [(k, "good day\nyou fool" if k < 4 else "good day now") for k in range(8)] + [(20, None), (21, "good fool\n\nnone here"), (22, "xyz")]
    frame = spark.createDataFrame(docs, "doc_id int, text string")
    marks = spark.createDataFrame([(k, int(k < 4)) for k in range(8)] + [(20, None), (99, 1)], "doc_id int, bad int")
    lexicon = E.learn_lexicon(frame, marks, least=4)
    tones = {r.word: r.tone for r in lexicon.collect()}
    assert tones == {"good": 0.0, "day": 0.0, "you": -1.0, "fool": -1.0, "now": 1.0}
    got = {r.doc_id: r.sentiment for r in E.sentiment_by(frame, lexicon).collect()}
    assert got[0] == -0.5 and got[5] == pytest.approx(1 / 3) and got[21] == -0.5 and got[20] is None and got[22] is None and len(got) == 11
    assert E.learn_lexicon(frame, marks.filter("bad = 1"), least=1).count() == 0
