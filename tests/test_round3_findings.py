"""Findings of round 3, each with the input that was wrong or too dear before."""

import re
from datetime import datetime

import duckdb
from pyspark.sql import functions as F

import __spark_entry__
from foliowork.functions import text as X
from foliowork.operators import evidence as E
from foliowork.operators import html as H
from foliowork.operators import quality as Q
from foliowork.operators import structure as S
from foliowork.operators import tables as T
from foliowork.plans import q_pages
from foliowork.streaming import streams as M


def test_outline_and_its_sql_read_entities_alike(spark, tmp_path):
    heads = ["a &quot;b&quot;", " x&nbsp;&amp;  *y* ", "&#65;&#x42;&#0;&#xD800;", "&nope; & c", "plain\n\tone"]
    html = [(k, f"<h1>{h}</h1><p>text</p>") for k, h in enumerate(heads)]
    spark.createDataFrame(html, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    mine = {(r.page_id, r.heading) for r in __spark_entry__.queries()["page_outline"](spark, str(tmp_path)).collect()}
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert mine == set(db.execute(q_pages.ORACLES["page_outline"]).fetchall())
    assert (0, '# a "b"') in mine and (2, "# AB��") in mine


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_cells_of_pages_are_counted_where_the_page_lies(spark):
    html = "<tr><td>no</td></tr><TABLE><tr><td colspan=2 rowspan='3'>a<!-- c -->&amp;</td></td><th>b <table><tr><td>in</td></tr></table> out</th></tr><tr></td><td>late</td></table>x"
    pages = spark.createDataFrame([(1, html), (2, None), (3, "<script><table></script>")], "page_id int, html string")
    cells = H.page_tables(pages)
    rows = [tuple(r) for r in cells.orderBy("page_id", "table_id", "row", "col").collect()]
    assert rows == [(1, 0, 0, 0, "a&", 2, 3), (1, 1, 0, 0, "in", 1, 1), (1, 1, 1, 0, "", 1, 1)]
    assert "Exchange" not in plan(cells)


def test_csv_documents_are_taken_apart_where_they_lie(spark):
    texts = ['a,b\n"x, ""y""",2\n\nq|r', 'h\r\n"m\nn",z\r\n', "", "a;b\tc", None, '""', '"open,1\n2', 'a"b,c"d,e\r', ",\n,,", "1\r2\n\r3"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    cells = T.csv_cells(docs)
    assert "Exchange" not in plan(cells)
    drawn = {r.doc_id: r.markdown for r in T.cells_to_markdown(cells).collect()}
    assert {r.doc_id: r.m for r in docs.select("doc_id", T.csv_markdown("text").alias("m")).collect()} == {k: drawn.get(k, "") for k in range(len(texts))}


def test_word_sets_are_made_once(spark, tmp_path):
    spark.createDataFrame([(1, "en", "s", "A b\nab cd ab"), (2, "en", "s", None)], "doc_id long, lang string, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    df = __spark_entry__.queries()["token_overlap"](spark, str(tmp_path))
    assert df._jdf.queryExecution().optimizedPlan().toString().count(r"[^\p{L}\p{N}]+") == 2  # one for each text
    assert [tuple(r) for r in df.filter("doc_id = 2").collect()] == [(2, 0.0, 1.0, 1.0, 0)]
    sizes = spark.createDataFrame([("a b", "b c"), ("", "x"), (None, "")], "a string, b string").select(X.token_f1("a", "b").alias("f"), X.completeness("a", "b").alias("c"), X.agreement("a", "b").alias("g"))
    assert [tuple(r) for r in sizes.collect()] == [(0.5, 0.5, 0.0), (0.0, 1.0, 0.0), (1.0, 1.0, 0.0)]


def test_artifacts_are_counted_as_by_the_patterns_alone(spark):
    texts = ["a- b- c", "�\xad", "x\n12\ny\n3\n4\nz", "aaaaaaaaaaaaaaaaaaab", "- -", "aaaaaaaa", "bbbbbbbbb ccccccccc", "a-\n b", "---------"]
    patterns = ("[�\xad]", r"\n\d{1,3}\n", r"[A-Za-z]-\s+[a-z]", r"([^\-|= \t])\1{8,}")
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    want = [sum(sum(1 for _ in re.finditer(p, t.strip(), re.ASCII)) for p in patterns) for t in texts]
    assert [r.n for r in d.select(X.artifact_count("t").alias("n")).collect()] == want
    # words are counted once for a score
    scored = Q.quality_score(d.select(F.col("t").alias("markdown"), F.lit(1).alias("pages")))
    assert scored._jdf.queryExecution().optimizedPlan().toString().count(r"\s+, -1") == 1


def test_boxes_are_shuffled_as_runs_of_a_page(spark):
    boxes = spark.createDataFrame([(1, k % 2, 0.1 * k, 0.5, 0.01, f"w{k}") for k in range(4)] + [(None, 0, 0.0, 0.5, 0.01, "n")], "doc_id long, page int, x double, y double, h double, text string")
    rows = {(r.doc_id, r.page): r.text for r in E.reading_rows(boxes).collect()}
    assert rows == {(1, 0): "w0  w2", (1, 1): "w1  w3", (None, 0): "n"}
    assert "_packed_runs" in plan(E.reading_rows(boxes))


def test_strips_of_a_table_are_one_row(spark):
    strips = spark.createDataFrame([(1, 1, [["B ", None], ["c", "3"]]), (1, 0, [["a", "1"], ["b", "2"]])], "table_id int, strip int, rows array<array<string>>")
    assert [r.cells for r in T.stitch(strips).orderBy("row").collect()] == [["a", "1"], ["b", "2"], ["c", "3"]]
    assert "FlatMapGroups" not in plan(T.stitch(strips))


def test_names_are_matched_once_and_texts_of_watched_files_are_not_carried_on(spark, tmp_path, monkeypatch):
    from foliowork.operators import rules as R
    from foliowork.plans import q_streams

    names = ["a.md", "b.MD.pdf", "x.tmp", "~$draft.docx", None, "c*.md", "plain.html", "d.json\n"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    match = df.select(R.match_rules("name").alias("m"))
    assert [r.m for r in match.collect()] == [False, True, False, False, True, False, True, False]
    assert plan(match).count("RLIKE") == 1
    seen = []
    monkeypatch.setattr(q_streams, "in_two_runs", lambda rows, *_: seen.append(rows) or rows)
    spark.createDataFrame([(1, "s", "abc")], "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    q_streams.QUERIES["watched_files"](spark, str(tmp_path))
    generate = [line for line in plan(seen[0]).splitlines() if "Generate explode" in line]
    assert generate and not any("text#" in line for line in generate)


ODD = ["", None, "#", "# ", "#\t#", "##x", " \t# a\r\n- b\r* c |d", "-", "- ", "- \t", "* |", "| a | b |\n|a|\n||a||b||\n| |\n#a|b", "a|b\r\r\n|\x0b|a\x0c|b", "\n\n# one\n\n## two\ntext that is long enough\n# ", "#\u0085a - b\n # c\n | ", "x\r", "# a\r# b\r\n", "- a\n-b\n*  c"]


def test_table_rows_and_words_are_those_of_the_plain_rules(spark):
    df = spark.createDataFrame(list(enumerate(ODD)), "doc_id int, text string")
    for r in df.select("text", S.structure("text").alias("s"), X.word_count(X.col("text")).alias("n")).collect():
        blank, text = " \t\n\x0b\f\r", r.text or ""
        own = [x.strip(blank) for x in re.sub(r"\r\n|\r", "\n", text).split("\n")]
        assert r.s.tables == sum(not x.startswith("#") and sum(c.strip(blank) != "" for c in x.split("|")) > 1 for x in own), text
        assert r.n == sum(w != "" for w in re.split("[ \t\n\x0b\f\r]+", text)), text


def test_findings_need_no_lines_of_their_own(spark):
    texts = list(enumerate(ODD))
    a, b = (spark.createDataFrame(rows, "doc_id int, text string") for rows in (texts, [(k, ODD[(k + 5) % len(ODD)]) for k, _ in texts]))
    found = S.structure_findings(a, b)
    assert "Window" not in plan(found) and "Generate posexplode" not in plan(found)
    rows = {(r.doc_id, r.category): r.amount for r in found.collect()}
    aligned = S.align_headings(S.line_table(a), S.line_table(b)).groupBy("doc_id").agg(F.sum(F.col("level_differs").cast("int")).alias("l"), F.sum(F.col("text_differs").cast("int")).alias("t")).collect()
    short = S.sections(S.line_table(b)).filter(F.length(X.trim_all(F.col("content"))) < S.SHORT_SECTION).groupBy("doc_id").count().collect()
    wanted = {(r.doc_id, "headingLevelWrong"): r.l for r in aligned if r.l} | {(r.doc_id, "headingTextChanged"): r.t for r in aligned if r.t} | {(r.doc_id, "emptySection"): r["count"] for r in short}
    assert {k: v for k, v in rows.items() if not k[1].startswith("missing")} == wanted and wanted


def test_conversion_measures_each_text_once(spark):
    from foliowork.plans import jobs

    rows = [(1, "txt", "# a\n- b | c\n| d | e |\n\nword"), (2, "csv", "a,b\n- c,d"), (3, None, None), (4, "html", "<h1>x</h1><ul><li>y</ul>")]
    raw = jobs.extract(spark.createDataFrame(rows, "doc_id int, ext string, text string")).cache()
    done = jobs.finish(raw)
    assert plan(done).count(r"\A[|\s]*+[^|\s]") == 2
    plain = S.validate_content(done.drop("retention_ratio", "warnings", "passed"), "raw", "markdown")
    kept = S.retention(S.structure("raw"), S.structure("markdown"))
    columns = ("doc_id", "retention_ratio", "warnings", "passed")
    assert sorted(map(tuple, done.select(*columns, "retention", "coverage").collect())) == sorted(map(tuple, Q.quality_score(plain).select(*columns, kept.alias("retention"), "coverage").collect()))


def test_streamed_job_states_do_not_open_a_store_for_every_shuffle_partition(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("foliowork.plans.q_streams.scratch_folder", lambda *_: str(tmp_path / "stream"))
    monkeypatch.setattr("foliowork.streaming.ordered.STORES", 2, raising=False)
    kind = "elt(id % 5 + 1, 'signup', 'view', 'click', 'purchase', 'error') AS event_type"
    spark.range(100).selectExpr("id AS event_id", "timestamp_seconds(id * 60) AS ts", "id % 7 AS user_id", kind, "1.0D AS value").write.parquet(f"{tmp_path}/events.parquet")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 12)
    try:
        mine = {tuple(r) for r in __spark_entry__.queries()["streamed_job_states"](spark, str(tmp_path)).collect()}
        assert spark.conf.get("spark.sql.shuffle.partitions") == "12"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len([p for p in (tmp_path / "stream/checkpoint/state/0").iterdir() if p.name.isdigit()]) <= 2 * spark.sparkContext.defaultParallelism == 8
    assert mine == {tuple(r) for r in __spark_entry__.queries()["job_state"](spark, str(tmp_path)).collect()}


def test_rows_of_a_stream_reach_its_step_as_arrow_batches(spark):
    rows = spark.readStream.format("rate").load().selectExpr("value as job_id", "timestamp as ts", "value as seq", "'queued' as stage")
    assert "FlatMapGroupsInPandasWithState" in M.job_state(rows)._jdf.queryExecution().analyzed().toString()  # not row by row


def test_waiting_rows_are_taken_when_others_come_and_late_rows_are_left_out(spark, tmp_path):
    at = lambda h: datetime(2024, 1, 1, h)
    lots = [[(1, at(0), 1, "processing"), (2, at(1), 2, "complete")], [(2, at(5), 3, "processing"), (1, at(4), 5, "queued"), (1, at(4), 4, "processing")], [(3, at(9), 6, "queued")], [(1, at(2), 7, "failed"), (3, at(12), 8, "cancelled"), (3, at(13), 9, "processing")], [(0, datetime(2099, 1, 1), 0, "queued")]]
    for lot in lots:
        spark.createDataFrame(lot, "job_id int, ts timestamp, seq int, stage string").coalesce(1).write.mode("append").json(f"{tmp_path}/in")
    out = M.job_state(spark.readStream.schema("job_id int, ts timestamp, seq int, stage string").option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in"), forget=366 * 86400)
    out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination(120)
    states = {(r.job_id, r.ts.hour): r.stage for r in spark.read.schema(out.schema).parquet(f"{tmp_path}/out").collect()}
    assert states[1, 4] == "queued" and states[2, 1] == "complete" and states[3, 12] == "cancelled"
    assert (2, 5) not in states and (1, 2) not in states and (3, 13) not in states
