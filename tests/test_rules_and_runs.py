from datetime import datetime

from pyspark.sql import functions as F

from foliowork.operators import evaluate as V
from foliowork.operators import evidence as E
from foliowork.operators import gate as G
from foliowork.operators import jobs as J
from foliowork.operators import quality as Q
from foliowork.operators import rules as R

EVIDENCE = {"avg_chars": 500, "avg_lines": 30, "short_ratio": 0.1, "numeric_ratio": 0.0, "axis": False, "rtl": False, "table_like": False, "table_lines": 0, "sampled_pages": 3, "vision": True, "seen_lines": 20, "seen_confidence": 0.9, "pages_with_text": 3, "columns": 1, "dense_pages": 0, "rotated": 0, "oversized": 0, "rectangles": 0, "skew": 0.0, "mixed": False, "language": "en"}


def routed(spark, column, **changes):
    e = EVIDENCE | changes
    return spark.range(1).select(F.struct(*(F.lit(v).alias(k) for k, v in e.items())).alias("e")).select(column(F.col("e")).alias("r")).first().r


def test_routes(spark):
    assert tuple(routed(spark, R.recommend)) == ("pdfKit", 0.70, "native", ["digital text"])
    assert tuple(routed(spark, R.recommend, avg_chars=79, rotated=1)) == ("visionOCR", 0.86, "scannedOrUnknown", ["low native text", "image text detected", "image normalization available"])
    assert routed(spark, R.recommend, avg_lines=46, short_ratio=0.46, rtl=True).reasons == ["right-to-left text", "dense multi-column layout"]
    assert routed(spark, R.recommend, avg_lines=14, axis=True).confidence == 0.74
    assert routed(spark, R.engine) == "model" and routed(spark, R.engine, language="zh-Hant") == "vision" and routed(spark, R.engine, columns=3) == "vision" and routed(spark, R.engine, language="pt-BR") == "model"
    assert routed(spark, R.hints, skew=2.0, mixed=True) == ["crop or deskew document image", "preserve mixed-language text"]


def test_names_requests_and_progress(spark):
    df = spark.createDataFrame([("a.PDF",), ("b.md",), ("draft-1.docx",), ("~$x.docx",)], "name string")
    assert [r[0] for r in df.select(R.match_rules("name", "*.pdf, draft")).collect()] == [True, False, True, False]
    assert [r[0] for r in df.select(R.match_rules("name")).collect()] == [True, False, True, False]
    p = spark.createDataFrame([("processing", 0.5), ("processing", None), ("complete", 0.1), ("copying", float("nan")), ("postProcessing", 9.0)], "stage string, f double")
    assert [round(r[0], 4) for r in p.select(R.progress(F.col("stage"), F.col("f"))).collect()] == [0.54, 0.55, 1.0, 0.06, 0.96]
    text = spark.createDataFrame([("at /Users/me/a/b.pdf, got report.docx via pdfium",)], "t string")
    assert text.select(R.redact("t")).first()[0] == "at [redacted path], got [redacted file] via conversion runtime"
    pages = spark.createDataFrame([("",), ("x\n" * 6,), (" ".join(map(str, range(12))) + " ",), ((" ".join(map(str, range(12))) + " ") * 6,)], "t string")
    assert [r[0] for r in pages.select(R.degenerate("t")).collect()] == [["empty"], ["repeated line"], [], ["repeated phrase"]]


def test_quality_orders_candidates(spark):
    prose = "# Title\n\n" + "\n".join(f"The river of line {i} is long and it was here for the city with a view." for i in range(30))
    rows = [(1, prose, 1, 0), (1, "x", 1, 1), (2, "", 1, 0), (2, "$$$$$$$$$$$ " * 9, 1, 1)]
    s = Q.quality_score(spark.createDataFrame(rows, "doc_id int, markdown string, pages int, ord int"))
    by = {(r.doc_id, r.ord): r for r in s.collect()}
    assert by[2, 0].overall == 0 and by[2, 0].reasons == ["empty output"] and by[1, 0].overall > 0.8
    assert "low coverage" in by[1, 1].reasons and {r.ord for r in Q.select_best(s).filter("doc_id = 1").collect()} == {0}


def test_evidence_rows(spark):
    pages = spark.createDataFrame([(1, p, f"Header\nbody {p} text\n{p}\nFooter") for p in range(7)], "doc_id int, page int, text string")
    assert sorted(r.page for r in E.sample_pages(pages).collect()) == [0, 3, 6] and sorted(r.page for r in E.sample_pages(pages, 1).collect()) == [0]
    e = E.page_evidence(E.sample_pages(pages)).first()
    assert (e.page_count, e.sampled_pages, e.avg_lines, e.numeric_ratio) == (7, 3, 4, 0.25)
    assert {r.line for r in E.running_headers(pages).collect()} == {"Header", "Footer"}
    seg = spark.createDataFrame([(1, 0.0, "a"), (1, 20.0, "b"), (1, 31.0, "c"), (1, 60.0, "d"), (1, 62.0, "e")], "id int, ts double, text string")
    assert E.transcript_blocks(seg).first().markdown == "**[0:00]** a b\n\n**[0:31]** c d\n\n**[1:02]** e"
    boxes = spark.createDataFrame([(1, 1, 0.5, 0.90, 0.1, 0.05, "right"), (1, 1, 0.1, 0.91, 0.1, 0.02, "left"), (1, 1, 0.1, 0.5, 0.1, 0.02, "below")], "doc_id int, page int, x double, y double, w double, h double, text string")
    assert E.reading_rows(boxes).first().text == "left  right\nbelow"


def test_gates_and_samples(spark):
    base = spark.createDataFrame([("p", f"d{i}", "scored", 80.0, 1.0, None) for i in range(4)], "pathway string, doc_id string, status string, overall_percent double, elapsed_seconds double, blocked_reason string")
    now = spark.createDataFrame([("p", "d0", "scored", 50.0, 1.0), ("p", "d1", "scored", 75.0, 1.6), ("p", "d2", "failed", 0.0, 1.0), ("p", "d3", "scored", 83.0, 1.0), ("p", "new", "scored", 1.0, 1.0), ("q", "d0", "scored", 1.0, 1.0)], "pathway string, doc_id string, status string, overall_percent double, elapsed_seconds double")
    found = {(r.doc_id, r.finding) for r in G.compare(now, base).collect()}
    assert found == {("d0", "large regression"), ("d1", "regression"), ("d1", "speed regression"), ("d2", "status change"), ("d3", "uplift"), ("new", "missing baseline")}
    docs = spark.createDataFrame([("d0",), ("zz",)], "doc_id string")
    assert {(r.doc_id, r.expected_status) for r in G.expected_status(docs, base).collect()} == {("d0", "success"), ("zz", "unsupported")}
    keys = spark.range(100).select(F.col("id").alias("key"))
    assert V.stable_sample(keys, 9).collect() == V.stable_sample(keys.orderBy(F.desc("key")).repartition(5), 9).collect()


def test_jobs(spark):
    t = lambda s: datetime(2024, 1, 1, 0, s // 60, s % 60)
    rows = [(1, t(0), 1, "queued"), (1, t(10), 2, "complete"), (1, t(20), 3, "processing"), (2, t(0), 4, "failed"), (2, t(5), 5, "cancelled"), (3, t(0), 6, "processing"), (3, t(70), 7, "processing")]
    p = spark.createDataFrame(rows, "job_id int, ts timestamp, seq int, stage string")
    assert {(r.job_id, r.stage) for r in J.job_state(p).collect()} == {(1, "complete"), (2, "cancelled"), (3, "processing")}
    assert {(r.job_id, r.gap) for r in J.stalled(p).collect() if r.gap == 70.0 and r.job_id == 3} == {(3, 70.0)}
    names = spark.createDataFrame([(1, "f", "a:b", "md"), (2, "f", "a/b", "md"), (3, "g", "a-b", "md")], "doc_id int, folder string, name string, ext string")
    assert [r.file_name for r in J.unique_names(names).orderBy("doc_id").collect()] == ["a-b.md", "a-b 2.md", "a-b.md"]


def test_queries_over_all_documents(spark, tmp_path):
    import __spark_entry__ as entry
    from foliowork.plans.q_pages import line_strips

    texts = ["a\nb\na\nb\na\nb\nc", "x\nx\nx\nx\nx", "src1 here\nis", None, "", *(f"text {k}\n" * (k % 7) + "end" * (k % 90) for k in range(195))]
    rows = [(i, t, "en", f"src{i % 4}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    out = lambda name: entry.queries()[name](spark, str(tmp_path)).collect()
    ids = set(range(len(texts)))
    asked = {r.doc_id: r for r in out("qa_summary")}
    assert set(asked) == ids and all(r.qa_count == 2 for r in asked.values()) and asked[0].hit_rate == 0.5 and asked[4].hit_rate == 0
    assert [r.id for r in out("newest_first")] == sorted(ids, reverse=True)
    assert {r.id for r in out("history_search")} == {i for i in ids if i % 4 == 1 or i == 2}
    status = {r.doc_id: r for r in out("expected_status")}
    ties = [r for r in status.values() if r.best_percent == 50]
    assert set(status) == ids and ties and all(r.status_source == "fast" for r in ties)

    strips, want = {}, {}
    for r in line_strips(spark.read.parquet(f"{tmp_path}/documents.parquet")).collect():
        strips.setdefault(r.table_id, {})[r.strip] = [x[0] for x in r.rows]
    for i, own in strips.items():
        lines = []
        for _, strip in sorted(own.items()):
            n = max((k for k in range(1, 5) if k <= min(len(lines), len(strip)) and lines[-k:] == strip[:k]), default=0)
            lines += strip[n:]
        want[i] = lines
    got = {}
    for r in sorted(out("grid_stitching"), key=lambda r: r.row):
        got.setdefault(r.table_id, []).append(r.key)
    assert got == want and set(got) == ids


def test_queries_over_whole_texts(spark, tmp_path):
    import __spark_entry__ as entry

    long = " ".join(["words"] * 30)
    docs = [(1, long + "\nsecond\nThe settlement", "en", "s", 0), (2, None, "en", "s", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "https://b.example/a%20b/%C3%A9?x=1")], "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    tail = " ".join(f"t{k}" for k in range(9))
    passages = [(1, "a b c " + tail + ". x. y. z. same"), (2, "a b c " + tail + ". x. y. z. other end"), (3, "a b c " + tail + ". x. y. z. other end")]
    spark.createDataFrame(passages, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = lambda name: entry.queries()[name](spark, str(tmp_path)).collect()
    rules = {(r.doc_id, r.line_no): r for r in out("heading_rules")}
    assert rules[1, 0].heading is None and rules[1, 0].first_line == long.upper() and rules[1, 1].first_line == "## second" and len(rules) == 4
    assert [r.decoded for r in out("url_decoding")] == ["https://a.example/https://b.example/a%20b/é?x=1?q=%20x&r=éü%2F"]
    lines = {(r.doc_id, r.line_no): (r.confidence, r.level) for r in out("heading_confidence")}
    assert lines == {(1, 0): (0.3, 3), (1, 1): (0.5, 3), (1, 2): (0.9, 1), (2, 0): (0.0, 0)}
    trees = {r.item_id: (round(r.structural, 6), r.skipped) for r in out("table_tree_similarity")}
    assert trees == {1: (round(1 - 1 / 23, 6), False), 2: (1.0, False)}
