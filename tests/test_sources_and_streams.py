import json
import re
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from foliowork.operators import jobs as J
from foliowork.sources import readers as R
from foliowork.sources import sinks as K
from foliowork.streaming import streams as M


def test_readers(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"version": 2, "documents": [{"id": "a", "format": "html"}, {"id": "b", "format": "csv"}]}, indent=1))
    assert [(r.id, r.format) for r in R.read_manifest(spark, str(tmp_path / "m.json")).collect()] == [("a", "html"), ("b", "csv")]
    (tmp_path / "h").mkdir()
    (tmp_path / "h/1.json").write_text('{"id": "x", "created_at": "2024-01-02T03:04:05Z", "title": "T"}\n')
    (tmp_path / "h/2.json").write_text("{broken\n")
    (tmp_path / "h/3.json").write_text('{"id": "y", "created_at": "2025-01-02T03:04:05Z"}\n')
    assert [r.id for r in R.read_history(spark, str(tmp_path / "h")).collect()] == ["y", "x"]
    (tmp_path / "d").mkdir()
    for name in ("a.pdf", "b.exe", "c.HTML"):
        (tmp_path / "d" / name).write_bytes(b"\xe9 text ")
    assert {r.ext: r.verdict for r in R.scan_documents(spark, str(tmp_path / "d")).collect()} == {"pdf": "ok", "exe": "unsupportedType", "html": "ok"}
    raw = spark.createDataFrame([(b" caf\xe9 ",), ("é\n".encode(),), (None,)], "content binary")
    assert [r[0] for r in raw.select(R.decode_text("content")).collect()] == ["café\n", "é\n", None]


def test_sinks(spark, tmp_path):
    base = spark.createDataFrame([("p", 1), ("q", 1)], "pathway string, n int")
    K.replace_baseline(base, str(tmp_path / "b"))
    K.replace_baseline(base.filter("pathway = 'p'").withColumn("n", F.lit(2)), str(tmp_path / "b"))
    assert {(r.pathway, r.n) for r in spark.read.parquet(str(tmp_path / "b")).collect()} == {("p", 2), ("q", 1)}
    doc = spark.createDataFrame([("T", "# x", "s.txt", datetime(2024, 1, 2), "en", "general", "fast", 1)], "title string, markdown string, source_name string, created_at timestamp, language string, type string, pipeline string, pages int")
    payload = json.loads(K.render(doc, "json").first().text)
    assert payload["markdown"] == "# x" and payload["metadata"]["word_count"] == 1 and list(payload) == ["markdown", "metadata", "title"]
    assert K.render(doc, "markdownWithFrontmatter").first().text.startswith('---\ntitle: "T"\nsource: "s.txt"\nconverted: "2024-01-02T00:00:00Z"')


def run(query_frame, mode, name, path):
    q = query_frame.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(path)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return query_frame.sparkSession.table(name)


def stream(spark, rows, schema, folder, files=2):
    """A file stream of the rows, in as many batches as files."""
    for k in range(files):
        spark.createDataFrame(rows[k::files] if files > 1 else rows, schema).coalesce(1).write.mode("append").json(str(folder))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))


FAR = datetime(2099, 1, 1)


def replayed(spark, rows, schema, folder, make, cuts):
    """What a stream gives when its rows come in several lots, the query being started anew for each."""
    out, at = None, 0
    for k, cut in enumerate((*cuts, len(rows))):
        spark.createDataFrame(rows[at:cut], schema).coalesce(1).write.mode("append").json(f"{folder}/in")
        at = cut
        frame = make(spark.readStream.schema(schema).json(f"{folder}/in"))
        q = frame.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/c").trigger(availableNow=True).start()
        q.awaitTermination(120)
        out = frame.schema, q.lastProgress
    return sorted(map(tuple, spark.read.schema(out[0]).parquet(f"{folder}/out").collect())), out[1]


def test_streamed_job_states_match_the_batch_form_however_they_are_cut(spark, tmp_path):
    at = lambda m: datetime(2024, 1, 1, 0, m)
    rows = [(1, at(0), 1, "queued"), (2, at(0), 2, "processing"), (1, at(5), 3, "complete"), (1, at(4), 9, "processing"), (2, at(9), 4, "cancelled"), (1, at(8), 5, "processing"), (3, at(9), 6, "failed"), (3, at(9), 7, "cancelled")]
    schema = "job_id int, ts timestamp, seq int, stage string"
    want = {(r.job_id, r.stage, r.ts) for r in J.job_state(spark.createDataFrame(rows, schema)).collect()}
    for k, cuts in enumerate(((), (3, 6))):
        got, _ = replayed(spark, [*rows, (9, FAR, 0, "queued")], schema, tmp_path / str(k), M.job_state, cuts)
        assert {max((x for x in got if x[0] == j), key=lambda x: x[2]) for j in (1, 2, 3)} == want


def test_streamed_listings_are_stable_after_two_scans_however_they_are_cut(spark, tmp_path):
    at = lambda s: datetime(2024, 1, 1, 0, 0, s)
    rows = [("f", "a", 5, 1.0, at(0)), ("f", "b", 5, 1.0, at(0)), ("f", "b", 6, 2.0, at(4)), ("f", "a", 5, 1.0, at(2)), ("f", "b", 6, 2.0, at(2)), ("f", "c", 1, 1.0, at(4)), ("f", "c", 1, 1.0, at(4))]
    schema = "folder string, name string, size long, modified double, seen_at timestamp"
    for k, cuts in enumerate(((), (1, 5))):
        got, _ = replayed(spark, [*rows, ("f", "z", 0, 0.0, FAR)], schema, tmp_path / str(k), M.stable, cuts)
        assert [(r[1], r[2], r[4].second) for r in got] == [("a", 5, 2), ("b", 6, 4)]


def test_state_is_forgotten_by_event_time(spark, tmp_path):
    day = lambda d: datetime(2024, 1, d)
    rows = [("f", f"n{k}", 1, 1.0, day(1)) for k in range(40)] + [("f", "kept", 1, 1.0, day(1)), ("f", "kept", 1, 1.0, day(9)), ("f", "x", 1, 1.0, day(20)), ("f", "n0", 1, 1.0, day(21))]
    schema = "folder string, name string, size long, modified double, seen_at timestamp"
    got, progress = replayed(spark, [*rows, ("f", "z", 0, 0.0, FAR)], schema, tmp_path, lambda s: M.stable(s, forget=10 * 86400), (42, 43))
    assert [(r[1], r[4]) for r in got] == [("kept", day(9))]  # n0 was forgotten, so that its signature is new
    assert progress["stateOperators"][0]["numRowsTotal"] < 20


def test_watched_listings_give_each_signature_once(spark, tmp_path):
    at = lambda s: datetime(2024, 1, 1, 0, 0, s)
    rows = [("/in/a.html", 5, 1.0, at(1)), ("/in/b.exe", 5, 1.0, at(1)), ("/in/a.html", 5, 1.0, at(2)), ("/in/c.txt", 2, 1.0, at(2)), ("/in/a.html", 5, 2.0, at(3)), ("/in/a.html", 5, 1.0, at(4)), ("/in/c.txt", 2, 1.0, at(4)), ("/in/d.tmp", 1, 1.0, at(4))]
    schema = "path string, size long, modified double, seen_at timestamp"
    want = None
    for k, cuts in enumerate(((), (2, 5))):
        got, _ = replayed(spark, [*rows, ("/in/z.txt", 0, 0.0, FAR)], schema, tmp_path / str(k), M.new_signatures, cuts)
        want = want or got
        assert got == want and [(r[0], r[2], r[3].second) for r in got] == [("/in/a.html", 1.0, 1), ("/in/a.html", 2.0, 3), ("/in/c.txt", 1.0, 2)]


def test_a_conversion_that_is_killed_between_batches_gives_each_document_once(spark, tmp_path, monkeypatch):
    from foliowork.sources import store as S

    schema = "doc_id string, ext string, text string, name string, mtime timestamp"
    for k in range(3):
        rows = [(f"d{k}{n}", "html" if n else "txt", f"<p>text {k}{n}</p>", "n", datetime(2024, 1, 1)) for n in range(3)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    start = lambda: M.convert_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), f"{tmp_path}/store", f"{tmp_path}/c")
    render, calls = S.render, []

    def dies(df, mode):
        calls.append(1)
        if len(calls) == 2:
            render(df, mode).select("doc_id", "text", "file_ext").write.parquet(f"{tmp_path}/store/documents/batch=1")  # half of the batch's tables are there
            raise RuntimeError("killed")
        return render(df, mode)

    monkeypatch.setattr(S, "render", dies)
    query = start()
    try:
        query.awaitTermination(120)
    except Exception as e:
        assert "killed" in str(e)
    assert S.read_documents_store(spark, f"{tmp_path}/store").count() == 3 and len(calls) == 2  # the broken batch does not count
    start().awaitTermination(120)
    texts = {r.doc_id: r.text for r in S.read_documents_store(spark, f"{tmp_path}/store").collect()}
    assert len(texts) == 9 and texts["d11"] == "text 11\n" and S.read_documents_store(spark, f"{tmp_path}/store").count() == 9
    assert S.read_history_store(spark, f"{tmp_path}/store").count() == 9
    # A document that changed counts once, as it is now.
    spark.createDataFrame([("d00", "txt", "new words here", "n", datetime(2024, 2, 1))], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    start().awaitTermination(120)
    assert S.read_history_store(spark, f"{tmp_path}/store").filter("id = 'd00'").first().word_count == 3
    assert S.read_documents_store(spark, f"{tmp_path}/store").filter("doc_id = 'd00'").first().text.strip() == "new words here"


def test_stalls_and_debounce(spark, tmp_path):
    rows = [(1, datetime(2024, 1, 1, 0, 0, 0), 1, "processing"), (1, datetime(2024, 1, 1, 0, 2, 0), 2, "processing"), (1, datetime(2024, 1, 1, 0, 2, 10), 3, "complete")]
    schema = "job_id int, ts timestamp, seq int, stage string"
    out = run(M.stalled(stream(spark, rows, schema, tmp_path / "s", 1)), "append", "stalls", tmp_path / "c1").collect()
    assert [(r.job_id, r.gap) for r in out] == [(1, 120.0)]
    events = [("a", datetime(2024, 1, 1, 0, 0, 0, 0)), ("a", datetime(2024, 1, 1, 0, 0, 0, 500_000)), ("a", datetime(2024, 1, 1, 0, 0, 2)), ("b", datetime(2024, 1, 1, 1, 0, 0))]
    out = run(M.debounce(stream(spark, events, "folder string, ts timestamp", tmp_path / "e", 1), "folder"), "append", "scans", tmp_path / "c2").collect()
    assert sorted(r.n for r in out) == [1, 2]


def test_requests_time_out(spark, tmp_path):
    t = lambda m: datetime(2024, 1, 1, 0, m)
    asked = stream(spark, [("a", t(0)), ("b", t(0)), ("z", t(59))], "id string, ts timestamp", tmp_path / "q", 1)
    answers = stream(spark, [("a", t(5), "done"), ("b", t(30), "late"), ("y", t(59), "x")], "id string, ts timestamp, status string", tmp_path / "r", 1)
    out = {r.id: r.status for r in run(M.match_handoffs(asked, answers), "append", "handoffs", tmp_path / "c").collect()}
    assert out.get("a") == "done" and out.get("b") == "timeout"


def test_watched_folder_is_converted_once(spark, tmp_path):
    from foliowork.sources import store as S

    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.html").write_text("<h1>Hi</h1><p>there</p>")
    (folder / "b.txt").write_text("plain text")
    (folder / "c.tmp").write_text("no")
    for _ in range(2):
        M.convert_stream(M.arriving(M.watch(spark, str(folder))), f"{tmp_path}/store", str(tmp_path / "checkpoint")).awaitTermination(120)
    assert sorted((r.doc_id.split("/")[-1], r.text.strip()) for r in S.read_documents_store(spark, f"{tmp_path}/store").collect()) == [("a.html", "# Hi\n\nthere"), ("b.txt", "plain text")]


def test_a_large_source_is_written_as_many_manifests_and_maps(spark, tmp_path):
    rows = spark.range(900).select(F.when(F.col("id") % 9 > 0, "hot").when(F.col("id") % 2 == 0, "b/c").alias("source"), F.col("id").cast("string").alias("id"))
    K.write_manifests(rows.select("source", "id", F.struct("id", "source").alias("entry")), f"{tmp_path}/m", 50)
    K.write_baselines(rows.filter("source is not null").select(F.col("source").alias("pathway"), F.col("id").alias("doc_id"), F.struct(F.lit("scored").alias("status")).alias("entry")), f"{tmp_path}/b", 50)
    for name, field in (("m", "documents"), ("b", "document_baselines")):
        sizes = [len(re.findall('"id":|"status":', line)) for f in tmp_path.glob(f"{name}/*/*/*.json") for line in f.read_text().splitlines()]
        assert all(f.read_text().count("\n") == 1 for f in tmp_path.glob(f"{name}/*/*/*.json")) and len(sizes) >= 16 and max(sizes) < 100, field
    want = {(r.source, r.id) for r in rows.collect()}
    assert {(r.source, r.id) for r in R.read_manifest(spark, f"{tmp_path}/m/*/*").collect()} == want
    assert {(r.pathway, r.doc_id) for r in R.read_baseline(spark, f"{tmp_path}/b/*/*").collect()} == {x for x in want if x[0]}


def test_bursts_across_time_slices_and_ranks_across_tasks(spark):
    at = lambda s: datetime(2024, 1, 1) + timedelta(seconds=s)
    import random

    draw = random.Random(3)
    times = {key: [at(draw.uniform(0, 3000)) for _ in range(400)] for key in ("a", "b", None)}
    events = spark.createDataFrame([(k, t) for k, own in times.items() for t in own], "folder string, ts timestamp")
    for gap in (1, 10, 100):
        want = []
        for key, own in times.items():
            for t in sorted(own):
                if want and want[-1][0] == key and t < want[-1][2] + timedelta(seconds=gap):
                    want[-1] = (key, want[-1][1], t, want[-1][3] + 1)
                else:
                    want.append((key, t, t, 1))
        got = J.debounce(events, "folder", f"{gap} seconds", time_slice=60).collect()
        assert sorted(((r.folder, r.start, r.scan_at - timedelta(seconds=gap), r.n) for r in got), key=str) == sorted(want, key=str)
    rows = spark.range(5000).select((F.col("id") % 3 > 0).alias("hot"), F.when(F.col("id") % 2 == 0, F.col("id")).alias("n"), "id").repartition(7)
    ranks = J.ranked(rows, ["hot"], ["n", "id"]).collect()
    for hot in (True, False):
        own = sorted((r for r in ranks if r.hot == hot), key=lambda r: (r.n is not None, r.n or 0, r.id))
        assert [r["rank"] for r in own] == list(range(1, len(own) + 1))
    assert J.ranked(rows.limit(0), ["hot"], ["id"]).count() == 0
