"""Queries over evaluations, gates, jobs and histories, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliowork.functions import text as X
from foliowork.operators import evaluate as V
from foliowork.operators import gate as G
from foliowork.operators import jobs as J
from foliowork.operators.rules import search_history
from foliowork.operators.structure import structure
from foliowork.plans.q_evidence import _STAGE, stage_column
from foliowork.plans.q_structure import _counts, _sql_lines
from foliowork.plans.q_text import PAIRS, passage_pairs, sql_distance, sql_word_rates
from foliowork.plans.tables import STRUCTURED, book, read, sql_tokens, sql_trim, structured

query, QUERIES, ORACLES = book()

# Results of a run and of a baseline, as fixed functions of the documents.


def results(spark, sf, shift: int = 0):
    d, n = F.col("doc_id"), F.length(X.col("text"))
    score = ((n * 7 + d * 13 + shift * (d % 5)) % 101).cast("double")
    status = F.when((d + shift) % 37 == 0, "expected_blocked").when(d % 41 == 0, "failed").otherwise("scored")
    return read(spark, sf, "documents").select(
        "doc_id", F.col("source").alias("pathway"), F.col("lang").alias("category"), status.alias("status"), score.alias("overall_percent"),
        ((n % 50 + 1) / 10.0 * (1 + shift * (d % 3) / 2.0)).alias("elapsed_seconds"), F.when(d % 74 == 0, "password_required").alias("blocked_reason"), d.alias("run_order"),
    )


def _results(name: str, shift: int = 0) -> str:
    n = "length(coalesce(text, ''))"
    return f"""{name} AS (SELECT doc_id, source AS pathway, lang AS category, CASE WHEN (doc_id + {shift}) % 37 = 0 THEN 'expected_blocked' WHEN doc_id % 41 = 0 THEN 'failed' ELSE 'scored' END AS status, (({n} * 7 + doc_id * 13 + {shift} * (doc_id % 5)) % 101)::DOUBLE AS overall_percent,
 (({n} % 50 + 1) / 10.0::DOUBLE * (1 + {shift} * (doc_id % 3) / 2.0::DOUBLE))::DOUBLE AS elapsed_seconds, CASE WHEN doc_id % 74 = 0 THEN 'password_required' END AS blocked_reason FROM documents)"""


_FINDINGS = """c AS (SELECT r.pathway, r.doc_id, r.status, b.status AS bs, b.doc_id IS NULL AS missing, coalesce(r.overall_percent, 0) - coalesce(b.overall_percent, 0) AS delta, r.elapsed_seconds AS s, b.elapsed_seconds AS b_s FROM r LEFT JOIN b USING (pathway, doc_id) WHERE r.pathway IN (SELECT pathway FROM b)),
 f AS (SELECT *, NOT missing AND status = bs AND status NOT IN ('expected_blocked', 'environment_blocked') AS scored FROM c),
 findings AS (SELECT pathway, doc_id, unnest(list_filter([CASE WHEN missing THEN 'missing baseline' END, CASE WHEN NOT missing AND status <> bs THEN 'status change' END, CASE WHEN scored THEN CASE WHEN delta <= -25 THEN 'large regression' WHEN delta <= -5 THEN 'regression' WHEN delta >= 3 THEN 'uplift' END END,
  CASE WHEN scored AND b_s > 0 AND s > b_s * 1.5 THEN 'speed regression' END], lambda x: x IS NOT NULL)) AS finding, CASE WHEN NOT missing THEN delta END AS delta FROM f)"""


@query(f"WITH {_results('r', 9)}, {_results('b0')}, b AS (SELECT * FROM b0 WHERE doc_id % 7 > 0 AND pathway <> 'src3'), {_FINDINGS} SELECT * FROM findings")
def regression_findings(spark, sf):
    base = results(spark, sf).filter((F.col("doc_id") % 7 > 0) & (F.col("pathway") != "src3"))
    return G.compare(results(spark, sf, 9), base)


def _registry(spark, sf):
    formats = F.when(F.col("source") == "src1", F.array(F.lit("en"), F.lit("de"))).otherwise(F.array(F.lit("fr")))
    sources = read(spark, sf, "documents").select("source").distinct()
    return sources.select(F.col("source").alias("pathway"), F.when(F.col("source").isin("src1", "src2"), "shipping").otherwise("internal").alias("release_status"), formats.alias("valid_formats"))


@query("SELECT doc_id, lang AS format FROM documents WHERE lang NOT IN ('en', 'de', 'fr')")
def pathway_coverage(spark, sf):
    return G.uncovered(read(spark, sf, "documents").select("doc_id", F.col("lang").alias("format")), _registry(spark, sf))


@query("SELECT 'x-' || lang AS format FROM (SELECT DISTINCT lang FROM documents WHERE lang <> 'en')")
def stale_exemptions(spark, sf):
    d = read(spark, sf, "documents")
    exempt = d.select(F.when(F.col("lang") == "en", F.col("lang")).otherwise(F.concat(F.lit("x-"), F.col("lang"))).alias("format"))
    return G.stale_exemptions(exempt, d.select(F.col("lang").alias("format")))


@query(f"WITH {_results('r')}, s AS (SELECT category, avg(overall_percent) AS actual FROM r WHERE category <> 'es' GROUP BY 1), f AS (SELECT DISTINCT category, CASE WHEN category = 'en' THEN 10.0 ELSE 90.0 END::DOUBLE AS minimum FROM r) SELECT category, CASE WHEN actual IS NULL THEN 'missing category' ELSE 'below floor' END AS finding, actual, minimum FROM f LEFT JOIN s USING (category) WHERE actual IS NULL OR actual < minimum")
def category_floors(spark, sf):
    r = results(spark, sf)
    floors = r.select("category", F.when(F.col("category") == "en", 10.0).otherwise(90.0).alias("minimum")).distinct()
    return G.check_floors(r.filter("category <> 'es'").groupBy("category").agg(F.avg("overall_percent").alias("score")), floors)


@query("""WITH m AS (SELECT doc_id AS id, lang AS category, source AS format FROM documents WHERE doc_id % 10 > 0), l AS (SELECT doc_id AS id, CASE WHEN doc_id % 9 = 0 THEN 'xx' ELSE lang END AS category, CASE WHEN doc_id % 8 = 0 THEN NULL ELSE source END AS format FROM documents WHERE doc_id % 11 > 0)
 SELECT id, unnest(list_filter([CASE WHEN m.id IS NULL THEN 'unknown id' END, CASE WHEN l.id IS NULL THEN 'missing id' END, CASE WHEN m.id IS NOT NULL AND l.id IS NOT NULL AND m.category IS DISTINCT FROM l.category THEN 'category changed' END, CASE WHEN m.id IS NOT NULL AND l.id IS NOT NULL AND m.format IS DISTINCT FROM l.format THEN 'format changed' END], lambda x: x IS NOT NULL)) AS finding FROM m FULL JOIN l USING (id)""")
def ledger_reconciliation(spark, sf):
    d = read(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("category"), F.col("source").alias("format"))
    ledger = d.filter(F.col("id") % 11 > 0).withColumns({"category": F.when(F.col("id") % 9 == 0, "xx").otherwise(F.col("category")), "format": F.when(F.col("id") % 8 != 0, F.col("format"))})
    return G.reconcile(d.filter(F.col("id") % 10 > 0), ledger)


@query("""WITH d AS (SELECT CASE WHEN doc_id % 97 = 0 THEN NULL WHEN doc_id % 50 = 0 THEN 50 ELSE doc_id END AS id, source || '/' || doc_id AS path, doc_id FROM documents)
 SELECT id, CASE WHEN id IS NULL THEN 'null id' ELSE 'duplicate id' END AS finding FROM d GROUP BY id HAVING id IS NULL OR count(*) > 1 UNION ALL SELECT id, 'missing file' FROM d WHERE doc_id % 13 = 0""")
def manifest_integrity(spark, sf):
    d = F.col("doc_id")
    docs = read(spark, sf, "documents").select("doc_id", F.when(d % 97 == 0, None).when(d % 50 == 0, 50).otherwise(d).alias("id"), F.concat_ws("/", "source", "doc_id").alias("path"))
    return G.check_manifest(docs.drop("doc_id"), docs.filter(d % 13 > 0).select("path"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_keys(spark, sf):
    return G.missing_keys(read(spark, sf, "documents"), read(spark, sf, "labels"), "doc_id")


@query("""SELECT item_id || '.txt' AS path, CASE WHEN item_id % 5 = 0 THEN 'absent' WHEN item_id % 5 = 1 THEN 'not expected' ELSE 'changed' END AS finding FROM benchmark WHERE item_id % 5 < 3""")
def asset_verification(spark, sf):
    b = read(spark, sf, "benchmark").withColumn("path", F.concat(F.col("item_id").cast("string"), F.lit(".txt")))
    expected = b.filter("item_id % 5 <> 1").select("path", F.when(F.col("item_id") % 5 == 2, F.sha2(F.lit("other"), 256)).otherwise(F.upper(F.sha2("text", 256))).alias("sha256"))
    return G.verify_assets(expected, b.filter("item_id % 5 <> 0").select("path", F.encode("text", "UTF-8").alias("content")))


@query(f"WITH {_results('r')} SELECT pathway, category, count(*) AS documents, avg(overall_percent) AS score, avg(elapsed_seconds) AS seconds, count(*) FILTER (status = 'failed') AS failed, grouping_id(pathway, category)::BIGINT AS level FROM r GROUP BY ROLLUP (pathway, category)")
def corpus_summary(spark, sf):
    return G.corpus_summary(results(spark, sf))


_MODES = "two AS (SELECT doc_id, category, 'fast' AS pathway, overall_percent, elapsed_seconds FROM r UNION ALL SELECT doc_id, category, 'enhanced', least(100.0, overall_percent + doc_id % 9 - 3), elapsed_seconds * 4 FROM r)"


def _two(spark, sf):
    r = results(spark, sf).select("doc_id", "category", F.lit("fast").alias("pathway"), "overall_percent", "elapsed_seconds")
    more = F.least(F.lit(100.0), F.col("overall_percent") + F.col("doc_id") % 9 - 3)
    return r.unionByName(r.withColumns({"pathway": F.lit("enhanced"), "overall_percent": more, "elapsed_seconds": F.col("elapsed_seconds") * 4}))


@query(f"WITH {_results('r')}, {_MODES} SELECT doc_id, max(overall_percent) FILTER (pathway = 'fast') AS fast, max(overall_percent) FILTER (pathway = 'enhanced') AS enhanced FROM two GROUP BY doc_id")
def score_matrix(spark, sf):
    return G.score_matrix(_two(spark, sf), ["fast", "enhanced"])


@query(f"WITH {_results('r')}, {_MODES}, m AS (SELECT category, avg(overall_percent) FILTER (pathway = 'fast') AS a, avg(overall_percent) FILTER (pathway = 'enhanced') AS b FROM two GROUP BY 1) SELECT category, a, b, b - a AS delta, CASE WHEN abs(b - a) <= 1 THEN 'tie' WHEN b > a THEN 'enhanced' ELSE 'fast' END AS winner FROM m")
def pipeline_delta(spark, sf):
    return G.compare_pipelines(_two(spark, sf), "fast", "enhanced")


@query(f"WITH {_results('r')}, m AS (SELECT category AS pathway, doc_id % 2 AS mode, count(*) AS n, sum(elapsed_seconds) / (1 + 2 * (doc_id % 2)) AS wall, avg(overall_percent) AS score, count(*) FILTER (status = 'failed') AS failed FROM r GROUP BY category, doc_id % 2) SELECT a.pathway, (b.n / b.wall) / (a.n / a.wall) AS speedup, b.score - a.score AS score_delta, b.failed - a.failed AS failed_delta FROM m a JOIN m b ON a.pathway = b.pathway AND a.mode = 0 AND b.mode = 1")
def serial_parallel(spark, sf):
    mode = F.when(F.col("doc_id") % 2 == 0, "serial").otherwise("parallel")
    runs = results(spark, sf).groupBy(F.col("category").alias("pathway"), mode.alias("mode")).agg(F.count("*").alias("documents"), F.sum("elapsed_seconds").alias("s"), F.avg("overall_percent").alias("score"), F.count_if(F.col("status") == "failed").alias("failed"))
    return G.compare_runs(runs.withColumn("wall_seconds", F.col("s") / F.when(F.col("mode") == "serial", 1).otherwise(3)))


@query("WITH a AS (SELECT lang AS format, count(*) AS actual FROM documents GROUP BY 1), b AS (SELECT lang AS format, count(*) AS expected FROM documents WHERE source <> 'src0' OR lang = 'en' GROUP BY 1 UNION ALL SELECT 'xx', 3) SELECT format, actual, expected FROM a FULL JOIN b USING (format) WHERE actual IS DISTINCT FROM expected")
def format_distribution(spark, sf):
    d = read(spark, sf, "documents").select(F.col("lang").alias("format"), "source")
    stored = d.filter("source <> 'src0' or format = 'en'").groupBy("format").agg(F.count("*").alias("n")).unionByName(d.limit(1).select(F.lit("xx").alias("format"), F.lit(3).cast("long").alias("n")))
    return G.format_counts(d, stored)


@query(f"""WITH {_results('r')}, b AS (SELECT doc_id, 'fast' AS pathway, status, blocked_reason, overall_percent FROM r WHERE doc_id % 19 > 0 UNION ALL SELECT doc_id, 'slow', CASE WHEN doc_id % 3 = 0 THEN 'failed' ELSE status END, NULL, 100 - overall_percent FROM r WHERE doc_id % 19 > 0),
 k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY overall_percent DESC, pathway) AS k FROM b WHERE status = 'scored'), g AS (SELECT doc_id, bool_or(status = 'expected_blocked' AND blocked_reason IS NOT DISTINCT FROM 'password_required') AS pw FROM b GROUP BY doc_id)
 SELECT r.doc_id, CASE WHEN coalesce(pw, false) THEN 'password_required' WHEN k.doc_id IS NULL THEN 'unsupported' WHEN k.overall_percent < 70 THEN 'degraded_output' ELSE 'success' END AS expected_status, CASE WHEN coalesce(pw, false) THEN 'password_required' WHEN k.doc_id IS NULL THEN 'no_scored_pathway' ELSE k.pathway END AS status_source,
 CASE WHEN NOT coalesce(pw, false) THEN k.overall_percent END AS best_percent FROM r LEFT JOIN g ON g.doc_id = r.doc_id LEFT JOIN k ON k.doc_id = r.doc_id AND k.k = 1""")
def expected_status(spark, sf):
    """All documents, those with equal scores of both pathways too."""
    r = results(spark, sf).filter(F.col("doc_id") % 19 > 0)
    fast = r.select("doc_id", F.lit("fast").alias("pathway"), "status", "blocked_reason", "overall_percent")
    slow = r.select("doc_id", F.lit("slow").alias("pathway"), F.when(F.col("doc_id") % 3 == 0, "failed").otherwise(F.col("status")).alias("status"), F.lit(None).cast("string").alias("blocked_reason"), (100 - F.col("overall_percent")).alias("overall_percent"))
    return G.expected_status(results(spark, sf), fast.unionByName(slow))


@query(f"""WITH {_results('r')}, g AS (SELECT category AS dataset, pathway AS name, avg(overall_percent) AS o, avg(elapsed_seconds) / 50 AS c, max(overall_percent) AS h FROM r GROUP BY 1, 2), l AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY name DESC) AS n FROM g)
 SELECT dataset, greatest(75, floor(o * 0.85::DOUBLE))::BIGINT AS overall_min, least(0.10::DOUBLE, c * 1.5::DOUBLE) AS cer_max, greatest(60, floor(h * 0.9::DOUBLE))::BIGINT AS recall_min FROM l WHERE n = 1""")
def threshold_bootstrap(spark, sf):
    reports = results(spark, sf).groupBy(F.col("category").alias("dataset"), F.col("pathway").alias("name")).agg(
        F.avg("overall_percent").alias("overall_percent"), (F.avg("elapsed_seconds") / 50).alias("avg_cer"), F.max("overall_percent").alias("heading_recall")
    )
    return G.bootstrap_thresholds(reports)


@query(f"WITH {_results('r')} SELECT pathway, count(*) AS documents, median(elapsed_seconds) AS median, max(elapsed_seconds) AS maximum, avg(elapsed_seconds) AS mean, count(*) / sum(elapsed_seconds) AS docs_per_second FROM r GROUP BY pathway")
def latency_percentiles(spark, sf):
    return G.latency(results(spark, sf))


@query(f"WITH {_results('a')}, {_results('b', 9)} SELECT doc_id, pathway, 2::BIGINT AS run, b.overall_percent - a.overall_percent AS delta FROM a JOIN b USING (doc_id, pathway)")
def run_delta(spark, sf):
    return G.run_delta(results(spark, sf).withColumn("run", F.lit(1)).unionByName(results(spark, sf, 9).withColumn("run", F.lit(2))))


@query(f"""WITH {_results('r', 9)}, {_results('b')}, {_FINDINGS}, fl AS (SELECT category, avg(overall_percent) AS actual FROM r GROUP BY 1)
 SELECT 'regression' AS check, pathway || '/' || doc_id AS subject, finding FROM findings WHERE finding <> 'uplift' UNION ALL SELECT 'floor', category, 'below floor' FROM fl WHERE actual < 60 UNION ALL SELECT 'coverage', doc_id::VARCHAR, 'no shipping pathway' FROM documents WHERE lang NOT IN ('en', 'de', 'fr')""")
def release_gate(spark, sf):
    now = results(spark, sf, 9)
    docs = read(spark, sf, "documents").select("doc_id", F.col("lang").alias("format"))
    return G.gate(now, results(spark, sf), now.select("category", F.lit(60.0).alias("minimum")).distinct(), docs, _registry(spark, sf))


# Evaluation


def _outputs(spark, sf):
    s = structured(read(spark, sf, "documents"))
    a = s.select(F.col("doc_id").alias("id"), F.lit("alpha").alias("engine"), F.col("converted").alias("text")).filter("id % 6 > 0")
    return a.unionByName(s.select(F.col("doc_id").alias("id"), F.lit("beta").alias("engine"), F.col("original").alias("text")).filter("id % 4 > 0"))


_OUT = f"{STRUCTURED}, outputs AS (SELECT doc_id AS id, 'alpha' AS engine, converted AS text FROM structured WHERE doc_id % 6 > 0 UNION ALL SELECT doc_id, 'beta', original FROM structured WHERE doc_id % 4 > 0), truth AS (SELECT doc_id AS id, text FROM documents)"
_SET = f"list_distinct({sql_tokens('{x}')})"


def _complete(ref: str, hyp: str) -> str:
    r, h = _SET.replace("{x}", f"coalesce({ref}, '')"), _SET.replace("{x}", f"coalesce({hyp}, '')")
    return f"CASE WHEN len({r}) = 0 THEN 1.0 ELSE len(list_intersect({r}, {h})) / len({r}) END"


@query(f"WITH {_OUT}, t AS (SELECT id, CASE WHEN id % 5 > 0 THEN text END AS truth FROM truth), j AS (SELECT t.id, truth, o.text, o.id IS NULL AS missing FROM t LEFT JOIN outputs o ON o.id = t.id AND engine = 'alpha') SELECT id, missing, CASE WHEN truth IS NULL THEN CASE WHEN missing THEN 1.0 ELSE 0.0 END WHEN missing THEN 0.0 ELSE {_complete('truth', 'text')} END AS score FROM j")
def prediction_pairs(spark, sf):
    truth = read(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 5 > 0, F.col("text")).alias("text"))
    p = V.pair(_outputs(spark, sf).filter("engine = 'alpha'"), truth)
    return p.select("id", "missing", V.pair_score(X.completeness("truth", "prediction")).alias("score"))


@query(f"WITH {_OUT} SELECT t.id, e.engine, o.text IS NULL AS missing FROM truth t CROSS JOIN (SELECT DISTINCT engine FROM outputs) e LEFT JOIN outputs o ON o.id = t.id AND o.engine = e.engine")
def engine_grid(spark, sf):
    return V.engine_grid(read(spark, sf, "documents").select(F.col("doc_id").alias("id")), _outputs(spark, sf)).select("id", "engine", "missing")


@query("SELECT doc_id AS key FROM documents WHERE NOT (doc_id % 4 = 0 OR (doc_id % 4 = 1 AND doc_id % 3 > 0))")
def resume_filter(spark, sf):
    d = read(spark, sf, "documents").select(F.col("doc_id").alias("key"), "text")
    status = F.when(F.col("key") % 4 == 0, "low_content").when(F.col("key") % 4 == 1, "ok").otherwise("timeout")
    outputs = d.select("key", F.when(F.col("key") % 3 == 0, "![x](y.png)").otherwise(F.concat(F.lit("word "), X.col("text"))).alias("markdown"))
    return V.todo(d.select("key"), d.select("key", F.lit("alpha").alias("engine"), status.alias("status")), outputs, "alpha")


@query(f"WITH {_OUT}, k AS (SELECT max(id) AS id FROM outputs WHERE id % 12 > 0) SELECT t.id, t.text AS truth, max(o.text) FILTER (engine = 'alpha') AS alpha, max(o.text) FILTER (engine = 'beta') AS beta FROM truth t JOIN k USING (id) LEFT JOIN outputs o ON o.id = t.id GROUP BY t.id, t.text")
def side_by_side(spark, sf):
    out = _outputs(spark, sf)
    key = out.filter("id % 12 > 0").agg(F.max("id")).first()[0]
    return V.side_by_side(read(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"), out, key, ["alpha", "beta"])


_RATES = f"""{PAIRS}, rates AS (SELECT item_id AS id, {sql_distance('r', 'h')} / length(r) AS cer, CASE WHEN item_id % 7 = 0 THEN 'failed' END AS error, {_complete('reference', 'text')} AS completeness FROM norm)"""


def _rates(spark, sf):
    p = passage_pairs(spark, sf).withColumnRenamed("item_id", "id")
    error = F.when(F.col("id") % 7 == 0, "failed")
    return p.select("id", X.cer("reference", "text").alias("cer"), X.wer("reference", "text").alias("wer"), X.completeness("reference", "text").alias("completeness"), error.alias("error"))


@query(f"WITH RECURSIVE {_RATES}, {sql_word_rates('pairs')} SELECT count(*) AS total, count(*) FILTER (error IS NULL) AS successful, count(*) FILTER (error IS NOT NULL) AS failed, avg(cer) FILTER (error IS NULL) AS avg_cer, min(cer) FILTER (error IS NULL) AS min_cer, max(cer) FILTER (error IS NULL) AS max_cer, avg(wer) FILTER (error IS NULL) AS avg_wer, avg(completeness) FILTER (error IS NULL) AS avg_completeness, (1 - avg(cer) FILTER (error IS NULL)) * 100 AS overall_percent FROM rates JOIN word_rates ON item_id = id")
def fidelity_summary(spark, sf):
    return V.fidelity_summary(_rates(spark, sf))


@query(f"WITH {_RATES} SELECT CASE WHEN c < 0.01 THEN 'excellent' WHEN c < 0.05 THEN 'good' WHEN c < 0.1 THEN 'fair' ELSE 'poor' END AS band, count(*) AS n FROM (SELECT cer / (1 + (id % 4) * (id % 4) * 10) AS c FROM rates) GROUP BY 1")
def quality_bands(spark, sf):
    k = F.col("id") % 4
    return V.quality_bands(_rates(spark, sf).withColumn("cer", F.col("cer") / (1 + k * k * 10)))


@query(f"WITH {_RATES} SELECT arg_min(id, (cer, id)) AS best, min(cer) AS best_rate, arg_max(id, (cer, -id)) AS worst, max(cer) AS worst_rate FROM rates")
def extreme_documents(spark, sf):
    return V.extremes(_rates(spark, sf))


@query("""WITH q AS (SELECT doc_id, 'q' AS question, CASE WHEN doc_id % 6 = 0 THEN '' ELSE lower(substr(coalesce(text, ''), 1 + (doc_id % 3) * 40, 12)) END AS answer FROM documents), n AS (SELECT q.doc_id, array_to_string(list_filter(string_split_regex(lower(answer), '\\s+'), lambda t: t <> ''), ' ') AS a,
 array_to_string(list_filter(string_split_regex(lower(coalesce(d.text, '')), '\\s+'), lambda t: t <> ''), ' ') AS t FROM q JOIN documents d ON d.doc_id = q.doc_id) SELECT doc_id, a <> '' AS answered, a <> '' AND contains(t, a) AS hit FROM n""")
def answer_containment(spark, sf):
    d = read(spark, sf, "documents")
    answer = F.when(F.col("doc_id") % 6 == 0, "").otherwise(F.lower(F.substring(X.col("text"), 1 + (F.col("doc_id") % 3) * 40, F.lit(12))))
    return V.qa_hits(d.select("doc_id", F.lit("q").alias("question"), answer.alias("answer")), d).select("doc_id", "answered", "hit")


@query("""WITH q AS (SELECT doc_id, lower(substr(coalesce(text, ''), 1 + (doc_id % 3) * 40, 12)) AS answer FROM documents UNION ALL SELECT doc_id, lower(substr(coalesce(text, ''), 50, 12)) || '##' FROM documents), n AS (SELECT q.doc_id, array_to_string(list_filter(string_split_regex(lower(answer), '\\s+'), lambda t: t <> ''), ' ') AS a,
 array_to_string(list_filter(string_split_regex(lower(coalesce(d.text, '')), '\\s+'), lambda t: t <> ''), ' ') AS t FROM q JOIN documents d ON d.doc_id = q.doc_id) SELECT doc_id, count(*) AS qa_count, count(*) FILTER (a <> '' AND contains(t, a)) / count(*) AS hit_rate, count(*) FILTER (a <> '' AND contains(t, a)) / count(*) AS exact_rate FROM n GROUP BY doc_id""")
def qa_summary(spark, sf):
    """Every document is asked for a stretch of its own text, and for one with marks behind it that it hardly has."""
    d = read(spark, sf, "documents")
    own = F.lower(F.substring(X.col("text"), 1 + (F.col("doc_id") % 3) * 40, F.lit(12)))
    other = F.concat(F.lower(F.substring(X.col("text"), 50, 12)), F.lit("##"))
    asked = d.select("doc_id", F.posexplode(F.array(own, other)).alias("n", "answer")).withColumn("question", F.concat(F.lit("q"), F.col("n")))
    return V.qa_summary(V.qa_hits(asked.select("doc_id", "question", "answer"), d)).select("doc_id", "qa_count", "hit_rate", "exact_rate")


#: Neighbouring words of a passage by which documents that may hold it are found.
KEY_WORDS = 5


@query("SELECT item_id, count(*) AS holding FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY item_id")
def passage_containment(spark, sf):
    """Documents that hold a passage whole; they share the first five of its words that must be whole words there too.

    Passages with fewer such words have no key and are looked for in every text.
    """
    b = read(spark, sf, "benchmark").select("item_id", F.col("text").alias("passage"), F.split("text", r"\s+", -1).alias("w"))
    d = read(spark, sf, "documents").select("doc_id", "text")
    keyed = F.size("w") >= KEY_WORDS + 2  # the first and the last word may go on in a document
    keys = b.filter(keyed).select("item_id", F.xxhash64(F.array_join(F.slice("w", 2, KEY_WORDS), " ")).alias("key"))
    w = d.select("doc_id", F.split("text", r"\s+", -1).alias("w"))
    at = F.sequence(F.lit(1), F.size("w") - KEY_WORDS + 1)
    windows = w.filter(F.size("w") >= KEY_WORDS).select("doc_id", F.explode(F.array_distinct(F.transform(at, lambda i: F.xxhash64(F.array_join(F.slice("w", i, KEY_WORDS), " "))))).alias("key"))
    found = windows.join(keys, "key").select("doc_id", "item_id").join(d, "doc_id").join(b.select("item_id", "passage"), "item_id")
    short = d.join(b.filter(~keyed).select("item_id", "passage"), F.contains("text", "passage"))
    return found.filter(F.contains("text", "passage")).select("item_id").unionAll(short.select("item_id")).groupBy("item_id").agg(F.count("*").alias("holding"))


@query(rf"SELECT count(*) AS total, avg(c) AS avg_confidence, min(c) AS min_confidence, max(c) AS max_confidence, sum(a)::BIGINT AS artifacts, avg(a) AS avg_artifacts, avg(v) AS avg_coverage FROM (SELECT (doc_id % 100) / 100.0::DOUBLE AS c, len(regexp_extract_all(coalesce(text, ''), '[�\x{{00AD}}ﬁﬂﬀ]')) AS a, least(1.0, len({sql_tokens(chr(99) + 'oalesce(text, ' + chr(39) * 2 + ')')}) / 50.0) AS v FROM documents)")
def ocr_summary(spark, sf):
    return V.ocr_summary(read(spark, sf, "documents").withColumn("confidence", F.col("doc_id") % 100 / 100.0))


@query("""WITH p AS (SELECT source AS engine, (doc_id % 100) / 100.0::DOUBLE AS structural, (doc_id * 7 % 100) / 100.0::DOUBLE AS total, doc_id % 9 = 0 AS missing, length(coalesce(text, '')) AS nodes FROM documents)
 SELECT engine, count(*) FILTER (nodes <= 4000) AS n, avg(structural) FILTER (nodes <= 4000) * 100 AS structural, avg(total) FILTER (nodes <= 4000) * 100 AS total, count(*) FILTER (missing) AS missing, count(*) FILTER (nodes > 4000) AS skipped FROM p GROUP BY engine""")
def engine_leaderboard(spark, sf):
    d = F.col("doc_id")
    p = read(spark, sf, "documents").select(F.col("source").alias("engine"), (d % 100 / 100.0).alias("structural"), (d * 7 % 100 / 100.0).alias("total"), (d % 9 == 0).alias("missing"), F.length(X.col("text")).alias("nodes"), F.lit(0).alias("truth_nodes"))
    return V.leaderboard(p)


@query("SELECT source AS engine, count(*) AS n, avg((doc_id % 100) / 100.0::DOUBLE) AS mean FROM documents GROUP BY 1")
def mean_similarity(spark, sf):
    return V.mean_similarity(read(spark, sf, "documents").select(F.col("source").alias("engine"), (F.col("doc_id") % 100 / 100.0).alias("sim")))


_RUNS = f"""ch AS (SELECT doc_id, unnest(string_split(t, '')) AS c, generate_subscripts(string_split(t, ''), 1) AS i FROM (SELECT doc_id, {sql_trim('converted')} AS t FROM structured)),
 runs AS (SELECT doc_id, c, i - row_number() OVER (PARTITION BY doc_id, c ORDER BY i) AS g FROM ch WHERE c NOT IN ('-', '|', '=', ' ', chr(9), chr(10), chr(13))),
 long AS (SELECT doc_id, count(*) AS n_runs FROM (SELECT doc_id, c, g FROM runs GROUP BY ALL HAVING count(*) >= 9) GROUP BY doc_id)"""
_ART = rf"(len(regexp_extract_all({sql_trim('converted')}, '[�\x{{00AD}}]')) + len(regexp_extract_all({sql_trim('converted')}, '\n\d{{1,3}}\n')) + len(regexp_extract_all({sql_trim('converted')}, '[A-Za-z]-\s+[a-z]')))"


@query(f"""WITH {STRUCTURED}, {_RUNS}, {_sql_lines('original', 'o')}, {_sql_lines('converted', 'c')}, a AS ({_counts('o', 't_')}), b AS ({_counts('c', 'o_')}),
 j AS (SELECT doc_id, a.*, b.*, len({sql_tokens('converted')}) / greatest(len({sql_tokens('original')}), 1) AS ratio, {sql_trim('converted')} <> '' AS ok, {_ART} + coalesce(n_runs, 0) AS art FROM a JOIN b USING (doc_id) JOIN structured USING (doc_id) LEFT JOIN long USING (doc_id))
 SELECT doc_id, (CASE WHEN t_headings = 0 THEN 1.0 ELSE least(1.0, o_headings / t_headings) END * 30 + CASE WHEN t_tables = o_tables THEN 1.0 ELSE least(t_tables, o_tables) / greatest(t_tables, o_tables, 1) END * 25 + CASE WHEN ratio BETWEEN 0.8 AND 1.2 THEN 1.0 ELSE greatest(0.0, 1 - abs(1 - ratio)) END * 30 + ok::INT * 10 + (art = 0)::INT * 5) AS overall_percent FROM j""")
def corpus_score(spark, sf):
    s = structured(read(spark, sf, "documents"))
    frame = s.select("doc_id", F.col("original").alias("truth"), F.col("converted").alias("text"), structure("original").alias("truth_structure"), structure("converted").alias("text_structure"))
    return V.corpus_score(frame).select("doc_id", "overall_percent")


@query("SELECT key FROM (SELECT doc_id AS key FROM documents ORDER BY md5('7:' || doc_id), doc_id LIMIT 50) ORDER BY key")
def stable_sample(spark, sf):
    return V.stable_sample(read(spark, sf, "documents").select(F.col("doc_id").alias("key")), 50)


@query("SELECT true AS size_ok, true AS unique_ok, 0::BIGINT AS missing")
def sample_check(spark, sf):
    d = read(spark, sf, "documents").select(F.col("doc_id").alias("key"))
    return V.check_sample(V.stable_sample(d, 50), 50, d)


@query("SELECT dataset, key FROM (SELECT lang AS dataset, doc_id AS key, row_number() OVER (PARTITION BY lang ORDER BY md5('7:' || doc_id), doc_id) AS r FROM documents) WHERE r <= 20")
def dataset_sample(spark, sf):
    return V.sample_dataset(read(spark, sf, "documents").select(F.col("lang").alias("dataset"), F.col("doc_id").alias("key")), 20)


# Jobs and histories


def progress_events(spark, sf):
    e = read(spark, sf, "events")
    return e.select(F.col("user_id").alias("job_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), stage_column().alias("stage"), (F.col("value") / 100).alias("progress"))


_P = f"p AS (SELECT user_id AS job_id, ts, event_id AS seq, {_STAGE} AS stage, value / 100 AS progress FROM events)"
_DONE = "('complete', 'failed', 'cancelled')"


@query(f"WITH {_P}, d AS (SELECT *, coalesce(bool_or(stage IN {_DONE}) OVER (PARTITION BY job_id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS done FROM p), k AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, seq DESC) AS r FROM d WHERE NOT done OR stage = 'cancelled') SELECT job_id, stage, epoch_us(ts) AS ts_us FROM k WHERE r = 1")
def job_state(spark, sf):
    return J.job_state(progress_events(spark, sf)).select("job_id", "stage", F.unix_micros("ts").alias("ts_us"))


@query(f"WITH {_P}, n AS (SELECT *, coalesce(lead(ts) OVER (PARTITION BY job_id ORDER BY ts, seq), (SELECT max(ts) FROM p)) AS nxt FROM p) SELECT job_id, epoch_us(ts) AS ts_us, (epoch_us(nxt) - epoch_us(ts)) / 1e6::DOUBLE AS gap FROM n WHERE stage NOT IN {_DONE} AND epoch_us(nxt) - epoch_us(ts) >= 60000000")
def stalled_jobs(spark, sf):
    return J.stalled(progress_events(spark, sf)).select("job_id", F.unix_micros("ts").alias("ts_us"), "gap")


@query("SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 5 AS allowed FROM events")
def first_n_quota(spark, sf):
    return J.quota(read(spark, sf, "events"), "user_id", "ts").select("event_id", "user_id", "allowed")


@query(f"WITH {_P} SELECT job_id, stage, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6::DOUBLE AS seconds FROM p GROUP BY job_id, stage")
def stage_durations(spark, sf):
    return J.stage_durations(progress_events(spark, sf))


@query(f"WITH {_P} SELECT job_id, 'engine.failed' AS error_code, epoch_us(ts) AS ts_us FROM p WHERE stage = 'failed' ORDER BY ts DESC, seq DESC LIMIT 1")
def last_failure(spark, sf):
    f = J.last_failure(progress_events(spark, sf).withColumn("error_code", F.lit("engine.failed")))
    return f.select("job_id", "error_code", F.unix_micros("ts").alias("ts_us"))


@query(f"WITH {_P}, s AS (SELECT job_id, arg_max(stage, (ts, seq)) AS stage, arg_max(progress, (ts, seq)) AS progress FROM p GROUP BY job_id) SELECT coalesce(avg(progress) FILTER (stage NOT IN {_DONE}), 1.0) AS progress FROM s")
def overall_progress(spark, sf):
    last = progress_events(spark, sf).groupBy("job_id").agg(F.max_by("stage", F.struct("ts", "seq")).alias("stage"), F.max_by("progress", F.struct("ts", "seq")).alias("progress"))
    return G.overall_progress(last)


@query("""WITH t AS (SELECT conv_id, turn, role, TIMESTAMP '2024-01-01' + INTERVAL 1 SECOND * (conv_id * 3600 + turn * (conv_id % 5) * 300) AS ts FROM conversations), q AS (SELECT conv_id AS id, min(ts) AS ts FROM t WHERE role = 'user' GROUP BY 1)
 SELECT q.id, CASE WHEN count(a.ts) > 0 THEN 'answered' ELSE 'timeout' END AS status FROM q LEFT JOIN t a ON a.conv_id = q.id AND a.role = 'assistant' AND a.ts >= q.ts AND a.ts <= q.ts + INTERVAL 600 SECOND GROUP BY q.id""")
def request_matching(spark, sf):
    c = F.col("conv_id")
    ts = F.timestamp_seconds(F.unix_seconds(F.lit("2024-01-01").cast("timestamp")) + c * 3600 + F.col("turn") * (c % 5) * 300)
    t = read(spark, sf, "conversations").select(c.alias("id"), "role", ts.alias("ts"))
    return J.match_handoffs(t.filter("role = 'user'").select("id", "ts"), t.filter("role = 'assistant'").select("id", "ts", F.lit("answered").alias("status")))


def listings(spark, sf):
    e = read(spark, sf, "events")
    return e.select(F.col("event_type").alias("folder"), F.concat(F.when(F.col("user_id") % 7 == 0, ".").otherwise(""), F.col("user_id")).alias("name"), F.floor(F.col("value") / 40).cast("long").alias("size"), (F.col("user_id") % 3).cast("double").alias("modified"), F.col("ts").cast("timestamp").alias("seen_at"), "event_id")


_LIST = "l AS (SELECT event_type AS folder, CASE WHEN user_id % 7 = 0 THEN '.' ELSE '' END || user_id AS name, floor(value / 40)::BIGINT AS size, (user_id % 3)::DOUBLE AS modified, ts AS seen_at, event_id FROM events)"


@query(f"WITH {_LIST}, b AS (SELECT *, lag(size) OVER w AS s, lag(modified) OVER w AS m, lag(seen_at) OVER w AS t FROM l WINDOW w AS (PARTITION BY folder, name ORDER BY seen_at)) SELECT folder, name, size, epoch_us(seen_at) AS us FROM b WHERE s = size AND m = modified AND epoch_us(seen_at) - epoch_us(t) >= 1000000")
def stable_listings(spark, sf):
    return J.stable(listings(spark, sf)).select("folder", "name", "size", F.unix_micros("seen_at").alias("us"))


@query(f"WITH {_LIST} SELECT folder, name, size, modified, epoch_us(min(seen_at)) AS us FROM l GROUP BY ALL")
def first_sightings(spark, sf):
    return J.first_sightings(listings(spark, sf)).select("folder", "name", "size", "modified", F.unix_micros("seen_at").alias("us"))


@query("""WITH g AS (SELECT event_type, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 10 MINUTE THEN 1 ELSE 0 END AS s FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts)), n AS (SELECT *, sum(s) OVER (PARTITION BY event_type ORDER BY ts) AS k FROM g)
 SELECT event_type, epoch_us(min(ts)) AS start_us, epoch_us(max(ts) + INTERVAL 10 MINUTE) AS scan_us, count(*) AS n FROM n GROUP BY event_type, k""")
def debounced_scans(spark, sf):
    e = read(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return J.debounce(e, "event_type", "10 minutes").select("event_type", F.unix_micros("start").alias("start_us"), F.unix_micros("scan_at").alias("scan_us"), "n")


@query("WITH m AS (SELECT max(ts) AS now FROM events) SELECT event_id AS seq, epoch_us(ts) AS us FROM events, m WHERE ts <= now AND ts > now - INTERVAL 900 SECOND ORDER BY ts DESC, event_id DESC LIMIT 200")
def recent_log_tail(spark, sf):
    e = read(spark, sf, "events").select(F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"))
    now = F.lit(e.agg(F.max("ts")).first()[0])
    return J.log_tail(e, now).select("seq", F.unix_micros("ts").alias("us"))


@query(f"WITH {_LIST} SELECT folder, sum(size)::BIGINT AS bytes FROM l WHERE NOT starts_with(name, '.') GROUP BY folder")
def directory_size(spark, sf):
    return J.directory_size(listings(spark, sf))


def records(spark, sf, late: bool):
    return _records(read(spark, sf, "documents").filter(F.col("doc_id") % (3 if late else 2) == 0), late)


def _records(base, late: bool):
    d = F.col("doc_id")
    created = F.timestamp_seconds(F.lit(1_700_000_000) + d * 60 + (F.when(d % 4 == 0, 7200).otherwise(-7200) if late else F.lit(0)))
    return base.select(d.alias("id"), created.alias("created_at"), F.lit("new" if late else "old").alias("version"), F.col("source").alias("title"), "lang", X.col("text").alias("markdown"))


_HIST = """recs AS (SELECT doc_id AS id, 1700000000 + doc_id * 60 + CASE WHEN doc_id % 4 = 0 THEN 7200 ELSE -7200 END AS stamp, 'new' AS version, 1 AS prior FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, 1700000000 + doc_id * 60, 'old', 0 FROM documents WHERE doc_id % 2 = 0)"""


@query(f"WITH {_HIST} SELECT id, stamp, version FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY stamp DESC, prior DESC) AS r FROM recs) WHERE r = 1")
def history_upsert(spark, sf):
    return J.upsert_history(records(spark, sf, True), records(spark, sf, False)).select("id", F.unix_seconds("created_at").alias("stamp"), "version")


@query(f"WITH {_HIST} SELECT id, stamp, version FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY prior DESC, stamp DESC) AS r FROM recs) WHERE r = 1")
def history_merge(spark, sf):
    return J.merge_history(records(spark, sf, True), records(spark, sf, False)).select("id", F.unix_seconds("created_at").alias("stamp"), "version")


@query("SELECT doc_id AS id FROM documents ORDER BY doc_id DESC")
def newest_first(spark, sf):
    return J.newest_first(_records(read(spark, sf, "documents"), False)).select("id")


@query("SELECT doc_id AS id FROM documents WHERE contains(lower(source), 'src1') OR contains(lower(coalesce(text, '')), 'src1')")
def history_search(spark, sf):
    return search_history(_records(read(spark, sf, "documents"), False), " SRC1 ", columns=("title", "lang")).select("id")


@query("""WITH n AS (SELECT doc_id, source AS folder, replace(replace(CASE WHEN doc_id % 3 = 0 THEN 'a/b' ELSE lang || '?' END, '/', '-'), '?', '-') AS name FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY folder, name ORDER BY doc_id) AS r FROM n)
 SELECT doc_id, folder, name || CASE WHEN r = 1 THEN '' WHEN r <= 999 THEN ' ' || r ELSE ' ' || doc_id END || '.md' AS file_name FROM r""")
def unique_output_names(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", F.col("source").alias("folder"), F.when(F.col("doc_id") % 3 == 0, "a/b").otherwise(F.concat("lang", F.lit("?"))).alias("name"), F.lit("md").alias("ext"))
    return J.unique_names(d).select("doc_id", "folder", "file_name")


@query("SELECT doc_id, lang AS folder, CASE WHEN lang = 'en' THEN lang ELSE '/out/' || lang END AS dest FROM documents WHERE lang <> 'fr'")
def output_routing(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", F.col("lang").alias("folder"))
    mode = F.when(F.col("folder") == "en", "sameFolder").when(F.col("folder") == "fr", "historyOnly").otherwise("chosenFolder")
    folders = d.select("folder", mode.alias("mode"), F.concat(F.lit("/out/"), F.col("folder")).alias("chosen")).distinct()
    return J.route_outputs(d, folders)


@query("WITH o AS (SELECT lang AS k, count(*) AS n FROM documents GROUP BY 1), c AS (SELECT lang AS k, count(*) + CASE WHEN lang = 'en' THEN 1 ELSE 0 END AS n FROM documents GROUP BY 1) (SELECT * FROM o EXCEPT SELECT * FROM c) UNION ALL (SELECT * FROM c EXCEPT SELECT * FROM o)")
def derived_staleness(spark, sf):
    from foliowork.sources.sinks import is_stale

    stored = read(spark, sf, "documents").groupBy(F.col("lang").alias("k")).agg(F.count("*").alias("n"))
    return is_stale(stored, stored.withColumn("n", F.col("n") + F.when(F.col("k") == "en", 1).otherwise(0)))


@query("SELECT dataset, name FROM (SELECT lang AS dataset, source AS name, row_number() OVER (PARTITION BY lang ORDER BY source DESC) AS r FROM (SELECT DISTINCT lang, source FROM documents)) WHERE r = 1")
def latest_reports(spark, sf):
    return G.latest_report(read(spark, sf, "documents").select(F.col("lang").alias("dataset"), F.col("source").alias("name")).distinct())
