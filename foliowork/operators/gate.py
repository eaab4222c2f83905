"""Regression gates: results against baselines, coverage, floors, ledgers and manifests, each as a table of findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the policy, in percent and as a factor, and the score below which output counts as degraded.
POLICY = {"document": 5.0, "large": 25.0, "uplift": 3.0, "speed": 1.5}
DEGRADED = 70.0


def compare(results: DataFrame, baseline: DataFrame, policy: dict[str, float] | None = None) -> DataFrame:
    """(pathway, doc_id, finding, delta) of results (pathway, doc_id, status, overall_percent, elapsed_seconds).

    Findings: missing baseline, status change, large regression, regression, uplift, speed regression. Rows that are
    blocked on both sides are not scored; pathways without any baseline give none.
    """
    p = POLICY | (policy or {})
    known = baseline.select("pathway").distinct().withColumnRenamed("pathway", "_p")
    b = baseline.select("pathway", "doc_id", F.col("status").alias("b_status"), F.col("overall_percent").alias("b_score"), F.col("elapsed_seconds").alias("b_seconds"), F.lit(True).alias("_there"))
    joined = results.join(known, F.col("pathway") == F.col("_p"), "left_semi").join(b, ["pathway", "doc_id"], "left")
    delta = F.coalesce("overall_percent", F.lit(0.0)) - F.coalesce("b_score", F.lit(0.0))
    missing, changed = F.col("_there").isNull(), F.col("status") != F.coalesce("b_status", F.lit("scored"))
    scored = ~missing & ~changed & ~F.col("status").isin("expected_blocked", "environment_blocked")
    by_score = F.when(delta <= -p["large"], "large regression").when(delta <= -p["document"], "regression").when(delta >= p["uplift"], "uplift")
    slow = scored & (F.col("b_seconds") > 0) & (F.col("elapsed_seconds") > F.col("b_seconds") * p["speed"])
    found = F.array_compact(F.array(F.when(missing, "missing baseline"), F.when(~missing & changed, "status change"), F.when(scored, by_score), F.when(slow, "speed regression")))
    return joined.select("pathway", "doc_id", F.explode(found).alias("finding"), F.when(~missing, delta).alias("delta"))


def uncovered(docs: DataFrame, registry: DataFrame, exempt: list[str] | None = None) -> DataFrame:
    """Documents (doc_id, format) whose format no shipping pathway takes and that is not exempt.

    `registry` has pathway, release_status and valid_formats (array).
    """
    taken = registry.filter(F.col("release_status") == "shipping").select(F.explode("valid_formats").alias("format")).distinct()
    out = docs.join(taken, "format", "left_anti")
    return out.filter(~F.col("format").isin(*exempt)) if exempt else out


def stale_exemptions(exempt: DataFrame, docs: DataFrame) -> DataFrame:
    """Exempt formats that the corpus does not have."""
    return exempt.select("format").subtract(docs.select("format"))


def check_floors(summary: DataFrame, floors: DataFrame) -> DataFrame:
    """(category, finding, actual, minimum): categories without a result or below their floor."""
    joined = floors.join(summary.select("category", F.col("score").alias("actual")), "category", "left")
    finding = F.when(F.col("actual").isNull(), "missing category").when(F.col("actual") < F.col("minimum"), "below floor")
    return joined.withColumn("finding", finding).filter("finding is not null").select("category", "finding", "actual", "minimum")


def reconcile(manifest: DataFrame, ledger: DataFrame, keys: tuple[str, ...] = ("category", "format")) -> DataFrame:
    """(id, finding): ids on one side only, and key columns that differ."""
    m = manifest.select("id", *(F.col(k).alias(f"m_{k}") for k in keys), F.lit(True).alias("_m"))
    g = ledger.select("id", *(F.col(k).alias(f"l_{k}") for k in keys), F.lit(True).alias("_l"))
    both = m.join(g, "id", "full_outer")
    here, there = F.col("_m").isNotNull(), F.col("_l").isNotNull()
    changed = [F.when(here & there & ~F.col(f"m_{k}").eqNullSafe(F.col(f"l_{k}")), f"{k} changed") for k in keys]
    return both.select("id", F.explode(F.array_compact(F.array(F.when(~here, "unknown id"), F.when(~there, "missing id"), *changed))).alias("finding"))


def check_manifest(docs: DataFrame, files: DataFrame) -> DataFrame:
    """(id, finding): ids that are null or occur twice, and paths that the listing lacks. `docs` has id and path."""
    doubled = docs.groupBy("id").count().filter("id is null or count > 1").select("id", F.when(F.col("id").isNull(), "null id").otherwise("duplicate id").alias("finding"))
    absent = docs.join(files.select("path"), "path", "left_anti").select("id", F.lit("missing file").alias("finding"))
    return doubled.unionByName(absent)


def missing_keys(required: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """Keys that are required and not present."""
    return required.select(key).distinct().join(present.select(key), key, "left_anti")


def verify_assets(expected: DataFrame, files: DataFrame) -> DataFrame:
    """(path, finding): assets (path, sha256) that are absent, changed or not expected among files (path, content)."""
    actual = files.select("path", F.sha2("content", 256).alias("actual"))
    both = expected.join(actual, "path", "full_outer")
    finding = F.when(F.col("actual").isNull(), "absent").when(F.col("sha256").isNull(), "not expected").when(F.lower("sha256") != F.col("actual"), "changed")
    return both.withColumn("finding", finding).filter("finding is not null").select("path", "finding")


def corpus_summary(results: DataFrame) -> DataFrame:
    """(pathway, category, documents, score, seconds, failed, level): per category, per pathway and overall."""
    return results.rollup("pathway", "category").agg(
        F.count("*").alias("documents"), F.avg("overall_percent").alias("score"), F.avg("elapsed_seconds").alias("seconds"), F.count_if(F.col("status") == "failed").alias("failed"), F.grouping_id().alias("level")
    )


def score_matrix(results: DataFrame, pathways: list[str]) -> DataFrame:
    """One row for each document, one column for each pathway's score."""
    return results.groupBy("doc_id").pivot("pathway", pathways).agg(F.first("overall_percent"))


def compare_pipelines(results: DataFrame, a: str, b: str, band: float = 1.0) -> DataFrame:
    """(category, a, b, delta, winner): mean scores of two pathways; within the band it is a tie."""
    means = results.groupBy("category").pivot("pathway", [a, b]).agg(F.avg("overall_percent"))
    delta = F.col(b) - F.col(a)
    winner = F.when(F.abs(delta) <= band, "tie").when(delta > 0, b).otherwise(a)
    return means.select("category", F.col(a).alias("a"), F.col(b).alias("b"), delta.alias("delta"), winner.alias("winner"))


def compare_runs(runs: DataFrame, a: str = "serial", b: str = "parallel") -> DataFrame:
    """(pathway, speedup, score_delta, failed_delta) of two modes of (pathway, mode, documents, wall_seconds, score, failed)."""
    own = [runs.filter(F.col("mode") == m).select("pathway", *(F.col(c).alias(f"{n}_{c}") for c in ("documents", "wall_seconds", "score", "failed"))) for n, m in (("a", a), ("b", b))]
    speed = (F.col("b_documents") / F.col("b_wall_seconds")) / (F.col("a_documents") / F.col("a_wall_seconds"))
    return own[0].join(own[1], "pathway").select("pathway", speed.alias("speedup"), (F.col("b_score") - F.col("a_score")).alias("score_delta"), (F.col("b_failed") - F.col("a_failed")).alias("failed_delta"))


def format_counts(docs: DataFrame, stored: DataFrame) -> DataFrame:
    """(format, actual, expected) where the corpus and a stored distribution (format, n) differ."""
    actual = docs.groupBy("format").agg(F.count("*").alias("actual"))
    both = actual.join(stored.select("format", F.col("n").alias("expected")), "format", "full_outer")
    return both.filter(~F.col("actual").eqNullSafe(F.col("expected")))


def expected_status(docs: DataFrame, baseline: DataFrame) -> DataFrame:
    """(doc_id, expected_status, status_source, best_percent) from the baselines of all pathways.

    A password anywhere comes first; without a scored pathway a document is unsupported; below 70 it is degraded. Of
    equal scores the pathway that is first by name counts.
    """
    password = (F.col("status") == "expected_blocked") & (F.col("blocked_reason") == "password_required")
    score = F.when(F.col("status") == "scored", F.struct(F.coalesce("overall_percent", F.lit(0.0)).alias("score"), "pathway"))
    best = baseline.groupBy("doc_id").agg(F.bool_or(password).alias("password"), F.max(score["score"]).alias("best"), F.min_by(score["pathway"], F.when(score.isNotNull(), F.struct(-score["score"], score["pathway"]))).alias("pathway"))
    own = docs.select("doc_id").join(best, "doc_id", "left")
    locked, none = F.coalesce("password", F.lit(False)), F.col("best").isNull()
    status = F.when(locked, "password_required").when(none, "unsupported").when(F.col("best") < DEGRADED, "degraded_output").otherwise("success")
    source = F.when(locked, "password_required").when(none, "no_scored_pathway").otherwise(F.col("pathway"))
    return own.select("doc_id", status.alias("expected_status"), source.alias("status_source"), F.when(~locked, F.col("best")).alias("best_percent"))


def latest_report(reports: DataFrame) -> DataFrame:
    """Of each dataset the report with the greatest name."""
    rank = F.row_number().over(Window.partitionBy("dataset").orderBy(F.desc("name")))
    return reports.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def bootstrap_thresholds(reports: DataFrame) -> DataFrame:
    """(dataset, overall_min, cer_max, recall_min) from each dataset's latest report, with fixed bounds."""
    latest = latest_report(reports)
    return latest.select(
        "dataset", F.greatest(F.lit(75), F.floor(F.col("overall_percent") * 0.85)).alias("overall_min"), F.least(F.lit(0.10), F.col("avg_cer") * 1.5).alias("cer_max"),
        F.greatest(F.lit(60), F.floor(F.col("heading_recall") * 0.9)).alias("recall_min"),
    )


def latency(results: DataFrame) -> DataFrame:
    """(pathway, documents, median, maximum, mean, docs_per_second)"""
    s = F.col("elapsed_seconds")
    return results.groupBy("pathway").agg(F.count("*").alias("documents"), F.median(s).alias("median"), F.max(s).alias("maximum"), F.avg(s).alias("mean"), (F.count("*") / F.sum(s)).alias("docs_per_second"))


def run_delta(results: DataFrame) -> DataFrame:
    """(doc_id, pathway, run, delta): the change of the score against the run before."""
    before = F.lag("overall_percent").over(Window.partitionBy("doc_id", "pathway").orderBy("run"))
    return results.withColumn("delta", F.col("overall_percent") - before).filter("delta is not null").select("doc_id", "pathway", "run", "delta")


def gate(results: DataFrame, baseline: DataFrame, floors: DataFrame, docs: DataFrame, registry: DataFrame) -> DataFrame:
    """(check, subject, finding) of all gates; an empty table is a pass. Uplifts are no findings."""
    regressions = compare(results, baseline).filter("finding <> 'uplift'").select(F.lit("regression").alias("check"), F.concat_ws("/", "pathway", F.col("doc_id").cast("string")).alias("subject"), "finding")
    summary = results.groupBy("category").agg(F.avg("overall_percent").alias("score"))
    low = check_floors(summary, floors).select(F.lit("floor").alias("check"), F.col("category").alias("subject"), "finding")
    open_formats = uncovered(docs, registry).select(F.lit("coverage").alias("check"), F.col("doc_id").cast("string").alias("subject"), F.lit("no shipping pathway").alias("finding"))
    return regressions.unionByName(low).unionByName(open_formats)


def _one(c: Column) -> Column:
    return F.coalesce(c, F.lit(1.0))


def overall_progress(jobs: DataFrame) -> DataFrame:
    """One row: the mean progress of running jobs; 1 if all are done, 0 if there are none."""
    running = ~F.col("stage").isin("complete", "failed", "cancelled")
    return jobs.agg(F.when(F.count("*") == 0, 0.0).otherwise(_one(F.avg(F.when(running, F.col("progress"))))).alias("progress"))
