"""Evaluation of outputs against ground truth, and the summaries of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliowork.functions import text as X


def pair(predictions: DataFrame, truth: DataFrame, on: str = "id") -> DataFrame:
    """Every ground-truth row with its prediction, if there is one: id, truth, prediction, missing.

    Both frames have the id and `text`.
    """
    p = predictions.select(on, F.col("text").alias("prediction"), F.lit(True).alias("_there"))
    return truth.select(on, F.col("text").alias("truth")).join(p, on, "left").withColumn("missing", F.col("_there").isNull()).drop("_there")


def pair_score(score: Column) -> Column:
    """The score of a pair; without a ground truth 1 if the prediction is missing too, else 0; without a prediction 0."""
    return F.when(F.col("truth").isNull(), F.when(F.col("missing"), 1.0).otherwise(0.0)).when(F.col("missing"), 0.0).otherwise(score)


def engine_grid(truth: DataFrame, outputs: DataFrame) -> DataFrame:
    """(id, engine, text, missing) for every ground truth and every engine of `outputs` (id, engine, text).

    The set of engines is found in the data; it is a small table and put beside every id as an array.
    """
    engines = outputs.agg(F.array_sort(F.collect_set("engine")).alias("engines"))
    grid = truth.select("id").withColumn("_one", F.lit(1)).join(F.broadcast(engines.withColumn("_one", F.lit(1))), "_one").select("id", F.explode("engines").alias("engine"))
    return grid.join(outputs.select("id", "engine", "text"), ["id", "engine"], "left").withColumn("missing", F.col("text").isNull())


def todo(selected: DataFrame, results: DataFrame, outputs: DataFrame, engine: str) -> DataFrame:
    """Selected keys without a final result of the engine: ok rows without a word are done again, low content is final."""
    own = results.filter(F.col("engine") == engine).join(outputs.select("key", "markdown"), "key", "left")
    empty = (F.col("status") == "ok") & F.col("markdown").isNotNull() & (X.wc_meaningful("markdown") == 0)
    final = own.filter((F.col("status") == "low_content") | ((F.col("status") == "ok") & ~empty))
    return selected.join(final.select("key").distinct(), "key", "left_anti")


def side_by_side(truth: DataFrame, outputs: DataFrame, key, engines: list[str]) -> DataFrame:
    """The ground truth of one key next to the output of every engine."""
    own = outputs.filter(F.col("id") == key).groupBy("id").pivot("engine", engines).agg(F.first("text"))
    return truth.filter(F.col("id") == key).select("id", F.col("text").alias("truth")).join(own, "id", "left")


def fidelity_summary(scored: DataFrame) -> DataFrame:
    """One row from (cer, wer, completeness, error): counts, mean, least and greatest rates, and the overall score."""
    good = F.col("error").isNull()

    def over(f, c: str) -> Column:
        return f(F.when(good, F.col(c)))

    return scored.agg(
        F.count("*").alias("total"), F.count_if(good).alias("successful"), F.count_if(~good).alias("failed"), over(F.avg, "cer").alias("avg_cer"), over(F.min, "cer").alias("min_cer"), over(F.max, "cer").alias("max_cer"),
        over(F.avg, "wer").alias("avg_wer"), over(F.avg, "completeness").alias("avg_completeness"), ((1 - over(F.avg, "cer")) * 100).alias("overall_percent"),
    )


def qa_hits(questions: DataFrame, texts: DataFrame) -> DataFrame:
    """The questions (doc_id, question, answer) with hit and f1 against their document's text."""
    joined = questions.join(texts.select("doc_id", "text"), "doc_id", "left")
    known = X.norm_answer("answer") != ""
    hit = known & F.contains(X.norm_answer("text"), X.norm_answer("answer"))
    return joined.withColumns({"answered": known, "hit": hit, "f1": F.when(known, X.token_f1("answer", "text"))}).drop("text")


def qa_summary(pairs: DataFrame) -> DataFrame:
    """(doc_id, qa_count, hit_rate, exact_rate, avg_f1): rates over all pairs of a document; hit and exact test the same."""
    n, hits = F.count("*"), F.count_if("hit")
    return pairs.groupBy("doc_id").agg(n.alias("qa_count"), (hits / n).alias("hit_rate"), (hits / n).alias("exact_rate"), F.coalesce(F.avg("f1"), F.lit(0.0)).alias("avg_f1"))


def qa_total(pairs: DataFrame) -> DataFrame:
    """One row: questions with an answer, hits, the hit rate over them, and the mean F1."""
    asked = F.count_if("answered")
    rate = F.when(asked > 0, F.count_if("hit") / asked).otherwise(0.0)
    return pairs.agg(asked.alias("questions"), F.count_if("hit").alias("answered"), rate.alias("hit_rate"), F.coalesce(F.avg("f1"), F.lit(0.0)).alias("avg_f1"))


def ocr_summary(df: DataFrame) -> DataFrame:
    """One row from (text, confidence): confidence mean, least and greatest, artifacts, coverage by 50 words."""
    coverage = F.least(F.lit(1.0), X.wc_any("text") / 50.0)
    artifacts = X.ocr_artifacts("text")
    return df.agg(
        F.count("*").alias("total"), F.avg("confidence").alias("avg_confidence"), F.min("confidence").alias("min_confidence"), F.max("confidence").alias("max_confidence"),
        F.sum(artifacts).alias("artifacts"), F.avg(artifacts).alias("avg_artifacts"), F.avg(coverage).alias("avg_coverage"),
    )


def leaderboard(pairs: DataFrame, most_nodes: int = 4000) -> DataFrame:
    """(engine, n, structural, total, missing, skipped): means in percent, the best first; large pairs are skipped."""
    large = F.greatest(F.coalesce("truth_nodes", F.lit(0)), F.coalesce("nodes", F.lit(0))) > most_nodes
    counted = F.when(~large, F.struct("structural", "total"))
    return (
        pairs.groupBy("engine")
        .agg(F.count(counted).alias("n"), (F.avg(counted["structural"]) * 100).alias("structural"), (F.avg(counted["total"]) * 100).alias("total"), F.count_if("missing").alias("missing"), F.count_if(large).alias("skipped"))
        .orderBy(F.desc("total"), "engine")
    )


def mean_similarity(results: DataFrame) -> DataFrame:
    return results.groupBy("engine").agg(F.count("*").alias("n"), F.avg("sim").alias("mean"))


def quality_bands(scored: DataFrame) -> DataFrame:
    """(band, n) by character error rate: below .01 excellent, .05 good, .10 fair, else poor."""
    c = F.col("cer")
    return scored.groupBy(F.when(c < 0.01, "excellent").when(c < 0.05, "good").when(c < 0.10, "fair").otherwise("poor").alias("band")).agg(F.count("*").alias("n"))


def extremes(scored: DataFrame, by: str = "cer", key: str = "id") -> DataFrame:
    """One row: the documents with the least and the greatest error; the smaller id on a tie."""
    return scored.agg(
        F.min(F.struct(by, key))[key].alias("best"), F.min(by).alias("best_rate"), F.max(F.struct(F.col(by), (-F.col(key)).alias("k")))["k"].alias("_worst"), F.max(by).alias("worst_rate")
    ).select("best", "best_rate", (-F.col("_worst")).alias("worst"), "worst_rate")


def corpus_score(df: DataFrame) -> DataFrame:
    """The frame with overall_percent: headings 30, tables 25, completeness 30, validity 10, no artifacts 5.

    It has truth, text, and the struct columns truth_structure and text_structure.
    """
    t, o = F.col("truth_structure"), F.col("text_structure")

    def recall(kind: str) -> Column:
        return F.when(t[kind] == 0, 1.0).otherwise(F.least(F.lit(1.0), o[kind] / t[kind]))

    tables = F.when(t["tables"] == o["tables"], 1.0).otherwise(F.least(t["tables"], o["tables"]) / F.greatest(t["tables"], o["tables"], F.lit(1)))
    ratio = X.wc_any("text") / F.greatest(X.wc_any("truth"), F.lit(1))
    complete = F.when(ratio.between(0.8, 1.2), 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.abs(1 - ratio)))
    valid = F.when(X.trim_all(X.col("text")) != "", 1.0).otherwise(0.0)
    clean = F.when(X.artifact_count("text") == 0, 1.0).otherwise(0.0)
    return df.withColumn("overall_percent", recall("headings") * 30 + tables * 25 + complete * 30 + valid * 10 + clean * 5)


def stable_sample(df: DataFrame, n: int, seed: int = 7, key: str = "key") -> DataFrame:
    """The same n rows for every caller, whatever the order and partitioning: the least seeded hashes, sorted by key."""
    return sampled(df, n, seed, key).orderBy(key)


def sampled(df: DataFrame, n: int, seed: int = 7, key: str = "key") -> DataFrame:
    """The rows of a stable sample, in no order.

    Rows are counted by the first four digits of their hash; those below the digits at which n is reached are in, and only the
    rows with just these digits, one in 65,536, are put in order. Keys are unique; a null key counts as its own hash.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    ranked = df.withColumns({"_rank": digest, "_head": F.substring(digest, 1, 4)})
    below, edge = 0, None
    for head, rows in sorted(tuple(r) for r in ranked.groupBy("_head").count().collect()):  # 65,536 rows at most
        if below + rows > n:
            edge = head
            break
        below += rows
    if edge is None:
        return df
    rim = ranked.filter(F.col("_head") == edge).orderBy("_rank", key).limit(n - below)
    return ranked.filter(F.col("_head") < edge).unionByName(rim).drop("_rank", "_head")


def check_sample(sample: DataFrame, n: int, available: DataFrame, key: str = "key") -> DataFrame:
    """One row: whether a stored sample has its size, no key twice, and no key that the corpus lacks."""
    known = available.select(key).distinct().withColumn("_known", F.lit(1))
    joined = sample.select(key).join(known, key, "left")
    return joined.agg((F.count("*") == n).alias("size_ok"), (F.count_distinct(key) == F.count("*")).alias("unique_ok"), F.count_if(F.col("_known").isNull()).alias("missing"))


def sample_dataset(df: DataFrame, n: int, seed: int = 7, dataset: str = "dataset", key: str = "key") -> DataFrame:
    """At most n rows of each dataset by seeded hash, ranked inside the dataset."""
    rank = F.row_number().over(Window.partitionBy(dataset).orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")
