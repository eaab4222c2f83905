"""What a user runs: conversion, triage, evaluation and repair as single plans."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliowork.functions.text import cer, completeness, norm_lev, token_f1, wc_meaningful, wer
from foliowork.operators.evidence import detect_language, document_type, page_evidence, sample_pages
from foliowork.operators.evaluate import fidelity_summary, leaderboard, mean_similarity, ocr_summary, qa_hits, qa_total, sampled, todo
from foliowork.operators.quality import quality_score
from foliowork.operators.rules import advise, classify_content, engine, hints, recommend
from foliowork.operators.structure import MEASURES, insert_tables, judge_content, line_table, measured, merge_lines, missing_tables, reflow, repair_headings, retention, structure, table_blocks, title
from foliowork.operators.tables import csv_markdown, sequence_ratio, table_similarity
from foliowork.operators.walker import pages_to_markdown
from foliowork.sources.sinks import append_results, render


def extract(src: DataFrame) -> DataFrame:
    """The documents (doc_id, ext, text and others) with `raw`, what their kind of file says, as Markdown.

    Pages go through the walker, comma-separated files become tables where they lie; other texts are their own Markdown. Each kind is a
    branch of one plan; ids are unique. A file without a single cell, and a null text, is an empty Markdown.
    """
    ext = F.lower("ext")
    kept = tuple(c for c in src.columns if c != "doc_id")
    pages = pages_to_markdown(src.filter(ext.isin("html", "htm")), "doc_id", "text", keep=kept).withColumnRenamed("markdown", "raw")
    tables = src.filter(ext == "csv").withColumn("raw", csv_markdown("text"))
    texts = src.filter(ext.isNull() | ~ext.isin("html", "htm", "csv")).withColumn("raw", F.coalesce("text", F.lit("")))
    return pages.unionByName(tables).unionByName(texts)


def finish(raw: DataFrame) -> DataFrame:
    """Extracted documents with `markdown`, the refined text, and what is known of it: title, language, type, score and validity.

    Texts have broken lines merged and paragraphs put together; pages and tables have their lines already. `retention` is the
    share of structure kept, `retention_ratio`, `warnings` and `passed` say whether words, tables or lists were lost.
    """
    laid_out = F.coalesce(F.lower("ext").isin("html", "htm", "csv"), F.lit(False))
    markdown = F.when(laid_out, F.col("raw")).otherwise(reflow(merge_lines("raw"))["markdown"])
    refined = raw.select("*", F.explode(F.array(markdown)).alias("markdown"))  # a generator: made once, not again in every measure of it
    counted = measured(refined, "raw", "markdown", same=laid_out)
    checked = judge_content(counted.withColumn("retention", retention(F.col("_structure_in"), F.col("_structure_out"))), "raw", "markdown")
    scored = quality_score(checked.withColumn("pages", F.lit(1)), words="_words_out").drop(*MEASURES).withColumnRenamed("language", "language_confidence")
    return scored.withColumns({"title": title("markdown"), "language": detect_language("markdown")["lang"], "type": document_type("markdown"), "route": classify_content("ext")})


def convert(src: DataFrame, mode: str = "markdown") -> DataFrame:
    """Documents (doc_id, ext, text) as rendered Markdown with route, title, language, type, quality and validity, in one plan.

    The blocks of pages are shuffled by page; tables and texts stay in their rows.
    """
    done = finish(extract(src))
    meta = {"source_name": F.col("doc_id").cast("string"), "pipeline": F.col("route.capability"), "created_at": F.lit("1970-01-01").cast("timestamp")}
    own = ("retention", "retention_ratio", "warnings", "passed")
    return render(done.withColumns(meta), mode).select("doc_id", "route.kind", "route.pathway", "title", "language", "type", "overall", "reasons", *own, "text", "file_ext")


def triage(pages: DataFrame) -> DataFrame:
    """Pages (doc_id, page, text) to a route, advice and hints for each document; one aggregate, over sampled pages only."""
    e = page_evidence(sample_pages(pages))
    seen = e.withColumns(
        {
            "vision": F.lit(True), "seen_lines": F.col("avg_lines"), "seen_confidence": F.lit(1.0), "pages_with_text": F.col("sampled_pages"), "columns": F.lit(1), "dense_pages": F.lit(0), "rotated": F.lit(0),
            "oversized": F.lit(0), "rectangles": F.lit(0), "skew": F.lit(0.0), "mixed": F.lit(False), "language": F.lit("en"),
        }
    )
    evidence = F.struct(*seen.columns)
    routed = seen.withColumns({"r": recommend(evidence), "engine": engine(evidence), "hints": hints(evidence)})
    return routed.select("doc_id", "r.pathway", "r.bucket", "r.confidence", "engine", "hints", advise(F.col("r.bucket"), F.col("r.confidence"), F.col("language"))["advice"].alias("advice"))


class Evaluation(NamedTuple):
    """What an evaluation run gives: `rows` for the result log and, beside each other, its summaries of one row or one for each engine."""

    rows: DataFrame
    similarity: DataFrame
    fidelity: DataFrame
    answers: DataFrame
    recognition: DataFrame
    tables: DataFrame


def compare(truth: DataFrame, outputs: DataFrame, results: DataFrame, engine_name: str, sample: int) -> DataFrame:
    """The open keys of a stable sample with reference, text, status and all measures of the pair.

    `truth` and `outputs` have key and text (outputs: markdown); finished keys are left out before anything is compared.
    """
    chosen = sampled(truth.select("key"), sample)
    open_keys = todo(chosen, results, outputs, engine_name)
    pairs = truth.join(open_keys, "key", "left_semi").select("key", F.col("text").alias("reference")).join(outputs.select("key", F.col("markdown").alias("text")), "key", "left")
    return sequence_ratio(pairs).withColumns(
        {
            "engine": F.lit(engine_name), "status": F.when(F.col("text").isNull(), "missing").otherwise("ok"), "error": F.lit(None).cast("string"),
            "gt_words": wc_meaningful("reference"), "md_words": wc_meaningful("text"), "cer": cer("reference", "text", cap=True), "wer": wer("reference", "text", cap=True),
            "completeness": completeness("reference", "text"), "f1": token_f1("reference", "text"), "ned": norm_lev("reference", "text"),
        }
    )


def evaluate(
    truth: DataFrame, outputs: DataFrame, results: DataFrame, engine_name: str, sample: int, questions: DataFrame | None = None, confidences: DataFrame | None = None, tables: DataFrame | None = None, log: str | None = None
) -> Evaluation:
    """Run an engine's evaluation over a stable sample: measures of every pair, and the summaries over them.

    `questions` (key, question, answer) are answered from the outputs; `confidences` (key, confidence) are those of recognition;
    `tables` (key, truth, other) are pairs of tables. Only keys of this run count. Rows are added to the result log at `log`.
    """
    rows = compare(truth, outputs, results, engine_name, sample)
    if log is not None:
        stored = rows.select("key", "engine", "status", "gt_words", "md_words", "sim", "error")
        append_results(stored, log)
    own = rows.select("key", "text")
    spark = truth.sparkSession
    asked = questions if questions is not None else spark.createDataFrame([], "key long, question string, answer string")
    hits = qa_hits(asked.join(own.select("key"), "key", "left_semi").withColumnRenamed("key", "doc_id"), own.withColumnRenamed("key", "doc_id"))
    sure = confidences if confidences is not None else own.select("key", F.lit(None).cast("double").alias("confidence"))
    pairs = tables if tables is not None else own.select("key").withColumns({c: F.lit(None).cast("array<array<struct<value:string,colspan:int,rowspan:int>>>") for c in ("truth", "other")}).limit(0)
    nodes = lambda c: F.aggregate(F.col(c), F.lit(1), lambda acc, r: acc + 1 + F.size(r))
    scored = table_similarity(pairs.join(own.select("key"), "key", "left_semi"))
    board = scored.withColumns({"engine": F.lit(engine_name), "truth_nodes": nodes("truth"), "nodes": nodes("other"), "missing": F.col("other").isNull()})
    return Evaluation(rows, mean_similarity(rows), fidelity_summary(rows), qa_total(hits), ocr_summary(own.join(sure, "key", "left")), leaderboard(board))


def repair(docs: DataFrame) -> DataFrame:
    """(doc_id, markdown, before, after): converted texts with the original's heading levels and missing tables.

    `docs` has doc_id, original and converted; before and after are the shares of structure kept.
    """
    fixed = docs.withColumn("fixed", repair_headings("converted", "original"))
    original = table_blocks(line_table(docs, "original"))
    lost = missing_tables(original, table_blocks(line_table(fixed, "fixed")))
    tables = original.join(lost.select("doc_id", "block_no"), ["doc_id", "block_no"], "left_semi")
    repaired = insert_tables(fixed.select("doc_id", F.col("fixed").alias("text")), tables)
    kept = docs.select("doc_id", structure("original").alias("o"), structure("converted").alias("c")).join(repaired, "doc_id")
    return kept.select("doc_id", "markdown", retention(F.col("o"), F.col("c")).alias("before"), retention(F.col("o"), structure("markdown")).alias("after"))
