"""A store of converted documents and their history, written batch by batch, each batch whole or not at all.

A batch's documents, its history records and then its commit are written below the batch's number. Readers take committed
batches only. Writing a number again replaces what is there, so a stream that repeats a batch after a failure leaves no
trace of the first attempt. Of a document that was converted in several batches the newest record counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliowork.functions.text import wc_alnum
from foliowork.sources.sinks import render

DOCUMENTS = "doc_id string, text string, file_ext string, batch long"
HISTORY = "id string, created_at timestamp, source_name string, ext string, title string, pathway string, pipeline string, word_count long, overall double, passed boolean, batch long"
COMMITS = "rows long, batch long"


def write_batch(docs: DataFrame, number: int, store: str, mode: str = "markdown") -> None:
    """Convert documents (doc_id, ext, text, name, mtime) as batch `number` of a store; done again, it gives the same."""
    from foliowork.plans.jobs import extract, finish

    spark = docs.sparkSession
    raw, folder = f"{store}/raw/batch={number}", f"batch={number}"
    extract(docs).write.mode("overwrite").parquet(raw)  # the batch is read once
    done = finish(spark.read.parquet(raw)).withColumns({"source_name": F.col("name"), "created_at": F.col("mtime"), "pipeline": F.col("route.capability")})
    rendered = render(done, mode).select("doc_id", "text", "file_ext")
    rendered.write.mode("overwrite").parquet(f"{store}/documents/{folder}")
    history = done.select(
        F.col("doc_id").alias("id"), "created_at", "source_name", "ext", "title", F.col("route.pathway").alias("pathway"), "pipeline", wc_alnum("markdown").alias("word_count"), "overall", "passed"
    )
    history.write.mode("overwrite").parquet(f"{store}/history/{folder}")
    count = spark.read.parquet(f"{store}/history/{folder}").agg(F.count("*").alias("rows"))
    count.write.mode("overwrite").parquet(f"{store}/commits/{folder}")
    where = spark._jvm.org.apache.hadoop.fs.Path(raw)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _committed(spark: SparkSession, store: str, table: str, schema: str) -> DataFrame:
    commits = spark.read.schema(COMMITS).parquet(f"{store}/commits").select("batch")
    return spark.read.schema(schema).parquet(f"{store}/{table}").join(commits, "batch", "left_semi")


def read_history_store(spark: SparkSession, store: str) -> DataFrame:
    """The newest record of each document in committed batches."""
    rows = _committed(spark, store, "history", HISTORY)
    columns = [c for c in rows.columns if c != "id"]
    newest = rows.groupBy("id").agg(F.max_by(F.struct(*columns), F.struct("created_at", "batch")).alias("r"))
    return newest.select("id", *(F.col(f"r.{c}").alias(c) for c in columns))


def read_documents_store(spark: SparkSession, store: str) -> DataFrame:
    """(doc_id, text, file_ext) as the newest record of each document has it."""
    newest = read_history_store(spark, store).select(F.col("id").alias("doc_id"), "batch")
    return _committed(spark, store, "documents", DOCUMENTS).join(newest, ["doc_id", "batch"]).select("doc_id", "text", "file_ext")
