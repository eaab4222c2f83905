"""Streaming queries: each runs over files that arrive in two lots, with a restart between, and gives what the batch form gives.

A last row far in the future moves the watermark past all others, as later input would.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliowork.plans import q_runs
from foliowork.plans.q_pages import _inputs
from foliowork.plans.tables import book, read
from foliowork.sources.scratch import scratch_folder
from foliowork.sources.store import read_documents_store, read_history_store
from foliowork.streaming import streams as M
from foliowork.streaming.ordered import start_stateful

query, QUERIES, ORACLES = book()

LATER = "2099-01-01 00:00:00"


def in_two_runs(rows: DataFrame, time: str, last: dict, stream) -> DataFrame:
    """What `stream` gives for rows that arrive in two lots by time, the query being started anew for each.

    `last` has the values of the row that closes the input; its time is LATER.
    """
    spark, folder = rows.sparkSession, scratch_folder(rows.sparkSession, "stream")
    half = rows.agg(F.percentile_approx(F.unix_micros(time), 0.5, 1000)).first()[0] or 0
    early = F.unix_micros(time) < half
    closing = spark.range(1).select(*((F.lit(LATER).cast("timestamp") if c == time else F.lit(last.get(c))).cast(rows.schema[c].dataType).alias(c) for c in rows.columns))
    for lot in (rows.filter(early), rows.filter(~early).unionByName(closing)):
        lot.write.mode("append").parquet(f"{folder}/in")
        out = stream(spark.readStream.schema(rows.schema).parquet(f"{folder}/in"))
        writer = out.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
        start_stateful(writer, spark).awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out")


@query(q_runs.ORACLES["job_state"])
def streamed_job_states(spark, sf):
    rows = q_runs.progress_events(spark, sf).withColumn("ts", F.col("ts").cast("timestamp")).select("job_id", "ts", "seq", "stage")
    states = in_two_runs(rows, "ts", {"job_id": -1, "seq": -1, "stage": "queued"}, lambda s: M.job_state(s, forget=366 * 86400))
    last = states.groupBy("job_id").agg(F.max_by("stage", "ts").alias("stage"), F.max("ts").alias("ts"))
    return last.select("job_id", "stage", F.unix_micros("ts").alias("ts_us"))


@query(q_runs.ORACLES["stable_listings"])
def streamed_stable_listings(spark, sf):
    rows = q_runs.listings(spark, sf).withColumn("seen_at", F.col("seen_at").cast("timestamp"))
    out = in_two_runs(rows.select("folder", "name", "size", "modified", "seen_at"), "seen_at", {"folder": "", "name": "", "size": 0, "modified": 0.0}, lambda s: M.stable(s, forget=366 * 86400))
    return out.select("folder", "name", "size", F.unix_micros("seen_at").alias("us"))


_SCANS = """s AS (SELECT doc_id, '/in/' || coalesce(source, '') || '/d' || doc_id || CASE doc_id % 7 WHEN 0 THEN '.exe' WHEN 1 THEN '.tmp' ELSE '.html' END AS path, length(coalesce(text, '')) AS size, n AS scan, doc_id % 5 + CASE WHEN n = 3 AND doc_id % 3 = 0 THEN 1 ELSE 0 END AS modified
  FROM documents, (SELECT unnest([0, 1, 2, 3]) AS n) WHERE n > 0 OR doc_id % 2 = 0)"""


@query(f"WITH {_SCANS} SELECT path, size, modified::DOUBLE AS modified, min(scan) * 60 AS seconds FROM s WHERE doc_id % 7 > 1 GROUP BY path, size, modified")
def watched_files(spark, sf):
    """Four scans of a folder that holds a file for each document: half of them come late, a third change at last, all are seen again."""
    files = read(spark, sf, "documents").select("doc_id", "source", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("size"))  # texts are not carried on
    scans = files.withColumn("n", F.explode(F.array(*map(F.lit, range(4))))).filter("n > 0 or doc_id % 2 = 0")
    end = F.when(F.col("doc_id") % 7 == 0, ".exe").when(F.col("doc_id") % 7 == 1, ".tmp").otherwise(".html")
    path = F.concat(F.lit("/in/"), F.coalesce("source", F.lit("")), F.lit("/d"), F.col("doc_id"), end)
    changed = F.when((F.col("n") == 3) & (F.col("doc_id") % 3 == 0), 1).otherwise(0)
    rows = scans.select(path.alias("path"), "size", (F.col("doc_id") % 5 + changed).cast("double").alias("modified"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("n") * 60).alias("seen_at"))
    out = in_two_runs(rows, "seen_at", {"path": "/in/last.html", "size": 0, "modified": 0.0}, M.new_signatures)
    return out.select("path", "size", "modified", (F.unix_seconds("seen_at") - 1_700_000_000).alias("seconds"))


@query("""SELECT 'd' || doc_id AS doc_id, CASE WHEN doc_id % 3 = 0 THEN 'csv' ELSE 'txt' END AS ext, 1::BIGINT AS texts, 1::BIGINT AS records, 'md' AS file_ext FROM documents UNION ALL SELECT 'p' || page_id, 'html', 1, 1, 'md' FROM pages""")
def streamed_conversion(spark, sf):
    """Documents and pages that arrive in files, converted into a store: each has one text and one record."""
    folder = scratch_folder(spark, "arriving")
    docs = _inputs(spark, sf).withColumns({"name": F.concat_ws(".", "doc_id", "ext"), "mtime": F.lit("2024-01-01").cast("timestamp")})
    for lot in (docs.filter("ext = 'txt'"), docs.filter("ext <> 'txt'")):
        lot.write.mode("append").parquet(f"{folder}/in")
        M.convert_stream(spark.readStream.schema(docs.schema).parquet(f"{folder}/in"), f"{folder}/store", f"{folder}/checkpoint").awaitTermination()
    texts = read_documents_store(spark, f"{folder}/store").groupBy("doc_id").agg(F.count("text").alias("texts"), F.max("file_ext").alias("file_ext"))
    records = read_history_store(spark, f"{folder}/store").groupBy(F.col("id").alias("doc_id")).agg(F.count("*").alias("records"), F.max("ext").alias("ext"))
    return texts.join(records, "doc_id", "full").select("doc_id", "ext", "texts", "records", "file_ext")
