"""Job histories and event tables: states, stalls, quotas, durations, requests, folders and stored records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliowork.sources.scratch import scratch_folder

FINISHED = ("complete", "failed", "cancelled")


def job_state(progress: DataFrame) -> DataFrame:
    """(job_id, stage, ts): the stage each job is in. The first finished stage holds, though a later cancel replaces it."""
    order = Window.partitionBy("job_id").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, -1)
    done = F.max(F.col("stage").isin(*FINISHED)).over(order)
    counted = progress.withColumn("_done", F.coalesce(done, F.lit(False))).filter(~F.col("_done") | (F.col("stage") == "cancelled"))
    return counted.groupBy("job_id").agg(F.max_by(F.struct("stage", "ts"), F.struct("ts", "seq")).alias("s")).select("job_id", "s.stage", "s.ts")


def stalled(progress: DataFrame, seconds: int = 60) -> DataFrame:
    """(job_id, ts, gap): running reports after which nothing came for `seconds` or more, or before the table's end."""
    order = Window.partitionBy("job_id").orderBy("ts", "seq")
    end = progress.agg(F.max("ts").alias("end"))
    rows = progress.withColumn("next", F.lead("ts").over(order)).join(F.broadcast(end.withColumn("_one", F.lit(1))), F.lit(1) == F.col("_one"))
    gap = F.unix_micros(F.coalesce("next", "end").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))
    return rows.filter(~F.col("stage").isin(*FINISHED)).withColumn("gap", gap / 1e6).filter(F.col("gap") >= seconds).select("job_id", "ts", "gap")


def quota(events: DataFrame, user: str, ts: str, limit: int = 5, order: str = "event_id") -> DataFrame:
    """The events with `allowed`: true for the first `limit` of each user."""
    n = F.row_number().over(Window.partitionBy(user).orderBy(ts, order))
    return events.withColumn("allowed", n <= limit)


def stage_durations(marks: DataFrame) -> DataFrame:
    """(job_id, stage, seconds) from the first to the last mark of a stage."""
    span = F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))
    return marks.groupBy("job_id", "stage").agg((span / 1e6).alias("seconds"))


def last_failure(jobs: DataFrame) -> DataFrame:
    """One row: the latest failed job with its context."""
    failed = F.col("stage") == "failed"
    return jobs.filter(failed).agg(F.max_by(F.struct("job_id", "error_code", "ts"), F.struct("ts", "seq")).alias("f")).select("f.*")


def match_handoffs(requests: DataFrame, responses: DataFrame, seconds: int = 600) -> DataFrame:
    """(id, status): the first response within the limit after the request, or a timeout. A request counts once."""
    asked = requests.groupBy("id").agg(F.min("ts").alias("ts"))
    answers = responses.select("id", F.col("ts").alias("at"), F.col("status").alias("answer"))
    late = (F.col("at") >= F.col("ts")) & (F.col("at") <= F.col("ts") + F.expr(f"INTERVAL {seconds} SECONDS"))
    joined = asked.join(answers, "id", "left").withColumn("good", F.when(late, F.struct("at", "answer")))
    return joined.groupBy("id").agg(F.coalesce(F.min("good")["answer"], F.lit("timeout")).alias("status"))


def stable(listings: DataFrame, seconds: float = 1.0) -> DataFrame:
    """Listing rows whose signature (size, modified) is the one of the scan before, at least `seconds` earlier."""
    order = Window.partitionBy("folder", "name").orderBy("seen_at")
    before = F.lag(F.struct("size", "modified", "seen_at")).over(order)
    same = (before["size"] == F.col("size")) & (before["modified"] == F.col("modified"))
    waited = F.unix_micros(F.col("seen_at").cast("timestamp")) - F.unix_micros(before["seen_at"].cast("timestamp")) >= int(seconds * 1e6)
    return listings.withColumn("_same", same & waited).filter("_same").drop("_same")


def first_sightings(listings: DataFrame) -> DataFrame:
    """Each signature (folder, name, size, modified) once, when it was first seen."""
    return listings.groupBy("folder", "name", "size", "modified").agg(F.min("seen_at").alias("seen_at"))


def _sessions(rows: DataFrame, within: list[str], gap: str) -> DataFrame:
    """Rows (key, start, last, n ...) of one window each put together where the next starts before the last one's gap is over."""
    order = Window.partitionBy(*within).orderBy("start", "last")
    reach = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1)) + F.expr(f"INTERVAL {gap}")
    begins = F.when(reach.isNull() | (F.col("start") >= reach), 1).otherwise(0)
    numbered = rows.withColumn("_begins", begins).withColumn("_session", F.sum("_begins").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.groupBy(*within, "_session").agg(F.min("start").alias("start"), F.max("last").alias("last"), F.sum("n").alias("n"))


def debounce(events: DataFrame, key: str, gap: str = "800 milliseconds", time_slice: int = 3600) -> DataFrame:
    """(key, start, scan_at, n): bursts of events less than `gap` apart; the scan starts when a burst is over.

    Bursts are put together inside slices of `time_slice` seconds first, in as many tasks as there are slices of a key. Only a
    slice's first and last burst can go on in another slice; just these meet again, two rows for each slice at most.
    """
    sliced = events.select(F.col(key), F.col("ts").alias("start"), F.col("ts").alias("last"), F.lit(1).cast("long").alias("n"), F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / time_slice).alias("_slice"))
    parts = _sessions(sliced, [key, "_slice"], gap)
    inner = Window.partitionBy(key, "_slice")
    marked = parts.withColumn("_border", (F.col("_session") == 1) | (F.col("_session") == F.max("_session").over(inner)))
    border = _sessions(marked.filter("_border").select(key, "start", "last", "n"), [key], gap)
    whole = marked.filter("not _border").select(key, "start", "last", "n").unionByName(border.select(key, "start", "last", "n"))
    return whole.select(key, "start", (F.col("last") + F.expr(f"INTERVAL {gap}")).alias("scan_at"), "n")


def log_tail(logs: DataFrame, now, most: int = 200, seconds: int = 900) -> DataFrame:
    """The latest entries within a time before `now`, newest first."""
    recent = logs.filter((F.col("ts") <= now) & (F.col("ts") > now - F.expr(f"INTERVAL {seconds} SECONDS")))
    return recent.orderBy(F.desc("ts"), F.desc("seq")).limit(most)


def upsert_history(batch: DataFrame, target: DataFrame) -> DataFrame:
    """The target with the batch's records: one for each id, the newest; on a tie the batch's."""
    both = batch.withColumn("_prior", F.lit(1)).unionByName(target.withColumn("_prior", F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("created_at"), F.desc("_prior")))
    return both.withColumn("_rank", rank).filter("_rank = 1").drop("_rank", "_prior")


def merge_history(current: DataFrame, loaded: DataFrame) -> DataFrame:
    """Union by id; the current record wins, whatever its date."""
    both = current.withColumn("_prior", F.lit(1)).unionByName(loaded.withColumn("_prior", F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("_prior"), F.desc("created_at")))
    return both.withColumn("_rank", rank).filter("_rank = 1").drop("_rank", "_prior")


def newest_first(history: DataFrame) -> DataFrame:
    return history.orderBy(F.desc("created_at"), "id")


def directory_size(listing: DataFrame) -> DataFrame:
    """(folder, bytes) of files that are not hidden."""
    return listing.filter(~F.col("name").startswith(".")).groupBy("folder").agg(F.sum("size").alias("bytes"))


def ranked(df: DataFrame, keys: list[str], order: list[str], rank: str = "rank") -> DataFrame:
    """The frame with each row's rank in its key, from 1 on, in the order of other columns; a key may fill many tasks.

    Rows are sorted over all tasks by key and order, and written; a row's rank is its place in its task plus the number of
    the key's rows in tasks before, which are counted in one small row for each key and task. Equal rows have some order.
    """
    path = scratch_folder(df.sparkSession, "ranked")
    by = [F.col(c).asc_nulls_first() for c in (*keys, *order)]
    df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()).write.parquet(path)
    rows = df.sparkSession.read.parquet(path).withColumn("_part", F.shiftright("_at", 33))
    counts = rows.groupBy(*keys, "_part").agg(F.count("*").alias("_rows"), F.min("_at").alias("_first"))
    before = F.sum("_rows").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_rows")
    shifts = counts.select(*(F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)), F.col("_part").alias("_p"), (before - F.col("_first") + 1).alias("_shift"))
    same = F.col("_part") == F.col("_p")
    for n, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{n}"))
    return rows.join(shifts, same).select(*df.columns, (F.col("_at") + F.col("_shift")).alias(rank))


def unique_names(df: DataFrame, order: str = "doc_id", folder: str = "folder", name: str = "name", ext: str = "ext") -> DataFrame:
    """The frame with file_name: unsafe characters become -, and equal names of a folder are numbered from 2 to 999.

    Beyond that the order column makes the name unique. One name may be that of all documents.
    """
    clean = df.withColumn("_clean", F.regexp_replace(F.col(name), r'[/\\:*?"<>|]', "-"))
    suffix = F.when(F.col(ext) != "", F.concat(F.lit("."), F.col(ext))).otherwise("")
    number: Column = F.when(F.col("_n") == 1, "").when(F.col("_n") <= 999, F.concat(F.lit(" "), F.col("_n"))).otherwise(F.concat(F.lit(" "), F.col(order).cast("string")))
    return ranked(clean, [folder, "_clean", ext], [order], "_n").withColumn("file_name", F.concat("_clean", number, suffix)).drop("_n", "_clean")


def route_outputs(outputs: DataFrame, folders: DataFrame) -> DataFrame:
    """Outputs with `dest`, by their folder's mode: sameFolder, chosenFolder, or historyOnly, which writes no file."""
    joined = outputs.join(folders, "folder")
    dest = F.when(F.col("mode") == "sameFolder", F.col("folder")).when(F.col("mode") == "chosenFolder", F.col("chosen"))
    return joined.withColumn("dest", dest).filter("dest is not null").drop("mode", "chosen")
