"""Structured Streaming forms of the folder, job and request operators, and the streaming conversion.

Each has a batch form in operators.jobs with the same meaning on complete data. Event time carries a watermark, so that
state is dropped; rows later than it are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from foliowork.operators.jobs import FINISHED
from foliowork.operators.rules import DEFAULT_EXCLUDES, match_rules
from foliowork.sources.readers import admission, decode_text
from foliowork.streaming.ordered import in_order

WATERMARK = "10 minutes"
#: Seconds without news after which a file or a job is forgotten.
FORGET = 7 * 86400


def watch(spark: SparkSession, path: str, include: str = "", exclude: str = DEFAULT_EXCLUDES, per_trigger: int = 1000) -> DataFrame:
    """New files of a folder (path, name, length, mtime, content), by name rules and admission, once for each signature."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", per_trigger).option("recursiveFileLookup", True).load(path)
    named = files.withColumn("name", F.regexp_extract("path", r"([^/]+)$", 1)).withColumnRenamed("modificationTime", "mtime")
    admitted = admission(named.filter(match_rules("name", include, exclude))).filter("verdict = 'ok'")
    return admitted.withWatermark("mtime", WATERMARK).dropDuplicatesWithinWatermark(["path", "length", "mtime"]).select("path", "name", "ext", "length", "mtime", "content")


def debounce(events: DataFrame, key: str, gap: str = "800 milliseconds", watermark: str = WATERMARK) -> DataFrame:
    """(key, start, scan_at, n): a scan for each burst of events, when nothing more can belong to it."""
    window = F.session_window("ts", gap)
    grouped = events.withWatermark("ts", watermark).groupBy(F.col(key), window.alias("w")).agg(F.count("*").alias("n"))
    return grouped.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("scan_at"), "n")


def _moment(micros: pd.Series) -> pd.Series:
    return pd.to_datetime(micros, unit="us")


def stable(listings: DataFrame, seconds: float = 1.0, forget: float = FORGET, watermark: str = WATERMARK) -> DataFrame:
    """(folder, name, size, modified, seen_at): listing rows whose signature is that of the scan before, long enough ago.

    Scans are taken in the order of their event time, once the watermark has passed them. A file that no listing has named for
    `forget` seconds of event time is forgotten; named again, it starts anew.
    """

    def fold(rows: pd.DataFrame, last: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
        read = ["run", "time_us", "size", "modified"]
        both = pd.concat([last.rename(columns={"at_us": "time_us"})[read], rows[read]], ignore_index=True) if len(last) else rows[read]
        place = both.sort_values("run", kind="stable").index  # a run's state comes before its rows
        own, before = both.loc[place], both.loc[place].shift(1)
        same = (own["run"] == before["run"]) & (own["size"] == before["size"]) & (own["modified"] == before["modified"]) & (own["time_us"] - before["time_us"] >= seconds * 1e6)
        kept = rows[same.loc[range(len(both) - len(rows), len(both))].to_numpy()]
        end = rows.groupby("run").tail(1)
        return end[["run", "time_us", "size", "modified"]].rename(columns={"time_us": "at_us"}), kept[["folder", "name", "size", "modified"]].assign(seen_at=_moment(kept["time_us"]))

    state, out = "at_us long, size long, modified double", "size long, modified double, seen_at timestamp"
    return in_order(listings, ["folder", "name"], "seen_at", ["size", "modified"], state, out, fold, watermark, forget)


def new_signatures(listings: DataFrame, include: str = "", exclude: str = DEFAULT_EXCLUDES, forget: float = FORGET, watermark: str = WATERMARK) -> DataFrame:
    """(path, size, modified, seen_at): admitted files of the listings (path, size, modified, seen_at), once for each signature.

    A file that changes is given again; one that is listed again as it was is not, however often and across restarts: its
    signature is kept as long as listings name it, and `forget` seconds of event time beyond.
    """
    named = listings.withColumn("name", F.regexp_extract("path", r"([^/]+)$", 1)).filter(match_rules("name", include, exclude))
    admitted = admission(named.withColumnRenamed("size", "length")).filter("verdict = 'ok'").withColumnRenamed("length", "size")

    def fold(rows: pd.DataFrame, last: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
        signature = ["run", "size", "modified"]
        known = pd.concat([last[signature].assign(old=True), rows.assign(old=False)], ignore_index=True).drop_duplicates(signature)
        new = known[~known["old"]]
        return known[signature], new[["path", "size", "modified"]].astype({"size": "int64"}).assign(seen_at=_moment(new["time_us"]))

    state, out = "size long, modified double", "size long, modified double, seen_at timestamp"
    return in_order(admitted, ["path"], "seen_at", ["size", "modified"], state, out, fold, watermark, forget)


def job_state(progress: DataFrame, forget: float = FORGET, watermark: str = WATERMARK) -> DataFrame:
    """(job_id, stage, ts) whenever a job's stage is known anew; a finished job stays, unless it is cancelled.

    Reports are taken in the order of ts and seq, once the watermark has passed them. A job without progress for `forget`
    seconds of event time is forgotten, finished or not.
    """

    def fold(rows: pd.DataFrame, last: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
        ends = rows["stage"].isin(FINISHED).astype("int64")
        ended = (ends.groupby(rows["run"]).cumsum() - ends > 0) | rows["run"].isin(last.loc[last["stage"].isin(FINISHED), "run"])
        counted = rows.loc[(rows["stage"] == "cancelled") | ~ended, ["run", "stage", "time_us"]].rename(columns={"time_us": "at"})
        state = pd.concat([last[["run", "stage", "at"]], counted], ignore_index=True).groupby("run").tail(1)
        jobs = rows.drop_duplicates("run").set_index("run")["job_id"]
        return state, pd.DataFrame({"job_id": jobs.loc[state["run"]].array, "stage": state["stage"].array, "ts": _moment(state["at"]).array})

    return in_order(progress, ["job_id"], "ts", ["seq", "stage"], "stage string, at long", "stage string, ts timestamp", fold, watermark, forget)


def stalled(progress: DataFrame, seconds: int = 60, watermark: str = "1 second") -> DataFrame:
    """(job_id, ts, gap): running jobs of which nothing came for `seconds` of event time; progress resumes them."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        columns = ["job_id", "ts", "gap"]
        if state.hasTimedOut:
            stage, at = state.get
            now = state.getCurrentWatermarkMs() / 1000
            state.remove()
            yield pd.DataFrame([(key[0], pd.Timestamp(at, unit="s"), now - at)], columns=columns)
            return
        rows = pd.concat(list(batches)).sort_values(["ts", "seq"]).reset_index(drop=True)
        rows["at"] = rows["ts"].map(pd.Timestamp.timestamp)
        before = rows[["stage", "at"]].shift(1)
        if state.exists:
            before.loc[0, ["stage", "at"]] = state.get
        gap = rows["at"] - before["at"]
        long = before["at"].notna() & ~before["stage"].isin(FINISHED) & (gap >= seconds)
        last = (rows["stage"].iloc[-1], float(rows["at"].iloc[-1]))
        state.update(last)
        if last[0] not in FINISHED:
            state.setTimeoutTimestamp(max(int((last[1] + seconds) * 1000), state.getCurrentWatermarkMs() + 1))
        own = pd.DataFrame({"job_id": key[0], "ts": pd.to_datetime(before["at"][long].astype(float), unit="s"), "gap": gap[long].astype(float)})
        yield own[columns]

    kind = progress.schema["job_id"].dataType.simpleString()
    marked = progress.withWatermark("ts", watermark)
    return marked.groupBy("job_id").applyInPandasWithState(step, f"job_id {kind}, ts timestamp, gap double", "stage string, at double", "append", GroupStateTimeout.EventTimeTimeout)


def match_handoffs(requests: DataFrame, responses: DataFrame, seconds: int = 600, watermark: str = WATERMARK) -> DataFrame:
    """(id, status): the answer to each request within the limit, or a timeout once that is over. An id counts once."""
    asked = requests.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["id"]).alias("q")
    answers = responses.select(F.col("id").alias("r_id"), F.col("ts").alias("r_ts"), F.col("status").alias("answer")).withWatermark("r_ts", watermark).alias("r")
    on = F.expr(f"id = r_id AND r_ts >= ts AND r_ts <= ts + INTERVAL {seconds} SECONDS")
    return asked.join(answers, on, "leftOuter").select("id", F.coalesce("answer", F.lit("timeout")).alias("status"))


def arriving(files: DataFrame) -> DataFrame:
    """Watched files as documents (doc_id, ext, text, name, mtime): the path is the id."""
    return files.select(F.col("path").alias("doc_id"), "ext", decode_text("content").alias("text"), "name", "mtime")


def convert_stream(docs: DataFrame, store: str, checkpoint: str, mode: str = "markdown"):
    """Start a query that converts arriving documents (doc_id, ext, text, name, mtime) into a store of documents and history.

    Each batch is written below its number and counts once its commit is there, so a batch that broke off and comes again
    takes the place of what was left of it: every document is there once. See sources.store for reading.
    """
    from foliowork.sources.store import write_batch

    return docs.writeStream.foreachBatch(lambda batch, n: write_batch(batch, n, store, mode)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
