"""Line deduplication over levelled sorted runs of line hashes.

A run is a table of (key, n): the hash of a line's key and the number of documents of some batches that hold it, in
buckets by hash and sorted inside them, so that runs are merged and anti-joined as they lie, without a shuffle. A new
batch is merge-anti-joined with the keys of the runs that are already in enough documents, and what is left becomes a run
of level 0. When a level has `fan_in` runs they are merged into one run of the next.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliowork.llm.shared import SPACES, ascii_lower, broadcast_if_small, drop_folder, read, shared_folder, text_of, whole_row, write_table, written

MIN_DOCS = 10
BATCHES = 4
FAN_IN = 2


def _keys(text: Column) -> Column:
    """Hashes of the keys of a text's lines, in order; null for an empty key. 128 bits tell keys apart."""
    stripped = F.transform(F.split(ascii_lower(text), "\n", -1), lambda x: F.trim(x, F.lit(SPACES)))
    return F.transform(stripped, lambda x: F.when(x != "", F.unhex(F.md5(x))))


class LineRuns:
    """The levelled store in a folder that driver and executors share; opened again on the folder, it goes on.

    A run's folder is named run-LEVEL-NUMBER-BUCKETS. Merging takes all runs below the new one's level, so a run stands for all
    runs of lower levels and numbers: those that a lost driver left behind are passed over. So are runs whose writing broke off;
    their numbers are never used again.
    """

    def __init__(self, spark: SparkSession, folder: str, min_docs: int = MIN_DOCS, fan_in: int = FAN_IN):
        self.spark, self.folder, self.min_docs, self.fan_in = spark, folder, min_docs, fan_in
        found = [tuple(map(int, name.split("-")[1:])) for name in written(spark, folder) if name.startswith("run-")]
        found = [x for x in found if not any(y[0] > x[0] and y[1] > x[1] for y in found)]
        self.buckets = found[0][2] if found else int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.number = max((int(name.split("-")[2]) for name in written(spark, folder, whole=False) if name.startswith("run-")), default=0)
        self.levels: list[list[tuple[str, str]]] = [[] for _ in range(max((x[0] for x in found), default=0) + 1)]
        for level, number, _ in sorted(found, key=lambda x: x[1]):
            table, path = f"foliowork_run_{uuid.uuid4().hex}", f"{folder}/run-{level}-{number}-{self.buckets}"
            spark.sql(f"CREATE TABLE {table} (key BINARY, n BIGINT) USING parquet CLUSTERED BY (key) SORTED BY (key) INTO {self.buckets} BUCKETS LOCATION '{path}'")
            self.levels[level].append((table, path))

    def _write(self, run: DataFrame, level: int) -> None:
        self.number += 1
        table, path = f"foliowork_run_{uuid.uuid4().hex}", f"{self.folder}/run-{level}-{self.number}-{self.buckets}"
        run.write.bucketBy(self.buckets, "key").sortBy("key").option("path", path).saveAsTable(table)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append((table, path))

    def _runs(self) -> list[tuple[str, str]]:
        return [run for level in self.levels for run in level]

    def add(self, counts: DataFrame) -> None:
        """Take a batch of (key, n), one row per key: what the runs do not know as repeated becomes a run of level 0."""
        new = counts.repartition(self.buckets, "key")
        for table, _ in self._runs():
            new = new.join(self.spark.table(table).filter(F.col("n") >= self.min_docs).select("key").hint("merge"), "key", "left_anti")
        self._write(new, 0)
        level = 0
        while len(self.levels[level]) >= self.fan_in:
            self._compact(level)
            level += 1

    def _compact(self, level: int) -> None:
        """Merge all runs up to a level, bucket by bucket, into one of the next."""
        old = [run for runs in self.levels[: level + 1] for run in runs]
        merged = self.spark.table(old[0][0])
        for table, _ in old[1:]:
            other = self.spark.table(table).withColumnRenamed("n", "more").hint("merge")
            merged = merged.join(other, "key", "full_outer").select("key", (F.coalesce("n", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("n"))
        self.levels[: level + 1] = [[] for _ in range(level + 1)]
        self._write(merged, level + 1)
        for table, path in old:
            self.spark.sql(f"DROP TABLE {table}")
            drop_folder(self.spark, path)

    def settled(self) -> DataFrame:
        """Keys in at least `min_docs` documents, from all runs merged into one."""
        if len(self._runs()) > 1:
            self._compact(len(self.levels) - 1)
        if not self._runs():
            return self.spark.createDataFrame([], "key binary")
        return self.spark.table(self._runs()[0][0]).filter(F.col("n") >= self.min_docs).select("key")

    def close(self) -> None:
        """Forget the tables; the runs stay in their folder."""
        for table, _ in self._runs():
            self.spark.sql(f"DROP TABLE {table}")
        self.levels = [[]]


def count_batches(docs: DataFrame, id_column: str, text_column: str, batches: int) -> DataFrame:
    """(batch, key, n): the documents of each batch that hold a line key. One pass over the texts."""
    keys = F.array_distinct(F.array_compact(_keys(text_of(text_column))))
    batch = F.pmod(F.xxhash64(F.col(f"`{id_column}`")), F.lit(batches)).cast("int").alias("batch")
    return docs.select(batch, F.explode(keys).alias("key")).groupBy("batch", "key").agg(F.count("*").alias("n"))


def dedup_lines(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_docs: int = MIN_DOCS, batches: int = BATCHES, runs: LineRuns | None = None
) -> DataFrame:
    """Drop, in every document, the lines whose key is in at least `min_docs` documents.

    A key is the line without white space at its ends, A-Z lower-cased; empty keys are never dropped. The table is
    taken in `batches` batches, all of which enter the runs before any line is judged; `runs` may bring the counts of
    earlier tables, and keeps those of this one. Returns all columns of `docs` with the text replaced, and n_lines, n_dropped
    (which replace columns of those names; no other name clashes). A null or empty text has one empty line and becomes an
    empty text. Repeated rows count as documents of their own and get equal results, as do rows of one id with several
    texts, each by its own text; rows with a null id are handled like others; an empty table gives no rows.
    """
    spark = docs.sparkSession
    folder = shared_folder(spark, "line-runs")
    store = runs or LineRuns(spark, f"{folder}/runs", min_docs)
    counts = write_table(count_batches(docs, id_column, text_column, batches), f"{folder}/batches", "batch")
    for k in range(batches):
        store.add(counts.filter(F.col("batch") == k).select("key", "n"))
    settled = write_table(store.settled(), f"{folder}/settled")
    drop_folder(spark, f"{folder}/batches")
    if runs is None:
        store.close()
        drop_folder(spark, f"{folder}/runs")

    others = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    carried = [c for c in others if c != text_column] or [id_column]  # the text itself is shuffled once
    rows = docs.select(whole_row(carried).alias("row"), docs[id_column].alias("id"), text_of(text_column).alias("text")).withColumn("own", F.xxhash64("text"))
    lines = rows.select("id", "own", F.posexplode(_keys(F.col("text"))).alias("place", "key")).filter("key is not null")
    settled = broadcast_if_small(settled, f"{folder}/settled")
    dropped = lines.join(settled, "key", "left_semi").groupBy("id", "own").agg(F.collect_set("place").alias("dropped")).withColumnsRenamed({"id": "its_id", "own": "its_own"})
    n_lines = F.size(F.split("text", "\n", -1))
    kept = F.array_except(F.sequence(F.lit(0), F.col("n_lines") - 1), F.coalesce("dropped", F.array().cast("array<int>")))
    whole = F.transform(F.array(F.split("text", "\n", -1)), lambda own: F.array_join(F.transform("kept", lambda k: F.get(own, k)), "\n"))  # split once
    text = F.when(F.col("dropped").isNull(), F.col("text")).otherwise(F.get(whole, 0))
    return (
        rows.join(dropped, F.col("id").eqNullSafe(F.col("its_id")) & (F.col("own") == F.col("its_own")), "left")
        .withColumn("n_lines", n_lines)
        .withColumn("kept", kept)
        .select(
            *((text if c == text_column else F.col("row").getField(c)).alias(c) for c in others),
            F.col("n_lines").cast("long"), (F.col("n_lines") - F.size("kept")).cast("long").alias("n_dropped"),
        )
    )


def op1_line_dedup(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


_STRIP = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
OP1_SQL = f"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM split),
keyed AS (SELECT *, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_STRIP}) AS key FROM lines),
hot AS (SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= {MIN_DOCS})
SELECT doc_id, count(*)::BIGINT AS n_lines, count(hot.key)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE hot.key IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN hot USING (key) GROUP BY doc_id
"""

QUERIES = {"op1_line_dedup": op1_line_dedup}
ORACLES = {"op1_line_dedup": OP1_SQL}
