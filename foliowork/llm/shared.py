"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The white space of the contracts: space, and tab to carriage return.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]++"


_own_roots: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only where one machine does all may it be unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        context = spark.sparkContext
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if context.applicationId not in _own_roots:
            _own_roots[context.applicationId] = f"file://{tempfile.mkdtemp(prefix='foliowork-')}"
        root = _own_roots[context.applicationId]
    return root.rstrip("/")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below the shared root; the caller writes tables there."""
    return f"{shared_root(spark)}/foliowork/{name}-{uuid.uuid4().hex}"


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate tables that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def written(spark: SparkSession, folder: str, whole: bool = True) -> list[str]:
    """Names of the tables below a folder, in order; of those only that were written to their end, if asked for `whole` ones."""
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(where):
        return []
    paths = [status.getPath() for status in files.listStatus(where)]
    return sorted(p.getName() for p in paths if not whole or files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def whole_row(columns: list[str]) -> Column:
    """Columns as one struct, so that no name of theirs can clash with a working column's."""
    return F.struct(*(F.col(f"`{c}`") for c in columns))


def write_table(df: DataFrame, path: str, *partition_by: str) -> DataFrame:
    """Write a table and return a frame that reads it: lineage ends here and lost executors cost nothing."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_of(column: str = "text") -> Column:
    """A text column in which null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACES = " \t\n\x0b\x0c\r"


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else; texts of one byte per character take the faster built-in."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def folder_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of the files below a path, from the file system's own summary."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(where).getLength()


def broadcast_if_small(table: DataFrame, path: str, most: int = 4 << 20) -> DataFrame:
    """Broadcast a written table whose files hold `most` bytes at most, and eight times that once they are decoded.

    A larger one is joined by shuffling.
    """
    if folder_bytes(table.sparkSession, path) > most:
        return table
    wide = [f.name for f in table.schema.fields if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    longs = [f.name for f in table.schema.fields if isinstance(f.dataType, T.ArrayType)]
    row = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in wide), F.lit(16 * len(table.columns)))
    row = sum((16 * F.greatest(F.size(c), F.lit(0)) for c in longs), row)
    decoded = table.agg(F.sum(row.cast("long"))).first()[0] or 0
    return F.broadcast(table) if decoded <= 8 * most else table


#: Bits of a bitmap for each marked hash, and of its address at most. False hits only cost work: what they let through is
#: joined or compared afterwards.
BITS_EACH, ADDRESS = 8, 28


def bitmap(hashes: DataFrame, column: str) -> np.ndarray:
    """A bitmap with the bits of all hashes in a column, of a size that follows their number; its words are made by Spark."""
    address = min(ADDRESS, max(16, (BITS_EACH * hashes.count()).bit_length()))
    bit = hashes.select(F.expr(f"{column} & {(1 << address) - 1}L").alias("bit"))
    words = bit.groupBy(F.expr("bit >> 6").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit & 63 as int)))").alias("bits")).toArrow()
    out = np.zeros(1 << (address - 6), dtype=np.uint64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return out


def is_marked(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the bits of hashes are set; low bits, since the high ones of least hashes are small."""
    bit = hashes.view(np.uint64) & np.uint64(64 * len(words) - 1)
    return (words[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)
