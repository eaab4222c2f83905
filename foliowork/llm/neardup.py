"""Near-duplicates by an inverted join over MinHash coordinates.

1. Every text gets its set of word shingles and a signature of K coordinates. Texts with equal sets are one class.
2. A class is posted under (coordinate, value) pairs. Pairs that agree in T of K coordinates must share one among
   the K - T + 1 that come first in any common order; rare values come first, so values that many classes share are
   skipped. Only postings of two or more go on.
3. In a posting, coordinates of two signatures are merged and their collisions counted, in blocks of bounded size. A pair with
   T or more belongs to one posting, the first in the common order that both are in; a task puts out which classes
   of the posting are in such a pair, not the pairs.
4. The whole shingle sets of these classes are compared inside the same block of the posting; a task puts out a spanning forest of
   the confirmed links. Components of these links, and of nothing else, are the answer.

With K = 64 and T = 30 a pair of similarity 0.75 is missed with a probability below one in a million.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliowork.llm.components import connected_components
from foliowork.llm.quality import _texts
from foliowork.llm.shared import bitmap, broadcast_if_small, is_marked, read, shared_folder, text_of, write_table
from foliowork.llm.shingles import by_bytes, shingle_sets

COORDINATES, MATCHES = 64, 30
PREFIX = COORDINATES - MATCHES + 1
#: Posted values that get a rank by their count: at most so many, with so many documents at least. Others count as rare.
RANKED, RANKED_FROM = 500_000, 16
#: Rows of a posting, and shingles of their sets, that one block holds; pairs that one array step compares.
BLOCK_ROWS, BLOCK_SHINGLES, PAIRS = 512, 400_000, 1 << 15
SIMILAR = 75

_MULTIPLIERS = np.random.default_rng(64).integers(0, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(one: np.ndarray) -> np.ndarray:
    """The least 32-bit value of a set under each of the multipliers."""
    out = np.full(COORDINATES, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(one), 4096):
        part = (np.multiply.outer(_MULTIPLIERS, one[at : at + 4096]) >> np.uint64(32)).min(axis=1)
        out = np.minimum(out, part.astype(np.uint32))
    return out


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) to (id, n, digest, signature); without words the digest and the signature are null."""
    for batch in batches:
        for part in by_bytes(batch, 1):
            sets = shingle_sets(*_texts(part.column(1)))
            n = pa.array([len(x) for x in sets], type=pa.int64())
            digest = pa.array([hashlib.md5(x.tobytes()).hexdigest() if len(x) else None for x in sets], type=pa.string())
            signed = pa.array([signature(x).tobytes() if len(x) else None for x in sets], type=pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), n, digest, signed], names=["id", "n", "digest", "signature"])


def _values(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<u4").reshape(len(column), COORDINATES)


def _keys(signatures: np.ndarray) -> np.ndarray:
    """Coordinate and value in one number."""
    return signatures.astype(np.int64) | (np.arange(COORDINATES, dtype=np.int64) << 32)


def _counts(keys: np.ndarray, order) -> np.ndarray:
    """How many classes are posted under each key, as far as it is among the ranked ones; else 0."""
    known, counts = order.value
    if not len(known):
        return np.zeros(keys.shape, dtype=np.int64)
    place = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[place] == keys, counts[place], 0)


def _post(first: int, order) -> Callable:
    """(v, n, signature) to (key, v, n) rows: the `first` keys of every class, in the common order: by count, then coordinate."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                keys = _keys(_values(part.column(2)))
                if order is not None:
                    keys = np.take_along_axis(keys, np.argsort(_counts(keys, order), axis=1, kind="stable"), axis=1)
                take = pa.array(np.repeat(np.arange(len(keys)), first))
                yield pa.RecordBatch.from_arrays([pa.array(keys[:, :first].ravel()), part.column(0).take(take), part.column(1).take(take)], names=["key", "v", "n"])

    return task


def spanning(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric boolean matrix, the smallest row of its component."""
    label = np.arange(len(linked))
    while True:
        lowest = np.where(linked, label[None, :], len(linked)).min(axis=1)
        new = np.minimum(label, lowest)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _starts(batch: pa.RecordBatch) -> np.ndarray:
    """Whether each row differs from the one before in (group, left, right)."""
    change = np.ones(batch.num_rows, dtype=bool)
    change[1:] = False
    for k in range(3):
        x = batch.column(k)
        change[1:] |= pc.not_equal(x.slice(1), x.slice(0, len(x) - 1)).to_numpy(zero_copy_only=False)
    return change


def _whole_groups(batches: Iterator[pa.RecordBatch], enough: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows again, in batches of whole groups with `enough` rows or more."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def key(batch: pa.RecordBatch, row: int) -> list:
        return [batch.column(k)[row].as_py() for k in range(3)]

    def joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        return pa.Table.from_batches([x for x in parts if x.num_rows]).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        change, done = _starts(batch), 0
        change[0] = bool(held) and key(held[-1], held[-1].num_rows - 1) != key(batch, 0)
        for cut in np.flatnonzero(change).tolist():
            if rows + cut - done >= enough:
                yield joined([*held, batch.slice(done, cut - done)])
                held, rows, done = [], 0, cut
        held.append(batch.slice(done))
        rows += batch.num_rows - done
    if rows:
        yield joined(held)


def _edges(v: pa.Array, label: np.ndarray) -> list[pa.Array]:
    moved = np.flatnonzero(label != np.arange(len(label)))
    return [v.take(pa.array(moved)), v.take(pa.array(label[moved]))]


def colliding(keys: np.ndarray, group: np.ndarray, signatures: np.ndarray, order) -> np.ndarray:
    """Whether each row is in a pair of its group that has MATCHES collisions or more and belongs to the group's key."""
    n = len(group)
    ends = np.repeat(np.append(np.flatnonzero(group)[1:], n), np.diff(np.append(np.flatnonzero(group), n)))
    later = ends - np.arange(n) - 1
    total, found, at = np.cumsum(later), np.zeros(n, dtype=bool), 0
    while at < n:
        stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, side="right")))
        own = later[at:stop]
        a = np.repeat(np.arange(at, stop), own)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(own) - own, own)
        agree = np.take(signatures, a, axis=0) == np.take(signatures, b, axis=0)
        lanes = agree.view(np.uint64).sum(axis=1)  # eight sums of at most eight in one number
        near = np.flatnonzero((lanes * np.uint64(0x0101010101010101)) >> np.uint64(56) >= MATCHES)
        if len(near):
            shared = _counts(_keys(signatures[a[near]]), order)
            first = np.where(agree[near], shared, np.iinfo(np.int64).max).argmin(axis=1)
            near = near[first == keys[a[near]] >> 32]
            found[a[near]] = found[b[near]] = True
        at = stop
    return found


def _candidates(order) -> Callable:
    """(group, left, right, v, signature) to the (group, left, right, v) whose whole sets are to be compared."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole_groups(batches, 2048):
            found = colliding(batch.column(0).to_numpy(), _starts(batch), _values(batch.column(4)), order)
            yield pa.RecordBatch.from_arrays(batch.columns[:4], names=batch.schema.names[:4]).filter(pa.array(found))

    return task


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(group, left, right, v, data) to links. Small groups are compared together: a link across them is one, too."""
    for batch in _whole_groups(batches, 64):
        yield pa.RecordBatch.from_arrays(_confirm(batch), names=["a", "b"])


def _confirm(batch: pa.RecordBatch) -> list[pa.Array]:
    """A spanning forest of the rows whose whole shingle sets are similar enough."""
    v = batch.column(3)
    sets = [np.frombuffer(x, dtype=np.uint64) for x in batch.column(4).to_pylist()]
    size = np.array([len(x) for x in sets])
    _, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), size)
    shared = np.zeros((len(sets), len(sets)), dtype=np.float32)
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    times = np.bincount(column)
    common = times[column] > 1  # a shingle of one text only is in no intersection
    column, row = column[common], row[common]
    column = np.unique(column, return_inverse=True)[1] if len(column) else column
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        part = slice(*np.searchsorted(column, (low, low + 4096)))
        has = np.zeros((len(sets), 4096), dtype=np.float32)
        has[row[part], column[part] - low] = 1
        shared += has @ has.T
    shared = np.rint(shared).astype(np.int64)
    linked = 100 * shared >= SIMILAR * (size[:, None] + size[None, :] - shared)
    return _edges(v, spanning(linked))


def _in_order(rows: DataFrame, inner: Callable, schema) -> DataFrame:
    return rows.repartition("group", "left", "right").sortWithinPartitions("group", "left", "right", "v").mapInArrow(inner, schema)


def near_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Components of documents whose sets of five-word shingles have a similarity of 0.75 or more.

    Returns, for every row, the id, n_shingles, component_id (the smallest id that can be reached, itself included) and
    kept (id = component_id). A-Z is lower-cased; a text of one to four words has one shingle; null, empty and blank texts
    have none and are linked with nothing. Rows of equal text are in one component; rows with a null id are their own,
    without an id, and stay. Ids should name one text: of rows with one id and several texts each goes with its own.
    Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    folder = shared_folder(spark, "near")
    kind = docs.schema[id_column].dataType
    texts = docs.select(docs[id_column].alias("id"), text_of(text_column).alias("text"))
    schema = T.StructType([T.StructField("id", kind)]).add("n", "long").add("digest", "string").add("signature", "binary")
    signed = write_table(texts.mapInArrow(_sign, schema), f"{folder}/signed")
    named = signed.filter("digest is not null and id is not null")
    classes = write_table(named.groupBy("digest").agg(F.min("id").alias("v"), F.first("n").alias("n"), F.first("signature").alias("signature")), f"{folder}/classes")

    posted = T.StructType([T.StructField("key", T.LongType()), T.StructField("v", kind), T.StructField("n", T.LongType())])
    every = classes.select("v", "n", "signature").mapInArrow(_post(COORDINATES, None), posted)
    top = every.groupBy("key").count().filter(F.col("count") >= RANKED_FROM).orderBy(F.desc("count"), "key").limit(RANKED).toPandas().sort_values("key")
    order = spark.sparkContext.broadcast((top["key"].to_numpy(np.int64), top["count"].to_numpy(np.int64)))
    posts = classes.select("v", "n", "signature").mapInArrow(_post(PREFIX, order), posted)
    path = f"{folder}/shared-keys"
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK_ROWS, F.sum("n") / BLOCK_SHINGLES)).alias("blocks")
    shared = write_table(posts.groupBy("key").agg(F.count("*").alias("rows"), blocks).filter("rows > 1").select("key", "blocks"), path)
    # Each row once for every pair of blocks of its posting that its own block takes part in; one block is one pair.
    own = F.pmod(F.xxhash64("v"), F.col("blocks"))
    dealt = posts.select("key", "v").join(broadcast_if_small(shared, path), "key").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    place = [F.col("key").alias("group"), F.least("own", "other").alias("left"), F.greatest("own", "other").alias("right")]
    where = T.StructType([T.StructField(c, T.LongType()) for c in ("group", "left", "right")]).add("v", kind)
    signatures = classes.select("v", F.col("signature").alias("data"))
    candidates = write_table(_in_order(dealt.join(signatures, "v").select(*place, "v", "data"), _candidates(order), where), f"{folder}/candidates")

    needed = candidates.groupBy("v").agg(F.collect_list(F.struct("group", "left", "right")).alias("needed")).join(classes.select("v", "digest"), "v")
    needed = write_table(needed, f"{folder}/needed")
    marks = spark.sparkContext.broadcast(bitmap(needed.select(F.xxhash64("v").alias("h")), "h"))

    @F.pandas_udf("boolean")
    def may_be_needed(hashes: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in hashes:
            yield pd.Series(is_marked(marks.value, part.to_numpy()))

    # Most texts are in no candidate pair: only their ids' hashes meet the bitmap, and the few that pass are shuffled.
    few = texts.filter(may_be_needed(F.xxhash64("id")))
    whole = few.join(needed.hint("merge"), few["id"] == needed["v"]).select("v", "needed", "digest", "text")
    sets = whole.mapInArrow(_data, T.StructType([*where.fields, T.StructField("data", T.BinaryType())]))
    links = _in_order(sets, _links, T.StructType([T.StructField("a", kind), T.StructField("b", kind)]))
    joined = connected_components(links, f"{folder}/links")

    path = f"{folder}/components"
    rooted = write_table(classes.select("digest", "v").join(joined, "v", "left").select("digest", F.coalesce("root", "v").alias("component")), path)
    found = signed.select("id", "n", "digest").join(rooted, "digest", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return found.select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def _data(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(v, needed, digest, text) to shingle sets where they are needed; rows whose set isn't the class's, by a repeated id, go."""
    for batch in batches:
        for part in by_bytes(batch, 3):
            sets = [x.tobytes() for x in shingle_sets(*_texts(part.column(3)))]
            keep = np.array([hashlib.md5(x).hexdigest() == d for x, d in zip(sets, part.column(2).to_pylist(), strict=True)])
            needed = part.column(1)
            row = np.repeat(np.arange(len(sets)), np.diff(needed.offsets.to_numpy()))
            places = [x.filter(pa.array(keep[row])) for x in needed.flatten().flatten()]
            row = row[keep[row]]
            for at in range(0, len(row), 256):
                own = row[at : at + 256]
                data = pa.array([sets[k] for k in own.tolist()], type=pa.binary())
                yield pa.RecordBatch.from_arrays([*(x.slice(at, 256) for x in places), part.column(0).take(pa.array(own)), data], names=["group", "left", "right", "v", "data"])


def drop_near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of `docs` that stay: one of each component, that of the smallest id, and rows without an id.

    Repeated rows of an id that stays all stay. Other columns pass through, whatever their names.
    """
    kept = near_groups(docs, id_column, text_column).filter("kept").select(id_column)
    own, its = docs.alias("own"), kept.alias("its")
    return own.join(its, F.col(f"own.`{id_column}`").eqNullSafe(F.col(f"its.`{id_column}`")), "left_semi")


def op5_minhash_near_dup(spark, sf_dir):
    return near_groups(read(spark, sf_dir, "documents"))


QUERIES = {"op5_minhash_near_dup": op5_minhash_near_dup}
ORACLES: dict[str, str] = {}
