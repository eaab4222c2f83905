"""Suffix-array deduplication of repeated byte strings, across and within documents.

Every string of `LENGTH` bytes is assigned to one of its own parts, the anchor: of its stretches of `ANCHOR` bytes the
one with the least hash. Equal strings have equal anchors at equal places, so a string can only repeat where its
anchor does. Strings of one anchor that follow each other form a context, a stretch of bytes.
1. Documents of equal text are copies of each other: one of them is looked at, and all are removed.
2. One pass over the texts writes all contexts. Anchors found twice or more are marked in a bitmap whose size follows
   their number; only their contexts go on.
3. A context found twice or more as a whole is removed wherever it is. Anchors with several contexts of which one is
   single, at the ends of repeated passages and around edits, stay open: one place of each of their contexts is joined with
   its text, and the bytes there are dealt to shards by anchor.
4. A shard is sorted into a suffix array by induced sorting; a start whose permuted common prefix with a
   neighbour has `LENGTH` bytes is the start of a repeated string.
5. Ranges are merged for each text, and cut from every document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliowork.llm.quality import _texts
from foliowork.llm.shared import bitmap, broadcast_if_small, drop_folder, is_marked, read, shared_folder, text_of, write_table
from foliowork.llm.shingles import mixed, powers
from foliowork.llm.suffixes import repeated_starts

LENGTH, ANCHOR = 200, 96
#: Bytes that one array step works on, bytes of a shard's text, contexts of one anchor in one block.
CHUNK, SHARD, BLOCK = 1 << 18, 2_000_000, 2048
_PLACE = 28  # low bits of a compared value that hold the position
_VALUE = np.random.default_rng(200).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def contexts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of texts laid end to end: the anchors' hashes, the contexts' hashes, texts, first starts and spans.

    Starts count from the beginning of their text. A text shorter than LENGTH has none.
    """
    data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    none = np.zeros(0, dtype=np.int64)
    room = np.diff(offsets) - LENGTH + 1
    if not (room > 0).any():
        return none, none, none, none, none
    value = _VALUE[data]
    rolling, width, wide = value, 1, {1: value}
    while width * 2 <= ANCHOR:
        rolling = rolling[:-width] + rolling[width:] * np.uint64(pow(_BASE, width, 1 << 64))
        width *= 2
        wide[width] = rolling
    whole, done = wide[width], width  # the rest of the anchor's width, from the widths that are there
    while done < ANCHOR:
        part = 1 << ((ANCHOR - done).bit_length() - 1)
        n = len(data) - done - part + 1
        whole = whole[:n] + wide[part][done : done + n] * np.uint64(pow(_BASE, done, 1 << 64))
        done += part
    hashes = mixed(whole)
    low = np.uint64((1 << _PLACE) - 1)
    ranked = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
    window, width = LENGTH - ANCHOR + 1, 1
    while width * 2 <= window:
        ranked = np.minimum(ranked[:-width], ranked[width:])
        width *= 2
    ranked = np.minimum(ranked[: len(ranked) - (window - width)], ranked[window - width :])
    fits = np.flatnonzero(room > 0)
    start = np.repeat(offsets[fits], room[fits]) + np.arange(room[fits].sum()) - np.repeat(np.cumsum(room[fits]) - room[fits], room[fits])
    anchor = (ranked[start] & low).astype(np.int64)
    cut = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
    first, last = start[cut], start[np.append(cut[1:], len(start)) - 1]
    sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(value * powers(_BASE, len(value)), dtype=np.uint64)))
    context = mixed((sums[last + LENGTH] - sums[first]) * powers(_INVERSE, len(value))[first] + (last - first).astype(np.uint64))
    text = np.searchsorted(offsets, first, side="right") - 1
    return hashes[anchor[cut]].view(np.int64), context.view(np.int64), text, first - offsets[text], last - first


def _pieces(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First row, first byte, data and offsets of parts of a column of about CHUNK bytes.

    A longer text is cut into parts that overlap, so that each of its strings of LENGTH bytes starts in one of them.
    """
    data, offsets = _texts(column)
    at = 0
    while at < len(column):
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, side="right")) - 1)
        if (n := int(offsets[stop] - offsets[at])) <= CHUNK:
            yield at, 0, data, offsets[at : stop + 1]
        else:
            for base in range(0, n - LENGTH + 1, CHUNK):
                end = min(base + CHUNK + LENGTH - 1, n)
                yield at, base, data[offsets[at] + base : offsets[at] + end], np.array([0, end - base])
        at = stop


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key1, key2, text) to the contexts; `place` is the first start and, in its low bits, the span."""
    for batch in batches:
        keys = [c.to_numpy(zero_copy_only=False) for c in batch.columns[:2]]
        for row, base, data, offsets in _pieces(batch.column(2)):
            anchor, context, text, first, span = contexts(data, offsets)
            columns = [anchor, context, keys[0][row + text], keys[1][row + text], (first + base) << 16 | span]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["anchor", "context", "key1", "key2", "place"])


def _marked(marks):
    """The contexts whose anchors are marked."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(is_marked(marks.value, batch.column(0).to_numpy())))

    return task


def _bytes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key1, key2, places, text) to one row for each place, with the bytes of its context."""
    for batch in batches:
        data, offsets = _texts(batch.column(3))
        lists = batch.column(2)
        anchor, blocks, place = (x.to_numpy() for x in lists.flatten().flatten())
        text = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        keys = [c.to_numpy()[text] for c in batch.columns[:2]]
        first = place >> 16
        start = offsets[text] + first
        stop = start + (place & 65535) + LENGTH
        for at in range(0, len(place), 4096):
            part = slice(at, at + 4096)
            own = [data[a:b].tobytes() for a, b in zip(start[part].tolist(), stop[part].tolist(), strict=True)]
            columns = [pa.array(x[part]) for x in (anchor, blocks, *keys, first)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(own, type=pa.binary())], names=["anchor", "blocks", "key1", "key2", "first", "data"])


def _sorted_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of (anchor, left, right) to the ranges that their repeated strings cover.

    A shard holds whole groups, and never two block pairs of one anchor, which would hold a context twice.
    """
    rows: list[tuple] = []
    group, size, held = None, 0, set()

    def flush() -> pa.RecordBatch:
        out: list[tuple] = []
        for (key1, key2, first, _), starts in zip(rows, repeated_starts([r[3] for r in rows], LENGTH), strict=True):
            if len(starts):
                cut = np.flatnonzero(np.diff(starts) > LENGTH)
                heads, ends = np.concatenate((starts[:1], starts[cut + 1])), np.concatenate((starts[cut], starts[-1:])) + LENGTH
                out += [(key1, key2, first + a, first + b) for a, b in zip(heads.tolist(), ends.tolist(), strict=True)]
        columns = [pa.array([x[k] for x in out], type=pa.int64()) for k in range(4)]
        return pa.RecordBatch.from_arrays(columns, names=["key1", "key2", "start", "stop"])

    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            for anchor, left, right, key1, key2, first, data in zip(*(c.to_pylist() for c in batch.slice(at, 1000).columns), strict=True):
                if (anchor, left, right) != group:
                    if rows and (size >= SHARD or anchor in held):
                        yield flush()
                        rows, size, held = [], 0, set()
                    group = (anchor, left, right)
                    held.add(anchor)
                rows.append((key1, key2, first, data))
                size += len(data)
    if rows:
        yield flush()


def merge_ranges(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of sorted ranges; ranges that touch are one."""
    out: list[tuple[int, int]] = []
    for start, stop in sorted(ranges):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(stop, out[-1][1]))
        else:
            out.append((start, stop))
    return out


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.int64())
    for batch in batches:
        merged = [merge_ranges([(r["start"], r["stop"]) for r in x]) for x in batch.column(2).to_pylist()]
        flat = [[x for pair in ranges for x in pair] for ranges in merged]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(flat, type=kind)], names=["key1", "key2", "ranges"])


def _cut(with_kept: bool, names: list[str]):
    def row(text: str, copies, ranges) -> tuple:
        data = text.encode("utf-8")
        if copies is not None and len(data) >= LENGTH:
            ranges = [0, len(data)]
        ranges = ranges or []
        kept, at = [], 0
        for start, stop in zip(ranges[::2], ranges[1::2], strict=True):
            kept.append(data[at:start])
            at = stop
        left = b"".join([*kept, data[at:]])
        return len(data), len(data) - len(left), len(ranges) // 2, hashlib.sha256(left).hexdigest(), left

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()][: 5 if with_kept else 4]
        for batch in batches:
            rows, at, size = [], 0, 0
            for k, values in enumerate(zip(*batch.columns[1:], strict=True), 1):
                rows.append(row(*(x.as_py() for x in values)))
                size += rows[-1][0]
                if size > 4 * CHUNK or k == batch.num_rows:
                    columns = [pa.array([r[c] for r in rows], type=kind) for c, kind in enumerate(kinds)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, k - at), *columns], names=names)
                    rows, at, size = [], k, 0

    return task


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", with_kept: bool = True) -> DataFrame:
    """Remove every byte that a string of LENGTH bytes covers which starts at another place too, overlaps included.

    Returns, for every row, the id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 and, if asked for,
    `kept`, the bytes that remain, which may not be whole characters. Strings are judged on the input and never cross
    documents. Null and empty texts lose nothing; rows with the same text, whatever their ids, are copies of each
    other; rows with a null id are handled like others; other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    folder = shared_folder(spark, "repeats")
    text = text_of(text_column)
    keys = ["key1", "key2"]  # together 128 bits that stand for a text
    keyed = docs.select(docs[id_column].alias("id"), F.xxhash64(text).alias("key1"), F.xxhash64(F.lit("second"), text).alias("key2"), text.alias("text"))

    path = f"{folder}/copies"
    copies = write_table(keyed.groupBy(*keys).agg(F.count("*").alias("copies"), F.min("id").alias("kept_id")).filter("copies > 1"), path)
    copied = keyed.join(broadcast_if_small(copies, path), keys, "left")
    long = F.octet_length("text") >= LENGTH
    texts = copied.filter(long & (F.col("copies").isNull() | F.col("id").eqNullSafe(F.col("kept_id")))).select(*keys, "text")

    row = "anchor long, context long, key1 long, key2 long, place long"
    every = write_table(texts.mapInArrow(_contexts, row), f"{folder}/every")
    shared = write_table(every.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor"), f"{folder}/shared")
    marks = spark.sparkContext.broadcast(bitmap(shared, "anchor"))
    marked = write_table(every.mapInArrow(_marked(marks), row), f"{folder}/contexts")
    drop_folder(spark, f"{folder}/every")
    one = [F.first(c).alias(c) for c in (*keys, "place")]
    kinds = write_table(marked.groupBy("anchor", "context").agg(F.count("*").alias("n"), *one), f"{folder}/kinds")
    repeated = kinds.filter("n > 1").select("anchor", "context")
    place = F.expr("place >> 16")
    whole = marked.join(repeated.hint("merge"), ["anchor", "context"]).select(*keys, place.alias("start"), (place + F.expr("place & 65535") + LENGTH).alias("stop"))

    path = f"{folder}/open"
    several = kinds.groupBy("anchor").agg(F.count("*").alias("rows"), F.count_if(F.col("n") == 1).alias("single")).filter("rows > 1 and single > 0")
    several = write_table(several.select("anchor", F.ceil(F.col("rows") / BLOCK).alias("blocks")), path)  # an anchor may have more contexts than a block
    chosen = kinds.join(broadcast_if_small(several, path), "anchor").groupBy(*keys).agg(F.collect_list(F.struct("anchor", "blocks", "place")).alias("places"))
    path = f"{folder}/places"
    chosen = write_table(chosen, path)
    with_text = texts.join(broadcast_if_small(chosen, path, 1 << 20), keys).select(*keys, "places", "text")
    blocked = with_text.mapInArrow(_bytes_of, "anchor long, blocks long, key1 long, key2 long, first long, data binary")
    own = F.pmod(F.xxhash64(*keys, "first"), F.col("blocks"))
    dealt = blocked.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("anchor", F.least("own", "other").alias("left"), F.greatest("own", "other").alias("right"), *keys, "first", "data")
    in_shards = dealt.repartition("anchor", "left", "right").sortWithinPartitions("anchor", "left", "right", *keys, "first")
    parts = in_shards.mapInArrow(_sorted_shards, "key1 long, key2 long, start long, stop long")

    path = f"{folder}/ranges"
    ranges = whole.unionByName(parts).groupBy(*keys).agg(F.collect_list(F.struct("start", "stop")).alias("ranges"))
    ranges = write_table(ranges.mapInArrow(_merge, "key1 long, key2 long, ranges array<long>"), path)
    final = copied.join(broadcast_if_small(ranges, path, 8 << 20), keys, "left").select("id", "text", "copies", "ranges")
    schema = T.StructType([T.StructField(id_column, docs.schema[id_column].dataType)])
    for name in ("n_bytes", "n_removed", "n_spans"):
        schema.add(name, "long")
    schema.add("kept_sha256", "string")
    if with_kept:
        schema.add("kept", "binary")
    return final.mapInArrow(_cut(with_kept, schema.names), schema)


def op10_suffix_array_dedup(spark, sf_dir):
    return remove_repeats(read(spark, sf_dir, "documents"), with_kept=False)


QUERIES = {"op10_suffix_array_dedup": op10_suffix_array_dedup}
ORACLES: dict[str, str] = {}
