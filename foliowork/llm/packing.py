"""Packing of tokenised documents into fixed windows by minimum bin slack.

Full windows of a long document are sequences of their own. What is left of every document goes into a pool,
and each further window takes the longest piece of the pool and then the multiset of remaining lengths that
comes closest to the free room: a subset-sum dynamic programme whose states are the bits of one integer, with
the counts read back from the stored states. Room that stays free beyond SLACK takes a part of the longest
piece left. A pool holds a bounded number of pieces and belongs to one task,
so nothing is shuffled and memory does not grow with the table.
"""

from __future__ import annotations

import base64
import functools
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from foliowork.llm.shared import text_of

CAPACITY = 2048
END_ID = 1
#: Pieces and tokens that one pool holds at most before it is packed.
POOL_PIECES = 4096
POOL_TOKENS = 4_000_000
#: A window with more free room than this is filled with a part of another piece, whose rest goes back into the pool; with no
#: piece left, when the task ends, it is cut at powers of two instead of padded.
SLACK = 32

#: Characters on which every version of Unicode's tables agrees; other texts go through the tokenizer file.
_OTHER = re.compile("[^\x00-ɏ]")
#: White space in one run from which the ranks' encoder, whose pattern goes back over such a run, is not used.
LONG_RUN = 50_000
_RUN = re.compile(r"\s{%d}" % LONG_RUN)


@functools.cache
def _encoder(tokenizer_file: str, rank_file: str | None):
    """A function from text to an array of ids.

    The tokenizer file defines the ids. Its vocabulary as ranks gives the same ids faster, and is used for texts
    without special tokens, without characters on which Unicode versions may differ and without very long runs of white space.
    """
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_file)
    special = [t.content for t in whole.get_added_tokens_decoder().values()]

    def slow(text: str) -> np.ndarray:
        return np.array(whole.encode(text, add_special_tokens=False).ids, dtype="<u4")

    if rank_file is None:
        return slow

    import public_tokenizers
    import tiktoken

    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> np.ndarray:
        if _OTHER.search(text) or any(s in text for s in special) or (len(text) >= LONG_RUN and _RUN.search(text)):
            return slow(text)
        return np.array(fast.encode_ordinary(text), dtype="<u4")

    return encode


def closest_multiset(room: int, counts: dict[int, int]) -> dict[int, int]:
    """How many of each length to take so that their sum is as near to `room` as it can be without passing it.

    Bit v of `reach` says that some multiset sums to v. Lengths are added from the longest on, each at most as
    often as it is there; the states before each length allow reading the counts back.
    """
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        steps.append((length, reach))
        left, times = min(counts[length], room // length), 1
        while left > 0:  # 1, 2, 4 ... and the rest: every count up to `left` is a sum of these
            take = min(times, left)
            reach |= (reach << (take * length)) & mask
            left, times = left - take, times * 2
        if reach >> room & 1:
            break
    at, chosen = reach.bit_length() - 1, {}
    for length, before in reversed(steps):
        n = 0
        while not before >> at & 1:
            at, n = at - length, n + 1
        if n:
            chosen[length] = n
    return chosen


def windows(counts: dict[int, int], capacity: int, keep_back: int) -> Iterator[tuple[list[int], int, int]]:
    """Lengths for one window after another; stops when no more than `keep_back` tokens are left in `counts`.

    With each come the length of a piece to cut and how many of its tokens end the window: 0 and 0 where at most SLACK
    tokens stay free or nothing is left to cut. The rest of a cut piece is back in `counts`.
    """
    left = sum(k * v for k, v in counts.items())

    def drop(length: int, n: int) -> None:
        counts[length] -= n
        if not counts[length]:
            del counts[length]

    while left > keep_back and counts:
        first = max(counts)
        take = defaultdict(int, {first: 1})
        drop(first, 1)
        for length, n in closest_multiset(capacity - first, counts).items():
            take[length] += n
            drop(length, n)
        total = sum(k * v for k, v in take.items())
        room, cut = capacity - total, 0
        if room > SLACK and counts:  # every piece left is longer than the room, else it would have been taken
            cut = max(counts)
            drop(cut, 1)
            counts[cut - room] = counts.get(cut - room, 0) + 1
        left -= capacity if cut else total
        yield [k for k, v in sorted(take.items(), reverse=True) for _ in range(v)], cut, room if cut else 0


def powers_of_two(total: int, capacity: int) -> list[int]:
    """`total` as descending powers of two, none above `capacity`."""
    parts = []
    while total:
        parts.append(min(capacity, 1 << (total.bit_length() - 1)))
        total -= parts[-1]
    return parts


class _Packer:
    """The pool of one task; every method yields pieces (doc, start, ids, doc_tokens, sequence_id, offset)."""

    def __init__(self, capacity: int, first_sequence: int):
        self.capacity, self.sequence = capacity, first_sequence
        self.by_length: dict[int, list] = defaultdict(list)
        self.pieces = self.tokens = 0

    def add(self, doc, ids: np.ndarray):
        n, full = len(ids), len(ids) - len(ids) % self.capacity
        for start in range(0, full, self.capacity):
            yield doc, start, ids[start : start + self.capacity], n, self._next(), 0
        if n > full:
            self.by_length[n - full].append((doc, full, ids[full:].copy(), n))
            self.pieces, self.tokens = self.pieces + 1, self.tokens + n - full
        if self.pieces >= POOL_PIECES or self.tokens >= POOL_TOKENS:
            yield from self.pack(last=False)

    def _next(self) -> int:
        self.sequence += 1
        return self.sequence - 1

    def pack(self, last: bool):
        counts = {k: len(v) for k, v in self.by_length.items() if v}
        keep_back = 0 if last else max(self.capacity, min(self.tokens // 2, 16 * self.capacity))  # so that a piece is left to cut
        for lengths, cut, part in windows(counts, self.capacity, keep_back):
            own = [self.by_length[x].pop() for x in lengths]
            total = sum(lengths) + part
            self.pieces, self.tokens = self.pieces - len(own), self.tokens - total
            if cut:
                doc, start, ids, n = self.by_length[cut].pop()
                own.append((doc, start, ids[:part], n))
                self.by_length[cut - part].append((doc, start + part, ids[part:], n))
            if last and self.capacity - total > SLACK:
                yield from self._cut(own, total)
                continue
            sequence, offset = self._next(), 0
            for doc, start, ids, n in own:
                yield doc, start, ids, n, sequence, offset
                offset += len(ids)

    def _cut(self, own: list, total: int):
        """Windows of power-of-two lengths, which need no padding, over the pieces laid end to end."""
        parts = iter(powers_of_two(total, self.capacity))
        room = size = next(parts)
        sequence = self._next()
        for doc, start, ids, n in own:
            while len(ids):
                if not room:
                    room = size = next(parts)
                    sequence = self._next()
                take = min(room, len(ids))
                yield doc, start, ids[:take], n, sequence, size - room
                start, ids, room = start + take, ids[take:], room - take


def pack_sequences(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    capacity: int = CAPACITY,
    tokenizer_file: str | None = None,
    rank_file: str | None = None,
    with_ids: bool = True,
) -> DataFrame:
    """Cut and pack whole documents into sequences of at most `capacity` tokens.

    One row per piece: the id column, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked
    for, the piece's ids. A document's ids are those of its text with END_ID after them, so an empty or null text
    is one piece of one token. Each id is in exactly one piece. Null ids and repeated rows pass through, each row
    a document of its own; other columns are ignored, whatever their names; an empty table gives no pieces.
    Sequence ids are unique over the table but not dense: the task's partition is their upper part.
    """
    if tokenizer_file is None:
        import public_tokenizers

        tokenizer_file = public_tokenizers.path("byte_bpe_50k.json")
        rank_file = rank_file or public_tokenizers.path("byte_bpe_50k.tiktoken")
    id_type = docs.schema[id_column].dataType
    rows = docs.select(docs[id_column].alias("doc"), text_of(text_column).alias("text"))
    long, names = T.LongType(), ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    schema = T.StructType([T.StructField(id_column, id_type), *(T.StructField(x, long) for x in names)])
    if with_ids:
        schema.add("ids", T.ArrayType(T.LongType()))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer_file, rank_file)
        packer = _Packer(capacity, TaskContext.get().partitionId() << 40)
        out: list = []

        def flush(doc_type):
            columns = [pa.array([x[0] for x in out], type=doc_type)]
            columns += [pa.array([x[k] for x in out], type=pa.int64()) for k in range(1, 7)]
            if with_ids:
                columns.append(pa.array([x[7] for x in out], type=pa.list_(pa.int64())))
            out.clear()
            return pa.RecordBatch.from_arrays(columns, names=schema.names)

        def keep(pieces):
            for doc, start, ids, n, sequence, offset in pieces:
                crc = zlib.crc32(np.ascontiguousarray(ids).data)
                out.append((doc, start, len(ids), crc, n, sequence, offset, ids.tolist() if with_ids else None))

        doc_type = None
        for batch in batches:
            doc_type = batch.schema.field(0).type
            for doc, text in zip(*batch.columns, strict=True):
                keep(packer.add(doc.as_py(), np.append(encode(text.as_py()), np.uint32(END_ID)).astype("<u4")))
                if len(out) >= (500 if with_ids else 20_000):
                    yield flush(doc_type)
        if doc_type is not None:
            keep(packer.pack(last=True))
            if out:
                yield flush(doc_type)

    return rows.mapInArrow(task, schema)


def op9_packing(spark, sf_dir):
    from foliowork.llm.shared import read

    return pack_sequences(read(spark, sf_dir, "documents"), with_ids=False)


QUERIES = {"op9_packing": op9_packing}
ORACLES: dict[str, str] = {}
