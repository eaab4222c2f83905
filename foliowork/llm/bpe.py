"""BPE encoding and decoding with forced-boundary splitting.

A merge joins neighbouring symbols into a token of the vocabulary. Two bytes that never stand next to each other inside any
token can therefore never come to lie in one token, whatever is merged around them: between them is a certain cut. A piece
of text is split at all its certain cuts, the fragments are encoded independently of each other, and their ids are
concatenated. Fragments are short even where a text has no white space, so a merge never looks at much at once. Pairs at a
word's end, where the last symbol carries the end mark, are looked up in a table of their own.

Decoding looks tokens up and joins them; it works on whole Arrow columns.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliowork.llm.shared import read, text_of
from foliowork.llm.shingles import by_bytes

#: Texts are encoded in slices of about this many characters, cut at spaces; ids of that many tokens leave a task at once.
SLICE, OUT = 1 << 20, 1 << 20
#: Pieces whose ids are remembered, and their characters at most.
MEMO, MEMO_CHARS = 1 << 18, 64
#: Symbols of a fragment beyond which a queue finds the next merge.
LONG = 128
#: Below this character, also in lower case, every version of Unicode's tables agrees and composing changes nothing; a text
#: with others is normalised and cut into pieces by the tokenizers library.
PLAIN = 0x180
_OTHER = re.compile(f"[^\x00-{chr(PLAIN - 1)}]|İ")
_SPACES = "\t-\r \x85\xa0"


def byte_letters() -> list[str]:
    """The character that stands for each byte: itself where it is printable Latin-1, the others from U+0100 on in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = (b for b in range(256) if b not in shown)
    letters = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
    return [letters[b] for b in range(256)]


def _letters(kind: str) -> str:
    """A character class of all characters below PLAIN whose category begins with `kind`."""
    return "".join(re.escape(chr(c)) for c in range(PLAIN) if unicodedata.category(chr(c)).startswith(kind))


class _Memo(dict):
    """Ids of pieces, computed when first asked for; bounded."""

    def __init__(self, ids_of, share: int = 1):
        self.ids_of, self.share = ids_of, share

    def __missing__(self, piece):
        ids = self.ids_of(piece)
        if len(piece) <= MEMO_CHARS:
            if len(self) >= MEMO // self.share:
                self.clear()
            self[piece] = ids
        return ids


class Bpe:
    """The vocabulary and merges of a tokenizer file of the layout: NFC, spaces, lower case; pieces by a pattern; bytes; BPE."""

    def __init__(self, tokenizer_file: str):
        with open(tokenizer_file, encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        steps = (file["normalizer"] or {}).get("normalizers", []), (file["pre_tokenizer"] or {}).get("pretokenizers", [])
        kinds = tuple([x["type"] for x in own] for own in steps)
        special = file["added_tokens"]
        plain = not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in special)
        if kinds != (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]) or model["type"] != "BPE" or model["dropout"] or model["ignore_merges"] or file["decoder"] or not plain:
            raise ValueError(f"{tokenizer_file} is not of the layout that is encoded here")
        self.file, self.end = tokenizer_file, model["end_of_word_suffix"] or ""
        vocab, letters = model["vocab"], byte_letters()
        self.byte = {c: b for b, c in enumerate(letters)}
        tokens = dict(sorted((i, t) for t, i in vocab.items()) + [(t["id"], t["content"]) for t in special])
        self.tokens = [tokens.get(i) for i in range(max(tokens) + 1)]
        merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in (x if isinstance(x, list) else x.split(" ", 1) for x in model["merges"])]
        #: The rank of each mergeable pair of ids, and the id that a merge of each rank makes.
        self.rank, self.made = {a << 32 | b: rank for rank, (a, b, _) in reversed(list(enumerate(merges)))}, [x[2] for x in merges]
        self.inner, self.last = [vocab[c] for c in letters], [vocab[c + self.end] for c in letters]
        #: Pairs of bytes that some token holds inside itself, and at its end where that is a word's end.
        self.joined, self.joined_last = self._pairs(vocab)
        pattern = steps[1][0]["pattern"]["Regex"]
        for name, own in ((r"[\p{L}]", f"[{_letters('L')}]"), (r"\p{L}", _letters("L")), (r"\p{N}", _letters("N")), (r"\s", _SPACES)):
            pattern = pattern.replace(name, own)
        self.piece = re.compile(pattern)
        self.special = {t["content"]: t["id"] for t in special}
        self.at_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if special else None
        self.of_text = _Memo(lambda piece: self.encode_piece(piece.encode("utf-8")))
        self.of_letters = _Memo(lambda piece: self.encode_piece(bytes(self.byte[c] for c in piece)))
        self.of_fragment, self.of_last_fragment = _Memo(self.of_inner, 4), _Memo(self.of_last, 4)

    def _pairs(self, vocab: dict[str, int]) -> tuple[bytearray, bytearray]:
        inside, at_end = bytearray(1 << 16), bytearray(1 << 16)
        for token in vocab:
            ends = bool(self.end) and token.endswith(self.end)
            own = [self.byte[c] for c in (token[: -len(self.end)] if ends else token)]
            stop = len(own) - 1
            for k in range(stop):
                (at_end if ends and k == stop - 1 else inside)[own[k] << 8 | own[k + 1]] = 1
        return inside, at_end if self.end else inside

    def cuts(self, data: bytes) -> list[int]:
        """Places in a piece between bytes that no token joins."""
        if len(data) > LONG:
            own = np.frombuffer(data, dtype=np.uint8).astype(np.int64)
            free = np.frombuffer(self.joined, dtype=bool)[own[:-1] << 8 | own[1:]] ^ True
            out = (np.flatnonzero(free[:-1]) + 1).tolist()
        else:
            joined = self.joined
            out = [k for k, (a, b) in enumerate(zip(data[:-2], data[1:]), 1) if not joined[a << 8 | b]]
        if len(data) > 1 and not self.joined_last[data[-2] << 8 | data[-1]]:
            out.append(len(data) - 1)
        return out

    def encode_piece(self, data: bytes) -> list[int]:
        """Ids of one piece, fragment by fragment; fragments inside a piece are remembered like pieces."""
        cuts = self.cuts(data)
        if not cuts:
            return self.of_last(data)
        out, start = [], 0
        for stop in cuts:
            out += self.of_fragment[data[start:stop]]
            start = stop
        return out + self.of_last_fragment[data[start:]]

    def of_inner(self, data: bytes) -> list[int]:
        """Ids of a fragment that does not end its piece."""
        inner = self.inner
        return self.merge([inner[b] for b in data])

    def of_last(self, data: bytes) -> list[int]:
        """Ids of a fragment that ends its piece."""
        inner = self.inner
        ids = [inner[b] for b in data]
        ids[-1] = self.last[data[-1]]
        return self.merge(ids)

    def merge(self, ids: list[int]) -> list[int]:
        """Merge the pair of the least rank, the leftmost of equal ones, until no pair can be merged."""
        if len(ids) > LONG:
            return self._merge_long(ids)
        none, rank = len(self.made), self.rank.get
        ranks = [rank(a << 32 | b, none) for a, b in zip(ids, ids[1:])]
        while ranks and (best := min(ranks)) < none:
            at = ranks.index(best)
            ids[at] = own = self.made[best]
            del ids[at + 1], ranks[at]
            if at:
                ranks[at - 1] = rank(ids[at - 1] << 32 | own, none)
            if at < len(ranks):
                ranks[at] = rank(own << 32 | ids[at + 1], none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a queue of pairs by rank and place, in n log n steps."""
        n, rank = len(ids), self.rank
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(rank[pair], k, pair) for k, pair in enumerate(a << 32 | b for a, b in zip(ids, ids[1:])) if pair in rank]
        heapq.heapify(queue)
        while queue:
            best, at, pair = heapq.heappop(queue)
            other = after[at]
            if other >= n or ids[at] < 0 or ids[at] << 32 | ids[other] != pair:
                continue  # one of the two was merged meanwhile
            ids[at], ids[other] = self.made[best], -1
            after[at] = after[other]
            if after[at] < n:
                before[after[at]] = at
            for first in (before[at], at):
                if first >= 0 and after[first] < n and (pair := ids[first] << 32 | ids[after[first]]) in rank:
                    heapq.heappush(queue, (rank[pair], first, pair))
        return [x for x in ids if x >= 0]

    @functools.cached_property
    def library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.file)

    def _slices(self, text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > SLICE:
            cut = text.find(" ", at + SLICE)
            if cut < 0:
                break
            yield text[at:cut]
            at = cut
        yield text[at:] if at else text

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text; the strings of special tokens in it are those tokens."""
        parts = []
        for part in self.at_special.split(text) if self.at_special else [text]:
            if part in self.special:
                parts.append([self.special[part]])
                continue
            for own in self._slices(part):
                if _OTHER.search(own):
                    pieces = (x for x, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(own)))
                    ids = map(self.of_letters.__getitem__, pieces)
                else:
                    ids = map(self.of_text.__getitem__, self.piece.findall(own.lower()))
                parts.append(np.fromiter(chain.from_iterable(ids), dtype=np.int32))
        return np.concatenate([np.asarray(x, dtype=np.int32) for x in parts]) if len(parts) > 1 else np.asarray(parts[0], dtype=np.int32)


@functools.cache
def _bpe(tokenizer_file: str) -> Bpe:
    return Bpe(tokenizer_file)


def _file(tokenizer_file: str | None) -> str:
    if tokenizer_file is None:
        import public_tokenizers

        tokenizer_file = public_tokenizers.path("word_bpe_49k.json")
    return tokenizer_file


def encode_texts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", tokenizer_file: str | None = None) -> DataFrame:
    """The id column and `ids`, the token ids of every whole text, as array<int>.

    No special tokens are added; their strings in a text become their ids, as in the tokenizers library. Null and empty
    texts have an empty array. Repeated rows stay, equal texts get equal ids, null ids pass through, other columns are
    ignored, an empty table gives no rows. A task holds one text and its ids beside the remembered pieces.
    """
    path = _file(tokenizer_file)
    schema = T.StructType([T.StructField(id_column, docs.schema[id_column].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(path)
        for batch in batches:
            for part in by_bytes(batch, 1):
                ids, at, held = [], 0, 0
                for k, text in enumerate(part.column(1), 1):
                    ids.append(bpe.encode(text.as_py()))
                    held += len(ids[-1])
                    if held > OUT or k == part.num_rows:
                        offsets = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                        yield pa.RecordBatch.from_arrays([part.column(0).slice(at, k - at), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))], names=[id_column, "ids"])
                        ids, at, held = [], k, 0

    return docs.select(docs[id_column], text_of(text_column).alias("text")).mapInArrow(task, schema)


def decode_ids(encoded: DataFrame, ids_column: str = "ids", tokenizer_file: str | None = None) -> DataFrame:
    """All columns of `encoded`, and `decoded` (which replaces a column of that name): tokens of the ids joined by spaces.

    Special tokens stay in the text. Ids that the vocabulary does not have, and null ids, are left out; a null array
    counts as empty, and an empty one gives an empty text.
    """
    path = _file(tokenizer_file)
    kept = [c for c in encoded.columns if c != "decoded"]
    rows = encoded.select(*(F.col(f"`{c}`") for c in kept), F.coalesce(F.col(f"`{ids_column}`"), F.array()).cast("array<int>").alias("decoded"))
    schema = T.StructType([encoded.schema[c] for c in kept] + [T.StructField("decoded", T.StringType())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = pa.array([*_bpe(path).tokens, None])
        unknown = len(tokens) - 1
        for batch in batches:
            lists = batch.column(len(kept))
            ids = lists.flatten()
            known = pc.fill_null(pc.and_(pc.greater_equal(ids, 0), pc.less(ids, unknown)), False)
            words = tokens.take(pc.if_else(known, ids, unknown))
            offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            if words.null_count:
                there = words.is_valid().to_numpy(zero_copy_only=False)
                offsets, words = np.concatenate(([0], np.cumsum(there)))[offsets], words.drop_null()
            words = words.cast(pa.large_string())
            text = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(offsets, type=pa.int64()), words), pa.scalar(" ", pa.large_string()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], text.cast(pa.string())], names=schema.names)

    return rows.mapInArrow(task, schema)


def op11_bpe(spark, sf_dir):
    decoded = decode_ids(encode_texts(read(spark, sf_dir, "documents")))
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256")
    )


QUERIES = {"op11_bpe": op11_bpe}
ORACLES: dict[str, str] = {}
