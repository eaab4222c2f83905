"""Periodic runs of words, found by catching squares online over dyadic blocks.

A run is a maximal stretch whose words repeat with a period; here only runs of at least four periods count. Words arrive
in order. For periods from b to 2b - 1, b a power of two, a catcher is set up over each completed pair of blocks of b words
and stays open for the next 2b - 1 starts: every appended word completes one suffix of 2b words, which is compared with the
open catchers by fingerprints made from those of half the length. The first suffix that equals a catcher's words, p
words later, makes a square of period p. A run of period q, b <= q < 2b, that is 4q long holds a whole pair of blocks and its
repetition q later, and by Fine and Wilf's theorem the pair repeats at no smaller distance, so no run is missed. Squares
are confirmed word by word and merged into runs, which grow as long as appended words go on with them.

Many appended words are worked on at once with arrays: texts of a batch are appended one after the other, with a word of its own
kind between, which nothing repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliowork.llm.quality import _texts
from foliowork.llm.shared import SPACE, read, text_of
from foliowork.llm.shingles import by_bytes, mixed

PERIODS, LEAST = 4, 6
#: Words that are appended at once.
APPEND = 1 << 18
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Fingerprints of stretches from those of their halves."""
    return mixed(left * _STEP + right)


class _Level:
    """Catchers over pairs of blocks of `block` words, for periods from `block` on."""

    def __init__(self, block: int):
        self.block = block
        self.low, self.prints = 0, np.zeros(0, dtype=np.uint64)  # the first place whose fingerprint is kept, and fingerprints
        self.caught = np.zeros(0, dtype=np.int64)  # catchers that are closed, as far as starts may still meet them

    @property
    def done(self) -> int:
        return self.low + len(self.prints)

    def matches(self, first: int) -> tuple[np.ndarray, np.ndarray]:
        """Open catchers and the starts from `first` on of equal suffixes, by catcher and then start."""
        b, low = self.block, self.low
        own = self.prints[first - low :]
        start = np.arange(first, self.done)
        nearest = (start - 1) // b * b
        pairs = []
        for catcher in (nearest, nearest - b):
            there = (catcher >= low) & (start - catcher < 2 * b)
            same = np.flatnonzero(there & (self.prints[np.maximum(catcher - low, 0)] == own))
            pairs.append((catcher[same], start[same]))
        catcher, start = (np.concatenate(x) for x in zip(*pairs, strict=True))
        if len(catcher):
            open_ = ~np.isin(catcher, self.caught)
            catcher, start = catcher[open_], start[open_]
            order = np.lexsort((start, catcher))
            catcher, start = catcher[order], start[order]
        return catcher, start


class RunFinder:
    """Takes numbers that stand for words, in as many calls as one likes, and keeps the runs found so far."""

    def __init__(self, longest: int | None = None, periods: int = PERIODS, least: int = LEAST):
        """`longest`: no run can be longer than that, so that wider blocks need no catchers."""
        if periods < PERIODS:
            raise ValueError(f"runs of fewer than {PERIODS} periods are not all caught")
        self.longest, self.periods, self.least = longest, periods, least
        self.words, self.n = np.zeros(1024, dtype=np.int64), 0
        self.levels: list[_Level] = []
        self.last: dict[int, list[int]] = {}  # period to [start, end] of its last run
        self.runs: list[tuple[int, int, int]] = []

    def append(self, words: np.ndarray) -> None:
        for at in range(0, len(words), APPEND):
            self._append(np.asarray(words[at : at + APPEND], dtype=np.int64))

    def _append(self, words: np.ndarray) -> None:
        old, self.n = self.n, self.n + len(words)
        if self.n > len(self.words):
            self.words = np.concatenate((self.words[:old], np.zeros(max(self.n, 2 * old) - old, dtype=np.int64)))
        self.words[old : self.n] = words
        for period, run in self.last.items():  # runs that reached the last word go on, or end for good
            if run[1] == old:
                run[1] += self._ahead(old - period, period)
        below_low, below = max(old - 2 * len(words), 0), None
        k = 0
        while True:
            block = 1 << k
            if 2 * block > self.n or (self.longest is not None and PERIODS * block > self.longest):
                break
            if k == len(self.levels):
                self.levels.append(_Level(block))
            level = self.levels[k]
            first = level.done
            stop = self.n - 2 * block + 1
            if below is None:  # fingerprints of single words
                below_low, below = first, mixed(self.words[first : self.n].view(np.uint64))
            left = below[first - below_low : stop - below_low]
            right = below[first + block - below_low : stop + block - below_low]
            level.prints = np.concatenate((level.prints, _joined(left, right)))
            self._catch(level, first)
            below_low, below = level.low, level.prints
            keep = max(level.low, level.done - 2 * block - 1)  # catchers still open, and halves of the next level's suffixes
            level.prints, level.low = level.prints[keep - level.low :], keep
            k += 1

    def _catch(self, level: _Level, first: int) -> None:
        catcher, start = level.matches(first)
        closed, squares = [level.caught], []
        while len(catcher):
            nearest = np.flatnonzero(np.concatenate(([True], catcher[1:] != catcher[:-1])))
            equal = self._equal(catcher[nearest], start[nearest], 2 * level.block)
            found = nearest[equal]
            closed.append(catcher[found])
            square = found[start[found] - catcher[found] >= level.block]
            squares += zip(catcher[square].tolist(), (start[square] - catcher[square]).tolist(), strict=True)
            left = np.ones(len(catcher), dtype=bool)
            left[nearest] = False
            left &= ~np.isin(catcher, catcher[found])
            catcher, start = catcher[left], start[left]
        for s, p in sorted(squares):
            self._merge(s, p, s + 2 * level.block + p)
        caught = np.concatenate(closed)
        level.caught = caught[caught >= level.done - 2 * level.block]

    def _equal(self, left: np.ndarray, right: np.ndarray, width: int) -> np.ndarray:
        """Whether stretches of `width` words are equal, word by word; their number times their width is held at most."""
        out = np.ones(len(left), dtype=bool)
        step = max(1, APPEND // width)
        for at in range(0, len(left), step):
            place = np.arange(width)
            a, b = left[at : at + step, None] + place, right[at : at + step, None] + place
            out[at : at + step] = (self.words[a] == self.words[b]).all(axis=1)
        return out

    def _ahead(self, at: int, period: int) -> int:
        """How many words from `at` on equal those `period` later."""
        n, width = 0, 64
        while at + n + period < self.n:
            stop = min(at + n + width, self.n - period)
            differ = np.flatnonzero(self.words[at + n : stop] != self.words[at + n + period : stop + period])
            if len(differ):
                return n + int(differ[0])
            n, width = stop - at, min(width * 4, APPEND)
        return n

    def _behind(self, at: int, period: int) -> int:
        """How many words before `at` equal those `period` later."""
        n, width = 0, 64
        while n < at:
            start = max(at - n - width, 0)
            differ = np.flatnonzero(self.words[start : at - n] != self.words[start + period : at - n + period])
            if len(differ):
                return at - start - 1 - int(differ[-1])
            n, width = at - start, min(width * 4, APPEND)
        return n

    def _merge(self, start: int, period: int, end: int) -> None:
        """A square joins the last run of its period, or begins another."""
        run = self.last.get(period)
        if run is not None and end <= run[1]:
            return
        if run is not None:
            self._keep(period, run)
        self.last[period] = [start - self._behind(start, period), end + self._ahead(end - period, period)]

    def _keep(self, period: int, run: list[int]) -> None:
        length = run[1] - run[0]
        if length >= max(self.least, self.periods * period):
            self.runs.append((run[0], length, period))

    def finish(self) -> list[tuple[int, int, int]]:
        """(start, length, period) of all runs, by start and period; nothing may be appended afterwards."""
        for period, run in self.last.items():
            self._keep(period, run)
        self.last = {}
        return sorted(self.runs, key=lambda run: (run[0], run[2]))


def runs_of(texts: list[list[bytes]], periods: int = PERIODS, least: int = LEAST) -> list[list[tuple[int, int, int]]]:
    """The runs of each text, a list of words."""
    longest = max(map(len, texts), default=0)
    finder = RunFinder(longest, periods, least)
    words = pa.array([w for own in texts for w in own], type=pa.binary())
    numbers = words.dictionary_encode().indices.to_numpy().astype(np.int64)
    starts, at = [], 0
    ends = np.cumsum([len(own) for own in texts])
    numbers = np.insert(numbers, ends, -1 - np.arange(len(texts)))  # a word of its own kind after each text
    starts = np.concatenate(([0], ends[:-1])) + np.arange(len(texts))
    finder.append(numbers)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for start, length, period in finder.finish():
        at = int(np.searchsorted(starts, start, side="right")) - 1
        out[at].append((start - int(starts[at]), length, period))
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds beyond its first period, joined by spaces."""
    if runs:
        change = np.zeros(len(words) + 1, dtype=np.int64)
        for start, length, period in runs:
            change[start + period] += 1
            change[start + length] -= 1
        words = [words[k] for k in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]
    return b" ".join(words)


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest length / period, exactly; of equal ones the first, and of these the one of the least period."""
    best = None
    for run in runs:  # by start, then period
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


_RUN = T.StructType([T.StructField(x, T.LongType()) for x in ("start", "length", "period")])


def periodic_runs(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", periods: int = PERIODS, least: int = LEAST) -> DataFrame:
    """All runs of at least `periods` periods (four or more) and `least` words in the words of every whole text.

    Returns, for every row, the id, `runs` (array of start, length, period; word numbers from 0; by start, then period),
    `strongest` (the run of the greatest length / period, null without runs; ties: first start, then least period) and
    `collapsed`, the text's words without the repetitions of any run, joined by spaces. A period is a run's smallest.
    Null and empty texts have no runs and collapse to an empty text. Repeated rows stay and get equal results, null ids
    pass through, other columns are ignored, an empty table gives no rows. A task holds one text, its list of words and
    some 200 bytes a word beside it, or about a megabyte of shorter texts.
    """
    kind = docs.schema[id_column].dataType
    schema = T.StructType([T.StructField(id_column, kind), T.StructField("runs", T.ArrayType(_RUN)), T.StructField("strongest", _RUN), T.StructField("collapsed", T.StringType())])
    run = pa.struct([(x, pa.int64()) for x in ("start", "length", "period")])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, 1):
                data, offsets = _texts(part.column(1))
                texts = [data[a:b].tobytes().split() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]  # splits at the six spaces
                runs = runs_of(texts, periods, least)
                best = [strongest(own) for own in runs]
                short = pa.array([collapsed(*x).decode("utf-8") for x in zip(texts, runs, strict=True)], type=pa.string())
                flat = pa.StructArray.from_arrays([pa.array([r[k] for own in runs for r in own], type=pa.int64()) for k in range(3)], fields=list(run))
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, runs)]), type=pa.int32()), flat)
                top = pa.array([r and dict(zip(("start", "length", "period"), r, strict=True)) for r in best], type=run)
                yield pa.RecordBatch.from_arrays([part.column(0), lists, top, short], names=schema.names)

    return docs.select(docs[id_column], text_of(text_column).alias("text")).mapInArrow(task, schema)


def _repeated(text: Column, number: Column) -> Column:
    """A text whose words from word a on are repetitions of its first p words from there, by a number of the document."""
    words = F.filter(F.split(text, f"{SPACE}+", -1), lambda w: w != "")

    def of(own: Column) -> Column:
        g, n = F.floor(number / 10), F.size(own)
        a = F.pmod(g, n)
        p = F.lit(1) + F.floor((n - a) / (g % 8 + 3))
        return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(own, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))), " ")

    return F.when(F.size(words) > 0, F.get(F.transform(F.array(words), of), 0)).otherwise(text)  # the words are split once


def op13_periodic_runs(spark, sf_dir):
    docs, text = read(spark, sf_dir, "documents"), text_of()
    number = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    planted = docs.select("doc_id", F.when(number % 10 == 0, _repeated(text, number)).otherwise(text).alias("text"))
    found = periodic_runs(planted)
    lines = F.transform("runs", lambda r: F.concat(r.start.cast("string"), F.lit(","), r.length.cast("string"), F.lit(","), r.period.cast("string"), F.lit("\n")))
    best = F.col("strongest")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best.start.alias("start"), best.length.alias("length"), best.period.alias("period"),
        F.floor(best.length * 1000 / best.period).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )


QUERIES = {"op13_periodic_runs": op13_periodic_runs}
ORACLES: dict[str, str] = {}
