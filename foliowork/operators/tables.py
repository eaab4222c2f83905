"""Tables: CSV documents as cells, cells as Markdown, integrity, modal width, and the stitching of strips."""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliowork.functions.text import col

#: A field, quoted parts included, and what ends it; a quoted part.
FIELD = re.compile(r"((?:\"(?:[^\"]++|\"\")*+\"?|[^\",\r\n]++)*+)(,|\r\n|\n|\r|\Z)")
QUOTED = re.compile(r"\"((?:[^\"]++|\"\")*+)\"?")
BREAKS = re.compile(r"\r\n|\n|\r")
OVERLAP = 4
#: Cells that a task gathers before it gives them on.
CELLS_AT_ONCE = 100_000


def _records(text: str) -> Iterator[list[str]]:
    """The records of a CSV document; one of a single empty field is skipped."""
    if '"' not in text:
        yield from (line.split(",") for line in BREAKS.split(text) if line)
        return
    own = []
    for match in FIELD.finditer(text):
        field, end = match.groups()
        own.append(QUOTED.sub(r"\1", field).replace('""', '"') if '"' in field else field)
        if end != ",":
            if own != [""]:
                yield own
            own = []


def csv_cells(df: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, row, col, value) of CSV documents, counted from 0: quotes, doubled quotes, breaks inside quotes.

    Only commas divide; LF, CR LF and CR end a record; a record of one empty field is skipped; rows may differ in width. Each
    document is taken apart where it lies.
    """
    kind = df.schema[id_column].dataType

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, rows, widths, values = [], [], [], []

            def cells() -> pa.RecordBatch:
                n = np.array(widths, dtype=np.int64)
                place = np.repeat(np.arange(len(n)), n)
                col = (np.arange(len(place)) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)
                ids = batch.column(0).take(pa.array(np.array(docs, dtype=np.int64)[place]))
                return pa.RecordBatch.from_arrays([ids, pa.array(np.array(rows, dtype=np.int32)[place]), pa.array(col), pa.array(values, pa.string())], ["doc_id", "row", "col", "value"])

            for k, x in enumerate(batch.column(1).to_pylist()):
                for row, record in enumerate(_records(x)):
                    docs.append(k)
                    rows.append(row)
                    widths.append(len(record))
                    values += record
                    if len(values) >= CELLS_AT_ONCE:
                        yield cells()
                        for gathered in (docs, rows, widths, values):
                            gathered.clear()
            if values:
                yield cells()

    fields = [T.StructField("doc_id", kind), *(T.StructField(c, T.IntegerType()) for c in ("row", "col")), T.StructField("value", T.StringType())]
    return df.select(F.col(id_column).alias("doc_id"), col(text).alias("text")).mapInArrow(cut, T.StructType(fields))


def csv_markdown(text: Column | str) -> Column:
    """A CSV document as a Markdown table, as `cells_to_markdown` draws its cells; empty without a cell. Nothing is shuffled."""

    def drawn(x: str) -> str:
        rows = [[BREAKS.sub(" ", v).replace("|", "\\|") for v in r] for r in _records(x)]
        if not rows:
            return ""
        width = max(map(len, rows))
        rows[1:1] = [["---"] * width]
        return "".join("| " + " | ".join(r + [""] * (width - len(r))) + " |\n" for r in rows)

    @F.pandas_udf("string")
    def tables(texts: pd.Series) -> pd.Series:
        return texts.map(drawn)

    return tables(col(text))


def cells_to_markdown(cells: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keys, markdown): the first row is the header; rows are padded to the widest; bars and breaks in cells are escaped."""
    value = F.replace(F.regexp_replace(col("value"), r"\r\n|\n|\r", " "), F.lit("|"), F.lit("\\|"))
    rows = cells.groupBy(*keys, "row").agg(F.transform(F.array_sort(F.collect_list(F.struct("col", value.alias("v")))), lambda c: c["v"]).alias("cells"))
    tables = rows.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "cells"))), lambda r: r["cells"]).alias("rows"), F.max(F.size("cells")).alias("width"))

    def line(r):
        padded = F.concat(r, F.array_repeat(F.lit(""), F.col("width") - F.size(r)))
        return F.concat(F.lit("| "), F.array_join(padded, " | "), F.lit(" |"))

    drawn = F.transform("rows", line)
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), F.col("width")), " | "), F.lit(" |"))
    return tables.select(*keys, F.concat(F.array_join(F.concat(F.slice(drawn, 1, 1), F.array(rule), F.slice(drawn, F.lit(2), F.greatest(F.size(drawn) - 1, F.lit(0)))), "\n"), F.lit("\n")).alias("markdown"))


def table_integrity(cells: DataFrame, tables: DataFrame | None = None, keys: tuple[str, ...] = ("doc_id", "table_id")) -> DataFrame:
    """(keys, finding, row): rows whose width is not the first row's, tables without rows, and tables without content.

    Only `tables` (keys) can name those without rows, which are without content as well. A cell of spaces alone, of any width, is no content.
    """
    widths = cells.groupBy(*keys, "row").agg(F.count("*").alias("width"), F.max(F.regexp_like(col("value"), F.lit(r"[^\p{Zs}]")).cast("int")).alias("filled"))
    kinds = {f.name: f.dataType for f in widths.schema.fields}
    if tables is not None:
        # A row without a number comes after a table's own, so that cells are made and shuffled once.
        widths = widths.unionByName(tables.select(*keys, *(F.lit(None).cast(kinds[c]).alias(c) for c in ("row", "width")), F.lit(0).alias("filled")))
    ordered = Window.partitionBy(*keys).orderBy(F.col("row").asc_nulls_last())
    first = F.first("width").over(ordered)
    # The first row of a table also says whether the table has content, so its rows are shuffled and sorted once.
    filled = F.when(F.row_number().over(ordered) == 1, F.max("filled").over(Window.partitionBy(*keys)))
    found = lambda finding, row: F.struct(F.lit(finding).alias("finding"), row.cast(kinds["row"]).alias("row"))
    uneven = F.when(F.col("width") != F.col("first"), found("uneven row", F.col("row")))
    empty = F.when(F.col("any").isNotNull() & F.col("row").isNull(), found("no rows", F.lit(None)))
    blank = F.when(F.col("any") == 0, found("no content", F.lit(None)))
    return widths.withColumns({"first": first, "any": filled}).select(*keys, F.inline(F.array_compact(F.array(uneven, empty, blank))))


def modal_width(rows: DataFrame, keys: tuple[str, ...] = ("doc_id", "table_id")) -> DataFrame:
    """(keys, width): the most frequent row width, the smallest on a tie. `rows` has the keys and width."""
    counted = rows.groupBy(*keys, "width").agg(F.count("*").alias("n"))
    return counted.groupBy(*keys).agg(F.max(F.struct("n", (-F.col("width")).alias("w")))["w"].alias("w")).select(*keys, (-F.col("w")).alias("width"))


def _overlaps(x: list[str], y: list[str]) -> bool:
    """Whether row y reads the same line of a page as row x: equal, or one key and no cell that says otherwise.

    Cells are in lower case and have no white space at their ends.
    """
    if x == y:
        return True
    if not x or not y or not x[0] or x[0] != y[0]:
        return False
    longest = max(len(x), len(y))
    pairs = zip(x[1:] + [""] * (longest - len(x)), y[1:] + [""] * (longest - len(y)), strict=True)
    return all(not p or not q or p in q or q in p for p, q in pairs)


def _stitched(strips: list[list[list[str | None]]]) -> list[list[str]]:
    """The rows of a table's strips in order."""
    out: list[list[str]] = []
    plain: list[list[str]] = []
    for rows in strips:
        own = [["" if c is None else c for c in r] for r in rows]
        read = [[c.strip().lower() for c in r] for r in own]
        skip = next((k for k in range(min(len(out), len(own), OVERLAP), 0, -1) if all(map(_overlaps, plain[-k:], read[:k]))), 0)
        out += own[skip:]
        plain = (plain + read[skip:])[-OVERLAP:]
    counts = Counter(map(len, out))
    width = min(counts, key=lambda w: (-counts[w], w), default=0)
    return [r + [""] * (width - len(r)) for r in out if len(r) <= width]


def stitch(strips: DataFrame, key: str = "table_id") -> DataFrame:
    """(key, row, cells): the strips of a table (key, strip, rows) put together.

    Up to four first rows of a strip that repeat the rows before go; all rows are padded to the modal width, and wider
    ones, which come from the edges of strips, are dropped. A table is one row of the aggregate, held by one task.
    """

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, own in enumerate(batch.column(1)):
                grid = _stitched(own.as_py())
                keys = batch.column(0).take(pa.array(np.full(len(grid), k)))
                yield pa.RecordBatch.from_arrays([keys, pa.array(range(len(grid)), pa.int64()), pa.array(grid, pa.list_(pa.string()))], [key, "row", "cells"])

    ordered = F.transform(F.array_sort(F.collect_list(F.struct("strip", "rows"))), lambda s: s["rows"])
    schema = T.StructType([strips.schema[key], T.StructField("row", T.LongType()), T.StructField("cells", T.ArrayType(T.StringType()))])
    return strips.groupBy(key).agg(ordered.alias("strips")).mapInArrow(tables, schema)


#: A word of a second text of 200 words and more that fills more than a hundredth of it starts no match (a fixed value).
POPULAR_FROM, POPULAR = 200, 100
#: Pairs of equal words up to which diagonals are laid out at once.
PAIRS_AT_ONCE = 1 << 23


def _diagonals(a: np.ndarray, b: np.ndarray, rare: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Maximal stretches of equal rare words: starts in both texts and lengths. None where the equal pairs are too many."""
    order = np.argsort(b, kind="stable")
    order = order[rare[b[order]]]
    low, high = (np.searchsorted(b[order], a, side) for side in ("left", "right"))
    n = high - low
    if n.sum() > PAIRS_AT_ONCE:
        return None
    i = np.repeat(np.arange(len(a)), n)
    j = order[np.repeat(low - np.cumsum(n) + n, n) + np.arange(len(i))]
    by = np.lexsort((i, j - i))
    i, j = i[by], j[by]
    head = np.flatnonzero(np.concatenate(([True], (np.diff(j - i) != 0) | (np.diff(i) != 1)))) if len(i) else np.zeros(0, dtype=np.int64)
    return i[head], j[head], np.diff(np.append(head, len(i)))


def _longest_by_rows(a: np.ndarray, b: np.ndarray, rare: np.ndarray, alo: int, ahi: int, blo: int, bhi: int) -> tuple[int, int, int]:
    """The longest stretch of equal rare words in a part of both texts, a row of the comparison at a time."""
    own, best = b[blo:bhi], (0, alo, blo)
    before = np.zeros(len(own) + 1, dtype=np.int64)
    for i in range(alo, ahi):
        now = np.zeros_like(before)
        if rare[a[i]]:
            now[1:] = np.where(own == a[i], before[:-1] + 1, 0)
            k = int(now.argmax())
            if now[k] > best[0]:
                best = int(now[k]), i - int(now[k]) + 1, blo + k - int(now[k])
        before = now
    return best


def matched_words(x: list[str], y: list[str]) -> int:
    """Words in matching blocks of two texts: the longest common stretch, and so on to its left and to its right.

    Of equally long stretches the first of `x` and then of `y` counts. Popular words of `y` start no stretch, but go on with one.
    """
    if not x or not y:
        return 0
    _, words = np.unique(np.array([*x, *y], dtype=object), return_inverse=True)
    a, b = words[: len(x)], words[len(x) :]
    counts = np.bincount(b, minlength=int(words.max()) + 1)
    rare = counts <= len(y) // POPULAR + 1 if len(y) >= POPULAR_FROM else np.ones(len(counts), dtype=bool)
    found, total, parts = _diagonals(a, b, rare), 0, [(0, len(x), 0, len(y), None)]
    while parts:
        alo, ahi, blo, bhi, own = parts.pop()
        if found is None:
            size, i, j = _longest_by_rows(a, b, rare, alo, ahi, blo, bhi)
        else:
            first, second, length = found if own is None else (f[own] for f in found)
            skip = np.maximum(np.maximum(alo - first, blo - second), 0)
            left = np.minimum(np.minimum(length, ahi - first), bhi - second) - skip
            inside = np.flatnonzero(left > 0)
            own = inside if own is None else own[inside]
            size, i, j = 0, alo, blo  # without a stretch, popular words may still be equal from the start of both on
            if len(inside):
                first, second, left = (first + skip)[inside], (second + skip)[inside], left[inside]
                k = np.lexsort((second, first, -left))[0]
                size, i, j = int(left[k]), int(first[k]), int(second[k])
        end_i, end_j = i + size, j + size
        while i > alo and j > blo and a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
        while end_i < ahi and end_j < bhi and a[end_i] == b[end_j]:
            end_i, end_j = end_i + 1, end_j + 1
        if end_i == i:
            continue
        total += end_i - i
        if i > alo and j > blo:
            parts.append((alo, i, blo, j, own))
        if end_i < ahi and end_j < bhi:
            parts.append((end_i, ahi, end_j, bhi, own))
    return total


def sequence_ratio(pairs: DataFrame, reference: str = "reference", text: str = "text") -> DataFrame:
    """The frame with `sim`: how alike two texts are as sequences of words: twice the words in matching blocks over all words.

    Two texts without words are alike; the result has four digits. Rows are compared where they lie; equal pairs of words are laid
    out as diagonals, and beyond PAIRS_AT_ONCE of them the comparison goes row by row in the memory of one text.
    """

    @F.pandas_udf("double")
    def ratio(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in batches:
            out = []
            for x, y in zip(a, b, strict=True):
                x, y = x.split(), y.split()
                out.append(round(2.0 * matched_words(x, y) / (len(x) + len(y)), 4) if x or y else 1.0)
            yield pd.Series(out, dtype="float64")

    return pairs.withColumn("sim", ratio(col(reference), col(text)))


def _text_distances(a: list[str], b: list[str]) -> np.ndarray:
    """Normalised edit distances of all texts of one list to all of the other, a whole column of pairs at a time."""
    out = np.zeros((len(a), len(b)))
    sizes = np.array([len(y) for y in b])
    wide = int(sizes.max(initial=0))
    letters = np.zeros((len(b), wide), dtype=np.int64)
    for k, y in enumerate(b):
        letters[k, : len(y)] = [ord(c) for c in y]
    step, rows = np.arange(wide + 1), np.arange(len(b))
    for i, x in enumerate(a):
        line = np.tile(step, (len(b), 1))
        for n, c in enumerate(x, 1):
            best = np.minimum(line[:, 1:] + 1, line[:, :-1] + (letters != ord(c)))
            line = _cheapest(np.concatenate((np.full((len(b), 1), n), best), axis=1))
        longest = np.maximum(sizes, len(x))
        out[i] = line[rows, sizes] / np.where(longest > 0, longest, 1)
    return out


def _cheapest(cost: np.ndarray) -> np.ndarray:
    """Costs at each place when every step to the right costs one more: a running minimum."""
    step = np.arange(cost.shape[-1])
    return np.minimum.accumulate(cost - step, axis=-1) + step


def tree_similarity(truth: list, other: list, structural: bool = False) -> float:
    """One minus the edit distance of two tables' trees over the larger number of nodes.

    Renaming costs 1 where kind or spans differ, else the normalised edit distance of the texts, or nothing if only
    the structure counts. A tree has three levels, so distances of its parts are known from the cells up: those of two rows
    are edit distances of their cells, all rows of the other table at a time; the tables' forests are then compared a node by
    all nodes of the other.
    """
    cells_a, cells_b = ([c for row in t for c in row] for t in (truth, other))
    nodes = max(len(truth) + len(cells_a), len(other) + len(cells_b)) + 1
    if not cells_a or not cells_b:  # rows alone are renamed for nothing
        return 1 - (abs(len(truth) - len(other)) + len(cells_a) + len(cells_b)) / nodes
    spans = [np.array([c[1:] for c in cells]) for cells in (cells_a, cells_b)]
    rename = (spans[0][:, None, :] != spans[1][None, :, :]).any(axis=2).astype(float)
    if not structural:
        (texts_a, at_a), (texts_b, at_b) = (np.unique(np.array([c[0] for c in cells], dtype=object), return_inverse=True) for cells in (cells_a, cells_b))
        rename = np.maximum(rename, _text_distances(list(texts_a), list(texts_b))[at_a][:, at_b])

    widths_a, widths_b = (np.array([len(r) for r in t]) for t in (truth, other))
    first_a, first_b = (np.cumsum(w) - w for w in (widths_a, widths_b))
    # Of each row of `truth` and all rows of `other`: the edit distance of their cells.
    wide = int(widths_b.max())
    place = np.minimum(first_b[:, None] + np.arange(wide), len(cells_b) - 1)
    rows = np.zeros((len(truth), len(other)))
    for i, (first, width) in enumerate(zip(first_a.tolist(), widths_a.tolist(), strict=True)):
        line = np.tile(np.arange(wide + 1.0), (len(other), 1))
        for n in range(width):
            best = np.minimum(line[:, 1:] + 1, line[:, :-1] + rename[first + n][place])
            line = _cheapest(np.concatenate((np.full((len(other), 1), n + 1.0), best), axis=1))
        rows[i] = line[np.arange(len(other)), widths_b]

    def post_order(widths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the nodes below the table: the row (from 0) of a row's node or -1 - cell, and the leftmost leaf."""
        kind, left, cell = [], [], 0
        for r, w in enumerate(widths.tolist()):
            left += [len(kind) + k for k in range(w)] + [len(kind)]
            kind += [-1 - (cell + k) for k in range(w)] + [r]
            cell += w
        return np.array(kind), np.array(left)

    (kind_a, left_a), (kind_b, left_b) = post_order(widths_a), post_order(widths_b)
    is_row_b, at_b = kind_b >= 0, np.where(kind_b >= 0, kind_b, -1 - kind_b)
    size_b = np.arange(len(kind_b)) - left_b + 1
    # The cheapest cell of each row for a cell of the other table; a row without cells has none.
    own_rows = np.where(widths_b > 0)[0]
    nearest_b = np.ones((len(cells_a), len(other)))
    nearest_b[:, own_rows] = np.minimum(np.minimum.reduceat(rename, first_b[own_rows], axis=1), 1.0)
    own_rows = np.where(widths_a > 0)[0]
    nearest_a = np.ones((len(truth), len(cells_b)))
    nearest_a[own_rows] = np.minimum(np.minimum.reduceat(rename, first_a[own_rows], axis=0), 1.0)
    forest = np.zeros((len(kind_a) + 1, len(kind_b) + 1))
    forest[0] = np.arange(len(kind_b) + 1)
    for x, (kind, left) in enumerate(zip(kind_a.tolist(), left_a.tolist(), strict=True)):
        if kind >= 0:
            subtree = np.where(is_row_b, rows[kind][np.where(is_row_b, at_b, 0)], (x - left) + nearest_a[kind][np.where(is_row_b, 0, at_b)])
        else:
            cell = -1 - kind
            subtree = np.where(is_row_b, size_b - 1 + nearest_b[cell][np.where(is_row_b, at_b, 0)], rename[cell][np.where(is_row_b, 0, at_b)])
        best = np.minimum(forest[x][1:] + 1, forest[left][left_b] + subtree)
        forest[x + 1] = _cheapest(np.concatenate(([x + 1.0], best)))
    return float(1 - forest[-1][-1] / nodes)


def table_similarity(pairs: DataFrame, most_nodes: int = 4000) -> DataFrame:
    """Pairs of tables with `structural`, `total` and `skipped`.

    `truth` and `other` are arrays of rows of struct(value, colspan, rowspan); a missing one scores 0, two missing ones 1.
    Nodes are counted by Spark, and pairs above `most_nodes` never reach the Arrow function.
    """
    nodes = lambda c: F.aggregate(F.col(c), F.lit(1), lambda acc, r: acc + 1 + F.size(r))
    sized = pairs.withColumn("skipped", F.greatest(F.coalesce(nodes("truth"), F.lit(0)), F.coalesce(nodes("other"), F.lit(0))) > most_nodes)

    @F.pandas_udf("structural double, total double")
    def score(truth: pd.Series, other: pd.Series) -> pd.DataFrame:
        def table(rows):
            return None if rows is None else [[(c.get("value") or "", c["colspan"], c["rowspan"]) for c in r] for r in json.loads(rows)]

        out = []
        for x, y in zip(map(table, truth), map(table, other), strict=True):
            same = 1.0 if x is None and y is None else 0.0
            out.append((same, same) if x is None or y is None else (tree_similarity(x, y, True), tree_similarity(x, y)))
        return pd.DataFrame(out, columns=["structural", "total"])

    small = F.when(~F.col("skipped"), F.to_json("truth")), F.when(~F.col("skipped"), F.to_json("other"))
    scored = sized.withColumn("_s", score(*small))
    return scored.withColumns({k: F.when(~F.col("skipped"), F.col(f"_s.{k}")) for k in ("structural", "total")}).drop("_s")
