"""A Merkle manifest of a dataset, computed by time-forward processing.

The rows of a group, in order, are the leaves of a tree; the roots of the groups' trees, in order, are the leaves of one
more. The nodes of a tree are labelled (level, place), so that children come before their parents. A node takes the digests
that lie ready for its label in a priority queue, and puts its own digest into the queue under its parent's label. The
reversed sweep goes through the labels from the root down: a node takes the proof suffix that lies ready for it, and sends
each child that suffix with the sibling's digest before it, until the suffixes reach the leaves.

The queue is external: time is cut into slices of LEVELS levels, in which messages stay inside blocks of 2 ** LEVELS nodes.
A block's queue is a heap of bounded size in a task; what goes from one slice to the next is a table, which Spark's shuffle
brings to its block and sorts by label. So a task holds one block, whatever the size of a tree, and the number of
jobs is the logarithm of the largest group to base 2 ** LEVELS.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliowork.llm.shared import broadcast_if_small, drop_folder, read, shared_folder, write_table

#: Levels of one slice of time.
LEVELS = 8


def leaf_digest(columns: list[Column]) -> Column:
    """The digest of a row: each value with its number of UTF-8 bytes and a colon before it, null as a hyphen."""
    parts = (c.cast("string") for c in columns)
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in parts)), 256)


def _digest(children: list[str]) -> str:
    return hashlib.sha256("".join(children).encode("ascii")).hexdigest()


def sweep_up(leaves: list[str], height: int) -> list[list[str]]:
    """The digests of all nodes over some leaves, level by level up to `height`, from a queue of messages by label."""
    levels: list[list[str]] = [[] for _ in range(height + 1)]
    queue = [((0, k), k, digest) for k, digest in enumerate(leaves)]  # label of the receiver, of the sender, message
    while queue:
        label = level, place = queue[0][0]
        messages = []
        while queue and queue[0][0] == label:
            messages.append(heapq.heappop(queue)[2])
        own = _digest(messages) if level else messages[0]
        levels[level].append(own)
        if level < height:
            heapq.heappush(queue, ((level + 1, place // 2), place, own))
    return levels


def sweep_down(levels: list[list[str]], suffix: list[str]) -> list[list[str]]:
    """The proof of each leaf, from the leaf on; `suffix` is that of the top node.

    An entry is the sibling's digest after L or R, the side on which it is, or empty for a node without a sibling.
    """
    queue, proofs = [((1 - len(levels), 0), None)], []  # labels are negative: the last one comes first
    while queue:
        (level, place), own = heapq.heappop(queue)
        if not level:
            proof = []
            while own is not None:
                proof.append(own[0])
                own = own[1]
            proofs.append(proof + suffix)
            continue
        below = levels[-level - 1]
        children = range(2 * -place, min(2 * -place + 2, len(below)))
        for child in children:
            other = child ^ 1
            entry = "" if other >= len(below) else ("L" if other < child else "R") + below[other]
            heapq.heappush(queue, ((level + 1, -child), (entry, own)))
    return proofs[::-1]


def _whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[int]]]:
    """Batches of whole blocks of rows that are equal in the first two columns, and where blocks begin, and end at last."""

    def cut(batch: pa.RecordBatch) -> np.ndarray:
        tree, block = (batch.column(k).to_numpy() for k in (0, 1))
        return np.flatnonzero(np.concatenate(([True], (tree[1:] != tree[:-1]) | (block[1:] != block[:-1]))))

    held = None
    for batch in batches:
        held = pa.concat_batches([held, batch]) if held is not None else batch
        if held.num_rows:
            starts = cut(held)
            if starts[-1]:
                yield held.slice(0, int(starts[-1])), starts.tolist()
            held = held.slice(int(starts[-1]))
    if held is not None and held.num_rows:
        yield held, [0, held.num_rows]


def _height(nodes: int, levels: int) -> int:
    """Levels of a slice over a tree of so many nodes: until one is left, or all of them."""
    return min(levels, max(nodes - 1, 0).bit_length())


def _up(levels: int):
    """(tree, block, pos, n, digest), sorted, to the block's top nodes as (tree, pos, n, digest) of the next slice."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, cuts in _whole_blocks(batches):
            tree, block, n = (batch.column(k).to_numpy() for k in (0, 1, 3))
            digest, starts = batch.column(4).to_pylist(), cuts[:-1]
            tops = [sweep_up(digest[a:b], _height(int(n[a]), levels))[-1][0] for a, b in zip(starts, cuts[1:], strict=True)]
            columns = [tree[starts], block[starts], (n[starts] + (1 << levels) - 1) >> levels, tops]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["tree", "pos", "n", "digest"])

    return task


def _down(names: list[str], levels: int):
    """(tree, block, pos, n, digest, suffix, carried ...), in which a block's message has no digest and comes first, to the block's nodes with their own suffixes."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, cuts in _whole_blocks(batches):
            n, digest, suffix, proofs = batch.column(3).to_numpy(), batch.column(4).to_pylist(), batch.column(5), []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                proofs += sweep_down(sweep_up(digest[a + 1 : b], _height(int(n[a + 1]), levels)), suffix[a].as_py())
            nodes = batch.filter(batch.column(4).is_valid())
            columns = [*nodes.columns[:5], pa.array(proofs, type=pa.list_(pa.string())), *nodes.columns[6:]]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return task


def _sweeps(nodes: DataFrame, carried: list[str], suffixes: DataFrame | None, folder: str) -> tuple[DataFrame, DataFrame]:
    """Both sweeps over trees of nodes (tree, pos, n, digest, carried ...).

    `suffixes`, a function of the roots (tree, digest), gives the suffix of each tree's root as (tree, suffix). Returns
    the nodes with their proofs as `suffix`, and the roots as a written table.
    """
    block = F.shiftright("pos", LEVELS).alias("block")
    slices, most = [nodes], nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        own = slices[-1].select("tree", block, "pos", "n", "digest").repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")
        slices.append(write_table(own.mapInArrow(_up(LEVELS), "tree long, pos long, n long, digest string"), f"{folder}/slice-{len(slices)}"))
        most = (most + (1 << LEVELS) - 1) >> LEVELS
    roots = write_table(slices[-1].select("tree", "digest"), f"{folder}/roots")
    down = suffixes(roots).select("tree", F.lit(0).cast("long").alias("pos"), "suffix")
    for k, level in reversed(list(enumerate(slices[:-1]))):
        own = carried if k == 0 else []
        none = [F.lit(None).cast(level.schema[c].dataType).alias(c) for c in own]
        message = down.select("tree", F.col("pos").alias("block"), F.lit(-1).cast("long").alias("pos"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("string").alias("digest"), "suffix", *none)
        rows = level.select("tree", block, "pos", "n", "digest", F.lit(None).cast("array<string>").alias("suffix"), *own)
        rows = rows.union(message).repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")
        down = rows.mapInArrow(_down(rows.columns, LEVELS), T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema]))
        if k:
            down = write_table(down.select("tree", "pos", "suffix"), f"{folder}/suffixes-{k}")
    if len(slices) == 1:  # every tree is one leaf
        down = nodes.join(down.drop("pos"), "tree")
    return down, roots


def _numbered(rows: DataFrame, order: list[str], groups: list[str], folder: str) -> tuple[DataFrame, DataFrame]:
    """The rows, sorted over all partitions and written, with `part` and `at`; and per group and part the count and the place of its first row."""
    keys = [F.col(c).asc_nulls_first() for c in order]
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id())
    table = write_table(dealt, f"{folder}-sorted").withColumn("part", F.shiftright("at", 33))
    counts = table.groupBy(*groups, "part").agg(F.count("*").alias("rows"), F.min("at").alias("least"))
    parts = Window.partitionBy(*groups).orderBy("part")  # at most one row for each partition
    before = F.sum("rows").over(parts.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("rows")
    return table, write_table(counts.withColumn("before", before), f"{folder}-counts")


def merkle_proofs(leaves: DataFrame, group_column: str, id_column: str, leaf_column: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Root, subroot and proof of every leaf.

    Leaves of a group ascend by id (null first), and those of one id by digest. Nodes are joined in twos, a last one alone
    is digested alone, until one is left: the group's subroot, which for a lone leaf is that leaf. The subroots, null group
    first and then by the bytes of the group's name, are joined likewise to the root. `leaf_column` is lowercase hex and never
    null. Returns the id, the leaf, the columns in `keep`, subroot, root and `proof`, the siblings from the leaf to the root: each
    a digest with L or R before it, the side on which the sibling is, or an empty string where there is none. Repeated
    rows are leaves of their own, next to each other; an empty table gives no rows. Column names do not clash.
    """
    spark = leaves.sparkSession
    folder = shared_folder(spark, "merkle")
    kept = [f"keep{k}" for k in range(len(keep))]
    own = [F.col(f"`{c}`").alias(a) for c, a in zip((group_column, id_column, leaf_column, *keep), ("group", "id", "digest", *kept), strict=True)]
    rows = write_table(leaves.select(*own), f"{folder}/leaves").withColumn("group", F.col("group").cast("string"))
    table, counts = _numbered(rows, ["group", "id", "digest"], ["group"], f"{folder}/leaf")
    drop_folder(spark, f"{folder}/leaves")

    # Groups are numbered in order: their trees are known by these numbers, and they are places in the upper tree.
    names, name_counts = _numbered(counts.groupBy("group").agg(F.sum("rows").alias("n")).withColumn("all", F.lit(0)), ["group"], ["all"], f"{folder}/group")
    offsets = broadcast_if_small(name_counts.select("part", (F.col("before") - F.col("least")).alias("shift")), f"{folder}/group-counts")
    trees = write_table(names.join(offsets, "part").select("group", "n", (F.col("at") + F.col("shift")).alias("tree")), f"{folder}/trees")
    few = broadcast_if_small(trees, f"{folder}/trees").withColumnRenamed("group", "of")
    shifts = counts.join(few, F.col("group").eqNullSafe(F.col("of"))).select("tree", "n", "group", "part", (F.col("before") - F.col("least")).alias("shift"))
    shifts = write_table(shifts, f"{folder}/shifts")
    shift = broadcast_if_small(shifts, f"{folder}/shifts").withColumnsRenamed({"group": "of", "part": "of_part"})
    nodes = table.join(shift, (F.col("part") == F.col("of_part")) & F.col("group").eqNullSafe(F.col("of")))
    nodes = nodes.select("tree", (F.col("at") + F.col("shift")).alias("pos"), "n", "digest", "id", *kept)

    tops: list[DataFrame] = []

    def from_upper(subroots: DataFrame) -> DataFrame:
        n = trees.count()
        upper = subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(n).cast("long").alias("n"), "digest")
        top = lambda roots: roots.select("tree", F.array().cast("array<string>").alias("suffix"))
        below, root = _sweeps(upper, [], top, f"{folder}/upper")
        below = write_table(below.select(F.col("pos").alias("tree"), F.col("digest").alias("subroot"), "suffix"), f"{folder}/subroots")
        tops.extend((below, root))
        return below

    proofs, _ = _sweeps(nodes, ["id", *kept], from_upper, folder)
    subroots, root = tops
    root = (root.select("digest").first() or [None])[0]
    subroots = broadcast_if_small(subroots.select(F.col("tree").alias("of"), "subroot"), f"{folder}/subroots")
    result = proofs.join(subroots, F.col("tree") == F.col("of"))
    return result.select(
        F.col("id").alias(id_column), F.col("digest").alias(leaf_column), *(F.col(a).alias(c) for a, c in zip(kept, keep, strict=True)),
        "subroot", F.lit(root).cast("string").alias("root"), F.col("suffix").alias("proof"),
    )


def fold_proof(leaf: Column, proof: Column) -> Column:
    """The root that follows from a leaf and its proof."""

    def step(own: Column, entry: Column) -> Column:
        side, other = F.substring(entry, 1, 1), F.substring(entry, 2, 64)
        return F.sha2(F.when(side == "L", F.concat(other, own)).when(side == "R", F.concat(own, other)).otherwise(own), 256)

    return F.aggregate(proof, leaf, step)


def op12_merkle(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    own = lambda n_chars: leaf_digest([F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text")])
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    leaves = docs.select("doc_id", "lang", own(F.col("n_chars")).alias("leaf"), F.when(chosen, own(F.col("n_chars") + 1)).alias("tampered"))
    proofs = merkle_proofs(leaves, "lang", "doc_id", "leaf", keep=("tampered",))
    folded = proofs.withColumn("folded_root", fold_proof(F.coalesce("tampered", "leaf"), F.col("proof")))
    siblings = F.array_join(F.transform("proof", lambda x: F.substring(x, 2, 64)), "")
    return folded.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


OP12_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, lang, n_chars, text, CAST(doc_id AS VARCHAR) AS own FROM documents),
crc AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(own, ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) ELSE xor(c >> 1, 3988292384::BIGINT * (c & 1)) END), 4294967295::BIGINT) % 7 = 0 AS chosen FROM d),
enc AS (
  SELECT doc_id, lang, chosen,
    coalesce(strlen(own) || ':' || own, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    coalesce(length(CAST(n_chars AS VARCHAR)) || ':' || CAST(n_chars AS VARCHAR), '-') AS n0,
    coalesce(length(CAST(n_chars + 1 AS VARCHAR)) || ':' || CAST(n_chars + 1 AS VARCHAR), '-') AS n1,
    coalesce(strlen(text) || ':' || text, '-') AS tail FROM crc),
leaves AS (
  SELECT doc_id, lang, sha256(head || n0 || tail) AS leaf, sha256(head || CASE WHEN chosen THEN n1 ELSE n0 END || tail) AS shown FROM enc),
placed AS (
  SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves),
nodes AS (
  SELECT tree, 0 AS level, pos, leaf AS digest, count(*) OVER (PARTITION BY tree) AS n FROM placed
  UNION ALL
  SELECT tree, level + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), (max(n) + 1) // 2 FROM nodes WHERE n > 1 GROUP BY tree, level, pos // 2),
subroots AS (SELECT tree, level AS height, digest FROM nodes WHERE n = 1),
upper AS (
  SELECT 0 AS level, tree AS pos, digest, count(*) OVER () AS n FROM subroots
  UNION ALL
  SELECT level + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), (max(n) + 1) // 2 FROM upper WHERE n > 1 GROUP BY level, pos // 2),
top AS (SELECT level AS height, digest FROM upper WHERE n = 1),
steps AS (
  SELECT p.doc_id, p.leaf, s.level AS step, s.digest AS other, s.pos < (p.pos >> CAST(s.level AS INTEGER)) AS before
  FROM placed p JOIN nodes s ON s.tree = p.tree AND s.n > 1 AND s.pos = xor(p.pos >> CAST(s.level AS INTEGER), 1)
  UNION ALL
  SELECT p.doc_id, p.leaf, r.height + s.level, s.digest, s.pos < (p.tree >> CAST(s.level AS INTEGER))
  FROM placed p JOIN subroots r ON r.tree = p.tree JOIN upper s ON s.n > 1 AND s.pos = xor(p.tree >> CAST(s.level AS INTEGER), 1)),
proofs AS (SELECT doc_id, leaf, sha256(string_agg(other, '' ORDER BY step)) AS proof FROM steps GROUP BY doc_id, leaf),
fold AS (
  SELECT p.doc_id, p.leaf, 0 AS step, r.height + t.height AS height, p.shown AS digest FROM placed p JOIN subroots r ON r.tree = p.tree CROSS JOIN top t
  UNION ALL
  SELECT f.doc_id, f.leaf, f.step + 1, f.height, sha256(CASE WHEN s.before THEN s.other || f.digest WHEN NOT s.before THEN f.digest || s.other ELSE f.digest END)
  FROM fold f LEFT JOIN steps s ON s.doc_id = f.doc_id AND s.leaf = f.leaf AND s.step = f.step WHERE f.step < f.height)
SELECT p.doc_id, p.leaf, r.digest AS subroot, t.digest AS root, coalesce(q.proof, sha256('')) AS proof_sha256, f.digest AS folded_root, f.digest = t.digest AS verified
FROM placed p JOIN subroots r ON r.tree = p.tree CROSS JOIN top t JOIN fold f ON f.doc_id = p.doc_id AND f.leaf = p.leaf AND f.step = f.height
LEFT JOIN proofs q ON q.doc_id = p.doc_id AND q.leaf = p.leaf
"""

QUERIES = {"op12_merkle": op12_merkle}
ORACLES = {"op12_merkle": OP12_SQL}
