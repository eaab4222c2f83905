"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Every source has a target in words. Blocks are seats: the house has as many as the targets ask for, a source's last, short
block counting by its real size. Seats go to the highest quotients of vote / (2 * seats + 1), to sources by the blocks that
they are due, and inside a source to shards, into which documents are dealt by a seeded hash, by their blocks. No party
takes more than twice its blocks. As sources and shards can be very many, both are apportioned in two steps, first to groups
of about FAN of them and then inside each group, so that no task ranks more than a few thousand small rows. In a shard
the documents lie end to end in seeded order; the quota is taken as whole passes over the shard plus evenly spread blocks
from a seeded start.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliowork.llm.shared import WORD, broadcast_if_small, read, shared_folder, text_of, write_table

WEIGHTS = (5, 2, 1)
BUDGET = 1.5
LIMIT = 2
BLOCK = 32
SHARD_ROWS = 128
SEED = "mix-1"
#: Sources or shards of one group, and the fixed point of votes: whole numbers add up alike in every order.
FAN, POINT = 1024, 1 << 16


def source_targets(sizes: DataFrame, folder: str, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, limit: float = LIMIT) -> DataFrame:
    """(place, source, source_size, rows, target): one row per source, from (source, size), written to `folder`.

    Sources by code point, null last, have the weights in turn and share `budget` times all words. A source stops at
    `limit` times its own; the excess goes to the others by weight until none is above. Each round of that is one aggregate.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    # Ids in sorted order have the partition above bit 33: with the rows of the partitions before, they are places.
    ordered = write_table(totals.orderBy(F.col("source").asc_nulls_last()).withColumn("at", F.monotonically_increasing_id()), f"{folder}/ordered")
    before, rows = {}, 0
    for part, n in sorted(map(tuple, ordered.groupBy(F.shiftright("at", 33).alias("part")).count().collect())):
        before[part], rows = rows, rows + n
    skipped = F.get(F.array(*(F.lit(before.get(k, 0)) for k in range(max(before, default=0) + 1))), F.shiftright("at", 33).cast("int"))
    place = (skipped + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).cast("long")
    weight = F.get(F.array(*(F.lit(float(w)) for w in weights)), F.pmod(place, F.lit(len(weights))).cast("int"))
    placed = ordered.select(place.alias("place"), "source", "source_size", "rows", weight.alias("weight"), (limit * F.col("source_size")).cast("double").alias("most"))
    placed = write_table(placed, f"{folder}/placed")
    free, share, level, stopped = 0.0, 1.0, -1.0, -1
    while True:
        stops = F.col("most") < level * F.col("weight")
        one = placed.agg(
            F.sum("source_size").alias("all"), F.sum(F.when(stops, F.col("most"))).alias("most"), F.sum(F.when(~stops, F.col("weight"))).alias("share"), F.count_if(stops).alias("stopped")
        ).first()
        if one["stopped"] == stopped or not one["share"]:
            break
        free, share, stopped = budget * one["all"] - (one["most"] or 0.0), one["share"], one["stopped"]
        level = free / share
    target = F.least("most", F.lit(free) * F.col("weight") / F.lit(share))
    return write_table(placed.select("place", "source", "source_size", "rows", target.alias("target")), f"{folder}/targets")


def sainte_lague(votes: np.ndarray, most: np.ndarray, house: int) -> np.ndarray:
    """Seats of each party: the `house` highest quotients of vote / (2 * seats + 1), no party above its `most`.

    A divisor by which almost all seats are given is found by halving; the last ones go to the highest quotients. Of equal quotients the earlier party's comes first. Parties without votes get none.
    """
    votes, most = votes.astype(np.float64), np.where(votes > 0, most, 0).astype(np.int64)
    if house >= most.sum():
        return most

    def at(divisor: float) -> np.ndarray:
        return np.minimum(most, np.floor(votes / divisor + 0.5)).astype(np.int64)

    low, high = 0.0, 2 * votes.max() + 1  # no seats at `high`
    for _ in range(100):
        middle = (low + high) / 2
        if middle in (low, high):
            break
        low, high = (low, middle) if at(middle).sum() <= house else (middle, high)
    seats = at(high)
    # What is left goes to parties whose next quotients are equal up to the last bit of the divisor, one seat each.
    quotient = np.where(seats < most, votes / (2 * seats + 1), -1.0)
    seats[np.argsort(-quotient, kind="stable")[: house - int(seats.sum())]] += 1
    return seats


def _apportion(nodes: DataFrame, group: str) -> DataFrame:
    """(group, node, vote, most, house) rows to (group, node, seats): each group's house among its nodes."""

    def share(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node")
        seats = sainte_lague(rows["vote"].to_numpy(), rows["most"].to_numpy(), int(rows["house"].iloc[0]))
        return pd.DataFrame({group: rows[group], "node": rows["node"], "seats": seats})

    return nodes.groupBy(group).applyInPandas(share, f"{group} long, node long, seats long")


def shard_seats(shards: DataFrame, targets: DataFrame, folder: str) -> DataFrame:
    """(place, shard, seats) from (place, shard, filled): the whole house to source groups, sources, shard groups and shards."""
    due = F.when(F.col("source_size") > 0, F.round(F.col("filled") * F.col("target") / F.col("source_size") * POINT)).otherwise(0).cast("long")
    sources = shards.groupBy("place").agg(F.sum("filled").alias("filled")).join(targets.select("place", "source_size", "target"), "place")
    groups = -(-targets.count() // FAN)
    sources = write_table(sources.select(F.pmod("place", F.lit(max(groups, 1))).alias("bucket"), F.col("place").alias("node"), due.alias("vote"), (LIMIT * F.col("filled")).alias("most")), f"{folder}/sources")
    buckets = sources.groupBy(F.col("bucket").alias("node")).agg(F.sum("vote").alias("vote"), F.sum("most").alias("most"))
    house = ((sources.agg(F.sum("vote")).first()[0] or 0) + POINT // 2) // POINT
    seats = _apportion(buckets.withColumns({"every": F.lit(0).cast("long"), "house": F.lit(house).cast("long")}), "every")
    seats = _apportion(sources.join(seats.select(F.col("node").alias("bucket"), F.col("seats").alias("house")), "bucket"), "bucket")
    seats = write_table(seats.select(F.col("node").alias("place"), F.col("seats").alias("house")), f"{folder}/source-seats")
    parts = shards.groupBy("place", F.floor(F.col("shard") / FAN).alias("node")).agg(F.sum("filled").alias("vote")).withColumn("most", LIMIT * F.col("vote"))
    seats = _apportion(parts.join(broadcast_if_small(seats, f"{folder}/source-seats"), "place"), "place")
    # One number for a group of shards: the place above, the group below bit 31.
    group = (F.shiftleft("place", 31) + F.floor(F.col("shard") / FAN)).alias("part")
    of_part = seats.select((F.shiftleft("place", 31) + F.col("node")).alias("part"), F.col("seats").alias("house"))
    nodes = shards.select(group, F.col("shard").alias("node"), F.col("filled").alias("vote"), (LIMIT * F.col("filled")).alias("most"))
    given = _apportion(nodes.join(of_part, "part"), "part")
    return given.select(F.shiftright("part", 31).alias("place"), F.col("node").alias("shard"), "seats")


def _chosen(b: Column, quota: Column, blocks: Column, start: Column) -> Column:
    """How many of the shard's blocks before block `b` are chosen: `quota` of `blocks`, evenly spread from `start`."""
    return F.floor((b + start) * quota / blocks) - F.floor(start * quota / blocks)


def _chosen_before(at: Column, quota: Column, blocks: Column, start: Column, block: int) -> Column:
    """Words of the shard before word `at` that lie in chosen blocks."""
    whole = F.floor(at / block)
    before = _chosen(whole, quota, blocks, start)
    return before * block + (at - whole * block) * (_chosen(whole + 1, quota, blocks, start) - before)


def mix_plan(docs: DataFrame, id_column: str = "doc_id", source_column: str = "source", text_column: str = "text", block: int = BLOCK, seed: str = SEED, carry: tuple[str, ...] = ()) -> DataFrame:
    """How many words of every document the mix takes.

    Returns the id, size (words of the text), source, source_size, target (the source's), taken, and where the taken
    words lie: first word in the shard, passes, quota, blocks, start; and the columns in `carry`, each with _ before it. Null texts have size
    0 and are taken 0 times; a null source is a source of its own, last in order; no document gives more than twice
    its words. Repeated rows stay apart, and equal ones get the same pair of values in either order. The same rows and
    seed give the same plan whatever the partitioning. An empty table gives no rows.
    """
    spark = docs.sparkSession
    folder = shared_folder(spark, "mix")
    carried = [docs[c].alias(f"_{c}") for c in carry]
    rows = docs.select(docs[id_column].alias("id"), docs[source_column].cast("string").alias("source"), F.regexp_count(text_of(text_column), F.lit(WORD)).cast("long").alias("size"), F.xxhash64(text_of(text_column)).alias("own"), *carried)
    sizes = write_table(rows.select("id", "source", "size", "own"), f"{folder}/sizes")
    targets = broadcast_if_small(source_targets(sizes.select("source", "size"), folder), f"{folder}/targets")

    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("null"))))
    number = F.conv(F.substring("digest", 1, 8), 16, 10).cast("long").bitwiseXOR(F.col("own"))  # rows of one id or of none are spread as well

    def deal(own: DataFrame) -> DataFrame:
        return (
            own.withColumn("digest", digest)
            .join(targets.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")), "left")
            .drop("of")
            .withColumn("shard", F.pmod(number, F.ceil(F.col("rows") / SHARD_ROWS)))
        )

    filled = F.ceil(F.sum("size") / block).alias("filled")
    shards = write_table(deal(sizes).groupBy("place", "shard").agg(filled), f"{folder}/filled")
    due = shards.join(shard_seats(shards, targets, folder), ["place", "shard"])
    due = due.select(F.col("place").alias("of"), F.col("shard").alias("of_shard"), F.greatest("filled", F.lit(1)).alias("blocks"), "seats")
    shards = broadcast_if_small(write_table(due, f"{folder}/shards"), f"{folder}/shards")
    dealt = deal(rows if carry else sizes).join(shards, (F.col("place") == F.col("of")) & (F.col("shard") == F.col("of_shard")), "left").drop("of", "of_shard")
    shard = Window.partitionBy("place", "shard")
    order = shard.orderBy("digest", "id", "size", "own").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("source"), F.col("shard"))), 1, 8), 16, 10).cast("long")
    planned = (
        dealt.withColumn("first", F.sum("size").over(order) - F.col("size"))
        .withColumn("passes", F.floor(F.col("seats") / F.col("blocks")))
        .withColumn("quota", F.col("seats") - F.col("passes") * F.col("blocks"))
        .withColumn("start", F.pmod(start, F.col("blocks")))
    )
    args = (F.col("quota"), F.col("blocks"), F.col("start"), block)
    partly = _chosen_before(F.col("first") + F.col("size"), *args) - _chosen_before(F.col("first"), *args)
    return planned.select(
        F.col("id").alias(id_column), "size", F.col("source").alias(source_column), "source_size", "target",
        (F.col("passes") * F.col("size") + partly).cast("long").alias("taken"), "first", "passes", "quota", "blocks", "start",
        *(F.col(f"_{c}") for c in carry),
    )


def mix(docs: DataFrame, id_column: str = "doc_id", source_column: str = "source", text_column: str = "text", block: int = BLOCK, seed: str = SEED) -> DataFrame:
    """The mixed corpus: the columns of `docs`, each text replaced by the words taken from it.

    A document is repeated as often as the plan passes over it, with a line break between, and then come its words in
    chosen blocks, joined by spaces. Documents of which nothing is taken are left out. Edge cases as in mix_plan().
    """
    plan = mix_plan(docs, id_column, source_column, text_column, block, seed, carry=tuple(docs.columns))
    text = text_of(f"_{text_column}")
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    first, end = F.col("first"), F.col("first") + F.col("size")
    args = (F.col("quota"), F.col("blocks"), F.col("start"))
    own_blocks = F.sequence(F.floor(first / block), F.floor((end - 1) / block))
    picked = F.filter(own_blocks, lambda b: _chosen(b + 1, *args) > _chosen(b, *args))

    def of(own: Column) -> Column:
        """The words of a document in chosen blocks, block by block."""

        def part(b: Column) -> Column:
            low = F.greatest(b * block, first)
            return F.slice(own, (low - first + 1).cast("int"), (F.least((b + 1) * block, end) - low).cast("int"))

        return F.array_join(F.flatten(F.transform(picked, part)), " ")

    some = F.get(F.transform(F.array(words), of), 0)  # the words are split once
    partly = F.when((F.col("quota") > 0) & (F.col("taken") > F.col("passes") * F.col("size")), some)
    whole = F.when(F.col("passes") > 0, F.array_join(F.array_repeat(text, F.col("passes").cast("int")), "\n"))
    mixed = F.concat_ws("\n", whole, partly)
    return plan.filter("taken > 0").select(*((mixed if c == text_column else F.col(f"_{c}")).alias(c) for c in docs.columns))


def op7_mixing(spark, sf_dir):
    return mix_plan(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op7_mixing": op7_mixing}
ORACLES: dict[str, str] = {}
