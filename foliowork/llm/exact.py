"""Exact deduplication by distributed MSD radix partitioning.

A round reads the next bytes of every text that is still undecided. The counting pass makes a histogram of
(group, digit), in which only groups of two or more matter; the distribution pass joins the rows with it. A row whose
digit nobody shares is alone; a group whose texts end within the digit is a set of equal texts; the others go on with
the bytes after the digit. Digits widen by two each round, so the number of rounds is the logarithm of the longest
text. Bytes themselves are compared; no digest decides anything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliowork.llm.shared import SPACES, broadcast_if_small, drop_folder, read, shared_folder, text_of, write_table

FIRST_DIGIT = 64


def exact_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", first_digit: int = FIRST_DIGIT) -> DataFrame:
    """Group documents whose texts are equal once white space is deleted, and choose the one that stays.

    Of a group, the row with the most code points stays, then the one with the smallest id (null ids first).
    Returns, for every row, the id, keep_id, group_size, kept and text_sha256 (of the text without white space). Null
    texts count as empty, and empty texts equal each other. Repeated rows of one id are in one group, and share the
    value of kept. Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    folder = shared_folder(spark, "radix")
    text = text_of(text_column)
    rest = F.encode(F.translate(text, SPACES, ""), "UTF-8")
    rows = docs.select(
        docs[id_column].alias("id"), F.length(text).alias("n_chars"), F.sha2(rest, 256).alias("sha"), F.lit(0).cast("long").alias("group"), rest.alias("rest")
    )
    width, done, previous = first_digit, [], None
    while True:
        digit = F.substring("rest", 1, width)
        keyed = rows.withColumn("digit", digit)
        counted = keyed.groupBy("group", "digit").agg(F.count("*").alias("n"), F.min(F.struct(-F.col("n_chars"), F.col("id"))).alias("best"))
        shared = counted.filter("n > 1").withColumn("next", F.monotonically_increasing_id())
        path = f"{folder}/digits-{len(done)}"
        histogram = write_table(shared.select("group", "digit", "n", F.col("best.id").alias("keep"), "next"), path)
        goes_on = F.col("n").isNotNull() & (F.octet_length("digit") == width)
        dealt = keyed.join(broadcast_if_small(histogram, path), ["group", "digit"], "left").select(
            "id",
            "n_chars",
            "sha",
            F.col("next").alias("group"),
            F.when(goes_on, F.expr(f"substring(rest, {width + 1})")).alias("rest"),
            F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep")).alias("keep"),
            F.coalesce("n", F.lit(1)).cast("long").alias("n"),
            goes_on.alias("open"),
        )
        table = write_table(dealt, f"{folder}/round-{len(done)}", "open")
        done.append(table.filter("not open"))
        drop_folder(spark, path)
        if previous:
            drop_folder(spark, f"{previous}/open=true")
        rows = table.filter("open").select("id", "n_chars", "sha", "group", "rest")
        if rows.isEmpty():
            break
        previous, width = f"{folder}/round-{len(done) - 1}", width * 2
    result = done[0]
    for more in done[1:]:
        result = result.unionByName(more)
    return result.select(
        F.col("id").alias(id_column),
        F.col("keep").alias("keep_id"),
        F.col("n").alias("group_size"),
        F.col("id").eqNullSafe(F.col("keep")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def op2_exact_dedup(spark, sf_dir):
    return exact_groups(read(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n_chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
r AS (SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size
      FROM t WINDOW w AS (PARTITION BY norm ORDER BY n_chars DESC, doc_id))
SELECT doc_id, keep_id, group_size::BIGINT AS group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM r
"""

QUERIES = {"op2_exact_dedup": op2_exact_dedup}
ORACLES = {"op2_exact_dedup": OP2_SQL}
