"""Text quality scores and the choice among candidate outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliowork.functions.text import agreement, artifact_penalty, col, trim_all, word_count
from foliowork.operators.evidence import detect_language
from foliowork.operators.rules import BUDGET_SCORE
from foliowork.operators.structure import duplication_penalty

#: The weights of the parts, and the bounds from which a part is given as a reason.
WEIGHTS = {"language": 0.20, "coverage": 0.30, "structure": 0.20, "clean": 0.15, "unique": 0.15, "agreement": 0.18, "image_confidence": 0.07}
LOW, HIGH, LOW_AGREEMENT = 0.45, 0.25, 0.35


def coverage(markdown: Column, pages: Column, expected_chars: Column | None = None, words: Column | None = None) -> Column:
    """Words a page over 180, or how near the length is to what the pages held; a little more for page rules.

    `words` is the number of words where it is known.
    """
    score = F.least(F.lit(1.0), (word_count(markdown) if words is None else words) / F.greatest(pages, F.lit(1)) / 180.0)
    if expected_chars is not None:
        ratio = F.length(markdown) / expected_chars
        by_ratio = F.when(ratio < 1, ratio).otherwise(F.greatest(F.lit(0.0), 1.25 - F.least(ratio - 1, F.lit(1.25))))
        score = F.when(expected_chars > 0, F.greatest(score, F.least(F.lit(1.0), by_ratio))).otherwise(score)
    ruled = (pages > 1) & F.contains(markdown, F.lit("\n\n---\n\n"))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(ruled, F.least(F.lit(1.0), score + 0.08)).otherwise(score)))


def structure_score(markdown: Column, table_like: Column | None = None, figure: Column | None = None) -> Column:
    """Points for headings, lists, table rules and fences; less where an expected table is absent."""
    # A line begins with the text or after a line end; spaces at its ends do not count, so an item has more than its mark.
    # A pattern is tried where its mark is in the text at all.
    heading = F.contains(markdown, F.lit("#")) & F.regexp_like(markdown, F.lit(r"(?:\A|[\r\n])[ \t\x0B\f]*+#"))
    item = F.regexp_like(markdown, F.lit(r"(?:\A|[\r\n])[ \t\x0B\f]*+(?:- |\d++\.[ \t\x0B\f])[ \t\x0B\f]*+[^\s]"))
    table = F.contains(markdown, F.lit("|")) & F.regexp_like(markdown, F.lit(r"(?:\A|[\r\n])\|[ \t\x0B\f\-|:]+\|(?:[\r\n]|\z)"))
    fence = F.contains(markdown, F.lit("```"))
    score = F.lit(0.45)
    for test, points in ((heading, 0.18), (item, 0.10), (table, 0.22), (fence, 0.08)):
        score = score + F.when(test, points).otherwise(0.0)
    if table_like is not None:
        score = score - F.when(table_like & ~table, 0.20).otherwise(0.0)
    if figure is not None:
        score = score + F.when(figure & fence, 0.14).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def quality_score(
    df: DataFrame, markdown: str = "markdown", pages: str = "pages", expected_chars: str | None = None, table_like: str | None = None, figure: str | None = None, image_text: str | None = None, image_confidence: str | None = None, words: str | None = None
) -> DataFrame:
    """The frame with language, coverage, structure, artifacts, duplication, overall and reasons.

    The overall score is the weighted mean of the parts that are there. An empty text scores 0, with full penalties and
    the reason `empty output`. Everything is computed in the row; nothing is shuffled. `words` names a column with the number of words.
    """
    from foliowork.operators.structure import col as text_col

    text = trim_all(text_col(markdown))
    c = {k: F.col(v) if v else None for k, v in (("expected", expected_chars), ("table", table_like), ("figure", figure))}
    parts = df.withColumn("_text", text).withColumn("_words", F.col(words) if words else word_count(F.col("_text"))).withColumns(
        {
            "language": detect_language("_text", 8000)["confidence"],
            "coverage": coverage(F.col("_text"), F.col(pages), c["expected"], F.col("_words")),
            "structure": structure_score(F.col("_text"), c["table"], c["figure"]),
            "artifacts": artifact_penalty("_text", F.col("_words")),
            "duplication": duplication_penalty("_text"),
        }
    )
    total, weight = F.lit(0.0), 0.0
    values = {"language": F.col("language"), "coverage": F.col("coverage"), "structure": F.col("structure"), "clean": 1 - F.col("artifacts"), "unique": 1 - F.col("duplication")}
    if image_text:
        values["agreement"] = agreement("_text", image_text)
    if image_confidence:
        values["image_confidence"] = F.least(F.greatest(F.col(image_confidence), F.lit(0.0)), F.lit(1.0))
    for name, value in values.items():
        total, weight = total + value * WEIGHTS[name], weight + WEIGHTS[name]
    reasons = [F.when(F.col(n) < LOW, f"low {what}") for n, what in (("language", "language confidence"), ("coverage", "coverage"), ("structure", "structure"))]
    reasons += [F.when(F.col("artifacts") > HIGH, "extraction artifacts"), F.when(F.col("duplication") > HIGH, "duplicate text")]
    if image_text:
        reasons.append(F.when(values["agreement"] < LOW_AGREEMENT, "low image-text agreement"))
    empty = F.col("_text") == ""
    scored = parts.withColumns({"overall": F.least(F.greatest(total / weight, F.lit(0.0)), F.lit(1.0)), "reasons": F.array_compact(F.array(*reasons))})
    blank = {"language": F.lit(0.0), "coverage": F.lit(0.0), "structure": F.lit(0.0), "artifacts": F.lit(1.0), "duplication": F.lit(1.0), "overall": F.lit(0.0), "reasons": F.array(F.lit("empty output"))}
    return scored.withColumns({k: F.when(empty, v).otherwise(F.col(k)) for k, v in blank.items()}).drop("_text", "_words")


def select_best(candidates: DataFrame, by: str = "doc_id", score: str = "overall", markdown: str = "markdown", order: str = "ord") -> DataFrame:
    """One candidate of each document: the best score, then the longer text, then the first."""
    length = F.length(col(markdown))
    # The least of these is the first in order; nulls of score and length come last. Each task sends on one row of a document.
    place = F.struct(F.col(score).isNull(), -F.col(score), length.isNull(), -length, F.col(order))
    best = candidates.groupBy(by).agg(F.min_by(F.struct(*(F.col(f"`{c}`") for c in candidates.columns)), place).alias("best"))
    return best.select(*(F.col("best").getField(c).alias(c) for c in candidates.columns))


def union_candidates(*outputs: DataFrame) -> DataFrame:
    """The outputs of several engines, one below the other, with `ord`, the engine's place; columns that one lacks are null."""
    stacked = outputs[0].withColumn("ord", F.lit(0))
    for place, more in enumerate(outputs[1:], 1):
        stacked = stacked.unionByName(more.withColumn("ord", F.lit(place)), allowMissingColumns=True)
    return stacked


def quality_select(basic: DataFrame, secondary) -> DataFrame:
    """The better of two engines' outputs, where the second runs only for documents that need it.

    `basic` has doc_id, markdown, pages, scanned and special; `secondary` turns such rows into the second engine's
    output. Documents that the first served well never reach the second.
    """
    from foliowork.operators.rules import needs_secondary

    scored = quality_score(basic)
    needy = scored.filter(needs_secondary(F.col("pages"), F.col("scanned"), F.col("special"), F.col("overall"))).select(*basic.columns)
    return select_best(union_candidates(scored, quality_score(secondary(needy))))


__all__ = ["BUDGET_SCORE", "coverage", "quality_score", "quality_select", "select_best", "structure_score", "union_candidates"]
