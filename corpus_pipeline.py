"""A training-data pipeline: documents that are good, without boilerplate lines and near-copies, mixed and packed.

Each stage works on all rows that its predecessor wrote. STAGES are (name, function); a function takes the session, the
stage's documents and the folder of the tables, and returns a frame. All stages but the last return the columns of
documents, whatever others there are beside doc_id, text and source, in their order.

For all stages: null texts count as empty; an empty table gives an empty result; repeated rows stay rows of their own, and equal
texts are treated alike; a null doc_id or source is a value like others, and only the near-duplicate stage never links such
rows; no column name clashes with a working column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliowork.llm.lines import dedup_lines
from foliowork.llm.mixing import mix
from foliowork.llm.neardup import drop_near_duplicates
from foliowork.llm.packing import pack_sequences
from foliowork.llm.quality import CUT, score_quality, train_quality
from foliowork.llm.shared import read, shared_folder, whole_row, write_table


OWN = ("doc_id", "text", "source")


def _packed(docs: DataFrame) -> DataFrame:
    """The columns that stages work on, and all others in one, so that no name can clash."""
    others = [c for c in docs.columns if c not in OWN]
    return docs.select(*OWN, *([whole_row(others).alias("others")] if others else []))


def _documents(rows: DataFrame, docs: DataFrame, changed: bool = True) -> DataFrame:
    """The columns of `docs` again, with the length of the text as it is now where texts were changed."""
    own = {c: F.col("others").getField(c) for c in docs.columns if c not in OWN} | {c: F.col(c) for c in OWN}
    if changed and "n_chars" in own:
        own["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return rows.select(*(own[c].alias(c) for c in docs.columns))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject. It is fitted on these documents' own labels.

    Empty texts are scored like others. Without labels of both kinds all documents have one score: the label's, or 0.5.
    """
    model = train_quality(docs, read(spark, sf_dir, "labels"))
    return _documents(score_quality(_packed(docs), model).filter(F.col("score") >= CUT), docs, changed=False)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten or more documents share. A document that loses all of them stays, with an empty text."""
    return _documents(dedup_lines(_packed(docs)), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the smallest id. Texts without words are linked with nothing and stay."""
    return _documents(drop_near_duplicates(_packed(docs)), docs, changed=False)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes, each document's in one row. Documents of which it takes none, as those without words, go."""
    return _documents(mix(_packed(docs)), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of 2048, as pieces of documents. An empty text is one piece of one token."""
    return pack_sequences(docs, with_ids=False)


STAGES = [
    ("quality", keep_good),
    ("line-dedup", drop_lines),
    ("near-dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: The classifier is no SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's result is written as Parquet and read again as the next one's input."""
    docs, folder = read(spark, sf_dir, "documents"), shared_folder(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = write_table(stage(spark, docs, sf_dir), f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
