"""Sinks: rendered documents, histories, result logs and baselines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliowork.functions.text import col, fmt_iso, wc_alnum, yaml_str

#: Entries of one manifest or baseline map, about.
ENTRIES = 10_000
MODES = ("markdown", "markdownWithFrontmatter", "json")


def frontmatter(row: dict[str, Column]) -> Column:
    """The header block of a document, its strings quoted, its numbers plain."""
    keys = ("title", "source", "converted", "language", "type", "pipeline", "pages", "word_count")
    lines = [F.concat(F.lit(f"{k}: "), row[k].cast("string") if k in ("pages", "word_count") else yaml_str(row[k])) for k in keys]
    return F.concat_ws("\n", F.lit("---"), *lines, F.lit("---"), F.lit(""))


def render(df: DataFrame, mode: str = "markdown") -> DataFrame:
    """The frame with `text` and `file_ext` in one of the three output modes.

    It has title, markdown, source_name, created_at, language, type, pipeline and pages. JSON keys are sorted.
    """
    values = {
        "title": col("title"), "source": col("source_name"), "converted": fmt_iso(F.col("created_at")), "language": col("language"),
        "type": col("type"), "pipeline": col("pipeline"), "pages": F.col("pages"), "word_count": wc_alnum("markdown"),
    }
    if mode == "markdown":
        return df.withColumns({"text": col("markdown"), "file_ext": F.lit("md")})
    if mode == "markdownWithFrontmatter":
        return df.withColumns({"text": F.concat(frontmatter(values), F.lit("\n"), col("markdown")), "file_ext": F.lit("md")})
    if mode == "json":
        metadata = F.struct(*(values[k].alias(k) for k in sorted(values)))
        payload = F.to_json(F.struct(col("markdown").alias("markdown"), metadata.alias("metadata"), col("title").alias("title")), {"pretty": "true"})
        return df.withColumns({"text": payload, "file_ext": F.lit("json")})
    raise ValueError(f"unknown output mode {mode!r}; known are {', '.join(MODES)}")


def write_documents(df: DataFrame, path: str, mode: str = "markdown") -> None:
    """Rendered documents below `path`, one folder for each file extension."""
    render(df, mode).write.mode("overwrite").partitionBy("file_ext").parquet(path)


def append_results(df: DataFrame, path: str) -> None:
    """Rows added to a result log of JSON lines."""
    df.write.mode("append").json(path)


def replace_baseline(df: DataFrame, path: str) -> None:
    """The baselines of the pathways in `df` replace those stored; other pathways keep theirs."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("pathway").parquet(path)


def _in_parts(df: DataFrame, key: str, id_column: str, most: int) -> DataFrame:
    """The frame with `_part`: the rows of a key dealt by id into parts of about `most` rows, however many it has."""
    counts = df.groupBy(F.col(key).alias("_key")).agg(F.ceil(F.count("*") / most).alias("_parts"))
    dealt = df.join(counts, df[key].eqNullSafe(counts["_key"]))
    return dealt.withColumn("_part", F.pmod(F.xxhash64(id_column), "_parts")).drop("_key", "_parts")


def write_manifests(df: DataFrame, path: str, most: int = ENTRIES) -> None:
    """Corpus manifests of (source, id, entry) below `path`: one file for each part of a source, to be read as `path/*/*`."""
    grouped = _in_parts(df, "source", "id", most).groupBy("source", "_part").agg(F.collect_list("entry").alias("documents"))
    grouped.select("source", "_part", F.lit(2).alias("version"), "documents").write.partitionBy("source", "_part").json(path)


def write_baselines(df: DataFrame, path: str, most: int = ENTRIES) -> None:
    """Nested baseline maps of (pathway, doc_id, entry) below `path`: one file for each part of a pathway, to be read as `path/*/*`."""
    grouped = _in_parts(df, "pathway", "doc_id", most).groupBy("pathway", "_part").agg(F.map_from_entries(F.collect_list(F.struct("doc_id", "entry"))).alias("docs"))
    named = grouped.select(F.col("pathway").alias("folder"), "_part", F.create_map("pathway", "docs").alias("document_baselines"))
    named.write.partitionBy("folder", "_part").json(path)


def write_registries(df: DataFrame, path: str, most: int = ENTRIES) -> None:
    """Pathway registries of (pathway, entry) below `path`, in files of about `most` pathways each."""
    parts = F.greatest(F.ceil(F.count("*") / most), F.lit(1)).alias("_parts")
    counted = df.crossJoin(F.broadcast(df.agg(parts)))  # one row
    grouped = counted.withColumn("_part", F.pmod(F.xxhash64("pathway"), "_parts")).groupBy("_part").agg(F.map_from_entries(F.collect_list(F.struct("pathway", "entry"))).alias("pathways"))
    grouped.write.partitionBy("_part").json(path)


def write_history(df: DataFrame, path: str) -> None:
    """One JSON record for each conversion, with ISO dates."""
    df.write.mode("append").option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss'Z'").json(path)


def is_stale(stored: DataFrame, regenerated: DataFrame) -> DataFrame:
    """Rows of either table that the other lacks, repeats counted; none means that the stored table is current."""
    return stored.exceptAll(regenerated).unionAll(regenerated.exceptAll(stored))
