"""Sources: manifests, document folders, archives, stored results, baselines, registries, histories and books."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliowork.functions.text import col, trim_all
from foliowork.operators.rules import ACCEPTED

MAX_BYTES = 500 * 1024 * 1024
HISTORY = "version int, id string, created_at timestamp, source_name string, ext string, title string, format string, pages int, word_count int, pipeline string, pathway string, markdown string"
RESULTS = "key string, engine string, status string, gt_words int, md_words int, sim double, error string"
BASELINE = "document_baselines map<string,map<string,struct<status:string,overall_percent:double,elapsed_seconds:double,category:string,blocked_reason:string>>>"
REGISTRY = "pathways map<string,struct<owner:string,runner:string,release_status:string,valid_formats:array<string>,baseline_required:boolean>>, unsupported_formats array<string>"
MANIFEST = "version int, description string, documents array<struct<id:string,document:string,ground_truth:string,format:string,source:string>>"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(id, document, ground_truth, format, source) of a corpus manifest: one JSON object with a `documents` array."""
    return spark.read.schema(MANIFEST).option("multiLine", True).json(path).select(F.inline("documents"))


def admission(listing: DataFrame) -> DataFrame:
    """The listing (path, length) with ext and verdict: ok, unsupportedType, tooLarge, notAFile or unavailable."""
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    verdict = F.when(F.col("length").isNull(), "unavailable").when(F.col("path").endswith("/"), "notAFile").when(~ext.isin(*ACCEPTED), "unsupportedType").when(F.col("length") > MAX_BYTES, "tooLarge")
    return listing.withColumn("ext", ext).withColumn("verdict", F.coalesce(verdict, F.lit("ok")))


def scan_documents(spark: SparkSession, root: str) -> DataFrame:
    """(path, ext, length, mtime, verdict) of all files below a folder. Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", F.col("modificationTime").alias("mtime"))
    return admission(files).select("path", "ext", "length", "mtime", "verdict")


def decode_text(content: Column | str) -> Column:
    """Bytes as text: UTF-8 where valid, else Latin-1; trimmed, with one line break at the end. Null stays null."""
    raw = F.col(content) if isinstance(content, str) else content
    text = F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string")).otherwise(F.decode(raw, "ISO-8859-1"))
    return F.concat(trim_all(text), F.lit("\n"))


def pair_members(members: DataFrame, exts: tuple[str, ...], cached: DataFrame | None = None) -> DataFrame:
    """(key) of archive members (name) of which every wanted extension is there, without those that are cached."""
    key, ext = F.regexp_extract("name", r"^(.*)\.[^.]+$", 1), F.regexp_extract("name", r"\.([^.]+)$", 1)
    grouped = members.select(key.alias("key"), ext.alias("ext")).filter(F.col("ext").isin(*exts)).groupBy("key").agg(F.count_distinct("ext").alias("n"))
    whole = grouped.filter(F.col("n") == len(set(exts))).select("key")
    return whole.join(cached.select("key"), "key", "left_anti") if cached is not None else whole


def gt_text(df: DataFrame) -> DataFrame:
    """(key, gt): the lines of all pages, in order. `pages` is an array of structs with `text`, an array of lines."""
    return df.select("key", F.array_join(F.flatten(F.transform("pages", lambda p: F.coalesce(p["text"], F.array().cast("array<string>")))), "\n").alias("gt"))


def discover_outputs(paths: DataFrame) -> DataFrame:
    """(id, engine, is_gt) from file names `<id>.<engine>.html`; `gt` marks the ground truth; other names are ignored."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    own = paths.select(F.regexp_extract(name, r"^(.+)\.([^.]+)\.html$", 1).alias("id"), F.regexp_extract(name, r"^(.+)\.([^.]+)\.html$", 2).alias("engine"))
    return own.filter("id <> ''").withColumn("is_gt", F.col("engine") == "gt")


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """Stored conversions, the newest first. Records that are no JSON or lack an id are skipped."""
    rows = spark.read.schema(f"{HISTORY}, _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    return rows.filter("_bad is null and id is not null").drop("_bad").orderBy(F.desc("created_at"), "id")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """The result log; lines that are no JSON, or have no key, are skipped."""
    rows = spark.read.schema(f"{RESULTS}, _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    return rows.filter("_bad is null and key is not null").drop("_bad")


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    """(pathway, doc_id, status, overall_percent, elapsed_seconds, category, blocked_reason) of a nested baseline map."""
    maps = spark.read.schema(BASELINE).option("multiLine", True).json(path).select(F.explode("document_baselines").alias("pathway", "docs"))
    return maps.select("pathway", F.explode("docs").alias("doc_id", "b")).select("pathway", "doc_id", "b.*")


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """(pathway, release_status, runner, baseline_required, format), one row for each format; a null one without any."""
    maps = spark.read.schema(REGISTRY).option("multiLine", True).json(path).select(F.explode("pathways").alias("pathway", "p"))
    return maps.select("pathway", "p.release_status", "p.runner", "p.baseline_required", F.explode_outer("p.valid_formats").alias("format"))


def resolve_path(base: Column, href: Column) -> Column:
    """An entry's path: the link without fragment, decoded, below the package's folder, `.` and `..` taken out."""
    link = F.regexp_replace(href, "#.*$", "")
    link = F.coalesce(F.try_url_decode(F.replace(link, F.lit("+"), F.lit("%2B"))), link)
    parts = F.filter(F.split(F.concat_ws("/", F.when(base != "", base), link), "/", -1), lambda p: ~p.isin("", "."))
    empty = F.array().cast("array<string>")
    folded = F.aggregate(parts, empty, lambda acc, p: F.when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p))))
    return F.array_join(folded, "/")


def reading_order(packages: DataFrame) -> DataFrame:
    """(book, pos, path) of books (book, path, content): the package's spine, or its manifest's order without one.

    Only items that are (x)html count. `path` is the package file's; names must be free of prefixes, as in OPF.
    """
    c = col("content")
    base = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    ids, hrefs, types = (F.xpath(c, F.lit(f"//manifest/item/@{a}")) for a in ("id", "href", "media-type"))
    items = F.arrays_zip(ids.alias("id"), hrefs.alias("href"), types.alias("type"))
    spine = F.xpath(c, F.lit("//spine/itemref/@idref"))
    order = F.when(F.size(spine) > 0, spine).otherwise(ids)
    rows = packages.select("book", base.alias("base"), items.alias("items"), F.posexplode(order).alias("pos", "idref"))
    item = F.get(F.filter("items", lambda i: i["id"] == F.col("idref")), 0)
    picked = rows.select("book", "pos", "base", item.alias("i")).filter("i is not null")
    by_name = F.regexp_like(F.col("i.href"), F.lit(r"(?i)\.(xhtml|html|htm)$")) & (col("i.type") == "")
    kept = picked.filter(F.contains(col("i.type"), F.lit("html")) | by_name)
    return kept.select("book", "pos", resolve_path(F.col("base"), F.col("i.href")).alias("path"))
