"""Secret scans over an incremental blob ledger.

Every version of every path is addressed by its content. The ledger records which (blob, rule version) pairs have
been scanned and what was found, so a scan reads only blobs and rules that it has not met together, each distinct
blob once; findings are then joined back to all paths and versions that hold the blob. Matching is by built-in
regular expressions: the texts between matches give the positions, without a user function.
"""

from __future__ import annotations

import uuid
from collections import namedtuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliowork.llm.shared import read, shared_folder, text_of, written

#: kind, version, pattern, the group whose length counts, and its least length.
Rule = namedtuple("Rule", "kind version pattern group least")

BASE_RULES = (
    Rule("assign", 1, r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", 1, r"AKIA[A-Z0-9]{12,}", 0, 16),
    Rule("hex", 1, r"[0-9a-f]{32,}", 0, 32),
)
MORE_RULES = (
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
    Rule("forge", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
    Rule("chat", 1, r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1),
)
RULES = BASE_RULES + MORE_RULES

SPAN = "array<struct<start:int,end:int>>"


def spans(text: Column, rule: Rule) -> Column:
    """(start, end) in code points of the rule's leftmost non-overlapping matches, without those that are too short.

    Every second stretch of the text is a match, so running lengths of what lies between and of the matches are the
    positions.
    """
    pattern = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    counted = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else found
    between = F.split(text, rule.pattern, -1)
    steps = F.transform(F.arrays_zip(found.alias("m"), counted.alias("g"), F.slice(between, 1, F.size(found)).alias("b")), lambda x: F.struct(F.length(x["b"]).alias("b"), F.length(x["m"]).alias("m"), F.length(x["g"]).alias("g")))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["b"]
        end = start + x["m"]
        one = F.array(F.struct(start.alias("start"), end.alias("end")))
        kept = F.when(x["g"] >= rule.least, F.concat(acc["spans"], one)).otherwise(acc["spans"])
        return F.struct(end.alias("at"), kept.alias("spans"))

    return F.when(F.regexp_like(text, pattern), F.aggregate(steps, zero, step)["spans"]).otherwise(F.array().cast(SPAN))


class BlobLedger:
    """A table of (blob, kind, version, spans) in a shared folder, one appended part for each scan.

    The parts are those that lie in the folder, written to their end: a ledger opened there again, in any session, goes on.
    """

    SCHEMA = f"blob string, kind string, version int, spans {SPAN}"

    def __init__(self, spark, folder: str):
        self.spark, self.folder = spark, folder
        self.parts = [f"{folder}/{name}" for name in written(spark, folder) if name.startswith("part-")]

    def read(self) -> DataFrame:
        if not self.parts:
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).parquet(*self.parts)

    def scan(self, versions: DataFrame, rules: tuple[Rule, ...]) -> None:
        """Scan the (blob, rule version) pairs of `versions` (blob, text) that the ledger lacks, and record them all.

        A pair without findings is recorded too. Each distinct blob is scanned once, wherever it occurs.
        """
        blobs = versions.dropDuplicates(["blob"])
        if self.parts:
            seen = self.read().groupBy("blob").agg(F.collect_set(F.concat_ws("@", "kind", "version")).alias("seen"))
            blobs = blobs.join(seen, "blob", "left")
        else:
            blobs = blobs.withColumn("seen", F.array().cast("array<string>"))
        seen = F.coalesce("seen", F.array().cast("array<string>"))
        pairs = [
            F.when(~F.array_contains(seen, f"{r.kind}@{r.version}"), F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), spans(F.col("text"), r).alias("spans")))
            for r in rules
        ]
        part = f"{self.folder}/part-{uuid.uuid4().hex}"
        blobs.select("blob", F.inline(F.array_compact(F.array(*pairs)))).write.parquet(part)
        self.parts.append(part)


def scan_versions(versions: DataFrame, ledger: BlobLedger, path_columns: tuple[str, ...] = ("doc_id",), text_column: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Findings of every path and version: the path columns, blob, and `found`: array of (start, order, kind, end).

    One row per input row, with an empty array where nothing was found. Null texts count as empty; repeated rows and
    null paths stay; other columns are ignored; an empty table gives no rows. Rows of one text share its findings.
    """
    text = text_of(text_column)
    blob = F.sha2(text, 256).alias("blob")
    ledger.scan(versions.select(blob, text.alias("text")), rules)
    order = {(r.kind, r.version): k for k, r in enumerate(rules)}
    place = F.coalesce(*(F.when((F.col("kind") == k) & (F.col("version") == v), F.lit(n)) for (k, v), n in order.items()))
    hits = ledger.read().withColumn("order", place).filter("order is not null and size(spans) > 0")
    one = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), F.col("order").alias("order"), F.col("kind").alias("kind"), s["end"].alias("end")))
    by_blob = hits.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list(one))).alias("found"))
    found = write_findings(by_blob, ledger)
    paths = versions.select(*path_columns, blob)
    return paths.join(found, "blob", "left").withColumn("found", F.coalesce("found", F.array().cast(FOUND)))


FOUND = "array<struct<start:int,order:int,kind:string,end:int>>"


def write_findings(by_blob: DataFrame, ledger: BlobLedger) -> DataFrame:
    """One row per blob with findings, written so that the join with all paths can split a blob that many share."""
    path = f"{ledger.folder}/found-{uuid.uuid4().hex}"
    by_blob.select("blob", F.col("found").cast(FOUND)).write.parquet(path)
    return ledger.spark.read.schema(f"blob string, found {FOUND}").parquet(path)


def joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def op4_secret_scan(spark, sf_dir):
    ledger = BlobLedger(spark, shared_folder(spark, "blob-ledger"))
    scanned = scan_versions(read(spark, sf_dir, "documents"), ledger)
    base = F.filter("found", lambda x: x["order"] < len(BASE_RULES))

    def count(kind: str) -> Column:
        return F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return scanned.select("doc_id", *(count(r.kind) for r in BASE_RULES), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))


def _sql() -> str:
    """The same spans by list functions: what lies between matches gives the positions."""
    kinds = []
    for k, r in enumerate(RULES):
        pattern = r.pattern.replace("'", "''")
        kinds.append(
            f"SELECT doc_id, text, {k} AS ord, '{r.kind}' AS kind, {r.least} AS least, regexp_extract_all(text, '{pattern}', 0) AS m, "
            f"regexp_extract_all(text, '{pattern}', {r.group}) AS g, string_split_regex(text, '{pattern}') AS b FROM t"
        )
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
k AS ({" UNION ALL ".join(kinds)}),
x AS (SELECT doc_id, ord, kind, least, unnest(range(1, len(m) + 1)) AS i, m, g, b FROM k WHERE len(m) > 0),
y AS (SELECT doc_id, ord, kind, length(g[i]) >= least AS ok,
             list_sum(list_transform(b[1:i], lambda s: length(s))) + coalesce(list_sum(list_transform(m[1:i-1], lambda s: length(s))), 0) AS s, length(m[i]) AS n FROM x),
z AS (SELECT doc_id, ord, kind, s, kind || ':' || s::BIGINT || ':' || (s + n)::BIGINT AS span FROM y WHERE ok),
a AS (SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access,
             count(*) FILTER (WHERE kind = 'hex') AS n_hex, string_agg(span, ',' ORDER BY s, ord) FILTER (WHERE ord < {len(BASE_RULES)}) AS base,
             string_agg(span, ',' ORDER BY s, ord) AS spans FROM z GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN a USING (doc_id)
"""


QUERIES = {"op4_secret_scan": op4_secret_scan}
ORACLES = {"op4_secret_scan": _sql()}
