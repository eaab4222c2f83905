"""Queries over pages, tables, sources, sinks and whole jobs, each with its SQL where SQL can say it."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import functions as F

from foliowork.functions import text as X
from foliowork.operators import html as H
from foliowork.operators import tables as T
from foliowork.operators.walker import pages_to_markdown
from foliowork.plans import jobs
from foliowork.plans.q_evidence import PER_PAGE, SAMPLE
from foliowork.plans.q_runs import _results, results
from foliowork.plans.q_text import PAIRS, passage_pairs, sql_distance, sql_word_rates
from foliowork.plans.tables import book, doc_pages, read, sql_lines, sql_tokens, sql_trim, structured
from foliowork.sources import readers as R
from foliowork.sources import sinks as K
from foliowork.sources.scratch import scratch_folder

query, QUERIES, ORACLES = book()


def sql_meaningful_words(x: str) -> str:
    """Words that remain without comments, pictures and tags."""
    bare = rf"regexp_replace(regexp_replace(regexp_replace({x}, '<!--.*?-->', ' ', 'gs'), '!\[[^\]]*\]\([^)]*\)', ' ', 'g'), '</?[^>]+>', ' ', 'g')"
    return rf"len(regexp_extract_all({bare}, '[\p{{L}}\p{{N}}]+(?:[''’-][\p{{L}}\p{{N}}]+)*'))"


_VISIBLE = "regexp_replace(coalesce(html, ''), '<!--.*?-->', '', 'gs')"
for _tag in H.DROPPED:
    _VISIBLE = f"regexp_replace({_VISIBLE}, '<{_tag}\\b[^>]*>.*?</{_tag}\\s*>', '', 'gis')"
_VIS = f"vis AS (SELECT page_id, {_VISIBLE} AS x FROM pages)"
_NAME = "lower(regexp_extract(token, '^</?([A-Za-z][A-Za-z0-9-]*)', 1))"
_TOKENS = f"{_VIS}, tk AS (SELECT page_id, unnest(regexp_extract_all(x, '<!--.*?-->|</?[A-Za-z][^>]*>|<![^>]*>|[^<]+|<', 0, 's')) AS token, generate_subscripts(regexp_extract_all(x, '<!--.*?-->|</?[A-Za-z][^>]*>|<![^>]*>|[^<]+|<', 0, 's'), 1) - 1 AS pos FROM vis), tags AS (SELECT page_id, pos, token, {_NAME} AS tag FROM tk)"


@query(f"WITH {_TOKENS} SELECT page_id, pos, CASE WHEN tag <> '' THEN tag END AS tag, CASE WHEN tag <> '' THEN starts_with(token, '</') END AS close, CASE WHEN tag = '' THEN token END AS text FROM tags")
def page_tag_stream(spark, sf):
    return H.tag_stream(read(spark, sf, "pages")).select("page_id", "pos", "tag", "close", "text")


_FOLD = f"CASE WHEN tag IN {H.BLOCK_FOLDS} THEN 'div' WHEN tag IN {H.INLINE_FOLDS} THEN 'span' ELSE tag END"


@query(f"WITH {_TOKENS} SELECT {_FOLD} AS tag, count(*) AS n FROM tags WHERE tag <> '' GROUP BY 1")
def page_tag_counts(spark, sf):
    return H.fold_tags(H.tag_stream(read(spark, sf, "pages"))).filter("tag is not null").groupBy("tag").agg(F.count("*").alias("n"))


@query(rf"""WITH {_VIS}, a AS (SELECT page_id, unnest(regexp_extract_all(x, '<a\b[^>]*>.*?</a\s*>', 0, 'is')) AS a FROM vis),
 l AS (SELECT page_id, 'link' AS kind, trim(regexp_replace(regexp_replace(a, '<[^>]*>', '', 'gs'), '[ \t\n\r\f]+', ' ', 'g')) AS label, regexp_replace(regexp_extract(a, '^<[^>]*?\shref\s*=\s*("[^"]*"|''[^'']*''|[^\s>]+)', 1, 'is'), '^["'']|["'']$', '', 'g') AS target FROM a) SELECT * FROM l WHERE label <> '' AND target <> ''""")
def page_links(spark, sf):
    return H.page_links(read(spark, sf, "pages"))


@query(None)
def page_markdown(spark, sf):
    return pages_to_markdown(read(spark, sf, "pages"))


_ENTITY = r"&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});|[^&]+|&"
_NAMED = "MAP {" + ", ".join(f"'&{name};': chr({code})" for name, code in sorted(name2codepoint.items())) + "}"
_NUMBER = "CASE WHEN regexp_matches(e, '^&#[xX]') THEN ('0x' || e[4:-2])::INT ELSE e[3:-2]::INT END"
_CHARACTER = f"CASE WHEN NOT regexp_matches(e, '^&#.*;$') THEN coalesce(names[e], e) WHEN {_NUMBER} BETWEEN 1 AND 55295 OR {_NUMBER} BETWEEN 57344 AND 1114111 THEN chr({_NUMBER}) ELSE '�' END"


@query(rf"""WITH {_VIS}, h AS (SELECT page_id, unnest(regexp_extract_all(regexp_replace(x, '[\x01-\x07\x0E\x0F\x12-\x14]', '', 'g'), '<h1\b[^>]*>([^<]*)', 1, 'i')) AS t FROM vis), n AS (SELECT {_NAMED} AS names),
 d AS (SELECT page_id, t, array_to_string(list_transform(regexp_extract_all(t, '{_ENTITY}'), lambda e: {_CHARACTER}), '') AS shown FROM h, n)
 SELECT page_id, '# ' || regexp_replace(regexp_replace(regexp_replace(shown, '([\\`*_\[\]])', '\\\1', 'g'), '[ \t\n\r\f]+', ' ', 'g'), '^[\p{{Zs}}\t]+|[\p{{Zs}}\t]+$', '', 'g') AS heading FROM d WHERE trim(t) <> ''""")
def page_outline(spark, sf):
    """First-level headings as the Markdown shows them: entities are characters, marks are escaped, white space is folded."""
    m = pages_to_markdown(read(spark, sf, "pages"))
    return m.select("page_id", F.explode(F.filter(F.split("markdown", "\n", -1), lambda t: t.startswith("# "))).alias("heading"))


def _html_tables(spark, sf):
    """Documents whose lines are table rows and whose words are cells."""
    cell = lambda w: F.concat(F.lit("<td>"), w, F.lit("</td>"))
    rows = F.transform(F.split(X.col("text"), "\n", -1), lambda t: F.concat(F.lit("<tr>"), F.array_join(F.transform(F.split(t, " ", -1), cell), ""), F.lit("</tr>")))
    return read(spark, sf, "documents").select("doc_id", F.concat(F.lit("<table>"), F.array_join(rows, "\n"), F.lit("</table>")).alias("html"))


@query(f"""WITH l AS (SELECT doc_id, unnest({sql_lines("coalesce(text, '')")}) AS line, generate_subscripts({sql_lines("coalesce(text, '')")}, 1) - 1 AS row FROM documents)
 SELECT doc_id, 0::BIGINT AS table_id, row, generate_subscripts(string_split(line, ' '), 1) - 1 AS col, trim(unnest(string_split(line, ' '))) AS value, 1::BIGINT AS colspan, 1::BIGINT AS rowspan FROM l""")
def page_table_cells(spark, sf):
    return H.page_tables(_html_tables(spark, sf), "doc_id")


# Tables


def _csv(spark, sf):
    """Documents as CSV: a comma for each space, and every third line quoted as one field."""
    line = lambda t, i: F.when(i % 3 == 2, F.concat(F.lit('"'), F.replace(t, F.lit("a"), F.lit('""')), F.lit('"'))).otherwise(F.replace(F.replace(t, F.lit('"'), F.lit("'")), F.lit(" "), F.lit(",")))
    text = F.array_join(F.transform(F.split(F.replace(X.col("text"), F.lit('"'), F.lit("'")), "\n", -1), line), "\r\n")
    return read(spark, sf, "documents").select("doc_id", text.alias("text"))


_CSV = """l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS i FROM (SELECT doc_id, string_split(replace(coalesce(text, ''), '"', ''''), chr(10)) AS ls FROM documents)),
 f AS (SELECT doc_id, i, CASE WHEN i % 3 = 2 THEN [replace(line, 'a', '"')] ELSE string_split(replace(line, ' ', ','), ',') END AS fs FROM l), k AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS row FROM f WHERE NOT (len(fs) = 1 AND fs[1] = '')),
 cells AS (SELECT doc_id, row, generate_subscripts(fs, 1) - 1 AS col, unnest(fs) AS value FROM k)"""


@query(f"WITH {_CSV} SELECT * FROM cells")
def csv_cells(spark, sf):
    return T.csv_cells(_csv(spark, sf))


@query(f"""WITH {_CSV}, w AS (SELECT doc_id, max(len(fs)) AS w FROM k GROUP BY 1), r AS (SELECT doc_id, row, w, '| ' || array_to_string(list_concat(list_transform(fs, lambda c: replace(c, '|', '\\|')), list_transform(range(w - len(fs)), lambda i: '')), ' | ') || ' |' AS line FROM k JOIN w USING (doc_id))
 SELECT doc_id, string_agg(line || CASE WHEN row = 0 THEN chr(10) || '| ' || array_to_string(list_transform(range(w), lambda i: '---'), ' | ') || ' |' ELSE '' END, chr(10) ORDER BY row) || chr(10) AS markdown FROM r GROUP BY doc_id""")
def csv_markdown(spark, sf):
    return T.cells_to_markdown(T.csv_cells(_csv(spark, sf)))


@query(f"WITH {_CSV}, n AS (SELECT doc_id, row, count(*) AS width, max((trim(value) <> '')::INT) AS filled FROM cells GROUP BY ALL), u AS (SELECT *, first_value(width) OVER (PARTITION BY doc_id ORDER BY row) AS first FROM n) SELECT doc_id, 'uneven row' AS finding, row FROM u WHERE width <> first UNION ALL SELECT doc_id, 'no content', NULL FROM n GROUP BY doc_id HAVING max(filled) = 0 UNION ALL SELECT doc_id, unnest(['no rows', 'no content']), NULL FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM n)")
def table_integrity(spark, sf):
    """Every document is a table, those without a row in their CSV too."""
    return T.table_integrity(T.csv_cells(_csv(spark, sf)), read(spark, sf, "documents"), ("doc_id",))


@query(f"WITH {_CSV}, n AS (SELECT doc_id, len(fs) AS width, count(*) AS c FROM k GROUP BY ALL) SELECT doc_id, width FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY c DESC, width) AS r FROM n) WHERE r = 1")
def modal_widths(spark, sf):
    rows = T.csv_cells(_csv(spark, sf)).groupBy("doc_id", "row").agg(F.count("*").alias("width"))
    return T.modal_width(rows, ("doc_id",))


def line_strips(docs):
    """(table_id, strip, rows): lines as rows, in strips of four that overlap by two."""
    rows = docs.withColumn("own", F.split(X.col("text"), "\n", -1))
    starts = F.sequence(F.lit(0), F.greatest(F.size("own") - 3, F.lit(0)), F.lit(2))
    return rows.select(F.col("doc_id").alias("table_id"), F.posexplode(F.transform(starts, lambda s: F.transform(F.slice("own", s + 1, F.lit(4)), lambda t: F.array(t, F.upper(t))))).alias("strip", "rows"))


@query(f"""WITH l AS (SELECT doc_id, ls, list_transform(ls, lambda t: lower({sql_trim('t')})) AS k FROM (SELECT doc_id, {sql_lines("coalesce(text, '')")} AS ls FROM documents)),
 s AS (SELECT doc_id, ls, k, list_transform(range(1, greatest(len(ls) - 3, 0) + 2, 2), lambda a: range(a, least(a + 3, len(ls)) + 1)) AS strips FROM l),
 o AS (SELECT doc_id, ls, list_reduce(strips, lambda acc, x: list_concat(acc, list_slice(x, 1 + list_max(list_filter([0, 1, 2, 3, 4], lambda j: j = 0 OR (j <= len(acc) AND j <= len(x)
  AND list_transform(list_slice(acc, len(acc) - j + 1, len(acc)), lambda i: k[i]) = list_transform(list_slice(x, 1, j), lambda i: k[i])))), len(x)))) AS places FROM s)
 SELECT doc_id AS table_id, generate_subscripts(places, 1) - 1 AS row, ls[unnest(places)] AS key FROM o""")
def grid_stitching(spark, sf):
    """All documents, lines as rows; where lines repeat, strips may take more than the overlap away."""
    return T.stitch(line_strips(read(spark, sf, "documents"))).select("table_id", "row", F.get("cells", 0).alias("key"))


@query(None)
def sequence_similarity(spark, sf):
    return T.sequence_ratio(passage_pairs(spark, sf)).select("item_id", "sim")


def _word_rows(text):
    """A text as a table: a row for each sentence, a cell for each word."""
    cell = lambda w: F.struct(w.alias("value"), F.lit(1).alias("colspan"), F.lit(1).alias("rowspan"))
    return F.transform(F.split(X.col(text), r"\. ", -1), lambda r: F.transform(F.split(r, " ", -1), cell))


@query(None)
def table_tree_similarity(spark, sf):
    p = passage_pairs(spark, sf).select("item_id", _word_rows("reference").alias("truth"), _word_rows("text").alias("other"))
    return T.table_similarity(p).select("item_id", "structural", "total", "skipped")


# Sources and sinks: what Spark derives from the tables is written to a shared folder and read by the operator.


@query("SELECT doc_id::VARCHAR AS id, 'd/' || doc_id AS document, 'g/' || doc_id AS ground_truth, lang AS format, source FROM documents")
def manifest_scan(spark, sf):
    d = F.col("doc_id").cast("string")
    entry = F.struct(d.alias("id"), F.concat(F.lit("d/"), d).alias("document"), F.concat(F.lit("g/"), d).alias("ground_truth"), F.col("lang").alias("format"), "source")
    path = scratch_folder(spark, "manifest")
    K.write_manifests(read(spark, sf, "documents").select("source", d.alias("id"), entry.alias("entry")), path)
    return R.read_manifest(spark, f"{path}/*/*")


@query("""SELECT path, CASE WHEN ext = 'png' THEN 'png' ELSE ext END AS ext, CASE WHEN ext NOT IN ('pdf', 'png') THEN 'unsupportedType' WHEN length > 524288000 THEN 'tooLarge' ELSE 'ok' END AS verdict FROM (SELECT '/d/' || doc_id || '.' || e AS path, lower(e) AS ext, doc_id * 1000000 AS length FROM (SELECT doc_id, list_extract(['PDF', 'exe', 'png', 'md'], (doc_id % 4 + 1)::INT) AS e FROM documents))""")
def document_admission(spark, sf):
    e = F.element_at(F.array(*map(F.lit, ("PDF", "exe", "png", "md"))), (F.col("doc_id") % 4 + 1).cast("int"))
    listing = read(spark, sf, "documents").select(F.concat(F.lit("/d/"), F.col("doc_id"), F.lit("."), e).alias("path"), (F.col("doc_id") * 1_000_000).alias("length"))
    return R.admission(listing).select("path", "ext", "verdict")


@query(rf"SELECT doc_id, {sql_trim(chr(99) + 'oalesce(text, ' + chr(39) * 2 + ')')} || chr(10) AS text FROM documents")
def text_decoding(spark, sf):
    raw = F.when(F.col("doc_id") % 2 == 0, F.encode(X.col("text"), "UTF-8")).otherwise(F.encode(X.col("text"), "ISO-8859-1"))
    return read(spark, sf, "documents").select("doc_id", R.decode_text(raw).alias("text"))


@query("SELECT 'k' || doc_id AS key FROM documents WHERE doc_id % 3 > 0 AND doc_id NOT IN (SELECT doc_id FROM labels)")
def shard_pairing(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", F.concat(F.lit("k"), F.col("doc_id")).alias("key"))
    exts = F.when(F.col("doc_id") % 3 > 0, F.array(F.lit("pdf"), F.lit("json"), F.lit("tif"))).otherwise(F.array(F.lit("pdf"), F.lit("tif")))
    members = d.select(F.explode(exts).alias("ext"), "key").select(F.concat_ws(".", "key", "ext").alias("name"))
    cached = read(spark, sf, "labels").select(F.concat(F.lit("k"), F.col("doc_id")).alias("key"))
    return R.pair_members(members, ("pdf", "json"), cached)


@query("SELECT doc_id AS key, coalesce(text, '') AS gt FROM documents")
def ground_truth_text(spark, sf):
    pages = doc_pages(read(spark, sf, "documents")).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", F.split("text", "\n", -1).alias("text")))).alias("pages"))
    return R.gt_text(pages.withColumnRenamed("doc_id", "key"))


@query("SELECT 'd' || doc_id AS id, source AS engine, false AS is_gt FROM documents UNION ALL SELECT 'd' || doc_id, 'gt', true FROM documents")
def output_discovery(spark, sf):
    d = read(spark, sf, "documents")
    names = d.select(F.explode(F.array("source", F.lit("gt"))).alias("e"), "doc_id").select(F.concat(F.lit("/out/d"), F.col("doc_id"), F.lit("."), F.col("e"), F.lit(".html")).alias("path"))
    return R.discover_outputs(names.unionByName(d.select(F.concat(F.lit("/out/"), F.col("doc_id"), F.lit(".log")).alias("path"))))


@query("SELECT doc_id::VARCHAR AS id, 1700000000 + doc_id AS stamp, source AS title FROM documents")
def history_scan(spark, sf):
    d = read(spark, sf, "documents")
    records = d.select(F.lit(1).alias("version"), F.col("doc_id").cast("string").alias("id"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id")).alias("created_at"), F.col("source").alias("title"), F.col("text").alias("markdown"))
    path = scratch_folder(spark, "history")
    K.write_history(records, path)
    d.select(F.concat(F.lit('{"id": '), F.col("doc_id")).alias("value")).write.mode("append").text(path)  # records that broke off
    return R.read_history(spark, path).select("id", F.unix_seconds("created_at").alias("stamp"), "title")


@query("SELECT doc_id::VARCHAR AS key, source AS engine, (doc_id % 100) / 100.0::DOUBLE AS sim FROM documents")
def results_log(spark, sf):
    d = read(spark, sf, "documents")
    path = scratch_folder(spark, "results")
    K.append_results(d.select(F.col("doc_id").cast("string").alias("key"), F.col("source").alias("engine"), F.lit("ok").alias("status"), (F.col("doc_id") % 100 / 100.0).alias("sim")), path)
    d.select(F.lit("not json").alias("value")).write.mode("append").text(path)
    return R.read_results(spark, path).select("key", "engine", "sim")


@query(f"WITH {_results('r')} SELECT pathway, doc_id::VARCHAR AS doc_id, status, overall_percent, category FROM r")
def baseline_scan(spark, sf):
    r = results(spark, sf)
    entry = F.struct("status", "overall_percent", "elapsed_seconds", "category", "blocked_reason")
    path = scratch_folder(spark, "baseline")
    K.write_baselines(r.select("pathway", F.col("doc_id").cast("string").alias("doc_id"), entry.alias("entry")), path)
    return R.read_baseline(spark, f"{path}/*/*").select("pathway", "doc_id", "status", "overall_percent", "category")


@query("SELECT source AS pathway, 'shipping' AS release_status, lang AS format FROM (SELECT DISTINCT source, lang FROM documents)")
def registry_scan(spark, sf):
    d = read(spark, sf, "documents").groupBy("source").agg(F.array_sort(F.collect_set("lang")).alias("formats"))
    entry = F.struct(F.lit("o").alias("owner"), F.lit("r").alias("runner"), F.lit("shipping").alias("release_status"), F.col("formats").alias("valid_formats"), F.lit(True).alias("baseline_required"))
    path = scratch_folder(spark, "registry")
    K.write_registries(d.select(F.col("source").alias("pathway"), entry.alias("entry")), path)
    return R.read_registry(spark, f"{path}/*").select("pathway", "release_status", "format")


@query("SELECT doc_id AS book, unnest([0, 1])::BIGINT AS pos, unnest(['text/' || lang || ' 2.xhtml', 'cover.html']) AS path FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, unnest([0, 2])::BIGINT, unnest(['cover.html', 'text/' || lang || ' 2.xhtml']) FROM documents WHERE doc_id % 2 = 1")
def book_reading_order(spark, sf):
    items = F.concat(
        F.lit('<item id="c" href="../cover.html" media-type="text/html"/><item id="i" href="i.png" media-type="image/png"/><item id="t" href="../text/./'), F.col("lang"), F.lit('%202.xhtml#top" media-type="application/xhtml+xml"/>')
    )
    spine = F.when(F.col("doc_id") % 2 == 0, '<spine><itemref idref="t"/><itemref idref="c"/></spine>').otherwise("")
    content = F.concat(F.lit("<package><manifest>"), items, F.lit("</manifest>"), spine, F.lit("</package>"))
    return R.reading_order(read(spark, sf, "documents").select(F.col("doc_id").alias("book"), F.lit("OPS/package.opf").alias("path"), content.alias("content")))


@query("""SELECT doc_id, '---' || chr(10) || 'title: "' || source || '"' || chr(10) || 'source: "' || doc_id || '.txt"' || chr(10) || 'converted: "2023-11-14T22:13:20Z"' || chr(10) || 'language: "' || lang || '"' || chr(10) || 'type: "general"' || chr(10) || 'pipeline: "fast"' || chr(10) || 'pages: 1' || chr(10)
 || 'word_count: ' || len(list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda t: regexp_matches(t, '[\\p{L}\\p{N}]'))) || chr(10) || '---' || chr(10) || chr(10) || coalesce(text, '') AS text, 'md' AS file_ext FROM documents""")
def document_sink(spark, sf):
    d = read(spark, sf, "documents").select(
        "doc_id", F.col("source").alias("title"), F.concat(F.col("doc_id"), F.lit(".txt")).alias("source_name"), F.timestamp_seconds(F.lit(1_700_000_000)).alias("created_at"),
        F.col("lang").alias("language"), F.lit("general").alias("type"), F.lit("fast").alias("pipeline"), F.lit(1).alias("pages"), F.col("text").alias("markdown"),
    )
    path = scratch_folder(spark, "rendered")
    K.write_documents(d, path, "markdownWithFrontmatter")
    return spark.read.parquet(path).select("doc_id", "text", "file_ext")


@query("""SELECT doc_id, coalesce(text, '') AS markdown, 'T ' || doc_id AS title, 'json' AS file_ext FROM documents""")
def document_json(spark, sf):
    """What readers of the JSON mode get back."""
    d = read(spark, sf, "documents").select("doc_id", F.concat(F.lit("T "), F.col("doc_id")).alias("title"), F.col("text").alias("markdown"), *(F.lit("x").alias(c) for c in ("source_name", "language", "type", "pipeline")), F.lit("2024-01-01").cast("timestamp").alias("created_at"), F.lit(1).alias("pages"))
    path = scratch_folder(spark, "sink")
    K.write_documents(d, path, "json")
    payload = F.from_json("text", "markdown string, title string")
    return spark.read.parquet(path).select("doc_id", payload["markdown"].alias("markdown"), payload["title"].alias("title"), "file_ext")


@query(f"WITH {_results('r')}, {_results('n', 9)} SELECT pathway, doc_id, overall_percent FROM n WHERE pathway < 'src2' UNION ALL SELECT pathway, doc_id, overall_percent FROM r WHERE pathway >= 'src2'")
def baseline_replacement(spark, sf):
    path = scratch_folder(spark, "baselines")
    columns = ("pathway", "doc_id", "overall_percent")
    K.replace_baseline(results(spark, sf).select(*columns), path)
    K.replace_baseline(results(spark, sf, 9).filter("pathway < 'src2'").select(*columns), path)
    return spark.read.parquet(path).select(*columns)


# Jobs


def _inputs(spark, sf):
    """Every document as plain text, as a table of comma-separated words for one in three, and every page."""
    docs = read(spark, sf, "documents")
    texts = docs.filter("doc_id % 3 > 0").select(F.concat(F.lit("d"), F.col("doc_id")).alias("doc_id"), F.lit("txt").alias("ext"), "text")
    tables = docs.filter("doc_id % 3 = 0").select(F.concat(F.lit("d"), F.col("doc_id")).alias("doc_id"), F.lit("csv").alias("ext"), F.regexp_replace(X.col("text"), " +", ",").alias("text"))
    pages = read(spark, sf, "pages").select(F.concat(F.lit("p"), F.col("page_id")).alias("doc_id"), F.lit("html").alias("ext"), F.col("html").alias("text"))
    return texts.unionByName(tables).unionByName(pages)


@query(None)
def convert_corpus(spark, sf):
    out = jobs.convert(_inputs(spark, sf), "json")
    return out.select("doc_id", "kind", "pathway", "language", "type", "title", "overall", "retention", "retention_ratio", "warnings", "passed", F.length("text").alias("n"), "file_ext")


@query(f"""WITH {SAMPLE}, {PER_PAGE}, r AS (SELECT *, avg_chars < 80 AND avg_lines > 8 AS is_scan, table_like OR rtl OR (avg_lines > 45 AND short_ratio > 0.45) AS layout FROM evidence)
 SELECT doc_id, CASE WHEN is_scan THEN 'visionOCR' WHEN layout THEN 'enhanced' ELSE 'pdfKit' END AS pathway, CASE WHEN is_scan THEN 'scannedOrUnknown' WHEN layout THEN 'digitalComplex' ELSE 'native' END AS bucket,
  CASE WHEN is_scan THEN 0.86 WHEN layout THEN 0.78 WHEN avg_lines <= 14 AND (numeric_ratio >= 0.35 OR axis) THEN 0.74 ELSE 0.70 END::DOUBLE AS confidence, CASE WHEN rtl THEN 'vision' ELSE 'model' END AS engine,
  '' AS hints, CASE WHEN is_scan THEN 'ai_required' WHEN layout THEN 'ai_recommended' ELSE 'basic' END AS advice FROM r""")
def triage_documents(spark, sf):
    return jobs.triage(doc_pages(read(spark, sf, "documents"))).withColumn("hints", F.array_join("hints", ";"))


def _evaluated(spark, sf):
    """Neighbouring passages as outputs of an engine that is done with every fifth; the last passage has no output."""
    b = read(spark, sf, "benchmark").select(F.col("item_id").alias("key"), "text")
    outputs = passage_pairs(spark, sf).select(F.col("item_id").alias("key"), F.col("text").alias("markdown"))
    done = b.select("key", F.lit("alpha").alias("engine"), F.when(F.col("key") % 5 == 0, "ok").otherwise("timeout").alias("status"))
    confidences = b.select("key", (F.length(X.col("text")) % 100 / 100.0).alias("confidence"))
    pairs = b.withColumnRenamed("text", "truth").join(outputs.withColumnRenamed("markdown", "other"), "key", "left")
    tables = pairs.select("key", _word_rows("truth").alias("truth"), F.when(F.col("other").isNotNull(), _word_rows("other")).alias("other"))
    questions = b.select("key", F.lit("what is said?").alias("question"), F.element_at(F.split(X.col("text"), " ", -1), 1).alias("answer"))
    return jobs.evaluate(b, outputs, done, "alpha", b.count(), questions, confidences, tables)


@query(None)
def evaluation_run(spark, sf):
    """The rows that a run adds to the result log, read back from it."""
    path = scratch_folder(spark, "results")
    K.append_results(_evaluated(spark, sf).rows.select("key", "engine", "status", "gt_words", "md_words", "sim", "error"), path)
    return R.read_results(spark, path)


_EVALUATED = "p AS (SELECT b.item_id, b.reference, x.text FROM b LEFT JOIN pairs x USING (item_id) WHERE b.item_id % 5 > 0 OR x.item_id IS NULL)"


@query(rf"""WITH {PAIRS}, {_EVALUATED}, t AS (SELECT *, coalesce(text, '') AS out, list_distinct({sql_tokens('reference')}) AS rs, list_distinct({sql_tokens("coalesce(text, '')")}) AS hs FROM p)
 SELECT item_id AS key, 'alpha' AS engine, CASE WHEN text IS NULL THEN 'missing' ELSE 'ok' END AS status, {sql_meaningful_words('reference')} AS gt_words, {sql_meaningful_words('out')} AS md_words,
  len(list_intersect(rs, hs)) / len(rs) AS completeness, CASE WHEN out = '' THEN 1.0 ELSE {sql_distance('reference', 'out')} / greatest(length(reference), length(out)) END AS ned FROM t""")
def evaluation_rows(spark, sf):
    """The measures of every pair of a run that SQL can say."""
    return _evaluated(spark, sf).rows.select("key", "engine", "status", "gt_words", "md_words", "completeness", "ned")


@query(rf"""WITH {PAIRS}, {_EVALUATED}, q AS (SELECT item_id, reference, coalesce(text, '') AS out FROM p)
 SELECT count(*) AS total, avg(length(reference) % 100 / 100.0) AS avg_confidence, min(length(reference) % 100 / 100.0) AS min_confidence, max(length(reference) % 100 / 100.0) AS max_confidence, avg(least(1.0, len({sql_tokens('out')}) / 50.0)) AS avg_coverage FROM q""")
def evaluation_recognition(spark, sf):
    return _evaluated(spark, sf).recognition.select("total", "avg_confidence", "min_confidence", "max_confidence", "avg_coverage")


@query(None)
def evaluation_tables(spark, sf):
    """The leaderboard of a run over tables made of the passages' sentences and words."""
    return _evaluated(spark, sf).tables


@query(f"""WITH RECURSIVE {PAIRS}, p AS (SELECT b.item_id, b.reference, coalesce(x.text, '') AS text FROM b LEFT JOIN pairs x USING (item_id) WHERE b.item_id % 5 > 0 OR x.item_id IS NULL), {sql_word_rates('p')},
 c AS (SELECT p.*, least(1.0, {sql_distance('reference', 'text')} / length(reference)) AS cer, least(1.0, wer) AS wer, list_distinct({sql_tokens('reference')}) AS rs, list_distinct({sql_tokens('text')}) AS hs FROM p JOIN word_rates USING (item_id))
 SELECT count(*) AS total, count(*) AS successful, 0::BIGINT AS failed, avg(cer) AS avg_cer, min(cer) AS min_cer, max(cer) AS max_cer, avg(wer) AS avg_wer, avg(len(list_intersect(rs, hs)) / len(rs)) AS avg_completeness, (1 - avg(cer)) * 100 AS overall_percent FROM c""")
def evaluation_summary(spark, sf):
    """Error rates of what a run still had to compare."""
    return _evaluated(spark, sf).fidelity


@query(None)
def structure_repair(spark, sf):
    return jobs.repair(structured(read(spark, sf, "documents"))).select("doc_id", "before", "after", F.sha2("markdown", 256).alias("digest"))

