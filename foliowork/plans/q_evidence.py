"""Queries over evidence, quality and rules, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliowork.functions.text import col, trim_all
from foliowork.llm.shared import broadcast_if_small
from foliowork.operators import evidence as E
from foliowork.operators import quality as Q
from foliowork.operators import rules as R
from foliowork.plans.tables import PAGES, STRUCTURED, book, doc_pages, read, sql_lines, sql_set, sql_tokens, sql_trim, structured
from foliowork.sources.scratch import scratch_folder

query, QUERIES, ORACLES = book()
_T = "coalesce(text, '')"


def _pages(spark, sf):
    return doc_pages(read(spark, sf, "documents"))


SAMPLE = f"""{PAGES}, counted AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS page_count FROM doc_pages),
 sampled AS (SELECT * FROM counted WHERE page IN (0, page_count // 2, page_count - 1))"""


@query(f"WITH {SAMPLE} SELECT doc_id, page, page_count FROM sampled")
def page_sampling(spark, sf):
    return E.sample_pages(_pages(spark, sf)).select("doc_id", "page", "page_count")


PER_PAGE = f"""own AS (SELECT doc_id, page_count, length({sql_trim('text')}) AS chars, list_filter(list_transform({sql_lines('text')}, lambda t: {sql_trim('t')}), lambda t: t <> '') AS ls FROM sampled),
 pp AS (SELECT doc_id, page_count, chars, len(ls) AS n, len(list_filter(ls, lambda t: length(t) <= 32)) AS short, len(list_filter(ls, lambda t: regexp_matches(t, '^-?\\d+(\\.\\d+)?$'))) AS num,
  len(list_filter(ls, lambda t: contains(t, '|') OR contains(t, chr(9)) OR regexp_matches(t, '\\S\\s{{2,}}\\S\\s{{2,}}\\S'))) AS tables, array_to_string(ls, ' ') AS j FROM own),
 evidence AS (SELECT doc_id, max(page_count) AS page_count, count(*) AS sampled_pages, (sum(chars) // count(*))::BIGINT AS avg_chars, (sum(n) // count(*))::BIGINT AS avg_lines,
  CASE WHEN sum(n) > 0 THEN sum(short) / sum(n) ELSE 0.0 END AS short_ratio, CASE WHEN sum(n) > 0 THEN sum(num) / sum(n) ELSE 0.0 END AS numeric_ratio,
  bool_or(contains(j, '[') OR contains(j, ']') OR contains(j, '/') OR contains(j, 'MeV')) AS axis, bool_or(regexp_matches(j, '[\\x{{0590}}-\\x{{05FF}}\\x{{0600}}-\\x{{06FF}}\\x{{0750}}-\\x{{077F}}\\x{{08A0}}-\\x{{08FF}}]')) AS rtl,
  sum(tables)::BIGINT AS table_lines, sum(tables) >= 2 AS table_like FROM pp GROUP BY doc_id)"""


@query(f"WITH {SAMPLE}, {PER_PAGE} SELECT * FROM evidence")
def page_evidence(spark, sf):
    return E.page_evidence(E.sample_pages(_pages(spark, sf)))


def _full_evidence(spark, sf):
    """Page evidence with what an inspection of the page pictures would add, as fixed functions of the id."""
    d = F.col("doc_id")
    base = E.page_evidence(E.sample_pages(_pages(spark, sf))).join(read(spark, sf, "documents").select("doc_id", F.col("lang").alias("language")), "doc_id")
    return base.withColumns(
        {
            "avg_chars": F.when(d % 6 == 0, d % 160).otherwise(F.col("avg_chars")), "vision": d % 13 != 0, "seen_lines": d % 20, "seen_confidence": (d % 10) / 10.0, "pages_with_text": d % 3, "columns": 1 + F.floor(d / 7) % 3,
            "dense_pages": F.floor(d / 5) % 2, "rotated": (d % 5 == 0).cast("int"), "oversized": (d % 7 == 0).cast("int"), "rectangles": F.lit(0), "skew": (d % 4).cast("double"), "mixed": d % 11 == 0,
        }
    )


_FULL = f"""{SAMPLE}, {PER_PAGE}, e AS (SELECT evidence.* REPLACE (CASE WHEN doc_id % 6 = 0 THEN doc_id % 160 ELSE avg_chars END AS avg_chars), lang AS language, doc_id % 13 <> 0 AS vision, doc_id % 20 AS seen_lines, (doc_id % 10) / 10.0::DOUBLE AS seen_confidence, doc_id % 3 AS pages_with_text,
 1 + (doc_id // 7) % 3 AS columns, (doc_id // 5) % 2 AS dense_pages, (doc_id % 5 = 0)::INT AS rotated, (doc_id % 7 = 0)::INT AS oversized, 0 AS rectangles, (doc_id % 4)::DOUBLE AS skew, doc_id % 11 = 0 AS mixed
 FROM evidence JOIN documents USING (doc_id)), f AS (SELECT *, avg_chars < 80 AND vision AND pages_with_text > 0 AND seen_lines > 8 AND seen_confidence > 0.35 AS is_scan, avg_lines > 45 AND short_ratio > 0.45 AS packed FROM e),
 r AS (SELECT *, CASE WHEN is_scan THEN 'visionOCR' WHEN table_like OR rtl OR columns > 1 OR dense_pages > 0 OR packed THEN 'enhanced' ELSE 'pdfKit' END AS pathway,
  CASE WHEN is_scan THEN 0.86 WHEN table_like OR rtl OR columns > 1 OR dense_pages > 0 OR packed THEN 0.78 WHEN sampled_pages > 0 AND avg_lines <= 14 AND (numeric_ratio >= 0.35 OR axis) THEN 0.74 ELSE 0.70 END AS confidence FROM f),
 b AS (SELECT *, CASE pathway WHEN 'visionOCR' THEN 'scannedOrUnknown' WHEN 'enhanced' THEN 'digitalComplex' ELSE 'native' END AS bucket FROM r)"""


def _evidence(df):
    return F.struct(*df.columns)


@query(f"""WITH {_FULL} SELECT doc_id, pathway, confidence, bucket, array_to_string(CASE WHEN is_scan THEN list_filter(['low native text', 'image text detected', CASE WHEN rotated > 0 OR oversized > 0 OR rectangles > 0 OR skew >= 2 THEN 'image normalization available' END], lambda x: x IS NOT NULL)
 WHEN pathway = 'enhanced' THEN list_filter([CASE WHEN table_like THEN 'table-like text' END, CASE WHEN rtl THEN 'right-to-left text' END, CASE WHEN columns > 1 THEN 'multi-column layout' END, CASE WHEN dense_pages > 0 THEN 'dense text layout' END, CASE WHEN packed THEN 'dense multi-column layout' END], lambda x: x IS NOT NULL)
 WHEN confidence = 0.74 THEN ['short figure text'] ELSE ['digital text'] END, ';') AS reasons FROM b""")
def scan_recommendation(spark, sf):
    e = _full_evidence(spark, sf)
    r = e.select("doc_id", R.recommend(_evidence(e)).alias("r"))
    return r.select("doc_id", "r.pathway", "r.confidence", "r.bucket", F.array_join("r.reasons", ";").alias("reasons"))


@query(f"WITH {_FULL} SELECT doc_id, CASE WHEN vision AND seen_confidence >= 0.6 AND NOT rtl AND NOT mixed AND columns < 3 AND language IN {R.LATIN} THEN 'model' ELSE 'vision' END AS engine FROM e")
def engine_choice(spark, sf):
    e = _full_evidence(spark, sf)
    return e.select("doc_id", R.engine(_evidence(e)).alias("engine"))


@query(f"""WITH {_FULL} SELECT doc_id, array_to_string(list_filter([CASE WHEN oversized > 0 THEN 'bounded image render' END, CASE WHEN rotated > 0 THEN 'normalize page rotation' END, CASE WHEN rectangles > 0 OR skew >= 2 THEN 'crop or deskew document image' END,
 CASE WHEN columns > 1 THEN 'preserve multi-column layout' END, CASE WHEN dense_pages > 0 THEN 'inspect dense text layout' END, CASE WHEN mixed THEN 'preserve mixed-language text' END], lambda x: x IS NOT NULL), ';') AS hints FROM e""")
def preprocessing_hints(spark, sf):
    e = _full_evidence(spark, sf)
    return e.select("doc_id", F.array_join(R.hints(_evidence(e)), ";").alias("hints"))


_EXTS = ("pdf", "png", "mp3", "html", "docx", "xyz")
_EXT_SQL = f"list_extract({list(_EXTS)}, (doc_id % 6 + 1)::INT)"


def _ext():
    return F.element_at(F.array(*map(F.lit, _EXTS)), (F.col("doc_id") % 6 + 1).cast("int"))


@query(f"""WITH {_FULL}, x AS (SELECT *, {_EXT_SQL} AS ext FROM e), y AS (SELECT doc_id, CASE WHEN ext = 'pdf' THEN CASE WHEN avg_chars < 80 AND seen_lines > 8 AND seen_confidence > 0.35 THEN ['scannedOrUnknown', 'imageText', '0.86'] WHEN avg_chars < 80 AND seen_lines = 0 THEN ['scannedOrUnknown', 'imageText', '0.58']
  WHEN table_lines >= greatest(2, sampled_pages) OR rtl OR packed2 THEN ['digitalComplex', 'enhanced', '0.78'] ELSE ['native', 'native', '0.7'] END WHEN ext = 'png' THEN ['scannedOrUnknown', 'imageText', CASE WHEN seen_lines > 3 AND seen_confidence > 0.25 THEN '0.82' ELSE '0.58' END]
  WHEN ext = 'mp3' THEN ['native', 'native', '0.72'] WHEN ext IN ('html', 'docx') THEN ['digitalComplex', 'enhanced', '0.66'] ELSE ['scannedOrUnknown', 'imageText', '0.4'] END AS a FROM (SELECT *, avg_lines > 45 AND short_ratio > 0.45 AS packed2 FROM x))
 SELECT doc_id, a[1] AS bucket, a[2] AS recommendation, a[3]::DOUBLE AS confidence FROM y""")
def corpus_buckets(spark, sf):
    e = _full_evidence(spark, sf)
    return e.select("doc_id", R.bucket_corpus(_ext(), _evidence(e)).alias("b")).select("doc_id", "b.*")


@query(f"WITH {_FULL} SELECT bucket, pathway, count(*) AS n FROM b GROUP BY CUBE (bucket, pathway)")
def bucket_counts(spark, sf):
    e = _full_evidence(spark, sf)
    r = e.select(R.recommend(_evidence(e)).alias("r")).select("r.bucket", "r.pathway")
    return r.cube("bucket", "pathway").agg(F.count("*").alias("n"))


@query(f"""WITH {_FULL} SELECT doc_id, CASE bucket WHEN 'native' THEN 'basic' WHEN 'digitalComplex' THEN 'ai_recommended' ELSE 'ai_required' END AS advice, floor(confidence * 100)::BIGINT AS score, doc_id % 9 = 0 AND bucket <> 'native' AS language_warning FROM b""")
def complexity_advice(spark, sf):
    e = _full_evidence(spark, sf)
    r = e.select("doc_id", R.recommend(_evidence(e)).alias("r"))
    lang = F.when(F.col("doc_id") % 9 == 0, "ja").otherwise("en")
    return r.select("doc_id", R.advise(F.col("r.bucket"), F.col("r.confidence"), lang).alias("a")).select("doc_id", "a.*")


@query(f"""WITH {_FULL} SELECT doc_id, CASE pathway WHEN 'visionOCR' THEN 'scannedDocument' ELSE 'digitalDocument' END AS kind, CASE WHEN pathway = 'enhanced' AND doc_id % 2 = 0 THEN 'enhanced' WHEN pathway = 'visionOCR' AND doc_id % 3 = 0 THEN 'ai' ELSE 'native' END AS capability,
 CASE WHEN pathway = 'enhanced' AND doc_id % 2 = 0 THEN 'enhanced' WHEN pathway = 'visionOCR' THEN CASE WHEN doc_id % 3 = 0 THEN 'ai' ELSE 'visionOCR' END ELSE 'pdfKit' END AS pathway FROM b""")
def pdf_route(spark, sf):
    e = _full_evidence(spark, sf)
    r = e.select("doc_id", R.recommend(_evidence(e))["pathway"].alias("p"))
    return r.select("doc_id", R.route_pdf(F.col("p"), F.col("doc_id") % 2 == 0, F.col("doc_id") % 3 == 0).alias("r")).select("doc_id", "r.*")


@query(f"""SELECT doc_id, CASE WHEN doc_id % 4 = 0 OR w >= 10 THEN 'scannedDocument' ELSE 'photoOrArtwork' END AS kind, CASE WHEN (doc_id % 4 = 0 OR w >= 10) AND doc_id % 3 = 0 THEN 'ai' ELSE 'native' END AS capability,
 CASE WHEN doc_id % 4 = 0 OR w >= 10 THEN CASE WHEN doc_id % 3 = 0 THEN 'ai' ELSE 'visionOCR' END ELSE 'metadata' END AS pathway FROM (SELECT doc_id, len({sql_tokens(_T)}) AS w FROM documents)""")
def image_route(spark, sf):
    from foliowork.functions.text import tokens

    d = read(spark, sf, "documents")
    words = F.size(tokens(col("text")))
    return d.select("doc_id", R.route_image(F.when(F.col("doc_id") % 4 == 0, 2).otherwise(1), words, F.col("doc_id") % 3 == 0).alias("r")).select("doc_id", "r.*")


_FORMATS = tuple("pdf html txt mp3 flac docx xlsx zip png heic abc csv epub".split())
_FORMAT_SQL = f"list_extract({list(_FORMATS)}, (doc_id % {len(_FORMATS)} + 1)::INT)"


def _formats(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.element_at(F.array(*map(F.lit, _FORMATS)), (F.col("doc_id") % len(_FORMATS) + 1).cast("int")).alias("ext"))


_MATRIX = "caps AS (SELECT tool, support, guarded, unnest(string_split(f, ' ')) AS ext FROM (VALUES " + ", ".join(f"('{t}', '{s}', {str(g).lower()}, '{f}')" for t, s, g, f in R.CAPABILITIES) + ") v(tool, support, guarded, f))"


@query(f"WITH {_MATRIX}, d AS (SELECT doc_id, {_FORMAT_SQL} AS ext FROM documents) SELECT doc_id, ext, tool, support, guarded FROM d JOIN caps USING (ext)")
def format_capabilities(spark, sf):
    return R.capabilities(_formats(spark, sf))


@query(f"WITH {_MATRIX}, d AS (SELECT doc_id, {_FORMAT_SQL} AS ext FROM documents) SELECT doc_id, ext FROM d WHERE ext IN {R.ACCEPTED} AND ext IN (SELECT ext FROM caps)")
def accepted_formats(spark, sf):
    return R.accepts(_formats(spark, sf))


@query(f"""WITH d AS (SELECT doc_id, {_FORMAT_SQL} AS ext FROM documents) SELECT doc_id, CASE WHEN ext IN ('mp3', 'flac') THEN 'audioVideo' WHEN ext IN ('html', 'txt', 'docx', 'csv', 'xlsx', 'zip', 'epub') THEN 'structuredDocument' WHEN ext = 'pdf' THEN 'pdf' WHEN ext IN ('png', 'heic') THEN 'image' END AS kind,
 CASE WHEN ext IN ('mp3', 'flac', 'html', 'txt', 'docx', 'csv') THEN 'native' WHEN ext IN ('xlsx', 'zip', 'epub') THEN 'enhanced' END AS capability,
 CASE WHEN ext IN ('mp3', 'flac') THEN 'metadata' WHEN ext = 'html' THEN 'nativeHTML' WHEN ext IN ('txt', 'csv') THEN 'nativeText' WHEN ext = 'docx' THEN 'nativeOffice' WHEN ext IN ('xlsx', 'zip', 'epub') THEN 'enhanced' END AS pathway FROM d""")
def content_kinds(spark, sf):
    return _formats(spark, sf).select("doc_id", R.classify_content("ext").alias("r")).select("doc_id", "r.kind", "r.capability", "r.pathway")


@query("""SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, CASE WHEN p > CASE WHEN l_linenumber % 2 = 0 THEN 80 ELSE 1000 END THEN 'tooManyPages' WHEN w <= 0 OR h <= 0 THEN 'invalidPageBounds' WHEN w > 14400 OR h > 14400 OR w * h > 5e7 THEN 'pageTooLarge' ELSE 'ok' END AS verdict
 FROM (SELECT l_orderkey, l_linenumber, l_quantity * 25 AS p, (l_extendedprice - 5000)::DOUBLE / 4 AS w, 3000.0::DOUBLE AS h FROM lineitem)""")
def size_limits(spark, sf):
    li = read(spark, sf, "lineitem")
    verdict = R.enforce_limits(F.col("l_quantity") * 25, F.col("l_linenumber") % 2 == 0, (F.col("l_extendedprice") - 5000).cast("double") / 4, F.lit(3000.0))
    return li.select("l_orderkey", "l_linenumber", verdict.alias("verdict"))


@query("""WITH a AS (SELECT l_orderkey, l_linenumber, greatest(floor(l_extendedprice::DOUBLE / 20 * (150.0 / 72))::BIGINT, 1) AS w, greatest(floor(l_quantity::DOUBLE * 60 * (150.0 / 72))::BIGINT, 1) AS h FROM lineitem),
 b AS (SELECT *, least(1.0, 4096 / greatest(w, h)) AS r FROM a), c AS (SELECT l_orderkey, l_linenumber, CASE WHEN r < 1 THEN greatest(floor(w * r)::BIGINT, 1) ELSE w END AS w, CASE WHEN r < 1 THEN greatest(floor(h * r)::BIGINT, 1) ELSE h END AS h FROM b), d AS (SELECT *, sqrt(16000000 / (w * h)) AS q FROM c)
 SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, CASE WHEN q < 1 THEN greatest(floor(w * q)::BIGINT, 1) ELSE w END AS width, CASE WHEN q < 1 THEN greatest(floor(h * q)::BIGINT, 1) ELSE h END AS height FROM d""")
def render_sizes(spark, sf):
    li = read(spark, sf, "lineitem")
    size = R.render_size(F.col("l_extendedprice").cast("double") / 20, F.col("l_quantity").cast("double") * 60)
    return li.select("l_orderkey", "l_linenumber", size.alias("s")).select("l_orderkey", "l_linenumber", "s.*")


@query(r"""SELECT doc_id, name, (name LIKE '%.pdf' OR contains(name, 'src1')) AND NOT (regexp_matches(name, '^.*\.(md|markdown|json|tmp|download|part|crdownload)$') OR name LIKE '~$%') AS watched
 FROM (SELECT doc_id, lower(source) || '-' || doc_id || list_extract(['.pdf', '.md', '.tmp', '.docx'], (doc_id % 4 + 1)::INT) AS name FROM documents)""")
def name_rules(spark, sf):
    suffix = F.element_at(F.array(*map(F.lit, (".pdf", ".md", ".tmp", ".docx"))), (F.col("doc_id") % 4 + 1).cast("int"))
    d = read(spark, sf, "documents").select("doc_id", F.concat(F.lower("source"), F.lit("-"), F.col("doc_id"), suffix).alias("name"))
    return d.withColumn("watched", R.match_rules("name", "*.pdf, src1"))


_MESSAGES = ("", "File is Password protected", "No Metal device found", "boom")
_MESSAGE_SQL = f"list_extract({list(_MESSAGES)}, (event_id % 4 + 1)::INT)"


@query(f"""SELECT event_id, CASE WHEN s <> '' AND s NOT IN ('failed', 'error') THEN s WHEN event_id % 4 = 1 THEN 'expected_blocked' WHEN event_id % 4 = 2 THEN 'environment_blocked' WHEN event_id % 4 = 3 THEN 'failed' ELSE 'scored' END AS status
 FROM (SELECT event_id, CASE event_type WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'failed' ELSE '' END AS s FROM events)""")
def status_normalisation(spark, sf):
    e = read(spark, sf, "events")
    status = F.when(F.col("event_type") == "purchase", "complete").when(F.col("event_type") == "error", "failed").otherwise("")
    message = F.element_at(F.array(*map(F.lit, _MESSAGES)), (F.col("event_id") % 4 + 1).cast("int"))
    return e.select("event_id", R.normalise_status(status, message, F.lit(None).cast("string")).alias("status"))


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'file.password' WHEN 2 THEN 'system.memory-pressure' WHEN 3 THEN 'engine.failed' ELSE 'conversion.failed' END AS error_code FROM events""")
def error_codes(spark, sf):
    names = F.array(F.lit(None).cast("string"), *map(F.lit, ("passwordRequired", "memoryPressure", "engineFailed", "something else")))
    e = read(spark, sf, "events").select("event_id", F.element_at(names, (F.col("event_id") % 5 + 1).cast("int")).alias("error"))
    return R.error_code(e).select("event_id", "error_code")


@query("""SELECT doc_id, 'open [redacted path], then [redacted file] with conversion runtime by ' || source AS message FROM documents""")
def log_redaction(spark, sf):
    message = F.concat(F.lit("open /Users/me/x"), F.col("doc_id"), F.lit("/y.pdf, then a"), F.col("doc_id"), F.lit(".docx with pdfium by "), F.col("source"))
    return read(spark, sf, "documents").select("doc_id", R.redact(message).alias("message"))


@query("""SELECT conv_id, turn, CASE WHEN v IN (1, 2) AND f <> '' AND NOT contains(f, '/') AND f <> '..' AND m IN ('markdown', 'json') AND (NOT e OR ai) THEN 'accepted' ELSE 'inputRejected' END AS status FROM (SELECT conv_id, turn, turn % 4 AS v,
 CASE WHEN conv_id % 5 = 0 THEN '../x.pdf' WHEN conv_id % 5 = 1 THEN '' ELSE conv_id || '.pdf' END AS f, CASE WHEN turn % 3 = 2 THEN 'html' WHEN turn % 3 = 1 THEN 'json' ELSE 'markdown' END AS m, conv_id % 2 = 0 AS ai, conv_id % 3 = 0 AS e FROM conversations)""")
def request_validity(spark, sf):
    c, t = F.col("conv_id"), F.col("turn")
    file = F.when(c % 5 == 0, "../x.pdf").when(c % 5 == 1, "").otherwise(F.concat(c.cast("string"), F.lit(".pdf")))
    mode = F.when(t % 3 == 2, "html").when(t % 3 == 1, "json").otherwise("markdown")
    status = R.validate_requests(t % 4, file, mode, c % 2 == 0, F.when(c % 3 == 0, "engine"))
    return read(spark, sf, "conversations").select("conv_id", "turn", status.alias("status"))


@query(f"""WITH l AS (SELECT doc_id, {sql_trim(f'unnest({sql_lines(_T)})')} AS line FROM documents), lc AS (SELECT doc_id, max(n) AS n FROM (SELECT doc_id, line, count(*) AS n FROM l WHERE line <> '' GROUP BY ALL) GROUP BY doc_id),
 w AS (SELECT doc_id, {sql_tokens(_T)} AS w FROM documents), g AS (SELECT doc_id, array_to_string(w[i:i+11], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM w)), gc AS (SELECT doc_id, max(n) AS n FROM (SELECT doc_id, gram, count(*) AS n FROM g GROUP BY ALL) GROUP BY doc_id)
 SELECT d.doc_id, array_to_string(list_filter([CASE WHEN {sql_trim(_T)} = '' THEN 'empty' END, CASE WHEN len(w.w) > 3500 THEN 'too many words' END, CASE WHEN strlen({_T}) > 120000 THEN 'too many bytes' END, CASE WHEN lc.n >= 6 THEN 'repeated line' END, CASE WHEN gc.n >= 6 THEN 'repeated phrase' END], lambda x: x IS NOT NULL), ';') AS reasons
 FROM documents d JOIN w ON w.doc_id = d.doc_id LEFT JOIN lc ON lc.doc_id = d.doc_id LEFT JOIN gc ON gc.doc_id = d.doc_id""")
def runaway_output(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.array_join(R.degenerate("text"), ";").alias("reasons"))


@query("""SELECT page_id, list_extract(['iCloudDrive', 'fileProvider', 'externalVolume', 'networkVolume', 'local'], (page_id % 5 + 1)::INT) AS kind FROM pages""")
def storage_kinds(spark, sf):
    roots = F.array(*map(F.lit, ("/Users/a/Library/Mobile Documents/", "/Users/a/Library/CloudStorage/B/", "/Volumes/X/", "/net/host/", "/Users/a/")))
    path = F.concat(F.element_at(roots, (F.col("page_id") % 5 + 1).cast("int")), F.col("page_id"))
    return read(spark, sf, "pages").select("page_id", R.storage_kind(path).alias("kind"))


_STAGE = "CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'analysing' WHEN 'click' THEN 'processing' WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'failed' END"


def stage_column():
    e = F.col("event_type")
    return F.when(e == "signup", "queued").when(e == "view", "analysing").when(e == "click", "processing").when(e == "purchase", "complete").when(e == "error", "failed")


@query(f"""SELECT event_id, CASE s WHEN 'queued' THEN 0.0 WHEN 'analysing' THEN CASE WHEN f IS NULL THEN 0.12 ELSE 0.06 + (0.12 - 0.06) * f END WHEN 'processing' THEN CASE WHEN f IS NULL THEN 0.55 ELSE 0.20 + (0.88 - 0.20) * f END WHEN 'complete' THEN 1.0 WHEN 'failed' THEN 1.0 END::DOUBLE AS progress
 FROM (SELECT event_id, {_STAGE} AS s, CASE WHEN event_id % 3 > 0 THEN least(greatest(value / 100, 0.0), 1.0) END AS f FROM events)""")
def stage_progress(spark, sf):
    fraction = F.when(F.col("event_id") % 3 > 0, F.col("value") / 100)
    return read(spark, sf, "events").select("event_id", R.progress(stage_column(), fraction).alias("progress"))


_NOUNS, _VERBS = ("tion", "ment", "heit", "ness"), ("is", "was", "are", "be", "est")


@query(rf"""WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents), l AS (SELECT doc_id, line_no, {sql_trim('line')} AS t FROM (SELECT doc_id, generate_subscripts(ls, 1) - 1 AS line_no, unnest(ls) AS line FROM s)), w AS (SELECT *, list_transform({sql_tokens('lower(t)')}, lambda w: regexp_replace(w, '[^\p{{L}}]', '', 'g')) AS w FROM l),
 f AS (SELECT *, len(list_intersect(w, {list(_VERBS)})) > 0 AS verb, len(list_filter(w, lambda x: regexp_matches(x, '(tion|ment|heit|ness)$'))) > 0 AS noun FROM w),
 c AS (SELECT *, CASE WHEN t = '' THEN 0.0 ELSE least(greatest(round(0.5 + CASE WHEN noun AND NOT verb AND length(t) < 60 THEN 0.3 ELSE 0.0 END - CASE WHEN verb THEN 0.3 ELSE 0.0 END - CASE WHEN length(t) > 100 THEN 0.2 ELSE 0.0 END - CASE WHEN regexp_matches(t, '[.,]$') THEN 0.2 ELSE 0.0 END + CASE WHEN regexp_matches(t, '^\p{{Lu}}') THEN 0.1 ELSE 0.0 END, 6), 0.0), 1.0) END::DOUBLE AS c FROM f)
 SELECT doc_id, line_no, c AS confidence, CASE WHEN t = '' THEN 0 WHEN c > 0.7 AND length(t) < 40 THEN 1 WHEN c > 0.5 AND length(t) < 80 THEN 2 ELSE 3 END::BIGINT AS level FROM c""")
def heading_confidence(spark, sf):
    """Every line of a document."""
    lines = read(spark, sf, "documents").select("doc_id", F.posexplode(F.split(col("text"), "\n", -1)).alias("line_no", "line"))
    return lines.select("doc_id", "line_no", R.heading_confidence("line", _NOUNS, _VERBS).alias("h")).select("doc_id", "line_no", "h.*")


@query(f"WITH {PAGES} SELECT doc_id, (sum(length(text)) // count(*))::BIGINT AS avg_chars, sum(length(text)) // count(*) < 100 AS scanned FROM doc_pages GROUP BY doc_id")
def scanned_flag(spark, sf):
    return E.pages_scanned(_pages(spark, sf))


#: Line boxes of a document's words, as a fixed function of their places.
def boxes(spark, sf):
    words = F.split(col("text"), " ", -1)
    rows = read(spark, sf, "documents").select("doc_id", F.posexplode(words).alias("i", "text")).filter("text <> ''")
    d, i = F.col("doc_id"), F.col("i")
    return rows.select("doc_id", F.floor(i / 30).alias("page"), ((i % 30 % (2 + d % 2)) * 0.4).alias("x"), (0.95 - F.floor(i % 30 / (2 + d % 2)) * 0.05).alias("y"), (F.lit(0.05) + (d % 3) * 0.05).alias("w"), (F.lit(0.012) + (d % 4) * 0.004).alias("h"), "text", "i")


_BOXES = """boxes AS (SELECT doc_id, i // 30 AS page, ((i % 30 % (2 + doc_id % 2)) * 0.4)::DOUBLE AS x, (0.95::DOUBLE - (i % 30 // (2 + doc_id % 2)) * 0.05::DOUBLE) AS y, 0.05::DOUBLE + (doc_id % 3) * 0.05::DOUBLE AS w, 0.012::DOUBLE + (doc_id % 4) * 0.004::DOUBLE AS h, text, i
 FROM (SELECT doc_id, unnest(ws) AS text, generate_subscripts(ws, 1) - 1 AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), ' ') AS ws FROM documents)) WHERE text <> '')"""


@query(f"""WITH {_BOXES}, s AS (SELECT doc_id, page, count(*) AS n, count(*) FILTER (w > 0.03 AND h > 0.005 AND x + w / 2 < 0.45) AS l, count(*) FILTER (w > 0.03 AND h > 0.005 AND x + w / 2 > 0.55) AS r, avg(h) AS ah FROM boxes GROUP BY ALL)
 SELECT doc_id, page, CASE WHEN n >= 10 AND l >= 4 AND r >= 4 THEN 2 ELSE 1 END::BIGINT AS columns, n >= 25 AND (n >= 45 OR ah < 0.018) AS dense FROM s""")
def layout_statistics(spark, sf):
    return E.layout_stats(boxes(spark, sf))


@query(f"""WITH {_BOXES}, rows AS (SELECT doc_id, page, i % 30 // (2 + doc_id % 2) AS r, string_agg(text, '  ' ORDER BY x) AS line FROM boxes GROUP BY ALL) SELECT doc_id, page, string_agg(line, chr(10) ORDER BY r) AS text FROM rows GROUP BY ALL""")
def reading_order_rows(spark, sf):
    return E.reading_rows(boxes(spark, sf).drop("w", "i"))


@query(f"""WITH {PAGES}, c AS (SELECT doc_id, page, count(*) OVER (PARTITION BY doc_id) AS pages, list_filter(list_transform({sql_lines('text')}, lambda t: {sql_trim('t')}), lambda t: length(t) > 3 AND length(t) < 120) AS ls FROM doc_pages),
 e AS (SELECT doc_id, pages, unnest(list_concat(list_slice(ls, 1, 2), list_slice(ls, greatest(len(ls) - 1, 1), len(ls)))) AS line FROM c WHERE pages > 2), s AS (SELECT doc_id, pages, line, count(*) AS occurrences FROM e GROUP BY ALL)
 SELECT doc_id, line, occurrences, occurrences / pages AS share FROM s WHERE occurrences >= greatest(3, pages // 3)""")
def running_headers(spark, sf):
    return E.running_headers(_pages(spark, sf))


_OWN = f"list_filter({sql_lines('t')}, lambda x: {sql_trim('x')} <> '')"


@query(rf"""WITH t AS (SELECT doc_id, regexp_replace({_T}, 'th', '1 2', 'g') AS t FROM documents WHERE doc_id >= 0), n AS (SELECT doc_id, len({_OWN}) AS n, len(list_filter({_OWN}, lambda x: len(regexp_extract_all(x, '\d+')) >= 2)) AS c FROM t)
 SELECT doc_id, n >= 6 AND c / n >= 0.3 AS page, n >= 1 AND c / n >= 0.5 AS block FROM n""")
def tabular_test(spark, sf):
    t = F.replace(col("text"), F.lit("th"), F.lit("1 2"))
    return read(spark, sf, "documents").select("doc_id", E.looks_tabular(t).alias("page"), E.looks_tabular(t, block=True).alias("block"))


_TYPES = ", ".join("(" + " + ".join(f"contains(s, '{p}')::INT" for p in ps) + f") AS {n}" for n, ps in E.TYPE_INDICATORS.items())
_BEST = "greatest(" + ", ".join(E.TYPE_INDICATORS) + ")"
_SPICE = "list_extract(['', ' abstract doi: arxiv', ' whereas court', ' revenue quarterly api endpoint', ' reported'], (doc_id % 5 + 1)::INT)"


@query(f"WITH s AS (SELECT doc_id, lower(substr({_SPICE} || {_T}, 1, 8000)) AS s FROM documents), c AS (SELECT doc_id, {_TYPES} FROM s) SELECT doc_id, CASE WHEN {_BEST} <= 1 THEN 'general' " + " ".join(f"WHEN {n} = {_BEST} THEN '{n}'" for n in E.TYPE_INDICATORS) + " END AS type FROM c")
def document_types(spark, sf):
    spice = F.element_at(F.array(*map(F.lit, ("", " abstract doi: arxiv", " whereas court", " revenue quarterly api endpoint", " reported"))), (F.col("doc_id") % 5 + 1).cast("int"))
    return read(spark, sf, "documents").select("doc_id", E.document_type(F.concat(spice, col("text"))).alias("type"))


def _votes(text: str, prefix: int) -> str:
    words = f"list_filter(string_split_regex(lower(substr({text}, 1, {prefix})), '[^\\p{{L}}]+'), lambda w: w <> '')"
    per = " UNION ALL ".join(f"SELECT doc_id, letters, '{lang}' AS lang, len(list_filter(ws, lambda w: list_contains({list(ws)}, w))) AS hits FROM w0" for lang, ws in E.STOP_WORDS.items())
    return f"""w0 AS (SELECT doc_id, length(regexp_replace(substr({text}, 1, {prefix}), '\\P{{L}}', '', 'g')) AS letters, {words} AS ws FROM documents), v0 AS ({per}),
 sh AS (SELECT doc_id, letters, lang, hits, sum(hits) OVER (PARTITION BY doc_id) AS total FROM v0), kept AS (SELECT *, hits / total AS share, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, lang DESC) AS r FROM sh WHERE hits > 0),
 language AS (SELECT d.doc_id, max(CASE WHEN r = 1 AND letters >= 20 AND share >= 0.2 THEN lang END) AS lang, coalesce(max(CASE WHEN r = 1 THEN share END), 0.35) AS confidence, coalesce(string_agg(lang, ',' ORDER BY r) FILTER (share >= 0.15), '') AS languages, count(*) FILTER (share >= 0.15) > 1 AS mixed
  FROM (SELECT doc_id FROM documents) d LEFT JOIN kept USING (doc_id) GROUP BY d.doc_id)"""


@query(f"WITH {_votes(_T, 4000)} SELECT * FROM language")
def language_vote(spark, sf):
    v = read(spark, sf, "documents").select("doc_id", E.detect_language("text").alias("l"))
    return v.select("doc_id", "l.lang", "l.confidence", F.array_join("l.languages", ",").alias("languages"), "l.mixed")


@query(f"WITH {_votes(_T, 4000)} SELECT d.lang, count(*) AS n, avg((l.lang IS NOT DISTINCT FROM d.lang)::INT) AS accuracy FROM documents d JOIN language l USING (doc_id) GROUP BY d.lang")
def language_accuracy(spark, sf):
    v = read(spark, sf, "documents").select("lang", E.detect_language("text")["lang"].alias("found"))
    return v.groupBy("lang").agg(F.count("*").alias("n"), F.avg(F.col("found").eqNullSafe(F.col("lang")).cast("int")).alias("accuracy"))


_OCR = f"""rec AS (SELECT doc_id, line_no // 5 AS page, ((doc_id * 7 + line_no * 13) % 100) / 100.0::DOUBLE AS confidence, line FROM (SELECT doc_id, unnest({sql_lines(_T)}) AS line, generate_subscripts({sql_lines(_T)}, 1) - 1 AS line_no FROM documents))"""


def recognised(spark, sf):
    rows = read(spark, sf, "documents").select("doc_id", "lang", F.posexplode(F.split(col("text"), "\n", -1)).alias("line_no", "line"))
    return rows.select("doc_id", "lang", F.floor(F.col("line_no") / 5).alias("page"), "line_no", ((F.col("doc_id") * 7 + F.col("line_no") * 13) % 100 / 100.0).alias("confidence"), "line")


@query(f"""WITH {_OCR}, m AS (SELECT *, avg(confidence) OVER (PARTITION BY doc_id, page) AS mean FROM rec), p AS (SELECT doc_id, page, max(mean) AS mean, avg(abs(confidence - mean)) AS mad FROM m GROUP BY ALL),
 s AS (SELECT doc_id, avg(least(greatest(CASE WHEN mean < 0.7 THEN (0.7 - mean) * 0.5 ELSE 0 END + CASE WHEN mad > 0.15 THEN least(mad, 0.5) * 0.5 ELSE 0 END, 0), 1)) AS ratio FROM p GROUP BY doc_id) SELECT doc_id, ratio, ratio > 0.3 AS significant FROM s""")
def handwriting_ratio(spark, sf):
    return E.handwriting(recognised(spark, sf))


@query(f"""WITH {_OCR}, a AS (SELECT doc_id, page, avg(confidence) AS c FROM rec GROUP BY ALL), p AS (SELECT doc_id, CASE WHEN page % 3 = 1 THEN 0.0 ELSE c END AS c FROM a)
 SELECT doc_id, coalesce(avg(c) FILTER (c > 0), 0.0) AS confidence, count(*) AS pages, any_value(lang) || ',xx' AS languages FROM p JOIN documents USING (doc_id) GROUP BY doc_id""")
def ocr_document(spark, sf):
    page = recognised(spark, sf).groupBy("doc_id", "lang", "page").agg(F.avg("confidence").alias("c"), F.first("line").alias("text"))
    rows = page.select("doc_id", "page", "text", F.when(F.col("page") % 3 == 1, 0.0).otherwise(F.col("c")).alias("confidence"), F.array("lang", F.lit("xx")).alias("languages"))
    return E.ocr_document(rows).select("doc_id", "confidence", "pages", F.array_join("languages", ",").alias("languages"))


@query(f"WITH {PAGES} SELECT doc_id, string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY page) FILTER ({sql_trim('text')} <> '') AS markdown FROM doc_pages GROUP BY doc_id")
def page_join(spark, sf):
    return E.join_pages(_pages(spark, sf))


@query(f"""WITH {PAGES}, n AS (SELECT doc_id, page, count(*) OVER (PARTITION BY doc_id) AS n FROM doc_pages), b AS (SELECT doc_id, n, page // 2 AS chunk, min(page) AS first, max(page) AS last FROM n GROUP BY ALL)
 SELECT doc_id, chunk, first, last, last = n - 1 AS is_last, CAST(ceil(n / 2.0) AS BIGINT) AS chunks, n > 2 AS was_chunked FROM b""")
def page_chunks(spark, sf):
    return E.chunk_pages(_pages(spark, sf), 2)


@query(f"""WITH {PAGES}, i AS (SELECT doc_id, page, list_filter(string_split_regex(lower(split_part(text, chr(10), 1) || CASE WHEN doc_id % 2 = 0 THEN ' zzq yyq xxq wwq vvq' ELSE '' END), '[^\\p{{L}}\\p{{N}}]+'), lambda w: length(w) > 1) AS ws, {sql_set('text', 1)} AS known FROM doc_pages)
 SELECT doc_id, page, 0::BIGINT AS list_no, len(ws) >= 3 AND len(list_filter(ws, lambda w: list_contains(known, w))) / len(ws) >= 0.7 AS duplicate FROM i""")
def duplicated_lists(spark, sf):
    p = _pages(spark, sf)
    items = F.concat(F.get(F.split("text", "\n", -1), 0), F.when(F.col("doc_id") % 2 == 0, " zzq yyq xxq wwq vvq").otherwise(""))
    return E.duplicate_lists(p.select("doc_id", "page", F.lit(0).alias("list_no"), items.alias("items")), p)


@query("""SELECT doc_id, array_to_string(list_slice(list_filter(list_transform(range(1, len(a) + 1), lambda i: CASE WHEN list_position(a, a[i]) = i THEN a[i] END), lambda x: x IS NOT NULL), 1, 10), ' ') AS words FROM (SELECT doc_id, string_split(coalesce(text, ''), ' ') AS a FROM documents)""")
def first_seen_words(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.array_join(E.first_seen(F.split(col("text"), " ", -1)), " ").alias("words"))


_STOPS = ", ".join(f"'{w}'" for w in sorted({w for words in E.STOP_WORDS.values() for w in words}))


@query(f"""WITH t AS (SELECT doc_id, unnest(p) AS w, generate_subscripts(p, 1) AS i FROM (SELECT doc_id, regexp_extract_all(lower(substr({_T}, 1, 8000)), '\\p{{L}}+|[^\\p{{L}}\\s]') AS p FROM documents)),
 m AS (SELECT *, regexp_matches(w, '^[^\\p{{L}}]$') OR w IN ({_STOPS}) AS stop FROM t), g AS (SELECT *, sum(stop::INT) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM m),
 r AS (SELECT doc_id, island, string_agg(w, ' ' ORDER BY i) AS phrase FROM g WHERE NOT stop GROUP BY ALL HAVING count(*) >= 2), c AS (SELECT doc_id, phrase, count(*) AS n FROM r GROUP BY ALL)
 SELECT doc_id, phrase, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, phrase) AS rank FROM c) WHERE rank <= 10""")
def key_phrases(spark, sf):
    return E.key_phrases(read(spark, sf, "documents"))


_TONE = "CASE w " + " ".join(f"WHEN '{w}' THEN {v}" for w, v in E.TONES.items()) + " END"


@query(f"""WITH l AS (SELECT doc_id, unnest({sql_lines(f'substr({_T}, 1, 8000)')}) AS line, generate_subscripts({sql_lines(f'substr({_T}, 1, 8000)')}, 1) AS i FROM documents), w AS (SELECT doc_id, i, unnest(string_split_regex(lower(line), '[^\\p{{L}}]+')) AS w FROM l),
 t AS (SELECT doc_id, i, avg(({_TONE})::DOUBLE) AS tone FROM w GROUP BY ALL) SELECT doc_id, avg(tone) AS sentiment FROM t GROUP BY doc_id""")
def sentiment(spark, sf):
    return read(spark, sf, "documents").select("doc_id", E.sentiment("text").alias("sentiment"))


@query("""WITH RECURSIVE s AS (SELECT conv_id, turn * 17.0::DOUBLE AS ts, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS n FROM conversations),
 f AS (SELECT conv_id, n, ts, text, 0.0::DOUBLE AS start, 0 AS block, ts AS head FROM s WHERE n = 1 UNION ALL
  SELECT s.conv_id, s.n, s.ts, s.text, CASE WHEN s.ts - f.start > 30 THEN s.ts ELSE f.start END, f.block + CASE WHEN s.ts - f.start > 30 THEN 1 ELSE 0 END, CASE WHEN s.ts - f.start > 30 THEN s.ts ELSE f.head END FROM f JOIN s ON s.conv_id = f.conv_id AND s.n = f.n + 1),
 b AS (SELECT conv_id, block, '**[' || floor(min(head))::BIGINT // 60 || ':' || lpad((floor(min(head))::BIGINT % 60)::VARCHAR, 2, '0') || ']** ' || string_agg(text, ' ' ORDER BY n) AS t FROM f GROUP BY ALL)
 SELECT conv_id AS id, string_agg(t, chr(10) || chr(10) ORDER BY block) AS markdown FROM b GROUP BY conv_id""")
def transcript_blocks(spark, sf):
    c = read(spark, sf, "conversations").select(F.col("conv_id").alias("id"), (F.col("turn") * 17.0).alias("ts"), "text")
    return E.transcript_blocks(c)


# Quality

_TEXT = sql_trim(_T)
_STRUCT = rf"""least(1.0, 0.45 + CASE WHEN len(list_filter({sql_lines('t')}, lambda x: starts_with({sql_trim('x')}, '#'))) > 0 THEN 0.18 ELSE 0 END + CASE WHEN len(list_filter({sql_lines('t')}, lambda x: starts_with({sql_trim('x')}, '- ') OR regexp_matches({sql_trim('x')}, '^\d+\.\s'))) > 0 THEN 0.10 ELSE 0 END
 + CASE WHEN len(list_filter({sql_lines('t')}, lambda x: regexp_matches(x, '^\|[\s\-|:]+\|$'))) > 0 THEN 0.22 ELSE 0 END + CASE WHEN contains(t, '```') THEN 0.08 ELSE 0 END)"""


@query(f"""WITH {STRUCTURED}, x AS (SELECT doc_id, {sql_trim('original')} AS t, 1 + doc_id % 3 AS pages FROM structured) SELECT doc_id, least(1.0, len({sql_tokens('t')}) / pages / 180.0) AS coverage, ({_STRUCT})::DOUBLE AS structure FROM x""")
def coverage_structure(spark, sf):
    s = structured(read(spark, sf, "documents")).withColumn("t", F.regexp_replace("original", r"^\s+|\s+$", ""))
    return s.select("doc_id", Q.coverage(F.col("t"), 1 + F.col("doc_id") % 3).alias("coverage"), Q.structure_score(F.col("t")).alias("structure"))


_SCORES = rf"""base AS (SELECT doc_id, lang, source, {_TEXT} AS t FROM documents), {_votes(_TEXT, 8000)},
 ch AS (SELECT doc_id, unnest(string_split(t, '')) AS c, generate_subscripts(string_split(t, ''), 1) AS i FROM base), rn AS (SELECT doc_id, c, i - row_number() OVER (PARTITION BY doc_id, c ORDER BY i) AS g FROM ch WHERE c NOT IN ('-', '|', '=', ' ', chr(9), chr(10), chr(13))),
 lg AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, c, g FROM rn GROUP BY ALL HAVING count(*) >= 9) GROUP BY doc_id),
 dl AS (SELECT doc_id, {sql_trim('unnest(string_split(t, chr(10)))')} AS line FROM base), dc AS (SELECT doc_id, line, count(*) AS n FROM dl WHERE length(line) > 8 GROUP BY ALL), dd AS (SELECT doc_id, sum(n) AS lines, coalesce(sum(n) FILTER (n > 1), 0) AS rep FROM dc GROUP BY doc_id),
 pt AS (SELECT b.doc_id, b.lang, b.source, b.t, l.confidence AS language, least(1.0, len({sql_tokens('b.t')}) / 1 / 180.0) AS coverage, ({_STRUCT.replace('(t,', '(b.t,')})::DOUBLE AS structure,
  least(1.0, (len(regexp_extract_all(b.t, '[�\x{{00AD}}]')) + len(regexp_extract_all(b.t, '\n\d{{1,3}}\n')) + len(regexp_extract_all(b.t, '[A-Za-z]-\s+[a-z]')) + coalesce(lg.n, 0)) / greatest(1, len({sql_tokens('b.t')})) * 50.0) AS artifacts,
  CASE WHEN coalesce(lines, 0) > 4 THEN rep / lines ELSE 0.0 END AS duplication FROM base b JOIN language l USING (doc_id) LEFT JOIN lg USING (doc_id) LEFT JOIN dd USING (doc_id)),
 scores AS (SELECT doc_id, lang, source, length(t) AS n, CASE WHEN t = '' THEN 0.0 ELSE language END AS language, CASE WHEN t = '' THEN 0.0 ELSE coverage END AS coverage, CASE WHEN t = '' THEN 0.0 ELSE structure END AS structure, CASE WHEN t = '' THEN 1.0 ELSE artifacts END AS artifacts, CASE WHEN t = '' THEN 1.0 ELSE duplication END AS duplication,
  CASE WHEN t = '' THEN 0.0 ELSE (language * 0.2 + coverage * 0.3 + structure * 0.2 + (1 - artifacts) * 0.15 + (1 - duplication) * 0.15) / (0.2 + 0.3 + 0.2 + 0.15 + 0.15) END::DOUBLE AS overall FROM pt)"""


def scored(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", "lang", "source", F.col("text").alias("markdown"), F.lit(1).alias("pages"))
    return Q.quality_score(d)


@query(f"""WITH {_SCORES} SELECT doc_id, language, coverage, structure, artifacts, duplication, overall, CASE WHEN n = 0 THEN 'empty output' ELSE array_to_string(list_filter([CASE WHEN language < 0.45 THEN 'low language confidence' END, CASE WHEN coverage < 0.45 THEN 'low coverage' END, CASE WHEN structure < 0.45 THEN 'low structure' END,
 CASE WHEN artifacts > 0.25 THEN 'extraction artifacts' END, CASE WHEN duplication > 0.25 THEN 'duplicate text' END], lambda x: x IS NOT NULL), ';') END AS reasons FROM scores""")
def quality_scores(spark, sf):
    return scored(spark, sf).select("doc_id", "language", "coverage", "structure", "artifacts", "duplication", "overall", F.array_join("reasons", ";").alias("reasons"))


@query(f"WITH {_SCORES} SELECT source, lang, count(*) AS n, avg(overall) AS score FROM scores GROUP BY ROLLUP (source, lang)")
def quality_by_source(spark, sf):
    return scored(spark, sf).rollup("source", "lang").agg(F.count("*").alias("n"), F.avg("overall").alias("score"))


@query(f"WITH {_SCORES}, b AS (SELECT lang, doc_id, source, overall, row_number() OVER (PARTITION BY lang ORDER BY overall DESC, n DESC, doc_id) AS r FROM scores) SELECT lang, doc_id, source, overall FROM b WHERE r = 1")
def best_per_group(spark, sf):
    # the text is trimmed in the SQL as well, so that lengths compare alike
    s = scored(spark, sf).withColumn("markdown", trim_all(col("markdown")))
    return Q.select_best(s, by="lang", order="doc_id").select("lang", "doc_id", "source", "overall")


@query(f"WITH {_SCORES} SELECT quality::BIGINT AS quality, count(*) AS n, avg(overall) AS score, avg(artifacts) AS artifacts, avg(duplication) AS duplication FROM scores JOIN labels USING (doc_id) GROUP BY labels.quality")
def quality_vs_label(spark, sf):
    j = scored(spark, sf).join(read(spark, sf, "labels"), "doc_id")
    return j.groupBy("quality").agg(F.count("*").alias("n"), F.avg("overall").alias("score"), F.avg("artifacts").alias("artifacts"), F.avg("duplication").alias("duplication"))


@query(f"WITH {_SCORES} SELECT doc_id, overall < 0.82 OR doc_id % 10 = 0 AS secondary FROM scores")
def candidate_budget(spark, sf):
    d = F.col("doc_id")
    return scored(spark, sf).select("doc_id", R.needs_secondary(F.col("pages"), d % 10 == 0, F.lit(False), F.col("overall")).alias("secondary"))


@query(f"WITH {STRUCTURED} SELECT doc_id, 0 AS ord, converted AS markdown, NULL::DOUBLE AS confidence FROM structured UNION ALL SELECT doc_id, 1, original, (doc_id % 10) / 10.0 FROM structured WHERE doc_id % 2 = 0")
def candidate_union(spark, sf):
    """One engine's outputs for all documents, and another's, which has a confidence, for half of them."""
    s = structured(read(spark, sf, "documents"))
    second = s.filter("doc_id % 2 = 0").select("doc_id", F.col("original").alias("markdown"), (F.col("doc_id") % 10 / 10.0).alias("confidence"))
    return Q.union_candidates(s.select("doc_id", F.col("converted").alias("markdown")), second).select("doc_id", "ord", "markdown", "confidence")


@query(None)
def quality_selection(spark, sf):
    s = structured(read(spark, sf, "documents"))
    basic = s.select("doc_id", F.col("converted").alias("markdown"), F.lit(1).alias("pages"), (F.col("doc_id") % 10 == 0).alias("scanned"), F.lit(False).alias("special"))
    originals = s.select("doc_id", F.col("original").alias("second"))
    best = Q.quality_select(basic, lambda needy: needy.join(originals, "doc_id").withColumn("markdown", F.col("second")).drop("second"))
    return best.select("doc_id", "ord", "overall")


@query(f"""WITH m AS (SELECT doc_id, toxic AS bad FROM labels WHERE toxic IS NOT NULL), k AS (SELECT count(*) FILTER (bad = 0) AS gd, count(*) FILTER (bad = 1) AS bd FROM m JOIN documents USING (doc_id)),
 l AS (SELECT doc_id, unnest({sql_lines(_T)}) AS t, generate_subscripts({sql_lines(_T)}, 1) AS line FROM documents), w AS (SELECT doc_id, line, unnest(regexp_extract_all(lower(t), '\\p{{L}}+')) AS word FROM l),
 c AS (SELECT word, count(*) FILTER (bad = 0) AS g, count(*) FILTER (bad = 1) AS b FROM (SELECT DISTINCT doc_id, word FROM w) JOIN m USING (doc_id) GROUP BY word HAVING g + b >= 20),
 x AS (SELECT word, (g / gd - b / bd) / (g / gd + b / bd) AS tone FROM c, k WHERE gd > 0 AND bd > 0), a AS (SELECT doc_id, line, avg(tone) AS tone FROM w JOIN x USING (word) GROUP BY ALL), s AS (SELECT doc_id, avg(tone) AS sentiment FROM a GROUP BY doc_id)
 SELECT doc_id, round(sentiment, 9) AS sentiment FROM documents LEFT JOIN s USING (doc_id)""")
def learned_sentiment(spark, sf):
    """The tone of every whole text by a lexicon that is learned from the documents marked as toxic or not."""
    docs = read(spark, sf, "documents")
    lexicon = E.learn_lexicon(docs, read(spark, sf, "labels").select("doc_id", F.col("toxic").alias("bad")))
    path = scratch_folder(spark, "lexicon")
    lexicon.write.parquet(path)
    known = broadcast_if_small(spark.read.schema(lexicon.schema).parquet(path), path)
    return E.sentiment_by(docs, known).select("doc_id", F.round("sentiment", 9).alias("sentiment"))
