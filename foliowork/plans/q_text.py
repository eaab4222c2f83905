"""Queries over the text functions, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliowork.functions import text as X
from foliowork.plans.tables import STRUCTURED, book, read, sql_lines, sql_set, sql_tokens, sql_trim, structured

query, QUERIES, ORACLES = book()


_T = "coalesce(text, '')"
_BARE = rf"regexp_replace(regexp_replace(regexp_replace({_T}, '<!--.*?-->', ' ', 'gs'), '!\[[^\]]*\]\([^)]*\)', ' ', 'g'), '</?[^>]+>', ' ', 'g')"


@query(rf"""SELECT doc_id, len({sql_tokens(_T)}) AS n_any, len(list_filter({sql_tokens(_T)}, lambda t: regexp_matches(t, '[\p{{L}}\p{{N}}]'))) AS n_alnum,
 len(regexp_extract_all({_BARE}, '[\p{{L}}\p{{N}}]+(?:[''’-][\p{{L}}\p{{N}}]+)*')) AS n_meaningful FROM documents""")
def word_counts(spark, sf):
    return read(spark, sf, "documents").select("doc_id", X.wc_any("text").alias("n_any"), X.wc_alnum("text").alias("n_alnum"), X.wc_meaningful("text").alias("n_meaningful"))


@query(f"SELECT doc_id, array_to_string({sql_tokens(_T)}, ' ') AS norm, array_to_string({sql_tokens(f'lower({_T})')}, ' ') AS answer FROM documents")
def text_normalisation(spark, sf):
    return read(spark, sf, "documents").select("doc_id", X.norm_text("text").alias("norm"), X.norm_answer("text").alias("answer"))


@query(f"SELECT doc_id, len({sql_set(_T)}) AS n_score, len({sql_set(_T, 1)}) AS n_list, array_to_string(list_sort({sql_set(_T)}), ' ') AS words FROM documents")
def token_sets(spark, sf):
    s = X.token_set("text")
    return read(spark, sf, "documents").select(
        "doc_id", F.size(s).cast("long").alias("n_score"), F.size(X.token_set("text", 1)).cast("long").alias("n_list"), F.array_join(F.array_sort(s), " ").alias("words")
    )


_N = rf"""(len(regexp_extract_all({sql_trim(_T)}, '[�\x{{00AD}}]')) + len(regexp_extract_all({sql_trim(_T)}, '\n\d{{1,3}}\n'))
  + len(regexp_extract_all({sql_trim(_T)}, '[A-Za-z]-\s+[a-z]')))"""


@query(rf"""WITH c AS (SELECT doc_id, {sql_trim(_T)} AS t FROM documents),
 ch AS (SELECT doc_id, unnest(string_split(t, '')) AS c, generate_subscripts(string_split(t, ''), 1) AS i FROM c),
 runs AS (SELECT doc_id, c, i - row_number() OVER (PARTITION BY doc_id, c ORDER BY i) AS g FROM ch WHERE c NOT IN ('-', '|', '=', ' ', chr(9), chr(10), chr(13))),
 long AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, c, g FROM runs GROUP BY ALL HAVING count(*) >= 9) GROUP BY doc_id)
 SELECT doc_id, ({_N} + coalesce(n, 0))::BIGINT AS artifacts, least(1.0, ({_N} + coalesce(n, 0)) / greatest(1, len({sql_tokens(sql_trim(_T))})) * 50.0) AS penalty
 FROM documents LEFT JOIN long USING (doc_id)""")
def artifact_parts(spark, sf):
    return read(spark, sf, "documents").select("doc_id", X.artifact_count("text").alias("artifacts"), X.artifact_penalty("text").alias("penalty"))


@query(rf"SELECT doc_id, len(regexp_extract_all({_T}, '[�\x{{00AD}}ﬁﬂﬀ]')) AS artifacts FROM documents")
def ocr_artifacts(spark, sf):
    return read(spark, sf, "documents").select("doc_id", X.ocr_artifacts("text").alias("artifacts"))


@query(f"SELECT doc_id, greatest(1, len({sql_tokens(_T)}) // 200)::BIGINT AS minutes FROM documents")
def reading_minutes(spark, sf):
    return read(spark, sf, "documents").select("doc_id", X.reading_minutes("text").alias("minutes"))


@query(f"SELECT doc_id, array_to_string(list_slice(list_filter(string_split(replace({_T}, chr(10), ' '), ' '), lambda t: t <> ''), 1, 18), ' ') AS snippet FROM documents")
def snippet(spark, sf):
    return read(spark, sf, "documents").select("doc_id", X.snippet("text").alias("snippet"))


_O, _C = sql_set("original"), sql_set("converted")
_OW, _CW = f"list_distinct({sql_tokens('original')})", f"list_distinct({sql_tokens('converted')})"
_OL, _CL = f"list_distinct({sql_tokens('lower(original)')})", f"list_distinct({sql_tokens('lower(converted)')})"


@query(f"""WITH {STRUCTURED}, s AS (SELECT doc_id, {_O} AS a, {_C} AS b, {_OW} AS ow, {_CW} AS cw, {_OL} AS ol, {_CL} AS cl FROM structured),
 n AS (SELECT *, len(list_intersect(ol, cl)) AS common FROM s)
 SELECT doc_id, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE len(list_intersect(a, b)) / len(a) END AS agreement,
  CASE WHEN len(ow) = 0 THEN 1.0 ELSE len(list_intersect(ow, cw)) / len(ow) END AS completeness,
  CASE WHEN len(ol) = 0 AND len(cl) = 0 THEN 1.0 WHEN len(ol) = 0 OR len(cl) = 0 OR common = 0 THEN 0.0 ELSE 2 * (common / len(cl)) * (common / len(ol)) / (common / len(cl) + common / len(ol)) END AS f1,
  len(list_intersect(a, b)) AS shared FROM n""")
def token_overlap(spark, sf):
    s = structured(read(spark, sf, "documents"))
    sets = F.struct(X.token_set("converted").alias("a"), X.token_set("original").alias("b"))
    shared = X.let(sets, lambda p: F.struct(X.set_agreement(p["a"], p["b"]).alias("agreement"), X.overlap(p["a"], p["b"]).alias("shared")))
    measured = s.select("doc_id", F.explode(F.array(shared)).alias("s"), X.completeness("original", "converted").alias("completeness"), X.token_f1("original", "converted").alias("f1"))
    return measured.select("doc_id", "s.agreement", "completeness", "f1", "s.shared")


def passage_pairs(spark, sf):
    """(item_id, reference, text): every benchmark passage with the next one."""
    b = read(spark, sf, "benchmark").select("item_id", X.col("text").alias("reference"))
    other = b.select((F.col("item_id") - 1).alias("item_id"), F.col("reference").alias("text"))
    return b.join(other, "item_id")


def sql_distance(a: str, b: str) -> str:
    """Edit distance in code points. The SQL engine counts bytes, so the characters of a pair (up to 127) get one byte each."""
    code = lambda x: f"array_to_string(list_transform(string_split({x}, ''), lambda c: chr(list_position(list_distinct(string_split({a} || {b}, '')), c)::INT)), '')"
    return f"levenshtein({code(a)}, {code(b)})"


PAIRS = r"""b AS (SELECT item_id, coalesce(text, '') AS reference FROM benchmark),
 pairs AS (SELECT x.item_id, x.reference, y.reference AS text FROM b x JOIN b y ON y.item_id = x.item_id + 1),
 norm AS (SELECT item_id, reference, text, array_to_string(list_filter(string_split_regex(reference, '\s+'), lambda t: t <> ''), ' ') AS r, array_to_string(list_filter(string_split_regex(text, '\s+'), lambda t: t <> ''), ' ') AS h FROM pairs)"""


@query(f"""WITH {PAIRS} SELECT item_id, CASE WHEN length(r) = 0 THEN CASE WHEN length(h) = 0 THEN 0.0 ELSE 1.0 END ELSE {sql_distance('r', 'h')} / length(r) END AS cer,
 CASE WHEN length(reference) = 0 THEN CASE WHEN length(text) = 0 THEN 0.0 ELSE 1.0 END ELSE least(1.0, {sql_distance('reference', 'text')} / length(reference)) END AS capped FROM norm""")
def cer_pairs(spark, sf):
    return passage_pairs(spark, sf).select("item_id", X.cer("reference", "text").alias("cer"), X.cer("reference", "text", cap=True).alias("capped"))


@query(f"""WITH {PAIRS} SELECT item_id, CASE WHEN greatest(length(reference), length(text)) = 0 THEN 0.0 ELSE {sql_distance('reference', 'text')} / greatest(length(reference), length(text)) END AS distance FROM norm""")
def normalised_edit_distance(spark, sf):
    return passage_pairs(spark, sf).select("item_id", X.norm_lev("reference", "text").alias("distance"))


def sql_word_rates(pairs: str) -> str:
    """CTEs up to `word_rates` (item_id, wer): the table of edit distances over the words of (item_id, reference, text), a row at a time."""
    return rf"""w AS (SELECT item_id, {sql_tokens('reference')} AS r, {sql_tokens('text')} AS h FROM {pairs}),
 cells AS (SELECT item_id, 0 AS i, range(0, len(h) + 1) AS line, r, h FROM w
  UNION ALL SELECT item_id, i + 1, list_reduce(list_concat([[(i + 1)::BIGINT]], list_transform(range(1, len(h) + 1), lambda j: [j])),
   lambda acc, x: list_append(acc, least(acc[len(acc)] + 1, line[x[1] + 1] + 1, line[x[1]] + CASE WHEN r[i + 1] = h[x[1]] THEN 0 ELSE 1 END))), r, h FROM cells WHERE i < len(r)),
 word_rates AS (SELECT item_id, CASE WHEN len(r) > 0 THEN line[len(line)] / len(r) WHEN len(h) = 0 THEN 0.0 ELSE 1.0 END AS wer FROM cells WHERE i = len(r))"""


@query(f"WITH RECURSIVE {PAIRS}, {sql_word_rates('pairs')} SELECT item_id, wer, least(1.0, wer) AS capped FROM word_rates")
def wer_pairs(spark, sf):
    return passage_pairs(spark, sf).select("item_id", X.wer("reference", "text").alias("wer"), X.wer("reference", "text", cap=True).alias("capped"))


@query(r"""WITH h AS (SELECT doc_id, replace(coalesce(text, ''), 'e ', 'e- ') AS t FROM documents)
 SELECT doc_id, sha256(regexp_replace(regexp_replace(t, '([A-Za-z])-[ \t]+([A-Za-z])', '\1-\2', 'g'), '([A-Za-z])-[ \t]+([A-Za-z])', '\1-\2', 'g')) AS fixed FROM h""")
def hyphen_repair(spark, sf):
    broken = F.replace(X.col("text"), F.lit("e "), F.lit("e- "))
    return read(spark, sf, "documents").select("doc_id", F.sha2(X.clean_hyphens(broken), 256).alias("fixed"))


_LINE = f"(SELECT doc_id, generate_subscripts(ls, 1) - 1 AS line_no, CASE WHEN generate_subscripts(ls, 1) % 3 = 0 THEN '2.' || generate_subscripts(ls, 1) || ' ' || unnest(ls) WHEN generate_subscripts(ls, 1) % 3 = 1 THEN upper(replace(unnest(ls), 'ß', 's')) ELSE unnest(ls) END AS line FROM (SELECT doc_id, {sql_lines(_T)} AS ls FROM documents))"


@query(rf"""WITH l AS {_LINE}, x AS (SELECT *, regexp_extract(line, '^(\d+(?:\.\d+)*)\.?\s+[A-Z]', 1) AS num, regexp_replace(line, '\P{{L}}', '', 'g') AS letters FROM l)
 SELECT doc_id, line_no, CASE WHEN regexp_matches(line, '\.{{4,}}') OR length(line) > 80 OR regexp_matches(line, '[.,;]$') THEN NULL
  WHEN num <> '' THEN repeat('#', least(len(string_split(num, '.')) + 1, 6)::INT) || ' ' || line WHEN length(letters) >= 2 AND NOT regexp_matches(letters, '\P{{Lu}}') THEN '# ' || line END AS heading,
  CASE WHEN length(line) < 80 AND regexp_matches(line, '\p{{L}}') AND NOT regexp_matches(line, '[.,]$') THEN '## ' || line ELSE line END AS first_line FROM x""")
def heading_rules(spark, sf):
    """Whole lines, those beyond the rules' 80 characters too."""
    own = F.posexplode(F.split(X.col("text"), "\n", -1)).alias("line_no", "raw")
    n, raw = F.col("line_no") + 1, F.col("raw")
    line = F.when(n % 3 == 0, F.concat(F.lit("2."), n, F.lit(" "), raw)).when(n % 3 == 1, F.upper(F.replace(raw, F.lit("ß"), F.lit("s")))).otherwise(raw)
    rows = read(spark, sf, "documents").select("doc_id", own).select("doc_id", F.col("line_no").cast("long").alias("line_no"), line.alias("line"))
    return rows.select("doc_id", "line_no", X.heading_markup("line").alias("heading"), X.first_line_heading("line").alias("first_line"))


@query(rf"""WITH p AS (SELECT doc_id, generate_subscripts({sql_lines(_T)}, 1) - 1 AS line_no, replace(unnest({sql_lines(_T)}), ' ', chr(10)) AS page FROM documents),
 l AS (SELECT doc_id, line_no, list_filter(list_transform({sql_lines('page')}, lambda x: {sql_trim('x')}), lambda x: x <> '') AS ls FROM p), j AS (SELECT *, array_to_string(ls, ' ') AS joined FROM l)
 SELECT doc_id, line_no, len(ls) > 0 AND len(ls) <= 14 AND len({sql_tokens('joined')}) <= 24 AND len(list_filter(ls, lambda x: regexp_matches(x, '[.:]$'))) = 0
  AND (len(list_filter(ls, lambda x: regexp_matches(x, '^-?\d+(\.\d+)?$'))) >= 3 OR contains(joined, '[') OR contains(joined, ']') OR contains(joined, '/') OR contains(joined, 'MeV')) AS figure FROM j""")
def figure_text(spark, sf):
    rows = read(spark, sf, "documents").select("doc_id", F.posexplode(F.split(X.col("text"), "\n", -1)).alias("line_no", "line"))
    return rows.select("doc_id", "line_no", X.is_figure(F.replace(F.col("line"), F.lit(" "), F.lit("\n"))).alias("figure"))


@query(f"SELECT doc_id, regexp_matches({_T}, '[\\x{{0590}}-\\x{{05FF}}\\x{{0600}}-\\x{{06FF}}\\x{{0750}}-\\x{{077F}}\\x{{08A0}}-\\x{{08FF}}]') AS rtl FROM documents")
def rtl_text(spark, sf):
    return read(spark, sf, "documents").select("doc_id", X.has_rtl("text").alias("rtl"))


@query(rf"""WITH {STRUCTURED} SELECT doc_id, array_to_string(list_filter(list_transform({sql_lines('original')}, lambda t: lower(replace(replace(replace({sql_trim('t')}, ' | ', '|'), '| ', '|'), ' |', '|'))), lambda t: t <> ''), chr(10)) AS signature FROM structured""")
def table_signatures(spark, sf):
    return structured(read(spark, sf, "documents")).select("doc_id", X.table_signature("original").alias("signature"))


@query(rf"""WITH {STRUCTURED} SELECT doc_id, '"' || replace(replace(replace(replace(original, '\', '\\'), '"', '\"'), chr(10), '\n'), chr(13), '\r') || '"' AS yaml,
 regexp_replace(original, '([\\`*_\[\]])', '\\\1', 'g') AS inline, regexp_replace(regexp_replace(original, '^(#{{1,6}}|>|[-+])(\s|$)', '\\\1\2'), '^(\d+)([.)])(\s|$)', '\1\\\2\3') AS block FROM structured""")
def markdown_escapes(spark, sf):
    s = structured(read(spark, sf, "documents"))
    return s.select("doc_id", X.yaml_str("original").alias("yaml"), X.md_escape("original").alias("inline"), X.md_escape_block("original").alias("block"))


@query(r"""WITH t AS (SELECT doc_id, 'x Acme Widget Corp. met University of New ' || upper(source) || ' and Acme Widget Corp. again ' || coalesce(text, '') AS t0 FROM documents), t1 AS (SELECT doc_id, substr(t0, 1, 8000) AS t FROM t)
 SELECT doc_id, array_to_string(list_slice(list_filter(list_transform(range(1, len(a) + 1), lambda i: CASE WHEN list_position(a, a[i]) = i THEN a[i] END), lambda x: x IS NOT NULL), 1, 10), ';') AS names FROM (
 SELECT doc_id, list_filter(list_concat(regexp_extract_all(t, '\b[A-Z][A-Za-z&.-]+(?:\s+[A-Z][A-Za-z&.-]+){0,3}\s+(?:Inc\.?|Corp\.?|Corporation|Company|University|Institute|Laboratory|Labs|LLC|Ltd\.?)\b'),
  regexp_extract_all(t, '\b(?:University|Institute|Laboratory|Labs)\s+of\s+[A-Z][A-Za-z&.-]+(?:\s+[A-Z][A-Za-z&.-]+){0,2}\b')), lambda x: length(x) > 2) AS a FROM t1)""")
def organisation_names(spark, sf):
    t = F.concat(F.lit("x Acme Widget Corp. met University of New "), F.upper("source"), F.lit(" and Acme Widget Corp. again "), X.col("text"))
    return read(spark, sf, "documents").select("doc_id", F.array_join(X.organisations(t), ";").alias("names"))


@query("""SELECT event_id, CASE WHEN value < 60 THEN floor(value)::BIGINT || 's' WHEN floor(value)::BIGINT % 60 > 0 THEN floor(value)::BIGINT // 60 || 'm ' || floor(value)::BIGINT % 60 || 's' ELSE floor(value)::BIGINT // 60 || 'm' END AS duration,
 floor(value)::BIGINT // 60 || ':' || lpad((floor(value)::BIGINT % 60)::VARCHAR, 2, '0') AS stamp,
 CASE WHEN c >= 3600 THEN c // 3600 || ':' || lpad((c % 3600 // 60)::VARCHAR, 2, '0') ELSE (c // 60)::VARCHAR END || ':' || lpad((c % 60)::VARCHAR, 2, '0') AS clock,
 strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM (SELECT *, greatest(0, round(value * 100))::BIGINT AS c FROM events)""")
def time_formats(spark, sf):
    v = F.col("value")
    return read(spark, sf, "events").select("event_id", X.fmt_duration(v).alias("duration"), X.fmt_timestamp(v).alias("stamp"), X.fmt_clock(v * 100).alias("clock"), X.fmt_iso(F.col("ts")).alias("iso"))


@query("""SELECT doc_id, '**TIFF.Make:** ' || source || chr(10) || CASE WHEN lang <> 'en' THEN '**Exif.LensModel:** ' || lang || chr(10) ELSE '' END || '**PNG.Title:** ' || doc_id AS markdown FROM documents""")
def metadata_markdown(spark, sf):
    entry = F.create_map(
        F.lit("PNG"), F.create_map(F.lit("Title"), F.col("doc_id").cast("string")),
        F.lit("Exif"), F.create_map(F.lit("LensModel"), F.when(F.col("lang") != "en", F.col("lang")).otherwise("")),
        F.lit("TIFF"), F.create_map(F.lit("Make"), F.col("source"), F.lit("Hidden"), F.col("lang")),
    )
    return read(spark, sf, "documents").select("doc_id", X.metadata_markdown(entry).alias("markdown"))


@query("""SELECT page_id, 'https://a.example/' || url || '?q=%20x&r=é' || 'ü%2F' AS decoded FROM pages""")
def url_decoding(spark, sf):
    url = F.concat(F.lit("https://a.example/"), F.col("url"), F.lit("?q=%20x&r=%C3%A9%C3%BC"))
    return read(spark, sf, "pages").select("page_id", F.concat(X.decode_non_ascii(url), X.decode_non_ascii(F.lit("%2F"))).alias("decoded"))


@query("""SELECT doc_id, source AS title, length(coalesce(text, ''))::BIGINT AS n FROM documents""")
def json_payload(spark, sf):
    rows = read(spark, sf, "documents").select("doc_id", X.to_payload(F.struct(F.col("text").alias("markdown"), F.col("source").alias("title"))).alias("payload"))
    parsed = X.from_payload(F.col("payload"), "markdown string, title string")
    return rows.select("doc_id", parsed["title"].alias("title"), F.length(F.coalesce(parsed["markdown"], F.lit(""))).cast("long").alias("n"))


@query("""SELECT conv_id, turn, '## Transcript' || chr(10) || chr(10) || '> Language: ' || role || '  ' || chr(10) || '> Duration: ' || CASE WHEN turn * 25 < 60 THEN turn * 25 || 's' WHEN turn * 25 % 60 > 0 THEN turn * 25 // 60 || 'm ' || turn * 25 % 60 || 's' ELSE turn * 25 // 60 || 'm' END || '  ' || chr(10)
 || '> Confidence: ' || turn % 100 || '%' || chr(10) || chr(10) || text AS markdown FROM conversations""")
def transcript_document(spark, sf):
    c = read(spark, sf, "conversations")
    return c.select("conv_id", "turn", X.transcript_markdown(F.col("role"), (F.col("turn") * 25).cast("double"), (F.col("turn") % 100 + 0.5) / 100.0, F.col("text")).alias("markdown"))
