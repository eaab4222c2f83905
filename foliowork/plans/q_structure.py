"""Queries over the structure of texts, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliowork.functions.text import trim_all
from foliowork.operators import structure as S
from foliowork.plans.tables import STRUCTURED, book, read, sql_lines, sql_tokens, sql_trim, structured

query, QUERIES, ORACLES = book()


def _docs(spark, sf):
    return structured(read(spark, sf, "documents"))


def _line_rows(spark, sf, side="original"):
    return S.line_table(_docs(spark, sf), side)


def _sql_lines(side: str, name: str) -> str:
    return f"""{name} AS (SELECT doc_id, line_no, line, {sql_trim('line')} AS trimmed FROM (SELECT doc_id, unnest({sql_lines(side)}) AS line, generate_subscripts({sql_lines(side)}, 1) - 1 AS line_no FROM structured))"""


_HEAD = f"starts_with(trimmed, '#') AND {sql_trim(chr(114) + 'egexp_replace(trimmed, ' + chr(39) + '^#+' + chr(39) + ', ' + chr(39) + chr(39) + ')')} <> ''"
_LEVEL, _TITLE = "length(regexp_extract(trimmed, '^(#+)', 1))", sql_trim("regexp_replace(trimmed, '^#+', '')")
_ROW = f"contains(trimmed, '|') AND NOT starts_with(trimmed, '#') AND len(list_filter(string_split(trimmed, '|'), lambda c: {sql_trim('c')} <> '')) > 1"
_ITEM = "(starts_with(trimmed, '- ') OR starts_with(trimmed, '* '))"


def _counts(lines: str, p: str = "") -> str:
    return f"SELECT doc_id, count(*) FILTER ({_HEAD}) AS {p}headings, count(*) FILTER ({_ROW}) AS {p}tables, count(*) FILTER ({_ITEM}) AS {p}lists FROM {lines} GROUP BY doc_id"


_BOTH = f"WITH {STRUCTURED}, {_sql_lines('original', 'o')}, {_sql_lines('converted', 'c')}"


@query(f"WITH {STRUCTURED}, {_sql_lines('original', 'o')} SELECT doc_id, line_no, line, trimmed FROM o")
def line_numbers(spark, sf):
    return _line_rows(spark, sf)


@query(f"WITH {STRUCTURED}, {_sql_lines('original', 'o')} {_counts('o')}")
def structure_counts(spark, sf):
    return _docs(spark, sf).select("doc_id", S.structure("original").alias("s")).select("doc_id", "s.*")


@query(f"{_BOTH}, a AS ({_counts('o', 'o_')}), b AS ({_counts('c', 'c_')}) SELECT doc_id, CASE WHEN o_headings + 2 * o_tables + o_lists > 0 THEN (c_headings + 2 * c_tables + c_lists) / (o_headings + 2 * o_tables + o_lists) ELSE 1.0 END AS retention FROM a JOIN b USING (doc_id)")
def structure_retention(spark, sf):
    return _docs(spark, sf).select("doc_id", S.retention(S.structure("original"), S.structure("converted")).alias("retention"))


def _heads(lines: str) -> str:
    return f"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS heading_no, line_no, {_LEVEL} AS level, {_TITLE} AS title FROM {lines} WHERE {_HEAD}"


@query(f"WITH {STRUCTURED}, {_sql_lines('original', 'o')} {_heads('o')}")
def document_headings(spark, sf):
    return S.headings(_line_rows(spark, sf))


def _sections(lines: str, start: str) -> str:
    return f"""SELECT doc_id, section_no, min(line_no) AS start, max(line_no) + 1 AS stop, min_by(trimmed, line_no) AS first, string_agg(line, chr(10) ORDER BY line_no) AS content
 FROM (SELECT *, (sum(CASE WHEN {start} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no))::BIGINT AS section_no FROM {lines}) GROUP BY doc_id, section_no"""


def _section_columns(x: str) -> str:
    level, name = _LEVEL.replace("trimmed", "first"), _TITLE.replace("trimmed", "first")
    return f"SELECT doc_id, section_no, CASE WHEN section_no > 0 THEN {level} END AS level, CASE WHEN section_no > 0 THEN {name} END AS title, start, stop, content FROM {x}"


@query(f"WITH {STRUCTURED}, {_sql_lines('original', 'o')}, s AS ({_sections('o', _HEAD)}) {_section_columns('s')} WHERE section_no > 0")
def section_extraction(spark, sf):
    return S.sections(_line_rows(spark, sf))


_H2 = "starts_with(trimmed, '## ')"


@query(f"WITH {STRUCTURED}, {_sql_lines('original', 'o')}, s AS ({_sections('o', _H2)}) {_section_columns('s')}")
def h2_sections(spark, sf):
    return S.h2_sections(_line_rows(spark, sf))


@query(f"""WITH {STRUCTURED}, {_sql_lines('original', 'o')}, n AS (SELECT doc_id, {_ITEM} AS item, lag({_ITEM}) OVER (PARTITION BY doc_id ORDER BY line_no) AS before FROM o WHERE trimmed <> '')
 SELECT doc_id, count(*) FILTER (item AND NOT coalesce(before, false)) AS runs FROM (SELECT DISTINCT doc_id FROM structured) d LEFT JOIN n USING (doc_id) GROUP BY doc_id""")
def list_runs(spark, sf):
    return _docs(spark, sf).select("doc_id", S.list_runs("original").alias("runs"))


def _blocks(lines: str) -> str:
    return f"""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS block_no, start, rows, block FROM (
  SELECT doc_id, min(line_no) AS start, count(*) AS rows, string_agg(line, chr(10) ORDER BY line_no) AS block FROM (
   SELECT *, line_no - row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS island FROM {lines} WHERE starts_with(trimmed, '|') AND ends_with(trimmed, '|')) GROUP BY doc_id, island)"""


@query(f"WITH {STRUCTURED}, {_sql_lines('original', 'o')} {_blocks('o')}")
def table_islands(spark, sf):
    return S.table_blocks(_line_rows(spark, sf))


@query(f"""WITH {STRUCTURED}, {_sql_lines('original', 'o')}, f AS (SELECT *, starts_with(trimmed, '#') OR trimmed = '---' AS alone FROM o),
 p AS (SELECT *, lag(trimmed) OVER w AS before, lag(alone) OVER w AS before_alone FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
 b AS (SELECT *, sum(CASE WHEN trimmed <> '' AND (alone OR before IS NULL OR before = '' OR before_alone) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS g FROM p),
 x AS (SELECT doc_id, g, bool_or(alone) AS alone, regexp_replace(string_agg(trimmed, ' ' ORDER BY line_no), '  +', ' ', 'g') AS block FROM b WHERE trimmed <> '' GROUP BY doc_id, g)
 SELECT d.doc_id, {sql_trim("coalesce(string_agg(block, chr(10) || chr(10) ORDER BY g), '')")} AS markdown,
  coalesce(sum(greatest(1, len(regexp_extract_all(block, '[.!?]+(\\s|$)')))) FILTER (NOT alone), 0)::BIGINT AS sentences, count(*) FILTER (NOT alone)::BIGINT AS paragraphs
 FROM (SELECT DISTINCT doc_id FROM structured) d LEFT JOIN x ON d.doc_id = x.doc_id GROUP BY d.doc_id""")
def paragraph_reflow(spark, sf):
    return _docs(spark, sf).select("doc_id", S.reflow("original").alias("r")).select("doc_id", "r.*")


@query(f"""WITH {STRUCTURED}, {_sql_lines('original', 'o')}, f AS (SELECT *, regexp_matches(trimmed, '^\\|.*\\|') AS bar FROM o),
 p AS (SELECT *, lag(trimmed) OVER w AS before, lag(bar) OVER w AS before_bar FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
 b AS (SELECT *, sum(CASE WHEN trimmed <> '' AND NOT bar AND coalesce(before, '') <> '' AND NOT before_bar AND NOT regexp_matches(before, '[.!?:]$') THEN 0 WHEN trimmed = '' AND before = '' THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS g FROM p),
 x AS (SELECT doc_id, g, CASE WHEN max(trimmed) = '' THEN '' ELSE string_agg(trimmed, ' ' ORDER BY line_no) END AS piece FROM b GROUP BY doc_id, g)
 SELECT doc_id, string_agg(piece, chr(10) ORDER BY g) AS merged FROM x GROUP BY doc_id""")
def broken_line_merge(spark, sf):
    return _docs(spark, sf).select("doc_id", S.merge_lines("original").alias("merged"))


@query(f"""WITH RECURSIVE p AS (SELECT doc_id, string_split(replace(coalesce(text, ''), chr(10), chr(10) || chr(10)), chr(10) || chr(10)) AS ps FROM documents),
 f AS (SELECT doc_id, 0 AS i, ps, ''::VARCHAR AS now, NULL::VARCHAR AS done FROM p
  UNION ALL SELECT doc_id, i + 1, ps, CASE WHEN now = '' OR length(now) + length(ps[i + 1]) > 3000 THEN ps[i + 1] ELSE now || chr(10) || chr(10) || ps[i + 1] END,
   CASE WHEN now <> '' AND length(now) + length(ps[i + 1]) > 3000 THEN now END FROM f WHERE i < len(ps)),
 c AS (SELECT doc_id, i, {sql_trim('done')} AS chunk FROM f WHERE done IS NOT NULL UNION ALL SELECT doc_id, i + 1, {sql_trim('now')} FROM f WHERE i = len(ps) AND {sql_trim('now')} <> '')
 SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS chunk_no, length(chunk)::BIGINT AS n, sha256(chunk) AS digest FROM c""")
def paragraph_chunks(spark, sf):
    text = F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit("\n\n"))
    rows = read(spark, sf, "documents").select("doc_id", F.posexplode(S.chunk_paragraphs(text)).alias("chunk_no", "chunk"))
    return rows.select("doc_id", "chunk_no", F.length("chunk").cast("long").alias("n"), F.sha2("chunk", 256).alias("digest"))


@query(f"""WITH l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), ' ') AS ls FROM documents)),
 s AS (SELECT *, regexp_matches(line, '^\\p{{L}}$') AS single FROM l), g AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, single ORDER BY i) AS island FROM s),
 p AS (SELECT *, CASE WHEN single THEN (row_number() OVER (PARTITION BY doc_id, single, island ORDER BY i) - 1) // 2 END AS pair FROM g),
 q AS (SELECT doc_id, min(i) AS first, string_agg(line, '' ORDER BY i) AS joined FROM p GROUP BY doc_id, single, CASE WHEN single THEN island END, pair, CASE WHEN NOT single THEN i END)
 SELECT doc_id, string_agg(joined, '/' ORDER BY first) AS labels FROM q GROUP BY doc_id""")
def label_repair(spark, sf):
    own = F.split(F.coalesce("text", F.lit("")), " ", -1)
    return read(spark, sf, "documents").select("doc_id", F.array_join(S.repair_labels(own), "/").alias("labels"))


@query(f"""{_BOTH}, h AS ({_heads('o')}), m AS (SELECT *, CASE WHEN starts_with(trimmed, '#') THEN count(*) FILTER (starts_with(trimmed, '#')) OVER (PARTITION BY doc_id ORDER BY line_no) - 1 END AS nth FROM c),
 x AS (SELECT m.doc_id, m.line_no, CASE WHEN h.level IS NOT NULL AND length(regexp_extract(m.trimmed, '^(#+)', 1)) <> h.level THEN repeat('#', h.level::INT) || ' ' || {_TITLE.replace('trimmed', 'm.trimmed')} ELSE m.line END AS line FROM m LEFT JOIN h ON h.doc_id = m.doc_id AND h.heading_no = m.nth)
 SELECT doc_id, {sql_trim("regexp_replace(string_agg(line, chr(10) ORDER BY line_no), '(?m)^(#{1,6})\\s', chr(10) || chr(10) || '\\1 ', 'g')")} AS repaired FROM x GROUP BY doc_id""")
def heading_repair(spark, sf):
    return _docs(spark, sf).select("doc_id", S.repair_headings("converted", "original").alias("repaired"))


@query(f"{_BOTH}, a AS ({_heads('o')}), b AS ({_heads('c')}) SELECT doc_id, heading_no, a.level <> b.level AS level_differs, a.title <> b.title AS text_differs FROM a JOIN b USING (doc_id, heading_no)")
def heading_alignment(spark, sf):
    return S.align_headings(_line_rows(spark, sf), _line_rows(spark, sf, "converted"))


@query(f"""{_BOTH}, a AS ({_counts('o', 'o_')}), b AS ({_counts('c', 'c_')}), n AS (SELECT * FROM a JOIN b USING (doc_id)), ha AS ({_heads('o')}), hb AS ({_heads('c')}),
 al AS (SELECT doc_id, ha.level <> hb.level AS l, ha.title <> hb.title AS t FROM ha JOIN hb USING (doc_id, heading_no)), s AS ({_sections('c', _HEAD)})
 SELECT doc_id, 'error' AS severity, 'missingHeading' AS category, o_headings - c_headings AS amount FROM n WHERE o_headings > c_headings
 UNION ALL SELECT doc_id, 'error', 'missingTable', o_tables - c_tables FROM n WHERE o_tables > c_tables UNION ALL SELECT doc_id, 'warning', 'missingList', o_lists - c_lists FROM n WHERE o_lists > c_lists
 UNION ALL SELECT doc_id, 'warning', 'headingLevelWrong', count(*) FROM al WHERE l GROUP BY 1 UNION ALL SELECT doc_id, 'warning', 'headingTextChanged', count(*) FROM al WHERE t GROUP BY 1
 UNION ALL SELECT doc_id, 'warning', 'emptySection', count(*) FROM s WHERE section_no > 0 AND length({sql_trim('content')}) < 20 GROUP BY 1""")
def structure_findings(spark, sf):
    d = _docs(spark, sf)
    return S.structure_findings(d.select("doc_id", F.col("original").alias("text")), d.select("doc_id", F.col("converted").alias("text")))


@query(f"""{_BOTH}, n AS (SELECT doc_id, {_ITEM} AS item, lag({_ITEM}) OVER (PARTITION BY doc_id ORDER BY line_no) AS before FROM o WHERE trimmed <> ''),
 r AS (SELECT doc_id, count(*) FILTER (item AND NOT coalesce(before, false)) AS runs FROM n GROUP BY doc_id), b AS ({_counts('c', 'c_')}),
 m AS (SELECT doc_id, original AS o, substr(converted, 1, length(converted) // 2) AS c, len({sql_tokens('original')}) AS wi FROM structured),
 x AS (SELECT m.*, len({sql_tokens('c')}) AS wo, CASE WHEN wi > 0 THEN len({sql_tokens('c')}) / wi ELSE 1.0 END AS ratio, coalesce(runs, 0) AS runs FROM m LEFT JOIN r USING (doc_id))
 SELECT doc_id, ratio AS retention_ratio, array_to_string(list_filter([CASE WHEN ratio < 0.7 THEN 'words lost' END, CASE WHEN length(c) < 100 AND length(o) > 1000 THEN 'very short' END, CASE WHEN wo = 0 AND wi > 0 THEN 'no text' END,
  CASE WHEN len(list_filter(string_split(c, chr(10)), lambda line: {_ROW.replace('trimmed', sql_trim('line'))})) = 0 AND (length(o) - length(replace(o, '|', '')) + 1) // 5 > 0 THEN 'tables missing' END,
  CASE WHEN len(list_filter(string_split(c, chr(10)), lambda line: {_ITEM.replace('trimmed', sql_trim('line'))})) = 0 AND runs > 0 THEN 'lists missing' END, CASE WHEN length(c) > 3 * length(o) THEN 'much longer' END], lambda w: w IS NOT NULL), ';') AS warnings,
  NOT (ratio < 0.7 OR length(c) < 100 AND length(o) > 1000 OR wo = 0 AND wi > 0 OR len(list_filter(string_split(c, chr(10)), lambda line: {_ROW.replace('trimmed', sql_trim('line'))})) = 0 AND (length(o) - length(replace(o, '|', '')) + 1) // 5 > 0
   OR len(list_filter(string_split(c, chr(10)), lambda line: {_ITEM.replace('trimmed', sql_trim('line'))})) = 0 AND runs > 0 OR length(c) > 3 * length(o)) AS passed FROM x""")
def content_validation(spark, sf):
    half = F.col("converted").substr(F.lit(1), F.floor(F.length("converted") / 2).cast("int"))
    checked = S.validate_content(_docs(spark, sf).withColumn("converted", half))
    return checked.select("doc_id", "retention_ratio", F.array_join("warnings", ";").alias("warnings"), "passed")


_SIGN = f"array_to_string(list_filter(list_transform({sql_lines('block')}, lambda t: lower(replace(replace(replace({sql_trim('t')}, ' | ', '|'), '| ', '|'), ' |', '|'))), lambda t: t <> ''), chr(10))"


def _ranked(blocks: str) -> str:
    return f"SELECT *, row_number() OVER (PARTITION BY doc_id, signature ORDER BY block_no) AS nth FROM (SELECT *, {_SIGN} AS signature FROM ({blocks}))"


@query(f"{_BOTH}, a AS ({_ranked(_blocks('o'))}), b AS ({_ranked(_blocks('c'))}) SELECT doc_id, block_no, signature FROM a ANTI JOIN b USING (doc_id, signature, nth)")
def missing_tables(spark, sf):
    return S.missing_tables(S.table_blocks(_line_rows(spark, sf)), S.table_blocks(_line_rows(spark, sf, "converted")))


@query(f"""{_BOTH}, a AS ({_ranked(_blocks('o'))}), b AS ({_ranked(_blocks('c'))}), m AS (SELECT doc_id, string_agg(block, chr(10) ORDER BY block_no) AS blocks FROM (SELECT * FROM a ANTI JOIN b USING (doc_id, signature, nth)) GROUP BY doc_id)
 SELECT doc_id, CASE WHEN blocks IS NULL THEN converted ELSE converted || chr(10) || chr(10) || blocks || chr(10) END AS markdown FROM structured LEFT JOIN m USING (doc_id)""")
def table_reinsertion(spark, sf):
    original = S.table_blocks(_line_rows(spark, sf))
    missing = S.missing_tables(original, S.table_blocks(_line_rows(spark, sf, "converted")))
    tables = original.join(missing.select("doc_id", "block_no"), ["doc_id", "block_no"], "left_semi")
    return S.insert_tables(_docs(spark, sf).select("doc_id", F.col("converted").alias("text")), tables)


@query(f"""WITH l AS (SELECT doc_id, {sql_trim('unnest(string_split(t, chr(10)))')} AS line FROM (SELECT doc_id, {sql_trim("coalesce(text, '')")} AS t FROM documents)), k AS (SELECT * FROM l WHERE length(line) > 8), c AS (SELECT doc_id, line, count(*) AS n FROM k GROUP BY ALL),
 d AS (SELECT doc_id, sum(n) AS lines, coalesce(sum(n) FILTER (n > 1), 0) AS repeated FROM c GROUP BY doc_id)
 SELECT doc_id, CASE WHEN coalesce(lines, 0) > 4 THEN repeated / lines ELSE 0.0 END AS penalty FROM documents LEFT JOIN d USING (doc_id)""")
def duplicate_lines(spark, sf):
    return read(spark, sf, "documents").select("doc_id", S.duplication_penalty("text").alias("penalty"))


@query(f"""WITH {STRUCTURED}, l AS (SELECT doc_id, list_filter(list_transform({sql_lines('substr(original, 1, 8000)')}, lambda t: {sql_trim('t')}), lambda t: t <> '') AS ls FROM structured)
 SELECT doc_id, coalesce(list_filter(list_transform(list_slice(ls, 1, 5), lambda t: regexp_replace(t, '^#+\\s*', '')), lambda t: length(t) > 5 AND length(t) < 200 AND NOT ends_with(t, '.'))[1],
  substr(list_filter(list_slice(ls, 1, 10), lambda t: starts_with(t, '# '))[1], 3)) AS title FROM l""")
def title_pick(spark, sf):
    return _docs(spark, sf).select("doc_id", S.title("original").alias("title"))
