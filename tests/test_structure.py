from pyspark.sql import functions as F

from foliowork.operators import structure as S

DOC = "# Title\n\nintro\n## A\n- x\n\n- y\ntext\n* z\n| a | b |\n|---|---|\n| 1 | 2 |\n## B\n"


def frame(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")


def test_counts_sections_and_runs(spark):
    df = frame(spark, DOC, None, "")
    rows = df.select("doc_id", S.structure("text").alias("s"), S.list_runs("text").alias("r")).orderBy("doc_id").collect()
    assert [(*r.s, r.r) for r in rows] == [(3, 3, 3, 2), (0, 0, 0, 0), (0, 0, 0, 0)]
    parts = S.sections(S.line_table(df)).orderBy("section_no").collect()
    assert [(p.title, p.level, p.start, p.stop) for p in parts] == [("Title", 1, 0, 3), ("A", 2, 3, 12), ("B", 2, 12, 14)]
    assert [(b.start, b.rows) for b in S.table_blocks(S.line_table(df)).collect()] == [(9, 3)]
    lead = S.h2_sections(S.line_table(df.filter("doc_id = 0"))).orderBy("section_no").collect()
    assert [p.title for p in lead] == [None, "A", "B"]


def test_reflow_and_merging(spark):
    text = "# H\nbroken\nline here. And  more.\n\n---\nnext"
    r = frame(spark, text).select(S.reflow("text").alias("r")).first().r
    assert r.markdown == "# H\n\nbroken line here. And more.\n\n---\n\nnext" and (r.sentences, r.paragraphs) == (3, 2)
    merged = frame(spark, "a\nb.\nc\n\n\n\n| x | y |\nd").select(S.merge_lines("text")).first()[0]
    assert merged == "a b.\nc\n\n| x | y |\nd"
    chunks = frame(spark, "aaaa\n\nbbbb\n\n" + "c" * 20).select(S.chunk_paragraphs("text", 10)).first()[0]
    assert chunks == ["aaaa\n\nbbbb", "c" * 20]
    labels = spark.range(1).select(S.repair_labels(F.array(*map(F.lit, ["A", "B", "C", "word", "D", "1"])))).first()[0]
    assert labels == ["AB", "C", "word", "D", "1"]


def test_duplication_title_and_validation(spark):
    lines = "repeated line\nrepeated line\nunique one here\nanother unique\nlast unique line\nshort"
    assert frame(spark, lines).select(S.duplication_penalty("text")).first()[0] == 2 / 5
    assert frame(spark, "a b c\n\nx\n# A real title\nmore.").select(S.title("text")).first()[0] == "A real title"
    df = spark.createDataFrame([(1, "word " * 300, "")], "doc_id int, original string, converted string")
    r = S.validate_content(df).first()
    assert r.warnings == ["words lost", "very short", "no text"] and not r.passed and r.retention_ratio == 0


def test_repairs(spark):
    original, converted = "# One\ntext\n### Two\n| a | b |\n| 1 | 2 |", "## One\ntext\n# Two"
    fixed = spark.createDataFrame([(converted, original)], "c string, o string").select(S.repair_headings("c", "o")).first()[0]
    assert fixed == "# One\ntext\n\n\n### Two"
    tables = S.table_blocks(S.line_table(frame(spark, original)))
    lost = S.missing_tables(tables, S.table_blocks(S.line_table(frame(spark, converted))))
    assert lost.count() == 1
    for other, n in (("|a|B |\n|1|2|", 0), ("| A | B |\n| 1 | 2 |", 0), ("| A | B |\n| 1 | 3 |", 1)):
        assert S.missing_tables(tables, S.table_blocks(S.line_table(frame(spark, other)))).count() == n
    out = S.insert_tables(frame(spark, converted), tables).first().markdown
    assert out == converted + "\n\n| a | b |\n| 1 | 2 |\n"
    after = S.insert_tables(frame(spark, converted), tables, after_heading="One").first().markdown
    assert after == "## One\ntext\n\n| a | b |\n| 1 | 2 |\n\n# Two"
    findings = S.structure_findings(frame(spark, original), frame(spark, converted)).collect()
    assert {(f.category, f.amount) for f in findings} == {("missingTable", 2), ("headingLevelWrong", 2), ("emptySection", 2)}
