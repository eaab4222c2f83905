from pyspark.sql import functions as F

from foliowork.functions import text as X


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return row.select(column.alias("x")).first()[0]


def test_counts(spark):
    t = "Hello,  world ## 42\n<b>x</b> ![pic](u) <!-- no -->"
    assert [one(spark, f("t"), t=t) for f in (X.wc_any, X.wc_alnum, X.wc_meaningful)] == [9, 6, 4]
    assert one(spark, X.wc_any(F.lit(None).cast("string"))) == 0
    assert one(spark, X.reading_minutes("t"), t="w " * 450) == 2 and one(spark, X.reading_minutes("t"), t="") == 1
    assert one(spark, X.snippet("t"), t="a\nb " + "c " * 30) == " ".join(["a", "b", *["c"] * 16])


def test_artifacts(spark):
    assert one(spark, X.artifact_count("t"), t="a\n12\nb co- operate aaaaaaaaa ---------- ­") == 4
    assert one(spark, X.artifact_count("t"), t="x ======== ||||||||| �") == 1
    assert one(spark, X.ocr_artifacts("t"), t="ﬁne ﬂy ﬀ �") == 4


def test_similarities(spark):
    assert one(spark, X.token_f1("a", "b"), a="the cat", b="The dog") == 0.5
    assert one(spark, X.token_f1("a", "b"), a=" ", b="") == 1.0 and one(spark, X.token_f1("a", "b"), a="x", b="") == 0.0
    assert one(spark, X.cer("a", "b"), a="abcd", b="abxd") == 0.25 and one(spark, X.cer("a", "b"), a="", b="x") == 1.0
    assert one(spark, X.cer("a", "b"), a="ab", b="abcdefgh") == 3.0 and one(spark, X.cer("a", "b", True), a="ab", b="abcdefgh") == 1.0
    assert one(spark, X.wer("a", "b"), a="one two three four", b="one 2 three") == 0.5 and one(spark, X.wer("a", "b"), a="", b="") == 0.0
    assert one(spark, X.norm_lev("a", "b"), a="", b="") == 0.0 and one(spark, X.norm_lev("a", "b"), a="ab", b="") == 1.0
    assert one(spark, X.agreement("a", "b"), a="Alpha beta!", b="beta gamma") == 0.5
    assert one(spark, X.completeness("a", "b"), a="", b="x") == 1.0


def test_markup_rules(spark):
    cases = {"2.1 Overview": "### 2.1 Overview", "CAPSTONE": "# CAPSTONE", "1. we did": None, "A SENTENCE.": None, "Intro .... 4": None, "1 Executive Summary": "## 1 Executive Summary", "X": None}
    assert {k: one(spark, X.heading_markup("t"), t=k) for k in cases} == cases
    assert one(spark, X.clean_hyphens("t"), t="start- up and a - b") == "start-up and a - b"
    assert one(spark, X.md_escape_block("t"), t="# x") == "\\# x" and one(spark, X.md_escape_block("t"), t="12. x") == "12\\. x" and one(spark, X.md_escape_block("t"), t="#x") == "#x"
    assert one(spark, X.md_escape("t"), t="a_b [c] `d`") == "a\\_b \\[c\\] \\`d\\`"
    assert one(spark, X.yaml_str("t"), t='a "b"\\\n') == '"a \\"b\\"\\\\\\n"'
    assert one(spark, X.decode_non_ascii("t"), t="a%20b%C3%A9%FFc%2F") == "a%20b%C3%A9%FFc%2F"
    assert one(spark, X.decode_non_ascii("t"), t="a%20/%C3%A9?") == "a%20/é?"
    assert one(spark, X.is_figure("t"), t="1\n2\n3.5\nlabel") is True and one(spark, X.is_figure("t"), t="1\n2\n3\nA sentence.") is False


def test_formats(spark):
    assert [one(spark, X.fmt_duration(F.lit(s))) for s in (59.9, 60.0, 61.0)] == ["59s", "1m", "1m 1s"]
    assert one(spark, X.fmt_clock(F.lit(3661.4))) == "1:01:01" and one(spark, X.fmt_timestamp(F.lit(75.0))) == "1:15"
    body = one(spark, X.transcript_markdown(F.lit("en"), F.lit(90.0), F.lit(0.876), F.lit("hi")))
    assert body == "## Transcript\n\n> Language: en  \n> Duration: 1m 30s  \n> Confidence: 87%\n\nhi"


def test_word_error_rate_of_large_vocabularies(spark):
    r = [f"w{k}" for k in range(40)]
    h = r[:7] + [f"x{k}" for k in range(20_500)] + r[8:]
    assert one(spark, X.wer("a", "b"), a=" ".join(r), b=" ".join(h)) == 20_500 / 40
    assert one(spark, X.wer("a", "b", True), a=" ".join(r), b=" ".join(h)) == 1.0
    assert X.word_distance("kitten", "sitting") == 3 and X.word_distance("", "ab") == X.word_distance("ab", "") == 2
