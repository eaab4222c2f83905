"""Structure of Markdown texts: lines, headings, sections, lists and tables, their comparison and their repair.

Line tables have doc_id, line_no (from 0), line and trimmed. Work inside one document stays inside its row wherever
the text itself is the result; rows are made only where lines are what is asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliowork.functions.text import col, let, line_ends, lines, table_signature, trim_all, word_count

#: Shares and lengths below which content is reported.
RETAINED, SHORT_OUTPUT, LONG_INPUT, GROWN, SHORT_SECTION = 0.7, 100, 1000, 3, 20


def line_table(df: DataFrame, text_column: str = "text", id_column: str = "doc_id") -> DataFrame:
    """(doc_id, line_no, line, trimmed) of every text; a null text has one empty line."""
    rows = df.select(F.col(id_column).alias("doc_id"), F.posexplode(lines(col(text_column))).alias("line_no", "line"))
    return rows.withColumn("trimmed", trim_all(F.col("line")))


def _marks(trimmed: Column) -> Column:
    return F.length(F.regexp_extract(trimmed, "^(#+)", 1))


def _title(trimmed: Column) -> Column:
    return trim_all(F.regexp_replace(trimmed, "^#+", ""))


def is_heading(trimmed: Column) -> Column:
    return trimmed.startswith("#") & (_title(trimmed) != "")


def is_table_row(trimmed: Column) -> Column:
    """More than one cell that is not blank; rules of dashes count too. A row is read up to its second such cell."""
    return F.contains(trimmed, F.lit("|")) & ~trimmed.startswith("#") & F.regexp_like(trimmed, F.lit(r"\A[|\s]*+[^|\s][^|]*+\|[|\s]*+[^|\s]"))


def is_list_item(trimmed: Column) -> Column:
    return trimmed.startswith("- ") | trimmed.startswith("* ")


def structure(text: Column | str) -> Column:
    """struct(headings, tables, lists): headings with text, table rows, list items."""


    def counts(own: Column) -> Column:
        count = lambda test: F.size(F.filter(own, test)).cast("long")
        return F.struct(count(is_heading).alias("headings"), count(is_table_row).alias("tables"), count(is_list_item).alias("lists"))

    return let(F.transform(lines(col(text)), trim_all), counts)


def retention(original: Column, converted: Column) -> Column:
    """Weighted share of the structure that was kept; tables count twice; 1 if there was none; may pass 1."""

    def total(s: Column) -> Column:
        return s["headings"] + 2 * s["tables"] + s["lists"]

    return F.when(total(original) > 0, total(converted) / total(original)).otherwise(1.0)


def headings(line_rows: DataFrame) -> DataFrame:
    """(doc_id, heading_no, line_no, level, title), numbered from 0 in each document."""
    own = line_rows.filter(is_heading(F.col("trimmed")))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no")) - 1
    return own.select("doc_id", number.alias("heading_no"), "line_no", _marks(F.col("trimmed")).alias("level"), _title(F.col("trimmed")).alias("title"))


def sections(line_rows: DataFrame, starts=is_heading, keep_lead: bool = False) -> DataFrame:
    """(doc_id, section_no, level, title, start, stop, content): from a heading to the next one; content has the heading.

    Lines before the first heading belong to no section, unless `keep_lead` keeps them as section 0 without a title.
    """
    order = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = line_rows.withColumn("section_no", F.sum(F.when(starts(F.col("trimmed")), 1).otherwise(0)).over(order))
    grouped = numbered.groupBy("doc_id", "section_no").agg(
        F.min("line_no").alias("start"), (F.max("line_no") + 1).alias("stop"), F.min_by("trimmed", "line_no").alias("first"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda r: r["line"]), "\n").alias("content"),
    )
    kept = grouped if keep_lead else grouped.filter("section_no > 0")
    lead = F.col("section_no") == 0
    return kept.select("doc_id", "section_no", F.when(~lead, _marks(F.col("first"))).alias("level"), F.when(~lead, _title(F.col("first"))).alias("title"), "start", "stop", "content")


def h2_sections(line_rows: DataFrame) -> DataFrame:
    """Sections that start at lines of level two; what comes before stays as an untitled one."""
    return sections(line_rows, lambda t: t.startswith("## "), keep_lead=True)


def list_runs(text: Column | str) -> Column:
    """Runs of list lines; blank lines do not end a run, other text does."""
    own = F.filter(F.transform(lines(col(text)), trim_all), lambda t: t != "")
    return F.aggregate(
        own, F.struct(F.lit(0).cast("long").alias("n"), F.lit(False).alias("inside")),
        lambda acc, t: F.struct((acc["n"] + F.when(is_list_item(t) & ~acc["inside"], 1).otherwise(0)).alias("n"), is_list_item(t).alias("inside")),
        lambda acc: acc["n"],
    )


def table_blocks(line_rows: DataFrame) -> DataFrame:
    """(doc_id, block_no, start, rows, block): maximal runs of lines that begin and end with a bar."""
    bars = line_rows.filter(F.col("trimmed").startswith("|") & F.col("trimmed").endswith("|"))
    order = Window.partitionBy("doc_id").orderBy("line_no")
    islands = bars.withColumn("island", F.col("line_no") - F.row_number().over(order)).groupBy("doc_id", "island").agg(
        F.min("line_no").alias("start"), F.count("*").alias("rows"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda r: r["line"]), "\n").alias("block")
    )
    return islands.select("doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("start")) - 1).alias("block_no"), "start", "rows", "block")


def reflow(text: Column | str) -> Column:
    """struct(markdown, sentences, paragraphs): body lines joined into paragraphs, headings and `---` alone.

    A blank line ends a paragraph and runs of spaces become one. A sentence ends with . ! or ? before a space or the end.
    """
    own = F.transform(lines(col(text)), trim_all)

    def alone(t: Column) -> Column:
        return t.startswith("#") | (t == "---")

    def joined(own: Column) -> Column:
        """Every line with what parts it from the block before, which only the line before decides; no block holds a line break."""

        def piece(t: Column, k: Column) -> Column:
            last = F.coalesce(F.get(own, k - 1), F.lit(""))
            return F.when(t == "", "").when(~alone(t) & (last != "") & ~alone(last), F.concat(F.lit(" "), t)).otherwise(F.concat(F.lit("\n"), t))

        return F.array_join(F.transform(own, piece), "")

    parts = F.filter(F.split(let(own, joined), "\n", -1), lambda b: b != "")
    blocks = F.transform(parts, lambda b: F.regexp_replace(b, "  +", " "))
    body = F.filter(blocks, lambda b: ~alone(b))
    ends = F.transform(body, lambda b: F.greatest(F.regexp_count(b, F.lit(r"[.!?]+(?=\s|$)")), F.lit(1)))
    sentences = F.aggregate(ends, F.lit(0).cast("long"), lambda acc, n: acc + n)
    return F.struct(trim_all(F.array_join(blocks, "\n\n")).alias("markdown"), sentences.alias("sentences"), F.size(body).cast("long").alias("paragraphs"))


def merge_lines(text: Column | str) -> Column:
    """Broken lines joined into paragraphs.

    A line goes on with the paragraph unless that ended in . ! ? or :, as both ways of going on give the same text;
    blank lines and table rows stand alone; of several blank lines one stays.
    """
    own = F.transform(lines(col(text)), trim_all)

    def bar_row(t: Column) -> Column:
        return F.regexp_like(t, F.lit(r"^\|.*\|"))

    def joined(own: Column) -> Column:
        """Every line with what parts it from the one before, which alone decides it."""

        def piece(t: Column, k: Column) -> Column:
            last = F.get(own, k - 1)
            goes_on = (t != "") & (last != "") & ~bar_row(t) & ~bar_row(last) & ~F.regexp_like(last, F.lit("[.!?:]$"))
            return F.when(k == 0, t).when((t == "") & (last == ""), "").when(goes_on, F.concat(F.lit(" "), t)).otherwise(F.concat(F.lit("\n"), t))

        return F.array_join(F.transform(own, piece), "")

    return F.get(F.transform(F.array(own), joined), 0)  # the lines are cut once


def chunk_paragraphs(text: Column | str, most: int = 3000) -> Column:
    """Paragraphs packed greedily into chunks of `most` characters; a longer one is a chunk alone."""
    parts = F.split(col(text), "\n\n", -1)
    zero = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def step(acc: Column, p: Column) -> Column:
        full = (F.length(acc["now"]) + F.length(p) > most) & (acc["now"] != "")
        done = F.when(full, F.concat(acc["done"], F.array(trim_all(acc["now"])))).otherwise(acc["done"])
        now = F.when(full | (acc["now"] == ""), p).otherwise(F.concat(acc["now"], F.lit("\n\n"), p))
        return F.struct(done.alias("done"), now.alias("now"))

    return F.aggregate(parts, zero, step, lambda acc: F.when(trim_all(acc["now"]) != "", F.concat(acc["done"], F.array(trim_all(acc["now"])))).otherwise(acc["done"]))


def repair_labels(own: Column) -> Column:
    """Of an array of lines, neighbouring lines of one letter each are joined in pairs, from the first on."""


    def paired(own: Column) -> Column:
        # One digit for each line: 1 is a letter, and each second one of a pair becomes 2.
        letter = lambda t: (F.length(t) <= 2) & F.regexp_like(t, F.lit(r"^\p{L}$"))
        digits = F.array_join(F.transform(own, lambda t: F.when(letter(t), "1").otherwise("0")), "")
        marks = F.regexp_extract_all(F.regexp_replace(digits, "11", "12"), F.lit("."), F.lit(0))

        def joined(marks: Column) -> Column:
            second = lambda k: F.coalesce(F.get(marks, k) == "2", F.lit(False))
            return F.array_compact(F.transform(own, lambda t, k: F.when(~second(k), F.when(second(k + 1), F.concat(t, F.get(own, k + 1))).otherwise(t))))

        return let(marks, joined)

    return let(own, paired)


def repair_headings(converted: Column | str, original: Column | str) -> Column:
    """The i-th heading line gets the level of the original's i-th heading, and blank lines come before each heading."""
    levels = F.transform(F.filter(F.transform(lines(col(original)), trim_all), is_heading), _marks)
    # The text is cut before every heading line, so a piece's number is that of its heading; a lead takes no number.
    whole = line_ends(col(converted))
    pieces = F.split(F.concat(F.lit("\n"), whole), r"\n(?=[ \t\x0B\f]*+#)", -1)

    def by(wanted: Column) -> Column:
        def fix(piece: Column, k: Column) -> Column:
            line = F.substring_index(piece, "\n", 1)
            level = F.get(wanted, k - 1)

            def leveled(t: Column) -> Column:
                return F.when(_marks(t) != level, F.concat(F.repeat(F.lit("#"), level), F.lit(" "), _title(t), F.substr(piece, F.length(line) + 1))).otherwise(piece)

            return F.when((k > 0) & (k <= F.size(wanted)), let(trim_all(line), leveled)).otherwise(piece)

        return F.array_join(F.transform(pieces, fix), "\n")

    joined = F.substr(let(levels, by), F.lit(2))
    return trim_all(F.regexp_replace(joined, r"(?m)^(#{1,6})\s", "\n\n$1 "))


def align_headings(original: DataFrame, converted: DataFrame) -> DataFrame:
    """(doc_id, heading_no, level_differs, text_differs) of headings at the same place in both."""
    a, b = (headings(x).select("doc_id", "heading_no", F.col("level").alias(f"{n}_level"), F.col("title").alias(f"{n}_title")) for n, x in (("o", original), ("c", converted)))
    differs = [(F.col("o_level") != F.col("c_level")).alias("level_differs"), (F.col("o_title") != F.col("c_title")).alias("text_differs")]
    return a.join(b, ["doc_id", "heading_no"]).select("doc_id", "heading_no", *differs)


def _outline(text: Column | str) -> Column:
    """struct(headings, short): the heading lines in order, trimmed, and the number of sections shorter than SHORT_SECTION."""
    pieces = F.split(F.concat(F.lit("\n"), line_ends(col(text))), r"\n(?=[ \t\x0B\f]*+#++[ \t\x0B\f]*+[^\n])", -1)  # each but the first is a section

    def outline(own: Column) -> Column:
        heads = F.transform(own, lambda piece: trim_all(F.substring_index(piece, "\n", 1)))
        short = F.filter(own, lambda piece: F.length(trim_all(piece)) < SHORT_SECTION)
        return F.struct(heads.alias("headings"), F.size(short).alias("short"))

    return let(let(pieces, lambda own: F.slice(own, F.lit(2), F.size(own))), outline)


def structure_findings(original: DataFrame, converted: DataFrame) -> DataFrame:
    """(doc_id, severity, category, amount): what the conversion has less of, headings that differ, empty sections.

    Both frames have doc_id and text; ids are unique. Headings and short sections are found where the text lies; heading lines, not
    texts, meet in one join.
    """
    a = original.select("doc_id", structure("text").alias("o"), _outline("text").alias("p"))
    b = converted.select("doc_id", structure("text").alias("c"), _outline("text").alias("q"))
    both = b.join(a, "doc_id", "left")

    def finding(severity: str, category: str, amount: Column) -> Column:
        return F.when(amount > 0, F.struct(F.lit(severity).alias("severity"), F.lit(category).alias("category"), amount.cast("long").alias("amount")))

    def differing(of) -> Column:
        pairs = F.zip_with("p.headings", "q.headings", lambda x, y: of(x) != of(y))  # null where one side has no heading at this place
        return F.size(F.filter(pairs, lambda x: x))

    lost = [(severity, category, F.col(f"o.{kind}") - F.col(f"c.{kind}")) for kind, severity, category in (("headings", "error", "missingHeading"), ("tables", "error", "missingTable"), ("lists", "warning", "missingList"))]
    changed = [("headingLevelWrong", differing(lambda h: _marks(h))), ("headingTextChanged", differing(lambda h: _title(h))), ("emptySection", F.col("q.short"))]
    return both.select("doc_id", F.inline(F.array_compact(F.array(*(finding(*x) for x in lost), *(finding("warning", *x) for x in changed)))))


#: What `measured` adds: structure and words of the original and of the converted text.
MEASURES = ("_structure_in", "_structure_out", "_words_in", "_words_out")


def measured(df: DataFrame, original: str = "original", converted: str = "converted", same: Column | None = None) -> DataFrame:
    """The frame with MEASURES, each a column that is made once; where `same` holds, both texts are one and the first is measured."""
    o, c = col(original), col(converted)
    either = lambda first, second: second if same is None else F.when(same, F.col(first)).otherwise(second)
    once = df.withColumns({"_structure_in": structure(o), "_words_in": word_count(o)})
    return once.withColumns({"_structure_out": either("_structure_in", structure(c)), "_words_out": either("_words_in", word_count(c))})


def validate_content(df: DataFrame, original: str = "original", converted: str = "converted") -> DataFrame:
    """The frame with retention_ratio, warnings (array) and passed: word loss, short, empty, grown, lost tables or lists."""
    return judge_content(measured(df, original, converted), original, converted).drop(*MEASURES)


def judge_content(df: DataFrame, original: str = "original", converted: str = "converted") -> DataFrame:
    """`validate_content` of a frame that is measured."""
    o, c = col(original), col(converted)
    before, after, words_in, words_out = (F.col(x) for x in MEASURES)
    ratio = F.when(words_in > 0, words_out / words_in).otherwise(1.0)
    expected_tables = F.floor((F.length(o) - F.length(F.replace(o, F.lit("|"), F.lit(""))) + 1) / 5)
    warnings = F.array_compact(
        F.array(
            F.when(ratio < RETAINED, "words lost"),
            F.when((F.length(c) < SHORT_OUTPUT) & (F.length(o) > LONG_INPUT), "very short"),
            F.when((words_out == 0) & (words_in > 0), "no text"),
            F.when((after["tables"] == 0) & (expected_tables > 0), "tables missing"),
            F.when((after["lists"] == 0) & (before["lists"] > 0), "lists missing"),
            F.when(F.length(c) > GROWN * F.length(o), "much longer"),
        )
    )
    return df.withColumns({"retention_ratio": ratio, "warnings": warnings}).withColumn("passed", F.size("warnings") == 0)


def missing_tables(original: DataFrame, output: DataFrame) -> DataFrame:
    """(doc_id, block_no, signature) of the original's table blocks that no block of the output matches, one for one."""

    def ranked(rows: DataFrame) -> DataFrame:
        signed = rows.withColumn("signature", table_signature("block"))
        return signed.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "signature").orderBy("block_no")))

    return ranked(original).join(ranked(output).select("doc_id", "signature", "nth"), ["doc_id", "signature", "nth"], "left_anti").select("doc_id", "block_no", "signature")


def insert_tables(converted: DataFrame, tables: DataFrame, after_heading: str | None = None) -> DataFrame:
    """(doc_id, markdown): each document's missing tables at its end, or at the end of the section with a heading.

    `converted` has doc_id and text, `tables` has doc_id, block_no and block. A blank line comes before and after.
    """
    grouped = tables.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("block_no", "block"))), lambda r: r["block"]).alias("blocks"))
    own = lines(col("text"))
    trimmed = F.transform(own, trim_all)
    end = F.size(own)
    if after_heading is not None:
        hit = F.array_position(F.transform(trimmed, lambda t: F.contains(t, F.lit(after_heading))), True)
        rest = F.transform(F.slice(trimmed, hit + 1, F.size(own)), lambda t: t.startswith("#"))
        stop = F.array_position(rest, True)
        end = F.when(hit == 0, F.size(own)).when(stop == 0, F.size(own)).otherwise(hit + stop - 1)
    with_tables = F.concat(F.slice(own, 1, end.cast("int")), F.array(F.lit("")), F.col("blocks"), F.array(F.lit("")), F.slice(own, (end + 1).cast("int"), F.size(own)))
    joined = converted.join(grouped, "doc_id", "left")
    return joined.select("doc_id", F.when(F.col("blocks").isNull(), col("text")).otherwise(F.array_join(with_tables, "\n")).alias("markdown"))


def duplication_penalty(text: Column | str) -> Column:
    """Share of the lines of nine characters and more that occur more than once, where there are five or more of them."""
    own = F.filter(F.transform(lines(trim_all(col(text))), trim_all), lambda t: F.length(t) > 8)
    zero = F.struct(F.lit("").alias("last"), F.lit(0).cast("long").alias("run"), F.lit(0).cast("long").alias("repeated"))

    def step(acc: Column, t: Column) -> Column:
        same = t == acc["last"]
        more = F.when(same, F.when(acc["run"] == 1, 2).otherwise(1)).otherwise(0)
        return F.struct(t.alias("last"), F.when(same, acc["run"] + 1).otherwise(1).cast("long").alias("run"), (acc["repeated"] + more).alias("repeated"))

    def share(kept: Column) -> Column:
        repeated = F.aggregate(F.sort_array(kept), zero, step)["repeated"] / F.size(kept)
        return F.when((F.size(kept) <= 4) | (F.size(F.array_distinct(kept)) == F.size(kept)), 0.0).otherwise(repeated)

    return let(own, share)


def title(text: Column | str) -> Column:
    """The first of the first five lines with text that is 6 to 199 characters without marks and has no final dot.

    Where there is none, the first `# ` line of the first ten.
    """
    own = F.filter(F.transform(lines(F.substring(col(text), 1, 8000)), trim_all), lambda t: t != "")
    clean = F.transform(F.slice(own, 1, 5), lambda t: F.regexp_replace(t, r"^#+\s*", ""))
    good = F.filter(clean, lambda t: (F.length(t) > 5) & (F.length(t) < 200) & ~t.endswith("."))
    level_one = F.filter(F.slice(own, 1, 10), lambda t: t.startswith("# "))
    return F.coalesce(F.get(good, 0), F.substring(F.get(level_one, 0), 3, 8000))
