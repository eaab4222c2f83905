"""Column functions over text: counts, normalisation, similarity, repair, escaping and formatting.

All are built-in expressions that Spark compiles, but for the word distance of very large vocabularies; a null text counts as an empty one unless a function says otherwise.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Ligatures and marks that recognition leaves behind.
REPLACEMENT, SOFT_HYPHEN, LIGATURES = "�", "­", "ﬁﬂﬀ"
#: Capitalised names of organisations.
ORGANISATIONS = (
    r"\b[A-Z][A-Za-z&.-]+(?:\s+[A-Z][A-Za-z&.-]+){0,3}\s+(?:Inc\.?|Corp\.?|Corporation|Company|University|Institute|Laboratory|Labs|LLC|Ltd\.?)\b",
    r"\b(?:University|Institute|Laboratory|Labs)\s+of\s+[A-Z][A-Za-z&.-]+(?:\s+[A-Z][A-Za-z&.-]+){0,2}\b",
)
#: Picture metadata that is shown, in order.
METADATA_KEYS = (
    "TIFF.Make", "TIFF.Model", "TIFF.Software", "Exif.DateTimeOriginal", "Exif.LensModel", "GPS.Latitude", "GPS.Longitude",
    "PNG.Title", "PNG.Author", "IPTC.ObjectName", "IPTC.Byline", "IPTC.CopyrightNotice",
)


def col(x: Column | str) -> Column:
    return F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit(""))


def trim_all(x: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(x, F.lit(" \t\n\x0b\f\r"))


def line_ends(x: Column) -> Column:
    """The text with LF where CR LF or CR ends a line."""
    return F.replace(F.replace(x, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def lines(x: Column) -> Column:
    """Lines of a text; CR LF and CR end a line like LF does."""
    return F.split(line_ends(x), "\n", -1)


def tokens(x: Column) -> Column:
    """Runs of non-blank characters."""
    return F.filter(F.split(x, r"\s+", -1), lambda t: t != "")


def let(value: Column, f) -> Column:
    """f(value) with the value computed once, also where f uses it inside another lambda."""
    return F.get(F.transform(F.array(value), f), 0)


# Counts


def word_count(x: Column) -> Column:
    """The number of tokens; a text without white space at its ends has no empty ones."""
    bare = trim_all(x)
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, r"\s+", -1)))


def wc_any(x) -> Column:
    return word_count(col(x)).cast("long")


def wc_alnum(x) -> Column:
    """Tokens that hold a letter or digit."""
    return F.size(F.filter(tokens(col(x)), lambda t: F.regexp_like(t, F.lit(r"[\p{L}\p{N}]")))).cast("long")


def wc_meaningful(x) -> Column:
    """Words that remain without comments, pictures and tags."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(col(x), r"(?s)<!--.*?-->", " "), r"!\[[^\]]*\]\([^)]*\)", " "), r"</?[^>]+>", " ")
    return F.regexp_count(bare, F.lit(r"[\p{L}\p{N}]+(?:['’-][\p{L}\p{N}]+)*")).cast("long")


def reading_minutes(x) -> Column:
    """At 200 words a minute, one at least."""
    return F.greatest(F.lit(1), F.floor(wc_any(x) / 200)).cast("long")


def snippet(x, words: int = 18) -> Column:
    return F.array_join(F.slice(F.filter(F.split(F.replace(col(x), F.lit("\n"), F.lit(" ")), " ", -1), lambda t: t != ""), 1, words), " ")


def ocr_artifacts(x) -> Column:
    return F.regexp_count(col(x), F.lit(f"[{REPLACEMENT}{SOFT_HYPHEN}{LIGATURES}]")).cast("long")


def artifact_count(x) -> Column:
    """Replacement characters, soft hyphens, lone page numbers, words broken at a hyphen, and runs of one character."""
    text = trim_all(col(x))
    count = lambda p: F.regexp_count(text, F.lit(p))
    # What most texts lack is looked for first in a plainer way.
    marks = F.when(F.contains(text, F.lit(REPLACEMENT)) | F.contains(text, F.lit(SOFT_HYPHEN)), count(f"[{REPLACEMENT}{SOFT_HYPHEN}]")).otherwise(0)
    hyphens = F.when(F.regexp_like(text, F.lit(r"-\s")), count(r"[A-Za-z]-\s+[a-z]")).otherwise(0)
    return (marks + count(r"\n\d{1,3}\n") + hyphens + count(r"([^\-|= \t])\1{8}\1*+")).cast("long")


def artifact_penalty(x, words: Column | None = None) -> Column:
    """Artifacts for each fiftieth of the words, 1 at most; `words` is the number of words where it is known."""
    return F.least(F.lit(1.0), artifact_count(x) / F.greatest(F.lit(1), wc_any(trim_all(col(x))) if words is None else words) * 50.0)


# Normal forms and sets


def norm_text(x) -> Column:
    return F.array_join(tokens(col(x)), " ")


def norm_answer(x) -> Column:
    return norm_text(F.lower(col(x)))


def token_set(x, longer_than: int = 2) -> Column:
    """Distinct lower-case runs of letters and digits above a length: 2 for scores, 1 for lists."""
    return F.array_distinct(F.filter(F.split(F.lower(col(x)), r"[^\p{L}\p{N}]+", -1), lambda t: F.length(t) > longer_than))


def overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)).cast("long")


def agreement(candidate, reference) -> Column:
    """Share of the reference's token set that the candidate has; 0 if either is empty."""
    return let(F.struct(token_set(candidate).alias("a"), token_set(reference).alias("b")), lambda p: set_agreement(p["a"], p["b"]))


def set_agreement(a: Column, b: Column) -> Column:
    """Share of the set `b` that `a` has; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(overlap(a, b) / F.size(b))


def completeness(reference, text) -> Column:
    """Share of the reference's distinct words, case kept, that the text has; 1 without a reference."""
    words = F.struct(F.array_distinct(tokens(col(reference))).alias("r"), tokens(col(text)).alias("h"))
    return let(words, lambda p: F.when(F.size(p["r"]) == 0, 1.0).otherwise(overlap(p["r"], p["h"]) / F.size(p["r"])))


def token_f1(answer, text) -> Column:
    def sets(p: Column) -> Column:
        return F.struct(p["a"].alias("a"), p["b"].alias("b"), overlap(p["a"], p["b"]).alias("common"))

    def f1(p: Column) -> Column:
        common, precision, recall = p["common"], p["common"] / F.size(p["b"]), p["common"] / F.size(p["a"])
        both_empty = (F.size(p["a"]) == 0) & (F.size(p["b"]) == 0)
        none = (F.size(p["a"]) == 0) | (F.size(p["b"]) == 0) | (common == 0)
        return F.when(both_empty, 1.0).when(none, 0.0).otherwise(2 * precision * recall / (precision + recall))

    own = F.struct(F.array_distinct(tokens(F.lower(col(answer)))).alias("a"), F.array_distinct(tokens(F.lower(col(text)))).alias("b"))
    return let(let(own, sets), f1)


# Edit distances


def _rate(distance: Column, n: Column, empty_other: Column, cap: bool) -> Column:
    rate = F.when(n == 0, F.when(empty_other, 0.0).otherwise(1.0)).otherwise(distance / n)
    return F.least(F.lit(1.0), rate) if cap else rate


def cer(reference, text, cap: bool = False) -> Column:
    """Character error rate: normalised and uncapped, or on the raw texts and capped at 1."""
    r, h = (col(reference), col(text)) if cap else (norm_text(reference), norm_text(text))
    return _rate(F.levenshtein(r, h), F.length(r), F.length(h) == 0, cap)


#: Distinct words of a pair that can be written as one character each.
ALPHABET = 20_000


def word_distance(a, b) -> int:
    """Edit distance of two sequences of words, one row of the table at a time."""
    ids: dict[str, int] = {}
    x, y = (np.array([ids.setdefault(w, len(ids)) for w in words], dtype=np.int64) for words in (a, b))
    at = np.arange(len(y) + 1)
    row = at.copy()
    for k, w in enumerate(x, 1):
        new = np.concatenate(([k], np.minimum(row[1:] + 1, row[:-1] + (y != w))))
        row = np.minimum.accumulate(new - at) + at  # insertions
    return int(row[-1])


def _word_distances(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else word_distance(x, y) for x, y in zip(a, b, strict=True)], dtype="Int64")


def wer(reference, text, cap: bool = False) -> Column:
    """Word error rate: each distinct word of the pair becomes one character, and the built-in distance does the rest.

    Characters run from U+4E00 on; a pair with more than 20,000 distinct words has no such alphabet, and its distance is
    computed over the words themselves.
    """
    own_r, own_h = tokens(col(reference)), tokens(col(text))
    pair = F.struct(own_r.alias("r"), own_h.alias("h"))
    large = F.size(F.array_distinct(F.concat(own_r, own_h))) > ALPHABET
    by_words = F.pandas_udf(_word_distances, T.LongType())(F.when(large, own_r), F.when(large, own_h))

    def rate(p: Column) -> Column:
        def coded(words: Column, vocabulary: Column) -> Column:
            return F.array_join(F.transform(words, lambda w: F.decode(F.unhex(F.lpad(F.hex(F.array_position(vocabulary, w) + 19967), 4, "0")), "UTF-16BE")), "")

        def by(vocabulary: Column) -> Column:
            distance = F.levenshtein(coded(p["r"], vocabulary), coded(p["h"], vocabulary))
            return F.when(F.size(vocabulary) <= ALPHABET, _rate(distance, F.size(p["r"]), F.size(p["h"]) == 0, cap))

        return let(F.array_distinct(F.concat(p["r"], p["h"])), by)

    return F.when(large, _rate(by_words, F.size(own_r), F.size(own_h) == 0, cap)).otherwise(let(pair, rate))


def norm_lev(a, b) -> Column:
    """Edit distance over the longer length; 0 for two empty texts."""
    x, y = col(a), col(b)
    longest = F.greatest(F.length(x), F.length(y))
    return F.when(longest == 0, 0.0).otherwise(F.levenshtein(x, y) / longest)


# Repair and mark-up


def clean_hyphens(x) -> Column:
    return F.regexp_replace(col(x), r"(?<=[A-Za-z])-[ \t]+(?=[A-Za-z])", "-")


def heading_markup(line) -> Column:
    """A line as a heading where it looks like one, else null: numbered sections by depth, banners in capitals."""
    x = col(line)
    number = F.regexp_extract(x, r"^(\d+(?:\.\d+)*)\.?\s+[A-Z]", 1)
    depth = F.size(F.split(number, r"\."))
    letters = F.regexp_replace(x, r"\P{L}", "")
    banner = (F.length(letters) >= 2) & ~F.regexp_like(letters, F.lit(r"\P{Lu}"))
    skip = F.regexp_like(x, F.lit(r"\.{4,}")) | (F.length(x) > 80) | F.regexp_like(x, F.lit(r"[.,;]$"))
    marked = F.when(number != "", F.concat(F.repeat(F.lit("#"), F.least(depth + 1, F.lit(6))), F.lit(" "), x)).when(banner, F.concat(F.lit("# "), x))
    return F.when(~skip, marked)


def first_line_heading(line) -> Column:
    """The plainer rule for the first line of a page: short, with a letter, no final dot or comma."""
    x = col(line)
    return F.when((F.length(x) < 80) & F.regexp_like(x, F.lit(r"\p{L}")) & ~F.regexp_like(x, F.lit("[.,]$")), F.concat(F.lit("## "), x)).otherwise(x)


def numeric_line(line: Column) -> Column:
    return F.regexp_like(line, F.lit(r"^-?\d+(\.\d+)?$"))


def axis_text(text: Column) -> Column:
    return F.contains(text, F.lit("[")) | F.contains(text, F.lit("]")) | F.contains(text, F.lit("/")) | F.contains(text, F.lit("MeV"))


def is_figure(page) -> Column:
    """A page of few short lines with numbers or axis signs and no sentences."""
    own = F.filter(F.transform(lines(col(page)), trim_all), lambda x: x != "")
    joined = F.array_join(own, " ")
    few = (F.size(own) > 0) & (F.size(own) <= 14) & (F.size(tokens(joined)) <= 24)
    sentences = F.exists(own, lambda x: F.regexp_like(x, F.lit("[.:]$")))
    return few & ~sentences & ((F.size(F.filter(own, numeric_line)) >= 3) | axis_text(joined))


def has_rtl(x) -> Column:
    return F.regexp_like(col(x), F.lit("[֐-׿؀-ۿݐ-ݿࢠ-ࣿ]"))


def table_signature(x) -> Column:
    """Lines without cell padding, lower-cased, blanks dropped: equal for tables that differ in spacing."""
    own = F.transform(lines(col(x)), lambda t: F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(trim_all(t), r" \| ", "|"), r"\| ", "|"), r" \|", "|")))
    return F.array_join(F.filter(own, lambda t: t != ""), "\n")


def yaml_str(x) -> Column:
    escaped = col(x)
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
        escaped = F.replace(escaped, F.lit(a), F.lit(b))
    return F.concat(F.lit('"'), escaped, F.lit('"'))


def md_escape(x) -> Column:
    return F.regexp_replace(col(x), r"([\\`*_\[\]])", r"\\$1")


def md_escape_block(x) -> Column:
    """A leading mark that would make a paragraph a heading, quote or list item is escaped."""
    marked = F.regexp_replace(col(x), r"^(#{1,6}|>|[-+])(?=\s|$)", r"\\$1")
    return F.regexp_replace(marked, r"^(\d+)([.)])(?=\s|$)", r"$1\\$2")


def decode_non_ascii(url) -> Column:
    """Percent runs that hold a byte of 0x80 or more and are valid UTF-8 are decoded; others stay as they are."""
    x = col(url)
    runs = F.regexp_extract_all(x, F.lit(r"(?:%[0-9A-Fa-f]{2})+"), F.lit(0))
    between = F.split(x, r"(?:%[0-9A-Fa-f]{2})+", -1)

    def one(run: Column) -> Column:
        raw = F.unhex(F.replace(run, F.lit("%"), F.lit("")))
        wide = F.regexp_like(run, F.lit("%[89A-Fa-f]"))
        return F.when(wide & F.is_valid_utf8(raw.cast("string")), raw.cast("string")).otherwise(run)

    pairs = F.zip_with(between, F.transform(runs, one), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    return F.array_join(pairs, "")


def organisations(x, most: int = 10) -> Column:
    """Distinct names by the two patterns, in that order, the first ten."""
    found = [F.transform(F.regexp_extract_all(F.substring(col(x), 1, 8000), F.lit(p), F.lit(0)), trim_all) for p in ORGANISATIONS]
    return F.slice(F.array_distinct(F.filter(F.concat(*found), lambda t: F.length(t) > 2)), 1, most)


# Formats


def fmt_timestamp(seconds: Column) -> Column:
    """m:ss"""
    s = F.floor(seconds).cast("long")
    return F.format_string("%d:%02d", F.floor(s / 60), s % 60)


def fmt_clock(seconds: Column) -> Column:
    """h:mm:ss from an hour on, else m:ss; rounded, never negative."""
    s = F.greatest(F.lit(0), F.round(seconds)).cast("long")
    long = F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)
    return F.when(s >= 3600, long).otherwise(F.format_string("%d:%02d", F.floor(s / 60), s % 60))


def fmt_duration(seconds: Column) -> Column:
    """Ns, Mm, or Mm Ss"""
    s = F.floor(seconds).cast("long")
    rest = F.when(s % 60 > 0, F.format_string("%dm %ds", F.floor(s / 60), s % 60)).otherwise(F.format_string("%dm", F.floor(s / 60)))
    return F.when(seconds < 60, F.format_string("%ds", s)).otherwise(rest)


def fmt_iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def metadata_markdown(groups: Column) -> Column:
    """`GROUP.key` entries of a map of maps, the known ones in fixed order, one `**key:** value` line each."""

    def line(key: str) -> Column:
        group, name = key.split(".")
        value = F.element_at(F.element_at(groups, group), name)
        return F.when(F.length(value) > 0, F.concat(F.lit(f"**{key}:** "), value))

    return F.array_join(F.array_compact(F.array(*map(line, METADATA_KEYS))), "\n")


def transcript_markdown(language: Column, seconds: Column, confidence: Column, body: Column) -> Column:
    percent = F.floor(confidence * 100).cast("long")
    head = (F.lit("## Transcript"), F.lit(""), F.concat(F.lit("> Language: "), language, F.lit("  ")), F.concat(F.lit("> Duration: "), fmt_duration(seconds), F.lit("  ")))
    return F.concat_ws("\n", *head, F.concat(F.lit("> Confidence: "), percent, F.lit("%")), F.lit(""), body)


def to_payload(row: Column) -> Column:
    return F.to_json(row)


def from_payload(text: Column, schema: str) -> Column:
    return F.from_json(text, schema)
