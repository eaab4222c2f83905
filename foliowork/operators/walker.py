"""HTML pages as Markdown, by nesting depths over the tags that begin and end blocks.

A page is split before every tag that begins or ends a block; a row is such a tag and what follows it up to the next. Running
sums over a page's rows give how deep each lies in lists, tables, definition lists and quotes, and the last start at the
same depth is the item, cell or term that a row belongs to, so nested lists number their own items and a table inside a
cell stays in that cell. Rows of one part are put together, parts to rows of a table, these to blocks, blocks to pages: four
aggregates over one shuffle by page. Each step is linear in a page's length, and nothing grows by being appended to.

Unfinished mark-up: the start of a block ends what was open before it; marks inside a line end with their part; an end
without a start counts for nothing.
"""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliowork.functions.text import col, decode_non_ascii, let, md_escape, md_escape_block
from foliowork.operators.html import CONTAINERS, attribute, tag_name, visible

HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
LISTS, ITEMS, ROWS = ("ul", "ol"), ("dt", "dd"), ("thead", "tbody", "tfoot")
#: Tags that begin and end blocks, and those of them in which a part of their own kind of content is laid out.
BLOCKS = (*CONTAINERS, *HEADINGS, *LISTS, *ITEMS, *ROWS, "p", "li", "dl", "blockquote", "pre", "table", "caption", "tr", "td", "th", "hr")
LAID_OUT = (*LISTS, "table", "dl", "pre")
_SPLIT = rf"(?i)(?=</?(?:{'|'.join(sorted(BLOCKS, key=len, reverse=True))})(?![A-Za-z0-9-]))"
_INLINE = r"(?is)<code(?![a-z0-9-])[^>]*>.*?(?:</code\s*>|\z)|</?[a-z][^>]*>|<![^>]*>|&(?:#[0-9]{1,7}|#x[0-9a-f]{1,6}|[a-z][a-z0-9]{1,31});|[^<&]+|[<&]"

# Marks that carry structure through the folding of white space: emphasis, link target, link text, end of link, hard break, boxes.
EMPHASIS = (("strong", ("b",), "\x02", "\x03", "**"), ("em", ("i",), "\x04", "\x05", "*"), ("del", ("s", "strike"), "\x06", "\x07", "~~"))
LINK, LINK_TEXT, LINK_END, BREAK, DONE, OPEN = "\x14", "\x13", "\x12", "\x01", "\x0e", "\x0f"
#: Not allowed in a page, and dropped from it.
MARKS = "".join((LINK, LINK_TEXT, LINK_END, BREAK, DONE, OPEN, *(x for e in EMPHASIS for x in e[2:4])))


def entity(token: Column) -> Column:
    """The character that an entity such as &amp; or &#38; stands for; unknown ones stay as they are."""
    names = F.create_map(*(F.lit(x) for name, code in name2codepoint.items() for x in (f"&{name};", chr(code))))
    number = F.when(F.regexp_like(token, F.lit("^&#[xX]")), F.conv(F.regexp_extract(token, "^&#[xX]([0-9A-Fa-f]+)", 1), 16, 10)).otherwise(F.regexp_extract(token, "^&#([0-9]+)", 1)).cast("int")
    known = ((number > 0) & (number < 0xD800)) | ((number > 0xDFFF) & (number <= 0x10FFFF))
    char = F.when(known, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")).otherwise(F.lit("�"))
    return F.when(token.startswith("&#"), char).otherwise(F.coalesce(names[token], token))


def decoded(text: Column) -> Column:
    """A text with its entities as characters."""
    parts = F.regexp_extract_all(text, F.lit(r"&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});|[^&]+|&"), F.lit(0))
    whole = F.array_join(F.transform(parts, lambda t: F.when(t.startswith("&") & t.endswith(";"), entity(t)).otherwise(t)), "")
    return F.when(F.contains(text, F.lit("&")), whole).otherwise(text)


def _bare(markup: Column) -> Column:
    """The text of some mark-up, without its tags."""
    return decoded(F.regexp_replace(markup, r"(?is)</?[a-z][^>]*>|<![^>]*>", ""))


def _tag(token: Column, name: Column) -> Column:
    """A tag inside a line, with marks for what is settled when the whole line is known."""
    closing, shown = token.startswith("</"), F.lit("")
    for first, others, start, stop, _ in EMPHASIS:
        shown = F.when(name.isin(first, *others), F.when(closing, stop).otherwise(start)).otherwise(shown)
    box = F.when(F.regexp_like(token, F.lit(r"(?i)\schecked(?![a-z-])")), DONE).otherwise(OPEN)
    link = let(attribute(token, "href"), lambda x: F.when(x != "", F.concat(F.lit(LINK), decode_non_ascii(x), F.lit(LINK_TEXT))).otherwise(""))
    image = let(attribute(token, "src"), lambda x: F.when(x != "", F.concat(F.lit("!["), attribute(token, "alt"), F.lit("]("), decode_non_ascii(x), F.lit(")"))).otherwise(""))
    return (
        F.when((name == "a") & closing, F.lit(LINK_END))
        .when(name == "a", link)
        .when(name == "br", F.lit(BREAK))
        .when(name == "code", F.concat(F.lit("`"), _bare(token), F.lit("`")))
        .when(name == "img", image)
        .when((name == "input") & (F.lower(attribute(token, "type")) == "checkbox"), box)
        .otherwise(shown)
    )


def _piece(token: Column) -> Column:
    """One piece of text or one tag inside a line."""
    is_tag, is_entity = token.startswith("<") & (F.length(token) > 1), token.startswith("&") & (F.length(token) > 1)
    return F.when(is_tag, let(tag_name(token), lambda name: _tag(token, name))).when(is_entity, md_escape(entity(token))).otherwise(md_escape(token))


def _inline(body: Column) -> Column:
    whole = F.array_join(F.transform(F.regexp_extract_all(body, F.lit(_INLINE), F.lit(0)), _piece), "")
    return F.when(F.regexp_like(body, F.lit("[<&]")), whole).otherwise(md_escape(body))


def _emphasised(text: Column) -> Column:
    """Marks of emphasis: what is open at the end is closed, spaces move outside, empty ones go."""

    def settled(start: str, stop: str, mark: str):
        def of(x: Column) -> Column:
            count = lambda c: F.length(x) - F.length(F.replace(x, F.lit(c), F.lit("")))
            done, shown = F.concat(x, F.repeat(F.lit(stop), F.greatest(count(start) - count(stop), F.lit(0)))), mark.replace("*", "\\*")
            for _ in range(2):  # an inner mark first, then the one around it
                done = F.regexp_replace(done, f"{start}([ \\t\\n\\r]*+){stop}", "$1")
                done = F.regexp_replace(done, f"{start}([ \\t]*+)([^{start}{stop}]*?)([ \\t]*+){stop}", f"$1{shown}$2{shown}$3")
            return F.when(F.contains(x, F.lit(start)), F.regexp_replace(done, f"[{start}{stop}]", "")).otherwise(F.replace(x, F.lit(stop), F.lit("")))

        return of

    x = text
    for _, _, start, stop, mark in EMPHASIS:
        x = let(x, settled(start, stop, mark))
    return F.when(F.regexp_like(text, F.lit(f"[{''.join(e[2] + e[3] for e in EMPHASIS)}]")), x).otherwise(text)


def _linked(x: Column) -> Column:
    """Links with a text as Markdown; those without one go, as do targets whose end is missing."""
    done = F.regexp_replace(F.concat(x, F.lit(LINK_END)), f"{LINK}[^{LINK_TEXT}]*{LINK_TEXT}[ \\t\\n\\r]*{LINK_END}", "")
    done = F.regexp_replace(done, f"{LINK}([^{LINK_TEXT}]*){LINK_TEXT}([^{LINK}{LINK_END}]*){LINK_END}?", r"[$2]($1)")
    return F.when(F.contains(x, F.lit(LINK)), done).otherwise(x)


def _spaced(x: Column) -> Column:
    """White space folded, hard breaks put in, ends trimmed."""
    x = F.regexp_replace(F.regexp_replace(x, "[ \\t\\n\\r\\f]+", " "), f" ?{BREAK} ?", "  \n")
    return F.regexp_replace(x, r"^[\p{Zs}\t]+|[\p{Zs}\t]+$", "")


def _line(pieces: Column) -> Column:
    marked = let(let(pieces, _linked), _emphasised)
    return _spaced(F.regexp_replace(marked, f"[{LINK_END}{DONE}{OPEN}]", ""))


def pages_to_markdown(pages: DataFrame, id_column: str = "page_id", html: str = "html", keep: tuple[str, ...] = ()) -> DataFrame:
    """The id, `markdown` and the columns in `keep` of every page: blocks with a blank line between, ending in a line break.

    Null and empty pages, and pages without visible text, give a lone line break. Every row is a page of its own, whatever
    its id; `pages` must give the same rows in the same order when it is read again, as tables do.
    """
    carried = F.struct(F.col(id_column).alias("id"), *(F.col(f"`{c}`").alias(f"k{n}") for n, c in enumerate(keep)))
    numbered = pages.select(F.monotonically_increasing_id().alias("page"), carried.alias("carried"), visible(F.translate(col(html), MARKS, "")).alias("html"))
    split = numbered.select("page", "carried", F.posexplode(F.split("html", _SPLIT, -1)).alias("pos", "x"))
    token = F.regexp_extract("x", r"(?s)^<[^>]*>?", 0)
    head = F.when(F.regexp_like("x", F.lit(_SPLIT.replace("(?=", "^(?=", 1))), token).otherwise("")
    rows = split.select("page", "pos", F.when(F.col("pos") == 0, F.col("carried")).alias("carried"), head.alias("head"), F.col("x")).select(
        "page", "pos", "carried", tag_name(F.col("head")).alias("tag"), F.col("head").startswith("</").alias("close"),
        F.when(F.regexp_like("head", F.lit("(?i)^<ol")), attribute(F.col("head"), "start")).alias("start"), F.expr("substring(x, length(head) + 1)").alias("body"),
    )

    order = Window.partitionBy("page").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opens, tag, pos = ~F.col("close"), F.col("tag"), F.col("pos")
    kinds = {"laid": LAID_OUT, "lists": LISTS, "tables": ("table",), "quotes": ("blockquote",)}
    for name, own in kinds.items():
        rows = rows.withColumn(f"{name}_sum", F.sum(F.when(tag.isin(*own) & opens, 1).when(tag.isin(*own), -1).otherwise(0)).over(order))
    for name in kinds:  # an end without a start counts for nothing
        rows = rows.withColumn(name, F.col(f"{name}_sum") - F.least(F.min(f"{name}_sum").over(order), F.lit(0)))

    def last(test: Column, value: Column) -> Column:
        """The value of the last row so far that passes a test."""
        return F.last(F.when(test, value), ignorenulls=True).over(order)

    outermost = tag.isin(*LAID_OUT) & opens & (F.col("laid") == 1)
    cell = (F.col("tables") == 1) & tag.isin("td", "th", "tr", "caption")
    term = tag.isin(*ITEMS) & (F.col("laid") == 1)
    rows = rows.withColumns(
        {
            "top": F.when(F.col("laid") > 0, last(outermost, F.struct(pos.alias("at"), tag.alias("tag")))),
            "cell": last(cell, F.struct(pos.alias("at"), tag.alias("tag"), F.col("close").alias("over"))),
            "row": last((F.col("tables") == 1) & (tag == "tr") & opens, pos),
            "term": last(term, F.struct(pos.alias("at"), tag.alias("tag"), F.col("close").alias("over"))),
            "quotes": F.when(F.col("laid") == 0, F.col("quotes")).otherwise(last(F.col("laid") == 0, F.col("quotes"))),
        }
    )
    # Items: at one depth of lists, the last start of a list and the last start or end of an item.
    level = Window.partitionBy("page", "lists").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    item = F.when((tag == "li") & opens, 1).otherwise(0)
    begins = tag.isin(*LISTS) & opens
    rows = rows.withColumn("items", F.sum(item).over(level))
    first = F.when(F.regexp_like("start", F.lit(r"^-?\d{1,9}$")), F.col("start").cast("int")).otherwise(1)
    of_list = F.struct(pos.alias("at"), (tag == "ol").alias("ordered"), first.alias("first"), F.col("items").alias("before"))
    rows = rows.withColumns(
        {
            "own_list": F.last(F.when(begins, of_list), ignorenulls=True).over(level),
            "li": F.last(F.when((tag == "li") | begins, F.struct(pos.alias("at"), tag.alias("tag"), F.col("close").alias("over"))), ignorenulls=True).over(level),
        }
    )
    kind = F.coalesce(F.col("top.tag"), F.when(tag.isin("p", *HEADINGS, "hr") & opens, tag).otherwise("run"))
    kind = F.when(kind.isin(*LISTS), "list").otherwise(kind)
    there = lambda state, *tags: F.when(F.col(f"{state}.tag").isin(*tags) & ~F.col(f"{state}.over"), F.col(f"{state}.at"))
    part = F.when(kind == "list", there("li", "li")).when(kind == "table", there("cell", "td", "th", "caption")).when(kind == "dl", there("term", *ITEMS)).when(kind == "pre", F.col("top.at")).otherwise(pos)
    sort = F.when(kind == "table", F.col("cell.tag")).when(kind == "dl", F.col("term.tag")).otherwise(kind)
    placed = rows.select(
        "page", "pos", "carried", F.coalesce("top.at", "pos").alias("block"), kind.alias("kind"), part.alias("part"),
        F.coalesce(F.when((kind == "table") & (sort != "caption"), F.col("row")), part).alias("row"), sort.alias("sort"), "quotes", "lists",
        F.when(F.col("own_list.ordered"), F.col("own_list.first") + F.col("items") - F.col("own_list.before") - 1).alias("number"),
        F.when(part.isNotNull() & (kind != "hr"), F.when(kind == "pre", _bare(F.col("body"))).otherwise(_inline(F.col("body")))).alias("piece"),
    )

    def joined(name: str, by: str) -> Column:
        return F.transform(F.array_sort(F.collect_list(F.struct(by, name))), lambda x: x[name])

    first_of = lambda name: F.min_by(name, "pos").alias(name)
    parts = placed.groupBy("page", "block", "row", "part").agg(
        F.array_join(joined("piece", "pos"), "").alias("pieces"), F.first("carried", ignorenulls=True).alias("carried"), F.min("quotes").alias("quotes"), *(first_of(x) for x in ("kind", "sort", "lists", "number"))
    )
    kind, sort, pieces, text = F.col("kind"), F.col("sort"), F.col("pieces"), _line(F.col("pieces"))
    marker = F.concat(F.repeat(F.lit("  "), F.col("lists") - 1), F.coalesce(F.concat(F.col("number").cast("string"), F.lit(". ")), F.lit("- ")))
    box = F.when(F.contains(pieces, F.lit(DONE)), "[x] ").when(F.contains(pieces, F.lit(OPEN)), "[ ] ").otherwise("")
    lines = F.filter(F.transform(F.split(pieces, BREAK, -1), _line), lambda t: t != "")
    shown = (
        F.when(F.col("part").isNull(), F.lit(None))
        .when(kind == "list", F.concat(marker, box, text))
        .when(sort == "caption", F.when(text != "", F.concat(F.lit("**"), text, F.lit("**"))))
        .when(kind == "table", F.replace(text, F.lit("|"), F.lit("\\|")))
        .when(sort == "dt", F.concat(F.lit("**"), text, F.lit("**")))
        .when(kind == "pre", F.concat(F.lit("```\n"), F.regexp_replace("pieces", r"^[\r\n]+|[\r\n]+$", ""), F.lit("\n```")))
        .when(kind == "hr", F.lit("---"))
        .when(kind.isin(*HEADINGS), F.concat(F.repeat(F.lit("#"), F.try_to_number(F.substring("kind", 2, 1), F.lit("9")).cast("int")), F.lit(" "), text))
        .when(kind == "p", md_escape_block(text))
        .when((kind == "run") & F.contains(pieces, F.lit(BREAK)) & ~F.regexp_like(pieces, F.lit(f"[{LINK}{''.join(x[2] for x in EMPHASIS)}]")), F.array_join(lines, "\n\n"))
        .otherwise(text)
    )
    shown_parts = parts.select("page", "block", "row", "part", "kind", "sort", "quotes", "carried", shown.alias("text"))
    table_rows = shown_parts.groupBy("page", "block", "row").agg(
        joined("text", "part").alias("cells"), F.first("kind").alias("kind"), F.min("sort").alias("sort"), F.min("quotes").alias("quotes"), F.first("carried", ignorenulls=True).alias("carried"), F.max("part").alias("part")
    )
    cells = F.filter("cells", lambda c: c.isNotNull())
    of_block = F.array_sort(F.collect_list(F.when(F.col("part").isNotNull(), F.struct("row", "sort", cells.alias("cells")))))
    blocks = table_rows.groupBy("page", "block").agg(of_block.alias("rows"), F.first("kind").alias("kind"), F.min("quotes").alias("quotes"), F.first("carried", ignorenulls=True).alias("carried"))

    def drawn(own: Column) -> Column:
        captions = F.flatten(F.transform(F.filter(own, lambda r: r["sort"] == "caption"), lambda r: r["cells"]))
        body = F.transform(F.filter(own, lambda r: (r["sort"] != "caption") & (F.size(r["cells"]) > 0)), lambda r: r["cells"])

        def table(grid: Column) -> Column:
            width = F.array_max(F.transform(grid, lambda r: F.size(r)))
            line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))

            def of_width(w: Column) -> Column:
                full = F.transform(grid, lambda r: line(F.concat(r, F.array_repeat(F.lit(""), F.greatest(w - F.size(r), F.lit(0))))))
                return let(full, lambda own: F.concat_ws("\n", F.get(own, 0), line(F.array_repeat(F.lit("---"), w)), F.array_join(F.slice(own, F.lit(2), F.greatest(F.size(own) - 1, F.lit(0))), "\n")))

            return F.regexp_replace(let(width, of_width), r"\n$", "")

        return let(body, lambda grid: F.when(F.size(grid) > 0, F.concat_ws("\n\n", F.get(captions, 0), table(grid))).otherwise(""))

    plain = F.array_join(F.flatten(F.transform("rows", lambda r: r["cells"])), "\n")
    texts = blocks.select("page", "block", "quotes", "carried", F.when(F.col("kind") == "table", drawn(F.col("rows"))).otherwise(plain).alias("text"))

    # Between two blocks, as many quotes go on as were open all the time.
    before = Window.partitionBy("page").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    above = F.lag("quotes").over(Window.partitionBy("page").orderBy("block"))
    numbered = texts.withColumns({"group": F.coalesce(F.sum(F.when(F.col("text") != "", 1).otherwise(0)).over(before), F.lit(0)), "both": F.least("quotes", above)})
    grouped = numbered.groupBy("page", "group").agg(
        F.max(F.when(F.col("text") != "", F.struct("text", "quotes"))).alias("own"), F.min("both").alias("common"), F.first("carried", ignorenulls=True).alias("carried")
    )
    quoted = let(F.repeat(F.lit("> "), F.col("own.quotes")), lambda mark: F.regexp_replace(F.concat(mark, F.replace("own.text", F.lit("\n"), F.concat(F.lit("\n"), mark))), "(?m)^((?:> )*>) $", "$1"))
    lined = F.when(F.col("own.quotes") > 0, quoted).otherwise(F.col("own.text"))
    between = F.when(F.col("group") == 0, "").otherwise(F.concat(F.lit("\n"), F.rtrim(F.repeat(F.lit("> "), F.col("common"))), F.lit("\n")))
    whole = grouped.groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("own").isNotNull(), F.struct("group", F.concat(between, lined).alias("text"))))), lambda x: x["text"]), "").alias("text"), F.first("carried", ignorenulls=True).alias("carried"))
    markdown = F.concat(F.regexp_replace(F.regexp_replace("text", "\n{3,}", "\n\n"), r"^\s+|\s+$", ""), F.lit("\n"))
    return whole.select(F.col("carried.id").alias(id_column), markdown.alias("markdown"), *(F.col(f"carried.k{n}").alias(c) for n, c in enumerate(keep)))

