"""Pages as Markdown, against pinned cases and a plain walk over a parsed tree."""

import random
import re
import time
from html.parser import HTMLParser

from foliowork.operators.walker import pages_to_markdown

#: Page to its Markdown, without the last line break.
CASES = {
    '<h1>Title</h1><h2>Sub</h2>': '# Title\n\n## Sub',
    '<p>Hello   \n   world</p><p>Second</p>': 'Hello world\n\nSecond',
    '<p>a <strong>bold</strong> and <em>italic</em></p>': 'a **bold** and *italic*',
    '<p>use <code>print()</code></p>': 'use `print()`',
    '<p><del>gone</del></p>': '~~gone~~',
    '<p><a href="https://x.com">site</a></p>': '[site](https://x.com)',
    '<p><img src="a.png" alt="cat"></p>': '![cat](a.png)',
    '<p><a>no href</a></p>': 'no href',
    '<ul><li>one</li><li>two</li></ul>': '- one\n- two',
    '<ol><li>first</li><li>second</li></ol>': '1. first\n2. second',
    '<ul><li>a<ul><li>a1</li></ul></li><li>b</li></ul>': '- a\n  - a1\n- b',
    '<blockquote><p>quoted</p></blockquote>': '> quoted',
    '<pre>let x = 1\nlet y = 2</pre>': '```\nlet x = 1\nlet y = 2\n```',
    '<p>a</p><hr><p>b</p>': 'a\n\n---\n\nb',
    '<p>line one<br>line two</p>': 'line one  \nline two',
    '<table><thead><tr><th>H1</th><th>H2</th></tr></thead><tbody><tr><td>a</td><td>b</td></tr></tbody></table>': '| H1 | H2 |\n| --- | --- |\n| a | b |',
    '<style>p{color:red}</style><p>visible</p><script>alert(1)</script>': 'visible',
    '<p>a &amp; b &lt; c &gt; d &mdash; e</p>': 'a & b < c > d — e',
    '<p>👩\u200d👩\u200d👧 𠀀 &#x1F600;&#233;</p>': '👩\u200d👩\u200d👧 𠀀 😀é',
    '<p><a href="https://x.com/café?q=日本">链接</a></p>': '[链接](https://x.com/café?q=日本)',
    '<p>café &copy; 2026 &mdash; 50&deg;</p>': 'café © 2026 — 50°',
    '<html><head><title>T</title></head><body><h1>Doc</h1><p>Body</p></body></html>': '# Doc\n\nBody',
    '': '',
    '<html><body></body></html>': '',
    '<p>literal *stars* and _unders_ here</p>': 'literal \\*stars\\* and \\_unders\\_ here',
    '<p>call <code>a*b_c</code> now</p>': 'call `a*b_c` now',
    '<p># not a heading</p>': '\\# not a heading',
    '<p>1. not a list</p>': '1\\. not a list',
    '<p>&gt; not a quote</p>': '\\> not a quote',
    '<p>id - name</p>': 'id - name',
    '<dl><dt>Term</dt><dd>Definition</dd><dt>T2</dt><dd>D2</dd></dl>': '**Term**\nDefinition\n**T2**\nD2',
    '<ol start="5"><li>five</li><li>six</li></ol>': '5. five\n6. six',
    '<ul><li><input type="checkbox" checked>done</li><li><input type="checkbox">todo</li></ul>': '- [x] done\n- [ ] todo',
    '<table><caption>Sales</caption><tr><th>Q</th></tr><tr><td>1</td></tr></table>': '**Sales**\n\n| Q |\n| --- |\n| 1 |',
    '<p><a href="u"></a>after</p>': 'after',
    '<p><a href="u"><img src="i.png" alt="x"></a></p>': '[![x](i.png)](u)',
    '<figure><img src="i.png" alt="x"><figcaption>cap</figcaption></figure>': '![x](i.png)\n\ncap',
    '<main><aside><p>note</p></aside></main>': 'note',
    '<p>before <mark>hi</mark> and <time>2026</time> after</p>': 'before hi and 2026 after',
    '<p data-section="x">a &lt;section&gt; tag</p>': 'a <section> tag',
    '<blockquote><p>q1</p><blockquote><p>q2</p></blockquote><p>q3</p></blockquote><blockquote>z</blockquote>': '> q1\n>\n> > q2\n>\n> q3\n\n> z',
    '<table><tr><td>a<table><tr><td>in</td><td>ner</td></tr></table></td><td>b</td></tr><tr><td>c</td></tr></table>': '| ainner | b |\n| --- | --- |\n| c |  |',
    '<ul><li>a<ol start=3><li>x</li><li>y<ul><li>z</li></ul>t</li></ol>more</li><li>b</li></ul>': '- amore\n  3. x\n  4. yt\n    - z\n- b',
    '<h1>Hi <b>there </b>x</h1><p>a <i>b</i> &amp; c_d<br>e</p>': '# Hi **there** x\n\na *b* & c\\_d  \ne',
    "<script>'</p>'</script><nav><p>open <b>mark<p>next": 'open **mark**\n\nnext',
    '<div>a<br>b</div>': 'a\n\nb',
    '<p>Hello   \n   world</p>': 'Hello world',
}


VOID = ("br", "hr", "img", "input")
FLOW = ("div", "section", "article", "nav", "body", "html")


class Tree(HTMLParser):
    """A tree of [tag, attributes, children] for well-formed pages; texts are strings."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = ["body", {}, []]
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        node = [tag, dict(attrs), []]
        self.open[-1][2].append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_endtag(self, tag):
        self.open.pop()

    def handle_data(self, data):
        self.open[-1][2].append(data)


def escaped(t):
    return re.sub(r"([\\`*_\[\]])", r"\\\1", t)


def folded(t):
    return re.sub(" ?\x01 ?", "  \n", re.sub("[ \t\n\r\f]+", " ", t)).strip(" \t\xa0")


def plain(node):
    return node if isinstance(node, str) else "".join(map(plain, node[2]))


def inline(node):
    if isinstance(node, str):
        return escaped(node)
    tag, attrs, children = node
    inner = "".join(map(inline, children))
    marks = {"b": "**", "strong": "**", "i": "*", "em": "*", "del": "~~"}
    if tag in marks:
        if not inner.strip(" "):
            return inner
        left, right = " " * inner.startswith(" "), " " * inner.endswith(" ")
        return left + marks[tag] + inner.strip(" ") + marks[tag] + right
    if tag == "code":
        return f"`{plain(node)}`"
    if tag == "br":
        return "\x01"
    if tag == "a" and attrs.get("href"):
        return f"[{inner}]({attrs['href']})" if inner.strip(" ") else ""
    if tag == "img":
        return f"![{attrs.get('alt', '')}]({attrs['src']})"
    return inner


def listed(node, depth):
    number, out = int(node[1].get("start", 1)), []
    for li in node[2]:
        own, nested = "", []
        for x in li[2]:
            if not isinstance(x, str) and x[0] in ("ul", "ol"):
                nested.append(listed(x, depth + 1))
            else:
                own += inline(x)
        out += ["  " * depth + (f"{number}. " if node[0] == "ol" else "- ") + folded(own), *nested]
        number += 1
    return "\n".join(out)


def blocks(node):
    out, run = [], ""

    def flush():
        nonlocal run
        if folded(run):
            out.append(folded(run))
        run = ""

    for x in node[2]:
        if isinstance(x, str) or x[0] not in (*FLOW, "p", "h1", "h2", "ul", "ol", "dl", "blockquote", "pre", "table", "hr"):
            run += inline(x)
            continue
        flush()
        tag = x[0]
        if tag in ("h1", "h2"):
            out.append("#" * int(tag[1]) + " " + folded("".join(map(inline, x[2]))))
        elif tag == "p":
            t = folded("".join(map(inline, x[2])))
            out.append(re.sub(r"^(\d+)([.)])(?=\s|$)", r"\1\\\2", re.sub(r"^(#{1,6}|>|[-+])(?=\s|$)", r"\\\1", t)))
        elif tag in ("ul", "ol"):
            out.append(listed(x, 0))
        elif tag == "dl":
            out.append("\n".join(f"**{folded(''.join(map(inline, y[2])))}**" if y[0] == "dt" else folded("".join(map(inline, y[2]))) for y in x[2]))
        elif tag == "blockquote":
            inner = "\n\n".join(b for b in blocks(x) if b)
            out.append("\n".join("> " + line if line else ">" for line in inner.split("\n")))
        elif tag == "pre":
            out.append("```\n" + plain(x).strip("\n") + "\n```")
        elif tag == "hr":
            out.append("---")
        elif tag == "table":
            rows = [[folded("".join(map(inline, c[2]))).replace("|", "\\|") for c in tr[2]] for tr in x[2] if tr[0] == "tr"]
            width = max(map(len, rows))
            drawn = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
            caption = [f"**{folded(''.join(map(inline, c[2])))}**\n" for c in x[2] if c[0] == "caption"]
            out.append("\n".join([*caption, drawn[0], "| " + " | ".join(["---"] * width) + " |", *drawn[1:]]))
        else:
            out.append("\n\n".join(b for b in blocks(x) if b))
    flush()
    return [b for b in out if b]


def page(draw):
    """A well-formed page with nested lists, quotes, tables and marks."""
    words = lambda: " ".join(draw.choices(["one", "two_x", "a*b", "3.", "#", "&amp;", "&eacute;", "&#8212;", "|", "日本", "-"], k=draw.randint(1, 5)))

    def line(depth=0):
        out = ""
        for _ in range(draw.randint(1, 3)):
            kind = draw.random()
            if kind < 0.5 or depth > 1:
                out += words() + draw.choice(["", " ", "\n  "])
            elif kind < 0.7:
                tag = draw.choice(["b", "em", "del"] if depth == 0 else ["span"])
                out += f" <{tag}>{draw.choice(['', ' '])}{line(depth + 1)}</{tag}> "
            elif kind < 0.8:
                out += f"<a href='u?x=1'>{words()}</a>"
            elif kind < 0.9:
                out += f"<code>x &lt; {draw.choice(['*y*', '_z'])}</code> <img src=i.png alt='p q'>"
            else:
                out += " <span>" + words() + "</span> "
        return out

    def nested(depth):
        tag = draw.choice(["<ul>", "<ol>", "<ol start='4'>"])
        items = "".join(f"<li>{line()}{nested(depth + 1) if depth < 3 and draw.random() < 0.4 else ''}{draw.choice(['', ' tail'])}</li>" for _ in range(draw.randint(1, 3)))
        return f"{tag}{items}</{tag[1:3]}>"

    def table(depth=0):
        cell = lambda: f"<td>{line()}{table(1) if depth == 0 and draw.random() < 0.15 else ''}</td>"
        rows = "".join(f"<tr>{''.join(cell() for _ in range(draw.randint(1, 3)))}</tr>" for _ in range(draw.randint(1, 3)))
        return f"<table>{draw.choice(['', '<caption>cap</caption>']) if depth == 0 else ''}{rows}</table>"

    def flow(depth):
        out = ""
        for _ in range(draw.randint(1, 5)):
            kind = draw.randint(0, 9)
            if kind <= 2:
                out += f"<p>{line()}{draw.choice(['', '<br>next'])}</p>"
            elif kind == 3:
                out += f"<h{draw.randint(1, 2)}>{words()}</h1>".replace("</h1>", "</h1>")
            elif kind == 4:
                out += nested(0)
            elif kind == 5:
                out += table()
            elif kind == 6:
                out += f"<blockquote>{flow(depth + 1)}</blockquote>" if depth < 2 else "<hr>"
            elif kind == 7:
                out += f"<dl><dt>{words()}</dt><dd>{line()}</dd></dl>"
            elif kind == 8:
                out += f"<pre>\n{words()}\n  {words()}\n</pre>"
            else:
                out += f"<div>{line()}{flow(depth + 1) if depth < 2 else ''}</div>" + draw.choice(["", "loose text "])
        return re.sub(r"<h2>([^<]*)</h1>", r"<h2>\1</h2>", out)

    return flow(0)


def markdown(spark, pages):
    rows = pages_to_markdown(spark.createDataFrame(list(enumerate(pages)), "page_id int, html string")).collect()
    got = {r.page_id: r.markdown for r in rows}
    assert len(rows) == len(pages)
    return [got[k] for k in range(len(pages))]


def test_pinned_pages(spark):
    assert markdown(spark, list(CASES)) == [(m + "\n") for m in CASES.values()]


def test_pages_are_what_a_walk_over_the_tree_gives(spark):
    draw = random.Random(65)
    pages, expected = [page(draw) for _ in range(300)], []
    for html in pages:
        tree = Tree()
        tree.feed(html)
        tree.close()
        expected.append(re.sub("\n{3,}", "\n\n", "\n\n".join(blocks(tree.root))).strip() + "\n")
    for html, want, got in zip(pages, expected, markdown(spark, pages), strict=True):
        assert got == want, html


def test_unfinished_pages(spark):
    pages = ["</ul></table>a</p><p>b", "<ul><li>a<li>b<ul><li>c</ul>", "<table><tr><td>a<td>b<tr><td>c</table>z", "<p><b>x<p>y</b>", "<a href=u>t<p>z", "a < b & c &nosuch; &#0;", "<h1></h1>", "\x02\x14a"]
    assert markdown(spark, pages) == ["a\n\nb\n", "- a\n- b\n  - c\n", "| a | b |\n| --- | --- |\n| c |  |\n\nz\n", "**x**\n\ny\n", "[t](u)\n\nz\n", "a < b & c &nosuch; �\n", "#\n", "a\n"]


def test_rows_are_pages_of_their_own_and_keep_their_columns(spark):
    rows = [(1, "<p>a</p>", "x", 7), (1, "<p>a</p>", None, 7), (None, None, "y", 8), (None, "", "z", 9)]
    df = spark.createDataFrame(rows, "page int, html string, markdown_of string, pos int")
    got = pages_to_markdown(df, "page", keep=("markdown_of", "pos")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, "a\n", "x", 7), (1, "a\n", None, 7), (None, "\n", "y", 8), (None, "\n", "z", 9)], key=str)
    assert pages_to_markdown(df.limit(0), "page").count() == 0


def test_a_page_of_five_megabytes(spark):
    part = "<p>para <b>x</b> &amp; <a href='u'>l</a></p><ul><li>a<ul><li>b</li></ul></li></ul>"
    took = []
    for n in (15_000, 60_000):
        began = time.time()
        text = markdown(spark, [part * n])[0]
        took.append(time.time() - began)
        assert text.count("para **x** & [l](u)") == n and text.count("\n  - b") == n
    assert took[1] < 6 * max(took[0], 2)  # four times the page


def test_every_kind_of_file_is_converted_and_checked(spark):
    from foliowork.plans.jobs import convert, finish

    html = "<h1>The great title here</h1><p>It was the best of times and it was the worst of times for all of them.</p><ul><li>x</li></ul>"
    text = "Der Hund und die Katze sind nicht mit dem Mann in das Haus\ngegangen, weil es\nmit der Frau nicht ging."
    rows = [("p", "HTML", html), ("c", "csv", 'a,b\n"x, ""y""",2\n\nq'), ("e", "csv", ""), ("t", "txt", text), ("n", "txt", None), ("u", None, "word")]
    src = spark.createDataFrame(rows, "doc_id string, ext string, text string")
    got = {r.doc_id: r for r in convert(src).collect()}
    assert len(got) == len(rows)
    assert got["p"].text == "# The great title here\n\nIt was the best of times and it was the worst of times for all of them.\n\n- x\n"
    assert (got["p"].title, got["p"].language, got["p"].passed) == ("The great title here", "en", True)
    assert got["c"].text == '| a | b |\n| --- | --- |\n| x, "y" | 2 |\n| q |  |\n' and got["e"].text == ""
    assert got["t"].text.split() == text.split() and "\n" not in got["t"].text.strip() and got["t"].language == "de"
    assert all(r.passed and r.retention == 1.0 and r.retention_ratio == 1.0 for r in got.values())
    # What a refinement loses is told.
    lossy = spark.createDataFrame([("x", "txt", "| a | b | c |\n" * 9 + "w " * 300, "w " * 20)], "doc_id string, ext string, text string, raw string")
    from foliowork.operators.structure import retention, structure, validate_content

    checked = validate_content(lossy, "text", "raw").withColumn("kept", retention(structure("text"), structure("raw"))).first()
    assert not checked.passed and {"words lost", "tables missing"} <= set(checked.warnings) and checked.kept == 0.0
