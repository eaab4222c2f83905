from pyspark.sql import functions as F

from foliowork.operators import html as H
from foliowork.operators import tables as T
from foliowork.operators.walker import pages_to_markdown

PAGES = {
    "<h1>Hi <b>there </b>x</h1><p>a <i>b</i> &amp; c_d<br>e</p>": "# Hi **there** x\n\na *b* & c\\_d  \ne\n",
    "<ul><li>a<ul><li>b</li></ul></li><li>c</li></ul><ol start='3'><li>x</li><li>y</li></ol>": "- a\n  - b\n- c\n\n3. x\n4. y\n",
    "<blockquote><p>q1</p><p>q2</p></blockquote><pre>a  b\n c</pre>": "> q1\n>\n> q2\n\n```\na  b\n c\n```\n",
    "<p># not</p><p>see <a href='u?x=1'>me</a><a href='z'> </a> <code>a_b</code></p>": "\\# not\n\nsee [me](u?x=1) `a_b`\n",
    "<table><caption>Cap</caption><tr><th>A</th><th>B</th></tr><tr><td>1|2</td></tr></table><hr>": "**Cap**\n\n| A | B |\n| --- | --- |\n| 1\\|2 |  |\n\n---\n",
    "<script>'</p>'</script><nav><p>open <b>mark<p>next": "open **mark**\n\nnext\n",
    "": "\n",
}


def test_pages_to_markdown(spark):
    df = spark.createDataFrame(list(enumerate(PAGES)) + [(99, None)], "page_id int, html string")
    rows = {r.page_id: r.markdown for r in pages_to_markdown(df).collect()}
    assert [rows[i] for i in range(len(PAGES))] == list(PAGES.values()) and rows[99] == "\n"


def test_tags_cells_and_links(spark):
    html = "<section><a href=x.html>go <b>on</b></a><img src='i.png' alt='pic'></section><table><tr><td colspan='2'>a</td><th>b <i>c</i></th></tr></table>"
    df = spark.createDataFrame([(1, html)], "page_id int, html string")
    assert [r.tag for r in H.fold_tags(H.tag_stream(df)).orderBy("pos").collect()][:2] == ["div", "a"]
    assert {(r.kind, r.label, r.target) for r in H.page_links(df).collect()} == {("link", "go on", "x.html"), ("image", "pic", "i.png")}
    assert [(r.row, r.col, r.value, r.colspan) for r in H.page_tables(df).orderBy("col").collect()] == [(0, 0, "a", 2), (0, 1, "b c", 1)]


def test_csv(spark):
    df = spark.createDataFrame([(1, 'a,b\n"x, ""y""",2\n\nq'), (2, 'h\r\n"m\nn",z\r\n'), (3, ""), (4, "a;b\tc"), (5, None)], "doc_id int, text string")
    rows = [(r.doc_id, r.row, r.col, r.value) for r in T.csv_cells(df).orderBy("doc_id", "row", "col").collect()]
    assert rows == [(1, 0, 0, "a"), (1, 0, 1, "b"), (1, 1, 0, 'x, "y"'), (1, 1, 1, "2"), (1, 2, 0, "q"), (2, 0, 0, "h"), (2, 1, 0, "m\nn"), (2, 1, 1, "z"), (4, 0, 0, "a;b\tc")]
    drawn = {r.doc_id: r.markdown for r in T.cells_to_markdown(T.csv_cells(df)).collect()}
    assert drawn[2] == "| h |  |\n| --- | --- |\n| m n | z |\n"


def test_grids_and_kernels(spark):
    strips = [(1, 0, [["k", "v"], ["a", "1"], ["b", "2"]]), (1, 1, [["a", "1"], ["b", "2 x"], ["c", "3"]]), (1, 2, [["d", "4", "5"], ["e"]]), (2, 0, [["d", "1"], ["d", "2"]]), (2, 1, [["d", "3"]])]
    rows = T.stitch(spark.createDataFrame(strips, "table_id int, strip int, rows array<array<string>>")).collect()
    assert [r.cells for r in sorted(rows, key=lambda r: r.row) if r.table_id == 1] == [["k", "v"], ["a", "1"], ["b", "2"], ["c", "3"], ["e", ""]]
    assert len([r for r in rows if r.table_id == 2]) == 3  # one key, other values: rows of their own
    grid = [[("a", 1, 1), ("b", 1, 1)], [("c", 1, 1), ("d", 1, 1)]]
    assert T.tree_similarity(grid, grid) == 1.0
    assert abs(T.tree_similarity(grid, [grid[0], grid[1][:1]]) - (1 - 1 / 7)) < 1e-9
    assert T.tree_similarity(grid, [[("a", 1, 1), ("B", 1, 1)], grid[1]], structural=True) == 1.0
    pairs = spark.createDataFrame([("a b c d", "a b x d"), ("", ""), (None, "x")], "reference string, text string")
    assert [r.sim for r in T.sequence_ratio(pairs).collect()] == [0.75, 1.0, 0.0]


def test_large_tables_keep_all_rows_and_cells(spark):
    rows, cells = 100_005, 10_005
    long = "<table>" + "".join(f"<tr><td>{k}</td></tr>" for k in range(rows)) + "</table>"
    drawn = pages_to_markdown(spark.createDataFrame([(1, long)], "page_id int, html string")).first().markdown.strip().split("\n")
    assert len(drawn) == rows + 1 and drawn[0] == "| 0 |" and drawn[-1] == f"| {rows - 1} |"
    wide = "<table><tr>" + "".join(f"<td>{k}</td>" for k in range(cells)) + "</tr></table>"
    head = pages_to_markdown(spark.createDataFrame([(1, wide)], "page_id int, html string")).first().markdown.split("\n")[0]
    assert head.split("|")[-2] == f" {cells - 1} " and head.count("|") == cells + 1
