import random

import duckdb
import pytest

from revlake.llm import wrapper as W
from revlake.llm.registered import SQL

SCHEMA = "page_id long, url string, html string, host string, text string, skeleton string, constant string"


def texts(spark, rows):
    return {r.page_id: r.text for r in W.main_texts(spark.createDataFrame([(*r, *"zzzz") for r in rows], SCHEMA)).collect()}


def words(r, n):
    return " ".join(r.choice(["liber", "ardor", "été", "straße", "quux", "zeta"]) + str(r.randint(0, 99)) for _ in range(n))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_sql_gives_the_same_texts(spark, sf):
    path = f"/root/testdata/{sf}/pages.parquet"
    got = sorted(tuple(r) for r in W.main_texts(spark.read.parquet(path)).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{path}'")
    assert got == sorted(con.execute(f"SELECT page_id, url, text, n_chars FROM ({SQL['op12_wrapper_induction']})").fetchall())


def test_template_of_a_host_without_marks(spark):
    r = random.Random(1)
    rows, want = [], {}
    for i in range(40):
        blocks = [words(r, 9) for _ in range(r.randint(1, 6))]
        menu = "".join(f'<li><a href="/{j}">{words(r, 1)}</a>' for j in range(r.randint(2, 5)))
        extra = "<div class=x><p>Only here now</p></div>" if i % 7 == 0 else ""
        body = "".join(f"<p>{b}" for b in blocks)
        page = f"<body><div><h2>The Daily Site</h2></div><ul>{menu}</ul><div class='c {i}'><h1>{blocks[0]}</h1>{body}{extra}</div><div>All rights kept</div>"
        rows.append((i, f"https://site.example/{i}", page))
        want[i] = "\n".join([blocks[0], *blocks, *(["Only here now"] if extra else [])])
    # On another host the same lines are too few pages to be template.
    rows.append((100, "http://other.example/", "<div>All rights kept</div><p>own text"))
    got = texts(spark, rows)
    assert got.pop(100) == "All rights kept\nown text" and got == want


def test_copies_do_not_make_an_article_template(spark):
    page = "<body><nav>menu</nav><article><h1>Same</h1><p>one text</p></article></body>"
    rows = [(i, f"https://copies.example/{i}", page) for i in range(30)]
    assert set(texts(spark, rows).values()) == {"Same\none text"}


def test_hot_host_on_the_salted_way(spark, monkeypatch):
    from revlake.operators import joins

    monkeypatch.setattr(joins, "broadcast_limit", lambda df: 0)
    test_template_of_a_host_without_marks(spark)


ODD = {
    "": "",
    "plain text &amp; more": "plain text & more",
    "<p>a  b\n c&nbsp;d<p>e": "a b c d\ne",
    "<p>one<br>two<hr>three</p>": "one two\nthree",
    "<article><p>x<script>if (a<b) '</p>'</script> y<!-- <p>no --> z</p></article>": "x y z",
    "<article>lead<p>in</p>tail</article><p>out": "lead\nin\ntail",
    "<main><header><h1>T</h1></header><p>a</p><footer>f</footer><section class='user-comments'><p>nice</p></section></main>": "T\na",
    "<header>site</header><p>a</p><aside>b</aside><form><p>c</form><div id='cookieNotice'>d</div><div role=navigation>e</div>": "a",
    "<p>5 < 6 &lt;b&gt; &#x41;&#233;&bogus; &am": "5 < 6 <b> Aé&bogus; &am",
    "<p>cut <a href='x": "cut",
    "<p>cut <!-- never closed <p>x": "cut",
    "<ul><li>a<li>b<ul><li>c</ul></ul><table><tr><td>1<td>2<tr><td>3</table>": "a\nb\nc\n1\n2\n3",
    "<p title='a>b'>q</p></div></p></span>r": "q\nr",
    "<p><a href=x>only</a> <a href=y>links</a></p><p>text with a <a href=x>link</a></p>": "text with a link",
    "<article><p><a href=x>only a link</a></p></article>": "only a link",
    "<title>t</title><style>p{}</style>body text": "body text",
    "<div>" * 5000 + "deep" + "</div>" * 5000 + "<p>after": "deep\nafter",
    "<div>" * 300 + "<nav>menu</nav>deep": "deep",
    "<article><p>a</article><article class=comment><p>b</article>": "a",
    "<textarea><p>x</textarea><p>y": "y",
}


def test_odd_pages(spark):
    rows = [(i, None if i % 2 else f"https://odd{i}.example", page) for i, page in enumerate(ODD)]
    rows += [(-1, None, None), (None, "https://odd2.example", "<p>no id"), (2, "https://odd2.example", list(ODD)[2])]
    got = texts(spark, rows)
    assert got.pop(-1) == "" and got.pop(None) == "no id"
    assert got == {i: want for i, want in enumerate(ODD.values())}
    assert W.main_texts(spark.createDataFrame([], SCHEMA)).count() == 0
    assert W.main_texts(spark.createDataFrame([(*r, *"zzzz") for r in rows], SCHEMA)).count() == len(rows)


def brute_match(a, b):
    """Most nodes that two trees (label, children) share, top down and in order."""
    if a[0] != b[0]:
        return 0
    x, y = a[1], b[1]
    if not x or not y:
        return 1
    first, rest = (a[0], x[1:]), (b[0], y[1:])
    return max(brute_match(first, b), brute_match(a, rest), brute_match(first, rest) + brute_match(x[0], y[0]))


def test_simple_tree_matching():
    r = random.Random(5)

    def tree(depth):
        return (r.choice("ab"), [tree(depth - 1) for _ in range(r.randint(0, 3))] if depth else [])

    def lines(t, depth=0):
        return [f"{depth} {t[0]}"] + [x for c in t[1] for x in lines(c, depth + 1)]

    for _ in range(150):
        a, b = ("r", tree(3)[1]), ("r", tree(3)[1])
        la, lb = "\n".join(lines(a)), "\n".join(lines(b))
        place = W.matched(la, lb)
        used = [p for p in place if p >= 0]
        assert len(used) == len(set(used)) == brute_match(a, b)
        assert used == sorted(used)
        assert all(la.split("\n")[p] == lb.split("\n")[i] for i, p in enumerate(place) if p >= 0)


def test_neighbours_of_equal_shape_are_one_node():
    page = W.Page("<body><ul><li>a<li>b<li>c</ul><div><p>x<p>y</div><div><p>z</div><p>w")
    tree, node = W.skeleton(page)
    assert tree.split("\n") == ["0 html", "1 body", "2 ul", "3 li", "2 div", "3 p", "2 p"]
    assert [tree.split("\n")[node[b]] for b, _, _ in page.texts] == ["3 li"] * 3 + ["3 p"] * 3 + ["2 p"]
