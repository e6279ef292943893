import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import neighbours, page_text

FRAME = '<html><head><title>t</title></head><body><div>Menu one</div><div>{0}</div><p>Shared &amp; legal</p></body></html>'


def test_blocks_and_furniture():
    page = '<nav><a href="/">Home</a></nav><article><h1>A  &lt;b&gt;</h1><p>x <b>y</b>z<br>w<p>v</p><div class="comments"><p>no</p></div><form>no</form><script>"</p>"</script></article><footer>&copy; no</footer>'
    assert page_text.article_of(page_text.lines(page)) == "A <b>\nx yz w\nv"


@pytest.mark.parametrize(
    "page",
    [
        '<article><p>One<p class="notice">no<p>Two<div>Three</div></article>',
        '<article><p>One<p><span class="ad">no<p>Two<ul><li class="share">no<li>Three</ul></article>',
        "<html><head><title>no</title><meta charset=x><body><article><p>One<p>Two<p>Three</article>",
        '<article><p>One</p><svg/><p>Two</p><svg class="x" /><p>Three</p></article>',
        "<body><form action=/search/>no</form><svg><path><article><p>One<p>Two<p>Three</article><svg></svg>",
        '<body class="no-sidebar"><article><p>One<p>Two<p>Three</article><aside>no</aside></body>',
        '<div class="page with-sidebar"><div class="content-sidebar-wrap"><main><p>One<p>Two<div class="related">no</div><p>Three</main></div></div>',
        '<div class="related"><article><p>One<p>Two<p>Three</article></div>',
        '<form id="aspnet"><main><p>One<p>Two<p>Three</main></form>',
        '<article><p>One<p>Two<p>Three</article><section id="comments"><article>no</article></section><aside><article>no</article></aside>',
    ],
)
def test_ordinary_markup_drops_no_article(page):
    assert page_text.article_of(page_text.lines(page)) == "One\nTwo\nThree"


def test_marks_of_the_page_silence_no_page():
    assert page_text.candidates_of(page_text.lines('<body class="widget no-sidebar"><div class="with-sidebar">Text<div class="sidebar">no</div></div></body>')) == ["Text"]


def test_lcs_matches_brute_force():
    r = np.random.default_rng(1)
    for _ in range(60):
        a, b = ([str(x) for x in r.integers(0, 4, r.integers(0, 9))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        assert sum(page_text.shared_lines(a, b)) == table[-1][-1]


def test_pages_without_article_lose_what_the_nearest_shares(spark):
    rows = [(i, f"http://h.org/a/{i}", FRAME.format(f"Own text {i}"), 7) for i in range(20)]
    rows += [(50, "https://alone.org/x", FRAME.format("Only"), 7), (51, None, FRAME.format("No address"), 7), (52, "http://h.org/zz", None, 7), (53, "", "", 7), (54, "http://c.org/1", FRAME.format("Copy"), 7), (55, "http://c.org/2", FRAME.format("Copy"), 7), (1, "http://h.org/a/1", FRAME.format("Own text 1"), 7)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text long").repartition(4)
    got = {r.page_id: (r.text, r.n_chars) for r in page_text.extract(pages).collect()}
    assert page_text.extract(pages).count() == len(rows)
    assert all(got[i] == (f"Own text {i}", len(f"Own text {i}")) for i in [0, *range(3, 19)])
    assert got[50][0] == "Menu one\nOnly\nShared & legal" and got[51][0].startswith("Menu one")
    assert got[52] == ("", 0) and got[53] == ("", 0) and got[54] == got[55] == ("Menu one\nCopy\nShared & legal", 28)
    assert page_text.extract(pages.limit(0)).count() == 0


def brute_texts(rows):
    """Every page against all others of its host, with a plain table of common subsequences."""
    found = {k: page_text.lines(html or "") for k, (_, _, html) in enumerate(rows)}
    split = {k: (m.group(1).lower(), m.group(2)) if (m := re.match(r"(?:\w+://)?([^/?#]*)([^?#]*)", url or "")) else ("", "") for k, (_, url, _) in enumerate(rows)}
    order = sorted(found, key=lambda k: (*split[k], rows[k][0]))
    main = {k: [x for x in found[k] if x[1] != page_text.FURNISHED] for k in found}
    for k in found:
        texts, gone = [t for t, _ in found[k]], set()
        place = order.index(k)
        sides = [next((o for o in side if split[o][0] == split[k][0] and split[k][0] and main[o] != main[k]), None) for side in (order[:place][::-1], order[place + 1 :])]
        common = [-1 if o is None else len(os.path.commonprefix([split[o][1], split[k][1]])) for o in sides]
        if max(common) >= 0:
            other = [t for t, _ in found[sides[0] if common[0] >= common[1] else sides[1]]]
            n, m = len(texts), len(other)
            best = [[0] * (m + 1) for _ in range(n + 1)]
            for i in range(n - 1, -1, -1):
                for j in range(m - 1, -1, -1):
                    best[i][j] = best[i + 1][j + 1] + 1 if texts[i] == other[j] else max(best[i + 1][j], best[i][j + 1])
            i = j = 0
            while i < n and j < m:
                if texts[i] == other[j]:
                    gone.add(i)
                    i, j = i + 1, j + 1
                elif best[i + 1][j] >= best[i][j + 1]:
                    i += 1
                else:
                    j += 1
        kinds = [kind for _, kind in found[k]]
        article = any(kind >= page_text.ARTICLE for kind in kinds)
        yield rows[k][0], "\n".join(t for i, (t, kind) in enumerate(found[k]) if (kind == page_text.ARTICLE or i not in gone) and (kind >= page_text.ARTICLE if article else kind == page_text.CANDIDATE))


def test_query_equals_brute_force(spark):
    r = np.random.default_rng(6)
    word = lambda n: " ".join(f"w{k}" for k in r.integers(0, 90, n))
    menus = [[f"<div>menu {h} {k}</div>" for k in range(4)] for h in range(3)]
    rows = []
    for i in range(90):
        h = int(r.integers(0, 3))
        head = "".join(menus[h][: r.integers(1, 5)])
        own = "".join(f"<p>{word(6)}" for _ in range(r.integers(1, 5)))
        body = own if r.random() < 0.5 else f"<article><h1>{word(3)}</h1>{own}<p><a href=x>Read more {h}</a></p><p>A quoted line {h}</p></article><footer>foot {h}</footer>"
        rows.append((i, f"https://h{h}.org/{'ab'[i % 2]}/{r.integers(0, 999)}", f"<body>{head}{body}</body>"))
    rows += [(200 + i, f"https://h1.org/a/c{i}", rows[0][2]) for i in range(15)] + [(300, None, rows[1][2]), (301, "https://h1.org/a/5", None), (302, "https://h2.org/a/6", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = page_text.extract(pages)
    assert sorted((x.page_id, x.text) for x in got.collect()) == sorted(brute_texts(rows))
    assert page_text.deletions(page_text.parsed(pages)).agg(F.sum(F.size("shared"))).first()[0] > 100


@pytest.mark.parametrize("parts", [1, 4, 7, 50])
def test_copies_may_fill_partitions(spark, parts):
    """60 copies of a page between two others, and next to another host's; the dealing changes nothing."""
    page = lambda k: f"<body><div>Menu</div><p>own {k}</p><div>Legal</div></body>"
    rows = [(0, "https://a.org/a", page("first")), *((1 + i, f"https://a.org/b{i:02d}", page("copy")) for i in range(60)), (99, "https://a.org/c", page("last"))]
    rows += [(200 + i, f"https://b.org/b{i:02d}", page("copy")) for i in range(9)] + [(300, "https://c.org/x", page("alone"))]
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set(coalesce, "false")
    try:
        got = page_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset(coalesce)
    assert sorted((x.page_id, x.text) for x in got) == sorted(brute_texts(rows))
    assert sum(x.text == "own copy" for x in got) == 60


def test_common_subsequences_in_linear_memory(monkeypatch):
    r = np.random.default_rng(2)
    a, b = ([str(x) for x in r.integers(0, 6, 90)] for _ in range(2))
    want = sum(page_text.shared_lines(a, b))
    monkeypatch.setattr(page_text, "TABLE_CELLS", 20)
    assert sum(page_text.shared_lines(a, b)) == want


def test_a_page_of_several_megabytes(spark):
    body = "".join(f"<p>paragraph {i} of a long page &amp; more</p>" for i in range(60_000))
    pages = spark.createDataFrame([(1, "https://a.org/x", f"<body><nav>menu</nav><article>{body}</article></body>"), (2, "https://a.org/y", "<p>other</p>")], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in page_text.extract(pages).collect()}
    assert got == {1: "\n".join(f"paragraph {i} of a long page & more" for i in range(60_000)), 2: "other"}


def test_repeated_ids_of_vectors(spark):
    """Rows that share an id are candidates of their own; as a query an id has one answer, the nearest of any of its rows, without them."""
    rows = [(i % 30, [float(i), 1.0]) for i in range(60)]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 20, 3)
    assert all(r.vec_id != r.query_id for r in got.collect()) and sorted(r.vec_id for r in got.collect()) == [27, 28, 29]


@pytest.mark.parametrize("shard_rows", [150, 10_000])
def test_recall_and_order(spark, shard_rows):
    r = np.random.default_rng(3)
    x = r.normal(size=(700, 16)) * r.uniform(0.5, 2, (700, 1))
    x[300:360] = x[20]
    rows = [(i, x[i].tolist(), i) for i in range(700)] + [(900, None, 0), (901, [0.0] * 16, 0), (902, [float("nan")] + [1.0] * 15, 0), (903, [None] + [1.0] * 15, 0), (904, [1.0] * 3, 0), (None, [1.0] * 16, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, shard int")
    got = neighbours.nearest(df, F.col("vec_id") % 20 == 0, 20, shard_rows).toPandas()
    hits = 0
    for q in range(0, 700, 20):
        s = (x * x[q]).sum(axis=1)
        s[q] = -np.inf
        want = np.lexsort((np.arange(700), -s))[:20]
        mine = got[got["query_id"] == q].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 21)) and np.allclose(mine["score"], (x[mine["vec_id"]] * x[q]).sum(axis=1), rtol=1e-12)
        assert (np.diff(mine["score"]) <= 0).all()
        hits += len(set(want) & set(mine["vec_id"]))
    assert hits >= 0.9 * 20 * 35
    tied = got[(got["query_id"] == 20)].sort_values("rank")["vec_id"].tolist()
    assert [v for v in tied if 300 <= v < 360] == sorted(v for v in tied if 300 <= v < 360)
    assert neighbours.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert neighbours.nearest(df.filter("vec_id < 3"), F.col("vec_id") == 0).count() == 2
    # vectors of another length are searched among their own
    other = spark.createDataFrame([(1000 + i, [float(i + 1), 1.0], 0) for i in range(5)], df.schema)
    both = neighbours.nearest(df.unionByName(other), F.col("vec_id").isin(20, 1000), 20, shard_rows).toPandas()
    assert both[both["query_id"] == 1000]["vec_id"].tolist() == [1004, 1003, 1002, 1001]
    assert sorted(both[both["query_id"] == 20]["vec_id"]) == sorted(tied)
