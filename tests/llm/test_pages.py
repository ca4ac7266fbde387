import html
import random

from headway.llm import pages

PAGES = "page_id long, url string, html string"


def site(n, article=True, seed=1):
    """Pages of one host: the same menu, advert and footer around different texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9)))
    rows, texts = [], []
    for i in range(n):
        body = [" ".join(word() for _ in range(rng.randrange(3, 40))) for _ in range(4)]
        body[1] += " a &amp; b &lt;c&gt; &#233;"
        tags = ("<article>", "</article>") if article else ('<div class="x1">', "</div>")
        inner = f"<h1>{body[0]}</h1><p>{body[1]}\n\t {body[2]}<p><b>{body[3]}<br></p>"
        page = f'<!doctype html><html><head><title>t</title><style>p{{}}</style><script>var a="</p>";</script></head><body><nav><ul><li><a href="/">Home</a></ul></nav><!-- x --><div class="ad">Buy</div><div class="k9"><div>Always the same words here</div></div>{tags[0]}{inner}{tags[1]}<form><input><p>Search</p></form><div id="comments"><p>Nice {i}!</p></div><footer>Foot {i}</footer></body></html>'
        rows.append((i, f"https://www.example.org/{i}", page))
        texts.append("\n".join([body[0], html.unescape(f"{body[1]} {body[2]}"), body[3]]))
    return rows, texts


def test_articles(spark):
    rows, texts = site(20)
    got = {r.page_id: r for r in pages.main_text(spark.createDataFrame(rows, PAGES)).collect()}
    assert [got[i].text for i in range(20)] == texts
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_site_tree_removes_what_all_pages_share(spark):
    rows, texts = site(30, article=False)
    df = spark.createDataFrame(rows, PAGES)
    got = {r.page_id: r.text for r in pages.main_text(df).collect()}
    assert [got[i] for i in range(30)] == texts
    tree = {r.path: r for r in pages.site_trees(df).collect()}
    found = {b.tag: [] for b in pages.branches(pages.parse(rows[0][2])).values()}
    for path, b in pages.branches(pages.parse(rows[0][2])).items():
        found[b.tag].append(tree.get(path))
    same, different = [x for x in found["div"] if x.words == 5][-1], found["p"][0]
    assert same.content < 1e-9 and different.content > 0.9 and different.pages == 30


def test_boilerplate_inside_an_article_goes_and_copies_of_a_page_protect_nothing(spark):
    rows, texts = site(30)
    shared = '<p class="x">Read more of our best stories every day</p></article>'
    rows = [(i, u, h.replace("</article>", shared)) for i, u, h in rows]
    rows += [(100 + k, f"https://www.example.org/copy{k}", rows[3][2]) for k in range(200)]
    got = {r.page_id: r.text for r in pages.main_text(spark.createDataFrame(rows, PAGES), words=False).collect()}
    assert [got[i] for i in range(30)] == texts and all(got[100 + k] == texts[3] for k in range(200))


def plain(page):
    """The text of a driver page's article by cutting strings: an extraction of its own."""
    import re

    part = re.search(r"<article>(.*)</article>", page, re.S).group(1)
    pieces = re.split(r"</?(?:p|h1)>", part)
    lines = [" ".join(html.unescape(re.sub(r"<[^>]*>", " " if "br" in x else "", x.replace("<br>", " "))).split()) for x in pieces]
    return "\n".join(x for x in lines if x)


def test_trees_alone_find_the_articles_of_the_driver_pages(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    sizes = {}
    rows = df.collect()
    for r in rows:
        sizes[pages.host(r.url)] = sizes.get(pages.host(r.url), 0) + 1
    want = {r.page_id: plain(r.html) for r in rows}
    with_words = {r.page_id: r.text for r in pages.main_text(df).collect()}
    assert with_words == want
    alone = {r.page_id: r.text for r in pages.main_text(df, words=False, least_pages=4).collect()}
    large = [r.page_id for r in rows if sizes[pages.host(r.url)] >= 8]
    assert len(large) > 20 and sum(alone[i] == want[i] for i in large) >= 0.95 * len(large)


def test_hot_hosts_are_dealt_out_when_trees_are_not_broadcast(spark, monkeypatch):
    rows, texts = site(40)
    monkeypatch.setattr(pages, "PART_PAGES", 10)
    df = spark.createDataFrame(rows, PAGES)
    want = sorted(tuple(r) for r in pages.main_text(df).collect())
    monkeypatch.setattr(pages, "BROADCAST_BYTES", 64)
    assert sorted(tuple(r) for r in pages.main_text(df).collect()) == want


def test_odd_pages_end_soon():
    import time

    for page in ("<div>" * 100_000, "<a '" * 250_000, "<a b=\"" * 150_000, "<p x='" + "<b y=" * 100_000, "<a =\" " + "<i " * 200_000, "</div>" * 100_000 + "<li>" * 100_000, "<!--" * 100_000, "<div><p>" * 50_000):
        t = time.time()
        pages.extract(page)
        pages.branches(pages.parse(page))
        assert time.time() - t < 10


def test_edges(spark):
    rows = [(1, None, None), (2, "", ""), (3, "x", "plain  text\nonly"), (4, "http://h/", "<p>cut off <b"), (5, "http://h/", "<article><p>one<p>two</div></article>"), (5, "http://h/", "<article><p>one<p>two</div></article>"), (None, "http://h/", "<p>" + "long " * 50_000), (7, None, "<script>never ends"), (8, "//H/x", "a<br>b &nbsp; c &bogus; &#x41;")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], PAGES + ", host int, low int")
    got = sorted(((r.page_id, r.text) for r in pages.main_text(df).collect()), key=str)
    want = [(1, ""), (2, ""), (3, "plain text only"), (4, "cut off <b"), (5, "one\ntwo"), (5, "one\ntwo"), (None, ("long " * 50_000).strip()), (7, ""), (8, "a b c &bogus; A")]
    assert got == sorted(want, key=str)
    assert pages.main_text(df.filter("false")).count() == 0


def test_hosts_agree_with_sql(spark):
    assert pages.host("https://u@Www.A.org:80/x?y") == "www.a.org:80" and pages.host("//b/c") == "b" and pages.host("a/b") == pages.host(None) == ""


def test_all_features_of_a_node_count(spark, monkeypatch):
    import math

    rows, _ = site(30, article=False)
    rows = [(i, u, h.replace("<p>", f'<p><a href="/{i}">a</a><img src="/same">', 1)) for i, u, h in rows]
    n, on = {}, {}
    for _, _, h in rows:
        for path, b in pages.branches(pages.parse(h)).items():
            n[path] = n.get(path, 0) + 1
            for f in [(t, len(t)) for t in b.terms] + [((r,), 1) for r in b.refs]:
                on.setdefault(path, {})[f] = on.get(path, {}).get(f, 0) + 1
    want = {}
    for path in set(n) - {0}:
        weighed = [(c * f[1], 1 - math.log(c) / math.log(n[path])) for f, c in on.get(path, {}).items()]
        want[path] = sum(w * x for w, x in weighed) / sum(w for w, _ in weighed) if weighed else 0.0
    assert max(map(len, on.values())) > 500
    df = spark.createDataFrame(rows + rows[:7], PAGES)  # some pages twice
    for held in (pages.HELD, 40):
        monkeypatch.setattr(pages, "HELD", held)
        got = {r.path: r for r in pages.site_trees(df).collect()}
        assert set(got) == set(want) and all(abs(got[p].content - want[p]) < 1e-9 and got[p].pages == 30 for p in want)


def test_what_differs_counts_wherever_its_hashes_lie(spark):
    words = sorted((f"word{k}" for k in range(3000)), key=pages._hash)
    shared, own = words[:20], words[20:]
    rows, texts = site(30)
    extra = [" ".join(shared + own[i * 90 : i * 90 + 90]) for i in range(30)]
    rows = [(i, u, h.replace("</article>", f'<p class="x">{x}</p></article>')) for (i, u, h), x in zip(rows, extra, strict=True)]
    got = {r.page_id: r.text for r in pages.main_text(spark.createDataFrame(rows, PAGES)).collect()}
    assert [got[i] for i in range(30)] == [f"{t}\n{x}" for t, x in zip(texts, extra, strict=True)]


def test_copies_of_a_page_count_once(spark):
    rows = [(1, "http://h/a", "<p>x</p>"), (2, "http://h/b", "<p>x</p>"), (3, "http://H/c", "<p>x</p>"), (4, "http://h/d", "<p>y</p>"), (5, "http://g/a", "<p>x</p>"), (6, "http://h/e", None), (7, "http://h/f", "")]
    got = sorted((r.host, r.html) for r in pages.different_pages(spark.createDataFrame(rows, PAGES)).collect())
    assert got == [("g", "<p>x</p>"), ("h", ""), ("h", "<p>x</p>"), ("h", "<p>y</p>")]


def test_a_notice_with_one_changing_word_goes(spark):
    rows, texts = site(30)
    rows = [(i, u, h.replace("</article>", f'<p class="x">This is story {i} of the many that we tell</p></article>')) for i, u, h in rows]
    got = {r.page_id: r.text for r in pages.main_text(spark.createDataFrame(rows, PAGES)).collect()}
    assert [got[i] for i in range(30)] == texts
