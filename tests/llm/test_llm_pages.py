import re
from collections import Counter, defaultdict

from lagwise.llm import page_text as P
from lagwise.llm import queries

PAGES = [
    (1, "http://a.org/1", "<html><head><title>T</title></head><body><nav><a>Home</a></nav><div>All about us</div><div id=c><h1>One</h1><p>First &amp; only<br>line<p>Two</div><footer>f</footer></body></html>"),
    (2, "http://a.org/2", "<html><head><title>T</title></head><body><nav><a>Home</a></nav><div>All about us</div><div id=c><h1>Two</h1><p>Other</p></div><footer>f</footer></body></html>"),
    (3, "http://A.org:80/3", "<html><head><title>T</title></head><body><nav><a>Home</a></nav><div>All about us</div><div id=c><h1>Three</h1></div><footer>f</footer></body></html>"),
    (4, "http://b.org/", "<body><article><header>h</header><h1>Kept</h1><p>a <b>b</b><p>c<div class='ad big'>buy</div><section id=comments>no</section><p>d<aside>s</aside></article><p>outside"),
    (5, None, "<p>no host</p>"),
    (6, "not a url", None),
    (7, "http://c.org/x", ""),
    (8, "http://c.org/y", "plain text only &lt;b&gt; 3 < 4"),
    (9, "http://c.org/z", "<p>open <script>var t='</p>';</script>rest<!-- x -- ></p> gone -->end<form>f</form>"),
]
WANT = {
    1: "One\nFirst & only line\nTwo", 2: "Two\nOther", 3: "Three", 4: "Kept\na b\nc\nd", 5: "no host", 6: "", 7: "",
    8: "plain text only <b> 3 < 4", 9: "open restend",
}


def frame(spark):
    return spark.createDataFrame([(i, u, h, "clash", 1) for i, u, h in PAGES], "page_id long, url string, html string, text string, _tokens int")


def test_odd_pages(spark):
    found = P.extracted(frame(spark))
    assert sorted(found.columns) == ["_tokens", "html", "page_id", "text", "url"]
    assert {r.page_id: r.text for r in found.collect()} == WANT
    assert P.extracted(frame(spark).limit(0)).collect() == []


def test_classes_are_those_of_whole_occurrence_vectors(spark):
    pages = [(i, u, h) for i, u, h in PAGES if i <= 3] + [(10, PAGES[0][1], PAGES[0][2])]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    vectors = defaultdict(lambda: [0] * len(pages))
    for k, (_, _, html) in enumerate(pages):
        blocks, tags = P.read(html)
        for token, n in (Counter({P.number(t): n for t, n in tags.items()}) + Counter(b.token() for b in blocks if not b.content and not b.left_out)).items():
            vectors[token][k] = n
    groups = defaultdict(set)
    for token, v in vectors.items():
        if max(v) == 1 and sum(v) > len(pages) / 2:
            groups[tuple(v)].add(token)
    found = defaultdict(set)
    for r in P.classes(df).collect():
        found[(r.high, r.low)].add(r.token)
    assert sorted(map(sorted, found.values())) == sorted(sorted(g) for g in groups.values() if len(g) > 1)


def test_whole_table_against_a_plain_reading_of_articles(spark, folder):
    import html

    rows = queries.QUERIES["op9_page_text"](spark, folder).collect()
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    assert len(rows) == len(pages)
    for r in rows:
        article = re.search(r"<article>(.*?)(</article>|\Z)", pages[r.page_id], re.S)[1]
        blocks = re.split(r"</?(?:p|h1|ul|li|div)>", re.sub(r"</?b>|</?i>", "", article).replace("<br>", " "))
        want = "\n".join(x for x in (re.sub(r"\s+", " ", html.unescape(b)).strip() for b in blocks) if x)
        assert r.text == want and r.n_chars == len(want)


def test_copies_make_no_template(spark):
    from llm_data import prose

    body = lambda *texts: "<html><body>" + "".join(f"<div>{x}</div>" for x in texts) + "</body></html>"
    paragraphs = [prose(k, 60) for k in range(6)]
    pages = [("two.org", body(*paragraphs))] * 2 + [("many.org", body(*paragraphs))] * 1000
    pages += [("many.org", body(prose(20 + k, 30))) for k in range(3)]
    pages += [("near.org", body(*paragraphs[:5], f"{paragraphs[5]} changed{k}")) for k in range(40)]
    pages += [("pair.org", body(paragraphs[0], prose(30 + k, 60))) for k in range(2)]
    pages += [("real.org", body("Shown on all pages", prose(40 + k, 60))) for k in range(5)] * 2
    df = spark.createDataFrame([(k, f"http://{h}/{k}", x) for k, (h, x) in enumerate(pages)], "page_id long, url string, html string")
    found = {r.page_id: r.text for r in P.extracted(df.repartition(3)).collect()}
    for k, (host, html) in enumerate(pages):
        want = re.findall(r"<div>(.*?)</div>", html)
        assert found[k] == "\n".join(want[1:] if host == "real.org" else want)


def test_template_texts_inside_an_article_go(spark):
    from llm_data import prose

    page = "<body><nav>n</nav><main><p>Read our terms of use</p><p>{}</p><p>Share with all your friends</p></main></body>"
    texts = [prose(60 + k, 50) for k in range(4)]
    df = spark.createDataFrame([(k, f"http://m.org/{k}", page.format(x)) for k, x in enumerate(texts)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in P.extracted(df).collect()} == dict(enumerate(texts))


def test_ordinary_words_in_names_lose_nothing():
    page = (
        "<main><h2 id=search-algorithms>Search</h2><section id=related-work><h2 id=comments-in-python>Related</h2><p class=share-price>Price</p>"
        "<pre>x <span class=comment># why</span></pre></section><section id=search><p id=login>Login</p></section>"
        "<div class=share-bar>share</div><p class=ad>buy</p><section id=comments>no</section></main>"
    )
    assert P.main_text(page, set()).split("\n") == ["Search", "Related", "Price", "x # why", "Login"]
    assert P.main_text("<body><div id=site-menu>m</div><a class=share>s</a><ul><li><div class=social-links>l</div></ul><p>kept</p></body>", set()) == "kept"


def test_made_up_names_leave_out_only_what_they_name():
    page = (
        "<article><div class=menu-planning>a</div><section class=related-work>b</section><div class=share-price>c</div>"
        "<ul class=search-tips><li>d</li></ul><label>e</label><div class=comment-list>x</div><div class='ad-slot ad-2'>x</div>"
        "<ul class=share-links><li>x</ul><form><label>x</label></form></article>"
    )
    assert P.main_text(page, set()).split("\n") == ["a", "b", "c", "d", "e"]


def test_headings_of_the_template_stay_over_filled_slots(spark):
    from llm_data import prose

    page = "<body><article><h1>{}</h1><h2>Ingredients</h2><p>{}</p><h2>Method</h2><p>{}</p><h2>Tell us</h2></article><div>Imprint of all</div></body>"
    texts = [(f"Dish {k}", prose(80 + k, 40), prose(90 + k, 40)) for k in range(5)]
    df = spark.createDataFrame([(k, f"http://r.org/{k}", page.format(*x)) for k, x in enumerate(texts)], "page_id long, url string, html string")
    want = {k: f"{a}\nIngredients\n{b}\nMethod\n{c}" for k, (a, b, c) in enumerate(texts)}
    assert {r.page_id: r.text for r in P.extracted(df).collect()} == want


def test_classes_nest_or_the_rarer_one_goes():
    place = lambda kind, place, support: P.Place(kind, place, support)
    template = {1: place(1, 1, 9), 2: place(1, 9, 9), 3: place(2, 1, 5), 4: place(2, 2, 5), 5: place(3, 1, 4), 6: place(3, 2, 4)}
    assert P.nested([1, 3, 0, 4, 2, 5, 6], template) == [0, 1, 3, 4, 5, 6]
    assert P.nested([1, 3, 5, 4, 6, 2], template) == [0, 1, 3, 5]  # the third crosses the second
    assert P.nested([3, 1, 4, 2], template) == [1, 3]
    assert P.nested([1, 4, 3, 2], template) == [0, 3]  # not in the order of its class
    assert P.nested([1, 3, 4, 2, 3], template) == [0, 3]


def test_deep_and_broken_pages_are_read_in_linear_time():
    import time

    begin = time.process_time()
    for page in ("<div>" * 60_000 + "end", "<a " * 100_000, "<b><div></div>" * 20_000, "<p><b>" * 40_000, "<script " * 50_000, "x < " * 100_000):
        P.main_text(page, set())
    assert time.process_time() - begin < 20
    assert P.main_text("<div>" * 60_000 + "end", set()) == "end"
    assert P.main_text("<p>a <!-- b > <c", set()) == "a"
