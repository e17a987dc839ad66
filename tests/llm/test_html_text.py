import random

from tokenloom.llm import html_text as H

VOID_SET: set[int] = set()


def text(html):
    return H.main_text(html, VOID_SET)


def test_blocks_entities_and_white_space():
    html = "<html><head><title>T</title><style>p{}</style></head><body><nav><a>menu</a></nav><article><h1>A &amp;\n B</h1><p>one<b>two</b><br>three<p>four &lt;x&gt; &eacute;<script>var t='</p>';</script></article><footer>&copy; me</footer>"
    assert text(html) == "A & B onetwo three four <x> é"


def test_noise_inside_and_outside():
    html = "<body><header>top</header><div>loose</div><main><header><h1>t</h1></header><p>x</p><div id=comments><p>c</p></div><form>f<p>g</p></form><aside>s</aside><p>y</main><div class=s>z</div>"
    assert text(html) == "t x y"
    assert text("<div><p>a</p><p>b</div></section>c") == "a b c"
    assert text("") == "" and text("<p") == "" and text("a < b <!-- c") == "a < b" and text("<p>1 <script>") == "1"


def test_unclosed_elements_end_with_their_parent():
    for tag in ("button", "select", "svg", "object", "video", "audio", "canvas", "noscript", "template"):
        assert text(f"<body><div><{tag}>x</div><{tag}>y<article><p>a <{tag}>z</p><p>b</article><{tag}>t</{tag}>") == "a b"
        assert text(f"<p>a<{tag}>x<article>n</article></{tag}>b<{tag}/>c<p>d") == "a b c d"
        assert text(f"<{tag}>x<{tag}>y</{tag}>z</{tag}>a") == "a"
        assert text(f"<article><p>a<{tag}>x<p>b<ul><li>c<{tag}><b>x</b><li>d</ul><p>e") == "a b c d e"
    assert text("<p>a<script>b<article>c</article>") == "a" and text("<button>x<script></button></script><main>a</main>") == "a"


def test_priors():
    assert text("<div class=elementor-widget><article class=share-price-report>a<h2 class=notice-period>b</h2></article></div>") == "a b"
    assert text("<main><section class=related-work>a</section><p>x<math><mi>y</mi><mo>=</mo><mn>2</mn></math>") == "a xy=2"
    assert text("<form id=all><nav>n</nav><div>page in a form</div></form>") == "page in a form" and text("<p>some longer text</p><form>search</form>") == "some longer text"
    assert text("<article>a<p>b</article><ol id=comments><li class=comment><article>c</article></ol>") == "a b"
    assert text("<div class='ad widget sidebar share'>a</div>") == "a"  # names of adverts decide nothing


def pages(n=120):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows = []
    for i in range(n):
        body = " ".join(word() for _ in range(40))
        ad = f"Buy {'abcde'[i % 5]} now"  # each on every fifth page
        rows.append((i, f"http://h{i % 2}.com/{i}", f"<body><div class=x><p>Same words on all</p></div><div class=q>{ad}</div><div class=y><p>{body}</p></div><div class=z>links here</div>", body))
    return rows


def test_style_tree_removes_what_repeats(spark):
    rows = pages()
    odd = [(900, None, None, ""), (901, "http://rare.org/", "<div class=x><p>Same words on all</p></div><div class=y>only here", "only here"), (902, "::bad::", "<p>solo</p>", "solo"), (0, rows[0][1], rows[0][2], rows[0][3])]
    df = spark.createDataFrame([(*r[:3], "q") for r in rows + odd], "page_id long, url string, html string, text string").repartition(3)
    got = sorted((r.id, r.text) for r in H.extract(df).collect())
    assert got == sorted((r[0], r[3]) for r in rows + odd)
    assert all(text(r[2]) != r[3] for r in rows)  # without the tree nothing of it goes


def brute_importance(rows, gamma=0.9):
    """Straight from the definition, page by page."""
    import math
    from collections import defaultdict

    def tree(group):
        nodes = defaultdict(list)
        for items in group.values():
            for node in {i[0] for i in items}:
                nodes[node].append([i for i in items if i[0] == node])
        return nodes

    host_pages, every = defaultdict(dict), {}
    for host, html in rows:
        capture, items = H.page_features(html or "")
        items = sorted(items)
        for group in (host_pages[host], every):
            group[capture] = min(group.get(capture, items), items)
    all_nodes, out = tree(every), {}
    h = lambda c, m: math.log(c) / math.log(m) if m > 1 else 0.0
    for host, group in host_pages.items():
        for node, pages_ in tree(group).items():
            m, every_ = len(pages_), all_nodes[node]
            values = {i[2] for p in pages_ for i in p if i[1] == 2}
            count = lambda ps, v: sum(any(i[1] == 2 and i[2] == v for i in p) for p in ps)
            all_values = {i[2] for p in every_ for i in p if i[1] == 2}
            mean = sum(h(count(every_, v), len(every_)) for v in all_values) / len(all_values)
            shared = (sum(max(h(count(pages_, v), m), h(count(every_, v), len(every_))) for v in values) + 10 * mean) / (len(values) + 10)
            styles = [next(i[2] for i in p if i[1] == 1) for p in pages_]
            style = -sum(styles.count(x) / m * math.log(styles.count(x) / m) for x in set(styles)) / math.log(m) if m > 1 else 1.0
            w = gamma ** max(i[3] for p in pages_ for i in p)
            out[host, node] = (m, (1 - w) * style + w * (1 - shared))
    return out


def test_importance_against_brute_force(spark):
    rng = random.Random(6)
    block = lambda: rng.choice(["one", "two", "three four", "five 5", "six"]) if rng.random() < 0.6 else str(rng.random()) + "abcdefghij"[rng.randrange(10)] * 3
    rows = []
    for i in range(90):
        inner = "".join(f"<{t} class=c{rng.randrange(2)}>{block()}<p>{block()}</p></{t}>" for t in rng.choices(["div", "section", "nav"], k=rng.randrange(1, 5)))
        rows.append((f"h{i % 7}", f"<body>{inner}{block()}</body>"))
    rows += rows[:9] + [("h0", None), ("h9", "<p>x</p>")]
    got = {(r.host, r.node): (r.m, r.importance) for r in H.importance(spark.createDataFrame(rows, "host string, html string").repartition(4)).collect()}
    want = brute_importance(rows)
    assert set(got) == set(want)
    assert all(got[k][0] == m and abs(got[k][1] - x) < 1e-9 for k, (m, x) in want.items())


def test_neutral_names_give_the_same_texts(spark):
    """Without article elements and with meaningless class names the tree alone finds adverts; menus and footers are elements."""
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", "html")
    want = {r.id: r.text for r in H.extract(df).collect()}
    plain = df.selectExpr("page_id", "url", "replace(replace(replace(html, '<article>', '<div class=\"ka\">'), '</article>', '</div>'), 'class=\"ad\"', 'class=\"kb\"') as html")
    assert {r.id: r.text for r in H.extract(plain).collect()} == want
    assert any(text(r.html) != want[r.page_id] for r in plain.collect())


def test_clashing_names_and_long_pages(spark):
    long = "<p>" + "word " * 200_000 + "</p>"
    df = spark.createDataFrame([(1, "http://a/", long, "x"), (2, "http://a/", "", "y")], "page_id long, url string, html string, HTML string")
    assert {r.id: len(r.text) for r in H.extract(df).collect()} == {1: 999_999, 2: 0}


def test_empty(spark):
    assert H.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_generated_pages(spark):
    import re

    df = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    html = {r.page_id: r.html for r in df.collect()}
    for r in H.extract(df).collect():
        article = re.search(r"<article>(.*?)</article>", html[r.id], re.S)[1]
        blocks = re.split(r"</?(?:p|h1)>", article)
        import html as h

        want = " ".join(x for x in (" ".join(h.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", b))).split()) for b in blocks) if x)
        assert r.text == want


def test_copies_of_an_article_stay_whole(spark):
    page = lambda name: f"<body><div class=x>Same on all</div><article><h1>Title {name}</h1><p>The words of {name}.</p><div><p>More.</p></div></article></body>"
    words = ["alpha", "beta", "gamma", "delta", "omega"]
    rows = [(i, f"http://one.com/{i}", page("alpha"), "alpha") for i in range(40)]
    rows += [(100 + i, f"http://five.com/{i}", page(words[i % 5]).replace("article", "main"), words[i % 5]) for i in range(60)]
    df = spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string").repartition(3)
    assert {r.id: r.text for r in H.extract(df).collect()} == {r[0]: f"Title {r[3]} The words of {r[3]}. More." for r in rows}


def test_the_tree_decides_inside_articles(spark):
    """What all of a site's articles repeat in a place of its own goes, whether or not an article element is around it."""
    rows = [(i, f"http://h.com/{i}", f"<body><div class=n>Same on all</div><ARTICLE><h1>{body[:20]}</h1><div class=u><p>Subscribe to our letter</p></div><p>{body}</p></ARTICLE>", f"{body[:20]} {body}") for i, _, _, body in pages()]
    for i, tag in enumerate(("article", "main", "div")):
        df = spark.createDataFrame([(k, f"{u}?{i}", h.replace("ARTICLE", tag)) for k, u, h, _ in rows], "page_id long, url string, html string").repartition(3)
        assert {r.id: r.text for r in H.extract(df).collect()} == {r[0]: r[3] for r in rows}
    few = spark.createDataFrame([(k, u, h.replace("ARTICLE", "article")) for k, u, h, _ in rows[:3]], "page_id long, url string, html string")
    assert all("Subscribe" in r.text for r in H.extract(few).collect())  # three captures say too little against an article
