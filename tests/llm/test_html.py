"""HTML extraction by wrappers: structure decides, not tags and names; odd markup; the algorithms beside brute force."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from weft.llm import html_wrapper as H

PAGE = """<html><head><title>t</title></head><body><nav><a>menu</a></nav><div>same notice</div><div class="{name}"><h1>{title}</h1><p>One &amp; <b>two</b>
 three.<p>{body}<ul><li>item {title}<li>other</ul><div><div><p>Subscribe here</p></div></div></div><div id="comments"><p>reader {title}</p></div><form>name<input></form><footer>f</footer></body>"""


def extract(spark, pages):
    df = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages)], "page_id long, url string, html string")
    return [r.text for r in H.extract(df).orderBy("page_id").collect()]


def plain(i, inner="x", outer="y"):
    """No article nor main element, no telling names: only the structure and what varies between pages tell."""
    body = "".join(f"<p>{inner} {i} paragraph {k} " + "words " * 20 + "</p>" for k in range(3))
    return f"<body><div class=a><div class=q><a>One</a> <a>Two</a></div><div class=b><h2>Title {i}</h2><div class=c>Read this first</div>{body}<div class=d><div>About {outer}<p>Write to us</p></div></div></div></div><div class=z>All rights kept</div></body>"


def test_unnamed_containers(spark):
    found = extract(spark, [(f"http://h.org/{i}", PAGE.format(name="x", title=f"Title {i}", body=f"Body {i} " * 30)) for i in range(8)])
    assert found[3] == "Title 3\nOne & two three.\n" + ("Body 3 " * 30).strip() + "\nitem Title 3\nother"


def test_the_wrapper_decides(spark):
    pages = [plain(i) for i in range(6)]
    found = extract(spark, [(f"http://h.org/{i}", p) for i, p in enumerate(pages)])
    want = "Title 4\n" + "\n".join(f"x 4 paragraph {k} " + ("words " * 20).strip() for k in range(3))
    assert found[4] == want
    alone = "\n".join(H.main_text(H.parse(pages[4]), None))
    assert alone != want and "Read this first" in alone and "Write to us" in alone  # a single page doesn't tell them


def test_constant_nodes_inside_an_article_are_template(spark):
    page = "<body><article><h1>T{0}</h1><section><p>Sign up for our letter</p></section><p>Text {0} of the article, some more</p><p>And {0} more</p></article></body>"
    assert extract(spark, [(f"http://h/{i}", page.format(i)) for i in range(5)])[2] == "T2\nText 2 of the article, some more\nAnd 2 more"


def test_copies_of_one_page_are_all_text(spark):
    page = "<body><div><h1>T</h1><p>Text of it</p></div></body>"
    assert extract(spark, [(f"http://h/{i}", page) for i in range(5)]) == ["T\nText of it"] * 5


def test_names_that_tell_nothing_keep_their_text(spark):
    inner = {
        "social-history": "<div class='social-history'><p>Kept history</p></div>", "tags": "<section class='tags'>Kept tags</section>", "notice-of-intent": "<h2 id='notice-of-intent'>Kept heading</h2>",
        "discussion": "<section id='discussion'>Kept talk</section>", "related-work": "<h2 id='related-work'>Kept work</h2>", "legal-form": "<h2 id='legal-form'>Kept form</h2>",
    }
    for name, x in inner.items():
        assert "Kept" in extract(spark, [("http://h/", f"<body><main><p>Some text of the page itself.</p>{x}</main></body>")])[0], name
    whole = extract(spark, [("http://h/", "<body><main><div class='social-history'><p>All of it</p></div></main></body>")])
    assert whole == ["All of it"]


@pytest.mark.parametrize("name", ["comments", "comments-area", "sidebar left", "cookie-notice", "site-footer", "ad", "share-links", "breadcrumbs"])
def test_names_that_tell(spark, name):
    assert extract(spark, [("http://h/", f"<body><div><p>Some text of the page, more than beside it.</p><div class='{name}'><p>Gone</p></div></div></body>")]) == ["Some text of the page, more than beside it."]


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ('<p class="x"">hello</p>', "hello"), ("<p class='x''>hello</p>", "hello"), ('<p "">hello</p>', "hello"), ('<p title="a > b">hello', "hello"), ('<p title="my class=ad text">hello', "hello"),
        ("<p title=a>hello", "hello"), ('<p title="open>hello', "hello"), ("a < b and c > d", "a < b and c > d"), ("<div/>x</div>y", "x\ny"), ("<p>a<script>if (a < b) '</p>'</script>b", "ab"),
        ("x<br>y<br/>z", "x y z"), ("<td>a<td>b", "a\nb"), ("&lt;b&gt; &amp;amp; &nbsp; &#8364;", "<b> &amp; \u20ac"), ("<p hidden>no</p><p style='display: none'>no</p>yes", "yes"), ("<!-- <p>no</p> -->yes<!", "yes"),
    ],
)
def test_odd_markup(page, want):
    assert "\n".join(H.main_text(H.parse(page), None)) == want


def test_deep_and_wide_pages_are_whole(spark):
    deep = "<div>" * 20_000 + "deep"
    wide = "".join(f"<div class=k{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}><p>w{i}</p></div>" for i in range(900))
    layers = lambda i: "<div class=a><p>same</p>" * 30 + f"<div class=b><p>new {i}</p><p>and {i}</p></div>"
    found = extract(spark, [("http://a/", deep), ("http://b/", wide), *[(f"http://c/{i}", layers(i)) for i in range(4)], ("http://a/1", deep)])
    assert found[0] == found[-1] == "deep" and found[1].split("\n") == [f"w{i}" for i in range(900)] and found[3] == "new 1\nand 1"


def test_edges(spark):
    article = "<body><aside>no</aside><article><h1>A</h1>text<br>more<script>x</script><div class='ad'>buy</div></article>"
    pages = [(1, None, None), (2, "", ""), (3, "nonsense", article), (3, "nonsense", article), (4, "http://a/", "<p>unclosed <b>bold"), (5, "http://b/", "plain & simple"), (6, "http://c/", "<" * 3000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("text", F.lit("old")).withColumn("host", F.lit(1)).withColumn("wrapper", F.lit(2))
    found = {r.page_id: r.text for r in H.extract(df).collect()}
    assert found[1] == found[2] == "" and found[3] == "A\ntext more" and found[4] == "unclosed bold" and found[5] == "plain & simple" and found[6] == "<" * 3000
    assert H.extract(df.where("page_id < 0")).count() == 0


def tree(rng, depth=3):
    part = H.Part(rng.choice("ab"), rng.randrange(3), 1, 0, 1, 0, [], [])
    if depth:
        part.kids = [tree(rng, depth - 1) for _ in range(rng.randrange(4))]
    return part


def brute(a, b):
    """The largest order-keeping matching of two trees with one mark: every choice of children is tried."""
    best = 0
    for n in range(min(len(a.kids), len(b.kids)) + 1):
        for x in itertools.combinations(a.kids, n):
            for y in itertools.combinations(b.kids, n):
                if all(p.mark == q.mark for p, q in zip(x, y, strict=True)):
                    best = max(best, sum(brute(p, q) for p, q in zip(x, y, strict=True)))
    return 1 + best


def test_tree_matching_beside_brute_force():
    rng = random.Random(4)
    for _ in range(60):
        a, b = tree(rng), tree(rng)
        b.mark = a.mark
        score = H.match(a, b)[id(a), id(b)][0]
        size = lambda t: len(H.preorder(t))
        assert score == brute(a, b) and size(H.merge(a, b)) == size(a) + size(b) - score


def test_merging_keeps_order_and_counts():
    t = lambda k, *kids: H.Part(k, 0, 1, 0, 0, 0, [], list(kids))
    a, b = t("r", t("a"), t("b", t("x")), t("c")), t("r", t("b", t("x")), t("a"), t("c"))
    out = H.merge(a, b)
    assert [(k.mark, k.n) for k in out.kids] == [("a", 1), ("b", 2), ("a", 1), ("c", 2)]
    again = H.from_json(H.to_json(out))
    assert [(d, x.mark, x.n) for d, x in H.preorder(again)] == [(d, x.mark, x.n) for d, x in H.preorder(out)]


def test_nodes_of_half_the_pages_survive_any_order():
    page = lambda i: H.skeleton(H.parse(f"<body><div class=a>{i}</div>" + ("<div class=b>same</div>" if i >= 300 else "") + f"<div class=only{chr(97 + i % 26)}{chr(97 + i // 26)}>x</div>"))
    top = H.merged([page(i) for i in range(600)])
    marks = {x.mark: x.n for _, x in H.preorder(top)}
    assert marks["div.b"] == 300 and len(marks) < 100


def unnamed(page):
    """The page without class, id and role, its sectioning elements renamed to div."""
    page = re.sub(r"""\s(class|id|role)=("[^"]*"|'[^']*'|[^\s>]+)""", "", page)
    return re.sub(r"<(/?)(article|nav|header|footer|aside|section|main)\b", r"<\1div", page)


def test_pages_without_names_have_the_same_texts(spark):
    """The table's pages hold one article element each; its blocks are the text, and they stay so when no name tells of it."""
    pages = [(r.url, r.html or "") for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    want = ["\n".join(H.blocks(H.parse(re.search(r"<article>(.*?)</article>", p, re.S)[1]))) for _, p in pages]
    assert extract(spark, pages) == want
    assert extract(spark, [(u, unnamed(p)) for u, p in pages]) == want
    assert all("\n".join(H.main_text(H.parse(p), None)) != w for (_, p), w in zip(pages, want, strict=True))


def test_hosts_with_varying_menus(spark):
    """Only div elements; menus, adverts, remarks and footers change from page to page, and some pages lack them."""
    rng = random.Random(7)
    words = lambda n: " ".join(rng.choice("amber birch cedar dune ember fjord grove heath".split()) for _ in range(n))
    pages, want = [], []
    for i in range(60):
        text = [words(rng.randint(8, 60)) for _ in range(rng.randint(2, 6))]
        menu = "<div><ul>" + "".join(f"<li><a href=/{k}>{words(2)}</a></li>" for k in range(rng.randint(3, 9))) + "</ul></div>"
        advert = f"<div>{words(4)}</div>" if i % 3 else ""
        side = f"<div><div><a href=/x>{words(3)}</a></div><div><a href=/y>{words(4)}</a></div></div>" if i % 4 else ""
        body = f"<div><h2>{text[0]}</h2>" + "".join(f"<p>{t}</p>" for t in text[1:]) + "</div>"
        pages.append((f"http://h{i % 3}.org/{i}", f"<body>{menu}{advert}{body}{side}<div>{words(5)} <a href=/z>{words(2)}</a></div></body>"))
        want.append("\n".join(text))
    assert extract(spark, pages) == want


def test_neighbours_join_where_their_trees_are_alike():
    kids = lambda page: [(k.mark, k.run) for k in H.skeleton(H.parse(page)).kids]
    assert kids("<div><p>a</p></div><div><p>b</p><p>c</p></div>") == [("div", 1)]
    assert kids("<div>menu</div><div><h1>a</h1><p>b</p></div><div>foot</div>") == [("div", 0)] * 3


def test_a_title_beside_the_text_is_kept(spark):
    page = "<body><div>Same site</div><div><h1>Title {0}</h1><div>" + "<p>long text {0} and so on and on</p>" * 3 + "</div></div><div>{0} foot</div></body>"
    assert extract(spark, [(f"http://h/{i}", page.format(i)) for i in range(4)])[1].split("\n") == ["Title 1"] + ["long text 1 and so on and on"] * 3
