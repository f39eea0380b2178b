import itertools
import math
import random

from caselens.llm import html_main as h

MODEL = h.default_model()


def test_marginals_match_enumeration():
    rng = random.Random(2)
    for _ in range(20):
        page = h.Page()
        for i in range(7):
            page.add(rng.randrange(i) if i else -1, [f"f{i}"], "t" if i and rng.random() < 0.4 else None, False)
        odds = {f"f{i}": rng.uniform(-3, 3) for i in range(7)}
        edges = [[[math.log(rng.uniform(0.1, 1)) for _ in range(2)] for _ in range(2)] for _ in range(2)]
        model = h.Potentials(odds, rng.uniform(-2, 2), edges)
        weight = [0.0] * 7
        total = 0.0
        for labels in itertools.product((0, 1), repeat=7):
            log = labels[0] * model.root + sum(y * odds[f"f{i}"] for i, y in enumerate(labels))
            log += sum(edges[page.text[i] is not None][labels[page.parent[i]]][labels[i]] for i in range(1, 7))
            p = math.exp(log)
            total += p
            for i, y in enumerate(labels):
                weight[i] += p * y
        assert all(abs(a - b / total) < 1e-9 for a, b in zip(model.marginals(page), weight))


def test_held_out_pages():
    wrong = blocks = 0
    for source in h.labelled_pages(100, seed=101):
        page = h.parse(source)
        for text, label, p in zip(page.text, page.label, MODEL.marginals(page)):
            if text is not None:
                blocks += 1
                wrong += (p > 0.5) != label
    assert wrong < 0.01 * blocks


def test_parts_of_a_page():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head><body>
    <header>Site</header><nav><ul><li><a href="/">Home</a><li><a href="/b">More</a></ul></nav><!-- <p>hidden</p> --><div class="ad">Buy now.</div>
    <article><h1>Title &amp; more</h1><p><b>First&nbsp;line<br>goes  on <a href="x>y">here</a>.<p>A &lt;b&gt; &#233; &eacute; 3 < 4 &am<ul><li>one<li>two</ul>
    <div class="cookie-notice">We use cookies.</div><form><label>Mail</label><input><button>Go</button></form>
    <p>Last words</article><section class="comments"><h3>Comments</h3><div class="comment"><p>I like it a lot.</p></div></section>
    <footer>&copy; me</footer></body></html>"""
    assert h.main_text(page, MODEL).split("\n\n") == ["Title & more", "First line goes on here.", "A <b> é é 3 < 4 &am", "one", "two", "Last words"]


def test_odd_pages():
    for source in (None, "", " ", "<", "<p", "<!--", "<script>x", "<nav><ul><li>a</ul></nav>", "</p></div>", "<a href='"):
        assert h.main_text(source, MODEL) == ""
    deep = "<div>" * 3000 + "x" + "</div>" * 3000
    assert isinstance(h.main_text(deep, MODEL), str)
    long = "<article>" + "<p>words and words.</p>" * 20000 + "</article>"
    assert h.main_text(long, MODEL).count("\n\n") == 19999


def test_elements_without_text():
    page = lambda inner: f"<body><article><h1>Title here</h1><p>Some words, before. {inner} Some words, after.</p><p>The last words, too.</p></article></body>"
    want = lambda inner: ["Title here", " ".join(f"Some words, before. {inner} Some words, after.".split()), "The last words, too."]
    found = lambda inner: h.main_text(page(inner), MODEL).split("\n\n")
    for tag in ("<svg/>", "<svg class='x' />", '<svg a="b"/>', "<math/>", "<noscript>", "<template>", "<svg>", "<object>", "<video src=x>", "<iframe>", "<canvas>"):
        assert found(tag) == want(""), tag
    for hidden in ("<svg><text>no</text></svg>", "<svg width=1/><text>no</text></svg>", "<noscript>no</noscript>", "<script>no</script>", "<template>no</template>", "<svg/><svg><text>no</text></svg>"):
        assert found(hidden) == want(""), hidden
    assert found("<math><mi>x</mi><mo>=</mo><mn>2</mn><annotation encoding='application/x-tex'>no</annotation></math>") == want("x=2")
    assert found("<object data='a'>A picture.</object>") == want("A picture.")
    assert found("<script>") == ["Title here", "Some words, before."]
    many = "<svg>" * 50_000 + "word, word."
    assert [t for t in h.parse(f"<article><p>{many}</p></article>").text if t] == ["word, word."]


#: Pages written by hand, not by the generator: what their readers came for, and what not.
BY_HAND = [
    ("<h1>Title</h1><p>Only plain paragraphs stand here, without any article.</p><p>A second one, with more words.</p>", ["Title", "Only plain paragraphs stand here, without any article.", "A second one, with more words."], []),
    ("<article><h1>T</h1><p>Some text here, with words.</p><aside class='related'>Related: y</aside><p>More text goes on, and on.</p></article><footer>f</footer>", ["T", "Some text here, with words.", "More text goes on, and on."], ["f"]),
    ("<center><h1>Old page</h1></center><p>Text of an old page. It has words.<p>Another one, too.<hr>", ["Old page", "Text of an old page. It has words.", "Another one, too."], []),
    ("<main><table><tr><td>A cell, of a table.</td><td>Another cell, of it.</td></tr></table><p>And words below, as well.</p></main><nav><a href='/'>Home</a></nav>", ["A cell, of a table.", "Another cell, of it.", "And words below, as well."], ["Home"]),
]


def test_pages_by_hand():
    for inner, wanted, unwanted in BY_HAND:
        found = h.main_text(f"<html><head><title>x</title></head><body>{inner}</body></html>", h.default_model()).split("\n\n")
        assert [t for t in wanted if t in found] == wanted, inner
        assert not set(unwanted) & set(found), inner


def test_report(spark):
    page = "<body><nav><a>x</a></nav><article><h1>One title</h1><p>Two words, é.</p></article></body>"
    pages = spark.createDataFrame([(1, "u", page, "c"), (2, None, None, "c"), (1, "u", page, "c")], "page_id long, url string, html string, text string")
    got = [tuple(r) for r in h.report(pages).orderBy("page_id").collect()]
    assert got == [(1, "u", "One title\n\nTwo words, é.", 24)] * 2 + [(2, None, "", 0)]
    assert h.report(pages.limit(0)).count() == 0


def test_stray_end_tags_are_passed_over():
    """100,000 end tags without an open element under 100,000 open ones: no search of the stack for each."""
    import time

    began = time.perf_counter()
    page = h.parse("<div>" * 100_000 + "words" + "</table></ul>" * 100_000)
    assert len(page.parent) > 100_000 and time.perf_counter() - began < 20
