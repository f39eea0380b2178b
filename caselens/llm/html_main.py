"""Main text of web pages by a tree-structured graphical model.

The nodes are the block elements of a page's DOM and its blocks of text. Each is content or not; a node's potential
comes from its tag, its class, id and role words, or the size, links and punctuation of its text, and parent-child
potentials connect the tree. A pass of sum-product messages upward and one downward give each block's marginal
probability of being content. All potentials are learned from labelled pages.

Text is taken from the whole page: character references are decoded, white space inside a block becomes one space,
blocks are trimmed and joined in page order by an empty line. What stands in elements that are not shown as text
(``RAW``) is dropped up to their end tag; without one, only the tag is, but for script and style. Nothing else is dropped
or cut: math and the fallback text in object are kept. Defined cases: a null or
empty page, and one without content, gives the empty text; unclosed and misnested tags are closed as browsers do for
paragraphs, list items and table cells; a stray "<" is text; an unfinished tag or comment at the end is dropped; repeated
rows each get their text; an empty table gives an empty result; further columns are kept by ``with_text``.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of HTML: elements that begin a block, have no end tag, hold raw text that is never shown, and close others.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td textarea tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript iframe svg annotation annotation-xml canvas audio video noembed noframes".split())
CLOSES_P = BLOCKS - frozenset("body head html legend li dd dt option td th tr tbody thead tfoot summary title".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}}

TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)"  # comment
    r"|<[!?][^>]*(?:>|\Z)"  # declaration
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>"""  # tag
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",  # tag with an open quote, or the page's end in a tag
    re.S,
)
#: A "/" at the end of a tag that belongs to an attribute's value without quotes.
UNQUOTED = re.compile(r"""=\s*[^\s"'>]+$""")
NAMES = re.compile(r"""\b(class|id|role|data-main)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)


@dataclass
class Page:
    """The tree of one page: for each node its parent, features, and text (None for an element)."""

    parent: list[int] = field(default_factory=list)
    features: list[list[str]] = field(default_factory=list)
    text: list[str | None] = field(default_factory=list)
    label: list[bool] = field(default_factory=list)

    def add(self, parent: int, features: list[str], text: str | None, label: bool) -> int:
        self.parent.append(parent)
        self.features.append(features)
        self.text.append(text)
        self.label.append(label)
        return len(self.parent) - 1


def text_features(text: str, linked: int) -> list[str]:
    share = linked / len(text)
    marks = sum(map(text.count, ".!?,;"))
    return [f"size:{min(9, len(text).bit_length())}", f"links:{0 if share == 0 else 1 if share < 0.34 else 2 if share < 0.67 else 3}", f"marks:{min(3, marks)}"]


def parse(source: str | None) -> Page:
    """The block tree of a page. The label of a node is that of the nearest ``data-main`` attribute (for training)."""
    source, page = source or "", Page()
    root = page.add(-1, ["tag:#root"], None, False)
    stack: list[tuple[str, int]] = [("#root", root)]
    opened: Counter[str] = Counter()  # names on the stack, so that a stray end tag is passed over without a search
    words: list[str] = []
    linked = in_link = 0
    at = 0
    unended: set[str] = set()

    def flush() -> None:
        nonlocal linked
        if words:
            text = " ".join("".join(words).split())
            if text:
                node = stack[-1][1]
                page.add(node, text_features(text, linked), text, page.label[node])
            words.clear()
        linked = 0

    def add_text(raw: str) -> None:
        nonlocal linked
        if raw:
            text = entities.unescape(raw) if "&" in raw else raw
            words.append(text)
            if in_link:
                linked += len(text.strip())

    def close(names: Iterable[str], scope: Iterable[str] = ()) -> bool:
        """Closes the innermost open block of one of the names, and all in it."""
        if not any(opened[name] for name in names):
            return False
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in names:
                flush()
                opened.subtract(name for name, _ in stack[i:])
                del stack[i:]
                return True
            if stack[i][0] in scope:
                return False
        return False

    while True:
        found = TOKEN.search(source, at)
        add_text(source[at : found.start()] if found else source[at:])
        if not found:
            break
        at = found.end()
        name = found[2] or found[5]
        if not name or (found[5] and not found[0].endswith(">")):
            continue
        name, ends = name.lower(), found[1] or found[4]
        if name in RAW and not ends:
            attributes = found[3] or found[6] or ""
            if name in unended or (name == "svg" and attributes.endswith("/") and not UNQUOTED.search(attributes)):
                continue
            end = re.compile(rf"</{name}(?![^\s/>])[^>]*>", re.I).search(source, at)
            if end:
                at = end.end()
            elif name in ("script", "style"):
                at = len(source)
            else:
                unended.add(name)
        elif name == "a":
            in_link = 0 if ends else 1
        elif name == "br":
            words.append(" ")
        elif name not in BLOCKS:
            continue
        elif ends:
            flush()
            close({name})
        else:
            flush()
            if name in CLOSES_P:
                close({"p"}, {"td", "th", "body", "div", "article", "section"})
            if name in SAME:
                close(SAME[name], SCOPE[name])
            features, label = [f"tag:{name}"], page.label[stack[-1][1]]
            for attribute in NAMES.finditer(found[3] or found[6] or ""):
                value = (attribute[2] or attribute[3] or attribute[4] or "").lower()
                if attribute[1].lower() == "data-main":
                    label = value == "1"
                else:
                    features += [f"word:{w}" for w in re.split(r"[^a-z]+", value) if w]
            node = page.add(stack[-1][1], features, None, label)
            if name not in VOID:
                stack.append((name, node))
                opened[name] += 1
    flush()
    return page


@dataclass
class Potentials:
    """Log-odds of each feature, log-odds of the root, and log[kind][parent][child] with kind 1 for text."""

    features: dict[str, float]
    root: float
    edges: list[list[list[float]]]

    def beliefs(self, page: Page) -> tuple[list[float], list[float], list[float]]:
        """Log-odds of each node without its parent's message, those of its parent without its own, and of both: by
        sum-product. Children follow parents, so one pass goes back and one forth."""
        n = len(page.parent)
        own = [0.0] * n
        message = [0.0] * n
        get = self.features.get
        for i in range(n - 1, -1, -1):
            own[i] += sum([get(f, 0.0) for f in page.features[i]])
            if i:
                e, b = self.edges[page.text[i] is not None], own[i]
                message[i] = log_add(e[1][0], e[1][1] + b) - log_add(e[0][0], e[0][1] + b)
                own[page.parent[i]] += message[i]
        belief, rest = [0.0] * n, [0.0] * n
        belief[0] = own[0] + self.root
        for i in range(1, n):
            e = self.edges[page.text[i] is not None]
            r = rest[i] = belief[page.parent[i]] - message[i]
            belief[i] = own[i] + log_add(e[0][1], e[1][1] + r) - log_add(e[0][0], e[1][0] + r)
        return own, rest, belief

    def marginals(self, page: Page) -> list[float]:
        """P(content) of each node."""
        return [1 / (1 + math.exp(-max(-500.0, min(500.0, b)))) for b in self.beliefs(page)[2]]

    def given_body(self, page: Page) -> list[float]:
        """P(content) of each node if the page's body is content: the same messages with that as evidence."""
        seen = Page(page.parent, [f + ["seen"] if "tag:body" in f or p < 0 else f for f, p in zip(page.features, page.parent, strict=True)], page.text, page.label)
        return Potentials(self.features | {"seen": SEEN}, self.root, self.edges).marginals(seen)


#: Elements that stand around an article.
AROUND = {"tag:article", "tag:main", "tag:div", "tag:section"}
#: Log-odds that stand for certainty, and the probability of content that a block needs where the body is taken for it.
SEEN, SURE = 30.0, 0.7


def log_add(a: float, b: float) -> float:
    return max(a, b) + math.log1p(math.exp(-abs(a - b)))


def train(sources: Iterable[str], rounds: int = 40, rate: float = 1.0, decay: float = 0.05) -> Potentials:
    """Potentials from labelled pages: elements with ``data-main`` = 1 are content, with 0 not, others as their parent.
    Gradient ascent on the conditional likelihood of the labels (with decay), whose gradient is what is seen of each
    feature and labelled edge less what the marginals expect."""
    pages = [parse(s) for s in sources]
    model = Potentials({f: 0.0 for p in pages for fs in p.features for f in fs}, -2.0, [[[0.5, -0.5], [-0.5, 0.5]] for _ in range(2)])
    squares: dict = Counter()

    def step(key, value: float, gradient: float) -> float:
        gradient -= decay * value
        squares[key] += gradient * gradient
        return value + rate * gradient / math.sqrt(squares[key] + 1e-6)

    for _ in range(rounds):
        features: dict[str, float] = dict.fromkeys(model.features, 0.0)
        edges = [[[0.0, 0.0], [0.0, 0.0]] for _ in range(2)]
        root = 0.0
        for page in pages:
            own, rest, belief = model.beliefs(page)
            for i, b in enumerate(belief):
                gap = page.label[i] - 1 / (1 + math.exp(-max(-50.0, min(50.0, b))))
                for f in page.features[i]:
                    features[f] += gap
                if i == 0:
                    root += gap
                    continue
                kind = page.text[i] is not None
                e = model.edges[kind]
                logs = [[e[y][z] + y * rest[i] + z * own[i] for z in (0, 1)] for y in (0, 1)]
                top = max(max(row) for row in logs)
                weights = [[math.exp(x - top) for x in row] for row in logs]
                total = sum(map(sum, weights))
                edges[kind][page.label[page.parent[i]]][page.label[i]] += 1
                for y in (0, 1):
                    for z in (0, 1):
                        edges[kind][y][z] -= weights[y][z] / total
        model = Potentials(
            {f: step(f, v, features[f]) for f, v in model.features.items()},
            step("root", model.root, root),
            [[[step((k, y, z), model.edges[k][y][z], edges[k][y][z]) for z in (0, 1)] for y in (0, 1)] for k in (0, 1)],
        )
    return model


@lru_cache
def default_model() -> Potentials:
    """The potentials learned from ``labelled_pages``."""
    return train(labelled_pages())


# Class and id words by which pages commonly name their parts.
MAIN_WORDS = "content main article post entry story body text page single blog news prose markdown detail".split()
JUNK_WORDS = {
    "nav": "nav menu navbar navigation breadcrumb breadcrumbs toolbar topbar tabs pagination pager".split(),
    "header": "header masthead site head logo brand hero top branding".split(),
    "footer": "footer copyright legal bottom colophon imprint foot".split(),
    "aside": "sidebar aside widget related recommended trending popular tags toc rail complementary".split(),
    "div": "ad ads advert advertisement sponsor sponsored promo banner cookie consent notice alert popup modal overlay gdpr share social newsletter subscribe paywall".split(),
    "form": "form search login signup subscribe contact newsletter".split(),
    "section": "comments comment discussion replies respond disqus reviews feedback reader".split(),
}


def labelled_pages(count: int = 240, seed: int = 7) -> list[str]:
    """Pages made by rule, with their labels: an article among the parts that surround and interrupt it."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("bcdfglmnprstv") + rng.choice("aeiou") for _ in range(rng.randint(1, 4)))
    sentence = lambda n: " ".join(word() for _ in range(rng.randint(1, n))).capitalize() + rng.choice("...?!")
    plain = lambda k: " ".join([word()] * rng.randint(1, 20 * k)) if rng.random() < 0.5 else word()  # noqa: E731  neither long nor punctuated
    prose = lambda k: plain(k) if rng.random() < 0.25 else " ".join(sentence(14) for _ in range(rng.randint(1, k)))
    link = lambda: f'<a href="/{word()}">{word()}</a>'

    def named(words: list[str]) -> str:
        picked = "-".join(rng.sample(words, rng.randint(1, min(2, len(words)))))
        return rng.choice([f' class="{picked}"', f' id="{picked}"', f' class="{picked} {word()}"', ""])

    def junk(kind: str) -> str:
        words = JUNK_WORDS[kind]
        tag = rng.choice([kind, kind, "div"]) if kind != "div" else rng.choice(["div", "div", "p", "aside"])
        name = named(words) if tag not in ("div", "p", "section") and rng.random() < 0.7 else f' {rng.choice(["class", "id"])}="{rng.choice(words)}"'
        if kind in ("nav", "header", "aside") and rng.random() < 0.8:
            inner = "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(rng.randint(1, 8))) + "</ul>"
            size = rng.randint(1, 5)
            inner = rng.choice(["", f"<h{size}>{prose(1)}</h{size}>", f"<p>{prose(2)}</p>"]) + rng.choice([inner, inner, f"<div>{link()} {link()}</div>", ""])
            inner = inner or prose(1)
        elif kind == "header":
            size = rng.randint(1, 4)
            inner = f"<h{size}>{prose(1)}</h{size}>" + rng.choice(["", f"<p>{prose(1)}</p>"])
        elif kind == "form":
            inner = f"<label>{word()}</label><input><p>{prose(1)}</p><button>{word()}</button>"
        elif kind == "section":
            reply = rng.choice(['<div class="comment"><p>{}</p></div>', "<p>{}</p>", "<li>{}</li>", "<article class='comment'><p>{}</p></article>"])
            inner = rng.choice(["", f"<h3>{prose(1)}</h3>"]) + "".join(reply.format(prose(3)) for _ in range(rng.randint(1, 5)))
        else:
            inner = rng.choice([prose(2), prose(2) + " " + link(), f"<p>{prose(2)}</p>", f"&copy; {word()} &middot; {prose(1)}"])
        return f'<{tag}{name} data-main="0">{inner}</{tag}>'

    def block() -> str:
        return rng.choices(
            [
                f"<p>{prose(8)}</p>",
                f"<p>{prose(2)} {link()} {prose(2)}</p>",
                f"<p><b>{prose(1)}<br>",
                f"<h2>{prose(1)}</h2>",
                f"<{rng.choice(['ul', 'ol'])}><li>{prose(2)}</li><li>{word()}<li>{prose(1)}</ul>",
                f"<blockquote>{prose(2)}</blockquote>",
                f"<div>{prose(4)}</div>",
                f"<table><tr><td>{prose(1)}</td><td>{word()}</td></tr></table>",
                f"<pre>{prose(1)}</pre>",
            ],
            [8, 3, 2, 3, 3, 1, 2, 1, 1],
        )[0]

    out = []
    for _ in range(count):
        inside = [f"<h1>{prose(1)}</h1>"] + [block() for _ in range(rng.randint(1, 10))]
        for _ in range(rng.choice([0, 0, 1, 2, 3])):
            inside.insert(rng.randint(1, len(inside)), junk(rng.choice(list(JUNK_WORDS))))
        tag = rng.choice(["article", "article", "article", "main", "div", "section"])
        name = named(MAIN_WORDS) if tag in ("article", "main") else f' {rng.choice(["class", "id"])}="{rng.choice(MAIN_WORDS)}"'
        article = f'<{tag}{name} data-main="1">{"".join(inside)}</{tag}>'
        if rng.random() < 0.3:
            article = f'<div class="{rng.choice(["wrapper", "container", "layout", "row"])}">{article}{junk("aside")}</div>'
        before = [junk(k) for k in rng.sample(["nav", "header", "div", "form"], rng.randint(1, 3))]
        after = [junk(k) for k in rng.sample(["footer", "section", "aside", "div", "form"], rng.randint(1, 3))]
        title = f"<head><title>{prose(1)}</title></head>"
        out.append(f"<!DOCTYPE html><html>{title}<body>{''.join(before)}{article}{''.join(after)}</body></html>")
    return out


def main_text(source: str | None, potentials: Potentials) -> str:
    """The text of the blocks that are more probably content than not. A page that has words but no element of
    ``AROUND`` that is content has its article in the body itself, which is then taken for it."""
    page = parse(source)
    kept = potentials.marginals(page)
    around = any(p > 0.5 and f[0] in AROUND for f, p in zip(page.features, kept, strict=True))
    if not around and any(c.isalnum() for t in page.text if t for c in t):
        kept = [p + 0.5 - SURE for p in potentials.given_body(page)]
    return "\n\n".join(t for t, p in zip(page.text, kept, strict=True) if t is not None and p > 0.5)


def with_text(pages: DataFrame, potentials: Potentials | None = None) -> DataFrame:
    """``pages`` with text and n_chars, by the given potentials or those of ``labelled_pages``."""
    model = potentials or default_model()

    @F.pandas_udf(T.StringType())
    def extract(html: pd.Series) -> pd.Series:
        return html.map(lambda h: main_text(h, model))

    return pages.withColumn("text", extract("html")).withColumn("n_chars", F.char_length("text").cast("long"))


def report(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages``."""
    return with_text(pages.select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
