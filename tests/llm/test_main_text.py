"""Main text: parsing, trees and decoding against plain versions; accuracy on unseen pages."""

import itertools
import random
import re

import numpy as np
import pytest

from tidemark.llm import boosting
from tidemark.llm import main_text as M
from tidemark.llm.dom import Pages, attribute_words
from tidemark.llm.made_pages import Maker

SF = "/root/testdata/sf0.01"


def leaves(page):
    p = Pages()
    p.add(page)
    return [t for t in p.text if t]


@pytest.mark.parametrize(
    "page, want",
    [
        ("", []),
        ("  \n ", []),
        ("no markup &amp; more\n  text", ["no markup & more text"]),
        ("<p>one <b>two<br>three<p>four", ["one two three", "four"]),
        ("<p>a<i>b</i>c</p>d", ["abc", "d"]),
        ("<ul><li>a<li>b<ul><li>c</ul></ul>", ["a", "b", "c"]),
        ("<table><tr><td>a<td>b<tr><th>c</table>d", ["a", "b", "c", "d"]),
        ("<script>var x='</p>';</script>a<style>b</style><textarea><p>c</textarea>d", ["ad"]),
        ("a<script>never closed <p>x", ["a"]),
        ("<!-- c <p>x</p> -->a<!-- open <p>b", ["a"]),
        ('<p title="x > y">a</p><p title=\'<b>\'>b', ["a", "b"]),
        ('<p title="x>a</p>', ["a"]),
        ("a < b <3 &lt;p&gt; &#233;&eacute &am", ["a < b <3 <p> éé &am"]),
        ("a<br/>b<hr>c<img src=x>d", ["a b", "cd"]),
        ("text <a href=cut", ["text"]),
        ("<div>a</span></b></div>b</div></p>c", ["a", "bc"]),
        ("<svg><text>x</text></svg><select><option>o</select>y", ["y"]),
        ("<![CDATA[x]]><?php y?>z", ["z"]),
    ],
)
def test_leaves(page, want):
    assert leaves(page) == want


def test_open_attributes_take_no_exponential_time():
    assert leaves("a<p " + 'k="v" ' * 5000) == ["a"]
    assert leaves("a" + "<p x='" * 3000)[0].startswith("a")


def test_attribute_words():
    assert attribute_words(' class="post-content mainBox" id=SideNAV data-x="ad" hidden') == (
        "post", "content", "main", "box", "side", "nav", "hidden")
    assert attribute_words(' style="display: none"') == ("hidden",)


def brute_decode(parent, odds, leaf):
    """Best labelling by trying all, in which children of keep are keep, of drop are drop."""
    n = len(parent)
    best = None
    for kinds in itertools.product(range(3), repeat=n):
        if any(leaf[i] and kinds[i] == 2 for i in range(n)):
            continue
        if any(kinds[parent[i]] != 2 and kinds[parent[i]] != kinds[i] for i in range(1, n)):
            continue
        total = sum(odds[i][k] for i, k in enumerate(kinds))
        if best is None or total > best[0] + 1e-12:
            best = (total, kinds)
    return best[1]


def test_decoding_is_the_most_probable_consistent_labelling():
    rng = random.Random(3)
    for _ in range(40):
        p = Pages()
        p.add("".join(rng.choice(["<div>x", "<p>y", "</div>", "z", "<ul><li>w</ul>"]) for _ in range(4))[:60])
        if len(p.tag) > 9:
            continue
        odds = np.log(np.random.default_rng(rng.randrange(10**6)).dirichlet([1, 1, 1], len(p.tag)))
        leaf = [t == "#text" for t in p.tag]
        sums = np.concatenate([[0], np.cumsum(p.chars)])
        used = [[0, 0, 0] if sums[p.end[i]] == sums[i] else odds[i] for i in range(len(p.tag))]
        got, want = M.decode(p, odds), brute_decode(p.parent, used, leaf)
        text = [i for i in range(len(p.tag)) if leaf[i]]
        assert [got[i] for i in text] == [want[i] for i in text]
        assert all(got[p.parent[i]] in (2, got[i]) for i in range(1, len(p.tag)))


def test_one_split_is_the_best_split():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 9, (400, 3)).astype(float)
    y = (x[:, 1] > 4).astype(int) ^ (rng.random(400) < 0.1)
    forest = boosting.fit(x, y, 2, rounds=1, depth=1)
    share = (np.bincount(y) + 1) / (len(y) + 2)
    for c in (0, 1):
        grad, hess = share[c] - (y == c), np.full(400, share[c] * (1 - share[c]))

        def gain(f, cut):
            left = x[:, f] <= cut
            return sum(grad[s].sum() ** 2 / (hess[s].sum() + boosting.SHRINK) for s in (left, ~left))

        best = max(((f, v + 0.5) for f in range(3) for v in range(8)), key=lambda s: gain(*s))
        assert (forest.feature[c, 0], forest.bound[c, 0]) == best
        left = x[:, best[0]] <= best[1]
        assert np.isclose(forest.leaf[c, 0], -boosting.RATE * grad[left].sum() / (hess[left].sum() + boosting.SHRINK))
    flipped = np.exp(boosting.fit(x, y, 2).log_odds(x)).argmax(1)
    # Nearer to the rule than the labels are, a tenth of which are flipped.
    assert (flipped == (x[:, 1] > 4)).mean() > 0.93
    assert len(forest.log_odds(x[:0])) == 0


def truth(page):
    """The generated pages have one plain article element."""
    import html

    inside = re.search(r"<article>(.*?)</article>", page, re.S).group(1)
    inside = re.sub(r"<[^>]*>", "", re.sub(r"</?(?:p|h1|br)>", " ", inside))
    return " ".join(html.unescape(inside).split())


@pytest.fixture(scope="module")
def given(spark):
    return spark.read.parquet(f"{SF}/pages.parquet")


@pytest.fixture(scope="module")
def model(given):
    return M.fit(given)


def test_given_pages(given, model):
    rows = given.collect()
    got = {r.page_id: r for r in M.main_text(given, model).collect()}
    assert len(got) == len(rows)
    for r in rows:
        assert got[r.page_id].text == truth(r.html) and got[r.page_id].n_chars == len(truth(r.html))


def test_unseen_designs(given, model):
    paragraphs = [t for r in given.collect()[-60:] for t in re.findall(r"<p>([^<]{20,})</p>", r.html)]
    maker = Maker(random.Random(77), paragraphs)
    right = found = every = 0
    for _ in range(150):
        pages, page = Pages(), maker.page()
        pages.add(page, M._mark_made)
        kinds, _ = M.labels(pages)
        got = M.decode(pages, model.forest.log_odds(M.features(pages, model.weights)))
        chars = np.array(pages.chars)
        right += chars[(kinds == 0) & (got == 0)].sum()
        found += chars[got == 0].sum()
        every += chars[kinds == 0].sum()
    assert right / found > 0.95 and right / every > 0.95


WORDS = "The harvest began early this year, and the farmers of the valley were glad of it."
PARTS = [f"{WORDS} Paragraph {k} goes on for a while, with commas, stops and all that; it ends here." for k in range(5)]
PAGES = [
    # div layout with sidebar, notice, comments
    '<body><div id="cookie-notice"><p>We use cookies to make this site better.</p><button>OK</button></div>'
    '<div class="site-header"><a href="/">Daily Valley</a></div><div class="main-menu"><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></div>'
    '<div class="wrapper"><div class="post-content"><h1>Harvest</h1>' + "".join(f"<p>{p}</p>" for p in PARTS) + "</div>"
    '<div class="sidebar"><h3>Related</h3><ul><li><a href="/1">Other one</a><li><a href="/2">Other two</a></ul></div></div>'
    '<div id="comments"><h3>2 comments</h3><div class="comment"><b>ann</b><p>I liked reading this very much.</p></div>'
    '<div class="comment"><b>bob</b><p>So did I, thank you.</p></div></div>'
    '<div class="footer">&copy; 2024 Daily Valley | <a href="/imprint">Imprint</a></div></body>',
    # semantic, advert and form inside the article
    "<header><a href='/'>Valley</a><nav><a href='/a'>A</a> <a href='/b'>B</a></nav></header><main><h1>Harvest</h1>"
    + f"<p>{PARTS[0]}</p><p>{PARTS[1]}</p><div class='advert'><p>Buy two tractors, get one free. Only today.</p></div>"
    + "".join(f"<p>{p}</p>" for p in PARTS[2:])
    + "<form class='newsletter'><label>Mail</label><input><button>Send</button></form></main><footer><p>&copy; Valley</p></footer>",
    # named by ids only, cut off before the end
    "<html><body><div id=nav><a href=1>one</a> | <a href=2>two</a> | <a href=3>three</a></div><div id=content><h1>Harvest</h1>"
    + "".join(f"<p>{p}" for p in PARTS),
]


def test_pages_written_by_hand(model):
    want = " ".join(["Harvest", *PARTS])
    assert M.texts(model, PAGES) == [want] * 3


def test_rows(spark, model):
    long = "<article>" + "<p>word and more words.</p>" * 40_000 + "</article><footer>x</footer>"
    rows = [(1, None, "u", 9), (1, "", "u", 9), (None, PAGES[0], None, 9), (None, PAGES[0], None, 9), (4, long, "w", 9), (5, "<nav><a>x</a></nav>", "t", 9)]
    pages = spark.createDataFrame(rows, "page_id long, html string, text string, n_chars int")
    got = M.main_text(pages, model)
    assert got.columns == ["page_id", "text", "n_chars"]
    out = sorted(((r.page_id, r.text, r.n_chars) for r in got.collect()), key=str)
    article, words = " ".join(["Harvest", *PARTS]), " ".join(["word and more words."] * 40_000)
    assert out == sorted([(1, "", 0), (1, "", 0), (5, "", 0), (4, words, len(words)), *[(None, article, len(article))] * 2], key=str)
    assert M.main_text(pages.limit(0), model).collect() == []


def test_training_without_pages(spark):
    none = spark.createDataFrame([], "page_id long, html string")
    alone = M.fit(none, made=200)
    assert M.texts(alone, ["", PAGES[2]]) == ["", " ".join(["Harvest", *PARTS])]
