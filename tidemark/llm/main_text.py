"""Main text of web pages: boosted trees over DOM nodes and a consistent decoding.

Every block-level element and text leaf gets probabilities of three kinds: all its text
belongs to the article, none does, or both occur. Features are the subtree's text and link
density, the words of class, id and role with weights learnt from the training pages, depth,
position, elements around it, and how it compares with its siblings. The most probable labelling of
the whole tree in which everything below an element of the first kind is kept and
everything below one of the second is dropped follows from one pass up and one pass down,
so an ancestor and a descendant never contradict each other.

Training needs no labelled input. A bounded sample of pages (least hash) gives pages whose
one ``article`` or ``main`` element labels them, and paragraphs for pages made by random
designs (``made_pages``), whose labels are known.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm import boosting
from tidemark.llm.dom import Pages
from tidemark.llm.groups import rank_in_group
from tidemark.llm.made_pages import PARTS, Maker
from tidemark.llm.pieces import blocks
from tidemark.llm.registry import query, table, text_of

#: Pages sampled for training at most, the longest that may be, and pages made.
SAMPLE_PAGES = 120
SAMPLE_CHARS = 100_000
MADE_PAGES = 360
KEEP, DROP, MIXED = 0, 1, 2
BLOCK_BYTES = 1 << 20
#: Fewest training nodes with an attribute word for it to have a weight.
LEAST_SEEN = 4

#: Elements told apart, others being one kind; and those asked for among the ancestors.
KINDS = (
    "#text p h1 h2,h3,h4,h5,h6 li ul,ol,menu div section article main nav aside header footer form table,tbody,tr,td,th"
    " blockquote,pre,figure,figcaption dl,dt,dd dialog body,html,#page"
).split()
ABOVE = "article main nav aside header footer form ul,ol table dialog".split()


@dataclass(frozen=True)
class Model:
    forest: boosting.Forest
    weights: dict  # log odds of attribute words, for text that is kept


def _above(own, parent, levels, join):
    """For each node the ``join`` of ``own`` over its ancestors, 0 at the top."""
    import numpy as np

    out = np.zeros_like(own)
    for at in levels[1:]:
        out[at] = join(out[parent[at]], own[parent[at]])
    return out


def _levels(depth):
    """Nodes of depth 0, 1, ...; every page's root has depth 0."""
    import numpy as np

    order = np.argsort(depth, kind="stable")
    return np.split(order, np.cumsum(np.bincount(depth))[:-1]) if len(depth) else []


def features(pages: Pages, weights: dict):
    """One row per node of ``pages``."""
    import numpy as np

    n = len(pages.tag)
    parent, end, depth, page = (np.array(c, np.int64) for c in (pages.parent, pages.end, pages.depth, pages.page))
    levels = _levels(depth)
    nodes = np.arange(n)
    at_page = np.searchsorted(page, np.arange(pages.count))[page]  # root of each node's page

    def below(own):
        sums = np.concatenate([[0.0], np.cumsum(own, dtype=float)])
        return sums[end] - sums[:-1]

    def most(own):
        padded = np.append(own, 0).astype(float)
        return np.maximum.reduceat(padded, np.stack([nodes, end], 1).ravel())[::2] if n else padded[:0]

    kind_of = {tag: k for k, tags in enumerate(KINDS) for tag in tags.split(",")}
    kind = np.array([kind_of.get(t, len(KINDS)) for t in pages.tag], np.int64)
    codes = {t: k for k, t in enumerate(dict.fromkeys(pages.tag))}
    tag = np.array([codes[t] for t in pages.tag], np.int64)
    leaf = kind == kind_of["#text"]
    chars, linked, stops, digits, controls, media = (
        below(c) for c in (pages.chars, pages.linked, pages.stops, pages.digits, pages.controls, pages.media)
    )
    elements, leaves = below(~leaf), below(leaf)
    all_chars = np.maximum(chars[at_page], 1)
    size = np.log1p(chars)

    of_words = [[weights.get(w, 0.0) for w in words] for words in pages.words]
    best, worst = (np.array([f(0.0, *w) if w else 0.0 for w in of_words]) for f in (max, min))
    hidden = np.array(["hidden" in w for w in pages.words], float)
    named = np.array([len(w) for w in pages.words], float)

    # Siblings: nodes of one parent, in page order.
    order = np.argsort(parent, kind="stable")
    nth = np.empty(n)
    nth[order] = rank_in_group(parent[order]) if n else 0
    slot = np.where(parent >= 0, parent, nodes)
    siblings = np.bincount(slot, minlength=n)[slot]
    mean = (np.bincount(slot, size, n) / np.maximum(np.bincount(slot, minlength=n), 1))[slot]
    of_parent = chars[slot]
    same = parent[order][1:] == parent[order][:-1] if n else np.zeros(0, bool)
    before, after = np.zeros(n), np.zeros(n)
    before[order[1:][same]] = size[order[:-1][same]]
    after[order[:-1][same]] = size[order[1:][same]]
    pair, inverse, often = np.unique(slot * (len(codes) + 1) + tag, return_inverse=True, return_counts=True)
    alike = often[inverse] / np.maximum(siblings, 1) if n else size
    largest = np.zeros(n)
    np.maximum.at(largest, slot, chars * (parent >= 0))

    started = np.cumsum(pages.chars) - pages.chars if n else size
    position = (started - started[at_page]) / all_chars
    columns = [
        leaf, depth, most(depth) - depth, size, chars / all_chars, chars / np.maximum(of_parent, 1),
        chars / (elements + leaves + 1), linked / np.maximum(chars, 1), stops / np.maximum(chars, 1),
        digits / np.maximum(chars, 1), np.log1p(leaves), np.log1p(elements), chars / np.maximum(leaves, 1),
        np.log1p(most(pages.chars)), below(kind == kind_of["p"]), below(kind == kind_of["li"]) / np.maximum(elements, 1),
        below(kind == kind_of["h1"]), controls, media, position, position + chars / all_chars,
        siblings, nth, nth / np.maximum(siblings, 1), mean, size - mean, before, after, alike,
        chars / np.maximum(largest[slot], 1), best, worst, named, hidden,
        _above(best, parent, levels, np.maximum), _above(worst, parent, levels, np.minimum),
        _above(hidden, parent, levels, np.maximum), below(best) / (elements + leaves + 1), below(worst) / (elements + leaves + 1),
        most(best), -most(-worst), below(linked > 0) / np.maximum(leaves, 1),
    ]
    columns += [kind == k for k in range(len(KINDS))]
    for tags in ABOVE:
        inside = np.isin(kind, [kind_of[t] for t in tags.split(",")]) & ~leaf
        columns += [_above(inside.astype(float), parent, levels, np.add), below(inside)]
    return np.stack([np.asarray(c, float) for c in columns], axis=1)


def decode(pages: Pages, odds):
    """Kind of every node in the most probable labelling without contradictions."""
    import numpy as np

    parent, depth, end = (np.array(c, np.int64) for c in (pages.parent, pages.depth, pages.end))
    sums = np.concatenate([[0], np.cumsum(pages.chars)])
    leaf = np.array([t == "#text" for t in pages.tag])
    odds = odds.copy()
    odds[sums[end] == sums[:-1]] = 0.0  # nothing to keep or drop
    odds[leaf, MIXED] = -np.inf
    levels = _levels(depth)
    for at in levels[:0:-1]:
        for k in (KEEP, DROP):
            np.add.at(odds[:, k], parent[at], odds[at, k])
        np.add.at(odds[:, MIXED], parent[at], odds[at].max(axis=1))
    kind = odds.argmax(axis=1)
    for at in levels[1:]:
        up = kind[parent[at]]
        kind[at] = np.where(up == MIXED, kind[at], up)
    return kind


def labels(pages: Pages):
    """Kinds of nodes from marks: a leaf is what its nearest marked ancestor says, else dropped."""
    import numpy as np

    n = len(pages.tag)
    keep = np.zeros(n, bool)
    for i in range(n):
        mark, up = pages.mark[i], pages.parent[i]
        keep[i] = mark == "keep" if mark else up >= 0 and keep[up]
    leaf = np.array([t == "#text" for t in pages.tag])
    end = np.array(pages.end)
    kept, every = (np.concatenate([[0], np.cumsum(c)]) for c in (leaf & keep, leaf))
    kept, every = kept[end] - kept[:-1], every[end] - every[:-1]
    return np.where(kept == every, KEEP, np.where(kept == 0, DROP, MIXED)), every > 0


def _mark_made(tag, words, inside):
    return "keep" if "data-part=keep" in inside else "drop" if "data-part=drop" in inside else None


def _mark_given(tag, words, inside):
    """Elements that say themselves what they hold."""
    if tag in ("article", "main"):
        return "keep"
    aside = {w for part in ("ad", "comments", "notice", "share") for w in PARTS[part][0].split()[:4]}
    return "drop" if tag in ("nav", "footer", "aside", "form", "dialog") or aside & set(words) else None


def train(given: list[str], made: int = MADE_PAGES, seed: int = 5) -> Model:
    """Model from the texts of sampled pages; without any it learns from made pages alone."""
    import random

    import numpy as np

    pages, paragraphs = Pages(), []
    for page in given:
        trial = Pages()
        trial.add(page, _mark_given)
        kinds, _ = labels(trial)
        paragraphs += [t for t, k in zip(trial.text, kinds) if t and k == KEEP]
        if trial.mark.count("keep") == 1:
            pages.add(page, _mark_given)
    maker = Maker(random.Random(seed), paragraphs)
    for _ in range(made):
        pages.add(maker.page(), _mark_made)
    kinds, has_text = labels(pages)

    seen: dict = {}
    for words, kind, use in zip(pages.words, kinds, has_text):
        for w in set(words) if use else ():
            seen.setdefault(w, [0, 0])[int(kind == DROP)] += 1
    whole = np.bincount(kinds[has_text] == DROP, minlength=2)
    weights = {
        w: float(np.clip(np.log((kept + 1) / (whole[0] + 2)) - np.log((dropped + 1) / (whole[1] + 2)), -4, 4))
        for w, (kept, dropped) in seen.items()
        if kept + dropped >= LEAST_SEEN
    }
    x = features(pages, weights)[has_text]
    return Model(boosting.fit(x, kinds[has_text], 3), weights)


def fit(
    pages: DataFrame, html_col: str = "html", sample: int = SAMPLE_PAGES, longest: int = SAMPLE_CHARS, made: int = MADE_PAGES
) -> Model:
    """Model trained on at most ``sample`` pages of at most ``longest`` characters, of least hash.

    Hashes are picked first, then the pages that bear them, so the driver gets ``sample``
    hashes of each task and one page of each hash picked.
    """
    text = text_of(html_col)
    hashed = (
        pages.select(F.xxhash64(text).alias("hash"), text.alias("html"))
        .filter((F.char_length("html") <= longest) & (F.col("html") != ""))
    )
    picked = [r.hash for r in hashed.select("hash").distinct().orderBy("hash").limit(sample).collect()]
    if not picked:
        return train([], made)
    chosen = hashed.filter(F.col("hash") <= picked[-1]).groupBy("hash").agg(F.min("html").alias("html"))
    return train([r.html for r in sorted(chosen.collect())], made)


def texts(model: Model, given: list[str]) -> list[str]:
    """Main text of each page."""
    pages = Pages()
    for page in given:
        pages.add(page)
    kinds = decode(pages, model.forest.log_odds(features(pages, model.weights)))
    parts: list = [[] for _ in given]
    for i, text in enumerate(pages.text):
        if text and kinds[i] == KEEP:
            parts[pages.page[i]].append(text)
    return [" ".join(p) for p in parts]


def main_text(
    pages: DataFrame, model: Model, html_col: str = "html", text_col: str = "text", chars_col: str = "n_chars"
) -> DataFrame:
    """``pages`` without ``html_col``, plus the main text and its number of code points.

    Columns of the new names are replaced. Null and empty pages, and pages without an
    article, have an empty text. Text without markup is one block. Repeated rows and null ids are
    kept as they are; an empty table gives no rows. Blocks are joined in page order by one
    blank, white space inside a block is one blank.
    """
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    others = [c for c in pages.columns if c.lower() not in (html_col.lower(), text_col.lower(), chars_col.lower())]
    named = pages.select(*[F.col(f"`{c}`") for c in others], text_of(html_col).alias("_html"))

    def extract(batches):
        import pyarrow as pa

        for block in blocks(batches, "_html", BLOCK_BYTES):
            found = texts(model, block.column(len(others)).to_pylist())
            rest = [c.combine_chunks() for c in block.columns[: len(others)]]
            sizes = pa.array([len(t) for t in found], pa.int64())
            yield pa.RecordBatch.from_arrays([*rest, pa.array(found, pa.string()), sizes], names=[*others, text_col, chars_col])

    schema = [*named.schema.fields[: len(others)], StructField(text_col, StringType()), StructField(chars_col, LongType())]
    return named.mapInArrow(extract, StructType(schema))


@query()
def op13_main_text(spark: SparkSession, folder: str) -> DataFrame:
    """All pages with their main text."""
    pages = table(spark, folder, "pages")
    return main_text(pages, fit(pages)).select("page_id", "url", "text", "n_chars")
