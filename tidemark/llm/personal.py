"""Personal data: exact patterns plus a skip-chain conditional random field.

Patterns find the base spans. The field labels tokens that hold a digit or ``@``; its
neighbours are adjacent tokens (the chain) and tokens of the same document that repeat or
resemble each other (skip edges). Tokens under a base span are observed; loopy message
passing carries their labels to look-alikes that no pattern matches, such as the same
number with other separators. Every look-alike has an edge of its own to the nearest
observed one, so the distance between them doesn't matter. Runs of tokens labelled alike
become added spans.

Weights are trained here, on a bounded sample of documents with such tokens, by
pseudo-likelihood: every token given the labels of its neighbours, labels being those of
the base spans; tokens that repeat a match in another spelling have no known label and take
no part. Documents are independent, so Spark deals out documents, and one document
is held by one task at a time.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm.pieces import blocks
from tidemark.llm.registry import fresh, query, table, text_of

#: Kinds in order of precedence, and the patterns of base spans.
KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

SAMPLE_DOCS = 2000
BLOCK_BYTES = 4 << 20
SURE = 0.9
#: Messages that change by less (in nats) have settled. After LONG rounds the steps shrink, so that
#: messages that never settle end too.
SETTLED, LONG = 1e-3, 500
#: Prior mean of the skip potential between equal labels; data may move it.
CONSISTENCY = 5.0
DIGIT = re.compile(r"[0-9]")
ACTIVE = re.compile(r"[0-9@]")
SPACE = re.compile(r"\s")
WORD_BUCKETS = 128
LABELS = 1 + len(KINDS)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str):
    """Leftmost matches of the email pattern in linear time: each ``@`` is tried once.

    A match can only begin at the first of the local characters that lead up to its ``@``,
    as any later beginning would meet the same domain.
    """
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at) if start < at else None
        if found:
            end = found.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base spans, in order."""
    out = []
    if "@" in text:
        out += [(a, 0, b) for a, b in emails(text)]
    if DIGIT.search(text):
        for m in IP.finditer(text):
            parts = [p.lstrip("0") for p in m.group().split(".")]
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
                out.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m.group().replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= sum(map(str.isdigit, m.group())) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def spelled(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def tokens_of(text: str) -> list[tuple[int, int]]:
    """Bounds of the runs without white space that hold a digit or ``@``, trimmed of marks."""
    out, at = [], 0
    hit = ACTIVE.search(text)
    while hit:
        first = hit.start()
        start = first
        while start > at and not text[start - 1].isspace():
            start -= 1
        stop = SPACE.search(text, first)
        end = at = stop.start() if stop else len(text)
        while start < first and not (text[start].isalnum() or text[start] in "+@_%-."):
            start += 1
        while end > first + 1 and not (text[end - 1].isalnum() or text[end - 1] == "@"):
            end -= 1
        out.append((start, end))
        hit = ACTIVE.search(text, at)
    return out


def bucket(n: int) -> int:
    """0, 1-3, 4-6, 7-8, 9-11, 12-15, 16-19, more."""
    return sum(n > b for b in (0, 3, 6, 8, 11, 15, 19))


class Graph:
    """Tokens, features and edges of several documents."""

    def __init__(self):
        self.features: list[list[int]] = []
        self.labels: list[int] = []
        self.chain: list[tuple[int, int]] = []
        self.skip: list[tuple[int, int]] = []
        #: Edges between observed and other tokens. They depend on labels, so training leaves them out.
        self.match: list[tuple[int, int]] = []
        self.repeats: set[int] = set()  # tokens that repeat an observed one
        self.spans: list[tuple[int, int, int]] = []  # document, start, end

    def add(self, doc: int, text: str, base: list[tuple[int, int, int]]) -> None:
        """Tokens of one document. Links grow with its tokens, not with their square."""
        import zlib

        bounds = tokens_of(text)
        first_node, first_skip = len(self.features), len(self.skip)
        digits = ["".join(c for c in text[a:b] if "0" <= c <= "9") for a, b in bounds]
        joined = [i > 0 and a - bounds[i - 1][1] <= 2 for i, (a, _) in enumerate(bounds)]
        # Runs of neighbouring digit tokens share what their digits amount to together.
        run, runs = [], []
        for i in range(len(bounds)):
            if not joined[i] or len(runs[run[-1]]) > 64:
                runs.append("")
            run.append(len(runs) - 1)
            runs[-1] += digits[i]
        # A short part of a number, such as an area code, stands for the number only with the rest.
        under, parts_only, j = [], set(), 0
        for i, (a, b) in enumerate(bounds):
            while j < len(base) and base[j][2] <= a:
                j += 1
            # Only the few tokens of a number in groups share a span, so none is seen often.
            over, n = [], j
            while n < len(base) and base[n][0] < b:
                if base[n][2] > a:
                    over.append(base[n])
                n += 1
            under.append(1 + min(k for _, k, _ in over) if over else 0)
            if len(digits[i]) < 6 and not any(a <= s and e <= b for s, _, e in over):
                parts_only.add(first_node + i)
        alike = self.whole_numbers(text, bounds, digits, joined, base, first_node)
        places: dict[str, list[int]] = {}
        for i, (a, b) in enumerate(bounds):
            token, n, whole = text[a:b], len(digits[i]), runs[run[i]]
            before = text[max(0, a - 40) : a].split()
            word = before[-1].strip(".,:;()").lower() if before else ""
            parts = token.split(".")
            octets = len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) < 256 for p in parts)
            marks = [
                "@" in token,
                "@" in token and "." in token[token.find("@") :],
                token[:1] == "+",
                "-" in token,
                any(c.isalpha() for c in token),
                octets,
                12 <= n <= 19 and luhn(digits[i]),
                12 <= len(whole) <= 19 and luhn(whole),
                joined[i],
                i + 1 < len(bounds) and joined[i + 1],
                "/" in token or ":" in token,
            ]
            self.features.append(
                [0, 1 + bucket(n), 9 + bucket(len(whole)), 17 + min(len(parts), 5), 23 + zlib.crc32(word.encode("utf-8", "replace")) % WORD_BUCKETS]
                + [23 + WORD_BUCKETS + k for k, on in enumerate(marks) if on]
            )
            self.labels.append(under[i])
            self.spans.append((doc, a, b))
            node = first_node + i
            if joined[i]:
                self.chain.append((node - 1, node))
            # Alike: the same digits whatever the separators, or the same token whatever its case.
            keys = {token.lower()}
            if n >= 6 and "@" not in token:
                keys.add("#" + digits[i])
            for key in keys:
                places.setdefault(key, []).append(node)
        links = set()
        for nodes in places.values():
            self.skip += zip(nodes, nodes[1:])
            links.update(self.nearest_observed(nodes, parts_only))
        for nodes in alike:
            links.update(self.nearest_observed(nodes))
        self.repeats.update(n for link in links for n in link if not self.labels[n])
        self.match += sorted(links.difference(self.skip[first_skip:]))

    def whole_numbers(self, text, bounds, digits, joined, base, first_node) -> list[list[int]]:
        """Tokens, ascending, of each number that a base span holds, in all its spellings.

        A span stands for the digits of all its tokens together, and so does every sequence
        of joined tokens that amounts to these digits, alone or among other numbers. Of
        phones, 00 may stand for +.
        """
        spans: dict[str, list[int]] = {}
        j = 0
        for start, kind, end in base:
            number = "".join(c for c in text[start:end] if "0" <= c <= "9")
            while j < len(bounds) and bounds[j][1] <= start:
                j += 1
            # Longer ones are addresses with leading zeros: single tokens, alike by their digits.
            if kind == 0 or not 6 <= len(number) <= 19:
                continue
            own = range(j, next((i for i in range(j, len(bounds)) if bounds[i][0] >= end), len(bounds)))
            for key in (number, "00" + number) if kind == 3 else (number,):
                spans.setdefault(key, []).extend(first_node + i for i in own)
        if not spans:
            return []
        lengths = {len(s) for s in spans}
        most = max(lengths)
        for i in range(len(bounds)):
            number, k = "", i
            while k < len(bounds) and digits[k] and (k == i or joined[k]) and "@" not in text[slice(*bounds[k])]:
                number += digits[k]
                if len(number) > most:
                    break
                if len(number) in lengths and number in spans:
                    spans[number].extend(first_node + n for n in range(i, k + 1))
                k += 1
        return [sorted(set(nodes)) for nodes in spans.values()]

    def nearest_observed(self, nodes: list[int], without=frozenset()):
        """A pair, in order, of each unobserved one of ``nodes`` (ascending) and the nearest
        observed one not in ``without``; of two equally far, the earlier."""
        seen = [n for n in nodes if self.labels[n] and n not in without]
        j = 0
        for n in nodes if seen else ():
            if self.labels[n]:
                continue
            while j + 1 < len(seen) and abs(seen[j + 1] - n) < abs(seen[j] - n):
                j += 1
            yield min(n, seen[j]), max(n, seen[j])


N_FEATURES = 23 + WORD_BUCKETS + 11


@dataclass(frozen=True)
class Field:
    nodes: object  # features x labels
    chain: object  # labels x labels, left to right
    skip: object  # labels x labels, symmetric


def design(graph: Graph):
    import numpy as np

    x = np.zeros((len(graph.features), N_FEATURES), np.float32)
    for i, on in enumerate(graph.features):
        x[i, on] = 1
    edges = [np.array(e, np.int64).reshape(-1, 2) for e in (graph.chain, graph.skip)]
    return x, edges[0], edges[1]


def train(graph: Graph, rounds: int = 300, decay: float = 1e-3) -> Field:
    """Pseudo-likelihood by gradient steps with momentum estimates (Adam).

    Weights are drawn to a prior: 0, but in favour of equal labels across skip edges, since
    a sample may hold few repeats."""
    import numpy as np

    x, chain, skip = design(graph)
    y = np.eye(LABELS)[np.array(graph.labels, np.int64)]
    # Tokens that spell a match in another way are no examples of tokens without a label.
    unsure = np.array(sorted(graph.repeats), np.int64)
    y[unsure] = 0
    left, right, like = np.zeros((3, len(x), LABELS))
    np.add.at(right, chain[:, 0], y[chain[:, 1]])
    np.add.at(left, chain[:, 1], y[chain[:, 0]])
    np.add.at(like, skip[:, 0], y[skip[:, 1]])
    np.add.at(like, skip[:, 1], y[skip[:, 0]])
    prior = [np.zeros((N_FEATURES, LABELS)), np.zeros((LABELS, LABELS)), CONSISTENCY * np.eye(LABELS)]
    w = [p.copy() for p in prior]
    first, second = [0.0] * 3, [0.0] * 3
    n = max(len(x) - len(unsure), 1)
    for t in range(1, rounds + 1):
        z = x @ w[0] + left @ w[1] + right @ w[1].T + like @ w[2]
        z -= z.max(1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(1, keepdims=True)
        d = (p - y) / n
        d[unsure] = 0
        g = [x.T @ d, left.T @ d + (right.T @ d).T, like.T @ d]
        g[2] = (g[2] + g[2].T) / 2
        for k in range(3):
            g[k] = g[k] + decay * (w[k] - prior[k])
            first[k] = 0.9 * first[k] + 0.1 * g[k]
            second[k] = 0.99 * second[k] + 0.01 * g[k] ** 2
            w[k] = w[k] - 0.1 * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.99**t)) + 1e-8)
    return Field(*w)


def beliefs(graph: Graph, field: Field):
    """Label marginals by loopy sum-product; tokens under base spans are observed.

    Messages are sent until none changes; those whose source no longer changes rest."""
    import numpy as np

    x, chain, skip = design(graph)
    skip = np.concatenate([skip, np.array(graph.match, np.int64).reshape(-1, 2)])
    score = x @ field.nodes
    seen = np.array(graph.labels, np.int64)
    observed = np.flatnonzero(seen > 0)
    score[observed] = -1e4
    score[observed, seen[observed]] = 0.0
    # Both directions of every edge: from, to, potential[from label, to label].
    source = np.concatenate([chain[:, 0], chain[:, 1], skip[:, 0], skip[:, 1]])
    target = np.concatenate([chain[:, 1], chain[:, 0], skip[:, 1], skip[:, 0]])
    table = np.stack([field.chain, field.chain.T, (field.skip + field.skip.T) / 2])
    kind = np.repeat([0, 1, 2], [len(chain), len(chain), 2 * len(skip)])
    back = np.concatenate(
        [np.arange(len(chain)) + len(chain), np.arange(len(chain)),
         np.arange(len(skip)) + 2 * len(chain) + len(skip), np.arange(len(skip)) + 2 * len(chain)]
    ).astype(np.int64)
    message = np.zeros((len(source), LABELS))
    total = score.astype(np.float64)
    # What observed tokens are sent changes nothing.
    useful = seen[target] == 0
    active, step, turn = np.flatnonzero(useful), 0.5, 0
    while len(active):
        sent = (total[source[active]] - message[back[active]])[:, :, None] + table[kind[active]]
        top = sent.max(1, keepdims=True)
        new = np.log(np.exp(sent - top).sum(1)) + top[:, 0, :]
        new -= new.max(1, keepdims=True)
        change = step * (new - message[active])
        message[active] += change
        np.add.at(total, target[active], change)
        moved = active[np.abs(change).max(1) > SETTLED]
        again, ahead = np.zeros(len(source), bool), np.zeros(len(x), bool)
        again[moved] = ahead[target[moved]] = True
        active = np.flatnonzero(useful & (again | ahead[source]))
        turn += 1
        step *= 0.99 if turn > LONG else 1.0
    total -= total.max(1, keepdims=True)
    p = np.exp(total)
    return p / p.sum(1, keepdims=True)


def added_spans(graph: Graph, marginals, sure: float) -> dict[int, list[tuple[int, int, int]]]:
    """Runs of adjacent tokens labelled alike with enough certainty, by document."""
    out: dict[int, list] = {}
    joined = {b for _, b in graph.chain}
    best = marginals.argmax(1)
    previous = (None, 0)
    for i, (doc, a, b) in enumerate(graph.spans):
        label = int(best[i])
        if graph.labels[i] or not label or marginals[i, label] < sure:
            previous = (None, 0)
            continue
        spans = out.setdefault(doc, [])
        if i in joined and previous == (doc, label):
            spans[-1] = (spans[-1][0], label - 1, b)
        else:
            spans.append((a, label - 1, b))
        previous = (doc, label)
    return out


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = SAMPLE_DOCS) -> Field:
    """Field trained on at most ``most`` documents with a digit or ``@``, least id hash first.

    Without any such document all weights are 0, and no span is ever added.
    """
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).filter(F.col("text").rlike("[0-9@]"))

    def graphs(batches):
        import pickle

        import pyarrow as pa

        for batch in batches:
            graph = Graph()
            for i, text in enumerate(batch.column(0).to_pylist()):
                graph.add(i, text, base_spans(text))
            yield pa.RecordBatch.from_pydict({"graph": [pickle.dumps((graph.features, graph.labels, graph.chain, graph.skip, sorted(graph.repeats)))]})

    import pickle

    # Hashes alone are sorted; only the texts below the bound so found are fetched.
    hashed = rows.select("text", F.xxhash64("id", "text").alias("hash"))
    lowest = hashed.select("hash").orderBy("hash").limit(most).agg(F.max("hash")).first()[0]
    picked = hashed.filter(F.col("hash") <= F.lit(lowest).cast("long")).limit(most).select("text")
    whole = Graph()
    for row in sorted(bytes(r.graph) for r in picked.mapInArrow(graphs, "graph binary").collect()):
        features, labels, chain, skip, repeats = pickle.loads(row)
        n = len(whole.features)
        whole.features += features
        whole.labels += labels
        whole.chain += [(a + n, b + n) for a, b in chain]
        whole.skip += [(a + n, b + n) for a, b in skip]
        whole.repeats.update(a + n for a in repeats)
    return train(whole)


def find(docs: DataFrame, field: Field, text_col: str = "text", out_col: str = "found", sure: float = SURE) -> DataFrame:
    """``docs`` with ``out_col``: struct of base and all spans, each an array of (kind, start, end).

    Offsets count code points, ends are exclusive; spans ascend by start, then kind. Base
    spans may overlap across kinds; added spans overlap nothing. Null and empty texts have
    no spans. Rows and columns stay; a column named ``out_col`` is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)
    keep = [f for f in docs.schema.fields if f.name != out_col]
    names, text_name = [f.name for f in keep], fresh(docs, "_text")
    span = "array<struct<kind: string, start: int, end: int>>"
    schema = ", ".join(
        [*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), f"`{out_col}` struct<base: {span}, spans: {span}>"]
    )

    def label(batches):
        import pyarrow as pa

        spans_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

        def column(found):
            return pa.array([[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans] for spans in found], spans_type)

        for block in blocks(batches, text_name, BLOCK_BYTES):
            batch = block.combine_chunks().to_batches()[0]
            texts = batch.column(batch.num_columns - 1).to_pylist()
            graph, base = Graph(), []
            for i, text in enumerate(texts):
                base.append(base_spans(text))
                if ACTIVE.search(text):
                    graph.add(i, text, base[-1])
            every = base
            if graph.features:
                more = added_spans(graph, beliefs(graph, shared.value), sure)
                every = [sorted(spans + more[i]) if i in more else spans for i, spans in enumerate(base)]
            found = pa.StructArray.from_arrays([column(base), column(every)], names=["base", "spans"])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], found], names=[*names, out_col])

    return docs.select(*[f"`{n}`" for n in names], text_of(text_col).alias(text_name)).mapInArrow(label, schema)


def redact(docs: DataFrame, field: Field, text_col: str = "text", sure: float = SURE) -> DataFrame:
    """``docs`` with every span of its text replaced by its kind in brackets; overlapping
    spans become one, named by the first. Null texts stay null."""
    shared = docs.sparkSession.sparkContext.broadcast(field)
    names = docs.columns
    at = names.index(text_col)

    def replace(batches):
        import pyarrow as pa

        for block in blocks(batches, text_col, BLOCK_BYTES):
            batch = block.combine_chunks().to_batches()[0]
            texts = batch.column(at).to_pylist()
            graph, base = Graph(), []
            for i, text in enumerate(texts):
                base.append(base_spans(text or ""))
                if text and ACTIVE.search(text):
                    graph.add(i, text, base[-1])
            more = added_spans(graph, beliefs(graph, shared.value), sure) if graph.features else {}
            for i, text in enumerate(texts):
                spans, parts, done = sorted(base[i] + more.get(i, [])), [], 0
                for a, k, b in spans:
                    if a >= done:
                        parts += [text[done:a], f"[{KINDS[k].upper()}]"]
                    done = max(done, b)
                if spans:
                    texts[i] = "".join(parts) + text[done:]
            columns = list(batch.columns)
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(replace, docs.schema)


@query()
def op3_personal(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data in all documents."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = find(docs, fit(docs))

    def listed(spans: str):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str):
        return F.size(F.filter("found.base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *[count(k) for k in KINDS], F.sha2(listed("found.base").cast("binary"), 256).alias("base_sha256"),
        listed("found.spans").alias("spans"),
    )
