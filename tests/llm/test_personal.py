"""Base spans against the patterns themselves, and what the random field adds."""

import random
import re
import time

import numpy as np

from tidemark.llm import personal

PATTERNS = [
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    re.compile(r"[0-9]([\x20-]?[0-9])+"),
    re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def by_patterns(text):
    out = []
    for k, pattern in enumerate(PATTERNS):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m.group())
            fine = [
                True,
                k != 1 or all(int(p) <= 255 for p in m.group().split(".")),
                k != 2 or 12 <= len(digits) <= 19 and personal.luhn(digits),
                k != 3 or 9 <= len(digits) <= 15,
            ]
            if all(fine):
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_equal_patterns():
    rng = random.Random(2)
    pieces = [
        "a@b.c", "x.y@z-1.de.fr@q.r", "@@", "@", "a@b", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112",
        "+49 (30) 123-456-78", "+1", "++12.34", "5500005555555559", " ", "é", ".", "-", "0", "12", "٣", "000.000.01.255", "+1 202 555 0123 45 67 89 11",
    ]
    for _ in range(4000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(1, 9)))
        assert personal.base_spans(text) == by_patterns(text), text


def test_long_texts_take_linear_time():
    start = time.time()
    for unit in ("a", "1", "1.", "@", "+1", "a@", "1 ", "+1((("):
        personal.base_spans(unit * 100_000)
        graph = personal.Graph()
        graph.add(0, unit * 100_000, [])
    assert time.time() - start < 20


def corpus():
    rng = random.Random(4)
    rows = []
    for i in range(300):
        words = [rng.choice("alpha beta gamma delta".split()) for _ in range(30)]
        card = "4" + "".join(rng.choice("0123456789") for _ in range(14))
        card += next(d for d in "0123456789" if personal.luhn(card + d))
        some = [f"mail me{i}@site{i % 9}.example.org", f"host 10.{i % 256}.3.{i % 200}", f"card {card}", f"call +49 30 {1000000 + i}", f"order {i} of 2024", "room 12"]
        for s in rng.sample(some, 4):
            words.insert(rng.randrange(len(words)), s)
        rows.append((i, " ".join(words), "x", 1))
    card = "4111111111111111"
    rows.append((1000, f"card {card} beta gamma delta alpha {' '.join('word' for _ in range(50))} 4111.1111.1111.1111 beta", "x", 1))
    rows.append((1001, "nothing to see in 2024, room 12, page 7 of 300, chapter 1.2", "x", 1))
    rows += [(1002, None, "x", 1), (1003, "", "x", 1), (None, "me@a.bc " * 3000, "x", 1), (1004, "same 10.0.0.1", "x", 1), (1004, "same 10.0.0.1", "x", 1)]
    return rows


def test_field_labels_look_alikes_and_keeps_base_spans(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, found string, spans int")
    field = personal.fit(docs)
    out = personal.find(docs, field)
    assert out.columns == ["doc_id", "text", "spans", "found"]
    got = {(r.doc_id, r.text): r.found for r in out.collect()}
    for i, text, *_ in rows:
        found = got[(i, text)]
        base = [(s.start, personal.KINDS.index(s.kind), s.end) for s in found.base]
        every = [(s.start, personal.KINDS.index(s.kind), s.end) for s in found.spans]
        assert base == by_patterns(text or "")
        assert every == sorted(every) and set(base) <= set(every)
    text = next(t for i, t, *_ in rows if i == 1000)
    added = [text[s.start : s.end] for s in got[(1000, text)].spans if (s.start, s.end) not in {(b.start, b.end) for b in got[(1000, text)].base}]
    assert added == ["4111.1111.1111.1111"]
    assert got[(1001, rows[-8][1] if rows[-8][0] == 1001 else next(t for i, t, *_ in rows if i == 1001))].spans == []
    hidden = {r.doc_id: r.text for r in personal.redact(docs, field).collect()}
    assert "4111" not in hidden[1000] and "[CARD]" in hidden[1000]
    assert hidden[1002] is None and hidden[1003] == "" and hidden[1004] == "same [IP]"
    assert hidden[1001] == next(t for i, t, *_ in rows if i == 1001)


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "plain words"), (2, None)], "doc_id long, text string")
    field = personal.fit(docs)
    assert all(r.found.spans == [] for r in personal.find(docs, field).collect())
    none = spark.createDataFrame([], "doc_id long, text string")
    assert personal.find(none, personal.fit(none)).collect() == []


def neutral():
    import numpy as np

    return personal.Field(np.zeros((personal.N_FEATURES, personal.LABELS)), np.zeros((personal.LABELS, personal.LABELS)), personal.CONSISTENCY * np.eye(personal.LABELS))


def added(text, field):
    graph, base = personal.Graph(), personal.base_spans(text)
    graph.add(0, text, base)
    return [(text[a:b], personal.KINDS[k]) for a, k, b in personal.added_spans(graph, personal.beliefs(graph, field), personal.SURE).get(0, [])]


def test_labels_reach_all_repeats():
    filler = " plain words between them "
    for other, match in (("4111.1111.1111.1111", "4111111111111111"), ("4930/1234567", "+49301234567"), ("49.301234567", "+49-301234567")):
        if personal.base_spans(other):
            continue
        text = filler.join([other] * 50 + [match] + [other] * 50)
        assert len(personal.base_spans(text)) == 1
        kind = personal.KINDS[personal.base_spans(text)[0][1]]
        assert added(text, neutral()) == [(other, kind)] * 100
    assert added(filler.join(["4111.1111.1111.1111"] * 50), neutral()) == []


def test_many_repeats_settle():
    text = " and then ".join(["4111.1111.1111.1111", "4111111111111111", "x 12 y 13", "7.11"] * 5000)
    start = time.time()
    found = added(text, neutral())
    assert [f for f in found if f[0] == "4111.1111.1111.1111"] == [("4111.1111.1111.1111", "card")] * 5000
    assert time.time() - start < 60


CARDS = ["4111111111111111", "4111 1111 1111 1111", "4111-1111-1111-1111", "4111.1111.1111.1111", "4111/1111/1111/1111", "4111  1111  1111  1111", "4111. 1111. 1111. 1111"]
PHONES = ["+49 30 1234567", "+49301234567", "+49-30-1234567", "0049/30/1234567", "0049 30 1234567", "0049301234567", "49 30/1234567", "+49/30/1234567", "(0049) 30.1234567"]


def test_numbers_in_groups_equal_other_spellings():
    filler = " plain words between them "
    tried = 0
    for spellings, kind in ((CARDS, "card"), (PHONES, "phone")):
        for match in spellings:
            for other in spellings:
                if not personal.base_spans(match) or personal.base_spans(other):
                    continue
                for text in (match + filler + other, other + filler + match, f"{match}{filler}7 {other} 12", f"{other} 5{filler}{match}"):
                    base = personal.base_spans(text)
                    if [k for _, k, _ in base] != [personal.KINDS.index(kind)]:
                        continue
                    got = added(text, neutral())
                    tried += 1
                    assert {k for _, k in got} == {kind}, (text, got)
                    assert [c for t, _ in got for c in t if c.isdigit()] == [c for c in other if c.isdigit()], (text, got)
    assert tried > 80
    assert added(f"4111 1111 1111 1111{filler}1111 4111 1111 1112{filler}5.2", personal.Field(neutral().nodes, neutral().chain, 0 * neutral().skip)) == []


def test_groups_are_labelled_by_the_trained_field(spark):
    rows = [(i, t) for i, t, *_ in corpus() if i is not None and i < 1000]
    filler = " ".join(["word"] * 50)
    pairs = [("4111 1111 1111 1111", "4111.1111.1111.1111"), ("4111111111111111", "4111  1111  1111  1111"), ("+49 30 1234567", "0049/30/1234567"), ("+49-30-1234567", "0049 30 1234567")]
    rows += [(1000 + i, f"beta {a} gamma {filler} {b} beta") for i, (a, b) in enumerate(pairs)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    hidden = {r.doc_id: r.text for r in personal.redact(docs, personal.fit(docs)).collect()}
    for i in range(len(pairs)):
        assert not any(c.isdigit() for c in hidden[1000 + i]), hidden[1000 + i]


def test_short_parts_of_a_number_are_no_repeats():
    graph, text = personal.Graph(), "+49 30 1234567 then words 30 then words 30 then words 49301234567"
    graph.add(0, text, personal.base_spans(text))
    assert [text[slice(*graph.spans[n][1:])] for n in sorted(graph.repeats)] == ["49301234567"]


def test_every_base_span_of_a_token_counts():
    for n in (1, 3, 4, 9):
        text = "1.2.3.4;" * n + "a@b.co"
        graph = personal.Graph()
        graph.add(0, text, personal.base_spans(text))
        assert graph.labels == [1]


def enumerated(score, edges):
    """Exact marginals: all labellings, weighed by node scores and tables of edges."""
    n, k = score.shape
    every = np.indices((k,) * n).reshape(n, -1)
    weight = sum(score[i][every[i]] for i in range(n))
    for i, j, table in edges:
        weight = weight + table[every[i], every[j]]
    p = np.exp(weight - weight.max())
    return np.array([[p[every[i] == x].sum() for x in range(k)] for i in range(n)]) / p.sum()


def test_beliefs_against_all_labellings():
    """Exact where links make no loop; close where they do."""
    rng = np.random.RandomState(9)
    for case in range(24):
        n, loops = rng.randint(2, 7), case % 3 == 2
        graph = personal.Graph()
        graph.features = [sorted(rng.choice(personal.N_FEATURES, 4, replace=False).tolist()) for _ in range(n)]
        graph.labels = [int(rng.randint(1, personal.LABELS)) if rng.rand() < 0.25 else 0 for _ in range(n)]
        graph.labels[0] = 0
        for j in range(1, n):  # a tree, of chain and skip edges
            i = int(rng.randint(0, j))
            (graph.chain if i == j - 1 else graph.skip if rng.rand() < 0.5 else graph.match).append((i, j))
        if loops and n > 2:
            graph.skip.append((0, n - 1))
        scale = 0.5 if loops else 1.5
        skip = rng.standard_normal((personal.LABELS, personal.LABELS)) * scale
        field = personal.Field(
            rng.standard_normal((personal.N_FEATURES, personal.LABELS)),
            rng.standard_normal((personal.LABELS, personal.LABELS)) * scale,
            skip + skip.T,
        )
        score = personal.design(graph)[0].astype(float) @ field.nodes
        for i, label in enumerate(graph.labels):
            if label:
                score[i] = np.where(np.arange(personal.LABELS) == label, 0.0, -1e4)
        edges = [(i, j, field.chain) for i, j in graph.chain] + [(i, j, skip + skip.T) for i, j in graph.skip + graph.match]
        want, got = enumerated(score, edges), personal.beliefs(graph, field)
        hidden = [i for i in range(n) if not graph.labels[i]]
        assert np.abs(want[hidden] - got[hidden]).max() < (0.15 if loops else 2e-3), case
