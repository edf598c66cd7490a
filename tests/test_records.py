"""Scan, decode, rules and repair on hand-made records."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators import repair, rules
from tidemark.sources import jsonl

from .records import good, write


@pytest.fixture(scope="module")
def scanned(spark, tmp_path_factory):
    path = write(
        tmp_path_factory.mktemp("in") / "data",
        {
            "02_b.jsonl": ["", "   ", "```json", good(5), "[1]", "7", "{bad"],
            "01_a.jsonl": [good(1), "", good(2, id=...), good(3, title=None), '{"a":1,"a":2}'],
            "notes.txt": ["not read"],
        },
    )
    return jsonl.read_records(spark, path)


def test_scan_numbers_and_quarantine(scanned):
    bad = {(r.source_file, r.line_num): r.reason for r in scanned.quarantine.collect()}
    assert bad == {
        ("02_b.jsonl", 3): "fence", ("02_b.jsonl", 5): "not_object",
        ("02_b.jsonl", 6): "not_object", ("02_b.jsonl", 7): "json",
    }
    kept = sorted((r.source_file, r.line_num, r.pos) for r in scanned.records.collect())
    assert kept == [
        ("01_a.jsonl", 1, 1), ("01_a.jsonl", 3, 3), ("01_a.jsonl", 4, 4), ("01_a.jsonl", 5, 5),
        ("02_b.jsonl", 4, 9),
    ]


def test_last_repeated_key_wins(scanned):
    row = scanned.records.filter("line_num = 5").select(F.expr("variant_get(rec, '$.a', 'int')")).first()
    assert row[0] == 2


def test_scan_many_splits(spark, tmp_path):
    path = write(tmp_path / "data", {f"{i:02d}.jsonl": [f"{i} {k} {'x' * (k % 37)}" for k in range(3000)] for i in range(3)})
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        got = jsonl.scan_lines(spark, path).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(got) == 9000
    for r in got:
        i, k = r.value.split()[:2]
        assert (r.line_num, r.pos) == (int(k) + 1, int(i) * 3000 + int(k) + 1)


def test_empty_input(spark, tmp_path):
    with pytest.raises(jsonl.EmptyInputError):
        jsonl.scan_lines(spark, str(tmp_path / "absent"))
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "x.txt").write_text("x")
    with pytest.raises(jsonl.EmptyInputError):
        jsonl.scan_lines(spark, str(tmp_path / "e"))


def broken(spark, tmp_path, *records):
    path = write(tmp_path / "data", {"f.jsonl": list(records)})
    found = rules.check_records(jsonl.read_records(spark, path).records).collect()
    out = {}
    for r in found:
        out.setdefault(r.line_num, set()).add((r.kind[:1], r.rule, r.field))
    return out, found


def test_rules(spark, tmp_path):
    q = good()["quality"]
    out, found = broken(
        spark, tmp_path,
        good(1),
        good(2, audience=..., batch=..., id="x"),
        good(3, title=None),
        good(4, quality={**q, "specificity_score": 8.0}),
        good(5, quality={**q, "specificity_score": "8", "originality_score": True}),
        good(6, quality={"specificity_score": 11}),
        good(7, prompt="short text", tags=["a"], acceptance_criteria=["x" * 10] * 7),
        good(8, category="shop", style="plain", tags=["Bad Tag", "b", "c", "d", "e"]),
        good(9, prompt="w " * 221, negative_prompt="w " * 61, id="PRM-1"),
        good(10, website_card={"headline": "abc"}),
    )
    d = lambda *x: {("d", *y) for y in x}
    i = lambda *x: {("i", *y) for y in x}
    assert 1 not in out
    assert out[2] == i(("missing_field", "audience"), ("missing_field", "batch")) | d(("pattern", "id"))
    assert out[3] == d(("type", "title"))
    score = ("invalid_score", "quality.specificity_score")
    assert out[4] == i(score) | d(("type", "quality.specificity_score"))
    assert out[5] == i(score, ("invalid_score", "quality.originality_score")) | d(
        ("type", "quality.specificity_score"), ("type", "quality.originality_score"))
    assert out[6] == i(score, *[("missing_key", f"quality.{k}") for k in
                                ("originality_score", "implementation_clarity_score", "website_readiness_score")])
    assert out[7] == i(("too_short", "prompt"), ("too_few", "tags"), ("too_many", "acceptance_criteria")) | d(
        ("min_length", "prompt"))
    assert out[8] == i(("invalid_value", "category"), ("invalid_type", "style")) | d(
        ("type", "style"), ("item_pattern", "tags"))
    assert out[9] == i(("too_long", "prompt"), ("too_long", "negative_prompt"), ("invalid_id", "id")) | d(("pattern", "id"))
    assert out[10] == i(*[("missing_key", f"website_card.{k}") for k in ("summary", "preview_label", "search_keywords")]) | d(
        ("min_length", "website_card.headline"))
    text = {(r.line_num, r.rule, r.field): r.detail for r in found}
    assert text[7, "too_short", "prompt"] == "Prompt too short: 2 words (min 80)"
    assert text[2, "missing_field", "batch"] == "Missing required field: 'batch'"
    assert text[8, "invalid_value", "category"] == "Invalid category: 'shop'"
    assert text[6, "invalid_score", "quality.specificity_score"] == (
        "Invalid quality score for 'specificity_score': 11")


def test_valid_flag_matches_violations(spark, scanned):
    flagged = {(r.source_file, r.line_num): r.valid for r in rules.flag_valid(scanned.records).collect()}
    bad = {(r.source_file, r.line_num) for r in rules.check_records(scanned.records).collect() if r.kind == "imperative"}
    assert {k for k, ok in flagged.items() if not ok} == bad


def repaired(spark, tmp_path, *records):
    path = write(tmp_path / "data", {"f.jsonl": list(records)})
    rows = repair.repair_records(jsonl.read_records(spark, path).records).orderBy("pos").collect()
    return rows


def test_repair(spark, tmp_path):
    rows = repaired(
        spark, tmp_path,
        good(1),
        good(2, difficulty="hard", language="fr", category="shop", audience="tutor", use_case="dashboard_ui"),
        good(3, difficulty="weird", style="plain", quality={
            "specificity_score": 11, "originality_score": 8.0, "implementation_clarity_score": 7}),
        good(4, acceptance_criteria=["Only one given"], tags=["UI Kit", "Dark_Mode"], difficulty="easy"),
        good(5, acceptance_criteria=[f"criterion {i}" for i in range(7)], tags=["A", "a", "b", "c", "d"]),
        good(6, prompt=" ".join(["w"] * 40), negative_prompt="", version="", industry=0, batch=None),
        good(7, prompt="\t".join(f"w{i}" for i in range(221)), negative_prompt=" ".join(["n"] * 61)),
        good(8, title=..., slug=..., tags="none", style={}),
        good(9, slug="nav-bar-1x", title="A navigation bar number 1", note="kept"),
        good(10, tags=["!!!", "??", "+", "*", "#"], subcategory=..., created_by_agent=...),
    )
    a = dict(enumerate(rows, 1))
    assert a[1].repairs == [] and a[1].title == "A navigation bar number 1"
    assert (a[2].difficulty, a[2].language, a[2].category, a[2].audience, a[2].use_case) == (
        "advanced", "en", "ecommerce", "teacher", "dashboard_generation")
    assert a[3].difficulty == "intermediate" and a[3].style.layout_style == "responsive grid layout"
    assert tuple(a[3].quality) == (8, 8, 7, 9)
    assert set(a[3].repairs) == {"difficulty", "style", "quality"}
    assert a[4].acceptance_criteria == [
        "Only one given", "Layout is responsive across all screen sizes",
        "Design matches the specified visual style and color direction"]
    assert a[4].tags == ["ui-kit", "dark-mode", "ui-components", "nav-bars", "beginner", "react", "tailwind"]
    assert len(a[5].acceptance_criteria) == 6 and a[5].tags == ["a", "a", "b", "c", "d"]
    assert len(a[6].prompt.split()) == 71 and a[6].negative_prompt.startswith("Avoid generic")
    assert (a[6].version, a[6].industry, a[6].batch) == ("1.0.0", "saas", "ui_components_001")
    assert a[7].prompt == " ".join(f"w{i}" for i in range(220)) and len(a[7].negative_prompt.split()) == 60
    assert a[8].title == "Untitled Prompt 8" and a[8].slug == "untitled"
    assert a[8].tags == ["ui-components", "nav-bars", "beginner", "react", "tailwind"]
    assert a[9].slug == "nav-bar-1x-1" and a[9].title == "A navigation bar number 1 (2)"
    assert set(a[9].repairs) == {"slug", "title"} and list(a[9].extra) == ["note"]
    assert a[10].tags == ["!!!", "??", "+", "*", "#"] and a[10].subcategory == "general"
    assert a[10].created_by_agent == "ui_components_agent"


def test_repair_counters(spark, scanned):
    got = {r.source_file: (r.total, r.fixed, r.skipped) for r in repair.repair_counters(
        scanned.lines, repair.repair_records(scanned.records)).collect()}
    assert got == {"01_a.jsonl": (4, 2, 0), "02_b.jsonl": (4, 0, 3)}
