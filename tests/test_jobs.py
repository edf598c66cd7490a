"""The four jobs and the streams, end to end on small folders."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators import lookups, index as idx, search
from tidemark.plans import cleanup, dedupe, publish, validate
from tidemark.sources import jsonl, manifest
from tidemark.streaming import ingest

from .records import good, write


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    records = [good(i, category="ecommerce" if i % 3 else "ui_components", difficulty="expert" if i % 2 else "beginner") for i in range(1, 41)]
    records[4]["slug"] = records[3]["slug"]
    records[6]["title"] = records[5]["title"]
    records[7]["prompt"] = records[6]["prompt"]
    return write(
        tmp_path_factory.mktemp("in") / "data",
        {"01.jsonl": records[:20], "02.jsonl": [*records[20:], "{bad", "```"]},
    )


def test_validate_job(spark, folder, tmp_path):
    out = str(tmp_path / "report")
    assert validate.run(spark, folder, out) is False
    s = spark.read.json(f"{out}/summary").first()
    assert (s.total_prompts, s.total_categories, s.invalid_lines) == (40, 2, 2)
    assert (s.duplicate_ids, s.duplicate_slugs, s.duplicate_titles, s.overall_result) == (0, 1, 1, "FAIL")
    assert (s.category_counts.ecommerce, s.category_counts.ui_components) == (27, 13)
    errors = [r.value for r in spark.read.text(f"{out}/errors").collect()]
    assert "[01.jsonl:5] Duplicate slug: 'nav-bar-4x' (first seen in 01.jsonl:4)" in errors
    assert "[02.jsonl:22] Markdown code block detected" in errors
    files = {r.source_file: (r.lines, r.valid, r.invalid) for r in spark.read.json(f"{out}/files").collect()}
    assert files == {"01.jsonl": (20, 20, 0), "02.jsonl": (22, 20, 2)}


def test_gate_can_pass(spark, folder):
    decoded = jsonl.read_records(spark, folder)
    gate = validate.validate(decoded, min_total=40, min_categories=2, min_per_category=13).gate.first()
    assert gate.total_ok and gate.categories_ok and gate.per_category_ok and not gate.keys_ok
    assert gate.overused_openings == 0


def test_dedupe_job(spark, folder, tmp_path):
    out = str(tmp_path / "dups")
    assert dedupe.run(spark, folder, out) == "NEEDS_REVIEW"
    s = spark.read.json(f"{out}/summary").first()
    # Digits and stopwords do not count, so all prompts share one fingerprint.
    assert (s.fingerprint, s.title, s.slug, s.first_sentence, s.openings) == (1, 1, 1, 1, 0)
    assert s.key_status == "NEEDS_REVIEW"
    assert s.total_analysed == 40
    slugs = spark.read.json(f"{out}/slugs").collect()
    assert sorted((r.slug, r.occurrences, r.nth, r.id) for r in slugs) == [
        ("nav-bar-4x", 2, 1, "PRM-000004"), ("nav-bar-4x", 2, 2, "PRM-000005")]
    prints = spark.read.json(f"{out}/fingerprints").collect()
    assert sorted((r.nth, r.occurrences, len(r.hash)) for r in prints) == [(k, 40, 16) for k in range(1, 41)]
    members = spark.read.parquet(f"{out}/members/slug")
    assert sorted(r.id for r in members.collect()) == ["PRM-000004", "PRM-000005"]
    # 13 and 27 rows: all pairs within a category are closer than the window.
    assert spark.read.parquet(f"{out}/pairs").count() == 13 * 12 // 2 + 27 * 26 // 2


def test_cleanup_job(spark, folder, tmp_path):
    out = str(tmp_path / "clean")
    cleanup.run(spark, folder, out)
    counters = {r.source_file: (r.total, r.fixed, r.skipped) for r in spark.read.json(f"{out}/counters").collect()}
    assert counters == {"01.jsonl": (20, 2, 0), "02.jsonl": (21, 0, 1)}
    parts = sorted((tmp_path / "clean" / "data" / "source_file=01.jsonl").glob("part-*"))
    again = [json.loads(line) for p in parts for line in p.read_text(encoding="utf-8").splitlines()]
    assert [r["id"] for r in again] == [f"PRM-{i:06d}" for i in range(1, 21)]
    assert again[4]["slug"] == "nav-bar-4x-1" and again[6]["title"] == "A navigation bar number 6 (2)"
    assert again[0] == good(1, category="ecommerce", difficulty="expert")


def test_jobs_follow_each_other(spark, folder, tmp_path):
    """What cleanup writes is input for the other jobs, under the same file names."""
    clean = str(tmp_path / "clean")
    cleanup.run(spark, folder, clean)
    lines = jsonl.scan_lines(spark, f"{clean}/data").orderBy("pos").collect()
    assert [(r.source_file, r.line_num, r.pos) for r in lines] == [
        (f"{1 + i // 20:02d}.jsonl", i % 20 + 1, i + 1) for i in range(40)
    ]
    assert [json.loads(r.value)["id"] for r in lines] == [f"PRM-{i:06d}" for i in range(1, 41)]
    out = str(tmp_path / "report")
    validate.run(spark, f"{clean}/data", out)
    s = spark.read.json(f"{out}/summary").first()
    assert (s.total_prompts, s.invalid_lines, s.duplicate_slugs, s.duplicate_titles) == (40, 0, 0, 0)
    dedupe.run(spark, f"{clean}/data", str(tmp_path / "dups"))
    s = spark.read.json(str(tmp_path / "dups/summary")).first()
    assert (s.title, s.slug) == (0, 0)
    publish.run(spark, f"{clean}/data", str(tmp_path / "site"))
    assert spark.read.parquet(str(tmp_path / "site/index")).count() == 40
    profiles = {r.category: r for r in spark.read.json(str(tmp_path / "site/profile")).collect()}
    assert profiles["ecommerce"].n == 27 and profiles["ecommerce"].difficulty_distribution.expert in (13, 14)
    made = spark.read.json(str(tmp_path / "site/manifest")).first()
    assert made.total_prompts == 40 and {(c["category"], c["count"]) for c in made.categories} == {("ecommerce", 27), ("ui_components", 13)}


def test_publish_search_and_lookup(spark, folder, tmp_path):
    out = str(tmp_path / "site")
    publish.run(spark, folder, out)
    whole = spark.read.parquet(f"{out}/index")
    first = whole.orderBy("pos").first()
    wanted = search.Query(first.t[:8])
    assert lookups.search_text(spark, f"{out}/text", wanted).count() == search.matching(whole, wanted).count() > 0
    assert lookups.look_up(spark, f"{out}/lookup", first.id).first().pos == first.pos
    page = lookups.ranked_page(spark, f"{out}/ranks", "az").orderBy("rank")
    assert [r.pos for r in page.collect()] == [r.pos for r in search.page(whole, "az").collect()]
    index = spark.read.parquet(f"{out}/index")
    assert index.count() == 40
    q = search.Query("  Navigation bar number 1 ", {"category": "ecommerce", "difficulty": None})
    rows, n = search.search(index, q, size=3)
    want = [1, 10, 11, 13, 14, 16, 17, 19]
    assert [r.id for r in rows.collect()] == [f"PRM-{i:06d}" for i in want[:3]]
    assert n.first().n == len(want)
    records = spark.read.parquet(f"{out}/records")
    hit = search.find_record(index, records, "PRM-000009")
    assert hit.first().title == "A navigation bar number 9"
    plan = hit._jdf.queryExecution().toString()
    assert "dynamicpruning" in plan.lower()
    stats = spark.read.json(f"{out}/stats").first()
    assert (stats.total, stats.distinct_frameworks, stats.avg_website_readiness) == (40, 1, 10.0)
    meta = [(r.key, r.n, r.label) for r in spark.read.json(f"{out}/meta").collect()]
    assert meta == [("ecommerce", 27, "E-Commerce"), ("ui_components", 13, "UI Components")]
    header = spark.read.json(f"{out}/flat/meta").first()
    assert (header.total_items, header.source_files) == (40, 2)
    card = idx.card_items(index, idx.category_dimension(spark), idx.difficulty_dimension(spark)).orderBy("pos").first()
    assert (card.category_label, card.difficulty_label, card.tags, card.score) == (
        "E-Commerce", "Expert", ["Nav", "Bar", "Menu"], "10.0")
    detail = idx.detail_items(records, index).orderBy("pos").first()
    assert detail.chips == ["Vue", "TypeScript", "CSS", "GSAP", "x"] and detail.style[2].name == "Farben"


def test_query_object():
    q = search.Query().toggle("category", "ecommerce").toggle("language", "en")
    assert q.active == 2 and q.toggle("language", "en").active == 1 and q.cleared().active == 0


def test_manifest(spark, folder, tmp_path):
    body = {
        "dataset_name": "d", "version": "1", "total_prompts": 10, "format": "csv", "schema": "s",
        "categories": [{"category": "ecommerce", "file": "01.jsonl", "count": 27}, {"category": "x", "count": 1000}],
        "created_for": 5, "quality_gates": {"json_valid": "yes", "schema_valid": True, "duplicates_removed": True,
                                            "minimum_total_reached": True},
    }
    path = tmp_path / "manifest.json"
    path.write_text(json.dumps(body, indent=1))
    m = manifest.read_manifest(spark, str(path))
    found = {(r.entry, r.rule, r.field) for r in manifest.check_manifest(m).collect()}
    assert found == {
        (None, "minimum", "total_prompts"), (None, "invalid_value", "format"), (None, "type", "created_for"),
        (None, "type", "quality_gates.json_valid"),
        (None, "missing_field", "quality_gates.minimum_per_category_reached"),
        (0, "minimum", "count"), (1, "missing_field", "file"),
    }
    actual = spark.createDataFrame([("ecommerce", 27), ("ui_components", 13)], "category string, n long")
    got = {r.category: (r.expected, r.actual, r.status) for r in manifest.reconcile(manifest.manifest_categories(m), actual).collect()}
    assert got == {"ecommerce": (27, 27, "match"), "ui_components": (0, 13, "unlisted"), "x": (1000, 0, "absent")}
    files = spark.createDataFrame([("b", "2", 4), ("a", "1", 3)], "category string, file string, count long")
    built = manifest.build_manifest(files, "d", "1", "tests", "s", {g: True for g in manifest.GATES})
    row = built.first()
    assert row.total_prompts == 7 and [c.category for c in row.categories] == ["a", "b"]


def test_streams(spark, folder, tmp_path):
    lines = ingest.arriving_lines(spark, folder)
    ingest.validated_sink(lines, str(tmp_path / "v"), str(tmp_path / "c1")).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(str(tmp_path / "v" / "valid")).count() == 40
    assert sorted(r.reason for r in spark.read.parquet(str(tmp_path / "v" / "quarantine")).collect()) == ["fence", "json"]
    docs = spark.readStream.schema("id long, ts timestamp, body string")
    spark.createDataFrame(
        [(1, "the red card"), (2, "RED card 7"), (3, "blue card")], "id long, body string"
    ).select("id", F.timestamp_seconds("id").alias("ts"), "body").write.parquet(str(tmp_path / "docs"))
    by_id = F.col("id")
    for i, args in enumerate([(None, None), ("ts", "1 hour"), (None, None, by_id), ("ts", "1 hour", by_id)]):
        unique = ingest.first_by_fingerprint(docs.parquet(str(tmp_path / "docs")), F.col("body"), *args)
        ingest.table_sink(unique, str(tmp_path / f"u{i}"), str(tmp_path / f"k{i}")).trigger(availableNow=True).start().awaitTermination()
        assert spark.read.parquet(str(tmp_path / f"u{i}")).count() == 2
