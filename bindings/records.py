"""Scan, rules and repair over JSON records that Spark derives from ``documents``.

Every document becomes one JSON line. Its fields are set from the document so that
each rule and each repair is met by some rows; some lines are made unreadable.
``REC`` states the same fields for the checking side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark import vocab
from tidemark.functions import text, variants as V
from tidemark.operators import dups, gates, profile, repair, rules
from tidemark.plans.publish import typed_records
from tidemark.plans.validate import validate
from tidemark.session import scratch_dir
from tidemark.sources import jsonl, sinks
from tidemark.sources.tables import read_table

from . import query, sqltext as q
from .duplicates import documents

CATEGORIES = ["landing_pages", "shop", "ui_components", "game", "ai", "data_visualization",
              "unheard_of", "mobile_apps", "chart", "ecommerce", "education", "saas_dashboards"]
DIFFICULTIES = ["beginner", "easy", "hard", "expert", "weird", "intermediate", "advanced"]
AUDIENCES = ["designer", "tutor", "sre", "nobody", "founder"]
USE_CASES = ["website_generation", "dashboard_ui", "other", "data_visualization"]
FRAMEWORKS = ["React", "Vue", "Svelte", "", "Angular", "Solid", "React", "Astro"]


def _pick(values: list[str], i: Column) -> Column:
    return F.get(F.lit(values), (i % len(values)).cast("int"))


def record_lines(docs: DataFrame, damaged: bool = False) -> DataFrame:
    """One JSON line per document, in the shape of a scanned file; some unreadable if ``damaged``."""
    i = F.col("doc_id")
    w = F.col("w")
    first = lambda n: F.slice(w, F.lit(1), n)
    unless = lambda m, value: F.when(i % m != 0, value)
    style = F.struct(
        F.lit("plain look").alias("visual_style"),
        F.when(i % 11 != 1, F.lit("one column")).alias("layout_style"),
        F.lit("blue tones").alias("color_direction"),
        F.when(i % 11 == 0, F.lit("")).otherwise("calm moves").alias("motion_style"),
    )
    tech = F.struct(
        _pick(FRAMEWORKS, i).alias("framework"),
        F.lit("TypeScript").alias("language"),
        F.lit("CSS").alias("styling"),
        F.when(i % 3 == 0, F.lit("")).otherwise("GSAP").alias("animation"),
        F.when(i % 4 == 0, F.array().cast("array<string>")).otherwise(F.array("source")).alias("optional_libraries"),
    )
    card = F.struct(
        F.col("title").alias("headline"),
        F.concat(F.lit("About "), "source").alias("summary"),
        F.col("lang").alias("preview_label"),
        F.array("lang", "source").alias("search_keywords"),
    )
    quality = F.struct(
        (i % 12).alias("specificity_score"),
        F.lit(7).alias("originality_score"),
        (i % 10 + 1).alias("implementation_clarity_score"),
        (i % 9 + 2).alias("website_readiness_score"),
    )
    record = F.struct(
        F.when(i % 50 == 0, F.concat(F.lit("X"), i.cast("string")))
        .otherwise(F.concat(F.lit("PRM-"), F.lpad(i.cast("string"), 6, "0"))).alias("id"),
        F.when(i % 9 == 0, F.lit("")).when(i % 9 == 1, F.lit("v2")).otherwise("1.0.0").alias("version"),
        _pick(CATEGORIES, i).alias("category"),
        F.when(i % 23 == 0, F.lit("")).otherwise(F.concat(F.lit("sub_"), (i % 20).cast("string"))).alias("subcategory"),
        F.col("title"),
        F.col("slug"),
        F.col("lang").alias("language"),
        _pick(DIFFICULTIES, i).alias("difficulty"),
        _pick(AUDIENCES, i).alias("audience"),
        _pick(USE_CASES, i).alias("use_case"),
        unless(13, F.col("source")).alias("industry"),
        style.alias("style"),
        tech.alias("tech_stack"),
        F.col("text").alias("prompt"),
        F.when(i % 10 == 0, F.lit("")).when(i % 3 == 0, F.array_join(first(F.lit(70)), " ")).otherwise("No clutter.").alias("negative_prompt"),
        F.transform(first((i % 9).cast("int")), lambda x: F.concat(F.lit("criterion "), x)).alias("acceptance_criteria"),
        first((i % 15).cast("int")).alias("tags"),
        card.alias("website_card"),
        quality.alias("quality"),
        unless(17, F.lit("agent_x")).alias("created_by_agent"),
        F.when(i % 19 == 0, F.lit("")).otherwise("b7").alias("batch"),
    )
    line = F.to_json(record)
    hurt = (
        F.when(i % 41 == 40, F.left(line, F.length(line) - 5))
        .when(i % 43 == 42, F.lit("```json"))
        .when(i % 47 == 46, F.lit("[1, 2]"))
        .when(i % 53 == 52, F.lit(" \t "))
        .otherwise(line)
    )
    value = hurt if damaged else line
    titled = (
        V.once(docs, "w", text.words(F.col("text")))
        .withColumn("title", F.when(i % 29 == 0, F.lit("")).otherwise(F.array_join(first(F.lit(6)), " ")))
        .withColumn("slug", F.when(i % 31 == 0, F.lit("")).otherwise(text.slugify(F.array_join(first(F.lit(1)), " "))))
    )
    return V.once(titled, "value", value).select(
        F.concat("source", F.lit(".jsonl")).alias("source_file"),
        (i + 1).alias("line_num"),
        i.alias("pos"),
        "value",
    )


def decoded(spark, folder, damaged: bool = False) -> jsonl.Decoded:
    return jsonl.decode(record_lines(documents(spark, folder), damaged))


_FIRST = lambda n: f"list_slice(w, 1, {n})"
LINES = f"""lines AS (SELECT *, {q.words('text')} AS w,
      CASE WHEN doc_id % 41 = 40 THEN 'json' WHEN doc_id % 43 = 42 THEN 'fence'
        WHEN doc_id % 47 = 46 THEN 'not_object' WHEN doc_id % 53 = 52 THEN 'blank' END AS reason
    FROM documents)"""
SOUND = f"lines AS (SELECT *, {q.words('text')} AS w, CAST(NULL AS VARCHAR) AS reason FROM documents)"
_RECORDS = f"""rec AS (SELECT doc_id, source, lang, text AS prompt, w,
      CASE WHEN doc_id % 50 = 0 THEN 'X' || doc_id ELSE 'PRM-' || lpad(CAST(doc_id AS VARCHAR), 6, '0') END AS id,
      CASE WHEN doc_id % 9 = 0 THEN '' WHEN doc_id % 9 = 1 THEN 'v2' ELSE '1.0.0' END AS version,
      {q.pick(CATEGORIES)} AS category,
      CASE WHEN doc_id % 23 = 0 THEN '' ELSE 'sub_' || (doc_id % 20) END AS subcategory,
      CASE WHEN doc_id % 29 = 0 THEN '' ELSE array_to_string({_FIRST(6)}, ' ') END AS title,
      CASE WHEN doc_id % 31 = 0 THEN '' ELSE {q.slug(f"array_to_string({_FIRST(1)}, ' ')")} END AS slug,
      lang AS language, {q.pick(DIFFICULTIES)} AS difficulty, {q.pick(AUDIENCES)} AS audience,
      {q.pick(USE_CASES)} AS use_case, CASE WHEN doc_id % 13 <> 0 THEN source END AS industry,
      {q.pick(FRAMEWORKS)} AS framework, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'GSAP' END AS animation,
      CASE WHEN doc_id % 10 = 0 THEN '' WHEN doc_id % 3 = 0 THEN array_to_string({_FIRST(70)}, ' ') ELSE 'No clutter.' END AS negative_prompt,
      list_transform({_FIRST('doc_id % 9')}, lambda x: 'criterion ' || x) AS criteria,
      {_FIRST('doc_id % 15')} AS tags,
      'About ' || source AS summary,
      CASE WHEN doc_id % 17 <> 0 THEN 'agent_x' END AS agent,
      CASE WHEN doc_id % 19 = 0 THEN '' ELSE 'b7' END AS batch,
      len(w) AS n_words
    FROM lines WHERE reason IS NULL)"""
REC = f"{SOUND}, {_RECORDS}"
DAMAGED = f"{LINES}, {_RECORDS}"


@query(f"WITH {LINES} SELECT doc_id AS pos, reason, source || '.jsonl' AS source_file FROM lines WHERE reason IN ('json', 'fence', 'not_object')")
def json_quarantine(spark, folder):
    return decoded(spark, folder, damaged=True).quarantine.select("pos", "reason", "source_file")


@query(
    """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_type(json_extract(props, '$.k')) = 'UBIGINT' AS is_integer
    FROM events WHERE json_valid(props)"""
)
def json_fields(spark, folder):
    events = read_table(spark, f"{folder}/events.parquet").select(
        F.lit("events").alias("source_file"), F.col("event_id").alias("line_num"),
        F.col("event_id").alias("pos"), F.col("props").alias("value"),
    )
    rec = "rec"
    return jsonl.decode(events).records.select(
        F.col("pos").alias("event_id"), V.long_at(rec, "k").alias("k"),
        V.is_integer(V.type_at(rec, "k")).alias("is_integer"),
    )


_VALID = f"""complete AS (SELECT * FROM rec WHERE doc_id % 13 <> 0 AND doc_id % 17 <> 0),
    checked AS (SELECT *,
      doc_id % 50 = 0 OR length(id) <> 10 AS bad_id,
      category NOT IN ({', '.join(q.lit(c) for c in vocab.CATEGORIES)}) AS bad_category,
      difficulty NOT IN ('beginner', 'intermediate', 'advanced', 'expert') AS bad_difficulty,
      language NOT IN ('en', 'de') AS bad_language,
      audience NOT IN ({', '.join(q.lit(c) for c in vocab.AUDIENCES)}) AS bad_audience,
      use_case NOT IN ({', '.join(q.lit(c) for c in vocab.USE_CASES)}) AS bad_use_case,
      doc_id % 11 = 1 AS no_layout,
      doc_id % 12 NOT BETWEEN 1 AND 10 AS bad_score,
      len(criteria) AS n_criteria, len(tags) AS n_tags,
      {q.word_count('negative_prompt')} AS n_negative
    FROM complete)"""
_BROKEN = f"""SELECT doc_id AS pos, 'missing_field' AS rule, 'industry' AS field, 'Missing required field: ''industry''' AS detail FROM rec WHERE doc_id % 13 = 0
    UNION ALL SELECT doc_id, 'missing_field', 'created_by_agent', 'Missing required field: ''created_by_agent''' FROM rec WHERE doc_id % 17 = 0
    UNION ALL SELECT doc_id, 'invalid_id', 'id', 'Invalid ID format: ''' || id || '''' FROM checked WHERE bad_id
    UNION ALL SELECT doc_id, 'invalid_value', 'category', 'Invalid category: ''' || category || '''' FROM checked WHERE bad_category
    UNION ALL SELECT doc_id, 'invalid_value', 'difficulty', 'Invalid difficulty: ''' || difficulty || '''' FROM checked WHERE bad_difficulty
    UNION ALL SELECT doc_id, 'invalid_value', 'language', 'Invalid language: ''' || language || '''' FROM checked WHERE bad_language
    UNION ALL SELECT doc_id, 'invalid_value', 'audience', 'Invalid audience: ''' || audience || '''' FROM checked WHERE bad_audience
    UNION ALL SELECT doc_id, 'invalid_value', 'use_case', 'Invalid use_case: ''' || use_case || '''' FROM checked WHERE bad_use_case
    UNION ALL SELECT doc_id, 'missing_key', 'style.layout_style', 'Missing style field: ''layout_style''' FROM checked WHERE no_layout
    UNION ALL SELECT doc_id, 'invalid_score', 'quality.specificity_score', 'Invalid quality score for ''specificity_score'': ' || (doc_id % 12) FROM checked WHERE bad_score
    UNION ALL SELECT doc_id, 'too_short', 'prompt', 'Prompt too short: ' || n_words || ' words (min 80)' FROM checked WHERE n_words < 80
    UNION ALL SELECT doc_id, 'too_long', 'prompt', 'Prompt too long: ' || n_words || ' words (max 220)' FROM checked WHERE n_words > 220
    UNION ALL SELECT doc_id, 'too_long', 'negative_prompt', 'Negative prompt too long: ' || n_negative || ' words (max 60)' FROM checked WHERE n_negative > 60
    UNION ALL SELECT doc_id, 'too_few', 'acceptance_criteria', 'Too few acceptance criteria: ' || n_criteria || ' (min 3)' FROM checked WHERE n_criteria < 3
    UNION ALL SELECT doc_id, 'too_many', 'acceptance_criteria', 'Too many acceptance criteria: ' || n_criteria || ' (max 6)' FROM checked WHERE n_criteria > 6
    UNION ALL SELECT doc_id, 'too_few', 'tags', 'Too few tags: ' || n_tags || ' (min 5)' FROM checked WHERE n_tags < 5
    UNION ALL SELECT doc_id, 'too_many', 'tags', 'Too many tags: ' || n_tags || ' (max 12)' FROM checked WHERE n_tags > 12"""


@query(f"WITH {REC}, {_VALID} {_BROKEN}")
def rule_violations(spark, folder):
    found = rules.check_records(decoded(spark, folder).records, declarative=False)
    return found.select("pos", "rule", "field", "detail")


@query(f"WITH {REC}, {_VALID} SELECT rule, field, count(*) AS n FROM ({_BROKEN}) GROUP BY rule, field")
def violation_counts(spark, folder):
    found = rules.check_records(decoded(spark, folder).records, declarative=False)
    return rules.count_by_rule(found).drop("kind")


_KEBAB = "^[a-z0-9]+(-[a-z0-9]+)*$"


@query(
    f"""WITH {REC}
    SELECT doc_id AS pos, 'pattern' AS rule, 'id' AS field FROM rec WHERE NOT regexp_full_match(id, 'PRM-[0-9]{{6}}')
    UNION ALL SELECT doc_id, 'pattern', 'version' FROM rec WHERE version <> '1.0.0'
    UNION ALL SELECT doc_id, 'pattern', 'slug' FROM rec WHERE NOT regexp_matches(slug, '{_KEBAB}')
    UNION ALL SELECT doc_id, 'min_length', 'subcategory' FROM rec WHERE subcategory = ''
    UNION ALL SELECT doc_id, 'min_length', 'title' FROM rec WHERE length(title) < 10
    UNION ALL SELECT doc_id, 'max_length', 'title' FROM rec WHERE length(title) > 120
    UNION ALL SELECT doc_id, 'min_length', 'prompt' FROM rec WHERE length(prompt) < 50
    UNION ALL SELECT doc_id, 'item_pattern', 'tags' FROM rec WHERE len(list_filter(tags, lambda t: NOT regexp_matches(t, '{_KEBAB}'))) > 0
    UNION ALL SELECT doc_id, 'min_length', 'style.motion_style' FROM rec WHERE doc_id % 11 = 0
    UNION ALL SELECT doc_id, 'min_length', 'website_card.headline' FROM rec WHERE length(title) < 5
    UNION ALL SELECT doc_id, 'min_length', 'website_card.summary' FROM rec"""
)
def schema_violations(spark, folder):
    found = rules.check_records(decoded(spark, folder).records)
    return found.filter(F.col("kind") == rules.DECLARATIVE).select("pos", "rule", "field")


#: Faults put into the JSON text: (condition, text, replacement, rule, field, only in complete records).
_FAULTS = (
    ("doc_id % 7 = 0", "'\"styling\":\"CSS\",'", "''", "missing_key", "tech_stack.styling", True),
    ("doc_id % 8 = 3", "'\"originality_score\":7,'", "''", "missing_key", "quality.originality_score", True),
    ("doc_id % 9 = 4", "concat('\"summary\":\"About ', source, '\",')", "''", "missing_key", "website_card.summary", True),
    ("doc_id % 7 = 1", "'\"styling\":\"CSS\"'", "'\"styling\":5'", "type", "tech_stack.styling", False),
    ("doc_id % 6 = 5 AND doc_id % 9 > 0", "'\"acceptance_criteria\":['", "'\"acceptance_criteria\":[\"short\",'", "item_min_length", "acceptance_criteria", False),
    ("doc_id % 10 = 7", "concat('\"preview_label\":\"', lang, '\"')", "'\"preview_label\":\"x\"'", "min_length", "website_card.preview_label", False),
)
_COMPLETE = "doc_id % 13 <> 0 AND doc_id % 17 <> 0"


@query(
    " UNION ALL ".join(
        f"SELECT doc_id AS pos, '{rule}' AS rule, '{field}' AS field FROM documents WHERE {when}" + (f" AND {_COMPLETE}" if complete else "")
        for when, _, _, rule, field, complete in _FAULTS
    )
)
def nested_violations(spark, folder):
    """Missing keys of three objects, a wrong type, a short criterion and a short label."""
    docs = documents(spark, folder)
    value = F.col("value")
    for when, old, new, *_ in _FAULTS:
        value = F.when(F.expr(when), F.replace(value, F.expr(old), F.expr(new))).otherwise(value)
    lines = record_lines(docs).join(docs.select(F.col("doc_id").alias("pos"), "doc_id", "lang", "source"), "pos")
    hurt = lines.select("source_file", "line_num", "pos", value.alias("value"))
    found = rules.check_records(jsonl.decode(hurt).records)
    asked = F.array(*[F.lit(f"{rule} {field}") for *_, rule, field, _ in _FAULTS])
    return found.filter(F.array_contains(asked, F.concat_ws(" ", "rule", "field"))).select("pos", "rule", "field")


_OK = """ok AS (SELECT * FROM checked WHERE NOT (bad_id OR bad_category OR bad_difficulty OR bad_language OR bad_audience
      OR bad_use_case OR no_layout OR bad_score OR n_words NOT BETWEEN 80 AND 220 OR n_negative > 60
      OR n_criteria NOT BETWEEN 3 AND 6 OR n_tags NOT BETWEEN 5 AND 12))"""


@query(f"WITH {REC}, {_VALID}, {_OK} SELECT doc_id AS pos, id, category, language FROM ok")
def valid_records(spark, folder):
    flagged = rules.flag_valid(decoded(spark, folder).records).filter("valid")
    return flagged.select("pos", *[V.text_at("rec", f).alias(f) for f in ("id", "category", "language")])


@query(
    f"""WITH {DAMAGED}, {_VALID}, {_OK},
    v AS (SELECT source, count(*) AS n FROM ok GROUP BY 1),
    l AS (SELECT source, count(*) AS n FROM lines WHERE reason IS NULL OR reason <> 'blank' GROUP BY 1)
    SELECT l.source || '.jsonl' AS source_file, l.n AS lines, coalesce(v.n, 0) AS valid, l.n - coalesce(v.n, 0) AS invalid
    FROM l LEFT JOIN v USING (source)"""
)
def file_counters(spark, folder):
    d = decoded(spark, folder, damaged=True)
    return jsonl.file_counters(d, rules.flag_valid(d.records).filter("NOT valid"))


@query(
    """SELECT source || '.jsonl' AS source_file, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS line_num,
      row_number() OVER (ORDER BY source || '.jsonl', doc_id) AS pos, md5(text) AS text FROM documents"""
)
def jsonl_round_trip(spark, folder):
    """Documents written as JSON lines in the layout of cleaned records, scanned and parsed."""
    docs = documents(spark, folder)
    lines = docs.select(
        F.concat("source", F.lit(".jsonl")).alias("source_file"), F.col("doc_id").alias("pos"),
        F.to_json(F.struct("doc_id", "text")).alias("value"),
    )
    path = scratch_dir(spark, "lines")
    sinks.write_lines(lines, path)
    records = jsonl.read_records(spark, path).records
    return records.select("source_file", "line_num", "pos", F.md5(V.text_at("rec", "text")).alias("text"))


@query(
    f"""WITH w AS (SELECT doc_id, {q.word_count('text')} AS n FROM documents)
    SELECT doc_id, 'too_short' AS rule, n AS words FROM w WHERE n < 80
    UNION ALL SELECT doc_id, 'too_long', n FROM w WHERE n > 220"""
)
def word_count_violations(spark, folder):
    counted = documents(spark, folder).select("doc_id", text.word_count(F.col("text")).alias("n"))
    found = rules.violations(
        counted, rules.word_rules(F.col("n"), "text", "Text", *vocab.PROMPT_WORDS), "doc_id"
    )
    return found.select("doc_id", "rule", F.col("observed").cast("long").alias("words"))


@query(
    f"""WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY 1),
    o AS (SELECT {q.opening('text')} AS k FROM documents GROUP BY 1 HAVING count(*) > 5),
    r AS (SELECT (SELECT sum(n) FROM c) AS total, (SELECT count(*) FROM c) AS categories,
      (SELECT min(n) FROM c) AS smallest_category,
      (SELECT count(*) - count(DISTINCT text) FROM documents) AS duplicate_keys, (SELECT count(*) FROM o) AS overused_openings)
    SELECT CAST(total AS BIGINT) AS total, categories, smallest_category, duplicate_keys, overused_openings,
      total >= 500 AS total_ok, categories >= 10 AS categories_ok, duplicate_keys = 0 AS keys_ok,
      overused_openings = 0 AS openings_ok, smallest_category >= 50 AS per_category_ok,
      CASE WHEN total >= 500 AND categories >= 10 AND duplicate_keys = 0 AND overused_openings = 0
        AND smallest_category >= 50 THEN 'PASS' ELSE 'FAIL' END AS result FROM r"""
)
def dataset_gate(spark, folder):
    docs = documents(spark, folder)
    surplus = dups.surplus(docs, {"text": F.sha2("text", 256)})
    return gates.dataset_gate(
        profile.count_by(docs, "source"), surplus, dups.overused_openings(docs, "text"),
        min_total=500, min_per_category=50, gating_keys=("text",),
    )


@query(
    f"""WITH {DAMAGED}, {_VALID}, {_OK},
    r AS (SELECT count(*) AS total_prompts, count(DISTINCT category) AS total_categories,
      count(*) - count(DISTINCT id) AS duplicate_ids, count(*) - count(DISTINCT slug) AS duplicate_slugs,
      count(*) - count(DISTINCT title) AS duplicate_titles FROM ok)
    SELECT r.*, (SELECT count(*) FROM lines WHERE reason <> 'blank') AS invalid_lines,
      (SELECT count(*) FROM ({_BROKEN})) + (SELECT count(*) FROM lines WHERE reason <> 'blank')
        + duplicate_ids + duplicate_slugs + duplicate_titles AS total_errors,
      (SELECT count(*) FROM (SELECT 1 FROM ok JOIN documents d USING (doc_id) GROUP BY {q.opening('d.text')} HAVING count(*) > 5)) AS first5_duplicates,
      (SELECT string_agg(k || '=' || n, ',' ORDER BY n DESC, k) FROM (SELECT category AS k, count(*) AS n FROM ok GROUP BY 1)) AS categories,
      (SELECT string_agg(k || '=' || n, ',' ORDER BY n DESC, k) FROM (SELECT difficulty AS k, count(*) AS n FROM ok GROUP BY 1)) AS difficulties,
      (SELECT string_agg(k || '=' || n, ',' ORDER BY n DESC, k) FROM (SELECT language AS k, count(*) AS n FROM ok GROUP BY 1)) AS languages,
      'FAIL' AS overall_result FROM r"""
)
def validation_summary(spark, folder):
    lines = decoded(spark, folder, damaged=True)
    listed = lambda c: F.array_join(
        F.transform(F.map_entries(c), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ","
    )
    return validate(lines).summary.select(
        "total_prompts", "total_categories", "duplicate_ids", "duplicate_slugs", "duplicate_titles",
        "invalid_lines", "total_errors", "first5_duplicates", listed("category_counts").alias("categories"),
        listed("difficulty_distribution").alias("difficulties"), listed("language_distribution").alias("languages"),
        "overall_result",
    )


@query(
    f"""SELECT o_orderkey, {q.mapped('o_orderpriority', ['1-URGENT', '2-HIGH'], {'3-MEDIUM': '2-HIGH', '5-LOW': '9-IDLE'}, '0-NONE')} AS priority
    FROM orders"""
)
def enum_repair(spark, folder):
    orders = read_table(spark, f"{folder}/orders.parquet")
    fixed = repair.map_enum(
        F.col("o_orderpriority"), ["1-URGENT", "2-HIGH"], {"3-MEDIUM": "2-HIGH", "5-LOW": "9-IDLE"}, "0-NONE"
    )
    return orders.select("o_orderkey", fixed.alias("priority"))


@query(
    f"""SELECT c_custkey, {q.mapped('c_mktsegment', ['BUILDING'], {'MACHINERY': 'INDUSTRY', 'AUTOMOBILE': 'INDUSTRY'}, 'OTHER')} AS segment
    FROM customer"""
)
def enum_repair_by_table(spark, folder):
    customer = read_table(spark, f"{folder}/customer.parquet").select("c_custkey", "c_mktsegment")
    synonyms = spark.createDataFrame(
        [("MACHINERY", "INDUSTRY"), ("AUTOMOBILE", "INDUSTRY")], "value string, replacement string"
    )
    return repair.map_enum_by_table(
        customer, "c_mktsegment", ["BUILDING"], synonyms, "OTHER", "segment"
    ).drop("c_mktsegment")


_PAD = q.lit(vocab.PROMPT_PADDING)
_FIXED = f"""f AS (SELECT doc_id,
      {q.mapped('category', vocab.CATEGORIES, vocab.CATEGORY_SYNONYMS, vocab.CATEGORY_DEFAULT)} AS category,
      {q.mapped('difficulty', vocab.DIFFICULTIES, vocab.DIFFICULTY_SYNONYMS, vocab.DIFFICULTY_DEFAULT)} AS difficulty,
      {q.mapped('audience', vocab.AUDIENCES, vocab.AUDIENCE_SYNONYMS, vocab.AUDIENCE_DEFAULT)} AS audience,
      {q.mapped('use_case', vocab.USE_CASES, vocab.USE_CASE_SYNONYMS, vocab.USE_CASE_DEFAULT)} AS use_case,
      CASE WHEN language IN ('en', 'de') THEN language ELSE 'en' END AS language FROM rec)"""


@query(f"WITH {REC}, {_FIXED} SELECT doc_id AS pos, category, difficulty, audience, use_case, language FROM f")
def enum_repair_records(spark, folder):
    return repair.repair_fields(decoded(spark, folder).records).select(
        "pos", "category", "difficulty", "audience", "use_case", "language"
    )


@query(
    f"""WITH {REC}
    SELECT doc_id AS pos, CASE WHEN doc_id % 11 = 1 THEN {q.lit(vocab.STYLE_DEFAULTS['layout_style'])} ELSE 'one column' END AS layout_style,
      CASE WHEN doc_id % 11 = 0 THEN {q.lit(vocab.STYLE_DEFAULTS['motion_style'])} ELSE 'calm moves' END AS motion_style,
      CASE WHEN framework = '' THEN 'React' ELSE framework END AS framework,
      CASE WHEN animation = '' THEN 'Framer Motion' ELSE animation END AS animation,
      CASE WHEN doc_id % 4 = 0 THEN 'lucide-react' ELSE source END AS library,
      CASE WHEN title = '' THEN 'UI Component Prompt' ELSE title END AS headline,
      CASE WHEN doc_id % 12 BETWEEN 1 AND 10 THEN doc_id % 12 ELSE 8 END AS specificity
    FROM rec"""
)
def object_defaults(spark, folder):
    return repair.repair_fields(decoded(spark, folder).records).select(
        "pos", "style.layout_style", "style.motion_style", "tech_stack.framework", "tech_stack.animation",
        F.col("tech_stack.optional_libraries")[0].alias("library"), "website_card.headline",
        F.col("quality.specificity_score").cast("long").alias("specificity"),
    )


_CRITERIA = q.lits(vocab.CRITERIA_DEFAULTS)
_KEBAB_TAG = "regexp_replace(replace(replace(lower(t), ' ', '-'), '_', '-'), '[^a-z0-9-]', '', 'g')"
_DISTINCT = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"
_TAGS = f"""{_FIXED},
    m AS (SELECT rec.doc_id, f.category, rec.tags AS given,
        list_concat(rec.tags, [replace(f.category, '_', '-'), replace(rec.subcategory, '_', '-'), f.difficulty, 'react', 'tailwind']) AS merged
      FROM rec JOIN f USING (doc_id)),
    n AS (SELECT doc_id, category, CASE WHEN len(given) < 5 THEN list_slice({_DISTINCT.format('merged')}, 1, 12) ELSE list_slice(given, 1, 12) END AS tags FROM m),
    c AS (SELECT *, list_filter(list_transform(tags, lambda t: {_KEBAB_TAG}), lambda t: t <> '') AS clean FROM n),
    d AS (SELECT *, list_filter([replace(category, '_', '-'), 'react', 'tailwind', 'ui', 'component'], lambda x: NOT list_contains(clean, x)) AS more FROM c)"""


@query(
    f"""WITH {REC}, {_TAGS}
    SELECT doc_id AS pos, array_to_string(CASE WHEN len(clean) = 0 THEN tags
      ELSE list_slice(list_concat(clean, list_slice(more, 1, greatest(0, 5 - len(clean)))), 1, 12) END, '|') AS tags FROM d"""
)
def tag_repair(spark, folder):
    return repair.repair_fields(decoded(spark, folder).records).select("pos", F.array_join("tags", "|").alias("tags"))


@query(
    f"""WITH {REC}
    SELECT doc_id AS pos, array_to_string(CASE WHEN len(criteria) > 6 THEN list_slice(criteria, 1, 6)
      ELSE list_concat(criteria, list_slice({_CRITERIA}, len(criteria) + 1, 3)) END, '|') AS criteria FROM rec"""
)
def list_repair(spark, folder):
    return repair.repair_fields(decoded(spark, folder).records).select(
        "pos", F.array_join("acceptance_criteria", "|").alias("criteria")
    )


@query(
    f"""WITH p AS (SELECT doc_id, CASE WHEN {q.word_count('text')} < 80 THEN text || {_PAD} ELSE text END AS t FROM documents),
    c AS (SELECT doc_id, CASE WHEN {q.word_count('t')} > 220 THEN array_to_string(list_slice({q.words('t')}, 1, 220), ' ') ELSE t END AS t FROM p)
    SELECT doc_id, {q.word_count('t')} AS words, md5(t) AS digest FROM c"""
)
def text_repair(spark, folder):
    fixed = documents(spark, folder).select("doc_id", repair.repair_text(F.col("text")).alias("t"))
    return fixed.select("doc_id", text.word_count(F.col("t")).cast("long").alias("words"), F.md5("t").alias("digest"))


@query(
    f"""WITH {REC} SELECT doc_id AS pos, CASE WHEN negative_prompt = '' THEN {q.lit(vocab.NEGATIVE_PROMPT_DEFAULT)}
      WHEN {q.word_count('negative_prompt')} > 60 THEN array_to_string(list_slice({q.words('negative_prompt')}, 1, 60), ' ')
      ELSE negative_prompt END AS negative_prompt FROM rec"""
)
def secondary_text_repair(spark, folder):
    return repair.repair_fields(decoded(spark, folder).records).select("pos", "negative_prompt")


@query(
    f"""WITH {REC}, {_FIXED}
    SELECT doc_id AS pos, CASE WHEN version = '' THEN '1.0.0' ELSE version END AS version,
      CASE WHEN subcategory = '' THEN 'general' ELSE subcategory END AS subcategory,
      coalesce(industry, 'saas') AS industry, coalesce(agent, f.category || '_agent') AS agent,
      CASE WHEN batch = '' THEN f.category || '_001' ELSE batch END AS batch,
      CASE WHEN slug = '' THEN {q.slug('title')} ELSE slug END AS slug
    FROM rec JOIN f USING (doc_id)"""
)
def scalar_defaults(spark, folder):
    return repair.repair_fields(decoded(spark, folder).records).select(
        "pos", "version", "subcategory", "industry", F.col("created_by_agent").alias("agent"), "batch", "slug"
    )


# No first word or title of the documents ends in a number, so on these tables ordinals
# decide; the general case is compared with a sequential model in the tests.
_NAMES = f"""nm AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS number,
      CASE WHEN slug = '' THEN {q.slug('title')} ELSE slug END AS base FROM rec),
    un AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY doc_id) AS sj,
      row_number() OVER (PARTITION BY title ORDER BY doc_id) AS tj FROM nm)"""


@query(
    f"""WITH {REC}, {_FIXED}, {_NAMES}
    SELECT doc_id AS pos, id, f.category, CASE WHEN sj = 1 THEN base ELSE base || '-' || (sj - 1) END AS slug,
      CASE WHEN title = '' THEN 'Untitled Prompt ' || number WHEN tj = 1 THEN title ELSE title || ' (' || tj || ')' END AS title
    FROM un JOIN f USING (doc_id)"""
)
def repaired_records(spark, folder):
    return repair.repair_records(decoded(spark, folder).records).select("pos", "id", "category", "slug", "title")


_IN = lambda values: ", ".join(q.lit(v) for v in values)


@query(
    f"""WITH {DAMAGED}, {_NAMES},
    k AS (SELECT source, count(*) AS fine FROM un
      WHERE category IN ({_IN(vocab.CATEGORIES)}) AND difficulty IN ({_IN(vocab.DIFFICULTIES)}) AND language IN ('en', 'de')
      AND audience IN ({_IN(vocab.AUDIENCES)}) AND use_case IN ({_IN(vocab.USE_CASES)})
      AND doc_id % 11 NOT IN (0, 1) AND framework <> '' AND animation <> '' AND doc_id % 4 <> 0
      AND doc_id % 12 BETWEEN 1 AND 10 AND len(criteria) BETWEEN 3 AND 6 AND len(tags) BETWEEN 5 AND 12
      AND n_words BETWEEN 80 AND 220 AND negative_prompt <> '' AND {q.word_count('negative_prompt')} <= 60
      AND version <> '' AND subcategory <> '' AND industry IS NOT NULL AND agent IS NOT NULL AND batch <> ''
      AND slug <> '' AND title <> '' AND sj = 1 AND tj = 1 GROUP BY source),
    l AS (SELECT source, count(*) FILTER (reason IS NULL OR reason IN ('json', 'not_object')) AS total,
      count(*) FILTER (reason IS NULL) AS kept FROM lines GROUP BY source)
    SELECT source || '.jsonl' AS source_file, total, kept - coalesce(fine, 0) AS fixed, total - kept AS skipped
    FROM l LEFT JOIN k USING (source)"""
)
def repair_counters(spark, folder):
    d = decoded(spark, folder, damaged=True)
    return repair.repair_counters(d.lines, repair.repair_records(d.records))


def typed(spark, folder) -> DataFrame:
    return typed_records(decoded(spark, folder))
