"""Record rules. Every broken rule becomes one row; nothing stops at the first error.

``imperative`` rules decide whether a record is valid. ``declarative`` rules are the
schema's patterns, lengths and types; they are reported beside the others. All rules
are row-wise, so validation is one narrow pass over the input.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, functions as F

from .. import vocab
from ..functions import text, variants as V
from .dups import keyed
from .ordering import join_per_key

IMPERATIVE, DECLARATIVE = "imperative", "declarative"


@dataclass(frozen=True)
class Rule:
    """``broken`` is true when the rule is violated; null counts as not violated."""

    name: str
    field: str
    broken: Column
    observed: Column
    before: str
    after: str = ""
    kind: str = IMPERATIVE
    shows_observed: bool = True


def missing_fields(facts: V.Facts, fields: Sequence[str] = vocab.RECORD_FIELDS) -> list[Rule]:
    return [
        Rule("missing_field", f, facts.type(f).isNull(), F.lit(None), f"Missing required field: '{f}'", shows_observed=False)
        for f in fields
    ]


def word_rules(
    n: Column,
    field: str,
    label: str,
    minimum: int | None = None,
    maximum: int | None = None,
) -> list[Rule]:
    """Limits of a column that holds a number of words."""
    out = []
    if minimum is not None:
        out.append(Rule("too_short", field, n < minimum, n, f"{label} too short: ", f" words (min {minimum})"))
    if maximum is not None:
        out.append(Rule("too_long", field, n > maximum, n, f"{label} too long: ", f" words (max {maximum})"))
    return out


def size_rules(n: Column, field: str, label: str, bounds: tuple[int, int]) -> list[Rule]:
    low, high = bounds
    return [
        Rule("too_few", field, n < low, n, f"Too few {label}: ", f" (min {low})"),
        Rule("too_many", field, n > high, n, f"Too many {label}: ", f" (max {high})"),
    ]


def enum_rule(value: Column, field: str, valid: Sequence[str]) -> Rule:
    ok = F.coalesce(value.isin(*valid), F.lit(False))
    return Rule("invalid_value", field, ~ok, value, f"Invalid {field}: '", "'")


def imperative_rules(facts: V.Facts) -> list[Rule]:
    """Rules beyond presence; they apply only to records with all fields."""
    rules = []
    id_type, id_text = facts.type("id"), facts.text("id")
    well_formed = F.startswith(id_text, F.lit(vocab.ID_PREFIX)) & (F.length(id_text) == vocab.ID_LENGTH)
    rules.append(
        Rule(
            "invalid_id", "id", ~F.coalesce(V.is_string(id_type) & well_formed, F.lit(False)),
            id_text, "Invalid ID format: '", "'",
        )
    )
    enums = (
        ("category", vocab.CATEGORIES), ("difficulty", vocab.DIFFICULTIES),
        ("language", vocab.LANGUAGES), ("audience", vocab.AUDIENCES), ("use_case", vocab.USE_CASES),
    )
    rules += [enum_rule(facts.text(f), f, valid) for f, valid in enums]

    wrong = {
        "prompt": V.is_string, "negative_prompt": V.is_string,
        "acceptance_criteria": V.is_array, "tags": V.is_array,
        "style": V.is_object, "tech_stack": V.is_object,
        "quality": V.is_object, "website_card": V.is_object,
    }
    types = {f: facts.type(f) for f in wrong}
    right = {f: check(types[f]) for f, check in wrong.items()}
    rules += [
        Rule("invalid_type", f, ~right[f], types[f], f"Invalid type of '{f}': ") for f in wrong
    ]
    nested = (
        ("style", vocab.STYLE_FIELDS), ("tech_stack", vocab.TECH_REQUIRED_FIELDS),
        ("quality", vocab.SCORE_FIELDS), ("website_card", vocab.CARD_FIELDS),
    )
    for parent, keys in nested:
        rules += [
            Rule(
                "missing_key", f"{parent}.{k}", right[parent] & facts.type(parent, k).isNull(),
                F.lit(None), f"Missing {parent} field: '{k}'", shows_observed=False,
            )
            for k in keys
        ]
    low, high = vocab.SCORE_RANGE
    for k in vocab.SCORE_FIELDS:
        score, kind = facts.text("quality", k), facts.type("quality", k)
        in_range = facts.long("quality", k).between(low, high)
        good = V.is_integer(kind) & F.coalesce(in_range, F.lit(False))
        rules.append(
            Rule(
                "invalid_score", f"quality.{k}", kind.isNotNull() & ~good, score,
                f"Invalid quality score for '{k}': ",
            )
        )
    words = {
        f: F.when(right[f], facts.add(f"words_{f}", text.word_count(facts.raw_text(f))))
        for f in ("prompt", "negative_prompt")
    }
    rules += word_rules(words["prompt"], "prompt", "Prompt", *vocab.PROMPT_WORDS)
    rules += word_rules(
        words["negative_prompt"], "negative_prompt", "Negative prompt", maximum=vocab.NEGATIVE_WORDS_MAX
    )
    for f, label, bounds in (
        ("acceptance_criteria", "acceptance criteria", vocab.CRITERIA_ITEMS),
        ("tags", "tags", vocab.TAG_ITEMS),
    ):
        items = facts.strings(f)
        rules += size_rules(F.when(items.isNotNull(), F.size(items)), f, label, bounds)
    return rules


def pattern_rule(value: Column, field: str, pattern: str) -> Rule:
    return Rule(
        "pattern", field, ~value.rlike(pattern), value,
        f"'{field}' does not match its pattern: '", "'", DECLARATIVE,
    )


def length_rules(
    value: Column,
    field: str,
    minimum: int | None = None,
    maximum: int | None = None,
    measured: bool = False,
) -> list[Rule]:
    """Limits of the characters of a text, or of a length that is already ``measured``."""
    n, out = value if measured else F.length(value), []
    if minimum is not None:
        out.append(Rule("min_length", field, n < minimum, n, f"'{field}' has too few characters: ", kind=DECLARATIVE))
    if maximum is not None:
        out.append(Rule("max_length", field, n > maximum, n, f"'{field}' has too many characters: ", kind=DECLARATIVE))
    return out


def item_rule(name: str, items: Column, field: str, good) -> Rule:
    """All items must satisfy ``good``; the first that does not is reported."""
    bad = F.filter(items, lambda x: ~good(x))
    return Rule(name, field, F.size(bad) > 0, F.get(bad, 0), f"'{field}' has a bad item: '", "'", DECLARATIVE)


def type_rule(facts: V.Facts, path: tuple[str, ...], wanted: str) -> Rule:
    kind = facts.type(*path)
    ok = {
        "string": kind == "STRING",
        "integer": kind == "BIGINT",
        "object": V.is_object(kind),
        "strings": kind.isin("ARRAY<STRING>", "ARRAY<VOID>"),
    }[wanted]
    return Rule("type", ".".join(path), kind.isNotNull() & ~ok, kind, f"'{'.'.join(path)}' has type ", kind=DECLARATIVE)


def declarative_rules(facts: V.Facts) -> list[Rule]:
    """Patterns, lengths, item rules and types of the record schema. Absent fields pass."""

    def string(*path: str) -> Column:
        return F.when(facts.type(*path) == "STRING", facts.text(*path))

    rules = [
        pattern_rule(string("id"), "id", vocab.ID_PATTERN),
        pattern_rule(string("version"), "version", vocab.VERSION_PATTERN),
        pattern_rule(string("slug"), "slug", vocab.KEBAB_PATTERN),
        *length_rules(string("subcategory"), "subcategory", 1),
        *length_rules(string("title"), "title", 10, 120),
        *length_rules(string("industry"), "industry", 1),
        *length_rules(
            F.when(facts.type("prompt") == "STRING", facts.add("length_prompt", F.length(facts.raw_text("prompt")))),
            "prompt", 50, measured=True,
        ),
        item_rule("item_pattern", facts.strings("tags"), "tags", lambda t: t.rlike(vocab.KEBAB_PATTERN)),
        item_rule(
            "item_min_length", facts.strings("acceptance_criteria"), "acceptance_criteria",
            lambda c: F.length(c) >= 10,
        ),
    ]
    for k in vocab.STYLE_FIELDS:
        rules += length_rules(string("style", k), f"style.{k}", 5)
    for k, n in (("headline", 5), ("summary", 20), ("preview_label", 2)):
        rules += length_rules(string("website_card", k), f"website_card.{k}", n)

    objects = ("style", "tech_stack", "website_card", "quality")
    string_lists = ("acceptance_criteria", "tags")
    for f in vocab.RECORD_FIELDS:
        wanted = "object" if f in objects else "strings" if f in string_lists else "string"
        rules.append(type_rule(facts, (f,), wanted))
    for parent, keys in (
        ("style", vocab.STYLE_FIELDS), ("tech_stack", vocab.TECH_FIELDS),
        ("website_card", vocab.CARD_FIELDS),
    ):
        for k in keys:
            wanted = "strings" if k in ("optional_libraries", "search_keywords") else "string"
            rules.append(type_rule(facts, (parent, k), wanted))
    rules += [type_rule(facts, ("quality", k), "integer") for k in vocab.SCORE_FIELDS]
    return rules


def _hits(rules: Sequence[Rule]) -> Column:
    """Broken rules as structs (rule, kind, field, observed, detail).

    The row-wise part only yields the number of the rule and what was observed; the
    fixed texts are looked up afterwards, for broken rules only.
    """

    def quoted(s: str) -> str:
        return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"

    texts = ", ".join(
        f"named_struct('rule', {quoted(r.name)}, 'kind', {quoted(r.kind)}, 'field', {quoted(r.field)}, "
        f"'before', {quoted(r.before)}, 'after', {quoted(r.after)}, 'shown', {str(r.shows_observed).lower()})"
        for r in rules
    )
    broken = F.array_compact(
        F.array(
            *[
                F.when(r.broken, F.struct(F.lit(i).alias("i"), r.observed.cast("string").alias("observed")))
                for i, r in enumerate(rules)
            ]
        )
    )
    table = F.expr(f"array({texts})")

    def described(hit: Column) -> Column:
        t = F.get(table, hit["i"])
        seen = F.when(t["shown"], F.coalesce(hit["observed"], F.lit("None"))).otherwise("")
        return F.struct(
            t["rule"].alias("rule"),
            t["kind"].alias("kind"),
            t["field"].alias("field"),
            hit["observed"].alias("observed"),
            F.concat(t["before"], seen, t["after"]).alias("detail"),
        )

    return F.transform(broken, described)


def violations(df: DataFrame, rules: Sequence[Rule], *carry: str, only_if: Column | None = None) -> DataFrame:
    """One row per broken rule: ``carry`` columns, rule, kind, field, observed, detail."""
    hits = _hits(rules)
    if only_if is not None:
        hits = F.when(only_if, hits)
    return df.select(*carry, F.explode(hits).alias("v")).select(*carry, "v.*")


def _complete(facts: V.Facts) -> Column:
    present = [facts.type(f).isNotNull() for f in vocab.RECORD_FIELDS]
    out = present[0]
    for p in present[1:]:
        out = out & p
    return out


def with_hits(records: DataFrame, declarative: bool = True) -> DataFrame:
    """Add ``hits``: one struct per broken rule of a decoded record.

    A record that lacks a required field reports the missing fields and its schema
    violations, no other imperative rule.
    """
    facts, hits = _record_checks(declarative, SparkContext._gateway)
    return facts.drop(V.once(facts.measure(records), "hits", hits))


@lru_cache(maxsize=4)
def _record_checks(declarative: bool, gateway: object) -> tuple[V.Facts, Column]:
    """Facts and broken rules as columns. Building them takes thousands of calls into
    the JVM, so they are kept; a new JVM (``gateway``) builds its own."""
    facts = V.Facts("rec")
    hits = F.when(_complete(facts), _hits(imperative_rules(facts))).otherwise(_hits(missing_fields(facts)))
    if declarative:
        hits = F.concat(hits, _hits(declarative_rules(facts)))
    return facts, hits


def is_valid(hits: str = "hits") -> Column:
    return ~F.exists(F.col(hits), lambda h: h["kind"] == IMPERATIVE)


def explode_hits(checked: DataFrame) -> DataFrame:
    """One row per broken rule of rows that carry ``hits``."""
    carry = ["source_file", "line_num", "pos", "id"]
    # The outer form infers no filter on the list, which would evaluate it twice.
    rows = checked.select(*carry, F.explode_outer("hits").alias("v"))
    return rows.filter(F.col("v").isNotNull()).select(*carry, "v.*")


def check_records(records: DataFrame, declarative: bool = True) -> DataFrame:
    """All violations of decoded records."""
    checked = with_hits(records, declarative).withColumn("id", V.text_at("rec", "id"))
    return explode_hits(checked)


def flag_valid(records: DataFrame) -> DataFrame:
    """Add ``valid``: complete and no imperative rule broken."""
    return with_hits(records, declarative=False).withColumn("valid", is_valid()).drop("hits")


def split_valid(rows: DataFrame, broken: DataFrame, key: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(valid, invalid) rows by stored violations."""
    keys = broken.select(*key).distinct()
    return rows.join(keys, list(key), "left_anti"), rows.join(keys, list(key), "left_semi")


def unreadable_lines(quarantine: DataFrame) -> DataFrame:
    """Quarantined lines in the shape of violations."""
    detail = (
        F.when(F.col("reason") == "fence", "Markdown code block detected")
        .when(F.col("reason") == "json", "JSON parse error")
        .otherwise("Not a JSON object")
    )
    return quarantine.select(
        "source_file", "line_num", "pos", F.lit(None).cast("string").alias("id"),
        F.concat(F.lit("unreadable_"), F.col("reason")).alias("rule"),
        F.lit(IMPERATIVE).alias("kind"), F.lit(None).cast("string").alias("field"),
        F.lit(None).cast("string").alias("observed"), detail.alias("detail"),
    )


def duplicate_keys(valid: DataFrame, field: str, label: str, shown_chars: int | None = None) -> DataFrame:
    """Later users of a key, each naming where the key was first seen.

    ``valid`` holds source_file, line_num, pos, id and the field.
    """
    rows = keyed(valid, F.col(field), "pos", "id", "source_file", "line_num")
    per_key = (
        rows.groupBy("key")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min(F.struct("pos", F.concat_ws(":", "source_file", "line_num").alias("place"))).alias("first"),
        )
        .filter(F.col("n") > 1)
    )
    placed = (
        join_per_key(rows, per_key, "key", "pos")
        .filter(F.col("pos") > F.col("first.pos"))
        .withColumn("seen_at", F.col("first.place"))
    )
    shown = F.col("key") if shown_chars is None else F.left(F.col("key"), F.lit(shown_chars))
    return placed.select(
        "source_file", "line_num", "pos", "id",
        F.lit(f"duplicate_{field}").alias("rule"), F.lit(IMPERATIVE).alias("kind"),
        F.lit(field).alias("field"), F.col("key").alias("observed"),
        F.concat(
            F.lit(f"Duplicate {label}: '"), shown, F.lit("' (first seen in "), "seen_at", F.lit(")")
        ).alias("detail"),
    )


def as_messages(found: DataFrame) -> DataFrame:
    """Violations as report lines, in input order: (pos, message)."""
    place = F.concat(F.lit("["), "source_file", F.lit(":"), F.col("line_num").cast("string"), F.lit("] "))
    return found.select("pos", F.concat(place, "detail").alias("message"))


def count_by_rule(found: DataFrame) -> DataFrame:
    return found.groupBy("kind", "rule", "field").agg(F.count(F.lit(1)).alias("n"))
