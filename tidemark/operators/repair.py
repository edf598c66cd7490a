"""Repair of records as column expressions; one projection, no shuffle.

Column functions take plain columns, so they work on any table. ``repair_records``
applies them to decoded JSON records in the order the rules depend on: category and
difficulty first, since tag and agent defaults read the repaired values.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .. import vocab
from ..functions import lists, text, variants as V
from ..session import cut_lineage
from .ordering import dense_buckets
from .uniquify import record_numbers, unique_slugs, unique_titles


def map_enum(c: Column, valid: Sequence[str], synonyms: Mapping[str, str], default: str) -> Column:
    """Keep valid values, translate known synonyms, else the default."""
    translated = F.lit(None).cast("string")
    if synonyms:
        pairs = [F.lit(x) for kv in synonyms.items() for x in kv]
        translated = F.try_element_at(F.create_map(*pairs), c)
    return F.when(c.isin(*valid), c).otherwise(F.coalesce(translated, F.lit(default)))


def map_enum_by_table(
    df: DataFrame, column: str, valid: Sequence[str], synonyms: DataFrame, default: str, out: str
) -> DataFrame:
    """``map_enum`` with the synonyms in a table (value, replacement), one row per value."""
    known = synonyms.select(F.col("value").alias(column), F.col("replacement").alias("_to"))
    return (
        df.join(known, column, "left")
        .withColumn(
            out,
            F.when(F.col(column).isin(*valid), F.col(column)).otherwise(
                F.coalesce("_to", F.lit(default))
            ),
        )
        .drop("_to")
    )


def complete_scores(facts: V.Facts, field: str, defaults: Mapping[str, int]) -> Column:
    """Struct of whole numbers in range; anything else becomes the default."""

    def score(key: str, default: int) -> Column:
        value = facts.long(field, key)
        good = V.is_integer(facts.type(field, key)) & value.between(*vocab.SCORE_RANGE)
        return F.when(good, value).otherwise(F.lit(default)).cast("int").alias(key)

    return F.struct(*[score(k, d) for k, d in defaults.items()])


def complete_object(facts: V.Facts, field: str, defaults: Mapping[str, object]) -> Column:
    """Struct with all keys: empty texts and empty or wrongly typed lists get defaults."""
    parts = []
    for key, default in defaults.items():
        if isinstance(default, list):
            part = lists.non_empty_or(facts.strings(field, key), default)
        else:
            part = F.coalesce(facts.truthy(field, key), F.lit(default))
        parts.append(part.alias(key))
    return F.struct(*parts)


def _object_changed(facts: V.Facts, field: str, defaults: Mapping[str, object]) -> Column:
    """True unless the object already has exactly these keys with usable values."""
    usable = F.coalesce(facts.keys(field) == len(defaults), F.lit(False))
    for key, default in defaults.items():
        if isinstance(default, list):
            good = F.size(facts.strings(field, key)) > 0
        elif isinstance(default, int):
            kind = facts.type(field, key)
            # A fraction equal to the default is replaced by an equal number: no change.
            fraction = kind.startswith("DECIMAL") | (kind == "DOUBLE")
            same = fraction & (facts.text(field, key).cast("double") == default)
            good = (V.is_integer(kind) & facts.long(field, key).between(*vocab.SCORE_RANGE)) | same
        else:
            good = facts.truthy(field, key).isNotNull()
        usable = usable & F.coalesce(good, F.lit(False))
    return ~usable


def repair_list(c: Column, defaults: Sequence[str], maximum: int) -> Column:
    """Pad a short list position by position, cut a long one. Null counts as empty."""
    have = F.coalesce(c, F.array().cast("array<string>"))
    return (
        F.when(F.size(have) == 0, lists.literal_strings(defaults))
        .when(F.size(have) < len(defaults), lists.pad_by_index(have, defaults))
        .otherwise(lists.cap(have, maximum))
    )


def merge_tags(tags: Column, category: Column, subcategory: Column, difficulty: Column) -> Column:
    """Fewer than five tags: add derived ones; more than twelve: keep the first twelve."""
    low, high = vocab.TAG_ITEMS
    derived = F.array(
        F.translate(category, "_", "-"),
        F.translate(subcategory, "_", "-"),
        difficulty,
        *[F.lit(t) for t in vocab.TAG_MERGE_DEFAULTS],
    )
    return (
        F.when(tags.isNull(), derived)
        .when(F.size(tags) < low, lists.cap(lists.merge_distinct(tags, derived), high))
        .otherwise(lists.cap(tags, high))
    )


def normalise_tags(tags: Column, category: Column) -> Column:
    """Kebab-case tags, padded to five. If nothing survives, the tags stay as they were."""
    low, high = vocab.TAG_ITEMS
    clean = F.filter(
        F.transform(tags, lambda t: text.kebab_tag(F.coalesce(t, F.lit("none")))), lambda t: t != ""
    )
    defaults = F.array(
        F.translate(category, "_", "-"), *[F.lit(t) for t in vocab.TAG_PAD_DEFAULTS]
    )
    padded = lists.cap(lists.pad_with_absent(clean, defaults, low), high)
    return F.when(F.size(clean) == 0, tags).otherwise(padded)


def repair_text(
    c: Column,
    bounds: tuple[int, int] = vocab.PROMPT_WORDS,
    padding: str = vocab.PROMPT_PADDING,
    n_words: Column | None = None,
) -> Column:
    """Append the padding once to short text, then keep at most the maximum of words.

    ``n_words`` is the number of words when it is already known.
    """
    low, high = bounds
    n = text.word_count(c) if n_words is None else n_words
    return (
        F.when(n < low, text.truncate_words(F.concat(c, F.lit(padding)), high))
        .when(n > high, text.cut_words(c, high))
        .otherwise(c)
    )


def repair_secondary_text(
    c: Column,
    maximum: int = vocab.NEGATIVE_WORDS_MAX,
    default: str = vocab.NEGATIVE_PROMPT_DEFAULT,
    n_words: Column | None = None,
) -> Column:
    n = text.word_count(c) if n_words is None else n_words
    return (
        F.when(F.coalesce(c, F.lit("")) == "", F.lit(default))
        .when(n > maximum, text.cut_words(c, maximum))
        .otherwise(c)
    )


def slug_or_from_title(slug: Column, title: Column) -> Column:
    """The slug, or one made from the title; a record without a title gives ``untitled``."""
    return text.or_default(
        slug, text.slugify(F.coalesce(title, F.lit(vocab.UNTITLED_SLUG_SOURCE)))
    )


_ENUMS = {
    "category": (vocab.CATEGORIES, vocab.CATEGORY_SYNONYMS, vocab.CATEGORY_DEFAULT),
    "audience": (vocab.AUDIENCES, vocab.AUDIENCE_SYNONYMS, vocab.AUDIENCE_DEFAULT),
    "use_case": (vocab.USE_CASES, vocab.USE_CASE_SYNONYMS, vocab.USE_CASE_DEFAULT),
    "difficulty": (vocab.DIFFICULTIES, vocab.DIFFICULTY_SYNONYMS, vocab.DIFFICULTY_DEFAULT),
    "language": (vocab.LANGUAGES, {}, vocab.LANGUAGE_DEFAULT),
}
_OBJECTS = {
    "style": vocab.STYLE_DEFAULTS,
    "tech_stack": vocab.TECH_DEFAULTS,
    "website_card": vocab.CARD_DEFAULTS,
    "quality": vocab.SCORE_DEFAULTS,
}


def repair_fields(records: DataFrame) -> DataFrame:
    """Typed, repaired fields of decoded records; slug and title are not yet unique.

    ``repairs`` lists the rules that changed the row. Tag normalisation alone is not
    a repair. Top-level fields outside the record shape are kept in ``extra``.
    """
    rec = "rec"
    facts = V.Facts(rec)
    objects = {
        f: (complete_scores if f == "quality" else complete_object)(facts, f, d).alias(f)
        for f, d in _OBJECTS.items()
    }
    objects_changed = {f: _object_changed(facts, f, d) for f, d in _OBJECTS.items()}
    falsy = ("version", "industry", "created_by_agent", "batch")
    scalars = {f"_{f}": facts.truthy(f) for f in falsy}
    prompt = facts.add("prompt", F.coalesce(V.text_at(rec, "prompt"), F.lit("")))
    negative = facts.add("negative", F.coalesce(V.text_at(rec, "negative_prompt"), F.lit("")))
    start = facts.measure(records).select(
        "source_file",
        "line_num",
        "pos",
        "rec",
        *facts.names,
        text.word_count(prompt).alias("_words"),
        text.word_count(negative).alias("_negative_words"),
        *[c.alias(name) for name, c in scalars.items()],
        *[F.coalesce(V.text_at(rec, f), F.lit("")).alias(f"_{f}") for f in _ENUMS],
        V.text_at(rec, "subcategory").alias("_subcategory"),
        F.when(V.is_array(V.type_at(rec, "tags")), V.strings_at(rec, "tags")).alias("_tags"),
        V.strings_at(rec, "acceptance_criteria").alias("_criteria"),
        V.text_at(rec, "id").alias("id"),
        V.text_at(rec, "title").alias("_title"),
        V.text_at(rec, "slug").alias("_slug"),
    )
    enums = start.withColumns({f: map_enum(F.col(f"_{f}"), *args) for f, args in _ENUMS.items()})
    category, difficulty = F.col("category"), F.col("difficulty")
    # A record without any tags field is padded like one with an empty list.
    tags = F.when(V.at(rec, "tags").isNull(), F.array().cast("array<string>")).otherwise(F.col("_tags"))
    subcategory = F.coalesce("_subcategory", F.lit(vocab.SUBCATEGORY_DEFAULT))
    merged = enums.withColumn("_merged", merge_tags(tags, category, subcategory, difficulty))

    n_criteria = F.coalesce(F.size("_criteria"), F.lit(0))
    n_tags = F.coalesce(F.size("_tags"), F.lit(0))
    fired = {
        **{f: ~F.col(f"_{f}").isin(*args[0]) for f, args in _ENUMS.items()},
        **objects_changed,
        "acceptance_criteria": ~n_criteria.between(*vocab.CRITERIA_ITEMS),
        "tags": ~n_tags.between(*vocab.TAG_ITEMS),
        "prompt": ~F.col("_words").between(*vocab.PROMPT_WORDS),
        "negative_prompt": (F.col("_negative_words") > vocab.NEGATIVE_WORDS_MAX) | (negative == ""),
        "version": F.col("_version").isNull(),
        "subcategory": F.coalesce("_subcategory", F.lit("")) == "",
        "industry": F.col("_industry").isNull(),
        "created_by_agent": F.col("_created_by_agent").isNull(),
        "batch": F.col("_batch").isNull(),
        "slug": F.coalesce("_slug", F.lit("")) == "",
        "title": F.coalesce("_title", F.lit("")) == "",
    }
    known = F.lit(list(vocab.RECORD_FIELDS))
    everything = V.map_at(rec)
    return merged.select(
        "source_file",
        "line_num",
        "pos",
        "id",
        F.coalesce("_version", F.lit(vocab.VERSION_DEFAULT)).alias("version"),
        "category",
        text.or_default(F.col("_subcategory"), F.lit(vocab.SUBCATEGORY_DEFAULT)).alias("subcategory"),
        F.col("_title").alias("title"),
        slug_or_from_title(F.col("_slug"), F.col("_title")).alias("slug"),
        "language",
        "difficulty",
        "audience",
        "use_case",
        F.coalesce("_industry", F.lit(vocab.INDUSTRY_DEFAULT)).alias("industry"),
        objects["style"],
        objects["tech_stack"],
        repair_text(prompt, n_words=F.col("_words")).alias("prompt"),
        repair_secondary_text(negative, n_words=F.col("_negative_words")).alias("negative_prompt"),
        repair_list(F.col("_criteria"), vocab.CRITERIA_DEFAULTS, vocab.CRITERIA_ITEMS[1]).alias(
            "acceptance_criteria"
        ),
        normalise_tags(F.col("_merged"), category).alias("tags"),
        objects["website_card"],
        objects["quality"],
        F.coalesce("_created_by_agent", F.concat(category, F.lit(vocab.AGENT_SUFFIX))).alias(
            "created_by_agent"
        ),
        F.coalesce("_batch", F.concat(category, F.lit(vocab.BATCH_SUFFIX))).alias("batch"),
        F.array_compact(F.array(*[F.when(hit, F.lit(name)) for name, hit in fired.items()])).alias("repairs"),
        F.map_filter(everything, lambda k, _: ~F.array_contains(known, k)).alias("extra"),
    )


def repair_records(records: DataFrame) -> DataFrame:
    """Repaired records with unique slugs and titles, in the shape of the input rows.

    Names are settled on narrow rows that are kept in the shared folder, so records
    are parsed twice: for their names and for the result. Only names that change are
    joined back.
    """
    fields = repair_fields(records)
    buckets = dense_buckets()  # pos counts lines
    names = cut_lineage(fields.select("pos", "slug", "title"))
    slugs = unique_slugs(names, "slug", "pos", buckets).filter("name <> final_name").select(
        "pos", F.col("final_name").alias("_new_slug")
    )
    numbered = names.join(record_numbers(names, "pos", buckets), "pos")
    titles = (
        unique_titles(numbered, "title", "pos", "number", buckets)
        .join(names.select("pos", "title"), "pos")
        .filter(~F.equal_null(F.col("title"), F.col("final_name")))
        .select("pos", F.col("final_name").alias("_new_title"))
    )
    renamed = F.array_compact(
        F.array(
            F.when(F.col("_new_slug").isNotNull(), F.lit("slug")),
            F.when(F.col("_new_title").isNotNull(), F.lit("title")),
        )
    )
    return (
        fields.join(slugs, "pos", "left")
        .join(titles, "pos", "left")
        .withColumn("slug", F.coalesce("_new_slug", "slug"))
        .withColumn("title", F.coalesce("_new_title", "title"))
        .withColumn("repairs", F.array_union("repairs", renamed))
        .drop("_new_slug", "_new_title")
    )


def repair_counters(lines: DataFrame, repaired: DataFrame) -> DataFrame:
    """Per file: lines read, records changed, lines skipped. Fences count in none."""
    read = lines.filter(F.coalesce("reason", F.lit("")) != "fence").groupBy("source_file").agg(
        F.count(F.lit(1)).alias("total"), F.count("reason").alias("skipped")
    )
    fixed = repaired.groupBy("source_file").agg(
        F.count_if(F.size("repairs") > 0).alias("fixed")
    )
    return read.join(fixed, "source_file", "left").select(
        "source_file", "total", F.coalesce("fixed", F.lit(0)).alias("fixed"), "skipped"
    )
