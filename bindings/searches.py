"""Published shapes, search and lookup over records derived from ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import vocab
from tidemark.functions import text
from tidemark.operators import index as idx, lookups, search
from tidemark.session import scratch_dir
from tidemark.sources.tables import read_table

from . import query, sqltext as q
from .records import REC, typed

_EMPTY = "coalesce({0}, '')"


@query(
    f"""WITH {REC} SELECT id, title, slug, category, subcategory, difficulty, title AS headline, summary,
      array_to_string(tags, '|') AS tags, lang || '|' || source AS search_keywords FROM rec"""
)
def flat_index(spark, folder):
    return idx.flat_items(typed(spark, folder)).withColumns(
        {c: F.array_join(c, "|") for c in ("tags", "search_keywords")}
    )


@query(
    f"""WITH {REC} SELECT '1.0.0' AS version, count(*) AS total_items, 'fixed' AS generated_at,
      count(DISTINCT source) AS source_files FROM rec"""
)
def flat_index_header(spark, folder):
    return idx.flat_meta(typed(spark, folder), "1.0.0", "fixed")


_HAY = """lower(title || ' ' || title || ' ' || summary || ' ' || framework || ' ' || coalesce(industry, '') || ' ' || subcategory || ' ' || audience
      || CASE WHEN len(tags) > 0 THEN ' ' || array_to_string(tags, ' ') ELSE '' END || ' ' || lang || ' ' || source)"""
_INDEX = f"""{REC}, ix AS (SELECT doc_id AS pos, id, title AS t, slug AS s, category AS c, subcategory AS sc, difficulty AS d,
      audience AS a, industry AS "in", framework AS fw, animation AS an, language AS lang, tags, title AS hl, summary AS sum,
      lang AS pl, lang || '|' || source AS kw, doc_id % 9 + 2 AS q, {_HAY} AS haystack FROM rec)"""


def compact(spark, folder):
    return idx.compact_items(typed(spark, folder))


@query(
    f"""WITH {_INDEX} SELECT pos, id, t, s, c, sc, d, a, "in", fw, an, lang, array_to_string(tags, '|') AS tags, hl, sum, pl, kw,
      CAST(q AS INT) AS q, md5(haystack) AS haystack FROM ix"""
)
def compact_index(spark, folder):
    return compact(spark, folder).withColumns(
        {"tags": F.array_join("tags", "|"), "kw": F.array_join("kw", "|"), "haystack": F.md5("haystack")}
    )


@query(
    f"""WITH {REC} SELECT doc_id AS pos, id, summary,
      array_to_string(list_filter([framework, 'TypeScript', 'CSS', animation, CASE WHEN doc_id % 4 = 0 THEN '' ELSE source END], lambda x: x <> ''), '|') AS chips,
      'Visual=plain look|Layout=' || CASE WHEN doc_id % 11 = 1 THEN '' ELSE 'one column' END || '|Farben=blue tones|Motion='
        || CASE WHEN doc_id % 11 = 0 THEN '' ELSE 'calm moves' END AS style,
      'Specificity=' || (doc_id % 12) || '.0|Originality=7.0|Clarity=' || (doc_id % 10 + 1) || '.0|Readiness=' || (doc_id % 9 + 2) || '.0' AS scores
    FROM rec"""
)
def detail_view(spark, folder):
    pairs = lambda c: F.array_join(F.transform(c, lambda p: F.concat(p["name"], F.lit("="), F.coalesce(p["value"], F.lit("")))), "|")
    return idx.detail_items(typed(spark, folder)).select(
        "pos", "id", "summary", F.array_join("chips", "|").alias("chips"), pairs("style").alias("style"), pairs("scores").alias("scores")
    )


_LABELS = " ".join(f"WHEN c = {q.lit(k)} THEN {q.lit(label)}" for k, label, _ in vocab.CATEGORY_DIMENSION)
_LEVELS = " ".join(f"WHEN d = {q.lit(k)} THEN {q.lit(label)}" for k, label, _ in vocab.DIFFICULTY_DIMENSION)


@query(
    f"""WITH {_INDEX} SELECT pos, id, t AS title, CASE {_LABELS} ELSE 'Landing Pages' END AS category_label,
      CASE {_LEVELS} ELSE 'Intermediate' END AS difficulty_label, CASE WHEN hl = '' THEN sum ELSE hl END AS text,
      fw AS framework, printf('%.1f', CAST(q AS DOUBLE)) AS score, pl AS copy_text FROM ix"""
)
def card_view(spark, folder):
    cards = idx.card_items(compact(spark, folder), idx.category_dimension(spark), idx.difficulty_dimension(spark))
    return cards.drop("tags")


def _search_sql(where: str, order: str, offset: int = 0, size: int = 48) -> str:
    return f"""WITH {_INDEX} SELECT pos, id, t, CAST(q AS INT) AS q FROM ix WHERE {where} ORDER BY {order} LIMIT {size} OFFSET {offset}"""


def _found(rows):
    return rows.select("pos", "id", "t", "q")


@query(_search_sql("c = 'ecommerce' AND lang = 'en' AND a = 'founder'", "pos"))
def search_by_facets(spark, folder):
    wanted = search.Query(filters={"category": "ecommerce", "language": "en", "audience": "founder", "difficulty": None})
    return _found(search.page(search.matching(compact(spark, folder), wanted)))


@query(_search_sql("contains(haystack, 'src1')", "pos"))
def search_by_text(spark, folder):
    rows, _ = search.search(compact(spark, folder), search.Query("  SRC1 "))
    return _found(rows)


@query(_search_sql("contains(haystack, 'ing')", "coalesce(q, 0) DESC, pos"))
def search_by_quality(spark, folder):
    rows, _ = search.search(compact(spark, folder), search.Query("ing", sort="quality"))
    return _found(rows)


@query(_search_sql("fw = 'React'", "t COLLATE de, pos"))
def search_in_title_order(spark, folder):
    rows, _ = search.search(compact(spark, folder), search.Query("", {"framework": "React"}, "az"))
    return _found(rows)


@query(_search_sql("fw = 'Vue'", "pos", offset=48))
def search_second_page(spark, folder):
    rows, _ = search.search(compact(spark, folder), search.Query(filters={"framework": "Vue"}), number=1)
    return _found(rows)


@query(_search_sql("q < 9 OR (q = 9 AND pos > 250)", "q DESC, pos"))
def search_after_row(spark, folder):
    return _found(search.page(compact(spark, folder), "quality", after=(9, 250)))


@query(f"WITH {_INDEX} SELECT count(*) AS n FROM ix WHERE d = 'expert' AND contains(haystack, 'en')")
def search_count(spark, folder):
    _, n = search.search(compact(spark, folder), search.Query("en", {"difficulty": "expert"}))
    return n


@query("SELECT doc_id AS id, doc_id AS pos, lang AS category, md5(text) AS digest FROM documents WHERE doc_id = 77")
def point_lookup(spark, folder):
    docs = read_table(spark, f"{folder}/documents.parquet")
    index = docs.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("pos"), F.col("lang").alias("c"))
    records = docs.select(
        F.col("doc_id").alias("id"), F.col("doc_id").alias("pos"), F.col("lang").alias("category"), "text"
    )
    return search.find_record(index, records, 77).select("id", "pos", "category", F.md5("text").alias("digest"))


@query(
    f"""SELECT p_partkey, {q.humanize("replace(p_name, ' ', '_') || '-' || lower(p_type)")} AS label,
      replace(format('{{:,}}', p_partkey * 1234), ',', '.') AS grouped,
      replace(printf('%.2f', p_retailprice), '.', ',') AS price FROM part"""
)
def display_formats(spark, folder):
    part = read_table(spark, f"{folder}/part.parquet")
    name = F.concat(F.translate("p_name", " ", "_"), F.lit("-"), F.lower("p_type"))
    return part.select(
        "p_partkey", text.humanize(name).alias("label"),
        text.grouped_number(F.col("p_partkey") * 1234).alias("grouped"),
        text.comma_decimal(F.col("p_retailprice")).alias("price"),
    )


@query(
    """SELECT p_partkey, lower(p_name || ' ' || p_type || ' ' || p_brand || ' ' || array_to_string(string_split(p_name, ' '), ' ')) AS haystack FROM part"""
)
def haystacks(spark, folder):
    part = read_table(spark, f"{folder}/part.parquet")
    hay = text.haystack([F.col("p_name"), F.col("p_type"), F.col("p_brand")], [F.split("p_name", " ")])
    return part.select("p_partkey", hay.alias("haystack"))


@query(
    f"""SELECT doc_id, md5({q.slug('text')}) AS slug,
      {q.opening('text')} AS opening, md5({q.token_bag('text')}) AS bag FROM documents"""
)
def text_keys(spark, folder):
    docs = read_table(spark, f"{folder}/documents.parquet", spread_by="doc_id")
    return docs.select(
        "doc_id", F.md5(text.slugify(F.col("text"))).alias("slug"), text.first_words(F.col("text")).alias("opening"),
        F.md5(text.token_bag(F.col("text"))).alias("bag"),
    )


@query(_search_sql("contains(haystack, 'src1')", "pos"))
def search_by_postings(spark, folder):
    """Free text through posting lists written from all documents."""
    path = scratch_dir(spark, "text-index")
    lookups.write_text_index(compact(spark, folder), path)
    return _found(search.page(lookups.search_text(spark, path, search.Query(" SRC1"))))


@query("SELECT doc_id AS id, lang AS category, md5(text) AS digest FROM documents WHERE doc_id = 77")
def point_lookup_by_bucket(spark, folder):
    path = scratch_dir(spark, "lookup")
    docs = read_table(spark, f"{folder}/documents.parquet")
    lookups.write_lookup(docs.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("pos"), F.col("lang").alias("category"), "text"), path)
    return lookups.look_up(spark, path, 77).select("id", "category", F.md5("text").alias("digest"))


@query(_search_sql("true", "q DESC, pos", offset=96))
def page_by_rank(spark, folder):
    """The third page by quality, a range of materialised ranks."""
    path = scratch_dir(spark, "ranks")
    lookups.write_ranks(compact(spark, folder), path)
    return _found(lookups.ranked_page(spark, path, "quality", 2))
