"""Duplicate analysis over documents (text, language) and part (names)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import dups, gates, nearpairs, ordering, uniquify
from tidemark.plans.dedupe import report_members
from tidemark.session import cut_lineage
from tidemark.sources.tables import read_table
from tidemark.spec import RecordSpec

from . import query, sqltext as q

DOCS = RecordSpec(id="doc_id", pos="doc_id", text="text", title="title", slug="slug", category="lang", unique_ids=True)


def documents(spark, folder):
    return read_table(spark, f"{folder}/documents.parquet", spread_by="doc_id")


def part(spark, folder):
    return read_table(spark, f"{folder}/part.parquet")


def cells(df, pos):
    return ordering.measure_buckets(df, pos)


def _keyed_docs(spark, folder, key):
    return dups.keyed(documents(spark, folder), key, "doc_id", "doc_id")


def _kept_keys(spark, folder, key):
    """Keys made from the texts once, for queries that read them more than once."""
    return cut_lineage(_keyed_docs(spark, folder, key))


_FP = f"SELECT doc_id, sha256({q.token_bag('text')}) AS h FROM documents"


@query(
    f"""WITH fp AS ({_FP})
    SELECT left(h, 16) AS hash, count(*) AS n, min(doc_id) AS first_id
    FROM fp GROUP BY h HAVING count(*) > 1"""
)
def fingerprint_groups(spark, folder):
    groups = dups.groups(_keyed_docs(spark, folder, text.fingerprint(F.col("text"))))
    return groups.select(F.left("key", F.lit(16)).alias("hash"), "n", F.col("first_pos").alias("first_id"))


@query(
    f"""WITH fp AS ({_FP})
    SELECT left(h, 16) AS hash, doc_id, n FROM
      (SELECT h, doc_id, count(*) OVER (PARTITION BY h) AS n FROM fp) WHERE n > 1"""
)
def fingerprint_members(spark, folder):
    rows = _kept_keys(spark, folder, text.fingerprint(F.col("text")))
    found = dups.members(rows)
    return found.select(F.left("key", F.lit(16)).alias("hash"), F.col("id").alias("doc_id"), "n")


@query(
    f"""WITH s AS (SELECT doc_id, {q.first_sentence('text')} AS k FROM documents),
    g AS (SELECT k, count(*) AS n, list(doc_id ORDER BY doc_id) AS ids FROM s GROUP BY k HAVING count(*) > 1)
    SELECT left(k, 100) AS sentence, n, array_to_string(list_slice(ids, 1, 10), ',') AS first_ids FROM g"""
)
def first_sentence_groups(spark, folder):
    sentence = text.first_sentence(F.col("text"))
    docs = documents(spark, folder).withColumn("sentence", F.left(sentence, F.lit(100)))
    rows = cut_lineage(dups.keyed(docs, F.sha2(sentence, 256), "doc_id", "doc_id", "sentence"))
    return dups.group_heads(rows, 10, carry="sentence").select(
        "sentence", "n",
        F.array_join(F.col("ids").cast("array<string>"), ",").alias("first_ids"),
    )


@query(
    f"""WITH fp AS ({_FP})
    SELECT left(h, 16) AS hash, n, nth, doc_id FROM (SELECT h, doc_id, count(*) OVER (PARTITION BY h) AS n,
      row_number() OVER (PARTITION BY h ORDER BY doc_id) AS nth FROM fp) WHERE n > 1"""
)
def fingerprint_report(spark, folder):
    """Entries of the report, one row per id."""
    rows = _kept_keys(spark, folder, text.fingerprint(F.col("text")))
    return report_members(rows, cells(rows, "pos")).select(
        F.left("key", F.lit(16)).alias("hash"), "n", "nth", F.col("id").alias("doc_id")
    )


@query(
    """WITH g AS (SELECT p_name, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1 ORDER BY min(p_partkey) LIMIT 50)
    SELECT left(p_name, 80) AS title, n AS occurrences, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS nth, p_partkey
    FROM part JOIN g USING (p_name)"""
)
def title_report(spark, folder):
    """Entries of the report's titles, one row per id."""
    rows = cut_lineage(dups.keyed(part(spark, folder), F.col("p_name"), "p_partkey", "p_partkey"))
    return report_members(rows, cells(rows, "pos"), 50).select(
        F.left("key", F.lit(80)).alias("title"), F.col("n").alias("occurrences"), "nth", F.col("id").alias("p_partkey")
    )


@query(
    """WITH k AS (SELECT coalesce(CASE WHEN p_size % 7 > 0 THEN p_name END, '') AS title, p_partkey FROM part)
    SELECT title, count(*) AS n, min(p_partkey) AS first_key FROM k GROUP BY 1 HAVING count(*) > 1"""
)
def missing_key_groups(spark, folder):
    """Missing titles form one group, that of the empty title."""
    title = F.when(F.col("p_size") % 7 > 0, F.col("p_name"))
    found = dups.groups(dups.keyed(part(spark, folder), title, "p_partkey", "p_partkey"))
    return found.select(F.col("key").alias("title"), "n", F.col("first_pos").alias("first_key"))


@query(
    f"""WITH fp AS ({_FP})
    SELECT left(h, 16) AS hash, nth, doc_id FROM (SELECT h, doc_id, count(*) OVER (PARTITION BY h) AS n,
      row_number() OVER (PARTITION BY h ORDER BY doc_id) AS nth FROM fp) WHERE n > 1"""
)
def fingerprint_report_ids(spark, folder):
    """All ids of the report's entries, in long form."""
    rows = _kept_keys(spark, folder, text.fingerprint(F.col("text")))
    found = report_members(rows, cells(rows, "pos"))
    return found.select(F.left("key", F.lit(16)).alias("hash"), "nth", F.col("id").alias("doc_id"))


def _part_ids(key: str) -> str:
    return f"""WITH k AS (SELECT {key} AS k, p_partkey FROM part),
    g AS (SELECT k FROM k GROUP BY k HAVING count(*) > 1 ORDER BY min(p_partkey) LIMIT 50)
    SELECT left(k, 80) AS key, row_number() OVER (PARTITION BY k ORDER BY p_partkey) AS nth, p_partkey FROM k JOIN g USING (k)"""


def _part_report_ids(spark, folder, key):
    rows = cut_lineage(dups.keyed(part(spark, folder), key, "p_partkey", "p_partkey"))
    found = report_members(rows, cells(rows, "pos"), 50)
    return found.select(F.left("key", F.lit(80)).alias("key"), "nth", F.col("id").alias("p_partkey"))


@query(_part_ids("p_name"))
def title_report_ids(spark, folder):
    return _part_report_ids(spark, folder, F.col("p_name"))


@query(_part_ids(q.slug("p_name || '/' || p_brand")))
def slug_report_ids(spark, folder):
    return _part_report_ids(spark, folder, text.slugify(F.concat_ws("/", "p_name", "p_brand")))


@query("SELECT p_name AS title, count(*) AS n, min(p_partkey) AS first_key FROM part GROUP BY 1 HAVING count(*) > 1")
def title_groups(spark, folder):
    rows = dups.keyed(part(spark, folder), F.col("p_name"), "p_partkey", "p_partkey")
    return dups.groups(rows).select(F.col("key").alias("title"), "n", F.col("first_pos").alias("first_key"))


@query(
    """SELECT p_name AS title, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1
    ORDER BY n DESC, min(p_partkey) LIMIT 10"""
)
def largest_title_groups(spark, folder):
    rows = dups.keyed(part(spark, folder), F.col("p_name"), "p_partkey", "p_partkey")
    return dups.largest(dups.groups(rows)).select(F.col("key").alias("title"), "n")


@query(
    f"""SELECT {q.slug("p_name || '/' || p_brand")} AS slug, count(*) AS n, min(p_partkey) AS first_key
    FROM part GROUP BY 1 HAVING count(*) > 1"""
)
def slug_groups(spark, folder):
    slug = text.slugify(F.concat_ws("/", "p_name", "p_brand"))
    rows = dups.keyed(part(spark, folder), slug, "p_partkey", "p_partkey")
    return dups.groups(rows).select(F.col("key").alias("slug"), "n", F.col("first_pos").alias("first_key"))


@query(
    f"""SELECT opening, count(*) AS uses FROM (SELECT {q.opening('text')} AS opening FROM documents)
    GROUP BY 1 HAVING count(*) > 5"""
)
def overused_openings(spark, folder):
    return dups.overused_openings(documents(spark, folder), "text")


@query(
    """SELECT 'text' AS kind, count(*) AS n_rows, count(DISTINCT text) AS n_keys,
      count(*) - count(DISTINCT text) AS n_surplus FROM documents
    UNION ALL SELECT 'source', count(*), count(DISTINCT source), count(*) - count(DISTINCT source) FROM documents"""
)
def duplicate_surplus(spark, folder):
    # The digest keeps long texts out of the shuffle.
    keys = {"text": F.sha2("text", 256), "source": F.col("source")}
    return dups.surplus(documents(spark, folder), keys)


@query(
    """SELECT * FROM (SELECT p_partkey, p_name AS title,
        first_value(p_partkey) OVER (PARTITION BY p_name ORDER BY p_partkey) AS first_seen FROM part)
    WHERE p_partkey <> first_seen"""
)
def first_seen_annotation(spark, folder):
    rows = dups.keyed(part(spark, folder), F.col("p_name"), "p_partkey", "p_partkey")
    return dups.later_occurrences(rows).select(
        F.col("pos").alias("p_partkey"), F.col("key").alias("title"), F.col("first_pos").alias("first_seen")
    )


_PAIRS = f"""WITH t AS (
      SELECT doc_id, lang, list_distinct({q.words('lower(text)')}) AS ws,
        row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM documents),
    p AS (SELECT l.doc_id AS id1, r.doc_id AS id2, l.lang AS category,
        len(list_intersect(l.ws, r.ws)) AS shared, len(l.ws) + len(r.ws) AS n_both
      FROM t l JOIN t r ON l.lang = r.lang AND r.rn > l.rn AND r.rn <= l.rn + 49)
    SELECT category, id1, id2, CAST(shared AS INT) AS shared, CAST(n_both - shared AS INT) AS total,
      CAST(printf('%.3f', shared / (n_both - shared)) AS DOUBLE) AS similarity
    FROM p WHERE shared * 10 > (n_both - shared) * 7"""


@query(_PAIRS)
def near_duplicate_pairs(spark, folder):
    docs = documents(spark, folder)
    return nearpairs.near_pairs(docs, DOCS, buckets=cells(docs, "doc_id")).drop("pos1", "pos2")


def _sections(spark, folder):
    docs = documents(spark, folder)
    return {
        "fingerprint": dups.groups(dups.keyed(docs, text.fingerprint(F.col("text")), "doc_id", "doc_id")),
        "first_sentence": dups.groups(dups.keyed(docs, F.sha2(text.first_sentence(F.col("text")), 256), "doc_id", "doc_id")),
        "title": dups.groups(dups.keyed(part(spark, folder), F.col("p_name"), "p_partkey", "p_partkey")),
        "openings": dups.overused_openings(docs, "text"),
    }


@query(
    f"""SELECT *, CASE WHEN fingerprint + first_sentence + title + openings = 0 THEN 'CLEAN' ELSE 'NEEDS_REVIEW' END AS overall_status,
      CASE WHEN fingerprint + title = 0 THEN 'PASS' ELSE 'NEEDS_REVIEW' END AS key_status
    FROM (SELECT
      (SELECT count(*) FROM (SELECT h FROM ({_FP}) GROUP BY h HAVING count(*) > 1)) AS fingerprint,
      (SELECT count(*) FROM (SELECT {q.first_sentence('text')} AS k FROM documents GROUP BY 1 HAVING count(*) > 1)) AS first_sentence,
      (SELECT count(*) FROM (SELECT p_name FROM part GROUP BY 1 HAVING count(*) > 1)) AS title,
      (SELECT count(*) FROM (SELECT {q.opening('text')} AS k FROM documents GROUP BY 1 HAVING count(*) > 5)) AS openings)"""
)
def duplicate_status(spark, folder):
    return gates.duplicate_status(_sections(spark, folder))


@query(
    f"""SELECT p_partkey, CASE WHEN j = 1 THEN s ELSE s || '-' || (j - 1) END AS slug FROM (
      SELECT p_partkey, s, row_number() OVER (PARTITION BY s ORDER BY p_partkey) AS j
      FROM (SELECT p_partkey, {q.slug('p_name')} AS s FROM part))"""
)
def unique_slugs(spark, folder):
    rows = part(spark, folder).select("p_partkey", text.slugify(F.col("p_name")).alias("slug"))
    return uniquify.unique_slugs(rows, "slug", "p_partkey", cells(rows, "p_partkey")).select(
        F.col("pos").alias("p_partkey"), F.col("final_name").alias("slug")
    )


@query(
    """WITH n AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS number,
        CASE WHEN p_size = 7 THEN NULL ELSE p_name END AS t FROM part)
    SELECT p_partkey, CASE WHEN t IS NULL THEN 'Untitled Prompt ' || number
        WHEN j = 1 THEN t ELSE t || ' (' || j || ')' END AS title
    FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY p_partkey) AS j FROM n)"""
)
def unique_titles(spark, folder):
    rows = part(spark, folder).select(
        "p_partkey", F.when(F.col("p_size") != 7, F.col("p_name")).alias("title")
    )
    found = cells(rows, "p_partkey")
    numbered = rows.join(
        uniquify.record_numbers(rows, "p_partkey", found).withColumnRenamed("pos", "p_partkey"), "p_partkey"
    )
    return uniquify.unique_titles(numbered, "title", "p_partkey", "number", found).select(
        F.col("pos").alias("p_partkey"), F.col("final_name").alias("title")
    )


@query(
    f"""WITH RECURSIVE n AS (
      SELECT p_partkey, {q.slug('p_name')} || CASE WHEN p_size % 5 = 0 THEN '-' || p_size ELSE '' END AS slug FROM part),
    r AS (SELECT *, regexp_replace(slug, '(-[1-9][0-9]*)+$', '') AS root FROM n),
    o AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY p_partkey) AS step FROM r),
    named AS (
      SELECT root, step, p_partkey, slug, slug AS unique_slug, [slug] AS taken FROM o WHERE step = 1
      UNION ALL
      SELECT root, step, p_partkey, slug, chosen, list_append(taken, chosen) FROM (
        SELECT o.root, o.step, o.p_partkey, o.slug, named.taken,
          CASE WHEN NOT list_contains(named.taken, o.slug) THEN o.slug
            ELSE list_filter(list_transform(range(1, o.step + 1), lambda k: o.slug || '-' || k),
              lambda s: NOT list_contains(named.taken, s))[1] END AS chosen
        FROM named JOIN o ON o.root = named.root AND o.step = named.step + 1))
    SELECT p_partkey, slug, unique_slug FROM named"""
)
def unique_slugs_with_numbered_originals(spark, folder):
    suffix = F.when(F.col("p_size") % 5 == 0, F.concat(F.lit("-"), F.col("p_size").cast("string"))).otherwise("")
    rows = part(spark, folder).select(
        "p_partkey", F.concat(text.slugify(F.col("p_name")), suffix).alias("slug")
    )
    return uniquify.unique_slugs(rows, "slug", "p_partkey", cells(rows, "p_partkey")).select(
        F.col("pos").alias("p_partkey"), F.col("name").alias("slug"), F.col("final_name").alias("unique_slug")
    )
