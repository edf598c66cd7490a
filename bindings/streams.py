"""Streams that read the given tables until they are used up."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import profile
from tidemark.session import scratch_dir
from tidemark.sources import publication
from tidemark.sources.tables import read_table, stream_table
from tidemark.streaming import counts, first_seen, ingest

from . import query, sqltext as q
from .records import LINES, record_lines


def _document_stream(spark, folder):
    return stream_table(spark, f"{folder}/documents.parquet")


def _fresh(spark) -> str:
    return scratch_dir(spark, "stream")


@query(f"WITH k AS (SELECT DISTINCT sha256({q.token_bag('text')}) AS fingerprint FROM documents) SELECT fingerprint FROM k")
def stream_unique_fingerprints(spark, folder):
    out = _fresh(spark)
    docs = _document_stream(spark, folder)
    unique = ingest.first_by_fingerprint(docs, F.col("text"), None, spread_by=F.col("doc_id")).select("fingerprint")
    ingest.table_sink(unique, f"{out}/rows", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/rows")


@query(
    f"""WITH k AS (SELECT DISTINCT sha256({q.token_bag("event_type || ' of ' || chr(CAST(97 + user_id % 26 AS INT)) || 'user'")}) AS fingerprint
      FROM events) SELECT fingerprint FROM k"""
)
def stream_unique_events(spark, folder):
    """With a watermark: state of an event is dropped a year after it was last seen."""
    out = _fresh(spark)
    events = stream_table(spark, f"{folder}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    content = F.concat("event_type", F.lit(" of "), F.char((F.col("user_id") % 26 + 97).cast("int")), F.lit("user"))
    unique = ingest.first_by_fingerprint(events, content, "ts", "365 days", spread_by=F.col("event_id")).select("fingerprint")
    ingest.table_sink(unique, f"{out}/rows", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/rows")


@query(
    f"""WITH {LINES} SELECT source || '.jsonl' AS source_file, reason, count(*) AS n FROM lines
    WHERE reason IN ('json', 'fence', 'not_object') GROUP BY 1, 2"""
)
def stream_quarantine(spark, folder):
    out = _fresh(spark)
    lines = record_lines(_document_stream(spark, folder), damaged=True)
    ingest.validated_sink(lines, out, f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    bad = spark.read.parquet(f"{out}/quarantine")
    return bad.groupBy("source_file", "reason").agg(F.count(F.lit(1)).alias("n"))


_COUNTS = """SELECT 'lang' AS facet, lang AS value, count(*) AS n FROM documents WHERE lang <> '' GROUP BY lang
    UNION ALL SELECT 'source', source, count(*) FROM documents WHERE source <> '' GROUP BY source"""


def _facets(docs):
    return profile.facet_counts(docs, {"lang": F.col("lang"), "source": F.col("source")})


@query(_COUNTS)
def stream_facet_counts(spark, folder):
    """Counts kept per batch and folded, read from the fold."""
    out = _fresh(spark)
    sink = counts.counted_sink(_document_stream(spark, folder), _facets, out, f"{out}/state", fold_every=1)
    sink.trigger(availableNow=True).start().awaitTermination()
    return counts.read_counts(spark, out)


@query(
    f"""WITH {LINES}, rec AS (SELECT * FROM lines WHERE reason IS NULL),
    file AS (SELECT source || '.jsonl' AS value, reason FROM lines WHERE coalesce(reason, '') <> 'blank')
    SELECT 'language' AS facet, lang AS value, count(*) AS n FROM rec GROUP BY lang
    UNION ALL SELECT 'lines', value, count(*) FROM file GROUP BY value
    UNION ALL SELECT 'valid', value, count(*) FROM file WHERE reason IS NULL GROUP BY value
    UNION ALL SELECT 'invalid', value, count(*) FROM file WHERE reason IS NOT NULL GROUP BY value"""
)
def stream_record_counts(spark, folder):
    """Counts of arriving records by language and of lines by file."""
    out = _fresh(spark)
    lines = record_lines(_document_stream(spark, folder), damaged=True)
    sink = counts.counted_sink(lines, counts.record_counts, out, f"{out}/state")
    sink.trigger(availableNow=True).start().awaitTermination()
    return counts.read_counts(spark, out).filter(~F.col("facet").isin("category", "difficulty"))


@query(
    """SELECT doc_id, seen_at FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS seen_at
      FROM documents WHERE text IS NOT NULL) WHERE doc_id > seen_at"""
)
def stream_first_seen(spark, folder):
    """Documents whose text arrived before, with the first one's id."""
    out = _fresh(spark)
    docs = _document_stream(spark, folder).select(
        F.sha2(F.col("text"), 256).alias("key"), F.col("doc_id").alias("order"), F.col("doc_id").alias("place")
    )
    first_seen.first_seen_sink(docs, out, f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return first_seen.read_repeats(spark, out).select(F.col("order").alias("doc_id"), "seen_at")


@query(_COUNTS)
def published_counts(spark, folder):
    """Counts published by a job that ended; one that failed after it is not seen."""
    out = _fresh(spark)
    docs = read_table(spark, f"{folder}/documents.parquet")

    def whole(path):
        _facets(docs).write.parquet(f"{path}/counts")

    def cut_off(path):
        _facets(docs.filter(F.col("doc_id") < 0)).write.parquet(f"{path}/counts")
        raise InterruptedError

    publication.publish(spark, out, whole)
    try:
        publication.publish(spark, out, cut_off)
    except InterruptedError:
        pass
    return spark.read.parquet(f"{publication.current(spark, out)}/counts")
