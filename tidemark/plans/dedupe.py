"""Duplicate analysis job: five key groupings and near-duplicate pairs over one frame."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import vocab
from ..functions import text, variants as V
from ..operators import dups, gates, nearpairs
from ..operators.ordering import Buckets, dense_buckets, join_per_key, measure_buckets, running_sum
from ..session import cut_lineage
from ..sources import jsonl, sinks
from ..spec import RECORDS, RecordSpec


def report_members(rows: DataFrame, buckets: Buckets, n: int | None = None) -> DataFrame:
    """(key, pos, id, n, first_pos, nth): all members, numbered in input order, of the groups a
    report names: the ``n`` seen first, or all. ``rows`` is read twice."""
    heads = dups.groups(rows)
    if n is not None:
        heads = heads.orderBy("first_pos").limit(n)
    return running_sum(join_per_key(rows, heads, "key", "pos"), ["key"], "pos", "nth", buckets)


@dataclass(frozen=True)
class Duplicates:
    """``keyed`` has narrow rows per key kind; the other parts are findings."""

    keyed: dict[str, DataFrame]
    groups: dict[str, DataFrame]
    openings: DataFrame
    pairs: DataFrame
    buckets: Buckets

    @property
    def status(self) -> DataFrame:
        found = gates.duplicate_status({**self.groups, "openings": self.openings, "pairs": self.pairs})
        total = self.keyed["slug"].agg(F.count(F.lit(1))).scalar()
        return found.withColumn("total_analysed", total)

    def members(self) -> dict[str, DataFrame]:
        """Every member of every group: (key, pos, id, n, first_pos)."""
        return {k: dups.members(rows) for k, rows in self.keyed.items()}

    def largest(self, n: int = 10) -> dict[str, DataFrame]:
        """The most repeated titles and openings."""
        return {
            "titles": dups.largest(self.groups["title"], n),
            "openings": self.openings.orderBy(F.col("uses").desc(), "opening").limit(n),
        }

    def report_ids(self) -> dict[str, DataFrame]:
        """All ids of the report's entries, one row per id, numbered in input order: of every
        fingerprint group, and of the title and slug groups that were seen first."""
        n = vocab.REPORT_DETAILS_MAX

        def listed(kind, label, entries, chars):
            found = report_members(self.keyed[kind], self.buckets, entries)
            return found.select(F.left("key", F.lit(chars)).alias(label), F.col("n").alias("occurrences"), "nth", "id")

        return {
            "fingerprints": listed("fingerprint", "hash", None, 16),
            "titles": listed("title", "title", n, 80),
            "slugs": listed("slug", "slug", n, 2**31 - 1),
        }

    def details(self) -> dict[str, DataFrame]:
        """Capped report lists, in order of first appearance; openings by use."""
        n = vocab.REPORT_DETAILS_MAX

        sentences = dups.group_heads(self.keyed["first_sentence"], vocab.REPORT_SENTENCE_IDS_MAX, carry="sentence")
        return {
            "sentences": sentences.orderBy("first_pos").limit(n).select(
                "sentence", "ids", F.col("n").alias("occurrences")
            ),
            "openings": self.openings.orderBy(F.col("uses").desc(), "opening").limit(n),
            "pairs_listed": self.pairs.orderBy("category", "pos1", "pos2").limit(vocab.REPORT_PAIRS_MAX).select(
                "id1", "id2", "similarity", "category"
            ),
        }


def record_frame(decoded: jsonl.Decoded) -> DataFrame:
    """Fields the analysis needs; missing texts are empty, a missing id is made from the line."""
    rec = "rec"
    empty = F.lit("")
    return decoded.records.select(
        "pos",
        F.coalesce(V.text_at(rec, "id"), F.concat(F.lit("unknown_"), F.col("line_num").cast("string"))).alias("id"),
        *[F.coalesce(V.text_at(rec, f), empty).alias(f) for f in ("title", "slug", "prompt")],
        F.coalesce(V.text_at(rec, "category"), F.lit("unknown")).alias("category"),
    )


def analyse(df: DataFrame, spec: RecordSpec = RECORDS, buckets: Buckets | None = None) -> Duplicates:
    """Findings over ``df``. Starts jobs: keys and candidate pairs are computed and kept. Keys are made from the texts once and kept as narrow rows."""
    keys = dups.key_columns(spec)
    opening = text.first_words(F.coalesce(F.col(spec.text), F.lit("")))
    buckets = buckets or measure_buckets(df, spec.pos)
    narrow = cut_lineage(
        df.select(
            F.col(spec.pos).alias("pos"), F.col(spec.id).alias("id"),
            *[c.alias(f"key_{kind}") for kind, c in keys.items()], opening.alias("opening"),
            F.left(text.first_sentence(F.coalesce(F.col(spec.text), F.lit(""))), F.lit(100)).alias("sentence"),
        )
    )
    shown = {"first_sentence": ["sentence"]}
    keyed = {kind: dups.keyed(narrow, F.col(f"key_{kind}"), "pos", "id", *shown.get(kind, [])) for kind in keys}
    return Duplicates(
        keyed=keyed,
        groups={kind: dups.groups(rows) for kind, rows in keyed.items()},
        openings=dups.overused(narrow, "opening"),
        pairs=nearpairs.near_pairs(df, spec, buckets=buckets),
        buckets=buckets,
    )


def run(spark: SparkSession, source: str, target: str) -> str:
    """Analyse a folder of JSONL files, write the report, return the overall status."""
    frame = record_frame(jsonl.read_records(spark, source)).persist()
    try:
        found = analyse(frame, buckets=dense_buckets())
        sinks.write_duplicate_report(found.status, found.details(), found.report_ids(), found.members(), target)
        for kind, groups in found.groups.items():
            groups.write.parquet(f"{target}/groups/{kind}")
        found.pairs.write.parquet(f"{target}/pairs")
        return spark.read.json(f"{target}/summary").first().overall_status
    finally:
        frame.unpersist()
