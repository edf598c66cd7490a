"""Validation job: scan, decode, check, annotate duplicates, count, decide, report.

Lines are parsed and checked once. The narrow outcome per line (keys, opening words,
broken rules) is kept in the shared folder; every count and report reads only that.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import text, variants as V
from ..operators import dups, gates, profile, rules
from ..session import cut_lineage
from ..sources import jsonl, sinks

KEYS = {"id": "ID", "slug": "slug", "title": "title"}


def check_lines(decoded: jsonl.Decoded) -> DataFrame:
    """Outcome per line: place, reason if unreadable, broken rules, keys, facets, opening."""
    rec = "rec"
    fields = ("id", "slug", "title", "category", "difficulty", "language")
    readable = F.col("reason").isNull()
    return rules.with_hits(decoded.lines).select(
        "source_file", "line_num", "pos", "reason", F.when(readable, F.col("hits")).alias("hits"),
        *[F.when(readable, V.text_at(rec, f)).alias(f) for f in fields],
        F.when(readable, text.first_words(F.coalesce(V.text_at(rec, "prompt"), F.lit("")))).alias("opening"),
    )


@dataclass(frozen=True)
class Validation:
    """Results over the checked lines."""

    checked: DataFrame
    thresholds: dict

    @property
    def valid(self) -> DataFrame:
        return self.checked.filter(F.col("reason").isNull() & rules.is_valid())

    @property
    def quarantine(self) -> DataFrame:
        return self.checked.filter(F.col("reason").isNotNull())

    @property
    def violations(self) -> DataFrame:
        out = rules.explode_hits(self.checked).unionByName(rules.unreadable_lines(self.quarantine))
        for field, label in KEYS.items():
            shown = 50 if field == "title" else None
            out = out.unionByName(rules.duplicate_keys(self.valid, field, label, shown))
        return out

    @property
    def counters(self) -> DataFrame:
        """Per file: non-blank lines, valid and invalid lines."""
        good = F.col("reason").isNull() & rules.is_valid()
        return self.checked.groupBy("source_file").agg(
            F.count(F.lit(1)).alias("lines"),
            F.count_if(good).alias("valid"),
            F.count_if(F.coalesce(~good, F.lit(True))).alias("invalid"),
        )

    @property
    def facets(self) -> DataFrame:
        """Counts by category, difficulty and language in one pass."""
        return profile.facet_counts(self.valid, {f: F.col(f) for f in ("category", "difficulty", "language")})

    def counts(self, facet: str) -> DataFrame:
        return self.facets.filter(F.col("facet") == facet).select(F.col("value").alias("key"), "n")

    @property
    def surplus(self) -> DataFrame:
        return dups.surplus(self.valid, {k: F.col(k) for k in KEYS})

    @property
    def openings(self) -> DataFrame:
        return dups.overused(self.valid, "opening")

    @property
    def gate(self) -> DataFrame:
        return gates.dataset_gate(self.counts("category"), self.surplus, self.openings, **self.thresholds)

    @property
    def summary(self) -> DataFrame:
        """One row with the totals, distributions and the overall result."""
        found = self.checked.agg(
            F.count("reason").alias("unread"),
            F.coalesce(
                F.sum(F.size(F.filter("hits", lambda h: h["kind"] == rules.IMPERATIVE))), F.lit(0)
            ).alias("broken"),
        )
        extra = self.surplus.agg(
            *[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n_surplus"))), F.lit(0)).alias(k) for k in KEYS]
        )
        # Valid records hold only enumerated values here, so the maps are small.
        pairs = lambda f: F.filter(
            F.array_sort(F.collect_list(F.when(F.col("facet") == f, F.struct((-F.col("n")).alias("o"), "value", "n")))),
            lambda p: p.isNotNull(),
        )
        as_map = lambda f: F.map_from_entries(F.transform(pairs(f), lambda p: F.struct(p["value"], p["n"])))
        maps = self.facets.agg(
            as_map("category").alias("category_counts"),
            as_map("difficulty").alias("difficulty_distribution"),
            as_map("language").alias("language_distribution"),
        )

        def one(df: DataFrame) -> Column:
            return df.select(F.struct("*")).scalar()

        row = self.gate.select("*", one(found).alias("f"), one(extra).alias("x"), one(maps).alias("m"))
        return row.select(
            F.col("total").alias("total_prompts"),
            F.col("categories").alias("total_categories"),
            F.col("f.unread").alias("invalid_lines"),
            (F.col("f.unread") + F.col("f.broken") + F.col("x.id") + F.col("x.slug") + F.col("x.title")).alias("total_errors"),
            F.col("x.id").alias("duplicate_ids"),
            F.col("x.slug").alias("duplicate_slugs"),
            F.col("x.title").alias("duplicate_titles"),
            F.col("overused_openings").alias("first5_duplicates"),
            "m.*",
            F.col("result").alias("overall_result"),
        )


def validate(decoded: jsonl.Decoded, **thresholds) -> Validation:
    """Check decoded lines; ``thresholds`` go to the gate."""
    return Validation(cut_lineage(check_lines(decoded)), thresholds)


def run(spark: SparkSession, source: str, target: str, **thresholds) -> bool:
    """Validate a folder of JSONL files, write the report, return whether it passed."""
    result = validate(jsonl.read_records(spark, source), **thresholds)
    sinks.write_validation_report(result.summary, result.violations, target)
    result.counters.coalesce(1).write.json(f"{target}/files")
    profile.with_share(result.counts("category")).coalesce(1).write.json(f"{target}/categories")
    rules.count_by_rule(result.violations).coalesce(1).write.json(f"{target}/rules")
    return spark.read.json(f"{target}/summary").first().overall_result == "PASS"
