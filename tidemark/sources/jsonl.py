"""JSONL input with exact line numbers, and tolerant decoding with quarantine."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import text
from ..functions.variants import once


#: Files that the cleanup job writes below ``source_file=<name>``.
PART_FILES = "part-*.txt"


class EmptyInputError(ValueError):
    """There is no folder, or it holds no matching file."""


def _open(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """Text relation of the files that match, else of the part files of cleaned records."""
    for glob in (pattern, PART_FILES):
        try:
            raw = spark.read.option("pathGlobFilter", glob).text(path)
        except AnalysisException as e:
            raise EmptyInputError(f"cannot read {path}") from e
        if raw.inputFiles():
            return raw
    raise EmptyInputError(f"no {pattern} files in {path}")


def scan_lines(spark: SparkSession, path: str, pattern: str = "*.jsonl") -> DataFrame:
    """(source_file, line_num, pos, value) of every line, blank ones included.

    ``line_num`` counts from 1 within a file; ``pos`` counts from 1 over all files in
    name order. A folder as the cleanup job writes it (``source_file=<name>/part-*``) is
    read as the files it was made from: parts of a folder follow each other by name.

    Lines are not shuffled: the first pass counts lines per split without reading them
    out, the second adds the split's offset to the line's place in it. Both passes plan
    the same splits, as they scan the same relation.
    """
    raw = _open(spark, path, pattern)
    parts = "source_file" in raw.columns
    lines = raw.select(
        "value",
        F.col("_metadata.file_path").alias("_path"),
        F.col("source_file" if parts else "_metadata.file_name").cast("string").alias("source_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_at"),
    )
    splits = lines.groupBy("_path", "source_file", "_start").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first")
    )
    # The windows below see one row per split, not per line.
    earlier = (Window.unboundedPreceding, -1)
    one_file = ["source_file"] if parts else ["_path"]
    in_file = Window.partitionBy(*one_file).orderBy("_path", "_start").rowsBetween(*earlier)
    overall = Window.orderBy("source_file", "_path", "_start").rowsBetween(*earlier)
    offsets = splits.select(
        "_path",
        "_start",
        "_first",
        F.coalesce(F.sum("_n").over(in_file), F.lit(0)).alias("_in_file"),
        F.coalesce(F.sum("_n").over(overall), F.lit(0)).alias("_overall"),
    )
    place = F.col("_at") - F.col("_first") + 1
    return lines.join(offsets, ["_path", "_start"]).select(
        "source_file",
        (place + F.col("_in_file")).alias("line_num"),
        (place + F.col("_overall")).alias("pos"),
        "value",
    )


@dataclass(frozen=True)
class Decoded:
    """Lines split by outcome. ``lines`` has all non-blank lines with their ``reason``."""

    lines: DataFrame

    @property
    def records(self) -> DataFrame:
        """(source_file, line_num, pos, raw, rec) of JSON objects."""
        return self.lines.filter(F.col("reason").isNull()).drop("reason")

    @property
    def quarantine(self) -> DataFrame:
        """(source_file, line_num, pos, reason, raw): fence, json or not_object."""
        return self.lines.filter(F.col("reason").isNotNull()).select(
            "source_file", "line_num", "pos", "reason", "raw"
        )


def decode(lines: DataFrame) -> Decoded:
    """Parse lines to VARIANT; what is not a JSON object gets a reason instead.

    Blank lines are dropped after numbering. Of repeated keys the last one wins.
    """
    raw = text.strip(F.col("value"))
    stripped = lines.filter(text.has_text(F.col("value"))).withColumn("raw", raw).drop("value")
    parsed = once(stripped, "rec", F.try_parse_json("raw"))
    reason = (
        F.when(F.startswith("raw", F.lit("```")), "fence")
        .when(F.col("rec").isNull(), "json")
        .when(~F.startswith("raw", F.lit("{")), "not_object")
    )
    return Decoded(parsed.withColumn("reason", reason))


def read_records(spark: SparkSession, path: str, pattern: str = "*.jsonl") -> Decoded:
    return decode(scan_lines(spark, path, pattern))


def file_counters(decoded: Decoded, invalid_lines: DataFrame | None = None) -> DataFrame:
    """Per file: non-blank lines, valid and invalid lines.

    ``invalid_lines`` (source_file, line_num) adds lines that parse but break a rule.
    """
    lines = decoded.lines.groupBy("source_file").agg(
        F.count(F.lit(1)).alias("lines"),
        F.count("reason").alias("unreadable"),
    )
    if invalid_lines is None:
        broken = lines.select("source_file").withColumn("broken", F.lit(0).cast("long"))
    else:
        broken = (
            invalid_lines.select("source_file", "line_num")
            .distinct()
            .groupBy("source_file")
            .agg(F.count(F.lit(1)).alias("broken"))
        )
    return lines.join(broken, "source_file", "left").select(
        "source_file",
        "lines",
        (F.col("lines") - F.col("unreadable") - F.coalesce("broken", F.lit(0))).alias("valid"),
        (F.col("unreadable") + F.coalesce("broken", F.lit(0))).alias("invalid"),
    )
