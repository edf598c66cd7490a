"""Mixing sources to target weights by cutting a hash order at exact budgets.

Every document gets a hash-random key. Inside its source the keys are cut into cells of
equal hash ranges, cells are summed map-side, and prefix sums of the cells plus a running
sum inside a cell give the words before each document. A source whose budget exceeds its
size is taken whole as often as it fits; the rest of the budget cuts the hash order, and
the document on the cut gives the words still missing, so the budget is met exactly.

No task sees a whole source: windows run over (source, cell).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidemark.llm.registry import cells_for, fresh, query, table
from tidemark.session import cut_lineage

#: Fixed values of the mix: runs of other than white space are words; weights repeat.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MOST_EPOCHS = 3
SEED = "mix-1"
ROWS_PER_CELL = 50_000
#: Rows of equal id and text that are numbered in one task.
ROWS_PER_COPY_CELL = 10_000


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """Targets for one row per source (source, no_source, size), in words.

    Sources by code point, null last, weigh ``weights`` in turn and share the sum of all
    sizes. No target exceeds ``most`` times its source's size; what that leaves over is
    shared by weight among the others. Going through the sources by size over weight, a
    source is at its limit exactly if the rest, shared by weight, would give it more.
    All sums are integers, so the targets don't depend on any order of addition.
    """
    by_name = Window.orderBy("no_source", "source")
    by_ratio = Window.orderBy((F.col("size") * F.lit(6) / F.col("weight")), "rank")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    whole = "decimal(38,0)"
    return (
        sizes.withColumn("rank", F.row_number().over(by_name) - 1)
        .withColumn("weight", F.get(F.lit(list(weights)), F.col("rank") % len(weights)))
        .withColumn("limit", F.col("size") * most)
        .withColumn("limits_before", F.coalesce(F.sum("limit").over(before), F.lit(0)))
        .withColumn("weight_left", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("words_left", F.sum("size").over(every) - F.col("limits_before"))
        .withColumn(
            "at_limit",
            F.col("limit").cast(whole) * F.col("weight_left").cast(whole)
            <= F.col("weight").cast(whole) * F.col("words_left").cast(whole),
        )
        .withColumn("free_weight", F.sum(F.when(~F.col("at_limit"), F.col("weight"))).over(every))
        .withColumn(
            "free_words",
            F.sum("size").over(every) - F.coalesce(F.sum(F.when(F.col("at_limit"), F.col("limit"))).over(every), F.lit(0)),
        )
        .withColumn(
            "target",
            F.when(F.col("at_limit"), F.col("limit").cast("double")).otherwise(
                (F.col("free_words") * F.col("weight")).cast("double") / F.col("free_weight").cast("double")
            ),
        )
        .select("source", "no_source", F.col("size").alias("source_size"), "target")
    )


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: str = SEED,
    rows_per_cell: int = ROWS_PER_CELL,
) -> DataFrame:
    """One row per document: id, text_md5, size, source_size, target, taken.

    taken counts words, repeats included. Null and empty texts have size 0 and are never
    taken. Rows that agree in id and text are interchangeable. A source without words has
    target 0. Empty input gives no rows; other columns are ignored. The same rows and seed
    always give the same mix.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    name = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    narrow = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(source_col), F.lit("")).alias("source"),
        F.col(source_col).isNull().alias("no_source"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        F.md5(F.concat(F.lit(f"{seed}:"), name, F.lit(":"), text).cast("binary")).alias("key"),
        F.md5(text.cast("binary")).alias("text_md5"),
    )
    cells = cells_for(docs.select(id_col).count(), rows_per_cell)
    cell = F.expr(f"(conv(substr(key, 1, 8), 16, 10)::bigint * {cells}) div 4294967296")
    placed = cut_lineage(narrow.withColumn("cell", cell), "mix")

    per_cell = placed.groupBy("source", "no_source", "cell").agg(F.sum("size").alias("cell_size"))
    sizes = per_cell.groupBy("source", "no_source").agg(F.sum("cell_size").alias("size"))
    of_source = Window.partitionBy("source", "no_source").orderBy("cell")
    bases = per_cell.select(
        "source", "no_source", "cell",
        F.coalesce(
            F.sum("cell_size").over(of_source.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("base"),
    ).join(source_targets(sizes), ["source", "no_source"])
    inside = (
        Window.partitionBy("source", "no_source", "cell")
        .orderBy("key", "size")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    budget = F.floor("target").cast("long")
    rest = F.expr("CASE WHEN source_size > 0 THEN floor(target) % source_size ELSE 0 END").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.call_function("div", budget, F.col("source_size"))).otherwise(0)
    before = F.col("base") + F.col("upto") - F.col("size")
    last = F.greatest(F.lit(0), F.least(F.col("size"), rest - before))
    return (
        placed.withColumn("upto", F.sum("size").over(inside))
        .join(bases, ["source", "no_source", "cell"])
        .select(
            F.col("id").alias(id_col), "text_md5", "size", "source_size", "target",
            (F.col("size") * epochs + last).cast("long").alias("taken"),
        )
    )


_WEIGHT = "[" + ", ".join(map(str, WEIGHTS)) + "]"

SQL = f"""
WITH sized AS (
  SELECT doc_id, coalesce(source, '') AS source, source IS NULL AS no_source,
    len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size,
    md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null') || ':' || coalesce(text, '')) AS key
  FROM documents),
sources AS (
  SELECT source, no_source, sum(size)::HUGEINT AS size FROM sized GROUP BY source, no_source),
named AS (SELECT *, row_number() OVER (ORDER BY no_source, source) - 1 AS rank FROM sources),
weighed AS (SELECT *, {_WEIGHT}[rank % {len(WEIGHTS)} + 1] AS weight, {MOST_EPOCHS} * size AS most FROM named),
ranked AS (
  SELECT *, coalesce(sum(most) OVER before, 0) AS most_before, coalesce(sum(weight) OVER before, 0) AS weight_before
  FROM weighed WINDOW before AS (ORDER BY size * 6 / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
limited AS (
  SELECT *, most * (sum(weight) OVER () - weight_before) <= weight * (sum(size) OVER () - most_before) AS at_limit
  FROM ranked),
targets AS (
  SELECT source, no_source, size::BIGINT AS source_size, CASE WHEN at_limit THEN most::DOUBLE ELSE
    ((sum(size) OVER () - coalesce(sum(most) FILTER (at_limit) OVER (), 0)) * weight)::DOUBLE
    / (sum(weight) FILTER (NOT at_limit) OVER ())::DOUBLE END AS target
  FROM limited),
placed AS (
  SELECT *, floor(target)::BIGINT AS budget,
    sum(size) OVER (PARTITION BY source, no_source ORDER BY key ROWS UNBOUNDED PRECEDING) - size AS before
  FROM sized JOIN targets USING (source, no_source))
SELECT doc_id, size, source_size, target,
  (CASE WHEN source_size = 0 THEN 0 ELSE size * (budget // source_size)
    + greatest(0, least(size, budget % source_size - before)) END)::BIGINT AS taken
FROM placed
"""


@query(SQL)
def op7_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents mixed by source weights 1, 2, 3 in turn."""
    return mix(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of ``docs``, each repeated as often as it is taken.

    A document on the cut is kept if at least half of it is taken; rows of equal id and
    text share the copies of all of them, so the mix has exactly as many. Columns are those of ``docs``.
    """
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    taken = mix(docs, **options)
    copies, key, name, nth = (fresh(docs, c) for c in ("_copies", "_text_md5", "_id", "_nth"))
    whole = F.expr("CASE WHEN size > 0 THEN (2 * taken + size) div (2 * size) ELSE 0 END")
    wanted = taken.groupBy(F.col(id_col).alias(name), F.col("text_md5").alias(key)).agg(
        F.sum(whole).alias(copies), F.count("*").alias(nth)
    )
    of_text = F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    wanted = cut_lineage(wanted.filter(F.col(copies) > 0), "wanted")
    each, rest = F.call_function("div", F.col(copies), F.col(nth)), F.col(copies) % F.col(nth)

    def rows_of(these: DataFrame) -> DataFrame:
        return docs.join(these, F.col(id_col).eqNullSafe(F.col(name)) & (of_text == F.col(key)))

    def repeated(rows: DataFrame, times: Column) -> DataFrame:
        wide = rows.withColumn(copies, times).filter(F.col(copies) > 0)
        repeats = F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))
        return wide.withColumn(nth, repeats).select(*[F.col(f"`{c}`") for c in docs.columns])

    # Copies that equal rows can't share evenly: the first rows, in cells, get one more.
    row, cell, before = (fresh(docs, c) for c in ("_row", "_cell", "_before"))
    uneven = cut_lineage(rows_of(wanted.filter(rest > 0)).withColumn(row, F.monotonically_increasing_id()), "uneven")
    uneven = uneven.withColumn(cell, F.call_function("div", F.col(row), F.lit(ROWS_PER_COPY_CELL)))
    group = [name, key]
    earlier = Window.partitionBy(*group).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    bases = uneven.groupBy(*group, cell).agg(F.count("*").alias(before))
    bases = bases.withColumn(before, F.coalesce(F.sum(before).over(earlier), F.lit(0))).withColumnsRenamed(
        {name: f"{name}b", key: f"{key}b", cell: f"{cell}b"}
    )
    same = F.col(name).eqNullSafe(F.col(f"{name}b")) & (F.col(key) == F.col(f"{key}b")) & (F.col(cell) == F.col(f"{cell}b"))
    place = F.row_number().over(Window.partitionBy(*group, cell).orderBy(row))
    numbered = uneven.withColumn(row, place).join(bases, same)
    more = (F.col(before) + F.col(row) <= rest).cast("long")
    return repeated(rows_of(wanted.filter(rest == 0)), each).unionAll(repeated(numbered, each + more))
