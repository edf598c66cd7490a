"""Order-stable unique names: the first user keeps a name, later ones get a number.

In input order, a record whose name is taken gets the smallest free numbered form:
``a-1, a-2, ...`` for slugs, ``T (2), T (3), ...`` for titles. A numbered form may
also occur as somebody's original name, so the outcome depends on order.

The result equals that sequential rule, but without a task that sees a whole group:

* For a name whose numbered forms never occur as originals, the number follows from
  the record's ordinal among equal names (``running_sum``, safe for hot names).
* Otherwise only the *distinct* numbered originals are looked at. Such an original
  either blocks its number for the requests that come later, or loses its name to a
  request that came first. Which of the two depends on how many smaller numbers of its
  base are blocked, and on whether the base kept its own name. Both are unknown at
  first, so they are bounded from below and above, and running sums narrow the bounds of
  all bases at once until none is open (``_settle``). Requests then skip blocked numbers
  through a running count.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .. import vocab
from ..session import cut_lineage, release
from .ordering import Buckets, dense_buckets, join_per_key, measure_buckets, running_sum, running_sums


@dataclass(frozen=True)
class NumberedForm:
    """How numbered names look: ``base + left + number + right`` from ``first`` on."""

    left: str
    right: str
    first: int
    number: str

    @property
    def _suffix(self) -> str:
        quote = lambda s: "".join("\\" + ch if ch in "()-" else ch for ch in s)
        return f"{quote(self.left)}({self.number}){quote(self.right)}"

    def parse(self, name: Column) -> tuple[Column, Column, Column]:
        """(is numbered, base, number) of a name."""
        pattern = f"(?s)^(.*){self._suffix}$"
        return (
            name.rlike(pattern),
            F.regexp_extract(name, pattern, 1),
            F.try_to_number(F.regexp_extract(name, pattern, 2), F.lit("9" * 18)).cast("long"),
        )

    def render(self, base: Column, number: Column) -> Column:
        return F.concat(base, F.lit(self.left), number.cast("string"), F.lit(self.right))


SLUGS = NumberedForm("-", "", 1, "[1-9][0-9]{0,17}")
TITLES = NumberedForm(" (", ")", 2, "[2-9]|[1-9][0-9]{1,17}")


def _settle(marks: DataFrame) -> DataFrame:
    """Numbered originals that requests reach: (name, base, slot, skipped, lost).

    ``marks`` (name, base, slot, before, base_rows, base_pinned) holds the distinct numbered
    originals: slot is 1 for the first number, ``before`` counts the base's rows in front of
    the original. With ``skipped`` blocked slots below it, the original meets request number
    slot - skipped. That request came first, and takes the name, if it is among the base's
    requests before the original; else the slot is blocked. Every round turns the
    bounds of ``skipped`` into slots that are surely or possibly blocked, and sums those into
    tighter bounds; a base's own fate bounds its number of requests by one. The smallest
    open slot of a base whose base is settled closes in each round, so the rounds end;
    slots beyond the last request are left out.
    """
    state = marks.withColumns({
        "low": F.lit(0).cast("long"), "high": F.col("slot") - 1, "lost": F.lit(False), "may_lose": F.lit(True),
    })
    kept = None
    while True:
        fate = state.select(F.col("name").alias("base"), F.col("lost").alias("base_lost"), F.col("may_lose").alias("base_may"))
        # A base uses up one row for its own name unless it is pinned or loses it.
        keeps = lambda lost: F.when(F.col("base_pinned") | F.coalesce(lost, F.lit(False)), 0).otherwise(1)
        limit = lambda own: F.col("slot") - F.greatest(F.col("before") - F.col(own), F.lit(0))
        bounded = (
            state.join(fate, "base", "left")
            .withColumns({"most_kept": keeps(F.col("base_lost")), "least_kept": keeps(F.col("base_may"))})
            # The name is lost if at least this many slots are skipped.
            .withColumns({"limit_high": limit("most_kept"), "limit_low": limit("least_kept")})
        )
        blocked = {"low": F.col("high") < F.col("limit_low"), "high": F.col("low") < F.col("limit_high")}
        bounded = bounded.withColumns({f"{bound}_blocked": b.cast("long") for bound, b in blocked.items()})
        sums = {f"{bound}_sum": F.col(f"{bound}_blocked") for bound in blocked}
        bounded = running_sums(bounded, ["base"], "slot", sums, dense_buckets())
        low = F.greatest("low", F.col("low_sum") - F.col("low_blocked"))
        high = F.least("high", F.col("high_sum") - F.col("high_blocked"))
        state = cut_lineage(
            bounded.withColumns({"low": low, "high": high})
            .withColumns({"lost": F.col("low") >= F.col("limit_high"), "may_lose": F.col("high") >= F.col("limit_low")})
            .filter(F.col("slot") - F.col("high") <= F.col("base_rows") - F.col("least_kept"))
            .select(*marks.columns, "low", "high", "lost", "may_lose"),
            "numbered",
            replaces=kept,
        )
        kept = state
        if state.filter("low < high or lost <> may_lose").isEmpty():
            return state.select("name", "base", "slot", F.col("low").alias("skipped"), "lost")


def unique_names(
    df: DataFrame,
    name: str,
    pos: str,
    form: NumberedForm,
    pinned: Column | None = None,
    buckets: Buckets | None = None,
) -> DataFrame:
    """(pos, name, final_name) for every row of ``df``.

    ``name`` must not be null. ``pinned`` rows take their name as it is, even when it
    is taken, and make it taken for others.
    """
    fixed = F.lit(False) if pinned is None else pinned
    # Names and their counts are made once and read several times.
    rows = cut_lineage(df.select(F.col(name).alias("key"), F.col(pos).alias("pos"), fixed.alias("pinned")), "names")
    buckets = buckets or measure_buckets(rows, "pos")
    asks = (~F.col("pinned")).cast("long")
    keys = cut_lineage(
        rows.groupBy("key").agg(
            F.sum(asks).alias("base_rows"),
            F.min("pos").alias("first_pos"),
            F.min_by("pinned", "pos").alias("first_pinned"),
        ),
        "keys",
    )

    # Numbered originals whose base also occurs and can hand out numbers.
    numbered, base, number = form.parse(F.col("key"))
    originals = keys.filter(numbered).select(
        F.col("key").alias("name"), base.alias("base"), number.alias("number"),
        F.col("first_pos").alias("pos"),
    )
    base_numbered, _, _ = form.parse(F.col("base"))
    bases = (
        originals.groupBy("base").agg(F.count(F.lit(1)).alias("n"))
        .join(keys, F.col("base") == F.col("key"))
        .filter((F.col("base_rows") > 1) | F.col("first_pinned") | base_numbered)
        .select("base", "n", "base_rows", F.col("first_pinned").alias("base_pinned"))
    )
    tangled = cut_lineage(join_per_key(originals, bases, "base", "pos"), "tangled")

    # How many rows of the base precede each numbered original.
    parents = tangled.groupBy(F.col("base").alias("key")).agg(F.max("base_rows").alias("n"))
    marks = tangled.select(
        F.col("base").alias("key"), "pos", F.lit(True).alias("pinned"), F.col("name").alias("mark")
    )
    around = join_per_key(rows, parents, "key", "pos").select(
        "key", "pos", "pinned", F.lit(None).cast("string").alias("mark")
    ).unionByName(marks)
    before = (
        running_sum(around, ["key"], "pos", "rows_before", buckets, asks)
        .filter(F.col("mark").isNotNull())
        .select(F.col("mark").alias("name"), "rows_before")
    )
    marked = cut_lineage(
        tangled.join(before, "name").select(
            "name", "base", (F.col("number") - (form.first - 1)).alias("slot"),
            F.col("rows_before").alias("before"), "base_rows", "base_pinned",
        ),
        "marks",
        replaces=tangled,
    )
    fates = _settle(marked)
    release(marked)

    # Names whose first user does not keep them: lost to a request, or pinned.
    losers = fates.filter("lost").select(F.col("name").alias("key"))
    if pinned is not None:
        pinned_first = keys.filter(F.col("first_pinned") & (F.col("base_rows") > 0))
        losers = losers.unionByName(pinned_first.select("key")).distinct()

    # Only names that repeat or that their first user loses are numbered; all others stay.
    several = (
        keys.join(losers.withColumn("lost", F.lit(True)), "key", "left")
        .filter((F.col("base_rows") > 1) | F.col("lost") & (F.col("base_rows") > 0) | F.col("first_pinned"))
        .select("key", F.col("base_rows").alias("n"), F.when(F.col("lost"), 0).otherwise(1).alias("kept"))
    )
    contested = join_per_key(rows, several, "key", "pos").drop("n")
    requests = running_sum(contested, ["key"], "pos", "ordinal", buckets, asks).select(
        "key", "pos", "pinned", (F.col("ordinal") - F.col("kept")).alias("request")
    )
    # A blocked number after request v moves every request beyond v by one.
    after = F.col("slot") - F.col("skipped") - 1
    gaps = (
        fates.filter("not lost").groupBy(F.col("base").alias("key"), after.alias("after"))
        .agg(F.count(F.lit(1)).alias("step"))
    )
    line = requests.select(
        "key", (F.col("request") * 2).alias("at"), F.lit(0).cast("long").alias("step"),
        "pos", "pinned", "request",
    ).unionByName(
        gaps.select("key", (F.col("after") * 2 + 1).alias("at"), "step"), allowMissingColumns=True
    )
    moved = running_sum(line, ["key"], "at", "moved", dense_buckets(), F.col("step"))
    number_of = F.col("request") + F.col("moved") + (form.first - 1)
    renamed = (
        moved.filter(F.col("pos").isNotNull() & ~F.col("pinned") & (F.col("request") > 0))
        .select("pos", form.render(F.col("key"), number_of).alias("new_name"))
    )
    return rows.join(renamed, "pos", "left").select(
        "pos", F.col("key").alias("name"), F.coalesce("new_name", "key").alias("final_name")
    )


def record_numbers(df: DataFrame, pos: str, buckets: Buckets | None = None) -> DataFrame:
    """(pos, number): 1-based place of every row in input order."""
    buckets = buckets or measure_buckets(df, pos)
    return running_sum(df.select(F.col(pos).alias("pos")), [], "pos", "number", buckets)


def unique_slugs(df: DataFrame, slug: str, pos: str, buckets: Buckets | None = None) -> DataFrame:
    return unique_names(df, slug, pos, SLUGS, buckets=buckets)


def unique_titles(
    df: DataFrame, title: str, pos: str, number: str | None = None, buckets: Buckets | None = None
) -> DataFrame:
    """Unique titles; an empty title becomes ``Untitled Prompt`` plus the record's number.

    ``number`` names a column with the 1-based place of the record. Without it, titles
    must not be empty.
    """
    if number is None:
        return unique_names(df, title, pos, TITLES, buckets=buckets)
    missing = F.coalesce(F.col(title), F.lit("")) == ""
    named = df.select(
        F.col(pos).alias("pos"),
        F.when(missing, F.concat(F.lit(vocab.UNTITLED_PREFIX), F.col(number).cast("string")))
        .otherwise(F.col(title))
        .alias("title"),
        missing.alias("untitled"),
    )
    return unique_names(named, "title", "pos", TITLES, pinned=F.col("untitled"), buckets=buckets)
