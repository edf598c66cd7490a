"""Near-duplicate pairs inside a sliding window of followers.

Within a category, in input order, each record is compared with the next ``window``
records; a pair counts when the word-set overlap is strictly above the threshold.

How it scales:

* Rows are numbered per category by cell counts and offsets, so a category that
  holds most rows is spread over many tasks (see ``ordering``).
* The window becomes an equi-join on (category, block of ``window`` rows): every row
  meets its own and the next block only, and every cell has the same small size.
* What is shuffled first is narrow: set size and a bit signature per record. Both
  give a proven upper bound of the overlap, so no true pair is lost.
* Texts are joined once, with the narrow list of rows that still have a candidate; only
  their word sets travel, once as left and twice as right side, whatever the partners.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import vocab
from ..functions import text
from ..functions.variants import once
from ..session import cut_lineage
from ..spec import RecordSpec
from .dups import groups, keyed
from .ordering import Buckets, join_per_key, measure_buckets, running_sum

SIGNATURE_LONGS = 16
_SIG = [f"s{i}" for i in range(SIGNATURE_LONGS)]


def jaccard_counts(a: Column, b: Column) -> tuple[Column, Column]:
    """(shared words, words in either set) of two word sets without repeats."""
    shared = F.size(F.array_intersect(a, b))
    return shared, F.size(a) + F.size(b) - shared


def rounded_ratio(part: Column, whole: Column) -> Column:
    """``part / whole`` to three decimals, rounded the way IEEE doubles round.

    Exact decimal ties are resolved by the side on which the double of the ratio
    lies, and to the even digit when the double is exact.
    """
    i, u = part.cast("long"), whole.cast("long")
    doubled = i * 2000
    floor = F.call_function("div", doubled, u * 2)
    tie = (F.pmod(doubled, u) == 0) & (F.pmod(F.call_function("div", doubled, u), F.lit(2)) == 1)
    x = i.cast("double") / u
    high = F.floor(x * 2**26) / F.lit(2.0**26)
    error = (i - high * u) - (x - high) * u  # exact: both products fit 53 bits
    up_on_tie = F.when(error == 0, F.pmod(floor, F.lit(2)) == 1).otherwise(error < 0)
    nearest = F.call_function("div", doubled + u, u * 2)
    units = F.when(tie, floor + up_on_tie.cast("long")).otherwise(nearest)
    return units / F.lit(1000.0)


def with_signature(df: DataFrame, tokens: str) -> DataFrame:
    """Replace a word-set column by its size and a bit set of its word hashes.

    Two different words may share a bit, which can only hide a difference: the bits
    of A missing in B never outnumber the words of A missing in B.
    """
    slots = 64 * SIGNATURE_LONGS
    bits = df.withColumn("n_tokens", F.size(tokens)).withColumn(
        "_bits",
        F.array_distinct(
            F.transform(tokens, lambda w: F.pmod(F.xxhash64(w), F.lit(slots)).cast("int"))
        ),
    )
    one = F.lit(1).cast("long")

    def word(i: int) -> Column:
        mine = F.filter("_bits", lambda b: F.shiftright(b, 6) == i)
        return F.aggregate(
            mine,
            F.lit(0).cast("long"),
            lambda acc, b: acc.bitwiseOR(F.call_function("shiftleft", one, b.bitwiseAND(F.lit(63)))),
        )

    return bits.withColumns({name: word(i) for i, name in enumerate(_SIG)}).drop("_bits", tokens)


def _may_pass(threshold: tuple[int, int]) -> Column:
    """True unless set sizes and signatures prove the pair is not above the threshold."""
    p, q = threshold
    only_l = sum(
        (F.bit_count(F.col(f"l.{s}").bitwiseAND(F.bitwise_not(F.col(f"r.{s}")))) for s in _SIG),
        F.lit(0),
    )
    only_r = sum(
        (F.bit_count(F.col(f"r.{s}").bitwiseAND(F.bitwise_not(F.col(f"l.{s}")))) for s in _SIG),
        F.lit(0),
    )
    na, nb = F.col("l.n_tokens"), F.col("r.n_tokens")
    sizes = F.least(na, nb) * (p + q) > (na + nb) * p
    return sizes & (F.least(na - only_l, nb - only_r) * (p + q) > (na + nb) * p)


def _meet_next_block(left: DataFrame, right: DataFrame, residual: Column) -> DataFrame:
    """Join rows with the followers in their own and the next block."""
    homes = F.filter(F.array("blk", F.col("blk") - 1), lambda b: b >= 0)
    followers = right.withColumn("blk", F.explode(homes))
    same_cell = (F.col("l.category") == F.col("r.category")) & (F.col("l.blk") == F.col("r.blk"))
    return left.alias("l").join(followers.alias("r"), same_cell & residual)


def numbered(df: DataFrame, spec: RecordSpec, window: int, buckets: Buckets | None = None) -> DataFrame:
    """Narrow rows (category, pos, id, n_tokens, signature, rn, blk)."""
    buckets = buckets or measure_buckets(df, spec.pos)
    narrow = with_signature(
        df.select(
            F.coalesce(F.col(spec.category), F.lit("unknown")).alias("category"),
            F.col(spec.pos).alias("pos"),
            F.col(spec.id).alias("id"),
            text.token_set(F.coalesce(F.col(spec.text), F.lit(""))).alias("_tokens"),
        ),
        "_tokens",
    )
    rows = running_sum(narrow, ["category"], "pos", "rn", buckets)
    return rows.withColumn("rn", F.col("rn") - 1).withColumn(
        "blk", F.floor(F.col("rn") / F.lit(window)).cast("long")
    )


def _flag_repeated_ids(rows: DataFrame) -> DataFrame:
    """Mark rows whose id occurs more than once in their category."""
    per_id = rows.withColumn("key", F.sha2(F.to_json(F.struct("category", "id")), 256))
    repeated = groups(per_id.select("key", "pos"))
    marked = join_per_key(per_id.select("key", "pos"), repeated, "key", "pos").select(
        "pos", F.lit(True).alias("_again")
    )
    return per_id.join(marked, "pos", "left").withColumn(
        "again", F.coalesce("_again", F.lit(False))
    ).drop("key", "_again")


def candidate_pairs(
    df: DataFrame, spec: RecordSpec, window: int, threshold: tuple[int, int], buckets: Buckets | None = None
) -> DataFrame:
    """Pairs inside the window that may pass, each unordered id pair at its first meeting."""
    rows = numbered(df, spec, window, buckets)
    if not spec.unique_ids:
        # Read four times below; texts are tokenised once.
        rows = _flag_repeated_ids(cut_lineage(rows))
    in_window = (F.col("r.rn") > F.col("l.rn")) & (F.col("r.rn") <= F.col("l.rn") + window)
    passes = _may_pass(threshold)
    pair = [
        F.col("l.category").alias("category"),
        *[F.col(f"{side}.{c}").alias(f"{c}{n}") for n, side in ((1, "l"), (2, "r")) for c in ("rn", "pos", "id")],
    ]
    if spec.unique_ids:
        return _meet_next_block(rows, rows, in_window & passes).select(*pair)
    # An id pair that can meet again counts only at its first meeting, even if that
    # first meeting fails the threshold; all its meetings are needed to tell.
    again = F.col("l.again") | F.col("r.again")
    met = _meet_next_block(rows, rows, in_window & (again | passes)).select(
        *pair, passes.alias("passes")
    )
    firsts = met.groupBy(
        "category", F.least("id1", "id2").alias("lo"), F.greatest("id1", "id2").alias("hi")
    ).agg(F.min(F.struct("rn1", "rn2", "pos1", "pos2", "id1", "id2", "passes")).alias("p"))
    return firsts.filter("p.passes").select("category", "p.*").drop("passes")


def near_pairs(
    df: DataFrame,
    spec: RecordSpec,
    window: int = vocab.PAIR_WINDOW,
    threshold: tuple[int, int] = vocab.PAIR_THRESHOLD,
    buckets: Buckets | None = None,
) -> DataFrame:
    """(category, pos1, pos2, id1, id2, shared, total, similarity) of near-duplicate pairs."""
    # Read several times below; computed once and kept in the shared folder.
    candidates = cut_lineage(candidate_pairs(df, spec, window, threshold, buckets), "candidates")
    side = lambda n: candidates.select("category", *[F.col(f"{c}{n}").alias(c) for c in ("rn", "pos", "id")])
    wanted = side(1).unionByName(side(2)).distinct()
    # The only join with the texts: the narrow list meets them once, and what leaves the
    # join is word sets of rows with a candidate.
    texts = df.select(F.col(spec.pos).alias("pos"), F.coalesce(F.col(spec.text), F.lit("")).alias("_text"))
    block = F.floor(F.col("rn") / F.lit(window)).cast("long").alias("blk")
    sets = cut_lineage(
        wanted.join(texts, "pos").select("category", block, "rn", "pos", "id", text.token_set(F.col("_text")).alias("tokens")),
        "word-sets",
    )
    # At most ``window`` partners per row, so the list stays small.
    partners = candidates.groupBy(F.col("pos1").alias("pos")).agg(F.collect_list("rn2").alias("partners"))
    met = _meet_next_block(sets.join(partners, "pos"), sets, F.array_contains("l.partners", F.col("r.rn"))).select(
        "l.category",
        *[F.col(f"{s}.{c}").alias(f"{c}{n}") for c in ("pos", "id") for n, s in ((1, "l"), (2, "r"))],
        F.col("l.tokens").alias("_a"), F.col("r.tokens").alias("_b"),
    )
    # Sets are intersected once per pair, after the join.
    shared, total = jaccard_counts(F.col("_a"), F.col("_b"))
    counted = once(met, "_counts", F.struct(shared.alias("shared"), total.alias("total")))
    p, q = threshold
    return (
        counted.select("category", "pos1", "pos2", "id1", "id2", "_counts.shared", "_counts.total")
        .filter(F.col("shared") * q > F.col("total") * p)
        .withColumn("similarity", rounded_ratio(F.col("shared"), F.col("total")))
    )
