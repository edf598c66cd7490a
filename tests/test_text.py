"""Text functions against plain Python and hand-made cases."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark import vocab
from tidemark.functions import text
from tidemark.operators.nearpairs import rounded_ratio

SAMPLES = [
    "", " ", "one", "  two  words ", "tab\tand\nline", "café au lait, 3 cups.", "a b c", "x\x1cy\x1fz",
    "Build the RED card, 2 cards!", "Create cards: red CARD 99", ".x", "No dot here", "First. Second.",
    "naïve_user ١٢٣ ½ rock’n’roll", "w " * 300, "Ünïcode ÄÖÜ ß",
]


def column(spark, values, c):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[1] for r in sorted(df.select("i", c).collect())]


def model_bag(s):
    s = re.sub(r"\d+", " ", re.sub(r"[^\w\s]", " ", s.lower()))
    return " ".join(sorted(w for w in s.split() if w not in vocab.STOPWORDS and len(w) > 2))


def test_against_python(spark):
    rng = random.Random(5)
    alphabet = "ab é\t\n .,-_1½Ä\x1d"
    values = SAMPLES + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    t = F.col("t")
    assert column(spark, values, text.word_count(t)) == [len(v.split()) for v in values]
    assert column(spark, values, text.words(t)) == [v.split() for v in values]
    assert column(spark, values, text.first_words(t)) == [" ".join(v.split()[:5]).lower() for v in values]
    assert column(spark, values, text.token_bag(t)) == [model_bag(v) for v in values]
    assert column(spark, values, text.fingerprint(t)) == [hashlib.sha256(model_bag(v).encode()).hexdigest() for v in values]
    assert column(spark, values, text.first_sentence(t)) == [v.split(".")[0] if "." in v else v[:100] for v in values]
    assert column(spark, values, text.strip(t)) == [v.strip() for v in values]
    cut = [v if len(v.split()) <= 3 else " ".join(v.split()[:3]) for v in values]
    assert column(spark, values, text.truncate_words(t, 3)) == cut


def test_same_bag_for_reworded_text(spark):
    bags = column(spark, ["Build the RED card, 2 cards!", "Create cards: red CARD 99"], text.token_bag(F.col("t")))
    assert bags == ["card cards red"] * 2


@pytest.mark.parametrize(
    "value,want",
    [("ai_tools-agents saaS", "Ai Tools Agents SaaS"), ("", ""), ("élan vital", "éLan Vital"), ("a--b__c", "A B C"), ("(x) y", "(X) Y")],
)
def test_humanize(spark, value, want):
    assert column(spark, [value], text.humanize(F.col("t"))) == [want]


def test_formats(spark):
    row = spark.range(1).select(
        text.grouped_number(F.lit(10000)), text.comma_decimal(F.lit(9.06)),
        text.haystack([F.lit("A"), F.lit(None).cast("string"), F.lit("b")], [F.array(F.lit("C")), F.array().cast("array<string>")]),
        text.kebab_tag(F.lit("UI Kit_x!")), text.slugify(F.lit("--Hello, World!--")),
    ).first()
    assert tuple(row) == ("10.000", "9,06", "a  b c", "ui-kit-x", "hello-world")


def test_ratio_rounds_like_python(spark):
    pairs = spark.range(1, 241).select(F.col("id").alias("u"), F.explode(F.sequence(F.lit(0), F.col("id"))).alias("i"))
    rows = pairs.select("i", "u", rounded_ratio(F.col("i"), F.col("u")).alias("x")).collect()
    assert all(r.x == round(r.i / r.u, 3) for r in rows)


