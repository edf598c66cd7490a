"""Text columns built only from Spark built-ins, so they stay on the JVM side.

White space means what Unicode calls white space plus U+001C..U+001F. Word
characters are Unicode letters and numbers plus the underscore; combining marks
are not word characters.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F

from .. import vocab

_WS = r"\s\x1c-\x1f"
SPACES = f"(?U)[{_WS}]+"
WORD = f"(?U)[^{_WS}]+"
_EDGE_SPACES = f"(?U)^[{_WS}]+|[{_WS}]+$"


def has_text(c: Column) -> Column:
    return c.rlike(WORD)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, _EDGE_SPACES, "")


def words(c: Column) -> Column:
    """White-space separated words, in order."""
    return F.filter(F.split(c, SPACES), lambda w: w != "")


def word_count(c: Column) -> Column:
    """Number of words; 0 for empty text."""
    return F.regexp_count(c, F.lit(WORD)).cast("int")


def first_words(c: Column, n: int = vocab.OPENING_WORDS) -> Column:
    """Lower-cased first ``n`` words joined by one space, read without splitting the rest."""
    head = F.regexp_extract(c, f"(?U)^[{_WS}]*+([^{_WS}]++(?:[{_WS}]++[^{_WS}]++){{0,{n - 1}}})", 1)
    return F.lower(F.regexp_replace(head, SPACES, " "))


def cut_words(c: Column, n: int) -> Column:
    """The first ``n`` words joined by one space."""
    return F.array_join(F.slice(words(c), 1, n), " ")


def truncate_words(c: Column, n: int) -> Column:
    """``cut_words`` when there are more than ``n`` words, else the text itself."""
    return F.when(word_count(c) > n, cut_words(c, n)).otherwise(c)


def first_sentence(c: Column, fallback_chars: int = vocab.SENTENCE_FALLBACK_CHARS) -> Column:
    """Text before the first full stop; without one, the first ``fallback_chars`` characters."""
    return F.when(F.contains(c, F.lit(".")), F.substring_index(c, ".", 1)).otherwise(
        F.substring(c, 1, fallback_chars)
    )


def token_bag(c: Column, stopwords: Iterable[str] = vocab.STOPWORDS, min_chars: int = 3) -> Column:
    """Sorted, space-joined words without punctuation, digits, stopwords and short words."""
    # Everything but letters, underscores and non-decimal numerals separates words, so
    # punctuation, digits and white space go in one split.
    kept = F.filter(
        F.split(F.lower(c), r"[^\p{L}\p{Nl}\p{No}_]+"),
        lambda w: (F.length(w) >= min_chars) & ~w.isin(*stopwords),
    )
    return F.array_join(F.sort_array(kept), " ")


def fingerprint(c: Column, stopwords: Iterable[str] = vocab.STOPWORDS) -> Column:
    """SHA-256 hex digest of the token bag."""
    return F.sha2(token_bag(c, stopwords), 256)


def token_set(c: Column) -> Column:
    """Distinct lower-cased words, punctuation kept."""
    return F.array_distinct(words(F.lower(c)))


def slugify(c: Column) -> Column:
    dashed = F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-")
    return F.regexp_replace(dashed, "^-+|-+$", "")


def kebab_tag(c: Column) -> Column:
    return F.regexp_replace(F.translate(F.lower(c), " _", "--"), "[^a-z0-9-]", "")


def humanize(c: Column) -> Column:
    """``snake_case`` and ``kebab-case`` to spaced words; only first ASCII letters change case."""
    spaced = F.regexp_replace(c, "[_-]+", " ")
    pieces = F.split(spaced, "(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])")

    def raise_first(w: Column) -> Column:
        head = F.left(w, F.lit(1))
        return F.when(head.between("a", "z"), F.concat(F.upper(head), F.substr(w, F.lit(2)))).otherwise(w)

    return F.when(F.coalesce(c, F.lit("")) == "", F.lit("")).otherwise(
        F.array_join(F.transform(pieces, raise_first), "")
    )


def grouped_number(c: Column) -> Column:
    """Whole number with dots between groups of three digits."""
    return F.translate(F.format_number(c, 0), ",", ".")


def comma_decimal(c: Column, places: int = 2) -> Column:
    return F.translate(F.format_string(f"%.{places}f", c.cast("double")), ".", ",")


def or_default(c: Column, default: Column) -> Column:
    """``default`` where the text is null or empty."""
    return F.coalesce(F.nullif(c, F.lit("")), default)


def haystack(scalars: Iterable[Column], lists: Iterable[Column]) -> Column:
    """Lower-cased text that free-text search looks into. Empty scalars keep their slot."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in scalars]
    return F.lower(F.concat_ws(" ", *parts, *lists))
