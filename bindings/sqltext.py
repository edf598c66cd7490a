"""SQL fragments for the checking side."""

from __future__ import annotations

from tidemark import vocab

_SPACE = r"\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
SPACES = f"[{_SPACE}]+"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def lits(values) -> str:
    return "[" + ", ".join(lit(v) for v in values) + "]"


def words(expr: str) -> str:
    return f"list_filter(regexp_split_to_array({expr}, '{SPACES}'), lambda w: w <> '')"


def word_count(expr: str) -> str:
    return f"len({words(expr)})"


def token_bag(expr: str) -> str:
    plain = f"regexp_replace(lower({expr}), '[^\\p{{L}}\\p{{N}}_{_SPACE}]', ' ', 'g')"
    plain = f"regexp_replace({plain}, '\\p{{Nd}}+', ' ', 'g')"
    kept = (
        f"list_filter(regexp_split_to_array({plain}, '{SPACES}'), "
        f"lambda w: length(w) > 2 AND NOT list_contains({lits(vocab.STOPWORDS)}, w))"
    )
    return f"array_to_string(list_sort({kept}), ' ')"


def first_sentence(expr: str) -> str:
    return f"CASE WHEN contains({expr}, '.') THEN split_part({expr}, '.', 1) ELSE substring({expr}, 1, 100) END"


def opening(expr: str) -> str:
    return f"lower(array_to_string(list_slice({words(expr)}, 1, 5), ' '))"


def slug(expr: str) -> str:
    return f"trim(regexp_replace(lower({expr}), '[^a-z0-9]+', '-', 'g'), '-')"


def pick(values, i: str = "doc_id") -> str:
    return f"list_extract({lits(values)}, CAST({i} % {len(values)} AS INT) + 1)"


def mapped(expr: str, valid, synonyms, default: str) -> str:
    cases = " ".join(f"WHEN {expr} = {lit(k)} THEN {lit(v)}" for k, v in synonyms.items())
    listed = ", ".join(lit(v) for v in valid)
    return f"CASE WHEN {expr} IN ({listed}) THEN {expr} {cases} ELSE {lit(default)} END"


def humanize(expr: str) -> str:
    """For ASCII words that hold no inner punctuation."""
    parts = f"string_split(regexp_replace({expr}, '[_-]+', ' ', 'g'), ' ')"
    return (
        f"array_to_string(list_transform({parts}, "
        "lambda w: upper(left(w, 1)) || substring(w, 2)), ' ')"
    )
