"""Access to semi-structured records held as VARIANT.

Only VARIANT keeps a missing field, a null field and a wrongly typed field apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def once(df: DataFrame, name: str, expensive: Column) -> DataFrame:
    """Add a column that is evaluated exactly once per row.

    The optimizer copies a column's expression into every filter it pushes down. A
    generator's output is not copied, so a parsed record is not parsed once per rule.
    """
    held = df.withColumn("_held", expensive)
    return held.withColumn(name, F.explode_outer(F.array("_held"))).drop("_held")


def _path(path: tuple[str, ...]) -> str:
    return "'$" + "".join(f".{p}" for p in path) + "'"


def _get(v: str, path: tuple[str, ...], type_name: str) -> str:
    return f"try_variant_get({v}, {_path(path)}, '{type_name}')"


def at(v: str, *path: str) -> Column:
    """Sub-variant of column ``v``, SQL NULL when the path is missing."""
    return F.expr(_get(v, path, "variant"))


def text_at(v: str, *path: str) -> Column:
    return F.expr(_get(v, path, "string"))


def long_at(v: str, *path: str) -> Column:
    return F.expr(_get(v, path, "long"))


def strings_at(v: str, *path: str) -> Column:
    return F.expr(_get(v, path, "array<string>"))


def items_at(v: str, *path: str) -> Column:
    return F.expr(_get(v, path, "array<variant>"))


def struct_at(v: str, fields: str, *path: str) -> Column:
    return F.expr(_get(v, path, f"struct<{fields}>"))


def map_at(v: str, *path: str) -> Column:
    return F.expr(_get(v, path, "map<string,variant>"))


def type_at(v: str, *path: str) -> Column:
    """Type name such as STRING, BIGINT, VOID, ARRAY<...>; NULL when missing."""
    return F.expr(f"schema_of_variant({_get(v, path, 'variant')})")


def is_string(t: Column) -> Column:
    return t == "STRING"


def is_integer(t: Column) -> Column:
    return t == "BIGINT"


def is_array(t: Column) -> Column:
    return t.startswith("ARRAY<")


def is_object(t: Column) -> Column:
    return t.startswith("OBJECT<")


def truthy(kind: Column, text: Column) -> Column:
    """The text, NULL for anything empty: missing, null, '', 0, false, [] and {}."""
    empties = ["0", "0.0", "false", "[]", "{}"]
    return F.when(
        kind == "STRING", F.nullif(text, F.lit(""))
    ).otherwise(F.when(~text.isin(*empties), text))


def key_count(v: str, *path: str) -> Column:
    """Number of keys of an object field, NULL when it is not an object."""
    return F.expr(f"cardinality({_get(v, path, 'map<string,variant>')})")


class Facts:
    """Facts about a record that several expressions need, each computed once.

    Asking for a fact gives a column to use in later expressions; ``measure`` adds all
    facts that were asked for to the DataFrame in one projection.
    """

    def __init__(self, rec: str = "rec") -> None:
        self._rec = rec
        self._columns: dict[str, Column] = {}

    def add(self, name: str, c: Column) -> Column:
        self._columns.setdefault(f"_f_{name}", c)
        return F.col(f"_f_{name}")

    def _known(self, name: str, make) -> Column:
        if f"_f_{name}" not in self._columns:
            self._columns[f"_f_{name}"] = make()
        return F.col(f"_f_{name}")

    def type(self, *path: str) -> Column:
        return self._known("type_" + "_".join(path), lambda: type_at(self._rec, *path))

    def text(self, *path: str) -> Column:
        return self._known("text_" + "_".join(path), lambda: text_at(self._rec, *path))

    def raw_text(self, *path: str) -> Column:
        """Text for use inside another fact."""
        return text_at(self._rec, *path)

    def long(self, *path: str) -> Column:
        return self._known("long_" + "_".join(path), lambda: long_at(self._rec, *path))

    def strings(self, *path: str) -> Column:
        return self._known("list_" + "_".join(path), lambda: strings_at(self._rec, *path))

    def keys(self, *path: str) -> Column:
        return self._known("keys_" + "_".join(path), lambda: key_count(self._rec, *path))

    def truthy(self, *path: str) -> Column:
        return truthy(self.type(*path), self.text(*path))

    @property
    def names(self) -> list[str]:
        return list(self._columns)

    def measure(self, df: DataFrame) -> DataFrame:
        return df.withColumns(self._columns)

    def drop(self, df: DataFrame) -> DataFrame:
        return df.drop(*self._columns)
