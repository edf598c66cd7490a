"""Which column of a table plays which role of a record."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class RecordSpec:
    """Column bindings. ``pos`` is a BIGINT that is unique and follows input order."""

    id: str = "id"
    pos: str = "pos"
    text: str = "prompt"
    title: str = "title"
    slug: str = "slug"
    category: str = "category"
    unique_ids: bool = False


RECORDS = RecordSpec()
