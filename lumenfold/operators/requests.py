"""Checks of request parameters, and hits as JSON."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.date_text import parse_since
from ..functions.text import search_terms

LIST_LIMITS = (1, 500, 50)
SEARCH_LIMITS = (1, 100, 20)


def _limit(value, bounds: tuple[int, int, int]) -> int:
    least, most, default = bounds
    if value is None:
        return default
    try:
        n = int(str(value).strip())
    except ValueError:
        raise ValueError(f"limit must be a whole number, not {value!r}") from None
    if not least <= n <= most:
        raise ValueError(f"limit must be from {least} to {most}")
    return n


def _flag(value, default: bool) -> bool:
    if value is None or isinstance(value, bool):
        return default if value is None else value
    word = str(value).strip().lower()
    if word in ("true", "1", "yes", "on", "y", "enabled"):
        return True
    if word in ("false", "0", "no", "off", "n", "disabled"):
        return False
    raise ValueError(f"not a flag: {value!r}")


@dataclass(frozen=True)
class ListRequest:
    unread: bool
    limit: int
    source_id: str | None


@dataclass(frozen=True)
class SearchRequest:
    terms: list[str]
    limit: int
    since: datetime | None
    source_id: str | None
    unread_only: bool


def list_request(unread=None, limit=None, source_id: str | None = None) -> ListRequest:
    """Unread by default, 1 to 500 items, 50 by default; anything else raises."""
    return ListRequest(_flag(unread, True), _limit(limit, LIST_LIMITS), source_id or None)


def search_request(q, now: datetime, limit=None, since: str | None = None, source_id: str | None = None, unread_only=None) -> SearchRequest:
    """A query that is not blank, 1 to 100 hits, 20 by default; an unreadable
    `since` raises, for it must never widen a search."""
    if q is None or not str(q).strip():
        raise ValueError("q must not be empty")
    return SearchRequest(search_terms(str(q)), _limit(limit, SEARCH_LIMITS), parse_since(since, now), source_id or None, _flag(unread_only, False))


def as_json(rows: DataFrame) -> DataFrame:
    """One JSON document per row, null fields included."""
    return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("json"))
