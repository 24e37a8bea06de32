"""The key-range query: two independent bounds and a limit."""

from __future__ import annotations

import json
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NO_LIMIT = (1 << 63) - 1


@dataclass(frozen=True)
class KeyQuery:
    """Keys from ``min_key`` to ``max_key`` (None: open), each bound inclusive or not, and at most ``limit`` records."""

    min_key: str | None = None
    min_inclusive: bool = True
    max_key: str | None = None
    max_inclusive: bool = True
    limit: int = NO_LIMIT

    def __post_init__(self) -> None:
        for bound in (self.min_key, self.max_key):
            if bound is not None and not isinstance(bound, str):
                raise TypeError("a bound is text or None")
        if not isinstance(self.limit, int) or self.limit <= 0:
            raise ValueError("limit must be above 0")

    def with_min_key(self, key: str, inclusive: bool = True) -> KeyQuery:
        return replace(self, min_key=key, min_inclusive=inclusive)

    def with_max_key(self, key: str, inclusive: bool = True) -> KeyQuery:
        return replace(self, max_key=key, max_inclusive=inclusive)

    def with_no_min_bound(self) -> KeyQuery:
        return replace(self, min_key=None, min_inclusive=True)

    def with_no_max_bound(self) -> KeyQuery:
        return replace(self, max_key=None, max_inclusive=True)

    def with_limit(self, limit: int) -> KeyQuery:
        return replace(self, limit=limit)

    def with_no_limit(self) -> KeyQuery:
        return replace(self, limit=NO_LIMIT)

    def condition(self, key: Column | str = "key") -> Column | None:
        """The bounds as one condition, or None if both are open. An inverted range holds nothing."""
        key = F.col(key) if isinstance(key, str) else key
        parts = []
        if self.min_key is not None:
            parts.append(key >= self.min_key if self.min_inclusive else key > self.min_key)
        if self.max_key is not None:
            parts.append(key <= self.max_key if self.max_inclusive else key < self.max_key)
        return parts[0] & parts[1] if len(parts) == 2 else parts[0] if parts else None

    def bound(self, rows: DataFrame, key: str = "key") -> DataFrame:
        """``rows`` within the bounds."""
        return rows if (test := self.condition(key)) is None else rows.where(test)

    def limited(self, rows: DataFrame, key: str = "key") -> DataFrame:
        """``rows`` in key order, as many as the limit allows."""
        ordered = rows.orderBy(key)
        return ordered if self.limit >= 1 << 31 else ordered.limit(self.limit)

    def to_json(self) -> str:
        out: dict[str, object] = {}
        if self.min_key is not None:
            out |= {"MIN_VALUE": self.min_key, "IS_MIN_INCLUSIVE": self.min_inclusive}
        if self.max_key is not None:
            out |= {"MAX_VALUE": self.max_key, "IS_MAX_INCLUSIVE": self.max_inclusive}
        return json.dumps(out | {"LIMIT": self.limit})

    @classmethod
    def from_json(cls, text: str) -> KeyQuery:
        """LIMIT is mandatory; a missing bound is open."""
        x = json.loads(text)
        if "LIMIT" not in x:
            raise ValueError("LIMIT is missing")
        query = cls(limit=int(x["LIMIT"]))
        if "MIN_VALUE" in x:
            query = query.with_min_key(x["MIN_VALUE"], bool(x["IS_MIN_INCLUSIVE"]))
        if "MAX_VALUE" in x:
            query = query.with_max_key(x["MAX_VALUE"], bool(x["IS_MAX_INCLUSIVE"]))
        return query


ALL = KeyQuery()
