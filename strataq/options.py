"""Table options: defaults, ranges, parsing and their JSON form (all values as text)."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass


@dataclass(frozen=True)
class Option:
    default: bool | int | float
    low: float | None = None
    high: float | None = None

    def parse(self, name: str, value: object) -> bool | int | float:
        """The value in the option's type; ValueError outside its range."""
        if isinstance(self.default, bool):
            text = str(value).strip().lower()
            if text not in ("true", "false"):
                raise ValueError(f"{name} must be true or false, not {value!r}")
            return text == "true"
        try:
            number = type(self.default)(str(value))
        except ValueError:
            raise ValueError(f"{name} must be a number, not {value!r}") from None
        if (self.low is not None and number < self.low) or (self.high is not None and number > self.high):
            raise ValueError(f"{name} must be from {self.low} to {self.high}, not {number}")
        return number


# Wire names, defaults and ranges.  Some are known, checked and stored, but have nothing to act on here:
# KV_TABLE_COMMIT_LOG_PARALLELISM (the log is one file), LSM_SYNC_WITH_THREAD_FLUSH (a put waits for the flush that it
# sets off), LSM_SPARSE_INDEX_SIZE_RECORDS (Parquet has its own page index), and all of BPLUS_* but BPLUS_TREE_ORDER (there is no buffer).
TABLE_OPTIONS = {
    "KV_TABLE_ENABLE_WAL": Option(True),
    "KV_TABLE_COMMIT_LOG_PARALLELISM": Option(10, 1, 1000),
    "KV_TABLE_ENABLE_PERIODIC_CHECKPOINT": Option(False),
    "KV_TABLE_TRIGGER_CHECKPOINT_AFTER_SEC": Option(10, 1, 108_000),
}
LSM_OPTIONS = {
    "LSM_SYNC_WITH_THREAD_FLUSH": Option(False),
    "LSM_MAX_SSTABLES": Option(50, 1, 16_384),
    "ENABLE_MERGE_IF_MAX_SSTABLES": Option(False),
    "ENABLE_BACKGROUND_MERGER": Option(False),
    "BACKGROUND_MERGE_INIT_DELAY": Option(60, 0, 108_000),
    "TRIGGER_SSTABLES_MERGE_AFTER_SEC": Option(3600, 1, 108_000),
    "LSM_SPARSE_INDEX_SIZE_RECORDS": Option(128, 1, 16_384),
    "LSM_MEM_CACHE_SIZE": Option(100_000, 1, 10_000_000),
    "LSM_BLOOM_FILTER_FALSE_POSITIVE_RATE": Option(0.5, 0.001, 0.99),
}
BPLUS_OPTIONS = {
    "BPLUS_TREE_ORDER": Option(400, 3, 451),
    "BPLUS_TREE_PAGE_BUFFER_SIZE_BYTES": Option(40_000_000, 100_000, None),
    "BPLUS_FREE_SPACE_CHECKER_CACHE_MAX": Option(10, 1, 1022),
    "BPLUS_FREE_SPACE_CHECKER_CACHE_INIT": Option(10, 1, 1022),
}
ENGINES = {"lsm": LSM_OPTIONS, "bplus": BPLUS_OPTIONS}


def resolve(engine: str, given: Mapping[str, object] | None = None) -> dict[str, dict[str, bool | int | float]]:
    """All options of a table as {"engine": ..., "table": ...}, with defaults for those not given."""
    if engine not in ENGINES:
        raise ValueError(f"engine must be one of {', '.join(sorted(ENGINES))}, not {engine!r}")
    given = dict(given or {})
    known = ENGINES[engine] | TABLE_OPTIONS
    if unknown := sorted(set(given) - set(known)):
        raise ValueError(f"no such option for engine {engine}: {', '.join(unknown)}")
    values = {k: o.parse(k, given[k]) if k in given else o.default for k, o in known.items()}
    if engine == "bplus" and values["BPLUS_FREE_SPACE_CHECKER_CACHE_INIT"] > values["BPLUS_FREE_SPACE_CHECKER_CACHE_MAX"]:
        raise ValueError("BPLUS_FREE_SPACE_CHECKER_CACHE_INIT must not exceed BPLUS_FREE_SPACE_CHECKER_CACHE_MAX")
    return {"engine": {k: values[k] for k in ENGINES[engine]}, "table": {k: values[k] for k in TABLE_OPTIONS}}


def as_text(options: Mapping[str, Mapping[str, object]]) -> dict[str, dict[str, str]]:
    """The JSON form."""
    return {part: {k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in values.items()} for part, values in options.items()}
