"""Timings of operations: counts, means and quantiles from histograms of bounded size."""

from __future__ import annotations

import math
import threading
import time
from collections import Counter, defaultdict
from collections.abc import Iterator
from contextlib import contextmanager

PARTS = 16  # classes for each doubling: a quantile is off by 4.5 % at most
QUANTILES = (0.5, 0.75, 0.99, 0.999, 0.9999)


class Timings:
    """Seconds taken by operations, by name; may be used by many threads."""

    def __init__(self) -> None:
        self.lock = threading.Lock()
        self.classes: dict[str, Counter[int]] = defaultdict(Counter)
        self.sums: dict[str, float] = defaultdict(float)

    def add(self, name: str, seconds: float) -> None:
        with self.lock:
            self.classes[name][math.ceil(PARTS * math.log2(max(seconds, 1e-9)))] += 1
            self.sums[name] += seconds

    @contextmanager
    def of(self, name: str) -> Iterator[None]:
        """Times what is done inside, if it succeeds."""
        start = time.perf_counter()
        yield
        self.add(name, time.perf_counter() - start)

    def table(self) -> dict[str, dict[str, float]]:
        """For each operation its count, mean, and quantiles (as p50 and so on)."""
        out = {}
        with self.lock:
            for name, classes in self.classes.items():
                n, row = sum(classes.values()), {}
                for q in QUANTILES:
                    left = math.ceil(q * n)
                    for k in sorted(classes):
                        left -= classes[k]
                        if left <= 0:
                            break
                    row[f"p{q * 100:g}"] = 2.0 ** (k / PARTS)
                out[name] = {"count": n, "mean": self.sums[name] / n} | row
        return out
