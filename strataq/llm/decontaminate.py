"""Benchmark decontamination: q-gram lemma filter and banded alignment.

An item leaks into a document if the whole item stands there with at most
``ERRORS`` of its length in single-character edits.  Then at least
``m - Q + 1 - Q * edits`` of its q-grams are in the document, on diagonals
(place in the document less place in the item) no further apart than the edits
allow.  So: all q-grams of a slice of documents are looked up in the items'
index at once; for each item, places with a shared q-gram are counted in
overlapping bands of diagonals, each twice the budget wide; a band with enough
places is verified by an alignment within its diagonals.

A place counts once in a band, however often its q-gram is in the item, and a
q-gram that an item has more than ``DENSE`` times counts in every band between
its first and last place there.  So a place adds to a bounded number of bands
of an item, texts of one repeated character included, and no list of pairs is
longer than ``PAIRS``; the surplus is weeded out by the alignment.

Letters are compared without case and white space without kind, character by
character, so offsets are those of the text.

The items are the stated query set, of any size: they are taken in blocks of
``BLOCK`` characters at most, and only one block is sent to tasks at a time.
Documents stay where they are.

Defined cases: a null text is empty; items that are null or shorter than ``Q``
characters are no evidence and match nothing; items shorter than ``LEAST`` must
stand there without edits; longer ones count as a whole, whatever their length
(the alignment takes time by the square of it); identifiers may be of any type;
repeated documents are judged one by one; of several places the one with the
fewest edits counts, then the first; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from strataq.llm._text import mix, settle, slices, texts

Q = 8
ERRORS = 0.08
LEAST = 32
DENSE, PAIRS = 16, 4_000_000
BLOCK = 2_000_000
_TABLE = 20
_BASE = 0x9E3779B97F4A7C15
_FOLD = np.array([ord(chr(c).lower()) if len(chr(c).lower()) == 1 else c for c in range(0x590)], np.uint32)
_FOLD[9:14] = 32


def folded(text: str) -> np.ndarray:
    """Code points without case and kind of white space."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < len(_FOLD), _FOLD[np.minimum(points, len(_FOLD) - 1)], points)


def _grams(points: np.ndarray) -> np.ndarray:
    """A hash of the Q (8) code points from each place on."""
    h = points.astype(np.uint64)
    for half in (1, 2, 4):
        factor = np.uint64(pow(_BASE, half, 1 << 64))
        h = h[:-half] * factor + h[half:] if len(h) > half else h[:0]
    return mix(h)


def budget(m: int) -> int:
    """Edits allowed in an item of ``m`` characters."""
    return int(ERRORS * m) if m >= LEAST else 0


def least_grams(m: int) -> int:
    """q-grams that the budget leaves at least."""
    return max(1, m - Q + 1 - Q * budget(m))


class Items:
    """Items with an index of their q-grams: of each q-gram the items that have it, and where.

    Places that stand for a whole stretch of diagonals have ``last`` behind ``place``; others have both alike."""

    def __init__(self, rows: list[tuple[object, str]]) -> None:
        long_enough = [x for x in rows if len(x[1]) >= Q]
        self.ids = [x[0] for x in long_enough]
        self.points = [folded(x[1]) for x in long_enough]
        self.size = np.array([len(p) for p in self.points], np.int64)
        self.width = np.array([budget(m) + 1 for m in self.size], np.int64)
        self.least = np.array([least_grams(m) for m in self.size], np.int64)
        grams = [_grams(p) for p in self.points]
        every = np.concatenate([np.empty(0, np.uint64), *grams])
        item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        place = np.concatenate([np.empty(0, np.int64), *(np.arange(len(g)) for g in grams)])
        order = np.lexsort((place, item, every))
        every, item, place = every[order], item[order], place[order]
        new = np.concatenate(([True], (every[1:] != every[:-1]) | (item[1:] != item[:-1])))[: len(every)]
        first = np.flatnonzero(new)
        n = np.diff(np.append(first, len(every)))
        kept = np.repeat(n <= DENSE, n) | new  # of a dense q-gram only the first place, which stands for all
        last = place.copy()
        last[first[n > DENSE]] = place[(first + n - 1)[n > DENSE]]
        self.item, self.place, self.last = item[kept], place[kept], last[kept]
        self.grams, self.start = np.unique(every[kept], return_index=True)
        self.start = np.append(self.start, len(self.item))
        self.table = np.zeros(1 << _TABLE, bool)
        self.table[self.grams >> np.uint64(64 - _TABLE)] = True

    def found(self, points: np.ndarray, usable: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the texts, place in the index) of every q-gram that is in the index."""
        grams = _grams(points)
        at = np.flatnonzero(self.table[grams >> np.uint64(64 - _TABLE)] & usable[: len(grams)])
        if not len(self.grams):
            return at[:0], at[:0]
        found = np.minimum(np.searchsorted(self.grams, grams[at]), len(self.grams) - 1)
        same = self.grams[found] == grams[at]
        return at[same], found[same]

    def entries(self, at: np.ndarray, found: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(place in the texts, entry of the index) of what was found, so many at a time."""
        n = self.start[found + 1] - self.start[found]
        for part in _parts(n):
            yield np.repeat(at[part], n[part]), _spread(self.start[found[part]], n[part])

    def bands(self, diagonal: np.ndarray, entry: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """(places, how many bands each is in, these bands), so many at a time; ``diagonal`` is of the item's start at the place. A band starts at a step of the width and is two wide."""
        width = self.width[self.item[entry]]
        top, bottom = (diagonal - self.place[entry]) // width, (diagonal - self.last[entry]) // width - 1
        n = top - bottom + 1
        for part in _parts(n):
            yield part, n[part], _spread(bottom[part], n[part])


def _parts(n: np.ndarray) -> Iterator[slice]:
    """Consecutive ranges with about ``PAIRS`` in sum."""
    ends, low = np.cumsum(n), 0
    while low < len(n):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + PAIRS, side="right")))
        yield slice(low, high)
        low = high


def _tallied(keys: np.ndarray, counts: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with their counts, ``more`` added."""
    new, n = np.unique(more, return_counts=True)
    if not len(keys):
        return new, n
    keys, counts = np.concatenate((keys, new)), np.concatenate((counts, n))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts, first)


def _spread(starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (n[0] of them), starts[1], ..."""
    return np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def aligned(item: np.ndarray, text: np.ndarray, low: int, high: int, most: int | None = None) -> tuple[int, int]:
    """(edits, end in ``text``) of the best place of the whole item, over diagonals ``low`` to ``high``; the first of equals.

    With ``most`` it may stop as soon as there are more edits than that."""
    width = high - low + 1
    far = len(item) + len(text) + 1
    step = np.arange(width)
    column = low + step  # in the text, at row 0
    row = np.where((column >= 0) & (column <= len(text)), 0, far)
    for i, c in enumerate(item):
        column = low + step + i + 1
        inside = (column >= 0) & (column <= len(text))
        kind = text[np.clip(column - 1, 0, max(0, len(text) - 1))] if len(text) else np.zeros(width, np.uint32)
        best = row + ((kind != c) | (column < 1))
        best[:-1] = np.minimum(best[:-1], row[1:] + 1)
        best = np.where(inside, best, far)
        row = np.where(inside, np.minimum.accumulate(best - step) + step, far)
        if most is not None and i % 32 == 31 and row.min() > most:
            return far, 0
    at = int(np.argmin(row))
    return int(row[at]), low + at + len(item)


def matches(items: Items, column: pa.Array) -> list[tuple[int, int, int, int, int]]:
    """(row, item, start, end, edits) of every item that leaks into a text, at its best place."""
    column = texts(column)
    joined = folded("".join(column.to_pylist()))
    sizes = pc.utf8_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    doc = np.repeat(np.arange(len(sizes), dtype=np.int64), sizes)
    usable = np.arange(len(joined)) + Q <= ends[doc]
    at, found = items.found(joined, usable)
    if not len(at):
        return []
    none = np.empty(0, np.int64)
    pairs, n = none, none  # texts and items with places in common
    for place, entry in items.entries(at, found):
        pairs, n = _tallied(pairs, n, doc[place] * len(items.ids) + items.item[entry])
    pairs = pairs[n >= items.least[pairs % len(items.ids)]]
    if not len(pairs):
        return []
    longest = int(items.size.max())
    span = len(joined) + longest + 4  # more than there are bands
    banded, n = none, none
    for place, entry in items.entries(at, found):
        pair = doc[place] * len(items.ids) + items.item[entry]
        near = pairs[np.minimum(np.searchsorted(pairs, pair), len(pairs) - 1)] == pair
        place, entry, pair = place[near], entry[near], pair[near]
        for part, many, band in items.bands(place - starts[doc[place]], entry):
            whose, once = np.repeat(pair[part], many) * span + band + longest + 2, np.repeat(place[part], many)
            order = np.lexsort((once, whose))
            whose, once = whose[order], once[order]
            banded, n = _tallied(banded, n, whose[np.concatenate(([True], (whose[1:] != whose[:-1]) | (once[1:] != once[:-1])))[: len(whose)]])
    pair, band = banded // span, banded % span - longest - 2
    row, item = pair // len(items.ids), pair % len(items.ids)
    good = n >= items.least[item]
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for r, k, b in zip(row[good].tolist(), item[good].tolist(), band[good].tolist()):
        if (found := best.get((r, k))) and found[0] == 0:
            continue
        points, w, m = items.points[k], int(items.width[k]), int(items.size[k])
        low, high = b * w - w, b * w + 3 * w
        at = max(0, low)
        text = joined[starts[r] + at : min(ends[r], starts[r] + max(0, high + m))]
        edits, end = aligned(points, text, low - at, high - at, w - 1)
        if edits < w:
            back, length = (0, m) if not edits else aligned(points[::-1], text[:end][::-1], -w, w)
            one = (edits, at + end - length, at + end)
            best[r, k] = min(found, one) if found else one
    return [(r, k, start, end, edits) for (r, k), (edits, start, end) in sorted(best.items())]


def item_blocks(benchmark: DataFrame) -> Iterator[list[tuple[object, str]]]:
    """The distinct items, in blocks of about ``BLOCK`` characters."""
    items = benchmark.where("text is not null").select("item_id", F.col("text").cast("string").alias("text")).distinct()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-total // BLOCK)
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()
        yield sorted(((r["item_id"], r["text"]) for r in rows), key=lambda x: (str(x[0]), x[1]))


def _finding(block, key: str, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(block.value)
        for batch in batches:
            for part in slices(batch, "text"):
                found = matches(items, part.column("text"))
                columns = list(zip(*found)) or [()] * 5
                yield pa.RecordBatch.from_arrays(
                    [part.column(key).take(pa.array(columns[0], pa.int64())), pa.array([items.ids[k] for k in columns[1]], kind), *(pa.array(c, pa.int64()) for c in columns[2:])],
                    [key, "item_id", "start", "end", "edits"],
                )
            settle()

    return run


def find_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key``, item_id, start, end and edits of every leak."""
    context = docs.sparkSession.sparkContext
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, item_id {benchmark.schema['item_id'].dataType.simpleString()}, start long, end long, edits long"
    out = docs.sparkSession.createDataFrame([], schema)
    for k, rows in enumerate(item_blocks(benchmark)):
        found = docs.select(key, "text").mapInArrow(_finding(context.broadcast(rows), key, to_arrow_type(benchmark.schema["item_id"].dataType)), schema)  # a block has a bounded size
        out = found if k == 0 else out.unionAll(found)
    return out


def _clearing(block):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(block.value)
        for batch in batches:
            for part in slices(batch, "text"):
                clean = np.ones(part.num_rows, bool)
                clean[[m[0] for m in matches(items, part.column("text"))]] = False
                yield part.filter(pa.array(clean))
            settle()

    return run


def drop_leaked(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that no item leaks into, with their own columns."""
    context = docs.sparkSession.sparkContext
    for rows in item_blocks(benchmark):
        docs = docs.mapInArrow(_clearing(context.broadcast(rows)), docs.schema)
    return docs


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every leak of a benchmark item into a document."""
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {"op9_decontaminate": op9_decontaminate}
ORACLE_SQL: dict[str, str] = {}
