"""N-gram Jaccard join by grouped prefixes, and the classes its links make.

A document's set holds the distinct shingles of ``WIDTH`` words (64-bit
hashes); two documents link when ``100 * intersection >= PERCENT * union``.
The join is exact up to hash collisions, and no candidate is dropped.  A
shingle's name is 48 bits of its hash and the bucket that other bits deal it to.

1. Equal sets are one node, named by a hash of the set, so copies are neither
   compared nor expanded.  Shingles that are frequent within some batch are
   summed, and those of at least 1 in ``RARE`` documents make the "heavy" list;
   its length is bounded by ``RARE`` times the mean size of a set.
2. In the order of hashes, heavy ones last, similar sets have their first ``m``
   common shingles within their first ``n - ceil(PERCENT * n / 100) + m`` each.
   With an ``m`` of 1 in ``MARGIN`` of a set, these prefixes are dealt by hash,
   packed by batch (each set once a batch), and sets that share too few of theirs
   with others are done.  The texts of the rest are marked in a bitmap of their
   digests; its size is bounded, and a text that has a mark by chance does no harm.
   The marked sets' shingles are dealt whole and counted: those of one set only
   can be in no intersection, the others go back to their sets with their count's
   class.  Heavy shingles skip both, so no task gathers the documents of a
   frequent shingle.
3. A set orders its shingles from rare to frequent: unshared ones first, then
   by class of count.  Sets whose shared shingles are too few are done.  Of the
   rest, similar sets share a shingle in their prefixes of
   ``n - ceil(PERCENT * n / 100) + 1``.
4. Sets of the same size and prefix form one group, and groups that share a
   prefix shingle are candidates.  Verification starts with stars: each set
   against ``HUBS`` hubs of other classes among its candidates (a shingle has
   those of the classes least by as many hashes; a set takes those that most of
   its shingles have), again while that joins many classes, and the head of its group.
   Then up to ``MORE`` times each remaining set against ``TRIES`` members, drawn
   anew, of the largest class that most of its shingles have: a set may be
   similar to a small part of a class only.
   This joins large groups of near copies without their pairs.  Then every
   candidate pair of groups, filtered by size and position, is expanded to the
   members that are not yet in one class; those whose sketches (the parities of
   512 hashed parts of a set) differ in more places than similar sets can differ
   in shingles are done, and each other pair is verified.  So a pair goes unverified only if its sets are known to be in one class, and
   the classes are those of all links.  ``link_counts`` verifies these pairs too.
5. Classes are the connected components of the links: labels are propagated
   and halved until they rest, with a table in the shared folder each round.

Defined cases: null, empty and white-space texts have the empty set and link
with nothing; a text of fewer than ``WIDTH`` words has one shingle, its whole
sequence; rows that repeat an identifier are documents of their own, and a
class is named by its least identifier (null only if all are null); an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataq.llm._store import Scope, drop, kept
from strataq.llm._text import combine, hashed_words, mix, settle, slices, texts

WIDTH, PERCENT = 5, 75
RARE, HEAVY_IN_BATCH, HEAVY_LEAST = 1000, 16, 64
HUBS, ROUNDS = 3, 2
TRIES, MORE = 8, 4
SKETCH = 8  # words of 64 bits
_SKETCHED = ("unshared", *(f"s{k}" for k in range(SKETCH)))
BLOCK, KEYS_AT_ONCE = 64, 1 << 16
BUCKET_SHINGLES = 8_000_000
MARGIN = 16
MARK_BITS, MOST_BITS = 16, 1 << 28
_LOW, _HALF, _BYTE = np.uint64((1 << 48) - 1), np.uint64((1 << 32) - 1), np.uint64(255)
_HEAVY_CLASS = 200
#: Packed rows of the two exchanges.
PACKED = "bucket long, kind int, sets binary, keys binary, sizes binary"


# --- sets ----------------------------------------------------------------------------------------


def shingle_sets(column: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
    """Each text's set as ascending distinct hashes, and the set's name (0 for the empty set)."""
    hashes, counts = hashed_words(column)
    starts = np.concatenate(([0], np.cumsum(counts)))
    windows = combine(*(hashes[k : len(hashes) - WIDTH + 1 + k] for k in range(WIDTH))) if len(hashes) >= WIDTH else hashes[:0]
    sets, names = [], np.zeros(len(counts), np.int64)
    for i, n in enumerate(counts):
        a = starts[i]
        if n >= WIDTH:
            one = np.unique(windows[a : a + n - WIDTH + 1])
        elif n:
            one = combine(*(hashes[a + k : a + k + 1] for k in range(n)), np.array([n], np.uint64))
        else:
            one = hashes[:0]
        sets.append(one)
        if n:
            names[i] = np.uint64(xxhash.xxh3_64_intdigest(one.tobytes())).astype(np.int64) or 1
    return sets, names


def _named(key: str):
    """Rows of documents with their sets' names and sizes, and rows of shingles frequent in a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done, often = {0}, []
            for part in slices(batch, "text"):
                sets, names = shingle_sets(part.column("text"))
                n = len(sets)
                yield pa.RecordBatch.from_arrays([part.column(key), pa.array(names), pa.array(np.fromiter(map(len, sets), np.int64, n)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], [key, "node", "n", "shingle", "docs"])
                new = [x for x, name in zip(sets, names.tolist()) if not (name in done or done.add(name))]
                if new:
                    shingles, docs = np.unique(np.concatenate(new), return_counts=True)
                    often.append((shingles[docs > 1], docs[docs > 1]))
            if often:
                shingles, at = np.unique(np.concatenate([x[0] for x in often]), return_inverse=True)
                docs = np.bincount(at, weights=np.concatenate([x[1] for x in often]), minlength=len(shingles)).astype(np.int64)
                heavy = docs >= max(HEAVY_IN_BATCH, batch.num_rows // RARE)
                if k := int(np.count_nonzero(heavy)):
                    yield pa.RecordBatch.from_arrays([pa.nulls(k, batch.schema.field(key).type), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.array(shingles[heavy].view(np.int64)), pa.array(docs[heavy])], [key, "node", "n", "shingle", "docs"])
            settle()

    return run


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(48)) % np.uint64(buckets)).astype(np.int64)


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], ["bucket", "kind", "sets", "keys", "sizes"])


def _by_bucket(kind: int, bucket: np.ndarray, buckets: int, *arrays: np.ndarray) -> list[tuple]:
    """Rows of ``arrays`` cut by bucket."""
    order = np.argsort(bucket.astype(np.int32), kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    arrays = [a[order] for a in arrays]
    return [(b, kind, *(a[cuts[b] : cuts[b + 1]].tobytes() for a in arrays), *[b""] * (3 - len(arrays))) for b in np.flatnonzero(np.diff(cuts)).tolist()]


def _digests(column: pa.Array) -> np.ndarray:
    """A hash of each whole text."""
    return np.fromiter((xxhash.xxh3_64_intdigest(t.as_buffer()) for t in texts(column)), np.uint64, len(column))


def _least(n: np.ndarray | int):
    """The least intersection with any linked set, of a set of ``n``."""
    return -(-PERCENT * n // 100)


def _prefix(n: np.ndarray | int):
    """The length of the prefix, in the order of hashes, of a set of ``n``, and how many of its shingles a linked set's prefix has too."""
    # the least linked set is one of _least(n), whose prefix gives as many
    return np.minimum(n, n - _least(n) + np.maximum(1, n // MARGIN)), np.maximum(1, _least(n) // MARGIN)


def _found(heavy: np.ndarray, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each shingle's place among the heavy ones, and whether it is one."""
    at = np.minimum(np.searchsorted(heavy, shingles), max(0, len(heavy) - 1))
    return at, heavy[at] == shingles if len(heavy) else np.zeros(len(shingles), bool)


def _prefixes(heavy: np.ndarray, buckets: int):
    """Packs the prefixes of a batch's distinct sets by bucket (kind 0), and the sets with the number to be shared and a text's digest (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done: set[int] = {0}
            for part in slices(batch, "text"):
                sets, names = shingle_sets(part.column("text"))
                new = [i for i, name in enumerate(names.tolist()) if not (name in done or done.add(name))]
                if not new:
                    continue
                size = np.array([len(sets[i]) for i in new])
                shingles, place = np.concatenate([sets[i] for i in new]), np.repeat(np.arange(len(new)), size)
                _, often = _found(heavy, shingles)
                light, place = shingles[~often], place[~often]
                have = np.bincount(place, minlength=len(new))
                length, need = _prefix(size)
                first = np.arange(len(light)) - (np.cumsum(have) - have)[place] < length[place]
                light, owner = light[first], names[new][place[first]]
                # chance meetings do no harm, so 32 bits will do; the bucket is by others, and not by those that the order goes by
                rows = _by_bucket(0, _bucket(light << np.uint64(16), buckets), buckets, owner, (light & _HALF).astype("<u4"))
                need = need - np.maximum(0, length - have)  # heavy ones may be shared
                rows += _by_bucket(1, names[new].view(np.uint64) % np.uint64(buckets), buckets, names[new], need.astype(np.int64), _digests(part.column("text"))[new])
                yield _packed(rows)
            settle()

    return run


def _dealing(heavy: np.ndarray, weight: np.ndarray, marks: np.ndarray, buckets: int):
    """Packs the shingles of the distinct sets of a batch's marked texts by bucket (kind 0), and the sets with their heavy shingles (kinds 1 and 2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done: set[int] = {0}
            for part in slices(batch.filter(pa.array(_has_mark(marks, _digests(batch.column("text"))))), "text"):
                sets, names = shingle_sets(part.column("text"))
                new = [i for i, name in enumerate(names.tolist()) if not (name in done or done.add(name))]
                if not new:
                    continue
                size = np.array([len(sets[i]) for i in new])
                shingles, owner = np.concatenate([sets[i] for i in new]), np.repeat(names[new], size)
                at, often = _found(heavy, shingles)
                light = shingles[~often]
                low = (light & _LOW).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
                rows = _by_bucket(0, _bucket(light, buckets), buckets, owner[~often], low)
                rows += _by_bucket(1, names[new].view(np.uint64).astype(np.uint64) % np.uint64(buckets), buckets, names[new], size.astype(np.int64))
                if often.any():
                    keys = _keys(weight[at[often]], _bucket(shingles[often], buckets).astype(np.uint64), shingles[often] & _LOW)
                    rows += _by_bucket(2, owner[often].view(np.uint64) % np.uint64(buckets), buckets, owner[often], keys)
                yield _packed(rows)
            settle()

    return run


def _keys(classes: np.ndarray, bucket: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Numbers that name shingles and sort them from rare to frequent."""
    return classes.astype(np.uint64) << np.uint64(56) | (bucket & _BYTE) << np.uint64(48) | low


def _joined(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in column), kind)


def _with_number(bucket: int, buckets: int, owner: np.ndarray, low: np.ndarray, docs: np.ndarray) -> list[tuple]:
    """Sets with the number of their shared shingles."""
    owner, number = np.unique(owner, return_counts=True)
    return _by_bucket(2, owner.view(np.uint64) % np.uint64(buckets), buckets, owner, number.astype(np.int64))


def _with_class(bucket: int, buckets: int, owner: np.ndarray, low: np.ndarray, docs: np.ndarray) -> list[tuple]:
    """Sets with their shared shingles, named with their class."""
    classes = np.minimum(_HEAVY_CLASS - 1, 4 * np.log2(docs)).astype(np.uint64)
    return _by_bucket(2, owner.view(np.uint64) % np.uint64(buckets), buckets, owner, _keys(classes, np.full(len(classes), bucket, np.uint64), low))


def _counting(buckets: int, width: int, told):
    """Counts the sets of each shingle (of ``width`` bytes); shared ones go on as ``told``, by set (kind 2); sets pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_bucket: dict[int, tuple[list, list]] = {}
        for batch in batches:
            buckets_of, kinds = batch.column("bucket").to_pylist(), batch.column("kind").to_pylist()
            passed = [i for i, kind in enumerate(kinds) if kind]
            if passed:
                yield batch.take(pa.array(passed))
            for i, kind in enumerate(kinds):
                if kind == 0:  # views of the batch, not copies
                    sets, keys = by_bucket.setdefault(buckets_of[i], ([], []))
                    sets.append(np.frombuffer(batch.column("sets")[i].as_buffer(), np.int64))
                    keys.append(np.frombuffer(batch.column("keys")[i].as_buffer(), np.uint8))
        while by_bucket:
            bucket, (sets, keys) = by_bucket.popitem()
            owner, low = np.concatenate(sets), np.zeros((sum(map(len, keys)) // width, 8), np.uint8)
            low[:, :width] = np.concatenate(keys).reshape(-1, width)
            low = low.view("<u8").ravel()
            del sets, keys
            order = np.argsort(low, kind="stable")
            low, owner = low[order], owner[order]
            edge = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1], [True])))
            several = np.repeat(np.diff(edge) > 1, np.diff(edge))  # most shingles are of one row
            low, owner = low[several], owner[several]
            order = np.lexsort((owner, low))
            low, owner = low[order], owner[order]
            fresh = np.concatenate(([True], (low[1:] != low[:-1]) | (owner[1:] != owner[:-1]))) if len(low) else np.empty(0, bool)
            low, owner = low[fresh], owner[fresh]
            edge = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1], [True]))) if len(low) else np.zeros(1, np.int64)
            docs = np.repeat(np.diff(edge), np.diff(edge))
            shared = docs > 1
            rows = told(bucket, buckets, owner[shared], low[shared], docs[shared])
            if rows:
                yield _packed(rows)
            del owner, low, order, edge, docs, rows
        settle()

    return run


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digests of texts whose sets share enough of their prefixes, one of each set."""
    rows = [r for b in batches for r in b.select(["kind", "sets", "keys", "sizes"]).to_pylist()]
    names, need, digests = (np.frombuffer(b"".join(r[c] for r in rows if r["kind"] == 1), np.int64) for c in ("sets", "keys", "sizes"))
    owner, number = (np.frombuffer(b"".join(r[c] for r in rows if r["kind"] == 2), np.int64) for c in ("sets", "keys"))
    del rows
    names, at = np.unique(names, return_index=True)
    shared = np.bincount(np.searchsorted(names, owner), weights=number, minlength=len(names))
    yield pa.RecordBatch.from_arrays([pa.array(digests[at][shared >= need[at]])], ["digest"])
    settle()


def _marked(digests: DataFrame) -> np.ndarray:
    """A bitmap with a bit set for each digest: ``MARK_BITS`` or more a digest, but ``MOST_BITS`` at most."""
    bits, wanted = 1 << 15, min(MARK_BITS * digests.count(), MOST_BITS)
    while bits < wanted:
        bits *= 2
    place = F.col("digest").bitwiseAND(F.lit(bits - 1)) + 1
    parts = digests.groupBy(F.bitmap_bucket_number(place).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    marks = np.zeros((bits >> 15, 1 << 12), np.uint8)
    for r in parts.collect():
        marks[r["part"] - 1] = np.frombuffer(r["bits"], np.uint8)
    return marks.ravel()


def _has_mark(marks: np.ndarray, digests: np.ndarray) -> np.ndarray:
    place = digests & np.uint64(8 * len(marks) - 1)
    return marks[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1 == 1


def _choosing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sets that share enough, with their shared shingles in order, the number of unshared ones, and their group."""
    rows = [r for b in batches for r in b.select(["kind", "sets", "keys"]).to_pylist()]
    names = np.frombuffer(b"".join(r["sets"] for r in rows if r["kind"] == 1), np.int64)
    sizes = np.frombuffer(b"".join(r["keys"] for r in rows if r["kind"] == 1), np.int64)
    owner = np.frombuffer(b"".join(r["sets"] for r in rows if r["kind"] == 2), np.int64)
    keys = np.frombuffer(b"".join(r["keys"] for r in rows if r["kind"] == 2), np.uint64)
    del rows
    names, at = np.unique(names, return_index=True)
    sizes = sizes[at]
    place = np.searchsorted(names, owner)
    most = np.bincount(place, minlength=len(names))  # with repeats from several batches
    enough = most >= _least(sizes)
    keep = enough[place]
    place, keys = place[keep], keys[keep]
    order = np.lexsort((keys, place))
    place, keys = place[order], keys[order]
    cuts = np.searchsorted(place, np.arange(len(names) + 1))
    out = []
    for i in np.flatnonzero(enough).tolist():
        own, n = np.unique(keys[cuts[i] : cuts[i + 1]]), int(sizes[i])
        if len(own) >= (least := _least(n)):
            prefix = own[: len(own) - least + 1].tobytes()
            parity = np.bincount((mix(own) % np.uint64(64 * SKETCH)).astype(np.int64), minlength=64 * SKETCH) & 1
            sketch = np.packbits(parity.astype(np.uint8)).view(np.int64).tolist()
            group = np.uint64(xxhash.xxh3_64_intdigest(prefix, n)).astype(np.int64).item()
            out.append((int(names[i]), n, n - len(own), len(own) - least + 1, group, own.tobytes(), *sketch))
        if len(out) == 1000:
            yield _eligible(out)
            out = []
    if out:
        yield _eligible(out)
    del names, sizes, owner, keys, place, order, out
    settle()


def _eligible(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (*[pa.int64()] * 5, pa.binary(), *[pa.int64()] * SKETCH))], ["node", "n", "unshared", "length", "grp", "keys", *(f"s{k}" for k in range(SKETCH))])


ELIGIBLE = "node long, n long, unshared long, length long, grp long, keys binary" + "".join(f", s{k} long" for k in range(SKETCH))


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The prefix shingles of groups, with their places in the whole order."""
    for batch in batches:
        lengths = batch.column("length").to_numpy()
        keys = [np.frombuffer(k.as_py(), np.uint64)[:m] for k, m in zip(batch.column("keys"), lengths)]
        place = [np.arange(m) + u for m, u in zip(lengths, batch.column("unshared").to_numpy())]
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.repeat(batch.column("grp").to_numpy(), lengths)), pa.array(np.repeat(batch.column("n").to_numpy(), lengths)), pa.array(np.concatenate(place))], ["shingle", "grp", "n", "place"])


def _verifying(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose sets are similar."""
    for batch in batches:
        last, a = None, np.empty(0, np.uint64)
        good = np.zeros(batch.num_rows, bool)
        columns = [batch.column(c) for c in ("keys_a", "keys_b")]
        na, nb = batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()
        node = batch.column("a").to_numpy()
        for i in range(batch.num_rows):
            if node[i] != last:
                last, a = node[i], np.frombuffer(columns[0][i].as_py(), np.uint64)
            b = np.frombuffer(columns[1][i].as_py(), np.uint64)
            both = np.concatenate((a, b))
            both.sort()
            common = int(np.count_nonzero(both[1:] == both[:-1]))
            good[i] = 100 * common >= PERCENT * (na[i] + nb[i] - common)
        yield batch.select(["a", "b"]).filter(pa.array(good))


# --- the join ------------------------------------------------------------------------------------


def link_sets(docs: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame, list[str]]:
    """Documents (``key``, node, n) and links between nodes (a < b) whose components are those of all links, with the folders that hold them. Node 0 is the empty set."""
    documents, links, paths, _, at_eligible = _linked(docs, key)
    drop(docs.sparkSession, at_eligible)
    return documents, links, paths


def _linked(docs: DataFrame, key: str) -> tuple[DataFrame, DataFrame, list[str], DataFrame, str]:
    """As ``link_sets``, and the sets that may link, with their folder."""
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    texts = docs.select(key, "text")
    named, at_named = kept(texts.mapInArrow(_named(key), f"`{key}` {kind}, node long, n long, shingle long, docs long"), "join-named")
    documents = named.where("node is not null").select(key, "node", "n")
    often = named.where("shingle is not null").groupBy("shingle").agg(F.sum("docs").alias("docs"))
    size = documents.agg(F.count("*").alias("docs"), F.sum("n").alias("shingles")).first()
    least = max(HEAVY_LEAST, size["docs"] // RARE)
    # a task holds a bucket
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(size["shingles"] or 0) // BUCKET_SHINGLES))
    rows = sorted((r["shingle"] & (1 << 64) - 1, r["docs"]) for r in often.where(F.col("docs") >= least).collect())  # bounded: see the module's text
    heavy = np.array([r[0] for r in rows], np.uint64)
    weight = _HEAVY_CLASS + np.minimum(255 - _HEAVY_CLASS, np.log2([r[1] for r in rows] or [1.0])).astype(np.int64)

    by_bucket = lambda rows: rows.repartitionById(buckets, F.col("bucket").cast("int"))
    dealt = by_bucket(docs.select("text").mapInArrow(_prefixes(heavy, buckets), PACKED))
    shared = by_bucket(dealt.mapInArrow(_counting(buckets, 4, _with_number), PACKED))
    candidates, at_candidates = kept(shared.mapInArrow(_candidates, "digest long"), "join-candidates")
    marks = _marked(candidates)
    drop(spark, at_candidates)
    dealt = by_bucket(docs.select("text").mapInArrow(_dealing(heavy, weight, marks, buckets), PACKED))
    shared = by_bucket(dealt.mapInArrow(_counting(buckets, 6, _with_class), PACKED))
    eligible, at_eligible = kept(shared.mapInArrow(_choosing, ELIGIBLE), "join-sets")

    groups, at_groups = kept(eligible.groupBy("grp").agg(F.min("node").alias("node")), "join-groups")
    heads = eligible.join(groups.select("node"), "node", "left_semi")
    postings, at_postings = kept(heads.mapInArrow(_postings, "shingle long, grp long, n long, place long"), "join-postings")

    # stars: each set against a few hubs of other classes, again while that joins many
    parts, at_parts = kept(eligible.select("node", "grp", F.col("node").alias("label")), "join-parts")
    heads_of = eligible.select("node", "grp").join(groups.withColumnRenamed("node", "other"), "grp").where("node <> other")
    links, folders = spark.createDataFrame([], "a long, b long"), []
    at_rest = at_postings
    for turn in range(ROUNDS + MORE):
        rest, at_new = _between(postings, parts)
        drop(spark, at_rest)
        # classes only grow, so a shingle that one class has is done for good
        postings, at_rest = rest.where("first").drop("label", "first"), at_new
        if turn and rest.isEmpty():
            break
        # by class first, so that a large class doesn't hide the others; later the largest one, so that others don't hide it
        drawn = lambda k, *what: F.xxhash64(F.lit(turn * HUBS + k), *what)  # noqa: B023, E731
        hub = lambda k, h: F.min(F.struct(h.alias("h"), drawn(k, "grp", "label").alias("g"), "grp", "label")).alias(f"hub{k}")  # noqa: B023, E731
        if turn < ROUNDS:
            found = rest.groupBy("shingle").agg(*(hub(k, drawn(k, "label")) for k in range(HUBS)))
        else:
            sizes = parts.groupBy("label").agg(F.count("*").alias("size"))
            found = rest.join(sizes, "label").groupBy("shingle").agg(hub(0, -F.col("size")))
        hubs, at_hubs = kept(found, "join-hubs")
        # the hubs that come up for most of its shingles: those of frequent shingles are seldom similar
        votes = rest.select("shingle", "grp", "label").join(hubs, "shingle").select("grp", "label", F.explode(F.array_compact(F.array(*hubs.columns[1:]))).alias("hub"))
        votes = votes.where("hub.label <> label").groupBy("grp", "label", "hub").agg(F.count("*").alias("votes"))
        best = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("votes")).alias("votes"), "hub"))), 1, HUBS)  # of HUBS a shingle
        near = votes.groupBy("grp", "label").agg(best.alias("hubs")).select("grp", "label", F.explode("hubs.hub").alias("hub"))
        near = near.select("grp", "label", F.col("hub.grp").alias("hub_grp"), F.col("hub.label").alias("hub_label"))
        if turn < ROUNDS:
            chosen = parts.groupBy(F.col("grp").alias("hub_grp"), F.col("label").alias("hub_label")).agg(F.min("node").alias("other"))
            stars = parts.join(near, ["grp", "label"]).join(chosen, ["hub_grp", "hub_label"]).select("node", "other")
        else:  # a set may be similar to some of a large class only, so several of it are tried, others each time
            one = lambda k: F.min(F.struct(F.xxhash64(F.lit(turn * TRIES + k), "node").alias("h"), "node"))  # noqa: B023, E731
            chosen = parts.groupBy(F.col("label").alias("hub_label")).agg(F.count("*").alias("size"), F.array(*map(one, range(TRIES))).alias("tried"))
            chosen = chosen.where(F.col("size") >= TRIES).select("hub_label", F.explode(F.array_distinct("tried.node")).alias("other"))
            stars = parts.join(near.select("grp", "label", "hub_label").distinct(), ["grp", "label"]).join(chosen, "hub_label").select("node", "other")
        stars = stars if turn else stars.unionAll(heads_of.select("node", "other"))
        found, at_found = _verified(stars.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct(), eligible)
        links, folders = links.unionAll(found), [*folders, at_found]
        labels, at_labels = components(links)
        before = rest.select("label").distinct().count()
        old, at_old = parts, at_parts
        parts, at_parts = kept(eligible.select("node", "grp").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "join-parts")
        joined = old.select("label").distinct().count() - parts.select("label").distinct().count()
        drop(spark, at_hubs, at_old, *at_labels)
        if joined <= before // 100 and turn != ROUNDS - 1:
            break

    # then all pairs that are not yet in one class; a part of one set is sketched before its shingles meet others
    sketch = _SKETCHED
    sketched, at_sketched = kept(parts.join(eligible.select("node", "n", *sketch), "node"), "join-sketched")
    alone = sketched.groupBy("grp", "label").agg(F.first("n").alias("n"), F.count("*").alias("members"), *(F.first(c).alias(c) for c in sketch))
    alone, at_alone = kept(alone.select("grp", "label", "n", *(F.when(F.col("members") == 1, F.col(c)).alias(c) for c in sketch)), "join-alone")
    rest, at_new = _between(postings, parts)
    drop(spark, at_rest)
    rest = rest.join(alone.drop("n"), ["grp", "label"])
    x, y = (rest.select(*(F.col(c).alias(c if c == "shingle" else f"{c}_{s}") for c in rest.columns)) for s in "ab")
    both = F.col("n_a") + F.col("n_b")
    near = _near(both)
    fits = (F.col("label_a") < F.col("label_b")) & (100 * F.least("n_a", "n_b") >= PERCENT * F.greatest("n_a", "n_b"))
    room = F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b"))
    fits &= (100 + PERCENT) * room >= PERCENT * both
    pairs = x.join(y, "shingle").where(fits & near).select("grp_a", "label_a", "grp_b", "label_b").distinct()
    inside = parts.groupBy("grp").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("grp")
    same = alone.join(inside, "grp", "left_semi")
    x, y = (same.select("grp", *(F.col(c).alias(f"{c}_{s}") for c in ("label", "n", *sketch))) for s in "ab")
    same = x.join(y, "grp").where((F.col("label_a") < F.col("label_b")) & near)
    pairs = pairs.unionAll(same.select(F.col("grp").alias("grp_a"), "label_a", F.col("grp").alias("grp_b"), "label_b")).distinct()
    x, y = (sketched.select(*(F.col(c).alias(f"{c}_{s}") for c in sketched.columns if c != "node"), F.col("node").alias(s)) for s in "ab")
    pairs = pairs.join(x, ["grp_a", "label_a"]).join(y, ["grp_b", "label_b"]).where(near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    found, at_found = _verified(pairs, eligible)
    drop(spark, at_groups, at_parts, at_new, at_sketched, at_alone)
    return documents, links.unionAll(found), [at_named, *folders, at_found], eligible, at_eligible


def _between(postings: DataFrame, parts: DataFrame) -> tuple[DataFrame, str]:
    """Prefix shingles of the parts (grp, label) of groups, but only shingles that several labels have, with the ``first`` part
    of each group marked; and their folder."""
    low = parts.groupBy("grp").agg(F.min("label").alias("low"))
    named = parts.select("grp", "label").distinct().join(low, "grp").select("grp", "label", (F.col("label") == F.col("low")).alias("first"))
    by_part = postings.join(named, "grp")
    several, at = kept(by_part.groupBy("shingle").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("shingle"), "join-several")
    rest, at_rest = kept(by_part.join(several, "shingle", "left_semi"), "join-rest")
    drop(postings.sparkSession, at)
    return rest, at_rest


def _apart() -> Column:
    """At least so many shingles are in one of two sets (a and b) only: those that are unshared, and the places in which their sketches differ."""
    return F.col("unshared_a") + F.col("unshared_b") + sum((F.bit_count(F.col(f"s{k}_a").bitwiseXOR(F.col(f"s{k}_b"))) for k in range(SKETCH)), F.lit(0))


def _near(both: Column) -> Column:
    """Whether two sets may be similar, of ``both`` sizes together; also where a sketch is missing."""
    return F.coalesce((100 + PERCENT) * (both - _apart()) >= 2 * PERCENT * both, F.lit(True))


def _verified(pairs: DataFrame, eligible: DataFrame) -> tuple[DataFrame, str]:
    """The pairs (a, b) of nodes whose sets are similar, as a table, and its folder. Only sets of pairs that their sketches leave travel."""
    x, y = (eligible.select(F.col("node").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in ("n", *_SKETCHED))) for s in "ab")
    left = pairs.join(y, "b").join(x, "a").where(_near(F.col("n_a") + F.col("n_b"))).select("a", "b", "n_a", "n_b")
    left, at_left = kept(left, "join-near")
    x, y = (eligible.select(F.col("node").alias(s), F.col("keys").alias(f"keys_{s}")).join(left.select(s).distinct(), s, "left_semi") for s in "ab")
    both = left.join(y, "b").join(x, "a").select("a", "b", "n_a", "n_b", "keys_a", "keys_b")
    found = kept(both.mapInArrow(_verifying, "a long, b long"), "join-links")
    drop(pairs.sparkSession, at_left)
    return found


def components(edges: DataFrame) -> tuple[DataFrame, list[str]]:
    """(node, label) of every node with a link, where label is the least node that it reaches; and the table's folder."""
    spark = edges.sparkSession
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels, at = kept(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"), "join-labels")
    while True:
        # over each link, then from a label to that label's own label
        told = both.join(labels, both.a == labels.node).select(F.col("b").alias("node"), "label")
        near, at_near = kept(told.unionAll(labels).groupBy("node").agg(F.min("label").alias("label")), "join-labels")
        far = near.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new, at_new = kept(near.join(far, "label").select("node", F.least("label", "next").alias("label")), "join-labels")
        old = labels.select("node", F.col("label").alias("old"))
        moved = new.join(old, "node").where("label <> old").limit(1).count()
        drop(spark, at, at_near)
        labels, at = new, at_new
        if not moved:
            return labels, [at]


def classify(docs: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame, list[str]]:
    """Documents (``key``, node, n), and for each node but 0: component_id, least (key) and keeper (one node of each class); and folders."""
    documents, links, paths = link_sets(docs, key)
    nodes, at_nodes = kept(documents.where("node <> 0").groupBy("node").agg(F.min(key).alias("least")), "join-nodes")
    labels, at_labels = components(links)
    labelled, at_labelled = kept(nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "join-labelled")
    # null identifiers come last
    first = F.min(F.struct(F.col("least").isNull().alias("none"), "least", "node"))
    classes, at_classes = kept(labelled.groupBy("label").agg(first.alias("first")), "join-firsts")
    by_node, at_by_node = kept(
        labelled.join(classes, "label").select("node", "least", F.col("first.least").alias("component_id"), (F.col("first.node") == F.col("node")).alias("keeper")),
        "join-classes",
    )
    return documents, by_node, [*paths, at_nodes, *at_labels, at_labelled, at_classes, at_by_node]


def similar_documents(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """For every row: ``key``, n_shingles and component_id (the class's least key)."""
    documents, by_node, paths = classify(docs, key)
    empty = documents.where("node = 0").select(key, F.col("n").alias("n_shingles"), F.col(key).alias("component_id"))
    full = documents.where("node <> 0").join(by_node, "node").select(key, F.col("n").alias("n_shingles"), "component_id")
    result, _ = kept(full.unionAll(empty), "join-result")
    drop(docs.sparkSession, *paths)
    return result


def _linking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each pair of blocks: the documents that each set's links reach in the other block."""
    for batch in batches:
        for r in range(batch.num_rows):
            row = {c: batch.column(c)[r] for c in batch.schema.names}
            (node_a, n_a, docs_a, keys_a), (node_b, n_b, docs_b, keys_b) = (
                (*(row[f"{c}_{s}"].values.to_numpy() for c in ("nodes", "ns", "docs")), [np.frombuffer(k.as_py(), np.uint64) for k in row[f"keys_{s}"].values]) for s in "ab"
            )
            every_a, every_b = np.concatenate(keys_a), np.concatenate(keys_b)
            both = np.intersect1d(every_a, every_b)
            common = np.zeros((len(n_a), len(n_b)))
            for at in range(0, len(both), KEYS_AT_ONCE):
                some = both[at : at + KEYS_AT_ONCE]
                common += _members(every_a, keys_a, some) @ _members(every_b, keys_b, some).T
            good = 100 * common >= PERCENT * (n_a[:, None] + n_b[None, :] - common)
            if row["block_a"].as_py() == row["block_b"].as_py():
                nodes, links = node_a, (good & ~np.eye(len(n_a), dtype=bool)) @ docs_a
            else:
                nodes, links = np.concatenate((node_a, node_b)), np.concatenate((good @ docs_b, docs_a @ good))
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(links.astype(np.int64))], ["node", "links"])


def _members(every: np.ndarray, keys: list[np.ndarray], some: np.ndarray) -> np.ndarray:
    """Which of ``some`` (ascending) each set has, as a matrix."""
    owner = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
    at = np.minimum(np.searchsorted(some, every), len(some) - 1)
    out = np.zeros((len(keys), len(some)), np.float32)
    hit = some[at] == every
    out[owner[hit], at[hit]] = 1
    return out


def link_counts(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """For every row: ``key`` and n_links, the number of other rows whose sets link with its own.

    Links lie within classes, so each class's sets are cut into blocks of about
    ``BLOCK`` and all pairs of blocks are counted as matrices, summed by set:
    every pair of a class is verified, but none is a row.
    """
    documents, links, paths, eligible, at_eligible = _linked(docs, key)
    labels, at_labels = components(links)
    copies = documents.where("node <> 0").groupBy("node").agg(F.count("*").alias("docs"))
    copies, at_copies = kept(copies, "join-copies")
    sets = eligible.select("node", "n", "keys").join(labels, "node").join(copies, "node")
    sizes = labels.groupBy("label").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    sets = sets.join(sizes, "label").withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
    packed = sets.groupBy("label", "block").agg(F.collect_list(F.struct("node", "n", "docs", "keys")).alias("x"))
    packed, at_packed = kept(packed.select("label", "block", *(F.col(f"x.{c}").alias(d) for c, d in (("node", "nodes"), ("n", "ns"), ("docs", "docs"), ("keys", "keys")))), "join-packed")
    x, y = (packed.select("label", *(F.col(c).alias(f"{c}_{s}") for c in packed.columns if c != "label")) for s in "ab")
    found = x.join(y, "label").where("block_a <= block_b").drop("label").mapInArrow(_linking, "node long, links long")
    counts = copies.join(found.groupBy("node").agg(F.sum("links").alias("links")), "node", "left").select("node", (F.coalesce("links", F.lit(0)) + F.col("docs") - 1).alias("n_links"))
    result, _ = kept(documents.join(counts, "node", "left").select(key, F.coalesce("n_links", F.lit(0)).alias("n_links")), "join-counts")
    drop(docs.sparkSession, *paths, at_eligible, *at_labels, at_copies, at_packed)
    return result


def _with_node(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(shingle_sets(part.column("text"))[1])], [*part.schema.names, "__sq_node"])
        settle()


def one_of_each(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of ``docs``, with their own columns, but of each class only one: that of the least ``key``. Rows with empty sets all stay."""
    # what a class keeps is a narrow table; all others go
    with Scope(docs.sparkSession) as scope:
        documents, by_node, _ = classify(docs, key)
        doubled = documents.where("node <> 0").groupBy(key, "node").count().where("count > 1").select(F.col("node").alias("__sq_node")).distinct()
        doubled = scope.keep(kept(doubled, "join-doubled"))
        keepers = by_node.where("keeper").select(F.col("node").alias("__sq_node"), F.col("least").alias("__sq_least"))
        keepers = scope.keep(kept(keepers, "join-keepers"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    rows = docs.mapInArrow(_with_node, f"{schema}, __sq_node long")
    rest = rows.join(keepers, (rows["__sq_node"] == keepers["__sq_node"]) & rows[key].eqNullSafe(keepers["__sq_least"]), "left_semi")
    if not doubled.isEmpty():  # rows that repeat identifier and set
        rest = rest.join(doubled, "__sq_node", "left_anti").unionByName(rest.join(doubled, "__sq_node", "left_semi").dropDuplicates([key, "__sq_node"]))
    return rest.unionByName(rows.where("__sq_node = 0")).select(*docs.columns)


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The set's size and the near-duplicate class of every document."""
    return similar_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


QUERIES = {"op8_jaccard_join": op8_jaccard_join}
ORACLE_SQL = {
    "op8_jaccard_join": f"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t-\\r]+'), lambda x: x <> '') AS w FROM documents
), g AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= {WIDTH} THEN list_transform(range(1, len(w) - {WIDTH} + 2), lambda i: array_to_string(w[i:i + {WIDTH} - 1], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id
), l AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= {PERCENT} * (na.n + nb.n - count(*))
), r AS (
  SELECT doc_id AS id, doc_id AS other FROM documents UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.other
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.c AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT id AS doc_id, min(other) AS c FROM r GROUP BY id) c USING (doc_id)"""
}
