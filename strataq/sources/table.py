"""A table on storage: segments, manifests, a commit log and checkpoints.

Segments are Parquet folders, range-partitioned and sorted by key, with Bloom
filters on it, so that key bounds and lookups skip row groups.  A manifest
lists the live segments; manifests are numbered and never changed, and a new
one appears by a rename, so a reader keeps the state it began with.

A segment is written in a folder of its own and takes its number only when it
is committed.  If another writer committed meanwhile, the newest manifest is
read again and the commit repeated on top of it: sequence numbers are kept
relative in the files, and the manifest has each segment's offset, so the
later commit stays the later one without a rewrite.

The commit log has a file for each stretch between two flushes, with a line a
change.  A manifest lists the log files that its segments cover; all others are
replayed on top whenever a table is opened, however it was closed.  The end of
a line that a crash cut off is not a change.
"""

from __future__ import annotations

import json
import time
import uuid
from base64 import b64encode
from collections import defaultdict
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataq.functions import keys as K
from strataq.operators.versions import LOG, live, merged
from strataq.plans.query import ALL, KeyQuery
from strataq.sources.files import Appender, Files

RETAIN = 600.0  # seconds that files stay for readers of an older state
TRIES = 20
INDEX = "no int, file string, low string, high string, bits long, words array<bigint>"


@dataclass
class Manifest:
    """Live segments in ascending order as [id, version, offset of seq], the next sequence number, the log files they cover, retired segments as [name, time], and the root of a tree."""

    number: int = 0
    segments: list[list[int]] = field(default_factory=list)
    next_seq: int = 0
    covered: list[str] = field(default_factory=list)
    retired: list[list] = field(default_factory=list)
    root: str = ""


def _places() -> tuple[Column, Column]:
    """A key's two bits in a filter of ``bits``."""
    return F.pmod(F.xxhash64("key"), F.col("bits")), F.pmod(F.hash("key").cast("long"), F.col("bits"))


def routed(rows: DataFrame, lows: list[str], name: str = "leaf") -> DataFrame:
    """Rows with the index of the last of ascending ``lows`` that is not above the row's key (0 if all are), by binary search."""
    if len(lows) < 2:
        return rows.withColumn(name, F.lit(0))
    bounds, steps = F.lit(lows), [1 << i for i in reversed(range(len(lows).bit_length()))]
    at = F.aggregate(F.lit(steps), F.lit(0), lambda at, step: F.when(F.get(bounds, at + step) <= F.col("key"), at + step).otherwise(at))
    return rows.withColumn(name, at)


class SegmentTable:
    """One table's folder."""

    def __init__(self, spark: SparkSession, path: str, options: dict[str, dict[str, object]]) -> None:
        self.spark, self.path, self.files = spark, path.rstrip("/"), Files(spark)
        self.options = options["engine"] | options["table"]
        self.appender: Appender | None = None
        self.manifest = Manifest()
        self.refresh()

    # --- manifests and paths ---

    def refresh(self) -> Manifest:
        """Reads the newest manifest, if it is newer."""
        names = [n for n in self.files.names(f"{self.path}/manifest") if n.endswith(".json")]
        if names and int(names[-1].removesuffix(".json")) > self.manifest.number:
            self.manifest = Manifest(**json.loads(self.files.read(f"{self.path}/manifest/{names[-1]}")))
        return self.manifest

    def _commit(self, change) -> Manifest:
        """Makes ``change(newest manifest)``, a dictionary of what differs, the next manifest; on a conflict once more, on top of what was committed."""
        for _ in range(TRIES):
            newest = self.refresh()
            new = Manifest(**(asdict(newest) | change(newest) | {"number": newest.number + 1}))
            try:
                self.files.write_new(f"{self.path}/manifest/{new.number:012d}.json", json.dumps(asdict(new)))
            except FileExistsError:
                time.sleep(0.01)
                continue
            self.manifest = new
            return new
        raise TimeoutError(f"{self.path}: {TRIES} commits in a row met another writer's")

    def segment_path(self, segment: int, version: int) -> str:
        return f"{self.path}/data/{segment}v{version}"

    def segment_names(self) -> list[str]:
        """The live segments' names, oldest first."""
        return [f"{s}v{v}" for s, v, _ in self.manifest.segments]

    # --- commit log ---

    def append(self, changes: list[tuple[str, bytes]], seq: int) -> None:
        """Appends changes to the commit log; they are there when this returns."""
        if self.appender is None:
            self.appender = Appender(self.files, f"{self.path}/commit_log/{seq:015d}-{uuid.uuid4().hex[:8]}.jsonl")
        lines = (json.dumps({"key": k, "value": b64encode(v).decode(), "seq": seq + i}) for i, (k, v) in enumerate(changes))
        self.appender.write("".join(f"{x}\n" for x in lines).encode())

    def rotate(self) -> list[str]:
        """Ends the current log file; its name, if there is one."""
        if self.appender is None:
            return []
        self.appender.close()
        name, self.appender = self.appender.path.rsplit("/", 1)[1], None
        return [name]

    def log_tail(self) -> tuple[DataFrame | None, list[str]]:
        """The logged changes that no segment holds, and their files' names. Lines that are cut off are not part of it."""
        new = [n for n in self.files.names(f"{self.path}/commit_log") if n.endswith(".jsonl") and n not in self.manifest.covered]
        if not new:
            return None, []
        lines = self.spark.read.schema("key string, value string, seq long").json([f"{self.path}/commit_log/{n}" for n in new]).where("key is not null and value is not null and seq is not null")
        return lines.select("key", F.unbase64("value").alias("value"), (F.length("value") == 0).alias("is_deleted"), "seq"), new

    # --- segments ---

    def write_segment(self, changes: DataFrame, drop_removed: bool = False) -> str:
        """Resolves ``changes`` and writes them sorted by key, removals included unless told otherwise; gives the folder.

        One shuffle by ranges of keys and one sort serve the resolution and the order alike."""
        rows = changes.select(*LOG.names).repartitionByRange("key")
        last = Window.partitionBy("key").orderBy(F.desc("seq"))
        rows = rows.withColumn("__rank", F.row_number().over(last)).where("__rank = 1").drop("__rank")
        rows = live(rows) if drop_removed else rows
        rate = float(self.options.get("LSM_BLOOM_FILTER_FALSE_POSITIVE_RATE", 0.01))
        path = f"{self.path}/data/_new-{uuid.uuid4().hex}"
        writer = rows.sortWithinPartitions("key").write
        writer.option("parquet.bloom.filter.enabled#key", "true").option("parquet.bloom.filter.fpp#key", str(rate)).parquet(path)
        return path

    @contextmanager
    def staged(self, rows: DataFrame) -> Iterator[DataFrame]:
        """``rows``, written to a folder of the table that stays as long as it is in use."""
        path = f"{self.path}/data/_new-{uuid.uuid4().hex}"
        try:
            rows.write.parquet(path)
            yield self.spark.read.schema(rows.schema).parquet(path)
        finally:
            self.files.remove(path)

    def _place(self, written: str, segment: int, version: int) -> int:
        """Gives a written folder its name; the version, raised past folders of lost commits."""
        while not self.files.rename_new(written, self.segment_path(segment, version)):
            version += 1
        return version

    def read(self, segments: list[list[int]], only: Callable[[str], list[str]] = lambda path: [path]) -> DataFrame:
        """Changes of the segments, by one scan for each offset (there is one, unless writers met); of a segment's folder only the paths that are asked for."""
        paths = defaultdict(list)
        for segment, version, offset in segments:
            if found := only(self.segment_path(segment, version)):
                paths[offset] += found
        scans = [self.spark.read.schema(LOG).parquet(*at).withColumn("seq", F.col("seq") + offset) if offset else self.spark.read.schema(LOG).parquet(*at) for offset, at in paths.items()]
        return merged(*scans) if scans else self.spark.createDataFrame([], LOG)

    def state(self, manifest: Manifest, query: KeyQuery = ALL, keys: DataFrame | None = None) -> tuple[DataFrame, bool]:
        """All changes that the manifest has within the query's bounds, or of ``keys``, and others, perhaps; and whether each key is there once."""
        only = {} if keys is None else {"only": lambda path: self.files_of(path, keys)}
        return self.read(manifest.segments, **only), len(manifest.segments) < 2

    # --- indexes of segments ---

    def index(self, path: str) -> DataFrame:
        """A row for each of a segment's files: no, file, low, high and its keys' Bloom filter, in ``words`` of 64 of its ``bits``. It is made when it is first asked for and stays in the segment's folder."""
        at = f"{path}/_index"
        if not self.files.exists(at):
            rows = self.spark.read.schema(LOG).parquet(path).select("key", F.substring_index("_metadata.file_path", "/", -1).alias("file"))
            bits = K.bloom_bits(F.count("*"), float(self.options.get("LSM_BLOOM_FILTER_FALSE_POSITIVE_RATE", 0.01)))
            found = sorted(rows.groupBy("file").agg(F.min("key"), F.max("key"), bits).collect(), key=lambda r: r[1])
            files = F.broadcast(self.spark.createDataFrame([(i, *r) for i, r in enumerate(found)], "no int, file string, low string, high string, bits long"))
            place = rows.join(files, "file").select("no", F.explode(F.array(*_places())).alias("place"))
            bit = place.select("no", F.expr("int(place div 64)").alias("word"), F.expr("shiftleft(1L, int(place % 64))").alias("bit"))
            none = files.select("no", F.explode(F.expr("sequence(0, int(bits div 64) - 1)")).alias("word"), F.lit(0).cast("long").alias("bit"))
            words = bit.unionAll(none).groupBy("no", "word").agg(F.bit_or("bit").alias("bit")).groupBy("no").agg(F.array_sort(F.collect_list(F.struct("word", "bit")))["bit"].alias("words"))
            written = f"{path}/_new-{uuid.uuid4().hex}"
            words.join(files, "no").coalesce(1).write.parquet(written)
            if not self.files.rename_new(written, at):  # another reader made it meanwhile
                self.files.remove(written)
        return self.spark.read.schema(INDEX).parquet(at)

    def files_of(self, path: str, keys: DataFrame) -> list[str]:
        """A segment's files that may hold some of ``keys``: by their bounds, and then their Bloom filters."""
        index = self.index(path)
        found = index.select("no", "file", "low").orderBy("low").collect()
        if not found:
            return []
        placed = routed(keys.select("key"), [r["low"] for r in found], "no").join(index, "no").where("key >= low and key <= high")
        held = [F.expr(f"(shiftright(get(words, int({name} div 64)), int({name} % 64)) & 1) = 1") for name in ("first", "second")]
        first, second = _places()
        hit = placed.withColumns({"first": first, "second": second}).where(held[0] & held[1]).select("no").distinct().collect()
        return [f"{path}/{found[r['no']]['file']}" for r in sorted(hit)]

    def read_segments(self) -> DataFrame:
        """Changes of the live segments with segment_id."""
        segments = self.manifest.segments
        if not segments:
            return self.spark.createDataFrame([], LOG).withColumn("segment_id", F.lit(0))
        rows = self.spark.read.schema(LOG).parquet(*(self.segment_path(s, v) for s, v, _ in segments))
        name = F.regexp_extract(F.col("_metadata.file_path"), r"/data/(\d+)v\d+/[^/]*$", 1).cast("int")
        return rows.select(*LOG.names, name.alias("segment_id"))

    def log(self, pending: DataFrame | None = None) -> DataFrame:
        """All changes: segments and what is not yet in one."""
        rows = self.read(self.manifest.segments)
        return rows if pending is None else merged(rows, pending.select(*LOG.names))

    def flush(self, changes: DataFrame, first_seq: int, n: int, covered: list[str]) -> int:
        """Writes changes with sequence numbers from ``first_seq`` on (at most ``n``) as the newest segment; gives its offset. Merges if the options ask for it."""
        written = self.write_segment(changes)
        placed: list[int] = []

        def change(newest: Manifest) -> dict:
            offset = max(0, newest.next_seq - first_seq)
            segment = max((s for s, *_ in newest.segments), default=0) + 1
            if placed and placed[0] != segment:  # another writer took the number
                self.files.rename_new(self.segment_path(placed[0], placed[1]), written)
                placed.clear()
            if not placed:
                placed.extend((segment, self._place(written, segment, 1)))
            placed[2:] = [offset]
            return {"segments": [*newest.segments, list(placed)], "next_seq": first_seq + offset + n, "covered": [*newest.covered, *covered]}

        self._commit(change)
        if self.options.get("ENABLE_MERGE_IF_MAX_SSTABLES") and len(self.manifest.segments) > int(self.options["LSM_MAX_SSTABLES"]):
            self.merge_oldest(2)
        return placed[2]

    def merge_oldest(self, count: int) -> None:
        """The ``count`` oldest segments as one with the newest of their ids; removals go, as nothing older is left.

        If another writer merged them first, its result stays."""
        old = self.refresh().segments[:count]
        if len(old) < 2:
            return
        written = self.write_segment(self.read(old), drop_removed=True)
        segment, version = old[-1][0], self._place(written, old[-1][0], old[-1][1] + 1)

        def change(newest: Manifest) -> dict:
            if newest.segments[: len(old)] != old:
                raise _Superseded
            gone = [[f"{s}v{v}", time.time()] for s, v, _ in old]
            return {"segments": [[segment, version, 0], *newest.segments[len(old) :]], "retired": [*newest.retired, *gone]}

        try:
            self._commit(change)
        except _Superseded:
            self.files.remove(self.segment_path(segment, version))

    def optimize(self) -> None:
        """All segments as one, if there are several."""
        self.merge_oldest(len(self.refresh().segments))

    # --- checkpoints ---

    def checkpoint(self, retain: float = RETAIN) -> None:
        """Drops the log files that segments cover; and older manifests, merged segments and remains of lost commits, as soon as they are out of use for ``retain`` seconds."""
        now, newest = time.time(), self.refresh()
        covered = set(newest.covered)
        for name in self.files.names(f"{self.path}/commit_log"):
            if name in covered:
                self.files.remove(f"{self.path}/commit_log/{name}")
        names = [n for n in self.files.names(f"{self.path}/manifest") if n.endswith(".json")]
        for name in names[:-1]:
            if now - self.files.modified(f"{self.path}/manifest/{name}") >= retain:
                self.files.remove(f"{self.path}/manifest/{name}")
        retired = dict(map(tuple, newest.retired))
        alive = self.alive(newest)
        for folder in ("data", "nodes"):
            for name in self.files.names(f"{self.path}/{folder}"):
                if name not in alive and now - retired.get(name, self.files.modified(f"{self.path}/{folder}/{name}")) >= retain:
                    self.files.remove(f"{self.path}/{folder}/{name}")
        left = {name for folder in ("data", "nodes") for name in self.files.names(f"{self.path}/{folder}")}
        self._commit(lambda m: {"covered": [n for n in m.covered if n not in covered], "retired": [x for x in m.retired if x[0] in left]})

    def alive(self, manifest: Manifest) -> set[str]:
        """Names of what a manifest's state is in."""
        return {f"{s}v{v}" for s, v, _ in manifest.segments}

    def sizes(self) -> dict[int, int]:
        """Bytes of each live segment."""
        return {s: self.files.size(self.segment_path(s, v)) for s, v, _ in self.manifest.segments}

    def bytes_on_disk(self) -> int:
        return sum(self.sizes().values())


class _Superseded(Exception):
    """Another writer has merged the same segments."""
