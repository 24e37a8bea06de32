"""A table on storage as a B+ tree.

Leaves are Parquet files, each with a range of keys in order and all files
apart; inner nodes are small files with the least key, the name and the records
of each child.  A node has at most ``BPLUS_TREE_ORDER`` children, a leaf at most
``LEAF`` times as many records; all but the root are at least half full.

Neither leaves nor nodes are ever changed.  A write descends from the root to
the leaves that its keys fall into, puts new leaves in their place (split where
they are too full, joined with a sibling where they are too empty) and new nodes
above these; the rest of the tree stays.  The manifest names the root, so a
reader keeps the tree it began with, and a writer that comes second repeats its
write on the newest root.
"""

from __future__ import annotations

import json
import time
import uuid
from bisect import bisect_right
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataq.operators.versions import LOG, live, merged
from strataq.plans.query import ALL, KeyQuery
from strataq.sources.table import Manifest, SegmentTable, routed

LEAF = 256  # records of a leaf for each child of a node: 102,400 in the default order

Child = list  # least key, name, records


def _joined(parts: list[list], half: int, size=len) -> list[list]:
    """Neighbouring parts joined, until each has ``half`` at least."""
    out, at = [], []
    for part in parts:
        at = [*at, *part]
        if size(at) >= half:
            out.append(at)
            at = []
    if at and out:
        out[-1] = [*out[-1], *at]
    elif at:
        out = [at]
    return out


class TreeTable(SegmentTable):
    """One table's folder."""

    def __init__(self, spark: SparkSession, path: str, options: dict[str, dict[str, object]]) -> None:
        super().__init__(spark, path, options)
        self.order = int(self.options["BPLUS_TREE_ORDER"])
        self.room = self.order * LEAF

    # --- nodes ---

    def _node(self, name: str) -> dict:
        return json.loads(self.files.read(f"{self.path}/nodes/{name}"))

    def _put(self, height: int, children: list[Child]) -> Child:
        name = f"{uuid.uuid4().hex}.json"
        self.files.write_new(f"{self.path}/nodes/{name}", json.dumps({"height": height, "children": children}))
        return [children[0][0], name, sum(c[2] for c in children)]

    def leaves(self, root: str, query: KeyQuery = ALL) -> list[Child]:
        """The leaves that may hold keys within the query's bounds, in order, by a descent from the root."""
        if not root:
            return []
        node = self._node(root)
        lows = [c[0] for c in node["children"]]
        first = 0 if query.min_key is None else max(bisect_right(lows, query.min_key) - 1, 0)
        last = len(lows) if query.max_key is None else bisect_right(lows, query.max_key)
        found = node["children"][first:last]
        return found if node["height"] == 0 else [leaf for c in found for leaf in self.leaves(c[1], query)]

    def nodes(self, root: str) -> dict[int, list[tuple[Child, list[Child]]]]:
        """All nodes by height, in order, each with its children."""
        out = defaultdict(list)
        below = [["", root, 0]] if root else []
        while below:
            found = [(c, self._node(c[1])) for c in below]
            height = found[0][1]["height"]
            out[height] = [(c, n["children"]) for c, n in found]
            below = [c for _, n in found for c in n["children"]] if height else []
        return out

    # --- writes ---

    def _leaf_files(self, written: str) -> list[Child]:
        """The files of a written folder as leaves, in order; the folder goes."""
        rows = self.spark.read.schema(LOG).parquet(written)
        at = F.substring_index(F.col("_metadata.file_path"), f"{written.rsplit('/', 1)[1]}/", -1)
        out = []
        for file, low, n in sorted(rows.groupBy(at).agg(F.min("key"), F.count("*")).collect(), key=lambda r: r[1]):
            name = f"{uuid.uuid4().hex}.parquet"
            self.files.rename_new(f"{written}/{file}", f"{self.path}/data/{name}")
            out.append([low, name, n])
        self.files.remove(written)
        return out

    def _write(self, rows: DataFrame, *by: str) -> list[Child]:
        """Leaves of rows that are placed by key, apart for each combination of ``by``, which ascends with the key."""
        path = f"{self.path}/data/_new-{uuid.uuid4().hex}"
        rows.sortWithinPartitions(*by, "key").write.option("maxRecordsPerFile", self.room).partitionBy(*by).parquet(path)
        return self._leaf_files(path)

    def _read(self, leaves: list[Child]) -> DataFrame:
        return self.spark.read.schema(LOG).parquet(*(f"{self.path}/data/{name}" for _, name, _ in leaves)) if leaves else self.spark.createDataFrame([], LOG)

    def _changed(self, old: list[Child], changes: DataFrame) -> list[Child]:
        """The leaves after changes. Those that no key falls into stay."""
        lows = [c[0] for c in old]
        counts = dict(tuple(r) for r in routed(changes, lows).groupBy("leaf").count().collect())
        if not counts:
            return old
        touched = sorted(counts)
        runs, run = [], {}  # neighbours are written together; what lies between keeps the runs apart
        for i in touched:
            if not runs or runs[-1][-1] != i - 1:
                runs.append([])
            runs[-1].append(i)
            run[i] = len(runs) - 1
        taken = [old[i] for i in touched] if old else []
        rows = routed(merged(self._read(taken), changes.select(*LOG.names)), lows)
        number = F.lit(0) if len(runs) == 1 else F.get(F.lit([run.get(i, 0) for i in range(len(old))]), F.col("leaf"))
        total = sum(counts.values()) + sum(c[2] for c in taken)
        rows = rows.withColumn("run", number).drop("leaf").repartitionByRange(max(1, -(-total * 4 // (self.room * 3))), "key")
        last = Window.partitionBy("key").orderBy(F.desc("seq"))
        rows = live(rows.withColumn("__rank", F.row_number().over(last)).where("__rank = 1").drop("__rank"))
        gone = {c[1] for c in taken}
        return self._filled(sorted([*(c for c in old if c[1] not in gone), *self._write(rows, "run")]))

    def _filled(self, leaves: list[Child]) -> list[Child]:
        """The leaves, those less than half full written together with their next one; in two halves if both do not fit in one."""
        groups = _joined([[c] for c in leaves], -(-self.room // 2), lambda at: sum(c[2] for c in at))
        again = [g for g in groups if len(g) > 1]
        if not again:
            return leaves
        totals = [sum(c[2] for c in g) for g in again]
        rows = routed(self._read([c for g in again for c in g]), [g[0][0] for g in again], "part").repartition(min(len(again), 1000), "part")
        rank = F.row_number().over(Window.partitionBy("part").orderBy("key")) - 1
        total, pieces = (F.get(F.lit(x), F.col("part")) for x in (totals, [-(-t // self.room) for t in totals]))
        rows = rows.withColumn("piece", F.floor(rank * pieces / total).cast("int"))
        return sorted([*(g[0] for g in groups if len(g) == 1), *self._write(rows, "part", "piece")])

    def _rooted(self, root: str, leaves: list[Child]) -> str:
        """A root above ``leaves``. Nodes whose children stay are kept."""
        levels, children, height = self.nodes(root), leaves, 0
        while children:
            old = levels.get(height, [])
            known = {tuple(c[1] for c in below): node for node, below in old}
            lows, parts = [below[0][0] for _, below in old], defaultdict(list)
            for c in children:
                parts[max(bisect_right(lows, c[0]) - 1, 0)].append(c)
            nodes = []
            for group in _joined([parts[i] for i in sorted(parts)], -(-self.order // 2)):
                k = -(-len(group) // self.order)
                for i in range(k):
                    piece = group[len(group) * i // k : len(group) * (i + 1) // k]
                    kept = known.get(tuple(c[1] for c in piece))
                    nodes.append([piece[0][0], kept[1], sum(c[2] for c in piece)] if kept else self._put(height, piece))
            if len(nodes) == 1:
                return nodes[0][1]
            children, height = nodes, height + 1
        return ""

    def _names(self, root: str) -> set[str]:
        """Names of all nodes and leaves."""
        levels = self.nodes(root)
        return {c[1] for level in levels.values() for node, below in level for c in (node, *below)}

    def flush(self, changes: DataFrame, first_seq: int, n: int, covered: list[str]) -> int:
        """Writes changes with sequence numbers from ``first_seq`` on (at most ``n``) into the tree; gives the offset that they got. Segments that a table has from before become part of the tree."""
        placed: list[int] = []

        def change(newest: Manifest) -> dict:
            placed[:] = [max(0, newest.next_seq - first_seq)]
            rows = changes.withColumn("seq", F.col("seq") + placed[0])
            rows = merged(self.read(newest.segments), rows.select(*LOG.names)) if newest.segments else rows
            root = self._rooted(newest.root, self._changed(self.leaves(newest.root), rows))
            gone = [[name, time.time()] for name in sorted(self._names(newest.root) - self._names(root)) + [f"{s}v{v}" for s, v, _ in newest.segments]]
            return {"segments": [], "root": root, "next_seq": first_seq + placed[0] + n, "covered": [*newest.covered, *covered], "retired": [*newest.retired, *gone]}

        self._commit(change)
        return placed[0]

    def merge_oldest(self, count: int) -> None:
        """Nothing to do: every write leaves one tree."""

    # --- reads ---

    def alive(self, manifest: Manifest) -> set[str]:
        return super().alive(manifest) | self._names(manifest.root)

    def state(self, manifest: Manifest, query: KeyQuery = ALL, keys: DataFrame | None = None) -> tuple[DataFrame, bool]:
        leaves = self.leaves(manifest.root, query)
        if keys is not None:
            hit = {r["leaf"] for r in routed(keys, [c[0] for c in leaves]).select("leaf").distinct().collect()}
            leaves = [c for i, c in enumerate(leaves) if i in hit]
        rows = self._read(leaves)
        return (merged(self.read(manifest.segments), rows), False) if manifest.segments else (rows, True)

    def read_segments(self) -> DataFrame:
        """The tree is one segment, 0."""
        return merged(super().read_segments(), self._read(self.leaves(self.manifest.root)).withColumn("segment_id", F.lit(0)))

    def sizes(self) -> dict[int, int]:
        found = {0: sum(self.files.size(f"{self.path}/data/{name}") for _, name, _ in self.leaves(self.manifest.root))} if self.manifest.root else {}
        return super().sizes() | found
