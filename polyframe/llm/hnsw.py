"""Embedding near-duplicates through hierarchical navigable small-world graphs, one per shard.

Equal vectors of a label become one class with the smallest id and a count (partial aggregation),
so copies cost one row per task. The classes of a label are dealt to shards of about ``SHARD``
residents; every class queries every shard of its label. The queries of a shard are dealt to chunks
of about ``CHUNK``, each with the shard's residents, so that no task grows with its label: it holds
one shard, builds its graph and streams one chunk of queries through it in batches. Vectors travel
in their own type. In a shard

- beams over the graph find links, which are verified by cosine in double precision and united;
- members of a component are then compared exactly, in blocks, which completes link counts;
- an audit compares a sample of queries with brute force over the shard; if any link is missing,
  beams are doubled and the shard is searched again. A beam as wide as the shard meets only what the
  graph connects; if the audit still misses a link, the shard is compared by brute force, in blocks.

A shard emits at most one edge for each vector and component met. ``graph.components`` unites them.

Defined results: vectors that are null, empty or zero, or hold null or non-finite components, and
vectors without a label or id, link with nothing; their component is their own id. Vectors of
different lengths do not link. Repeated rows each keep their row and count as vectors of their own.
Different vectors that share an id share their component, and each has the links of all of them. An
empty table gives no row; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .common import Scratch
from .graph import components

SIMILARITY = 0.98
#: Residents of a shard, queries of a chunk, queries searched at once, queries of a batch that are audited.
SHARD, CHUNK, BATCH, AUDIT = 8192, 32768, 512, 128
#: Most tasks of the search; beyond it a task works through several chunks, one after the other.
TASKS = 1 << 16
#: Links of a new node, most links of a node, beam while building, first beam of queries.
LINKS, WIDTH, BUILD_BEAM, QUERY_BEAM = 10, 32, 64, 16
#: Nodes expanded by one step of a beam.
EXPAND = 4


class Graph:
    """A navigable small world over unit vectors, built and searched in batches."""

    def __init__(self, vectors: np.ndarray, seed: int = 1):
        self.x = vectors.astype(np.float32)
        n = len(vectors)
        self.level = np.minimum(np.random.default_rng(seed).exponential(1 / np.log(LINKS), n).astype(int), 4) if n else np.zeros(0, int)
        self.top = 0
        self.neighbours = [np.full((n, WIDTH), -1, dtype=np.int32) for _ in range(int(self.level.max(initial=0)) + 1)]
        self.entry = -1
        at = 0
        while at < n:
            size = min(BATCH, max(64, at // 2), n - at)
            self._insert(np.arange(at, at + size), at)
            at += size

    def _insert(self, new: np.ndarray, before: int) -> None:
        entries = np.full((len(new), 1), self.entry)
        for layer in range(len(self.neighbours) - 1, -1, -1):
            joins = self.level[new] >= layer
            if before and layer <= self.top:
                found, _ = self.beam(self.x[new], entries, BUILD_BEAM if joins.any() else 1, layer)
                entries = found[:, :8] if layer else found
            if joins.any():
                own = new[joins]
                old = entries[joins] if before and layer <= self.top else np.full((len(own), 1), -1)
                self._link(own, old, layer)
        highest = int(self.level[new].max())
        if self.entry < 0 or highest > self.top:
            self.top, self.entry = highest, int(new[self.level[new].argmax()])

    def _link(self, own: np.ndarray, found: np.ndarray, layer: int) -> None:
        """Links new nodes with what a beam found and with the nearest of their own batch, both ways."""
        close = self.x[own] @ self.x[own].T
        np.fill_diagonal(close, -2)
        k = min(16, len(own) - 1)
        near = own[np.argpartition(-close, k - 1, axis=1)[:, :k]] if k > 0 else np.full((len(own), 1), -1)
        chosen = self._choose(own, np.concatenate([found[:, :BUILD_BEAM], near], axis=1), LINKS)
        table = self.neighbours[layer]
        table[own, :LINKS] = chosen
        source, target = np.repeat(own, LINKS), chosen.ravel()
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        first = np.searchsorted(target, target, side="left")
        place = np.arange(len(target)) - first
        free = WIDTH - (table[target] >= 0).sum(axis=1)
        fits = place < free
        table[target[fits], (WIDTH - free + place)[fits]] = source[fits]
        # Full nodes keep the most diverse half of their old and new neighbours.
        full = np.unique(target[~fits])
        for part in np.array_split(full, -(-len(full) // 256)) if len(full) else []:
            extra = np.full((len(part), 32), -1)
            rows = np.searchsorted(part, target)
            mine = ~fits & (rows < len(part))
            mine[mine] = part[rows[mine]] == target[mine]
            which = place[mine] - np.maximum(free[mine], 0)
            keep = which < 32
            extra[rows[mine][keep], which[keep]] = source[mine][keep]
            table[part, : WIDTH // 2] = self._choose(part, np.concatenate([table[part], extra], axis=1), WIDTH // 2)
            table[part, WIDTH // 2 :] = -1

    def _choose(self, own: np.ndarray, candidates: np.ndarray, most: int) -> np.ndarray:
        """Up to ``most`` candidates, nearest first, that lie nearer to the node than to one chosen before; then the nearest rest."""
        sims = np.einsum("qd,qcd->qc", self.x[own], self.x[candidates])
        sims[(candidates < 0) | (candidates == own[:, None])] = -3
        width = min(candidates.shape[1], 3 * most)
        order = np.argsort(-sims, axis=1)[:, :width]
        ids, sims = np.take_along_axis(candidates, order, 1), np.take_along_axis(sims, order, 1)
        valid = sims > -3
        valid[:, 1:] &= ids[:, 1:] != ids[:, :-1]
        v = self.x[ids]
        between = v @ v.transpose(0, 2, 1)
        kept = np.zeros_like(valid)
        count = np.zeros(len(own), int)
        for j in range(width):
            rival = np.where(kept, between[:, j], -3).max(axis=1)
            kept[:, j] = valid[:, j] & (rival <= sims[:, j]) & (count < most)
            count += kept[:, j]
        rank = np.where(kept, 0, np.where(valid, 1, 2)) * width + np.arange(width)
        best = np.argsort(rank, axis=1)[:, :most]
        out = np.where(np.take_along_axis(valid, best, 1), np.take_along_axis(ids, best, 1), -1)
        return out if out.shape[1] == most else np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)

    def beam(self, queries: np.ndarray, entries: np.ndarray, width: int, layer: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """The ``width`` best nodes met from the entries, best first, and their similarities; -1 pads."""
        q, table = len(queries), self.neighbours[layer]
        width = max(width, entries.shape[1])
        seen = np.zeros((q, len(self.x) + 1), dtype=bool)  # the last column stands for -1
        seen[:, -1] = True
        rows = np.arange(q)[:, None]
        ids = np.full((q, width), -1)
        ids[:, : entries.shape[1]] = entries
        sims = np.where(ids >= 0, np.einsum("qd,qcd->qc", queries, self.x[ids]), -3)
        seen[rows, ids] = True
        done = ids < 0
        active = np.arange(q)
        while len(active):
            waiting = np.where(done[active], -4, sims[active])
            k = min(EXPAND, width)
            pick = np.argpartition(-waiting, k - 1, axis=1)[:, :k]
            real = np.take_along_axis(waiting, pick, 1) > -4
            done[active[:, None], pick] = True
            nodes = np.where(real, np.take_along_axis(ids[active], pick, 1), -1)
            fresh = np.where(nodes[:, :, None] >= 0, table[nodes], -1).reshape(len(active), -1)
            fresh = np.where(seen[active[:, None], fresh], -1, fresh)
            fresh = np.sort(fresh, axis=1)
            fresh[:, 1:][fresh[:, 1:] == fresh[:, :-1]] = -1  # two nodes may share a neighbour
            seen[active[:, None], fresh] = True
            got = np.where(fresh >= 0, np.einsum("qd,qcd->qc", queries[active], self.x[fresh]), -3)
            all_ids = np.concatenate([ids[active], fresh], axis=1)
            all_sims = np.concatenate([sims[active], got], axis=1)
            all_done = np.concatenate([done[active], fresh < 0], axis=1)
            best = np.argpartition(-all_sims, width - 1, axis=1)[:, :width]
            ids[active], sims[active], done[active] = (np.take_along_axis(a, best, 1) for a in (all_ids, all_sims, all_done))
            active = active[~done[active].all(axis=1)]
        order = np.argsort(-sims, axis=1)
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)

    def search(self, queries: np.ndarray, width: int) -> np.ndarray:
        """Nodes near each query: descent through the layers, then a beam on the lowest."""
        entries = np.full((len(queries), 1), self.entry)
        for layer in range(self.top, 0, -1):
            entries = self.beam(queries, entries, 4, layer)[0]
        return self.beam(queries, entries, width)[0]


class Shard:
    """Residents of a shard, their graph, and their exact components and link counts."""

    def __init__(self, ids: np.ndarray, copies: np.ndarray, unit: np.ndarray, similarity: float):
        self.ids, self.copies, self.unit, self.similarity = ids, copies, unit, similarity
        self.graph = Graph(unit)
        self.width = QUERY_BEAM
        self.root = np.arange(len(ids))
        while True:
            self._unite(self.width)
            if self._audit():
                break
            if self.width >= len(ids):
                self._unite_all()
                break
            self.width *= 2
        order = np.argsort(self.root, kind="stable")
        cuts = np.flatnonzero(np.diff(self.root[order])) + 1
        self.members = {int(self.root[g[0]]): g for g in np.split(order, cuts)} if len(order) else {}
        self.links = np.zeros(len(ids), dtype=np.int64)
        for group in self.members.values():
            if len(group) > 1:
                self.links[group] = self.count(self.unit[group], group) - self.copies[group]

    def count(self, queries: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Vectors (copies included) of a group linked with each query, in blocks of rows."""
        out = np.zeros(len(queries), dtype=np.int64)
        for at in range(0, len(queries), BATCH):
            out[at : at + BATCH] = (queries[at : at + BATCH] @ self.unit[group].T >= self.similarity) @ self.copies[group]
        return out

    def _find(self, x: int) -> int:
        while self.root[x] != x:
            self.root[x] = self.root[self.root[x]]
            x = self.root[x]
        return int(x)

    def _unite(self, width: int) -> None:
        n = len(self.ids)
        for at in range(0, n, BATCH):
            own = np.arange(at, min(n, at + BATCH))
            found = self.graph.beam(self.graph.x[own], own[:, None], width)[0]
            linked = (found >= 0) & (np.einsum("qd,qcd->qc", self.unit[own], self.unit[found]) >= self.similarity)
            self._join(own[np.nonzero(linked)[0]], found[linked])
        self.root = np.array([self._find(x) for x in range(n)], dtype=np.int64)

    def _unite_all(self) -> None:
        """Every pair of residents, in blocks."""
        n = len(self.ids)
        for at in range(0, n, BATCH):
            a, b = np.nonzero(self.unit[at : at + BATCH] @ self.unit.T >= self.similarity)
            self._join(a + at, b)
        self.root = np.array([self._find(x) for x in range(n)], dtype=np.int64)

    def _join(self, a: np.ndarray, b: np.ndarray) -> None:
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            x, y = self._find(x), self._find(y)
            self.root[max(x, y)] = min(x, y)

    def _audit(self) -> bool:
        """Whether every link of a sample of residents lies within their components."""
        n = len(self.ids)
        sample = np.arange(n) if n <= 1024 else np.random.default_rng(n).choice(n, max(1024, n // 16), replace=False)
        for at in range(0, len(sample), BATCH):
            own = sample[at : at + BATCH]
            a, b = np.nonzero(self.unit[own] @ self.unit.T >= self.similarity)
            if (self.root[own[a]] != self.root[b]).any():
                return False
        return True

    def query(self, unit: np.ndarray) -> tuple[np.ndarray, list[set[int]]]:
        """For vectors of other shards: linked vectors here, and roots of the components they link with."""
        while True:
            found = self.graph.search(unit.astype(np.float32), self.width)
            linked = (found >= 0) & (np.einsum("qd,qcd->qc", unit, self.unit[found]) >= self.similarity)
            roots: list[set[int]] = [set() for _ in unit]
            for a, b in zip(np.nonzero(linked)[0].tolist(), self.root[found[linked]].tolist(), strict=True):
                roots[a].add(b)
            sample = range(0, len(unit), max(1, len(unit) // AUDIT))
            hits = self.unit @ unit[list(sample)].T >= self.similarity
            if all(set(self.root[hits[:, k]].tolist()) <= roots[q] for k, q in enumerate(sample)):
                break
            if self.width >= len(self.ids):
                every = self.unit @ unit.T >= self.similarity
                roots = [set(self.root[every[:, q]].tolist()) for q in range(len(unit))]
                break
            self.width *= 2
        links = np.zeros(len(unit), dtype=np.int64)
        by_root: dict[int, list[int]] = {}
        for q, own in enumerate(roots):
            for r in own:
                by_root.setdefault(r, []).append(q)
        for r, own in by_root.items():
            links[own] += self.count(unit[own], self.members[r])
        return links, roots


def _unit(flat: np.ndarray, size: int) -> np.ndarray:
    x = flat.astype(np.float64).reshape(-1, size)
    x /= np.abs(x).max(axis=1, keepdims=True)  # so that no square overflows or vanishes
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _searcher(similarity: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def out(u: list, n: list, v: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(n, pa.int64()), pa.array(v, pa.int64())], ["u", "n", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by group (label, length, shard, chunk), residents before queries; the first chunk emits the residents."""
        group, held, shard = None, [], None

        def built() -> tuple[Shard, pa.RecordBatch]:
            ids, copies = (np.concatenate([h[k] for h in held]) for k in (0, 1))
            order = np.argsort(ids, kind="stable")  # the smallest place of a component has its smallest id
            made = Shard(ids[order], copies[order], np.concatenate([h[2] for h in held])[order], similarity)
            return made, out(made.ids.tolist(), made.links.tolist(), made.ids[made.root].tolist())

        for batch in batches:
            key = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(5)])
            cuts = [0, *(np.flatnonzero((np.diff(key) != 0).any(axis=0)) + 1).tolist(), key.shape[1]]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                label, size, number, chunk, foreign = key[:, a].tolist()
                part = batch.slice(a, b - a)
                ids, copies = (part.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (5, 6))
                unit = _unit(part.column(7).flatten().to_numpy(zero_copy_only=False), size)
                if (label, size, number, chunk) != group:
                    if held and not group[3]:
                        yield built()[1]
                    group, held, shard = (label, size, number, chunk), [], None
                if not foreign:
                    held.append((ids, copies, unit))
                    continue
                if shard is None:
                    if not held:
                        continue  # no resident here
                    shard, made = built()
                    held = []
                    if not chunk:
                        yield made
                for at in range(0, len(ids), BATCH):
                    links, roots = shard.query(unit[at : at + BATCH])
                    rows = [(u, n if first else 0, int(shard.ids[r])) for u, n, own in zip(ids[at : at + BATCH].tolist(), links.tolist(), roots, strict=True) for first, r in zip((True, *[False] * len(own)), sorted(own), strict=False)]
                    if rows:
                        yield out(*map(list, zip(*rows, strict=True)))
        if held and not group[3]:
            yield built()[1]

    return run


def near_duplicates(vectors: DataFrame, similarity: float = SIMILARITY, shard_size: int = SHARD, chunk_size: int = CHUNK) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "hnsw")
    given = vectors.schema["embedding"].dataType
    kind = "float" if isinstance(given, ArrayType) and isinstance(given.elementType, FloatType) else "double"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast(f"array<{kind}>").alias("e"))
    sound = F.forall("e", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("e", lambda c: c != 0)
    able = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & sound, F.lit(False))
    # Equal vectors are known by a digest from here on; -0.0 counts as 0.0.
    digest = F.sha2(F.concat_ws(",", F.col("label").cast("string"), F.transform("e", lambda c: (c + F.lit(0).cast(kind)).cast("string"))), 256)
    keyed = scratch.keep(rows.select("vec_id", "label", F.when(able, digest).alias("key"), F.when(able, F.col("e")).alias("e")))
    classes = scratch.keep(keyed.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("e").alias("e")))
    rows = scratch.keep(keyed.select("vec_id", "key"))
    scratch.drop(keyed)
    size = F.size("e").alias("size")
    sizes = classes.groupBy("label", size).agg(*(F.ceil(F.count("*") / n).cast("int").alias(name) for n, name in ((shard_size, "shards"), (chunk_size, "chunks"))))
    groups = sizes.agg(F.sum(F.col("shards").cast("long") * F.col("chunks"))).first()[0] or 1
    homes = classes.withColumn("size", size).join(sizes, ["label", "size"]).withColumn("home", F.pmod(F.xxhash64("key"), F.col("shards")))
    placed = homes.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).withColumn("foreign", F.col("shard") != F.col("home"))
    chunk = F.when(F.col("foreign"), F.array(F.pmod(F.xxhash64("key", F.lit(3)), F.col("chunks")).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("chunks") - 1))
    sent = placed.withColumn("chunk", F.explode(chunk)).select(*(F.col(c).cast("long").alias(c) for c in ("label", "size", "shard", "chunk", "foreign")), "id", "copies", "e", F.col("key").alias("k"))
    grouped = sent.repartition(int(min(TASKS, groups)), "label", "size", "shard", "chunk").sortWithinPartitions("label", "size", "shard", "chunk", "foreign", "k").drop("k")
    found = scratch.keep(grouped.mapInArrow(_searcher(similarity), "u long, n long, v long"))
    roots = components(found.select("u", "v"), scratch)
    links = found.groupBy("u").agg(F.sum("n").alias("n"))
    named = classes.select("key", "id", "copies").join(links, F.col("id") == F.col("u"), "left").join(roots, F.col("id") == F.col("node"), "left")
    named = scratch.keep(named.select(F.col("key").alias("k"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("root", "id").alias("c")))
    scratch.drop(classes, found)
    joined = rows.join(named, F.col("key") == F.col("k"), "left")
    component = F.coalesce("c", "vec_id")
    return joined.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
