"""SimHash near-duplicates found through a vantage-point tree over fingerprints.

1. Every text gets a 64-bit fingerprint of its word shingles. Equal fingerprints become one entry
   with the smallest id and a count, by partial aggregation, so exact copies cost one row per task.
2. A vantage-point tree of bounded size is built from a bounded sample of fingerprints. It only
   decides where fingerprints go, never which pairs count. A fingerprint belongs to the shard of
   its side at each node (distance to the vantage point up to or beyond a radius). One whose
   distance lies within ``bits`` below the radius also goes to the far side. By the triangle
   inequality two fingerprints that differ in at most ``bits`` bits then share a shard: if they
   part at a node, the nearer one's distance is within ``bits`` of the other's, hence of the radius.
   Both are then on the far side, and so on down.
3. Each shard continues the tree in memory down to small leaves, where exact distances are taken;
   it emits a spanning forest of its links (at most one row per entry), never all pairs.
4. Forests are united by ``graph.components``.

Defined results: a null, empty or wordless text has fingerprint zero and is linked like any other;
texts of any length count whole, repeats of shingles included; repeated rows and equal ids each
keep their row; a null id links nothing and its component is null; an empty table gives no row;
columns other than the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .graph import components

#: Shingles hashed at once.
BLOCK = 1 << 16
#: Entries aimed at in a shard, sampled entries for each shard, and the most shards the shared tree makes.
#: The sample is about SAMPLE fingerprints a shard, LEAST at least, at most 2 * SAMPLE * MOST_SHARDS (16 MB);
#: beyond MOST_SHARDS shards grow instead.
SHARD, SAMPLE, LEAST, MOST_SHARDS = 8192, 16, 4096, 1 << 16
#: Entries compared pair by pair in a leaf; larger leaves that cannot be split are compared in blocks.
LEAF = 256
#: Vantage points tried at each node, and the least share of entries on a side of the shared tree's nodes.
TRIES, LEAST_SIDE = 8, 0.02

FINGERPRINTS = "doc_id long, fp long, fingerprint string"


def fingerprint(text: str | None, words: int = 3) -> bytes:
    """The 8 bytes, most significant first, of a text's SimHash over XXH64 (seed 42) of word shingles."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z and ASCII white space
    if not tokens:
        return bytes(8)
    ones, n = np.zeros(64, dtype=np.int64), max(1, len(tokens) - words + 1)
    for at in range(0, n, BLOCK):
        shifted = [tokens[at + k : min(at + BLOCK, n) + k] for k in range(min(words, len(tokens)))]
        digests = b"".join(map(xxhash.xxh64_digest, map(b" ".join, zip(*shifted, strict=True)), repeat(42)))
        ones += np.unpackbits(np.frombuffer(digests, dtype=np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > n).tobytes()


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, fingerprint as a signed long and as 16 hexadecimal digits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(text.as_py(), words) for text in batch.column(1)]
            longs = np.frombuffer(b"".join(found), dtype=">i8").astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(longs), pa.array([f.hex() for f in found], pa.string())], ["doc_id", "fp", "fingerprint"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, FINGERPRINTS)


def far(points: np.ndarray, vantage: np.uint64) -> np.ndarray:
    """Hamming distances."""
    return np.bitwise_count(points ^ vantage)


def split(points: np.ndarray, bits: int, seed: int = 0, shared: bool = False) -> tuple[np.uint64, int] | None:
    """The vantage point and radius that send the fewest entries down, of a few tried; None if none parts them.

    In the shared tree an entry sent to both sides is sent again and again, so what counts there is
    by how much entries multiply for each bit of information about their shard.
    """
    best, best_cost = None, np.inf
    sample = points if len(points) <= 2048 else points[:: len(points) // 1024]
    n = len(sample)
    radii = np.arange(64)
    for vantage in np.random.default_rng(seed).choice(sample, min(TRIES, n), replace=False):
        upto = np.cumsum(np.bincount(far(sample, vantage), minlength=65)[:65])
        near = upto[radii] / n
        beyond = 1 - np.where(radii - bits >= 0, upto[np.maximum(radii - bits, 0)], 0) / n
        total = near + beyond
        if shared:
            p = near / total
            known = -(p * np.log2(np.maximum(p, 1e-9)) + (1 - p) * np.log2(np.maximum(1 - p, 1e-9)))
            cost = np.log2(total) / np.maximum(known, 1e-9)
            cost[(near < LEAST_SIDE) | (1 - near < LEAST_SIDE) | (np.maximum(near, beyond) > 1 - LEAST_SIDE)] = np.inf
        else:
            cost = np.maximum(near, beyond) + 0.5 * (total - 1)
            cost[(near == 0) | (cost >= 0.97)] = np.inf
        radius = int(np.argmin(cost))
        if cost[radius] < best_cost:
            best, best_cost = (vantage, radius), float(cost[radius])
    return best


def grow(points: np.ndarray, shards: int, bits: int) -> list[tuple]:
    """The shared tree as nodes (vantage, radius, near, beyond); a negative child -k-1 is shard k."""
    nodes: list[list] = []
    count = 0

    def child(own: np.ndarray, wanted: float) -> int:
        nonlocal count
        parted = split(own, bits, shared=True) if wanted > 1 and len(own) > 4 else None
        if parted is None:
            count += 1
            return -count
        vantage, radius = parted
        at = len(nodes)
        nodes.append([vantage, radius, 0, 0])
        d = far(own, vantage)
        inside, outside = own[d <= radius], own[d > radius - bits]
        nodes[at][2] = child(inside, wanted * len(inside) / len(own))
        nodes[at][3] = child(outside, wanted * len(outside) / len(own))
        return at

    child(points, shards)
    return [tuple(x) for x in nodes]


def route(points: np.ndarray, tree: list[tuple], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(place in points, shard) of every shard that each entry belongs to."""
    if not tree:
        return np.arange(len(points)), np.zeros(len(points), dtype=np.int64)
    places, shards = [], []
    stack = [(0, np.arange(len(points)))]
    while stack:
        at, own = stack.pop()
        if not len(own):
            continue
        if at < 0:
            places.append(own)
            shards.append(np.full(len(own), -at - 1))
            continue
        vantage, radius, near, beyond = tree[at]
        d = far(points[own], vantage).astype(np.int64)
        stack += [(near, own[d <= radius]), (beyond, own[d > radius - bits])]
    return np.concatenate(places or [np.zeros(0, int)]), np.concatenate(shards or [np.zeros(0, int)])


def forest(points: np.ndarray, bits: int) -> np.ndarray:
    """For each distinct fingerprint of a shard, the place of the first one that it reaches by links."""
    root = np.arange(len(points))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def leaf(own: np.ndarray) -> None:
        step = max(1, (1 << 20) // len(own))
        for at in range(0, len(own), step):
            a, b = np.nonzero(np.bitwise_count(points[own[at : at + step], None] ^ points[None, own]) <= bits)
            for x, y in zip(own[a[b < a + at] + at], own[b[b < a + at]], strict=True):
                x, y = find(x), find(y)
                root[max(x, y)] = min(x, y)

    stack = [np.arange(len(points))]
    while stack:
        own = stack.pop()
        parted = split(points[own], bits, seed=len(own)) if len(own) > LEAF else None
        if parted:
            d = far(points[own], parted[0]).astype(np.int64)
            inside, outside = own[d <= parted[1]], own[d > parted[1] - bits]
            if max(len(inside), len(outside)) < len(own):
                stack += [inside, outside]
                continue
        if len(own) > 1:
            leaf(own)
    return np.array([find(x) for x in range(len(points))], dtype=np.int64)


def links(entries: DataFrame, n: int, bits: int) -> DataFrame:
    """Edges (u, v) between ids that span the groups of near fingerprints; ``entries`` has fp, id; n rows."""
    shards = int(min(MOST_SHARDS, max(1, -(-n // SHARD))))
    tree: list[tuple] = []
    if shards > 1:
        take = max(LEAST, SAMPLE * shards)
        # Only where shards part depends on this sample; every entry is routed and compared.
        chosen = entries.select("fp").where(F.pmod(F.xxhash64("fp", F.lit(7)), F.lit(max(1, n // take))) == 0)
        tree = grow(np.array([r[0] for r in chosen.collect()], dtype=np.int64).view(np.uint64), shards, bits)
    shared = entries.sparkSession.sparkContext.broadcast(tree)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, shard = route(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), shared.value, bits)
            yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int64)), batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at))], ["shard", "fp", "id"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        last = None
        for batch in batches:
            shard = batch.column(0).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if last is not None and shard[a] != last:
                    yield unite(held)
                    held = []
                last = shard[a]
                held.append(pa.Table.from_batches([batch.slice(a, b - a)]))
        if held:
            yield unite(held)

    def unite(parts: list[pa.Table]) -> pa.RecordBatch:
        table = pa.concat_tables(parts)
        ids = table["id"].to_numpy().astype(np.int64)
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        root = forest(table["fp"].to_numpy().astype(np.int64).view(np.uint64)[order], bits)
        moved = root != np.arange(len(root))
        return pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[root[moved]])], ["u", "v"])

    sent = entries.select("fp", "id").mapInArrow(send, "shard long, fp long, id long")
    if shards > 1:
        sent = sent.repartition(F.col("shard"))
    else:
        sent = sent.coalesce(1)
    return sent.sortWithinPartitions("shard").mapInArrow(join, "u long, v long")


def near_duplicates(docs: DataFrame, words: int = 3, bits: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint, component_id (smallest id reachable over links of at most ``bits`` differing bits)."""
    scratch = Scratch(docs.sparkSession, "simhash")
    prints = scratch.keep(fingerprints(docs, words, id_col, text_col))
    return _united(prints, bits, scratch)


def _united(prints: DataFrame, bits: int, scratch: Scratch) -> DataFrame:
    entries = scratch.keep(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("id")))
    # An id that stands with several fingerprints joins their groups, as one document does.
    shared_ids = prints.where("doc_id is not null").select("doc_id", "fp").distinct().groupBy("doc_id").agg(F.count("*").alias("n"), F.min("fp").alias("first")).where("n > 1")
    same = prints.join(shared_ids, "doc_id").join(entries, "fp").select(F.col("doc_id").alias("u"), F.col("id").alias("v"))
    found = components(links(entries, entries.count(), bits).unionByName(same), scratch)
    named = entries.join(found, entries["id"] == found["node"], "left").select(F.col("fp").alias("k"), F.coalesce("root", "id").alias("root"))
    joined = prints.join(scratch.keep(named), F.col("fp") == F.col("k"), "left")
    return joined.select("doc_id", "fingerprint", F.when(F.col("doc_id").isNotNull(), F.col("root")).alias("component_id"))
