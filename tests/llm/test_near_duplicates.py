"""Components, SimHash, HNSW and media against brute force."""

import random

import numpy as np
import pytest
import xxhash

from polyframe.llm import hnsw, media, simhash
from polyframe.llm.common import Scratch
from polyframe.llm.graph import components


def union(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(k, k + 1) for k in range(40)], [(0, k) for k in range(1, 30)], [(5, 3), (3, 5), (9, 7), (7, 2)], None])
def test_components(spark, edges):
    if edges is None:
        rnd = random.Random(1)
        edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(150)]
    frame = spark.createDataFrame([*edges, (None, 4)], "u long, v long")
    got = {r["node"]: r["root"] for r in components(frame, Scratch(spark, "t")).collect()}
    roots = union(500, edges)
    assert got == {x: roots[x] for e in edges if e[0] != e[1] for x in e}


# --- SimHash ----------------------------------------------------------------------------------------------------------


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


TEXTS = ["", None, " \t", "one", "Two words", "a b c d", "ÉA b c\x1cd e", "x " * 70000, "The SAME text", "the same TEXT"]


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprints(text):
    assert int.from_bytes(simhash.fingerprint(text), "big") == plain_fingerprint(text)


def test_spark_hashes_shingles_alike(spark):
    assert spark.sql("SELECT xxhash64('a b c')").first()[0] % 2**64 == xxhash.xxh64_intdigest("a b c", 42)


def brute_components(ids, prints, bits=2):
    n = len(ids)
    pairs = [(a, b) for a in range(n) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= bits or ids[a] == ids[b]]
    roots = union(n, pairs)
    least = {}
    for k in range(n):
        least[roots[k]] = min(least.get(roots[k], ids[k]), ids[k])
    return {ids[k]: least[roots[k]] for k in range(n)}


def test_near_duplicates(spark):
    rnd = random.Random(3)
    words = [f"w{k}" for k in range(300)]
    rows = []
    for k in range(250):
        base = [rnd.choice(words) for _ in range(rnd.randrange(20, 400))]
        rows.append(" ".join(base))
        for _ in range(rnd.randrange(0, 3)):
            copy = list(base)
            copy[rnd.randrange(len(copy))] = rnd.choice(words)
            rows.append(" ".join(copy))
    rows += TEXTS + TEXTS[:3]
    data = [(k + 10, t, "x", 1) for k, t in enumerate(rows)] + [(12, "another text of a known id", "x", 1), (None, "a b c d", "x", 1)]
    got = simhash.near_duplicates(spark.createDataFrame(data, "doc_id long, text string, fp string, component_id int").repartition(3)).collect()
    assert len(got) == len(data)
    known = [(i, plain_fingerprint(t)) for i, t, *_ in data if i is not None]
    expected = brute_components([i for i, _ in known], [p for _, p in known])
    assert sorted((r["doc_id"], r["component_id"]) for r in got if r["doc_id"] is not None) == sorted((i, expected[i]) for i, _ in known)
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [None]
    assert {(r["doc_id"], r["fingerprint"]) for r in got if r["doc_id"] is not None} == {(i, f"{p:016x}") for i, p in known}


def test_no_documents(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("spread", [64, 20, 6])
def test_shared_tree_and_shards_lose_no_link(spark, monkeypatch, spread):
    """Dense clusters and random fingerprints, over many small shards."""
    monkeypatch.setattr(simhash, "SHARD", 60)
    monkeypatch.setattr(simhash, "LEAF", 8)
    rnd = random.Random(spread)
    prints = set()
    for _ in range(120):
        base = rnd.getrandbits(spread)
        prints.add(base)
        for _ in range(rnd.randrange(0, 12)):
            base ^= 1 << rnd.randrange(64) | (1 << rnd.randrange(64) if rnd.random() < 0.4 else 0)
            prints.add(base)
    data = [(k, p - (1 << 64) if p >> 63 else p) for k, p in enumerate(sorted(prints))]
    edges = simhash.links(spark.createDataFrame(data, "id long, fp long"), len(data), 2).collect()
    points = sorted(prints)
    assert all(r["u"] != r["v"] for r in edges)
    wanted = union(len(points), [(a, b) for a in range(len(points)) for b in range(a) if (points[a] ^ points[b]).bit_count() <= 2])
    assert union(len(points), [(r["u"], r["v"]) for r in edges]) == wanted


def test_entries_multiply_slowly():
    """Copies that the shared tree makes of random fingerprints, which no split parts well, at two sizes."""
    rng = np.random.default_rng(0)
    points = rng.integers(0, 1 << 64, 100_000, dtype=np.uint64)
    times = {}
    for shards in (32, 512):
        tree = simhash.grow(points[: max(simhash.LEAST, simhash.SAMPLE * shards)], shards, 2)
        times[shards] = len(simhash.route(points, tree, 2)[0]) / len(points)
    print(f"copies of an entry: {times}")
    assert times[32] < 4 and times[512] < 2 * times[32]  # power of 1/4 of the number of shards, at most


# --- HNSW -------------------------------------------------------------------------------------------------------------


def vectors(seed, n, dim=16, clusters=12):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dim))
    out = []
    for k in range(n):
        if k % 3 == 0:
            v = rng.normal(size=dim)
        else:
            v = centres[rng.integers(clusters)] + rng.normal(size=dim) * 0.12
        out.append((k, [float(np.float32(x)) for x in v], int(rng.integers(2))))
    return out


def brute_links(rows, similarity):
    usable = [(k, np.array(e, float)) for k, (_, e, label) in enumerate(rows) if rows[k][0] is not None and label is not None and e and None not in e and np.isfinite(e).all() and any(e)]
    links, pairs = [0] * len(rows), []
    for x, (a, u) in enumerate(usable):
        for b, v in usable[:x]:
            if rows[a][2] == rows[b][2] and len(u) == len(v) and u @ v / np.sqrt((u @ u) * (v @ v)) >= similarity:
                links[a] += 1
                links[b] += 1
                pairs.append((a, b))
    roots = union(len(rows), pairs)
    least = {}
    for k, (i, *_) in enumerate(rows):
        least[roots[k]] = min(least.get(roots[k], i), i) if i is not None else None
    return [(rows[k][0], links[k], least[roots[k]]) for k in range(len(rows))]


@pytest.mark.parametrize("shard", [16384, 90])
def test_vectors(spark, shard):
    rows = vectors(shard, 600)
    rows += [(1000, rows[0][1], rows[0][2]), (1001, rows[0][1], rows[0][2]), (1002, None, 1), (1003, [], 1), (1004, [0.0] * 16, 1), (1005, [float("nan")] * 16, 0), (1006, [None] * 16, 0), (1007, rows[1][1], None), (1008, [2 * x for x in rows[0][1]], rows[0][2]), (1009, [1.0, 0.0], 0), (1010, [float("inf")] + [0.0] * 15, 0)]
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, label int, id int, shard int").repartition(3)
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in hnsw.near_duplicates(frame, shard_size=shard).collect())
    assert got == sorted(brute_links(rows, 0.98))


def test_vectors_without_ids_or_rows(spark):
    frame = spark.createDataFrame([(None, [1.0, 2.0], 1), (3, [1.0, 2.0], 1), (3, [1.0, 2.0], 1)], "vec_id long, embedding array<double>, label int")
    got = sorted(map(tuple, hnsw.near_duplicates(frame).collect()), key=str)
    assert got == [(3, 1, 3, True), (3, 1, 3, True), (None, 0, None, False)]
    assert hnsw.near_duplicates(frame.limit(0)).count() == 0


def test_graph_recall():
    x = np.random.default_rng(0).normal(size=(3000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = hnsw.Graph(x)
    queries = x[:200] + np.random.default_rng(1).normal(size=(200, 32)) * 0.02
    found = graph.search(queries.astype(np.float32), 32)
    assert np.mean([k in found[k] for k in range(200)]) > 0.95


@pytest.mark.parametrize("kind", ["float", "double"])
def test_one_label_of_several_shards_and_chunks(spark, kind):
    rows = [(k, e, 0) for k, e, _ in vectors(5, 450)]
    frame = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int").repartition(3)
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in hnsw.near_duplicates(frame, shard_size=90, chunk_size=100).collect())
    assert got == sorted(brute_links(rows, 0.98))


def test_a_disconnected_graph_is_compared_by_brute_force(monkeypatch):
    """Without edges no beam gets anywhere: audits must notice, and brute force must find every link."""
    def no_links(self, own, found, layer):
        return None

    monkeypatch.setattr(hnsw.Graph, "_link", no_links)
    x = np.random.default_rng(3).normal(size=(2000, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.95
    shard = hnsw.Shard(np.arange(2000), np.ones(2000, int), x, 0.95)
    assert (shard.links == near.sum(axis=1) - 1).all()
    assert shard.root.tolist() == union(2000, zip(*(c.tolist() for c in np.nonzero(near)), strict=True))
    links, roots = shard.query(x[:700])
    assert (links == near[:700].sum(axis=1)).all()
    assert all(set(shard.root[np.flatnonzero(near[k])].tolist()) == roots[k] for k in range(700))


def test_audit_widens_beams():
    x = np.random.default_rng(0).normal(size=(400, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    shard = hnsw.Shard(np.arange(400), np.ones(400, int), x, 0.9)
    near = x @ x.T >= 0.9
    assert (shard.links == near.sum(axis=1) - 1).all()
    links, roots = shard.query(x[:50])
    assert (links == near[:50].sum(axis=1)).all()
    assert all(set(shard.root[np.flatnonzero(near[k])].tolist()) == roots[k] for k in range(50))


# --- Media ------------------------------------------------------------------------------------------------------------


def pictures(n=12, seed=0):
    rng = np.random.default_rng(seed)
    return [np.kron(rng.uniform(0, 255, (20, 20)), np.ones((8, 8))) for _ in range(n)]


EDITS = {
    "crop": lambda p: p[20:140, 30:150],
    "darker": lambda p: p * 0.7 + 20,
    "noise": lambda p: p + np.random.default_rng(5).normal(0, 6, p.shape),
    "turned": np.rot90,
    "smaller": lambda p: media.resize(p[None].astype(np.float32), 1.5)[0],
}


def png(picture):
    import struct
    import zlib

    grey = np.clip(np.rint(picture), 0, 255).astype(np.uint8)
    h, w = grey.shape
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    sub = np.concatenate([np.full((h, 1), 1, np.uint8), grey - np.pad(grey[:, :-1], ((0, 0), (1, 0)))], axis=1)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(sub.tobytes())) + chunk(b"IEND", b"")


def test_decoding():
    p = np.arange(600, dtype=float).reshape(20, 30) % 256
    assert (media.decode(media.encode_pgm(p)) == p).all()
    assert (media.decode(png(p)) == p).all()
    assert media.decode(b"P6\n#x\n1 1\n255\n\xff\xff\xff")[0, 0] == pytest.approx(255, abs=0.1)
    for raw in (None, b"", b"P5", b"P5\n9 9\n255\nx", b"\x89PNG\r\n\x1a\nxx", b"GIF89a"):
        assert media.decode(raw) is None


def test_copies(spark):
    base = pictures()
    rows = [(k, media.encode_pgm(p)) for k, p in enumerate(base)]
    rows += [(100 + 10 * k + e, png(edit(p)) if e % 2 else media.encode_pgm(edit(p))) for k, p in enumerate(base) for e, edit in enumerate(EDITS.values())]
    rows += [(900, rows[0][1]), (900, rows[0][1]), (901, None), (902, b"rubbish"), (903, b"rubbish"), (904, media.encode_pgm(np.zeros((40, 40)))), (None, rows[1][1])]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "media_id long, media binary, component_id int").repartition(3)
    got = media.copies(frame).collect()
    assert len(got) == len(rows)
    found = {r["media_id"]: r["component_id"] for r in got}
    edits = [(100 + 10 * k + e, k) for k in range(len(base)) for e in range(len(EDITS))]
    assert sum(found[i] == k for i, k in edits) >= 0.9 * len(edits)  # recall against all planted pairs
    assert all(found[i] in (i, k) or found[i] in [j for j, m in edits if m == k] for i, k in edits)  # nothing else is joined
    assert [found[k] for k in range(len(base))] == list(range(len(base)))
    assert (found[900], found[901], found[902], found[903], found[904], found[None]) == (0, 901, 902, 902, 904, None)
    assert media.copies(frame.limit(0)).count() == 0


def test_large_group_of_copies(spark):
    """Votes of a group of near copies meet in one leader however large the group is."""
    rng = np.random.default_rng(2)
    base = pictures(1, seed=4)[0][:96, :96]
    rows = [(k, media.encode_pgm(base + rng.normal(0, 6, base.shape))) for k in range(1500)]
    got = media.copies(spark.createDataFrame(rows, "media_id long, media binary").repartition(4)).collect()
    assert sum(r["component_id"] == 0 for r in got) >= 0.98 * len(rows)


def test_two_votes_make_a_candidate(spark):
    frame = spark.createDataFrame([(1, 1, [10, 20, 30]), (2, 2, [10, 20, 31]), (3, 3, [10, 21, 32])], "id long, root long, keys array<int>")
    got = {tuple(r) for r in media.candidates(frame.where("id < 3"), media.ORDERS[0]).collect()}
    assert got == {(2, 1)}
    assert media.candidates(frame.where("id != 2"), media.ORDERS[0]).count() == 0  # one bucket in common


def test_rendering(spark):
    frame = spark.createDataFrame([(1, [0.0, 1.0, 0.5]), (2, None), (3, [float("nan")]), (4, [2.0])], "vec_id long, embedding array<double>")
    got = {r["media_id"]: r["media"] for r in media.rendered(frame).collect()}
    assert got[2] is None and got[3] is None and media.decode(bytes(got[4])).shape == (8, 8)
    assert media.decode(bytes(got[1])).shape == (16, 16)


def patched(rng, patches):
    """A picture of shared patches with a mark that all pictures bear."""
    p = np.block([[patches[rng.integers(len(patches))] for _ in range(5)] for _ in range(5)])
    p[:32, :32] = patches[0]
    return p


def test_recall_among_shared_patches(spark):
    """Against comparing all pairs, in pictures whose patches hundreds of others hold."""
    rng = np.random.default_rng(8)
    patches = [np.kron(rng.uniform(0, 255, (4, 4)), np.ones((8, 8))) for _ in range(60)]
    edits = list(EDITS.values())
    base = [patched(rng, patches) for _ in range(150)]
    shown = base + [edits[k % len(edits)](p) for k, p in enumerate(base)]
    rows = [(k, media.encode_pgm(p)) for k, p in enumerate(shown)]
    got = {r["media_id"]: r["component_id"] for r in media.copies(spark.createDataFrame(rows, "media_id long, media binary")).collect()}
    known = [media.describe(media.decode(raw)[None])[0] for _, raw in rows]
    pairs = [(a, b) for a in range(len(known)) for b in range(a) if media.agree(known[a], known[b])]
    assert sum(got[a] == got[b] for a, b in pairs) >= 0.97 * len(pairs)
    roots = union(len(known), pairs + [(b, a) for a in range(len(known)) for b in range(a) if media.agree(known[b], known[a])])
    assert all(roots[got[k]] == roots[k] for k in got)  # nothing is joined that no pair joins


def test_larger_buckets_drop_no_pair(spark):
    """Cells of vectors look alike, so most corners stand in large buckets: what all pairs link is linked all the same."""
    rng = np.random.default_rng(3)
    base = [media.render(rng.normal(size=64)) for _ in range(150)]
    shown = base + [p * 0.9 + rng.normal(0, 4, p.shape) for p in base[:50]] + [media.resize(np.pad(p, 12, mode="edge")[None].astype(np.float32), 1.3)[0] for p in base[50:100]]
    rows = [(k, media.encode_pgm(p)) for k, p in enumerate(shown)]
    known = [media.describe(media.decode(raw)[None])[0] for _, raw in rows]
    pairs = [(a, b) for a in range(len(known)) for b in range(a) if media.agree(known[a], known[b])]
    frame = spark.createDataFrame(rows, "media_id long, media binary").repartition(3)
    features = media.features(frame.withColumnRenamed("media_id", "id"))
    crowd = {r["id"] for r in media.crowded(features).collect()}
    among = [p for p in pairs if crowd.issuperset(p)]
    assert len(crowd) > 150 and len(among) > 30
    got = {r["media_id"]: r["component_id"] for r in media.copies(frame).collect()}
    assert all(got[a] == got[b] for a, b in among)
    members = features.select("id", features["id"].alias("root"))  # nothing is united yet: every pair is compared
    assert sorted((r["u"], r["v"]) for r in media.compared(features, members).collect()) == pairs


def prepared(pictures):
    """Features as a task that compares blocks holds them."""
    out = [media.describe(p[None].astype(np.float32))[0] for p in pictures]
    out = [f for f in out if f["bits"]]
    for f in out:
        f |= {name: np.array(f[name], kind) for name, kind in (("x", np.float32), ("y", np.float32), ("level", np.int32), ("direction", np.int32))}
        f["words"] = np.frombuffer(f["bits"], np.uint64).reshape(-1, 4).T
    return out


@pytest.mark.parametrize("shared", [5, media.SHARED])
def test_pictures_abreast_lose_no_pair(monkeypatch, shared):
    """Of pictures of several sizes, with corners that look the same, every pair that agrees is found, and asked about rarely in vain."""
    monkeypatch.setattr(media, "SHARED", shared)
    rng = np.random.default_rng(6)
    tile = np.kron(rng.uniform(0, 255, (3, 3)), np.ones((8, 8)))
    base = [media.render(rng.normal(size=64)) for _ in range(40)] + [np.tile(tile, (n, 4)) for n in (3, 3, 4)] + pictures(3) + [np.kron(rng.uniform(0, 255, (50, 50)), np.ones((8, 8)))]
    known = prepared(base + [p * 0.9 + rng.normal(0, 4, p.shape) for p in base] + [np.rot90(p) for p in base[-20:]] + [base[-1][:256, 100:356]])
    assert len({len(f["x"]) for f in known}) > 5
    held = [(k, k, f) for k, f in enumerate(known)]
    wanted = [(a, b) for a in range(len(known)) for b in range(a) if media.agree(known[a], known[b])]
    asked, agree = [], media.agree
    monkeypatch.setattr(media, "agree", lambda a, b: asked.append(1) or agree(a, b))
    for size in (len(held), 70):
        asked.clear()
        assert sorted(media._met(held, [media.Chunk(held[k : k + size]) for k in range(0, len(held), size)])) == wanted
        assert len(wanted) <= len(asked) < 3 * len(wanted)
    one = [(7, k, f) for k, f in enumerate(known[:30])]
    assert media._met(one, [media.Chunk(one)]) == []  # equal roots are united already


def test_comparing_costs_little_beside_verifying():
    """All pairs of rendered vectors, whose corners look alike, in a fraction of the time that verifying each would take."""
    import time

    known = prepared([media.render(v) for v in np.random.default_rng(9).normal(size=(800, 64))])
    begin = time.process_time()
    for f in known[1:300]:
        media.agree(f, known[0])
    each = (time.process_time() - begin) / 299
    ids, fields = list(range(800)), [{n: f[n].tolist() for n in ("x", "y", "level", "direction")} | {"bits": f["bits"]} for f in known]
    columns = [0] * 800, [False] * 400 + [True] * 400, ids, ids, fields
    batch = media.pa.RecordBatch.from_arrays([media.pa.array(c) for c in columns], list("abcde"))
    begin = time.process_time()
    for _ in media._agreeing([batch]):
        pass
    took = (time.process_time() - begin) / (400 * 400)
    print(f"microseconds a pair: {took * 1e6:.1f}, verifying each {each * 1e6:.1f}")
    assert took < each / 5


def test_neighbours_meet_across_batches():
    import pyarrow as pa

    slot, rank, own = np.repeat([7, 8, 8], [5, 4, 4]), np.repeat([0, 1, 2], [5, 4, 4]), np.arange(13)
    own[6] = own[5]  # two corners of one picture
    whole = pa.RecordBatch.from_arrays([pa.array(c) for c in (slot, own, rank, 100 + own)], list("abcd"))
    wanted = [(own[a], own[b]) for a in range(13) for b in range(a) if a - b <= media.NEAR and (slot[a], rank[a]) == (slot[b], rank[b]) and own[a] != own[b]]
    for size in (13, 5, 1):
        out = [p for part in media._neighbours(whole.slice(at, size) for at in range(0, 13, size)) for p in zip(*(c.to_pylist() for c in part.columns), strict=True)]
        assert sorted((u, v) for u, _, v, _ in out) == sorted(wanted)
        assert all((p, q) == (100 + u, 100 + v) for u, p, v, q in out)


def test_corners_vote_for_a_pose(spark):
    """Two corners that moved alike make a candidate; two that moved differently, or one in many tables, do not."""
    def row(number, keys, xs, ys):
        f = {"x": xs, "y": ys, "level": [0] * len(xs), "direction": [3] * len(xs)}
        return number, [k for key in keys for k in [key] * 8], media.places(f).tolist()

    near = [row(1, [5, 6, 7], [10, 90, 50], [10, 20, 80]), row(2, [5, 6, 9], [15, 95, 50], [12, 22, 10])]
    apart = row(3, [15, 16, 9], [10, 90, 50], [10, 20, 80]), row(4, [15, 16, 8], [90, 10, 50], [10, 20, 80])
    frame = spark.createDataFrame([*near, *apart], "id long, keys array<int>, places array<long>")
    assert [tuple(r) for r in media.candidates(frame, media.ORDERS[0]).collect()] == [(2, 1)]


def test_sketches_tell_alike_from_different():
    rng = np.random.default_rng(4)
    a, b = rng.integers(-(1 << 31), 1 << 31, (2, 224))
    mixed = np.where(rng.random(224) < 0.8, a, b)
    assert (media.sketch(a) == media.sketch(mixed)).mean() > 0.3 and not (media.sketch(a) == media.sketch(b)).any()


def hostile():
    import struct
    import zlib

    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    def file(w, h, data, kind=0):
        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + chunk(b"IDAT", data) + chunk(b"IEND", b"")

    whole = file(8, 8, zlib.compress(bytes(72)))
    return [
        b"P5\n0 0\n255\n", b"P5\n5 0\n255\n", b"P5\n0 5\n255\n", b"P5\n99999999999999 99999999999\n255\n", b"P5\n" + b"9" * 6000 + b" 1\n255\n", b"P6\n4 4\n255\n" + bytes(47), b"P5 4 4 0\n" + bytes(16), b"P5\n-4 4\n255\n", b"P5 #", b"P5\n4",
        file(0, 0, zlib.compress(b"")), file(4294967295, 4294967295, b""), file(60000, 60000, zlib.compress(bytes(1 << 20))), file(8, 8, zlib.compress(bytes(71))), file(8, 8, zlib.compress(bytes([9]) * 72)),
        whole[:20], whole[:40], whole[: len(whole) // 2], whole.replace(b"IDAT", b"IDAX"), b"\x89PNG\r\n\x1a\n",
    ]


@pytest.mark.parametrize("k", range(len(hostile())))
def test_hostile_media(k):
    assert media.decode(hostile()[k]) is None


def test_compressed_bombs_stay_small():
    import struct
    import tracemalloc
    import zlib

    data = zlib.compress(bytes(200 << 20), 9)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", 0)
    raw = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 30, 30, 8, 0, 0, 0, 0)) + chunk(b"IDAT", data)
    tracemalloc.start()
    assert media.decode(raw).shape == (30, 30)
    assert tracemalloc.get_traced_memory()[1] < 8 << 20
    tracemalloc.stop()


@pytest.mark.parametrize("depth", [1, 2, 3, 4])
@pytest.mark.parametrize("kinds", [(0, 1, 2), (0, 1, 2, 3, 4)])
def test_filters_are_undone(depth, kinds):
    rng = np.random.default_rng(depth)
    want = rng.integers(0, 256, (13, 9, depth)).astype(np.uint8)
    padded = np.pad(want, ((1, 0), (1, 0), (0, 0))).astype(int)
    used = rng.choice(kinds, 13).astype(np.uint8)
    used[0] = max(kinds)
    coded = np.zeros_like(want)
    for y in range(13):
        for x in range(9):
            for c in range(depth):
                left, up, corner = padded[y + 1, x, c], padded[y, x + 1, c], padded[y, x, c]
                p = left + up - corner
                near = sorted((abs(p - v), k, v) for k, v in enumerate((left, up, corner)))[0][2]
                coded[y, x, c] = (int(want[y, x, c]) - (0, left, up, (left + up) // 2, near)[used[y]]) % 256
    assert (media._unfiltered(used, coded) == want).all()


def test_hostile_media_in_a_table(spark):
    rows = [*enumerate(hostile()), (500, media.encode_pgm(pictures(1)[0])), (501, media.encode_pgm(pictures(1)[0] * 0.9))]
    got = {r["media_id"]: r["component_id"] for r in media.copies(spark.createDataFrame(rows, "media_id long, media binary").repartition(3)).collect()}
    assert got[501] == 500 and all(got[k] == k for k in range(len(hostile())))


def test_large_pictures_have_more_corners():
    big = np.kron(np.random.default_rng(1).uniform(0, 255, (64, 64)), np.ones((8, 8))).astype(np.float32)
    whole = media.describe(big[None])[0]
    assert len(whole["x"]) > 3 * (16 + 8 + 4)
    for y, x in ((0, 0), (128, 100), (256, 256)):
        assert media.agree(whole, media.describe(big[None, y : y + 256, x : x + 256])[0])  # a quarter of the picture
