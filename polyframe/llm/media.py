"""Cropped and edited copies of images by local descriptors, Hamming tables and geometric consensus.

1. One pass over the media gives each picture its corners over three scales (Harris response, local
   maxima, the best of each tile), each turned by the direction of its intensity centroid and
   described by 256 binary tests. From there on only features travel, never media. Equal files
   become one class with the smallest id, by partial aggregation.
2. A descriptor stands in eight tables, one for each 32 of its bits: two that differ in up to seven
   bits meet in one of them at least. The tables are joined with themselves, bucket by bucket. Two
   corners that meet vote for a pose of their pictures: a turn, a scale and a shift, in coarse steps.

   - In a bucket of up to ``SMALL`` corners every two vote.
   - In a larger one nobody forms all pairs. It is sorted by a MinHash of each picture's keys, which
     one is drawn by the bucket, and corners of equal MinHash vote with their ``NEAR`` neighbours:
     copies have most keys in common, so they stand side by side even where many other pictures
     share a patch. A large group of copies is linked through its buckets and draws many times over.
     Adaptive execution may split such a bucket; its parts are then sorted by themselves. These
     votes only come first: what they miss is found by step 5.

3. Pairs whose pictures have ``VOTES`` corners that vote for one pose are verified: descriptors within ``BITS`` bits are matched, and one
   similarity transform must carry ``AGREE`` of the matched corners onto their partners.
4. ``graph.components`` unites verified pairs.
5. Pictures with a corner in a larger bucket are then compared with one another, every two that are
   not yet in one component, by what step 3 verifies; blocks of pictures meet in tasks of their own.
   Any two that larger buckets could have made a candidate are among them, so no bucket drops a pair.
   A picture is compared with ``ABREAST`` others at once, and a descriptor that several corners have
   only once. The work grows with the square of the number of such pictures.

Retrieval of the other pairs by tables is approximate; tests measure its recall against comparing all pairs.

Decoded formats: PGM and PPM (binary), PNG (8 bit, not interlaced), up to ``MOST_PIXELS`` by their
header. Defined results: null, empty, undecodable, oversized or truncated media, pictures without
extent, and images without corners, match nothing but equal files (null equals nothing); large
images are scaled down to ``LONGEST`` before corners are sought; repeated rows and equal ids each
keep their row; a null id matches nothing and its component is null; an empty table gives no row;
further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .graph import components

#: Corners of a tile of the finest scale (the next ones have half as many each), and the side of a tile.
SCALES, KEYPOINTS, TILE = (1.0, 1.5, 2.25), 16, 256
#: Radius of a descriptor's patch, directions told apart, longest side of an image that is searched.
RADIUS, DIRECTIONS, LONGEST = 8, 32, 512
VOTES, BITS, AGREE = 2, 40, 8
#: Corners of a bucket that is joined whole; neighbours voted with in a larger one.
SMALL, NEAR = 16, 3
#: MinHashes of a picture's keys; each bucket draws which of them sorts it. Steps of a pose: turns of
#: a circle, and parts of a picture's extent that a shift is told by.
SKETCH, TURNS, CELLS = 16, 4, 4
#: Orders of a bucket: the shared one breaks ties of the others.
ORDERS: tuple[Callable[[], Column], ...] = (
    lambda: F.xxhash64("id"),
    lambda: F.element_at("sketch", (F.pmod(F.hash("slot"), F.lit(SKETCH)) + 1).cast("int")),
)
#: Pictures of a block, in a table so large that ``FEWEST`` blocks do not do, and fewest pictures of a block; pictures that one picture is compared with at once.
BLOCK, FEWEST, CHUNK, ABREAST = 8192, 8, 64, 2048
#: Descriptors, the most frequent ones, whose nearest corners in a chunk are kept for all corners that have them.
SHARED = 16384
#: Pixels that a header may claim. What is decoded never takes more memory than that claim.
MOST_PIXELS = 1 << 26
#: Pictures described together; few enough for their arrays to stay in a processor's cache.
AT_ONCE = 16
#: Digests that a task remembers, so that copies of a file are described once by a task.
REMEMBERED = 100_000
FEATURES = "x array<float>, y array<float>, level array<int>, direction array<int>, bits binary, keys array<int>, places array<long>, sketch array<int>"


# --- pictures ---------------------------------------------------------------------------------------------------------


def decode(raw: bytes | None) -> np.ndarray | None:
    """Luminance as a float32 array; None if the bytes are no picture of a known format."""
    try:
        if raw and raw[:2] in (b"P5", b"P6"):
            return _netpbm(raw)
        if raw and raw[:8] == b"\x89PNG\r\n\x1a\n":
            return _png(raw)
    except (ValueError, IndexError, OverflowError, zlib.error):
        return None
    return None


def _checked(width: int, height: int) -> None:
    if width < 1 or height < 1 or width * height > MOST_PIXELS:
        raise ValueError("a picture without extent, or of more pixels than are read")


def _grey(pixels: np.ndarray) -> np.ndarray:
    if pixels.shape[2] < 3:
        return pixels[:, :, 0].astype(np.float32)
    return (pixels[:, :, :3] @ np.array([0.299, 0.587, 0.114])).astype(np.float32)


def _netpbm(raw: bytes) -> np.ndarray:
    at, numbers = 2, []
    while len(numbers) < 3:
        while raw[at : at + 1].isspace() or raw[at : at + 1] == b"#":
            at = raw.index(b"\n", at) + 1 if raw[at : at + 1] == b"#" else at + 1
        end = at
        while raw[end : end + 1].isdigit():
            end += 1
        numbers.append(int(raw[at:end]))
        at = end
    width, height, most = numbers
    depth = 3 if raw[:2] == b"P6" else 1
    if not 0 < most < 256:
        raise ValueError("only 8-bit pictures are read")
    _checked(width, height)
    return _grey(np.frombuffer(raw, np.uint8, width * height * depth, at + 1).reshape(height, width, depth))


def _png(raw: bytes) -> np.ndarray:
    at, data, head = 8, [], None
    while at < len(raw):
        size, kind = int.from_bytes(raw[at : at + 4], "big"), raw[at + 4 : at + 8]
        body = raw[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = body
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + size
    if head is None or head[8] != 8 or head[12] or head[9] not in (0, 2, 4, 6):
        raise ValueError("not an 8-bit picture without palette and interlace")
    width, height, depth = int.from_bytes(head[:4], "big"), int.from_bytes(head[4:8], "big"), {0: 1, 2: 3, 4: 2, 6: 4}[head[9]]
    _checked(width, height)
    size = height * (1 + width * depth)
    plain = zlib.decompressobj().decompress(b"".join(data), size)  # no more than the header claims
    lines = np.frombuffer(plain, np.uint8, size).reshape(height, 1 + width * depth)
    return _grey(_unfiltered(lines[:, 0], lines[:, 1:].reshape(height, width, depth)))


def _unfiltered(kinds: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Pixels of the rows of a PNG file, whose predictions by filter ``kinds`` are undone."""
    if kinds.max() > 4:
        raise ValueError("unknown filter")
    height, width, depth = values.shape
    out = np.zeros((height + 1, width + 1, depth), np.uint8)  # a row and a column of zeros come first
    own = out[1:, 1:]
    if kinds.max() <= 2:
        for k, kind in enumerate(kinds.tolist()):
            # Sums of bytes wrap around, as they must.
            own[k] = values[k] if not kind else np.cumsum(values[k], axis=0, dtype=np.uint8) if kind == 1 else values[k] + out[k, 1:]
        return own
    # Averages and Paeth's predictor need the pixel before: diagonals are worked out one by one, each at once.
    for d in range(height + width - 1):
        y = np.arange(max(0, d - width + 1), min(height, d + 1))
        x = d - y
        left, up, corner = (out[y + b, x + a].astype(np.int16) for b, a in ((1, 0), (0, 1), (0, 0)))
        near = np.abs(np.stack([up - corner, left - corner, left + up - 2 * corner]))
        paeth = np.where((near[0] <= near[1]) & (near[0] <= near[2]), left, np.where(near[1] <= near[2], up, corner))
        guess = np.choose(kinds[y][:, None], [np.zeros_like(left), left, up, (left + up) >> 1, paeth])
        out[y + 1, x + 1] = (values[y, x] + guess) & 255
    return own


def encode_pgm(picture: np.ndarray) -> bytes:
    grey = np.clip(np.rint(picture), 0, 255).astype(np.uint8)
    return b"P5\n%d %d\n255\n" % grey.shape[::-1] + grey.tobytes()


def render(values: np.ndarray, cell: int = 8) -> np.ndarray:
    """A vector as a square picture of cells, darkest for its smallest component."""
    side = int(np.ceil(np.sqrt(len(values))))
    low, high = values.min(), values.max()
    grid = np.zeros(side * side)
    grid[: len(values)] = (values - low) / ((high - low) or 1) * 255
    return np.kron(grid.reshape(side, side), np.ones((cell, cell)))


# --- descriptors ------------------------------------------------------------------------------------------------------


def resize(pictures: np.ndarray, factor: float) -> np.ndarray:
    """(n, h, w) scaled down by a factor, bilinearly."""
    if factor == 1:
        return pictures
    _, h, w = pictures.shape
    ys, xs = ((np.arange(max(1, int(n / factor))) + 0.5) * factor - 0.5 for n in (h, w))
    y, x = np.clip(ys, 0, h - 1), np.clip(xs, 0, w - 1)
    y0, x0 = y.astype(int), x.astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = (y - y0)[None, :, None].astype(np.float32), (x - x0)[None, None, :].astype(np.float32)
    rows = pictures[:, y0] * (1 - fy) + pictures[:, y1] * fy
    return rows[:, :, x0] * (1 - fx) + rows[:, :, x1] * fx


def box(p: np.ndarray, r: int) -> np.ndarray:
    """Mean over a square of side 2 r + 1, edges repeated."""
    for axis in (1, 2):
        pad = [(0, 0)] * 3
        pad[axis] = (r + 1, r)
        total = np.cumsum(np.pad(p, pad, mode="edge"), axis=axis, dtype=np.float64)
        n = p.shape[axis]
        p = (total.take(range(2 * r + 1, 2 * r + 1 + n), axis) - total.take(range(n), axis)) / (2 * r + 1)
    return p.astype(np.float32)


def harris(p: np.ndarray) -> np.ndarray:
    gy, gx = np.gradient(p, axis=(1, 2))
    xx, yy, xy = box(gx * gx, 2), box(gy * gy, 2), box(gx * gy, 2)
    return xx * yy - xy * xy - 0.05 * (xx + yy) ** 2


@lru_cache(maxsize=1)
def tests() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets (direction, test, end, yx) of the binary tests, turned; offsets of the disc and their weights."""
    rng = np.random.default_rng(7)
    points = np.clip(rng.normal(0, RADIUS / 2.2, (256, 2, 2)), -RADIUS / 1.5, RADIUS / 1.5)
    turned = []
    for k in range(DIRECTIONS):
        a = 2 * np.pi * k / DIRECTIONS
        turn = np.array([[np.cos(a), np.sin(a)], [-np.sin(a), np.cos(a)]])
        turned.append(np.rint(points @ turn.T))
    disc = np.array([(y, x) for y in range(-RADIUS + 1, RADIUS) for x in range(-RADIUS + 1, RADIUS) if y * y + x * x < RADIUS * RADIUS])
    return np.array(turned).astype(int), disc, disc.astype(np.float32)


def _best(score: np.ndarray, most: int, factor: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(picture, y, x) of the ``most`` best scores of each tile, so that large pictures have more corners."""
    _, h, w = score.shape
    rows, columns = (np.linspace(0, n, max(1, round(n * factor / TILE)) + 1).astype(int) for n in (h, w))
    for top, bottom in zip(rows, rows[1:], strict=False):
        for left, right in zip(columns, columns[1:], strict=False):
            tile = score[:, top:bottom, left:right].reshape(len(score), -1)
            k = min(most, tile.shape[1])
            best = np.argpartition(-tile, k - 1, axis=1)[:, :k]
            of, place = np.nonzero(np.take_along_axis(tile, best, 1) > 0)
            at = best[of, place]
            yield of, top + at // (right - left), left + at % (right - left)


def describe(pictures: np.ndarray) -> list[dict]:
    """Features of equally large pictures (n, h, w)."""
    n = len(pictures)
    found: list[list] = [[] for _ in range(n)]
    turned, disc, weight = tests()
    for level, factor in enumerate(SCALES):
        p = box(resize(pictures, factor), 1)
        _, h, w = p.shape
        if min(h, w) <= 2 * RADIUS + 2:
            continue
        response = harris(p)
        inner = response[:, RADIUS:-RADIUS, RADIUS:-RADIUS]
        peak = inner > 1e-3
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                if dy or dx:
                    other = response[:, RADIUS + dy : h - RADIUS + dy, RADIUS + dx : w - RADIUS + dx]
                    peak &= (inner > other) if (dy, dx) > (0, 0) else (inner >= other)
        of, y, x = (np.concatenate(c) for c in zip(*_best(np.where(peak, inner, 0), KEYPOINTS >> level, factor), strict=True))
        y, x = y + RADIUS, x + RADIUS
        flat, base = p.ravel(), ((of * h + y) * w + x).astype(np.int32)
        patch = flat.take(base[:, None] + (disc[:, 0] * w + disc[:, 1]).astype(np.int32))
        angle = np.arctan2(patch @ weight[:, 0], patch @ weight[:, 1])
        direction = np.rint(angle / (2 * np.pi) * DIRECTIONS).astype(int) % DIRECTIONS
        steps = (turned[..., 0] * w + turned[..., 1]).astype(np.int32)[direction] + base[:, None, None]
        bits = np.packbits(flat.take(steps[..., 0]) < flat.take(steps[..., 1]), axis=1)
        for k, i in enumerate(of.tolist()):
            found[i].append(((x[k] + 0.5) * factor, (y[k] + 0.5) * factor, level, int(direction[k]), bits[k]))
    return [
        {"x": [f[0] for f in own], "y": [f[1] for f in own], "level": [f[2] for f in own], "direction": [f[3] for f in own], "bits": b"".join(f[4].tobytes() for f in own)}
        for own in found
    ]


def agree(a: dict, b: dict) -> bool:
    """Whether one similarity transform carries enough matched corners of a onto corners of b."""
    left, right = (np.frombuffer(f["bits"], np.uint64).reshape(-1, 4) for f in (a, b))
    if not len(left) or not len(right):
        return False
    apart = np.bitwise_count(left[:, None] ^ right[None]).sum(axis=2, dtype=int)
    i, j = np.nonzero((apart <= BITS) & (apart == apart.min(axis=1, keepdims=True)))
    if len(i) < AGREE:
        return False
    p = np.asarray(a["x"], float)[i] + 1j * np.asarray(a["y"], float)[i]
    q = np.asarray(b["x"], float)[j] + 1j * np.asarray(b["y"], float)[j]
    size = 1.5 ** (np.asarray(b["level"])[j] - np.asarray(a["level"])[i])
    turn = (np.asarray(b["direction"])[j] - np.asarray(a["direction"])[i]) * (2 * np.pi / DIRECTIONS)
    # Hypotheses: each match alone says how far the picture is scaled, turned and moved; all are tried at once.
    by_match, steps = size * np.exp(1j * turn), p[None] - p[:, None]
    near = np.abs(by_match[:, None] * steps + q[:, None] - q[None]) < 3 + 0.1 * np.abs(steps)
    for k in np.flatnonzero(near.sum(axis=1) >= AGREE):
        fits = near[k]
        if len(set(i[fits].tolist())) < AGREE:
            continue
        # Least squares over the corners that agree, then a second count.
        pc, qc = p[fits].mean(), q[fits].mean()
        spread = (np.abs(p[fits] - pc) ** 2).sum()
        if spread < 1:
            continue
        m = (np.conj(p[fits] - pc) * (q[fits] - qc)).sum() / spread
        good = np.abs(m * (p - pc) + qc - q) < 2.5
        if 0.3 < abs(m) < 3.4 and len(set(i[good].tolist())) >= AGREE and len(set(j[good].tolist())) >= AGREE:
            return True
    return False


class Chunk:
    """Corners of up to ``ABREAST`` pictures side by side: corner after corner, each of all pictures.

    Asking pictures are compared with all of them at once, by operations on arrays that fit a processor's cache.
    """

    def __init__(self, held: list[tuple]):
        self.roots, self.ids = np.array([r for r, _, _ in held]), np.array([k for _, k, _ in held])
        self.known = [f for _, _, f in held]
        n = len(held)
        self.most = max(len(f["x"]) for f in self.known)  # below 254: a picture has LONGEST pixels a side at most
        self.words = np.zeros((4, self.most, n), dtype=np.uint64)
        self.absent = np.full((self.most, n), 255, dtype=np.uint8)
        # The row after the last corner stands for none: it lies far from everything.
        self.at = np.full((2, self.most + 1, n), 1e9, dtype=np.float32)
        self.turn = np.zeros((self.most + 1, n), dtype=np.intp)
        for k, f in enumerate(self.known):
            m = len(f["x"])
            self.words[:, :m, k], self.absent[:m, k] = f["words"], 0
            self.at[:, :m, k], self.turn[:m, k] = (f["x"], f["y"]), _turn(f)
        self._wide, self._count, self._apart = (np.empty((self.most, n), dtype=t) for t in (np.uint64, np.uint8, np.uint8))

    def nearest(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For descriptors (n, 4) and each picture the first and the last corner nearest to it.

        Both are ``most`` if none is near enough, and last is 255 if there are more than two.
        """
        first, last = (np.full((len(words), len(self.ids)), self.most, dtype=np.uint8) for _ in range(2))
        number = np.arange(self.most, dtype=np.uint8)[:, None]
        wide, count, apart = self._wide, self._count, self._apart
        for low, high, word in zip(first, last, words, strict=True):
            np.bitwise_count(np.bitwise_xor(self.words[0], word[0], out=wide), out=apart)
            for k in (1, 2, 3):
                np.bitwise_count(np.bitwise_xor(self.words[k], word[k], out=wide), out=count)
                np.add(apart, np.minimum(count, 63, out=count) if k == 3 else count, out=apart)  # a byte holds it
            np.maximum(apart, self.absent, out=apart)
            least = np.minimum.reduce(apart, axis=0)
            near = least <= BITS
            if not near.any():
                continue
            equal = np.equal(apart, least, out=count.view(bool)).view(np.uint8)
            several = np.add.reduce(equal, axis=0, dtype=np.uint8)
            np.subtract(equal, 1, out=apart)
            np.bitwise_or(apart, number, out=apart)
            np.copyto(low, np.minimum.reduce(apart, axis=0), where=near)
            np.copyto(high, low)
            tied = np.flatnonzero(near & (several > 1))
            if len(tied):
                high[tied] = np.where(several[tied] > 2, 255, (equal[:, tied] * number).max(axis=0))
        return first, last

    def may_agree(self, a: dict, first: np.ndarray, last: np.ndarray, open_: np.ndarray) -> np.ndarray:
        """Numbers of the open pictures with which ``a`` may agree: all for which ``agree`` is true, and few more.

        ``first`` and ``last`` hold what ``nearest`` says of each corner of ``a``. Each match is a
        hypothesis, which takes along the corners of ``a`` whose match lies where it says. Those with
        several nearest corners are taken along in any case, and at first also those that few pictures match.
        """
        matched = first < self.most
        at = np.flatnonzero((np.add.reduce(matched.view(np.uint8), axis=0, dtype=np.uint8) >= AGREE) & open_)
        if not len(at):
            return at
        first, last, matched = (c.take(at, axis=1) for c in (first, last, matched))
        place = first.astype(np.intp) * len(self.ids) + at
        q = self.at.reshape(2, -1).take(place, axis=1)
        turns = _turns().take(self.turn.ravel().take(place) + _turn(a)[:, None] * _CODES, axis=1)
        tied = first != last
        sure = np.add.reduce(tied.view(np.uint8), axis=0, dtype=np.uint8)
        o = np.where(tied, np.float32(1e9), q)
        often = np.count_nonzero(matched, axis=1) * 2 > len(at)
        rows = np.flatnonzero(often)
        free = sure + np.add.reduce((matched & ~tied & ~often[:, None]).view(np.uint8), axis=0, dtype=np.uint8)
        need = AGREE - np.minimum(free, AGREE)
        # Hypotheses: corner of a, number of the picture, corner of the picture. First those of corners that many match.
        mine, some = np.stack([a["x"], a["y"]]), o[:, rows]
        room = np.empty((2, *some.shape), dtype=np.float32)
        good = np.zeros_like(matched)
        for k in rows:
            good[k] = _taken((mine[:, rows] - mine[:, k, None])[:, :, None], turns[:, k], q[:, k], some, room) >= need
        k, b = np.nonzero(good & matched)
        found = [(k, b, first[k, b].astype(np.intp))]
        # The others one by one.
        k, b = np.nonzero(matched & ~often[:, None])
        listed = [(k, b, first[k, b].astype(np.intp))]
        k, b = np.nonzero(tied & (last < 255))
        listed.append((k, b, last[k, b].astype(np.intp)))
        k, b = np.nonzero(last == 255)
        if len(k):
            apart = np.bitwise_count(self.words[:, :, at[b]] ^ a["words"][:, None, k]).sum(axis=0, dtype=int) + self.absent[:, at[b]]
            j, e = np.nonzero(apart == apart.min(axis=0))
            listed.append((k[e], b[e], j))
        k, b, j = (np.concatenate(part) for part in zip(*listed, strict=True))
        if len(k):
            held = self._counted(a, rows, k, b, j, at, o) >= need[b]
            found.append((k[held], b[held], j[held]))
        k, b, j = (np.concatenate(part) for part in zip(*found, strict=True))
        if not len(k):
            return at[:0]
        held = self._counted(a, np.arange(len(first)), k, b, j, at, o) + sure[b] >= AGREE
        return at[np.unique(b[held])]

    def _counted(self, a: dict, rows: np.ndarray, k: np.ndarray, b: np.ndarray, j: np.ndarray, at: np.ndarray, o: np.ndarray) -> np.ndarray:
        """How many of the corners ``rows`` of a each hypothesis takes along."""
        place = j * len(self.ids) + at[b]
        turns = _turns().take(self.turn.ravel().take(place) + _turn(a)[k] * _CODES, axis=1)
        mine = np.stack([a["x"], a["y"]])
        theirs = o.reshape(2, -1).take(rows[:, None] * o.shape[2] + b, axis=1)
        return _taken(mine[:, rows, None] - mine[:, None, k], turns, self.at.reshape(2, -1).take(place, axis=1), theirs, np.empty((2, *theirs.shape), dtype=np.float32))


_CODES = len(SCALES) * DIRECTIONS


def _turn(f: dict) -> np.ndarray:
    return (f["level"] * DIRECTIONS + f["direction"]).astype(np.intp)


@lru_cache(maxsize=1)
def _turns() -> np.ndarray:
    """Scaled cosines, sines and negative sines that a match of levels and directions stands for: by ``_turn`` of both corners."""
    level, direction = np.divmod(np.arange(_CODES), DIRECTIONS)
    by = (1.5 ** (level[None] - level[:, None]) * np.exp(2j * np.pi / DIRECTIONS * (direction[None] - direction[:, None]))).ravel()
    return np.stack([by.real, by.imag, -by.imag]).astype(np.float32)


def _taken(steps: np.ndarray, turns: np.ndarray, q: np.ndarray, o: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Of each hypothesis, how many corners, ``steps`` (x and y) from its own, have their match ``o`` where it says, as seen from ``q``."""
    # Single precision: a margin far above its error keeps all that double precision would.
    most = (np.float32(3.05) + np.float32(0.1001) * np.sqrt(steps[0] ** 2 + steps[1] ** 2)) ** 2
    out, more = room
    np.multiply(turns[:2, None], steps[0], out=out)
    np.multiply(turns[[2, 0], None], steps[1], out=more)
    out += more
    out += q[:, None]
    out -= o
    out *= out
    out[0] += out[1]
    return np.add.reduce((out[0] < most).view(np.uint8), axis=0, dtype=np.uint8)


# --- tables -----------------------------------------------------------------------------------------------------------


def places(f: dict) -> np.ndarray:
    """Of each corner its number, level, direction, place and the picture's extent, in the bits of a long."""
    x, y = (np.rint(f[c]).astype(np.int64) for c in ("x", "y"))
    parts = (np.arange(len(x)), f["level"], f["direction"], x, y, np.full(len(x), max(x.max(), y.max())))
    out = np.zeros(len(x), dtype=np.int64)
    for part, width in zip(parts, (0, 2, 5, 10, 10, 10), strict=True):
        out = out << width | np.asarray(part, dtype=np.int64)
    return out


def sketch(keys: np.ndarray) -> np.ndarray:
    """``SKETCH`` MinHashes of a picture's keys and tables."""
    slots = (np.arange(len(keys)) % 8 << 32 | keys.astype(np.int64) & 0xFFFFFFFF).astype(np.uint64)
    odd = np.random.default_rng(11).integers(1 << 63, size=(SKETCH, 1), dtype=np.uint64) | np.uint64(1)
    return ((slots[None] * odd >> np.uint64(13)) * odd >> np.uint64(33)).min(axis=1).astype(np.int32)


def features(media: DataFrame) -> DataFrame:
    """id, digest and features of each medium: ``media`` has id and media (bytes).

    The digest is null without media or id. Features are null where there is no picture with corners,
    or where the task has described an equal file before.
    """
    kinds = [pa.list_(pa.float32()), pa.list_(pa.float32()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32())]
    names = [x.split()[0] for x in FEATURES.split(", ")]

    def described(raws: list[bytes | None]) -> list[dict | None]:
        out: list[dict | None] = [None] * len(raws)
        by_shape: dict[tuple, list] = {}
        for k, raw in enumerate(raws):
            picture = decode(raw)
            if picture is not None:
                factor = max(picture.shape) / LONGEST
                picture = resize(picture[None], factor)[0] if factor > 1 else picture
                by_shape.setdefault(picture.shape, []).append((k, picture))
        for own in by_shape.values():
            for (k, _), f in zip(own, describe(np.stack([p for _, p in own])), strict=True):
                if f["bits"]:
                    keys = np.frombuffer(f["bits"], ">i4")
                    out[k] = f | {"keys": keys.tolist(), "places": places(f).tolist(), "sketch": sketch(keys).tolist()}
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for whole in batches:
            for at in range(0, whole.num_rows, AT_ONCE):
                batch = whole.slice(at, AT_ONCE)
                digests, fresh = [], []
                for key, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    raw = raw.as_py()
                    digests.append(None if key is None or raw is None else hashlib.sha256(raw).digest())
                    fresh.append(raw if digests[-1] is not None and digests[-1] not in seen else None)
                    if digests[-1] is not None and len(seen) < REMEMBERED:
                        seen.add(digests[-1])
                rows = described(fresh)
                columns = [pa.array([r[c] if r else None for r in rows], t) for c, t in zip(names, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), *columns], ["id", "digest", *names])

    return media.select(F.col("id").cast("long"), "media").mapInArrow(run, f"id long, digest binary, {FEATURES}")


def _features_of(column: pa.StructArray) -> list[dict]:
    """The structs of a column, lists as views of its buffers."""
    fields = {column.type.field(k).name: part for k, part in enumerate(column.flatten())}
    bits = fields["bits"].to_pylist()
    held = {name: fields[name].values.to_numpy() for name in ("x", "y", "level", "direction")}
    at = {name: fields[name].offsets.to_numpy() for name in held}
    return [{name: held[name][at[name][k] : at[name][k + 1]] for name in held} | {"bits": bits[k]} for k in range(len(bits))]


def verified(pairs: DataFrame) -> DataFrame:
    """Pairs (u, v) whose features, in structs a and b, agree."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = pa.array([agree(x, y) for x, y in zip(_features_of(batch.column(2)), _features_of(batch.column(3)), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([c.filter(good) for c in batch.columns[:2]], ["u", "v"])

    return pairs.select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def candidates(pictures: DataFrame, *orders: Callable[[], Column]) -> DataFrame:
    """Pairs (u, v), u > v, with ``VOTES`` corners that vote for one pose.

    ``pictures`` has id and keys, and for the orders but the first sketch. Without places every key
    counts as a corner of its own, and all votes are for one pose.
    """
    carried = [c for c in ("places", "sketch") if c in pictures.columns]
    keyed = _keyed(pictures, *carried)
    place = F.element_at("places", F.shiftright("at", 3) + 1) if "places" in carried else F.shiftleft(F.col("at").cast("long"), 37)
    ranks = orders[1]().cast("int") if len(orders) > 1 else F.lit(0)
    entries = keyed.select("slot", "id", ranks.alias("rank"), place.alias("place"))
    buckets = entries.groupBy("slot").agg(F.count("*").cast("int").alias("n"))
    # Joined by shuffle at every size, so that a bucket's rows are together.
    met = lambda which: entries.join(buckets.where(which).select(F.col("slot").alias("k")).hint("shuffle_hash"), F.col("slot") == F.col("k")).drop("k")
    own = met(f"n between 2 and {SMALL}").groupBy("slot").agg(F.array_sort(F.collect_list(F.struct("id", "place"))).alias("e"))
    every = F.flatten(F.transform("e", lambda a, i: F.transform(F.slice("e", 1, i), lambda b: F.struct(a["id"].alias("u"), a["place"].alias("p"), b["id"].alias("v"), b["place"].alias("q")))))
    pairs = own.select(F.inline(every)).where("u != v")
    large = met(f"n > {SMALL}").sortWithinPartitions("slot", "rank", orders[0](), "place")
    pairs = pairs.union(large.mapInArrow(_neighbours, "u long, p long, v long, q long"))
    pose, corner = _pose(F.col("p"), F.col("q")), F.call_function("shiftleft", F.lit(1).cast("long"), (F.shiftright("p", 37) % 63).cast("int"))
    voted = pairs.groupBy("u", "v", pose.alias("pose")).agg(F.bit_or(corner).alias("corners"))
    return voted.where(F.bit_count("corners") >= VOTES).select("u", "v").distinct()


def _keyed(pictures: DataFrame, *carried: str) -> DataFrame:
    """One row for each key, with the bucket that it falls in: a table's number and the key."""
    slot = F.shiftleft((F.col("at") % 8).cast("long"), 32) + F.col("key")
    return pictures.select("id", *carried, F.posexplode("keys").alias("at", "key")).withColumn("slot", slot)


def crowded(pictures: DataFrame) -> DataFrame:
    """Distinct ids of pictures with a corner in a bucket of more than ``SMALL``; ``pictures`` has id and keys."""
    entries = _keyed(pictures).select("id", "slot")
    large = entries.groupBy("slot").agg(F.count("*").alias("n")).where(f"n > {SMALL}").select(F.col("slot").alias("k"))
    return entries.join(large, F.col("slot") == F.col("k"), "left_semi").select("id").distinct()


def compared(found: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs (u, v), u > v, of ``members`` (id, root) that agree, of every two with different roots; ``found`` has id and features.

    Members are cut by their ids into blocks of about equal size; every two blocks meet in a task,
    which holds the smaller ids and reads the others one after the other.
    """
    n = members.count()
    blocks = max(-(-n // BLOCK), min(FEWEST, -(-n // CHUNK)), 1)
    cuts = members.agg(F.percentile_approx("id", [k / blocks for k in range(1, blocks)])).first()[0] if blocks > 1 else []
    block = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda cut: cut < F.col("id"))) if cuts else F.lit(0)
    task = lambda low, high: (high * (high + 1) / 2 + low).cast("int")
    roles = F.concat(
        F.transform(F.sequence("block", F.lit(blocks - 1)), lambda b: F.struct(task(F.col("block"), b).alias("task"), F.lit(False).alias("asks"))),
        F.transform(F.sequence(F.lit(0), "block"), lambda b: F.struct(task(b, F.col("block")).alias("task"), F.lit(True).alias("asks"))),
    )
    rows = members.join(found.select("id", F.struct("x", "y", "level", "direction", "bits").alias("f")), "id").withColumn("block", block)
    dealt = rows.select(F.inline(roles), "root", "id", "f").repartitionById(blocks * (blocks + 1) // 2, F.col("task"))
    # Equal roots stand together, so that copies are passed over by chunks.
    return dealt.sortWithinPartitions("task", "asks", "root", "id").mapInArrow(_agreeing, "u long, v long")


def _agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs that agree, of rows (task, asks, root, id, f): those of a task that ask come after those that are asked about."""
    now, held, chunks = None, [], []
    for batch in batches:
        pairs, asking = [], []
        tasks, asks, roots, ids = (batch.column(k).to_pylist() for k in range(4))
        for of, asks_, root, own, f in zip(tasks, asks, roots, ids, _features_of(batch.column(4)), strict=True):
            if of != now:
                pairs += _met(asking, chunks)
                now, held, chunks, asking = of, [], [], []
            f = {name: np.array(f[name]) for name in ("x", "y", "level", "direction")} | {"bits": f["bits"]}
            f["words"] = np.frombuffer(f["bits"], np.uint64).reshape(-1, 4).T
            if asks_:
                if held:
                    chunks.append(Chunk(held))
                    held = []
                asking.append((root, own, f))
                continue
            held.append((root, own, f))
            if len(held) == ABREAST:
                chunks.append(Chunk(held))
                held = []
        pairs += _met(asking, chunks)
        yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["u", "v"])


def _met(asking: list[tuple], chunks: list[Chunk]) -> list[tuple[int, int]]:
    """Pairs (id that asks, smaller id of another root) that agree."""
    if not asking or not chunks:
        return []
    # Descriptors that several of the corners have are looked up once for each chunk.
    words = np.ascontiguousarray(np.concatenate([f["words"] for _, _, f in asking], axis=1).T)
    _, one, of, times = np.unique(words.view("V32").ravel(), return_index=True, return_inverse=True, return_counts=True)
    often = np.argsort(-times, kind="stable")[:SHARED]
    often = often[times[often] > 1]
    place = np.full(len(times), -1)
    place[often] = np.arange(len(often))
    place, shared = place[of], words[one[often]]
    ends = np.cumsum([len(f["x"]) for _, _, f in asking])
    pairs = []
    for chunk in chunks:
        known = None
        for (root, own, f), end in zip(asking, ends, strict=True):
            open_ = (chunk.roots != root) & (chunk.ids < own)
            if not open_.any():
                continue
            known = chunk.nearest(shared) if known is None else known
            at = place[end - len(f["x"]) : end]
            first, last = (np.empty((len(at), len(chunk.ids)), dtype=np.uint8) for _ in range(2))
            for out, held, new in zip((first, last), known, chunk.nearest(f["words"].T[at < 0]), strict=True):
                out[at >= 0], out[at < 0] = held[at[at >= 0]], new
            pairs += [(own, int(chunk.ids[b])) for b in chunk.may_agree(f, first, last, open_) if agree(f, chunk.known[b])]
    return pairs


def _pose(p: Column, q: Column) -> Column:
    """Turn, scale and shift that carry a corner in place p onto one in place q, as the number of a step of each."""
    part = lambda c, at, width: F.shiftright(c, at).bitwiseAND((1 << width) - 1)
    level, turn = part(q, 35, 2) - part(p, 35, 2), F.pmod(part(q, 30, 5) - part(p, 30, 5), F.lit(DIRECTIONS))
    angle, size = turn * (2 * np.pi / DIRECTIONS), F.pow(F.lit(1.5), level)
    x, y = part(p, 20, 10), part(p, 10, 10)
    right = part(q, 20, 10) - size * (F.cos(angle) * x - F.sin(angle) * y)
    down = part(q, 10, 10) - size * (F.sin(angle) * x + F.cos(angle) * y)
    cell = F.greatest(part(q, 0, 10), F.lit(CELLS)) / CELLS
    step = DIRECTIONS // TURNS
    parts = (F.floor(F.pmod(turn + step // 2, F.lit(DIRECTIONS)) / step), level, F.round(right / cell), F.round(down / cell))
    return F.hash(*(c.cast("int") for c in parts))


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Corners (u, p) and (v, q), u > v, up to ``NEAR`` rows apart, of equal slot and rank; rows (slot, id, rank, place) come sorted."""
    last = np.zeros((4, 0), dtype=np.int64)
    for batch in batches:
        rows = np.concatenate([last, np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])], axis=1)
        known, slot, own, rank = last.shape[1], rows[0], rows[1], rows[2]
        firsts, seconds = [], []
        for step in range(1, NEAR + 1):
            later = np.arange(max(known, step), rows.shape[1])
            before = later - step
            met = (slot[later] == slot[before]) & (rank[later] == rank[before]) & (own[later] != own[before])
            firsts.append(later[met])
            seconds.append(before[met])
        a, b = np.concatenate(firsts), np.concatenate(seconds)
        up = own[a] > own[b]
        u, v = rows[:, np.where(up, a, b)], rows[:, np.where(up, b, a)]
        yield pa.RecordBatch.from_arrays([pa.array(u[1]), pa.array(u[3]), pa.array(v[1]), pa.array(v[3])], ["u", "p", "v", "q"])
        last = rows[:, -NEAR:]


def copies(media: DataFrame, id_col: str = "media_id", media_col: str = "media") -> DataFrame:
    """One row per medium: media_id, component_id (smallest id of its copies), kept."""
    scratch = Scratch(media.sparkSession, "media")
    names = [x.split()[0] for x in FEATURES.split(", ")]
    keyed = scratch.keep(features(media.select(F.col(id_col).cast("long").alias("id"), F.col(media_col).alias("media"))))
    feature = F.first(F.when(F.col("bits").isNotNull(), F.struct(*names)), ignorenulls=True)
    classes = scratch.keep(keyed.where("digest is not null").groupBy("digest").agg(F.min("id").alias("id"), feature.alias("f")))
    rows = scratch.keep(keyed.select("id", "digest"))
    scratch.drop(keyed)
    found = classes.where("f is not null").select("id", "f.*")
    own = lambda name: found.select(F.col("id").alias(f"{name}_id"), F.struct("x", "y", "level", "direction", "bits").alias(name))
    pairs = scratch.keep(candidates(found.select("id", "keys", "places", "sketch"), *ORDERS))
    both = pairs.join(own("a"), F.col("u") == F.col("a_id")).join(own("b"), F.col("v") == F.col("b_id"))
    links = scratch.keep(verified(both))
    scratch.drop(pairs)
    firsts = components(links, scratch)
    crowd = crowded(found.select("id", "keys"))
    members = scratch.keep(crowd.join(firsts, F.col("id") == F.col("node"), "left").select("id", F.coalesce("root", "id").alias("root")))
    every = scratch.keep(links.union(compared(found, members)))
    scratch.drop(members)
    roots = components(every, scratch)
    named = scratch.keep(classes.join(roots, F.col("id") == F.col("node"), "left").select(F.col("digest").alias("d"), F.coalesce("root", "id").alias("c")))
    scratch.drop(links, every, classes)
    joined = rows.join(named, F.col("digest") == F.col("d"), "left")
    component = F.coalesce("c", "id")
    return joined.select(F.col("id").alias("media_id"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def rendered(vectors: DataFrame) -> DataFrame:
    """media_id and media: each vector as a PGM file; null where the vector is null, empty or not finite."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for v in batch.column(1).to_pylist():
                values = np.array(v, dtype=float) if v and None not in v else None
                out.append(encode_pgm(render(values)) if values is not None and np.isfinite(values).all() else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["media_id", "media"])

    return vectors.select(F.col("vec_id").cast("long").alias("media_id"), F.col("embedding").cast("array<double>").alias("e")).mapInArrow(run, "media_id long, media binary")
