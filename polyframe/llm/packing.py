"""Packing token sequences of documents into fixed windows by non-negative least squares.

Each Spark partition is packed by itself in shards of a bounded number of tokens, so nothing is
shuffled and nothing grows with the input. In a shard:

1. whole windows are cut off long documents, which leaves each document a rest shorter than one;
2. rests are counted in length classes (the histogram);
3. shallow combinations - up to ``DEPTH`` different classes that fill a window, one of the short
   ones as often as fits - are enumerated, and non-negative least squares over tokens finds how
   often each must repeat to use up the histogram;
4. repeats are rounded down, windows are built from them, and what is left of the histogram is
   solved again, up to ``ROUNDS`` times;
5. what is left is packed greedily: residual documents are cut into the gaps of those windows, then
   into further windows.

Only the last window of a shard can be short. It is cut into power-of-two sequences, which need
no padding.

Defined results: a null or empty text is one document of the end token alone; texts of any length
are packed whole; repeated rows are packed as often as they stand; the order of ties is that of the
rows of the partition; an empty table gives no row; columns other than the id and the text are
ignored, whatever their names. A null id stays null.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations_with_replacement
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenizers import Tokenizer

from .bpe import BLOCK_CHARS, SPACE, Cache, byte_symbols, latin, pieces

WINDOW = 4096
CLASSES = 64
DEPTH, ROUNDS = 3, 4
#: A shard closes once it holds so many tokens (16 MB of ids). A long document can pass it by its own length.
SHARD_TOKENS = 4 << 20
#: Sequence ids hold the partition in their upper bits.
PARTITION_SHIFT = 40
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long, padded_length long"

#: (document of the shard, first token, tokens)
Piece = tuple[int, int, int]


class LibraryCodec:
    """Ids of whole texts by the ``tokenizers`` library, which sees each distinct piece between white space once.

    No token crosses white space, so ids of pieces, kept by piece, make up those of a text. A word of
    lower-case Latin letters is one unit to the library's splitter, so it goes straight to its model.
    """

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.symbols = byte_symbols()
        self.specials = [t.content.lower() for t in self.library.get_added_tokens_decoder().values()]
        self.known = Cache(self._ids)

    def _ids(self, piece: str) -> bytes:
        if piece.isalpha() and (piece.isascii() or latin(piece)) and piece.islower():
            word = piece if piece.isascii() else "".join([self.symbols[b] for b in piece.encode()])
            ids = [t.id for t in self.library.model.tokenize(word)]
        else:
            ids = self.library.encode(piece, add_special_tokens=False).ids
        return pack(f"<{len(ids)}I", *ids)

    def encode_bytes(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; special strings in a text give their special ids."""
        out, at, text = [], 0, text or ""
        while at < len(text):
            end = len(text)
            if end - at > BLOCK_CHARS:
                cut = SPACE.search(text, at + BLOCK_CHARS)
                end = cut.start() if cut else end
            block = text[at:end]
            # Special strings must stand as they are; other characters than these the library lowers itself.
            if latin(block) and not any(s in (low := block.lower()) for s in self.specials):
                block = low
            out.append(b"".join(map(self.known.__getitem__, pieces(block))))
            at = end
        return b"".join(out)


_codecs: dict[str, LibraryCodec] = {}


def codec(path: str) -> LibraryCodec:
    """The codec of a vocabulary file, made once in each Python worker."""
    if path not in _codecs:
        _codecs[path] = LibraryCodec(path)
    return _codecs[path]


@lru_cache(maxsize=4)
def fills(classes: int, depth: int) -> np.ndarray:
    """Combinations of length classes 1..classes that sum to ``classes``, as columns of counts.

    Those of 1 to ``depth`` documents, and those of one document of any class or none, as many of a
    short class (up to classes / depth) as fit, and one that fills the rest.
    """
    found: set[tuple[int, ...]] = set()
    for n in range(1, depth + 1):
        for parts in combinations_with_replacement(range(1, classes + 1), n - 1):
            rest = classes - sum(parts)
            if rest >= (parts[-1] if parts else 1):
                found.add((*parts, rest))
    for long in range(classes):
        for short in range(1, classes // depth + 1):
            times, rest = divmod(classes - long, short)
            found.add(tuple(sorted([*[x for x in (long, rest) if x], *[short] * times])))
    columns = sorted(tuple(np.bincount(parts, minlength=classes + 1)[1:].tolist()) for parts in found)
    return np.array(columns, dtype=float).T


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 60) -> np.ndarray:
    """x >= 0 that minimises ``|a x - b|``, by cyclic coordinate descent on the normal equations."""
    gram, x = a.T @ a, np.zeros(a.shape[1])
    slope = -(a.T @ b)  # gradient at x
    size = np.diag(gram)
    goal = 1e-3 * max(1.0, float(np.abs(b).max(initial=0)))
    for _ in range(rounds):
        moved = 0.0
        for j in range(len(x)):
            step = max(-x[j], -slope[j] / size[j])
            if step:
                x[j] += step
                slope += step * gram[j]
                moved = max(moved, abs(step))
        if moved < goal:
            break
    return x


def combined(pools: list[list[Piece]], depth: int = DEPTH) -> list[list[Piece]]:
    """Windows built from combinations; their documents are taken from the pools of the classes."""
    classes = len(pools)
    ways, tokens = fills(classes, depth), np.arange(1, classes + 1)[:, None]
    built: list[list[Piece]] = []
    for _ in range(ROUNDS):
        count = np.array([len(p) for p in pools], dtype=float)
        repeats = np.floor(nnls(ways * tokens, count * tokens[:, 0]) + 1e-9).astype(int)
        before = len(built)
        for way in np.argsort(-repeats, kind="stable"):
            if not repeats[way]:
                break
            need = ways[:, way].astype(int)
            kinds = np.flatnonzero(need).tolist()
            # Rounding may have let an earlier combination take some of these.
            for _ in range(min(int(repeats[way]), *(len(pools[k]) // int(need[k]) for k in kinds))):
                built.append([pools[k].pop() for k in kinds for _ in range(need[k])])
        if len(built) == before:
            break
    return built


def plan(lengths: list[int], window: int = WINDOW, classes: int = CLASSES, depth: int = DEPTH) -> list[list[Piece]]:
    """Sequences, as lists of pieces, that hold each token of documents of these lengths once."""
    out: list[list[Piece]] = []
    rests: list[Piece] = []
    for doc, n in enumerate(lengths):
        whole = n - n % window
        out += [[(doc, at, window)] for at in range(0, whole, window)]
        if n > whole:
            rests.append((doc, whole, n - whole))
    width = -(-window // classes)
    pools: list[list[Piece]] = [[] for _ in range(classes)]
    for rest in rests:
        pools[-(-rest[2] // width) - 1].append(rest)
    built = combined(pools, depth)
    left = deque(sorted((r for p in pools for r in p), key=lambda r: -r[2]))
    closed: list[list[Piece]] = []
    at = 0
    while at < len(built):
        sequence = built[at]
        gap = window - sum(p[2] for p in sequence)
        while gap:
            if not left:
                if at == len(built) - 1:
                    break
                left.extend(built.pop())  # no residue is left: the last window is taken apart
            doc, start, n = left.popleft()
            taken = min(n, gap)
            sequence.append((doc, start, taken))
            if n > taken:
                left.appendleft((doc, start + taken, n - taken))
            gap -= taken
        if gap:
            left.extendleft(reversed(sequence))
            break
        closed.append(sequence)
        at += 1
    out += closed
    total = sum(p[2] for p in left)
    sizes = [window] * (total // window) + [1 << b for b in range(window.bit_length() - 1, -1, -1) if total % window >> b & 1]
    for size in sizes:
        sequence, gap = [], size
        while gap:
            doc, start, n = left.popleft()
            taken = min(n, gap)
            sequence.append((doc, start, taken))
            if n > taken:
                left.appendleft((doc, start + taken, n - taken))
            gap -= taken
        out.append(sequence)
    return out


def pack_documents(docs: DataFrame, path: str, end_id: int = 2, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of a document; ``ids`` of each piece stay with it as bytes (little-endian unsigned 32 bit)."""
    return _packed(docs, path, end_id, window, id_col, text_col, with_ids=True)


def pack_digests(docs: DataFrame, path: str, end_id: int = 2, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``pack_documents``, with the CRC-32 of a piece's ids instead of the ids."""
    return _packed(docs, path, end_id, window, id_col, text_col, with_ids=False)


def _packed(docs: DataFrame, path: str, end_id: int, window: int, id_col: str, text_col: str, with_ids: bool) -> DataFrame:
    end = end_id.to_bytes(4, "little")
    names = [f.split()[0] for f in SCHEMA.split(", ")] + ["ids"] * with_ids

    def rows(keys: list, ids: list[bytes], first: int) -> tuple[pa.RecordBatch, int]:
        lengths = [len(x) // 4 for x in ids]
        columns: list[list] = [[] for _ in names]
        sequences = plan(lengths, window)
        for number, sequence in enumerate(sequences, first):
            offset, size = 0, sum(p[2] for p in sequence)
            padded = size if size & (size - 1) == 0 else window
            for doc, start, n in sequence:
                raw = ids[doc][4 * start : 4 * (start + n)]
                for column, value in zip(columns, (keys[doc], start, n, zlib.crc32(raw), lengths[doc], number, offset, size, padded, *[raw] * with_ids), strict=True):
                    column.append(value)
                offset += n
        kinds = [pa.int64()] * 9 + [pa.binary()] * with_ids
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names), first + len(sequences)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, keys, ids, held = codec(path), [], [], 0
        number = TaskContext.get().partitionId() << PARTITION_SHIFT
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                keys.append(key)
                ids.append(c.encode_bytes(text.as_py()) + end)
                held += len(ids[-1]) // 4
                if held >= SHARD_TOKENS:
                    made, number = rows(keys, ids, number)
                    yield made
                    keys, ids, held = [], [], 0
        if keys:
            yield rows(keys, ids, number)[0]

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA + ", ids binary" * with_ids)
