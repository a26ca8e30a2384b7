"""BPE encoding and decoding with a merge-rank priority queue over a doubly linked symbol list.

The vocabulary file (path is a parameter) is in the format of the ``tokenizers`` library: NFC and
lower-casing, a splitting pattern, byte-level symbols with an end-of-word suffix, ranked merges.
Encoding gives the ids that the library gives with ``add_special_tokens=False``; decoding
concatenates vocabulary strings as the library's ``decode`` does for files without a decoder, with
one space between tokens.

Defined results: a null text counts as empty (0 tokens, empty ids, empty decoded text); texts of
any length are processed whole, in blocks that end before white space, so memory stays bounded;
repeated rows, ties and empty tables need no rule, as each row is encoded by itself; columns other
than the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush
from itertools import chain
from struct import pack

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex
from tokenizers.normalizers import NFC, Lowercase, Sequence
from tokenizers.pre_tokenizers import Split

#: Characters of text handled at once. Blocks end before white space, which no token crosses.
BLOCK_CHARS = 1 << 20
#: Keys that one cache of a Python worker keeps and their characters in all; it starts anew when either is
#: full. Longer keys than CACHE_CHARS (unspaced scripts, encoded data) hardly recur and are not kept.
CACHE_WORDS, CACHE_TOTAL, CACHE_CHARS = 1_000_000, 1 << 24, 64


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Cache(dict):
    """What ``make`` gives for a key, kept for keys of up to ``longest`` characters.

    It starts anew when it holds ``most`` keys, or keys of ``total`` characters in all.
    """

    def __init__(self, make: Callable, most: int = CACHE_WORDS, longest: int = CACHE_CHARS, total: int = CACHE_TOTAL):
        super().__init__()
        self.make, self.most, self.longest, self.total, self.held = make, most, longest, total, 0

    def __missing__(self, key: str):
        out = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.most or self.held > self.total:
                self.clear()
                self.held = 0
            self[key] = out
            self.held += len(key)
        return out


class Codec:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.ranks = {self.vocab[a] << 32 | self.vocab[b]: rank for rank, (a, b) in enumerate(merges)}
        self.made = [self.vocab[a + b] for a, b in merges]
        self.specials: dict[str, int] = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.specials.items()}
        splitter = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        pattern = splitter["pattern"]["Regex"]
        self.words = regex.compile(pattern, regex.V0).findall
        self.pattern = pattern
        self.newer = Cache(self._is_newer)
        # Characters that tables of other versions may case, order or compose otherwise.
        self.versioned = Cache(lambda char: unicodedata.category(char) == "Cn" or unicodedata.combining(char) > 0)
        self.special = re.compile("(" + "|".join(map(re.escape, self.specials)) + ")")
        # Ids of a byte within and at the end of a word.
        self.first = [self.vocab.get(s) for s in byte_symbols()]
        self.final = [self.vocab.get(s + self.suffix) for s in byte_symbols()]
        self.word_ids = Cache(self.merge)
        self.cache = Cache(self._code)
        self.special_codes = {s: (i.to_bytes(4, "little"), s) for s, i in self.specials.items()}

    def merge(self, word: str) -> list[int]:
        """Ids of one pre-split word.

        Symbols form a doubly linked list; the queue holds rank and place of each adjacent pair that
        can merge, as one integer. An entry is stale if its pair has changed meanwhile or its place is gone.
        """
        raw = word.encode("utf-8", "surrogatepass")
        ids = [self.first[b] for b in raw[:-1]]
        ids.append(self.final[raw[-1]])
        if None in ids:
            ids = [i for i in ids if i is not None]
        last = len(ids) - 1
        rank_of, made = self.ranks.get, self.made
        queue = [found << 32 | at for at in range(last) if (found := rank_of(ids[at] << 32 | ids[at + 1])) is not None]
        if not queue:
            return ids
        before, after = list(range(-1, last)), list(range(1, last + 2))
        heapify(queue)
        while queue:
            entry = heappop(queue)
            at = entry & 0xFFFFFFFF
            right = after[at]
            if right > last or ids[at] < 0 or rank_of(ids[at] << 32 | ids[right]) != entry >> 32:
                continue  # stale
            ids[at] = joined = made[entry >> 32]
            ids[right] = -1
            after[at] = beyond = after[right]
            if beyond <= last:
                before[beyond] = at
                if (found := rank_of(joined << 32 | ids[beyond])) is not None:
                    heappush(queue, found << 32 | at)
            if (left := before[at]) >= 0 and (found := rank_of(ids[left] << 32 | joined)) is not None:
                heappush(queue, found << 32 | left)
        return [i for i in ids if i >= 0]

    def _is_newer(self, char: str) -> bool:
        """Whether our tables call a letter or number what the library's older tables do not know."""
        return unicodedata.category(char) == "Cn" and bool(LETTER.match(char)) and bool(LIBRARY_LETTER.pre_tokenize_str(char))

    def _older(self, newer: str) -> Callable[[str], list[str]]:
        """The splitter for a block with such characters: they count as neither letter nor number."""
        made = regex.sub(r"\[(\\p\{[LN]\})\]", lambda m: f"(?:(?![{newer}]){m[1]})", self.pattern)
        return regex.compile(made.replace(r"[^\s\p{L}\p{N}]", rf"(?:[{newer}]|[^\s\p{{L}}\p{{N}}])"), regex.V0).findall

    def _code(self, chunk: str, split: Callable[[str], list[str]] | None = None) -> tuple[bytes, str]:
        """Code of what stands between white space: its ids as bytes, its vocabulary strings joined by a space."""
        if split is None and chunk.isalpha():
            ids = self.merge(chunk)
        elif split is None and chunk[-1:] in (".", ",") and chunk[:-1].isalpha():
            ids = [*self.word_ids[chunk[:-1]], *self.word_ids[chunk[-1]]]
        else:
            ids = list(chain.from_iterable(map(self.word_ids.__getitem__, (split or self.words)(chunk))))
        return pack(f"<{len(ids)}I", *ids), " ".join([self.strings[i] for i in ids])

    def _codes(self, block: str) -> list[tuple[bytes, str]]:
        if not latin(block) and any(map(self.versioned.__getitem__, set(block))):
            low = LIBRARY_LOWER.normalize_str(block)
            if newer := "".join(c for c in set(low) if self.newer[c]):
                split = self._older(newer)
                return [self._code(chunk, split) for chunk in UNICODE_SPACE.split(low)]
        else:
            block = unicodedata.normalize("NFC", block)
            # Lower-casing is character by character: no rule for a sigma that ends a word.
            low = block.lower() if "Σ" not in block else "".join(map(str.lower, block))
        return list(map(self.cache.__getitem__, pieces(low)))

    def blocks(self, text: str | None) -> Iterator[list[tuple[bytes, str]]]:
        """Codes of the whole text, block by block."""
        for piece in self.special.split(text or ""):
            if piece in self.special_codes:
                yield [self.special_codes[piece]]
                continue
            at = 0
            while at < len(piece):
                end = len(piece)
                if end - at > BLOCK_CHARS:
                    cut = SPACE.search(piece, at + BLOCK_CHARS)
                    end = cut.start() if cut else end
                yield self._codes(piece[at:end])
                at = end

    def encode_bytes(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(code[0] for block in self.blocks(text) for code in block)

    def encode(self, text: str | None) -> list[int]:
        raw = self.encode_bytes(text)
        return [int.from_bytes(raw[k : k + 4], "little") for k in range(0, len(raw), 4)]

    def decode(self, ids: list[int]) -> str:
        return " ".join(map(self.strings.__getitem__, ids))


#: White space before which a text may be cut. A cut needs the ASCII kinds only.
SPACE = re.compile(r"[ \n\r\t]")
LETTER = regex.compile(r"[\p{L}\p{N}]")
LIBRARY_LOWER = Sequence([NFC(), Lowercase()])
LIBRARY_LETTER = Split(Regex(r"[\p{L}\p{N}]"), "removed")
PYTHON_SPACE = re.compile("[\x1c-\x1f]")
UNICODE_SPACE = re.compile("[ \t-\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
#: A full stop or comma before white space that may be part of a longer run of signs: before it stands
#: anything but a Latin letter or digit. U+0130 is none here, as its lower case ends in a combining mark.
UNSURE = re.compile("(?<![A-Za-z0-9\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u017f])[.,][ \n]")


def latin(text: str) -> bool:
    """Whether all characters are among the first 256, where tables of all versions agree."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def pieces(block: str) -> list[str]:
    """Parts of a block that no token crosses, in order: what stands between white space.

    Where every full stop and comma before white space follows a Latin letter or digit, they are
    parts of their own, so that far fewer distinct parts occur.
    """
    if not UNSURE.search(block):
        for sign in (". ", ", ", ".\n", ",\n"):
            block = block.replace(sign, f" {sign}")
    # The separators U+001C to U+001F are white space to Python only.
    return block.split() if not PYTHON_SPACE.search(block) else UNICODE_SPACE.split(block)


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The codec of a vocabulary file, made once in each Python worker."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


#: Tokens after which a batch of encoded documents is handed on.
BATCH_TOKENS = 1 << 18
DIGEST_SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ids as an array, decoded text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)

        def made(keys: pa.Array, ids: list[list[int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([keys, pa.array(ids, pa.list_(pa.int32())), pa.array(map(c.decode, ids), pa.string())], ["id", "ids", "decoded"])

        for batch in batches:
            first, ids, held = 0, [], 0
            for at, text in enumerate(batch.column(1)):
                ids.append(c.encode(text.as_py()))
                held += len(ids[-1])
                if held >= BATCH_TOKENS:
                    yield made(batch.column(0)[first : at + 1], ids)
                    first, ids, held = at + 1, [], 0
            if ids:
                yield made(batch.column(0)[first:], ids)

    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(run, f"id {chosen.schema['id'].dataType.simpleString()}, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: number of tokens, SHA-256 of its ids and of its decoded text.

    Blocks are hashed as they are made; neither ids nor decoded text of a document is held whole.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            out: list[tuple[int, str, str]] = []
            for text in batch.column(1):
                n, ids, decoded, glue = 0, hashlib.sha256(), hashlib.sha256(), b""
                for codes in c.blocks(text.as_py()):
                    if raw := b"".join([x[0] for x in codes]):
                        n += len(raw) // 4
                        ids.update(raw)
                        decoded.update(glue + " ".join([x[1] for x in codes if x[0]]).encode())
                        glue = b" "
                out.append((n, ids.hexdigest(), decoded.hexdigest()))
            n, a, b = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, DIGEST_SCHEMA)
