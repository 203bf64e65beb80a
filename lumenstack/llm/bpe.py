"""Byte pair encoding and decoding with the vocabulary and merges of a tokenizer file.

Each word is a short contiguous array of parts and of the ranks of adjacent pairs. The smallest rank is
found by a scan, its boundary is deleted, and the two neighbouring ranks are looked up again. A batch's new
words of like length are rows of one matrix and go through these steps together. Words of over LONG_WORD
parts, for which repeated scans would be quadratic, keep the ranks in a heap; the merges are the same. The
ids of words and of whole chunks between spaces are kept in dictionaries of bounded size in each worker.

Nulls: a null text has no ids (an empty array) and null ids decode to "". Texts of any length are
handled whole. Pairs of equal rank merge from left to right, as their order in the text is. Repeated rows are
encoded alike, an empty table gives no rows, and rows, their order and other columns are left alone.
"""

from __future__ import annotations

import functools
import heapq
import itertools
import json
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenstack.llm.common import in_slices

LONG_WORD = 256
NONE = 1 << 62
#: A space between other white space, which words may reach over.
LONE_SPACE = regex.compile(r"\s \s")


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class PairRanks:
    """An open-addressed table from a pair of ids to rank << 20 | merged id, for arrays and for single pairs."""

    def __init__(self, pairs: dict[int, int]):
        self.single = pairs
        self.bits = max(4, (4 * len(pairs)).bit_length())
        keys, values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int64)
        todo_k, todo_v = np.fromiter(pairs, np.int64, len(pairs)), np.fromiter(pairs.values(), np.int64, len(pairs))
        place = self.place(todo_k)
        while len(todo_k):
            free = keys[place] == -1
            _, first = np.unique(place, return_index=True)
            chosen = first[free[first]]
            keys[place[chosen]], values[place[chosen]] = todo_k[chosen], todo_v[chosen]
            rest = np.ones(len(todo_k), bool)
            rest[chosen] = False
            todo_k, todo_v, place = todo_k[rest], todo_v[rest], place[rest] + 1 & (1 << self.bits) - 1
        self.keys, self.values = keys, values

    def place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) << 20 | right
        place = self.place(keys)
        there = self.keys[place]
        out = np.where(there == keys, self.values[place], NONE)
        open_ = np.flatnonzero((there != keys) & (there != -1))
        while len(open_):
            place[open_] = place[open_] + 1 & (1 << self.bits) - 1
            there = self.keys[place[open_]]
            hit = there == keys[open_]
            out[open_[hit]] = self.values[place[open_[hit]]]
            open_ = open_[~hit & (there != -1)]
        return out


def merge_rows(parts: np.ndarray, counts: np.ndarray, ranks_of: PairRanks) -> tuple[np.ndarray, np.ndarray]:
    """Merges words at once. parts: (words, width) ids; counts: ids in each row. Returns both when done."""
    width = parts.shape[1]
    if width < 2:
        return parts, counts
    done_parts, done_counts = parts.copy(), counts.copy()
    rows, columns = np.arange(len(parts)), np.arange(width)
    ranks = np.full((len(parts), width), NONE)
    r, c = np.nonzero(columns[None, :] < counts[:, None] - 1)
    ranks[r, c] = ranks_of(parts[r, c], parts[r, c + 1])
    while len(rows):
        at = ranks.argmin(axis=1)
        own = np.arange(len(rows))
        best = ranks[own, at]
        going = best != NONE
        if not going.all():
            done_parts[rows[~going]], done_counts[rows[~going]] = parts[~going], counts[~going]
            rows, parts, counts, ranks, at, best = (x[going] for x in (rows, parts, counts, ranks, at, best))
            own = np.arange(len(rows))
        moved = np.minimum(columns[None, :] + (columns[None, :] > at[:, None]), width - 1)
        parts, ranks = np.take_along_axis(parts, moved, 1), np.take_along_axis(ranks, moved, 1)
        parts[own, at] = best & 0xFFFFF
        counts = counts - 1
        ranks[:, -1] = NONE
        for side in (0, -1):
            place = at + side
            inside = (place >= 0) & (place < counts - 1)
            q, k = own[inside], place[inside]
            ranks[own, np.maximum(place, 0)] = np.where(place < 0, ranks[own, np.maximum(place, 0)], NONE)
            ranks[q, k] = ranks_of(parts[q, k], parts[q, k + 1])
    return done_parts, done_counts


def merge_long(parts: list[int], pairs: dict[int, int]) -> list[int]:
    """The ids of one long word, with a heap of (rank, place) over a linked list."""
    n = len(parts)
    after, before = [*range(1, n), -1], [-1, *range(n - 1)]
    heap = [(v, i) for i in range(n - 1) if (v := pairs.get(parts[i] << 20 | parts[i + 1], NONE)) != NONE]
    heapq.heapify(heap)
    gone = [False] * n
    while heap:
        best, i = heapq.heappop(heap)
        j = after[i]
        if gone[i] or j < 0 or pairs.get(parts[i] << 20 | parts[j], NONE) != best:
            continue
        parts[i], gone[j], after[i] = best & 0xFFFFF, True, after[j]
        if after[j] >= 0:
            before[after[j]] = i
        for left in (before[i], i):
            if left >= 0 and after[left] >= 0:
                v = pairs.get(parts[left] << 20 | parts[after[left]], NONE)
                if v != NONE:
                    heapq.heappush(heap, (v, left))
    return [p for p, g in zip(parts, gone) if not g]


class Bpe:
    """A tokenizer file's byte pair encoding, for lower-casing word models and byte-level models."""

    def __init__(self, path: str, cache_words: int):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        merges = (m if isinstance(m, list) else m.split(" ", 1) for m in model["merges"])
        pairs = {self.vocab[a] << 20 | self.vocab[b]: rank << 20 | self.vocab[a + b] for rank, (a, b) in enumerate(merges)}
        self.ranks = PairRanks(pairs)
        chars = byte_chars()
        self.first = np.array([self.vocab[c] for c in chars])
        self.last = np.array([self.vocab[c + self.end] for c in chars])
        self.lower = spec.get("normalizer") is not None
        steps = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        pattern = next((s["pattern"]["Regex"] for s in steps if s["type"] == "Split"), None)
        self.pattern = regex.compile(pattern or r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.special_pattern = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.special_start = {s[:2] for s in self.special}
        size = 1 + max([*self.vocab.values(), *self.special.values()])
        self.tokens = [""] * size
        for token, i in [*self.vocab.items(), *self.special.items()]:
            self.tokens[i] = token
        self.byte_level = (spec.get("decoder") or {}).get("type") == "ByteLevel"
        if self.byte_level:
            value = {c: b for b, c in enumerate(chars)}
            self.token_bytes = [bytes(value[c] for c in t) if all(c in value for c in t) else t.encode() for t in self.tokens]
        self.words: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}
        self.limit = cache_words
        self.drops_space = pattern is not None

    def encode_words(self, words: list[str]) -> None:
        """Puts the ids of new words into self.words, as little-endian 32-bit bytes."""
        if not words:
            return
        data = "\0".join(words).encode("utf-8", "surrogatepass")
        if data.count(b"\0") != len(words) - 1:  # a word holds a zero character itself
            several = [w.encode("utf-8", "surrogatepass") for w in words]
            sizes, data = np.fromiter(map(len, several), np.int64, len(several)), b"\0".join(several)
        else:
            sizes = np.diff(np.flatnonzero(np.frombuffer(b"\0" + data + b"\0", np.uint8) == 0)) - 1
        starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
        flat = np.frombuffer(data + bytes(48), np.uint8)
        low = 0
        for width in (4, 6, 8, 10, 12, 16, 24, 48):
            group = np.flatnonzero((sizes > low) & (sizes <= width))
            low = width
            if not len(group):
                continue
            counts, rows = sizes[group], flat[starts[group, None] + np.arange(width)]
            parts = self.first[rows]
            last = (np.arange(len(group)), counts - 1)
            parts[last] = self.last[rows[last]]
            parts, counts = merge_rows(parts, counts, self.ranks)
            out, at = parts.astype("<u4").tobytes(), np.arange(len(group)) * 4 * width
            self.words.update(zip([words[i] for i in group.tolist()], [out[a:b] for a, b in zip(at.tolist(), (at + 4 * counts).tolist())]))
        for i in np.flatnonzero(sizes > low).tolist():
            bytes_ = flat[starts[i] : starts[i] + sizes[i]]
            parts = np.append(self.first[bytes_[:-1]], self.last[bytes_[-1]])
            if len(parts) > LONG_WORD:
                parts = merge_long(parts.tolist(), self.ranks.single)
            else:
                parts = merge_rows(parts[None, :], np.array([len(parts)]), self.ranks)
                parts = parts[0][0, : parts[1][0]]
            self.words[words[i]] = np.array(parts, "<u4").tobytes()

    def encode_chunks(self, chunks: list[str]) -> None:
        """Puts the ids of new chunks into self.chunks."""
        if not chunks:
            return
        plain = chunks
        if self.lower:  # chunks have no line ends here
            plain = unicodedata.normalize("NFC", "\n".join(chunks)).replace("Σ", "σ").lower().split("\n")
        alone = [w.isalpha() for w in plain] if self.lower else [c.lstrip(" ").isalpha() for c in plain]
        mixed = {c: self.pattern.findall(w) for c, w, is_alone in zip(chunks, plain, alone) if not is_alone}
        if len(self.words) > self.limit:
            self.words.clear()
        new = set(itertools.compress(plain, alone)).union(*mixed.values()).difference(self.words)
        self.encode_words(list(new))
        of = self.words.__getitem__
        self.chunks.update(zip(itertools.compress(chunks, alone), map(of, itertools.compress(plain, alone))))
        self.chunks.update((c, b"".join(map(of, words))) for c, words in mixed.items())

    def split(self, text: str) -> list[str]:
        """Chunks that stand alone: no word reaches over a space but as its first character, unless the
        pattern keeps white space and the text has a run of it around a space."""
        if self.drops_space:
            return text.replace("\n", " ").split(" ")
        if "  " in text or "\0" in text or LONE_SPACE.search(text):
            return [text]
        return text.replace(" ", "\0 ").split("\0")

    def pieces(self, text: str | None) -> list[str]:
        """Chunks and special tokens of a text in order."""
        if not text:
            return []
        if any(s in text for s in self.special_start):
            return [x for p in self.special_pattern.split(text) if p for x in ([p] if p in self.special else self.split(p))]
        return self.split(text)

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit bytes."""
        split = [self.pieces(t) for t in texts]
        if len(self.chunks) > self.limit:
            self.chunks.clear()
        new = set(itertools.chain.from_iterable(split)).difference(self.chunks, self.special)
        self.encode_chunks(list(new))
        self.chunks.update((t, np.array([i], "<u4").tobytes()) for t, i in self.special.items())
        of = self.chunks.__getitem__
        return [b"".join(map(of, chunks)) for chunks in split]

    def encode(self, text: str | None) -> bytes:
        return self.encode_batch([text])[0]

    def decode(self, ids: list[int] | None) -> str:
        """Without a decoder in the file, tokens are joined by spaces, as the tokenizers library does."""
        if self.byte_level:
            return b"".join(map(self.token_bytes.__getitem__, ids or ())).decode("utf-8", "replace")
        return " ".join(map(self.tokens.__getitem__, ids or ()))


@functools.lru_cache(4)
def load(path: str) -> Bpe:
    """One for a worker's encoding and decoding."""
    return Bpe(path, 0)


def encode_bpe(text: Column | str, path: str, cache_words: int = 300_000, slice_bytes: int = 1_000_000) -> Column:
    """The ids of each text, an array<int>. path: a tokenizer file that every executor can open; cache_words: words, and
    as many chunks, that a worker keeps; slice_bytes: bytes of texts whose new words merge together (both trade memory
    for time)."""

    def run(texts: pa.Array) -> pa.Array:
        bpe = load(path)
        bpe.limit = cache_words
        parts = [p for some in in_slices(texts, slice_bytes) for p in bpe.encode_batch(some)]
        ends = np.cumsum([0, *(len(p) // 4 for p in parts)], dtype=np.int64)
        values = np.frombuffer(b"".join(parts), "<i4")
        if ends[-1] < 1 << 31:
            return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values))
        return pa.LargeListArray.from_arrays(pa.array(ends), pa.array(values)).cast(pa.list_(pa.int32()))

    return F.arrow_udf(run, "array<int>")(F.col(text) if isinstance(text, str) else text)


def decode_bpe(ids: Column | str, path: str) -> Column:
    """The text of each array of ids, special tokens included."""

    def run(lists: pa.Array) -> pa.Array:
        bpe = load(path)
        values, ends = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
        return pa.array((bpe.decode(values[a:b].tolist()) for a, b in zip(ends[:-1], ends[1:])), pa.string())

    return F.arrow_udf(run, "string")(F.col(ids) if isinstance(ids, str) else ids)
