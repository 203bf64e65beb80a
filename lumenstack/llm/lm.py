"""A bigram language model in an Elias-Fano trie, fitted and queried by Spark tasks.

Tokens are the words of a text, lower-cased (A-Z), then one end token; the end token also stands before the
first word. Words are known by their 64-bit XXH64 hash, whose order gives their ids. Probabilities are
Dirichlet-smoothed: p(w|h) = (c(hw) + K p(w)) / (c(h) + K), with p(w) = (c(w) + 1) / (N + V + 1); so they sum to
one over the vocabulary and one unknown word, and the weight of an unseen word after h is K / (c(h) + K).

Every table is a set of shards, each made by one task and written to a folder that all executors share:
the vocabulary (sorted hashes and counts) and the trie. A trie shard has a level of contexts (Elias-Fano ids),
monotone Elias-Fano pointers to the ranges of their successors, the successors (Elias-Fano, each range lifted by
the last value before it, so that the level is monotone), and an 8-bit code of each log-probability into the
shard's codebook, the means of 256 bins of equal width. Readers map the files; a look-up finds the context, its range, and the word by
successor search relative to that range. A context that is common is dealt out over all shards by its
successors, so no shard holds more for one word. Counts leave the tasks sorted and compressed, by shard.

All n-grams are kept. Null texts are empty ones: one end token. Repeated rows count and score each. With no
training rows N and V are 0 and every token has probability one.
"""

from __future__ import annotations

import functools
import math
import mmap
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenstack.llm.common import in_slices
from lumenstack.llm.eliasfano import U64, EliasFano

END = b""
BLOB = "shard int, keys binary, counts binary"
DONE = "shard int, entries long, total long"
SCORE = "n_tokens long, n_known long, base_score double, score double"
#: Tokens that a task holds before it sends its counts on.
HELD_TOKENS = 2_000_000


@dataclass(frozen=True)
class Lm:
    """What readers need to know: the folder and its sizes. bases[i]: words in vocabulary shards before i."""

    folder: str
    shards: int
    bases: tuple[int, ...]
    tokens: int
    words: int
    strength: float

    @property
    def common(self) -> int:
        """Contexts of more tokens are dealt out over all shards."""
        return self.tokens // (4 * self.shards) + 1


def hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts, end tokens included, and the n+1 bounds of the texts."""
    digest, out, bounds = xxhash.xxh64_digest, [], [0]
    end = digest(END)
    for t in texts:
        words = (t or "").encode().lower().split()
        out += [digest(w) for w in words]
        out.append(end)
        bounds.append(len(out))
    return np.frombuffer(b"".join(out), ">u8").astype(U64), np.array(bounds)


def squeezed(values: np.ndarray) -> bytes:
    return zstandard.compress(values.tobytes(), 1)


def restored(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), kind)


def summed(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, with the sums of their counts."""
    if counts is None:
        unique, n = np.unique(keys, return_counts=True)
        return unique, n
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def counted(make, shard_of, split: bool):
    """A function for mapInArrow: counts the keys that make(texts) gives, sends them on by shard_of(keys).

    split: keys are pairs of 32-bit ids; their halves are compressed apart, the first as differences.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n = 0

        def out() -> Iterator[pa.RecordBatch]:
            keys, counts = summed(np.concatenate(held))
            shard = shard_of(keys)
            order = np.argsort(shard, kind="stable")
            keys, counts, shard = keys[order], counts[order].astype(np.uint32), shard[order]
            bounds = np.flatnonzero(np.append(np.append(True, shard[1:] != shard[:-1]), True))
            rows = []
            for a, b in zip(bounds[:-1], bounds[1:]):
                own = keys[a:b]
                if split:
                    first = (own >> U64(32)).astype(np.uint32)
                    columns = np.concatenate([np.diff(first, prepend=np.uint32(0)), own.astype(np.uint32)])
                else:
                    columns = own
                rows.append((int(shard[a]), squeezed(columns), squeezed(counts[a:b])))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], ["shard", "keys", "counts"])

        for batch in batches:
            for texts in in_slices(batch.column(0)):
                held.append(make(texts))
                n += len(held[-1])
                if n >= HELD_TOKENS:
                    yield from out()
                    held, n = [], 0
        if n:
            yield from out()

    return run


def per_shard(finish, split: bool):
    """A function for mapInArrow over blobs sorted by shard: merges a shard's counts and calls
    finish(shard, keys, counts), which writes the shard and gives its number of entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, keys, counts, waiting = None, np.zeros(0, U64), np.zeros(0, np.int64), []

        def merge() -> None:
            nonlocal keys, counts, waiting
            keys, counts = summed(np.concatenate([keys, *(k for k, _ in waiting)]), np.concatenate([counts, *(c for _, c in waiting)]))
            waiting = []

        def done() -> pa.RecordBatch:
            merge()
            return pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "entries": pa.array([finish(shard, keys, counts)], pa.int64()), "total": pa.array([int(counts.sum())], pa.int64())})

        for batch in batches:
            for number, k, c in zip(*(column.to_pylist() for column in batch.columns)):
                if shard is not None and number != shard:
                    yield done()
                    keys, counts = np.zeros(0, U64), np.zeros(0, np.int64)
                shard = number
                if split:
                    first, second = restored(k, "<u4").reshape(2, -1)
                    own = np.cumsum(first, dtype=np.uint64) << U64(32) | second
                else:
                    own = restored(k, "<u8")
                waiting.append((own, restored(c, "<u4").astype(np.int64)))
                if sum(len(x) for x, _ in waiting) > max(HELD_TOKENS, len(keys)):
                    merge()
        if shard is not None:
            yield done()

    return run


def put(folder: str, name: str, arrays: tuple[np.ndarray, ...]) -> None:
    """Writes arrays of 64-bit words to one file: their number, their lengths, then each. The file gets its name
    when it is whole, so that a task that runs again replaces it."""
    fs, root = pafs.FileSystem.from_uri(folder)
    tried = f"{root}/.{name}-{TaskContext.get().taskAttemptId()}"
    with fs.open_output_stream(tried) as f:
        f.write(np.array([len(arrays), *map(len, arrays)], U64).tobytes())
        for a in arrays:
            f.write(np.ascontiguousarray(a).astype(a.dtype, copy=False).tobytes())
    fs.move(tried, f"{root}/{name}")


@functools.lru_cache(20_000)
def get(folder: str, name: str) -> tuple[np.ndarray, ...]:
    """The arrays of a file, memory-mapped where the shared folder is mounted, else read."""
    fs, root = pafs.FileSystem.from_uri(folder)
    if isinstance(fs, pafs.LocalFileSystem):
        with open(f"{root}/{name}", "rb") as f:
            words = np.frombuffer(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, trackfd=False), U64)
    else:
        with fs.open_input_stream(f"{root}/{name}") as f:
            words = np.frombuffer(f.read(), U64)
    sizes = words[1 : 1 + int(words[0])].astype(np.int64)
    starts = 1 + len(sizes) + np.concatenate([[0], np.cumsum(sizes)])
    return tuple(words[a:b] for a, b in zip(starts[:-1], starts[1:]))


def vocabulary_shard(keys: np.ndarray, shards: int) -> np.ndarray:
    return (keys >> U64(64 - shards.bit_length() + 1)).astype(np.int64) if shards > 1 else np.zeros(len(keys), np.int64)


def look_up(lm: Lm, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id, count) of each word hash; unknown words have the id `words` and the count 0."""
    unique, where = np.unique(keys, return_inverse=True)
    ids, counts = np.full(len(unique), lm.words, np.int64), np.zeros(len(unique), np.int64)
    shard = vocabulary_shard(unique, lm.shards)
    for s in np.unique(shard).tolist():
        if lm.bases[s + 1] == lm.bases[s]:
            continue
        a, b = np.searchsorted(shard, s), np.searchsorted(shard, s, side="right")
        known, n = get(lm.folder, f"vocabulary-{s}")
        at = np.minimum(np.searchsorted(known, unique[a:b]), len(known) - 1)
        hit = np.flatnonzero(known[at] == unique[a:b])
        ids[a + hit], counts[a + hit] = lm.bases[s] + at[hit], n[at[hit]].astype(np.int64)
    return ids[where], counts[where]


def trie_shard(lm: Lm, before: np.ndarray, count: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The shard of (context id, context count, word id)."""
    spread = np.where(count > lm.common, word * 7919, 0)
    return (before + spread) % lm.shards


def pairs_of(ids: np.ndarray, bounds: np.ndarray, end: int) -> np.ndarray:
    """The id before each token; the end token's before a text's first."""
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[bounds[:-1]] = end
    return before


def unigram(lm: Lm, counts: np.ndarray) -> np.ndarray:
    return np.log10((counts + 1) / (lm.tokens + lm.words + 1))


def counts_of(lm: Lm, ids: np.ndarray) -> np.ndarray:
    """Counts of known ids."""
    out, shard = np.zeros(len(ids), np.int64), np.searchsorted(np.array(lm.bases), ids, side="right") - 1
    for s in np.unique(shard).tolist():
        own = np.flatnonzero(shard == s)
        out[own] = get(lm.folder, f"vocabulary-{s}")[1][ids[own] - lm.bases[s]].astype(np.int64)
    return out


def write_trie(lm: Lm, shard: int, keys: np.ndarray, counts: np.ndarray) -> int:
    """keys: context << 32 | word, ascending."""
    before, word = (keys >> U64(32)).astype(np.int64), (keys & U64(0xFFFFFFFF)).astype(np.int64)
    starts = np.flatnonzero(np.append(True, before[1:] != before[:-1]))
    contexts, pointers = before[starts], np.append(starts, len(keys))
    context_counts = np.repeat(counts_of(lm, contexts), np.diff(pointers))
    p = 10.0 ** unigram(lm, counts_of(lm, word))
    log = np.log10((counts + lm.strength * p) / (context_counts + lm.strength))
    low, high = log.min(), log.max()
    code = np.minimum((log - low) * (256 / max(high - low, 1e-9)), 255).astype(np.uint8)
    book = np.bincount(code, log, 256) / np.maximum(1, np.bincount(code, minlength=256))
    # Each range is lifted by the last value before it.
    last = word[pointers[1:] - 1]
    lift = np.concatenate([[0], np.cumsum(last)[:-1]])
    lifted = word + np.repeat(lift, np.diff(pointers))
    data = code.tobytes()
    codes = np.frombuffer(data + bytes(-len(data) % 8), U64)
    put(lm.folder, f"trie-{shard}", (*EliasFano.parts_of(contexts), *EliasFano.parts_of(pointers), *EliasFano.parts_of(lifted), book.view(U64), codes))
    return len(keys)


@functools.lru_cache(20_000)
def trie(folder: str, shard: int):
    parts = get(folder, f"trie-{shard}")
    return *(EliasFano(parts[i : i + 4]) for i in (0, 4, 8)), parts[12].view(np.float64), parts[13].view(np.uint8)


def search(lm: Lm, made: frozenset[int], shard: int, before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The coded log-probabilities of pairs, NaN for those not there. before: ascending."""
    out = np.full(len(before), np.nan)
    if shard not in made:
        return out
    contexts, pointers, words, book, codes = trie(lm.folder, shard)
    unique, where = np.unique(before, return_inverse=True)
    node = contexts.successor(unique)
    there = node < contexts.n
    there[there] = contexts.access(node[there]).astype(np.int64) == unique[there]
    node = np.where(there, node, 0)
    start, end = pointers.access(node).astype(np.int64), pointers.access(node + 1).astype(np.int64)
    lift = np.where(start > 0, words.access(np.maximum(start - 1, 0)).astype(np.int64), 0)
    asked = np.flatnonzero(there[where])
    value = lift[where[asked]] + word[asked]
    # The last value before a range may equal a word's lifted value: the search starts inside the range.
    at = np.maximum(words.successor(value), start[where[asked]])
    inside = at < end[where[asked]]
    inside[inside] = words.access(at[inside]).astype(np.int64) == value[inside]
    out[asked[inside]] = book[codes[at[inside]]]
    return out


def pair_scores(lm: Lm, made: frozenset[int], before: np.ndarray, before_counts: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """log10 p(token | token before) of each token."""
    missing = np.log10(lm.strength / (before_counts + lm.strength)) + unigram(lm, counts)
    known = np.flatnonzero((ids < lm.words) & (before < lm.words))
    keys, first, where = np.unique(before[known].astype(U64) << U64(32) | ids[known].astype(U64), return_index=True, return_inverse=True)
    context, word = (keys >> U64(32)).astype(np.int64), (keys & U64(0xFFFFFFFF)).astype(np.int64)
    shard = trie_shard(lm, context, before_counts[known][first], word)
    found = np.full(len(keys), np.nan)
    order = np.argsort(shard, kind="stable")
    bounds = np.flatnonzero(np.append(np.append(True, np.diff(shard[order]) != 0), True)) if len(order) else [0]
    for a, b in zip(bounds[:-1], bounds[1:]):
        own = order[a:b]
        found[own] = search(lm, made, int(shard[own[0]]), context[own], word[own])
    value = found[where]
    missing[known] = np.where(np.isnan(value), missing[known], value)
    return missing


def fit_lm(docs: DataFrame, folder: str, text_col: str = "text", strength: float = 20.0, shard_bytes: int = 32 << 20) -> tuple[Lm, frozenset[int]]:
    """Fits on all rows of docs and writes the model to folder (a URI that all executors share); also returns
    the trie shards that are not empty. shard_bytes: text to a shard, about."""
    texts = docs.select(F.col(text_col).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = 1 << max(3, math.ceil(math.log2(max(1, size / shard_bytes))))
    pafs_, root = pafs.FileSystem.from_uri(folder)
    pafs_.create_dir(root, recursive=True)

    def write_words(shard: int, keys: np.ndarray, counts: np.ndarray) -> int:
        put(folder, f"vocabulary-{shard}", (keys, counts.astype(U64)))
        return len(keys)

    def by_shard(make, shard_of, finish, split: bool) -> list:
        blobs = texts.mapInArrow(counted(make, shard_of, split), BLOB)
        return blobs.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(per_shard(finish, split), DONE).collect()  # a row a shard

    done = by_shard(lambda t: hashes(t)[0], lambda keys: vocabulary_shard(keys, shards), write_words, False)
    sizes = {r["shard"]: r["entries"] for r in done}
    bases = [0]
    for s in range(shards):
        bases.append(bases[-1] + sizes.get(s, 0))
    if bases[-1] >= 1 << 32:
        raise ValueError("more than 2^32 words")
    lm = Lm(folder, shards, tuple(bases), sum(r["total"] for r in done), bases[-1], strength)
    if not lm.words:
        return lm, frozenset()

    def make(t: list[str | None]) -> np.ndarray:
        keys, bounds = hashes(t)
        ids = look_up(lm, keys)[0]
        return pairs_of(ids, bounds, int(ids[-1])).astype(U64) << U64(32) | ids.astype(U64)

    def shard_of(keys: np.ndarray) -> np.ndarray:
        before = (keys >> U64(32)).astype(np.int64)
        unique, where = np.unique(before, return_inverse=True)
        return trie_shard(lm, before, counts_of(lm, unique)[where], (keys & U64(0xFFFFFFFF)).astype(np.int64))

    made = by_shard(make, shard_of, lambda shard, keys, counts: write_trie(lm, shard, keys, counts), True)
    return lm, frozenset(r["shard"] for r in made)


def score_texts(text: Column, lm: Lm, made: frozenset[int]) -> Column:
    """n_tokens, n_known (tokens seen in training), base_score (add-one unigrams) and score of each text."""

    def run(texts: pa.Array) -> pa.Array:
        out = []
        for some in in_slices(texts):
            keys, bounds = hashes(some)
            ids, counts = look_up(lm, keys)
            before, before_counts = pairs_of(ids, bounds, int(ids[-1])), pairs_of(counts, bounds, int(counts[-1]))
            scores = pair_scores(lm, made, before, before_counts, ids, counts) if lm.words else np.zeros(len(ids))
            first = bounds[:-1]
            out.append((np.diff(bounds), np.add.reduceat((counts > 0).astype(np.int64), first), np.add.reduceat(unigram(lm, counts), first), np.add.reduceat(scores, first)))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0)] * 4
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
        return pa.StructArray.from_arrays([pa.array(c.astype(k.to_pandas_dtype()), k) for c, k in zip(columns, kinds)], [x.split()[0] for x in SCORE.split(", ")])

    return F.arrow_udf(run, SCORE)(text)
