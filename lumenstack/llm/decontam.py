"""Benchmark decontamination: test items found inside long documents by MinHash containment search.

Texts are lower-cased (A-Z), cut into words at ASCII white space and into 5-word shingles (an item of fewer
words is one shingle, looked for as that many words in a row). Items are partitioned by their number of
shingles into classes [2^k, 2^(k+1)), each with an index, a length of signature and a bound of its own. An item's
signature holds, for each hash function, its shingle of the least hash; that shingle is a random one of the item, so a
document that contains a share c of the item has it with probability c, however long the document is. Larger classes,
whose exact check costs more, have longer signatures (`hashes` times 2^(k/2) / 4) and so a tighter bound on the share of
hits, under which an item of containment `threshold` stays with a probability under 1e-6; items of no more shingles than
hash functions have all of their shingles as signature. Pairs over the bound are verified by exact containment of
their word shingles.

Items reach the workers in blocks of bounded size; more items mean more blocks over the same scan, so the
benchmark may grow; a worker holds the blocks of all, so a benchmark of many blocks needs memory for itself. Null and
wordless texts contain nothing and are contained in nothing. Repeated items and repeated documents are each reported, an
item of null id with a null. Each document is handled whole within its row; an empty table or benchmark gives no leaks.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenstack.llm.common import WORD

MIX = np.uint64(0x9E3779B97F4A7C15)
LEAK = "array<struct<item:string,shared:long,item_shingles:long>>"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def hits_needed(hashes: int, threshold: float, miss: float = 1e-6) -> int:
    """The most signature hits to ask for, so that Binomial(hashes, threshold) falls short with less than `miss`."""
    below, need = 0.0, 0
    while need < hashes:
        below += math.comb(hashes, need) * threshold**need * (1 - threshold) ** (hashes - need)
        if below >= miss:
            break
        need += 1
    return max(1, need)


def codes(ids: np.ndarray, size: int, at: np.ndarray) -> np.ndarray:
    """A 64-bit code of the `size` word ids from each place."""
    out = np.zeros(len(at), np.uint64)
    for i in range(size):
        out = (out ^ ids[at + i].astype(np.uint64)) * MIX
        out ^= out >> np.uint64(29)
    return out


def signature_length(part: int, hashes: int) -> int:
    """Hash functions of the class of items of 2^part and more shingles."""
    return max(hashes, round(hashes * 2 ** (part / 2) / 4))


class SizeClass:
    """The signatures of the items of one class and one number of words a shingle."""

    def __init__(self, hashes: int, threshold: float):
        self.hashes, self.need = hashes, hits_needed(hashes, threshold)
        self.seeds = np.arange(1, hashes + 1, dtype=np.uint64)[:, None] * MIX
        self.table: dict[int, list[int]] = defaultdict(list)
        self.needs: dict[int, int] = {}

    def add(self, item: int, code: np.ndarray, threshold: float) -> None:
        if len(code) <= self.hashes:
            signature, self.needs[item] = code, max(1, math.ceil(threshold * len(code) - 1e-9))
        else:
            mixed = (code[None, :] ^ self.seeds) * np.uint64(0xBF58476D1CE4E5B9)
            signature, self.needs[item] = code[np.argmin(mixed ^ mixed >> np.uint64(31), axis=1)], self.need
        for c in signature.tolist():
            self.table[c].append(item)

    def close(self) -> None:
        self.table = dict(self.table)
        self.keys = np.array(sorted(self.table), np.uint64)

    def candidates(self, code: np.ndarray, docs: np.ndarray) -> dict[int, list[int]]:
        """Items by document whose signature the document's codes hit often enough."""
        found = self.keys[np.minimum(np.searchsorted(self.keys, code), len(self.keys) - 1)] == code
        hits: dict[int, Counter] = defaultdict(Counter)
        for doc, c in set(zip(docs[found].tolist(), code[found].tolist())):
            hits[doc].update(self.table[c])
        likely = {doc: sorted(k for k, n in counted.items() if n >= self.needs[k]) for doc, counted in hits.items()}
        return {doc: items for doc, items in likely.items() if items}


class Index:
    """Signatures and shingles of a block of items."""

    def __init__(self, items: list[tuple[str | None, str]], shingle: int, threshold: float, hashes: int):
        self.names, self.threshold = [name for name, _ in items], threshold
        self.vocab: dict[bytes, int] = {}
        self.classes: dict[int, dict[int, SizeClass]] = defaultdict(dict)  # by words a shingle, by class
        self.shingles: list[set[tuple[int, ...]]] = []
        for k, (_, text) in enumerate(items):
            words = words_of(text)
            ids = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words]
            size = min(shingle, len(ids))
            own = set(zip(*(ids[i:] for i in range(size)))) if size else set()
            self.shingles.append(own)
            if own:
                rows = np.array(sorted(own), np.int64)
                part = len(own).bit_length() - 1
                if part not in self.classes[size]:
                    self.classes[size][part] = SizeClass(signature_length(part, hashes), threshold)
                self.classes[size][part].add(k, codes(rows.ravel(), size, np.arange(0, rows.size, size)), threshold)
        for classes in self.classes.values():
            for c in classes.values():
                c.close()
        self.classes = dict(self.classes)

    def search(self, texts: list[str | None]) -> list[list[tuple[str | None, int, int]]]:
        """For each text, (item, shared shingles, shingles of the item)."""
        out: list[list[tuple[str | None, int, int]]] = [[] for _ in texts]
        ids, starts, at = [], [], 0
        for t in texts:  # documents stand apart by zeros, which no item has
            words = words_of(t)
            starts.append(at)
            ids.append(np.fromiter(map(self.vocab.get, words, itertools.repeat(0)), np.int64, len(words)))
            ids.append(np.zeros(1, np.int64))
            at += len(words) + 1
        flat, bounds = np.concatenate([*ids, np.zeros(0, np.int64)]), np.array([*starts, at])
        known = flat > 0
        for size, classes in self.classes.items():
            n = len(flat) - size + 1
            if n <= 0:
                continue
            whole = known[:n].copy()
            for i in range(1, size):
                whole &= known[i : n + i]
            places = np.flatnonzero(whole)
            code, docs = codes(flat, size, places), np.searchsorted(bounds, places, side="right") - 1
            likely: dict[int, list[int]] = defaultdict(list)
            for c in classes.values():
                for doc, items in c.candidates(code, docs).items():
                    likely[doc] += items
            for doc, items in likely.items():
                inside = places[np.searchsorted(places, bounds[doc]) : np.searchsorted(places, bounds[doc + 1])]
                own = set(map(tuple, np.stack([flat[inside + i] for i in range(size)], 1).tolist()))
                for k in sorted(items):
                    shared, of = len(self.shingles[k] & own), len(self.shingles[k])
                    if shared >= self.threshold * of - 1e-9:
                        out[doc].append((self.names[k], shared, of))
        return out


def leaks(items: DataFrame, text: Column, item_id: str = "item_id", item_text: str = "text", shingle: int = 5, threshold: float = 0.8, hashes: int = 16, block_words: int = 500_000) -> Column:
    """A column of LEAK: the items that each text contains, threshold or more of their shingles.

    block_words: words of items, about, that a worker holds at once.
    """
    rows = items.select(F.col(item_id).cast("string").alias("item"), F.coalesce(F.col(item_text), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.regexp_count("text", F.lit(WORD)))).first()[0] or 0
    blocks = -(-total // block_words) or 1
    block = F.pmod(F.xxhash64("item", "text"), F.lit(blocks))
    context = items.sparkSession.sparkContext
    kind = pa.list_(pa.struct([("item", pa.string()), ("shared", pa.int64()), ("item_shingles", pa.int64())]))

    def search(index) -> Column:
        def run(texts: pa.Array) -> pa.Array:
            out = []
            for i in range(0, len(texts), 500):
                out += index.value.search(texts[i : i + 500].to_pylist())
            return pa.array([[{"item": n, "shared": s, "item_shingles": of} for n, s, of in row] for row in out], kind)

        return F.arrow_udf(run, LEAK)(text)

    found = []
    for b in range(blocks):
        block_items = sorted(((r["item"], r["text"]) for r in rows.where(block == b).collect()), key=lambda x: (x[0] is not None, x[0] or "", x[1]))
        found.append(search(context.broadcast(Index(block_items, shingle, threshold, hashes))))
    return F.flatten(F.array(*found)) if blocks > 1 else found[0]
