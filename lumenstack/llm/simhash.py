"""SimHash near-duplicate groups, with pigeonring filtering before the Hamming check.

Fingerprint: texts are lower-cased (A-Z), cut into words at ASCII white space and into shingles of `shingle`
words, repeats included; fewer words make one shingle, none makes the fingerprint zero. A bit is set if it
is set in more than half of the shingles' hashes (XXH64, seed 42). Null texts are empty texts.

Pigeonring: the 64 bits stand in a ring of m segments. If two fingerprints differ in at most t bits, there
is a segment from which every chain of l consecutive segments differs in at most l*t/m bits. Chains with
l*t/m < 1 must agree exactly, so the longest such chain is the key of an equi-join; the longer chains prune
what it finds, and the full Hamming distance (l = m) decides. A key that more than `heavy` fingerprints
share is not paired up: two fingerprints differ in at most t bits if and only if they share a variant with at most
ceil(t/2) bits of one and floor(t/2) of the other flipped; variants meet by equi-join, and links go to the least
fingerprint that reaches a variant with the fewer flips. That is linear in the key's fingerprints, at any t.

Groups are connected components. Rows with equal fingerprints are one node; copies are never paired.
Rows with a null id take part and get their group's id, null if the group has no other id. An empty table gives no
rows; only the id is kept of df's columns, and fp and component_id get underscores before them if the id is so named.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenstack.llm.common import free_name, materialise
from lumenstack.llm.components import connected_components

SEED = 42


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 of each shingle of a text, repeats included."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    digest, join = xxhash.xxh64_digest, b" ".join
    runs = zip(*(words[i:] for i in range(size))) if len(words) > size else [words]
    return np.frombuffer(b"".join([digest(join(r), SEED) for r in runs]), ">u8").astype(np.uint64)


def majority(hashes: np.ndarray) -> np.ndarray:
    """Of (n, w) 64-bit words, the w words whose bits are set in over half of the n."""
    n, w = hashes.shape
    if not n:
        return np.zeros(w, np.uint64)
    total = np.zeros(64 * w, np.int64)
    for i in range(0, n, 255):
        bits = np.unpackbits(hashes[i : i + 255].view(np.uint8), axis=1, bitorder="little")
        total += np.add.reduce(bits, axis=0, dtype=np.uint8)
    return np.packbits(2 * total > n, bitorder="little").view(np.uint64)


def fingerprint(text: Column, shingle: int) -> Column:
    """The 64-bit SimHash of each text, as a signed long."""

    def run(texts: pa.Array) -> pa.Array:
        out = [majority(shingle_hashes(t.as_py(), shingle)[:, None])[0] for t in texts]
        return pa.array(np.array(out, np.uint64).view(np.int64))

    return F.arrow_udf(run, "long")(text)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def ring(segments: int, distance: int) -> tuple[int, list[list[int]]]:
    """Length of the chains that must agree exactly, and masks[l][i] of the chain of l segments from i."""
    cuts = [round(64 * i / segments) for i in range(segments + 1)]
    own = [(1 << cuts[i + 1]) - (1 << cuts[i]) for i in range(segments)]
    masks = [[signed(sum(own[(i + j) % segments] for j in range(l))) for i in range(segments)] for l in range(segments + 1)]
    exact = max(l for l in range(segments + 1) if l * distance < segments)
    if not exact:
        raise ValueError("more segments than the distance are needed")
    return exact, masks


def pick(values: list[int], at: Column) -> Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), at + 1)


def hamming_links(fps: DataFrame, distance: int = 2, segments: int = 5, heavy: int = 128) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints (column fp) within the distance, no others."""
    exact, masks = ring(segments, distance)
    keys = [F.struct(F.lit(i).alias("chain"), F.col("fp").bitwiseAND(F.lit(masks[exact][i])).alias("key")) for i in range(segments)]
    rows = fps.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.chain", "k.key")
    shared = rows.groupBy("chain", "key").agg(F.count("*").alias("n")).where("n > 1")
    met = materialise(rows.join(shared, ["chain", "key"]))
    light = met.where(F.col("n") <= heavy)
    left, right = light.select("chain", "key", F.col("fp").alias("a")), light.select("chain", "key", F.col("fp").alias("b"))
    differ = F.col("a").bitwiseXOR(F.col("b"))
    chains = F.lit(True)
    for l in range(exact + 1, segments):
        chains &= F.bit_count(differ.bitwiseAND(pick(masks[l], F.col("chain")))) <= l * distance // segments
    pairs = left.join(right, ["chain", "key"]).where("a < b").where(chains).where(F.bit_count(differ) <= distance).select("a", "b")
    near, far = distance // 2, distance - distance // 2
    free = [[signed(1 << b) for b in range(64) if not masks[exact][i] >> b & 1] for i in range(segments)]

    def variants(most: int) -> DataFrame:
        """Fingerprints of heavy keys with up to `most` free bits flipped."""
        out = met.where(F.col("n") > heavy).select("fp", "chain", F.col("fp").alias("variant"))
        flips = F.element_at(F.array(*(F.array(*(F.lit(v) for v in [0, *bits])) for bits in free)), F.col("chain") + 1)
        for _ in range(most):
            out = out.select("fp", "chain", F.explode(flips).alias("flip"), "variant").select("fp", "chain", F.col("variant").bitwiseXOR(F.col("flip")).alias("variant"))
        return out.distinct() if most > 1 else out

    least = variants(near).groupBy("chain", "variant").agg(F.min("fp").alias("hub"))
    stars = variants(far).join(least, ["chain", "variant"]).where("fp <> hub").select(F.least("fp", "hub").alias("a"), F.greatest("fp", "hub").alias("b"))
    return pairs.unionAll(stars).distinct()


def simhash_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, distance: int = 2, segments: int = 5, heavy: int = 128) -> DataFrame:
    """(id_col, fp, component_id) for each row: fingerprint, and the smallest id that links lead to."""
    fp_name, component = (free_name(df.select(id_col), x) for x in ("fp", "component_id"))
    rows = materialise(df.select(F.col(id_col).alias("id"), fingerprint(F.col(text_col), shingle).alias("fp")))
    nodes = rows.groupBy("fp").agg(F.min("id").alias("least"))
    roots = connected_components(hamming_links(nodes, distance, segments, heavy), "a", "b")
    linked = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    linked = materialise(linked)
    named = linked.join(linked.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return rows.join(named, "fp").select(F.col("id").alias(id_col), F.col("fp").alias(fp_name), F.col("component_id").alias(component))
