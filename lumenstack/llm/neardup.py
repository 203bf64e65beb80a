"""Near-duplicate groups of texts at a shingle similarity, from long SimHash fingerprints with pigeonring filtering.

A fingerprint has `WORDS` x 64 bits; two texts whose shingle sets have a cosine c differ in a share acos(c) / pi of
the bits, so the Hamming distance, with the numbers of shingles, estimates their Jaccard similarity J, at J = 0.8
with a standard deviation of 0.026. Fingerprints that share no segment are the rule at this distance (a key of exact
bits would have to be so short that unrelated texts meet on it), so texts meet on keys that do not fill up with the
table: each of `BANDS` keys is a hash of `ROWS` minimum hashes of the shingle set. Two texts share a key with the
probability 1 - (1 - J**ROWS)**BANDS: 0.998 at J = 0.8, over 0.9999 at 0.85, 0.03 at 0.33.

What meets passes the pigeonring: the words of a fingerprint stand in a ring, and if two fingerprints differ in at
most t bits, there is a word from which every chain of l consecutive words differs in at most l * t / WORDS bits.
Pairs without such a start are dropped inside the join, before the full Hamming check. That check is a filter too:
pairs whose estimate is at least J less `margin` (nearly four deviations) go on, and the sets of shingle hashes
of the two texts decide by exact similarity. So no pair under J is linked, and one of J or more is lost with a
probability of 0.002 if no other text links its group.

Groups are connected components, found in two passes so that large groups do not emit all their pairs. First each
text is compared with one other: the most similar, by the estimate, of the least members of its keys' buckets and,
in crowded buckets, of the members nearest to their majority. Then, in buckets that still hold several components,
all members that are not of the bucket's largest component are compared with all others, block by block. Texts with equal sets of shingle hashes
are one node throughout. Null texts are empty texts, and all texts without words are one group. Rows with equal ids
and texts count as one document. An empty table gives an empty table; columns of any name are kept as they are.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenstack.llm.common import forget, free_name, in_slices, materialise, sieved
from lumenstack.llm.components import connected_components
from lumenstack.llm.simhash import shingle_hashes, signed

WORDS = 16
BANDS, ROWS = 20, 6
#: Words of the longest chain that the ring is searched for.
CHAIN = 3
PRINT = "fp array<long>, bands array<long>, shingles long, digest long"
MIX = np.uint64(0xD6E8FEB86659FD93)


def spread(hashes: np.ndarray) -> np.ndarray:
    """WORDS independent 64-bit hashes of each hash."""
    odd = (np.arange(1, 2 * WORDS, 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    out = hashes[:, None] * odd
    out ^= out >> np.uint64(32)
    out *= MIX
    out ^= out >> np.uint64(32)
    out *= MIX
    return out ^ out >> np.uint64(32)


#: Multipliers without a common factor: of x and 3x both would be least together.
ODD = spread(np.arange(1, 1 + -(-BANDS * ROWS // WORDS), dtype=np.uint64)).ravel()[: BANDS * ROWS] | np.uint64(1)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """BANDS keys, each of ROWS minimum hashes of the set."""
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for i in range(0, len(hashes), 255):
        some = hashes[i : i + 255]
        least = np.minimum(least, ((some ^ some >> np.uint64(29))[:, None] * ODD).min(axis=0))
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in least.reshape(ROWS, BANDS):
        out = (out ^ row) * MIX
        out ^= out >> np.uint64(31)
    return out.view(np.int64)


def long_fingerprint(text: Column, shingle: int) -> Column:
    """The fingerprint and the keys of each text's set of shingles, the set's size, and a hash of the set."""

    def lists(values: list[np.ndarray], size: int) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * size), pa.array(np.concatenate([*values, np.zeros(0, np.int64)])))

    def run(texts: pa.Array) -> pa.Array:
        prints, keys, sizes, digests = [], [], [], []
        for some in in_slices(texts, 500_000):
            for t in some:
                hashes = np.unique(shingle_hashes(t, shingle))
                sizes.append(len(hashes))
                digests.append(signed(xxhash.xxh64_intdigest(hashes.tobytes())))
                total = np.zeros(64 * WORDS, np.int64)
                for i in range(0, len(hashes), 255):
                    bits = np.unpackbits(spread(hashes[i : i + 255]).view(np.uint8), axis=1, bitorder="little")
                    total += np.add.reduce(bits, axis=0, dtype=np.uint8)
                prints.append(np.packbits(2 * total > len(hashes), bitorder="little").view(np.int64))
                keys.append(band_keys(hashes))
        return pa.StructArray.from_arrays([lists(prints, WORDS), lists(keys, BANDS), pa.array(sizes, pa.int64()), pa.array(digests, pa.int64())], ["fp", "bands", "shingles", "digest"])

    return F.arrow_udf(run, PRINT)(text)


def hash_set(text: Column, shingle: int) -> Column:
    """The distinct hashes of each text's shingles."""

    def run(texts: pa.Array) -> pa.Array:
        sets = [np.unique(shingle_hashes(t, shingle)).view(np.int64) for some in in_slices(texts, 500_000) for t in some]
        flat = np.concatenate([*sets, np.zeros(0, np.int64)])
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)], dtype=np.int32)), pa.array(flat))

    return F.arrow_udf(run, "array<long>")(text)


def bits_at(similarity: float) -> int:
    """The most bits of a fingerprint in which sets of this similarity are expected to differ."""
    return math.ceil(64 * WORDS * math.acos(2 * similarity / (1 + similarity)) / math.pi)


def similar(a: Column, b: Column, similarity: float) -> Column:
    """Whether two structs (fp, shingles) pass the ring at the similarity's distance and then, by their full
    distance, are estimated to reach the similarity."""
    most = bits_at(similarity)

    def passes(d: Column) -> Column:
        """d: differing bits of each word."""
        starts = F.lit(False)
        for i in range(WORDS):
            chain, holds = F.lit(0), F.lit(True)
            for l in range(1, CHAIN + 1):
                chain += d[(i + l - 1) % WORDS]
                holds &= chain <= l * most // WORDS
            starts |= holds
        shared = F.cos(F.aggregate(d, F.lit(0), lambda s, n: s + n) * (math.pi / (64 * WORDS))) * F.sqrt(a["shingles"] * b["shingles"].cast("double"))
        return starts & (shared >= similarity * (a["shingles"] + b["shingles"] - shared))

    differ = F.zip_with(a["fp"], b["fp"], lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return F.exists(F.array(differ), passes)


def estimate(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two structs (fp, shingles)."""
    distance = F.aggregate(F.zip_with(a["fp"], b["fp"], lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, n: s + n)
    shared = F.cos(distance * (math.pi / (64 * WORDS))) * F.sqrt(a["shingles"] * b["shingles"].cast("double"))
    return shared / (a["shingles"] + b["shingles"] - shared)


def verified(pairs: DataFrame, sets: Callable[[DataFrame], DataFrame], similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes whose Jaccard similarity reaches `similarity`; sets: (node, hashes) of a table's nodes."""
    held = materialise(sets(pairs.select(F.col("a").alias("node")).unionAll(pairs.select("b")).distinct()))
    side = lambda name: held.select(F.col("node").alias(name), F.col("hashes").alias(f"{name}_"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    counted = both.select("a", "b", F.size(F.array_intersect("a_", "b_")).alias("shared"), (F.size("a_") + F.size("b_")).alias("sizes"))
    reached = materialise(counted.where(F.col("shared") >= F.lit(similarity) * (F.col("sizes") - F.col("shared"))).select("a", "b"))
    forget(held)
    return reached


def central_members(crowded: DataFrame) -> DataFrame:
    """(key, hub): of each bucket's (key, node, word) the member that is nearest to the majority of each bit.

    Copies of one text differ from it each in its own way, so the majority of their bits is that text's, and the
    text, if it is there, is similar to more of them than any copy is.
    """
    ones = [F.sum(F.shiftrightunsigned("word", b).bitwiseAND(F.lit(1))).alias(f"b{b}") for b in range(64)]
    counted = crowded.groupBy("key").agg(F.count("*").alias("n"), *ones)
    bits = [F.when(F.col(f"b{b}") * 2 > F.col("n"), F.lit((1 << b) - (1 << 64) if b == 63 else 1 << b)).otherwise(F.lit(0)).cast("long") for b in range(64)]
    majority = bits[0]
    for bit in bits[1:]:
        majority = majority.bitwiseOR(bit)
    majorities = materialise(counted.select("key", majority.alias("majority")))
    away = F.bit_count(F.col("word").bitwiseXOR(F.col("majority")))
    nearest = crowded.join(majorities, "key").select("key", F.struct(away.alias("away"), "node").alias("m"))
    return nearest.groupBy("key").agg(F.min("m").alias("m")).select("key", F.col("m.node").alias("hub"))


class Block:
    """Some nodes of a bucket as arrays."""

    def __init__(self, rows: pa.StructArray):
        node, root, fp, bands, hashes = rows.flatten()
        numbers = lambda lists, width: lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(len(rows), width)
        self.node, self.root = node.to_numpy(zero_copy_only=False), root.to_numpy(zero_copy_only=False)
        self.fp, self.bands = numbers(fp, WORDS), numbers(bands, BANDS)
        self.hashes = hashes.flatten().to_numpy(zero_copy_only=False).view(np.uint64)  # ascending as such
        self.sizes = hashes.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])


def links_between(key: int, left: Block, right: Block, similarity: float, least: float) -> list[tuple[int, int]]:
    """Pairs of nodes of different roots that reach the similarity, of those whose first common key is this one."""
    same = left.bands[:, None, :] == right.bands[None, :, :]
    first = np.take_along_axis(np.broadcast_to(left.bands[:, None, :], same.shape), same.argmax(axis=2)[:, :, None], 2)[:, :, 0]
    differ = np.bitwise_count(left.fp[:, None, :] ^ right.fp[None, :, :]).astype(np.int16)
    most, chain, start = bits_at(least), differ.copy(), np.ones(differ.shape, bool)
    for l in range(1, CHAIN + 1):
        start &= chain <= l * most // WORDS
        chain += np.roll(differ, -l, axis=2)
    sizes = left.sizes[:, None] + right.sizes[None, :]
    shared = np.cos(differ.sum(axis=2) * (np.pi / (64 * WORDS))) * np.sqrt(left.sizes[:, None] * right.sizes[None, :].astype(np.float64))
    likely = (first == np.int64(key).view(np.uint64)) & (left.root[:, None] != right.root[None, :]) & start.any(axis=2) & (shared >= least * (sizes - shared))
    out = []
    for i in np.flatnonzero(likely.any(axis=1)):
        own = left.hashes[left.starts[i] : left.starts[i + 1]]
        others = np.flatnonzero(likely[i])
        flat = np.concatenate([right.hashes[right.starts[j] : right.starts[j + 1]] for j in others])
        found = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
        common = np.add.reduceat(found, np.concatenate([[0], np.cumsum(right.sizes[others])[:-1]]), dtype=np.int64)
        reached = common >= similarity * (sizes[i, others] - common)
        out += [(min(x, y), max(x, y)) for x, y in ((int(left.node[i]), int(right.node[j])) for j in others[reached])]
    return out


def block_links(split: DataFrame, placed: DataFrame, rooted: DataFrame, sets: Callable[[DataFrame], DataFrame], similarity: float, least: float) -> DataFrame:
    """Links between components that meet in a bucket, decided by exact similarity: members outside the bucket's
    largest component against all, both in the numbers of blocks that split gives, so that a bucket of any size is
    many pairs of small blocks and no pair of texts is a row."""
    inside = materialise(placed.join(split, "key"))
    held = rooted.select("node", "fp", "bands").join(sets(inside.select("node").distinct()), "node")
    whole = materialise(inside.join(held, "node").select("key", "top", "root", *(c for c in inside.columns if c.startswith("blocks_")), F.struct("node", "root", "fp", "bands", "hashes").alias("m")))

    def blocks(some: DataFrame, name: str) -> DataFrame:
        number = F.pmod(F.xxhash64("m.node", F.lit(name)), F.col(f"blocks_{name}"))
        return some.groupBy("key", number.alias(name)).agg(F.collect_list("m").alias(f"rows_{name}"))

    met = blocks(whole.where("root <> top"), "a").join(blocks(whole, "b"), "key").select("key", "rows_a", "rows_b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for i, key in enumerate(batch.column(0).to_pylist()):
                found += links_between(key, Block(batch.column(1)[i].values), Block(batch.column(2)[i].values), similarity, least)
            yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    spark = split.sparkSession
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, 8)  # a row has two blocks
    try:
        links = materialise(met.mapInArrow(compare, "a long, b long").distinct())
    finally:
        spark.conf.set(size, before)
    forget(inside)
    forget(whole)
    return links


def near_duplicate_links(nodes: DataFrame, sets: Callable[[DataFrame], DataFrame], similarity: float, margin: float = 0.1, crowd: int = 16, block: int = 64) -> DataFrame:
    """Links (a, b) between nodes (node, fp, bands, shingles) that connect what is similar; sets: gives (node, hashes)
    of the nodes of a table; margin: how far under the similarity an estimate may be for its pair to be compared
    exactly; crowd: members of a bucket from which on its majority is asked for a second hub, block: members of a
    block (both change the work, never which pairs can be found)."""
    least, hashes = similarity - margin, 20_000
    keyed = nodes.select("node", "shingles", F.col("fp")[0].alias("word"), F.explode("bands").alias("key"))
    shared = materialise(keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("hub")).where("n > 1"))
    members = materialise(sieved(keyed, "key", shared, "met").where("met").drop("met").join(shared, "key"))
    forget(shared)
    crowded = members.where(F.col("n") >= crowd).select("key", "node", "word")
    second_hub = materialise(central_members(crowded))
    met = members.select("node", "hub").unionAll(crowded.join(second_hub, "key").select("node", "hub")).where("node <> hub").distinct()
    side = lambda name: nodes.select(F.col("node").alias(name), F.struct("fp", "shingles").alias(f"{name}_"))
    compared = met.join(side("node"), "node").join(side("hub"), "hub").where(similar(F.col("node_"), F.col("hub_"), least))
    # A text's most similar hub; of two that choose each other, one pair is left.
    best = compared.groupBy("node").agg(F.max(F.struct(estimate(F.col("node_"), F.col("hub_")).alias("e"), "hub")).alias("best"))
    pairs = materialise(best.select(F.least("node", "best.hub").alias("a"), F.greatest("node", "best.hub").alias("b")).distinct())
    first = verified(pairs, sets, similarity)
    forget(pairs)

    rooted = materialise(nodes.join(connected_components(first, "a", "b"), "node", "left").withColumn("root", F.coalesce("root", "node")))
    placed = materialise(members.select("key", "node", "shingles").join(rooted.select("node", "root"), "node"))
    forget(members)
    by_root = placed.groupBy("key", "root").agg(F.count("*").alias("n"), F.sum("shingles").alias("s"))
    by_key = by_root.groupBy("key").agg(F.count("*").alias("roots"), F.max(F.struct("n", "root", "s")).alias("top"), F.sum("n").alias("n"), F.sum("s").alias("s")).where("roots > 1")
    number = lambda n, s: F.ceil(F.greatest(n / block, s / hashes))
    split = materialise(by_key.select("key", F.col("top.root").alias("top"), number(F.col("n") - F.col("top.n"), F.col("s") - F.col("top.s")).alias("blocks_a"), number(F.col("n"), F.col("s")).alias("blocks_b")))
    second = block_links(split, placed, rooted, sets, similarity, least)
    forget(placed)
    forget(rooted)
    return first.unionAll(second)


def keep_one_of_each_group(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """df without all but one row of each group: the row of the least id (a null id only if there is no other)."""
    text_key = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")), F.lit(1))
    row_key = F.xxhash64(F.col(id_col), text_key)
    made = df.select(F.col(id_col).alias("id"), row_key.alias("row"), text_key.alias("text"), long_fingerprint(F.col(text_col), shingle).alias("p"))
    rows = materialise(made.select("id", "row", "text", F.col("p.digest").alias("node"), "p.fp", "p.bands", "p.shingles"))
    nodes = materialise(rows.groupBy("node").agg(F.first(F.struct("fp", "bands", "shingles")).alias("p")).select("node", "p.*"))

    def sets(wanted: DataFrame) -> DataFrame:
        """(node, hashes): the set of one text of each wanted node."""
        one = materialise(rows.select("node", "row").join(wanted, "node", "left_semi").groupBy("node").agg(F.min("row").alias("row")))
        texts = sieved(df.select(row_key.alias("row"), F.col(text_col).alias("text")), "row", one, "wanted").where("wanted").join(one, "row")
        return texts.select("node", hash_set(F.col("text"), shingle).alias("hashes")).groupBy("node").agg(F.first("hashes").alias("hashes"))

    roots = connected_components(near_duplicate_links(nodes, sets, similarity), "a", "b")
    placed = rows.select("id", "row", "text", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    best = placed.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row", "text")).alias("best"))
    row, text, sifted = free_name(df, "_row"), free_name(df, "_text"), free_name(df, "_sifted")
    kept = materialise(best.select(F.col("best.row").alias(row), F.col("best.text").alias(text)))
    # Rows that go, and repeated ones: the few that must meet others. All other rows stay where they are.
    times = rows.groupBy(F.col("row").alias(row), F.col("text").alias(text)).agg(F.count("*").alias("n"))
    lone = times.where("n = 1").join(kept, [row, text], "left_semi")
    sought = materialise(rows.select(F.col("row").alias(row), F.col("text").alias(text)).join(lone, [row, text], "left_anti"))
    forget(nodes)
    forget(rows)
    keyed = sieved(df.withColumns({row: row_key, text: text_key}), row, sought, sifted)
    met = keyed.where(sifted).join(kept, [row, text], "left_semi").dropDuplicates([row, text])
    return keyed.where(~F.col(sifted)).drop(row, text, sifted).unionAll(met.drop(row, text, sifted))
