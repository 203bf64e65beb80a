"""Filter interaction audit: what each filter removes under every order in which the filters may run.

A row's failures are a mask of bits, one a filter. A table made beforehand holds, for each mask and each order, the step
of the first failure (32 masks by 120 orders for five filters), so a batch's rows are looked up at once and counted by
part, order, step and label with one bincount; tasks emit an array of counts a part, and the arrays are summed.

Null and empty parts are one part, named by the empty string. Null texts count as empty. A row without an id has no
smaller id beside it, so it never fails for being a copy; rows of one id are copies of each other only if another id is
smaller. An id labelled more than once is good (toxic) if any of its labels says so; unlabelled rows are neither. An
empty table has no parts and gives no rows. Texts are looked at whole, by the task that reads them; only digests travel.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenstack.work import materialise

#: The characters that filter D looks for, and A-Z.
SIGNS, CAPITALS = b"#$%&*|", bytes(range(65, 91))
#: Parts whose counts a task holds at once.
HELD_PARTS = 256


def first_failures(filters: int) -> np.ndarray:
    """table[mask, order]: the step (from 0) at which a row of that mask is removed, or `filters` if it is kept."""
    orders = np.array(list(itertools.permutations(range(filters))), np.int64)
    fails = (np.arange(2**filters)[:, None, None] >> orders[None]) & 1
    return np.where(fails.any(2), fails.argmax(2), filters)


def text_failures(text: str) -> int:
    """Bits 0 to 3: under 100 words; under 80 distinct words of 100; over 10 capitals of 100 code points; a sign."""
    data = text.encode()
    words = data.split()
    capitals = len(data) - len(data.translate(None, CAPITALS))
    few, repeated = len(words) < 100, 100 * len(set(words)) < 80 * len(words)
    signs = len(data.translate(None, SIGNS)) < len(data)
    return few | repeated << 1 | (100 * capitals > 10 * len(text)) << 2 | signs << 3


def failure_masks(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(id, part, mask) of each row of df: text_failures(), and bit 4 if a smaller id has the same text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(2).to_pylist()]
            masks, digests = [text_failures(t) for t in texts], [hashlib.sha256(t.encode()).digest() for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(masks, pa.int32()), pa.array(digests, pa.binary())], ["id", "part", "mask", "digest"])

    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.col(text_col).alias("text"))
    light = materialise(rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, part string, mask int, digest binary"))
    # A row that is not the first of its text is a copy. The first's id is part of the key, so no key is crowded.
    firsts = light.groupBy("digest").agg(F.min("id").alias("id")).select("id", "digest", F.lit(True).alias("is_first"))
    known = light.where(F.col("id").isNotNull()).join(firsts, ["id", "digest"], "left")
    copies = known.select("id", "part", F.when(F.col("is_first"), F.col("mask")).otherwise(F.col("mask") + 16).alias("mask"))
    return copies.unionByName(light.where(F.col("id").isNull()).select("id", "part", "mask"))


def with_labels(masks: DataFrame, labels: DataFrame, id_col: str, good: Column, toxic: Column) -> DataFrame:
    """masks with boolean columns good and toxic by id; rows without an id need no join and get false."""
    by_id = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(good).alias("good"), F.max(toxic).alias("toxic"))
    marked = masks.where(F.col("id").isNotNull()).join(by_id, "id", "left").unionByName(masks.where(F.col("id").isNull()), allowMissingColumns=True)
    return marked.fillna(False, ["good", "toxic"])


def audit(rows: DataFrame, filters: str = "ABCDE") -> DataFrame:
    """One row per part, order of filters and step.

    rows: part string, mask int (bit i: fails filter i), good and toxic boolean, none of them null. Counts within the part: kept
    after the step, removed there, redundant (failing its filter but removed earlier), unique_fails (failing no other
    filter), good_lost, toxic_lost, and shapley, the removals of its filter summed over all orders.
    """
    n = len(filters)
    steps, orders, masks = n + 1, math.factorial(n), 2**n
    table = first_failures(n)
    removals, width = orders * steps * 4, orders * steps * 4 + masks * 4

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def emit() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.list_(pa.int64()))], ["part", "counts"])
            held.clear()
            return out

        for b in batches:
            coded = b.column("part").dictionary_encode()
            code, names = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
            mask = b.column("mask").to_numpy().astype(np.int64)
            label = sum(pc.cast(b.column(c), pa.int64()).to_numpy() << k for k, c in enumerate(("good", "toxic")))
            for low in range(0, len(names), HELD_PARTS):
                some = (code >= low) & (code < low + HELD_PARTS)
                p, m, k = code[some] - low, mask[some], label[some]
                here = min(HELD_PARTS, len(names) - low)
                cell = ((p[:, None] * orders + np.arange(orders)) * steps + table[m]) * 4 + k[:, None]
                removed = np.bincount(cell.ravel(), minlength=here * removals).reshape(here, removals)
                failing = np.bincount((p * masks + m) * 4 + k, minlength=here * masks * 4).reshape(here, masks * 4)
                if len(held) + here > HELD_PARTS and held:
                    yield emit()
                for name, counts in zip(names[low : low + here], np.hstack([removed, failing])):
                    held[name] = held[name] + counts if name in held else counts
        if held:
            yield emit()

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = np.array(list(itertools.permutations(range(n))), np.int64)
        names = ["".join(filters[i] for i in o) for o in places]
        bits = np.arange(masks)[:, None] >> np.arange(n) & 1
        for b in batches:
            for part, cells in zip(b.column("part").to_pylist(), b.column("cells")):
                counts = np.zeros(width, np.int64)
                counts[cells.values.field("cell").to_numpy()] = cells.values.field("n").to_numpy()
                by_label = counts[:removals].reshape(orders, steps, 4)[:, :n]
                by_mask = counts[removals:].reshape(masks, 4).sum(1)
                removed = by_label.sum(2)
                fails, alone = by_mask @ bits, by_mask[1 << np.arange(n)]
                shapley = np.bincount(places.ravel(), removed.ravel(), n).astype(np.int64)
                flat = {
                    "filter_order": np.repeat(names, n), "step": np.tile(np.arange(1, n + 1, dtype=np.int32), orders), "filter": np.array(list(filters))[places.ravel()],
                    "kept": (by_mask.sum() - removed.cumsum(1)).ravel(), "removed": removed.ravel(), "redundant": (fails[places] - removed).ravel(), "unique_fails": alone[places].ravel(),
                    "good_lost": by_label[:, :, [1, 3]].sum(2).ravel(), "toxic_lost": by_label[:, :, [2, 3]].sum(2).ravel(), "shapley": shapley[places].ravel(),
                }
                yield pa.RecordBatch.from_pydict({"part": [part] * (orders * n), **flat})

    partial = rows.select("part", "mask", "good", "toxic").mapInArrow(count, "part string, counts array<long>")
    cells = partial.select("part", F.posexplode("counts").alias("cell", "n")).where(F.col("n") > 0).groupBy("part", "cell").agg(F.sum("n").alias("n"))
    whole = cells.groupBy("part").agg(F.collect_list(F.struct("cell", "n")).alias("cells"))  # at most `width` cells
    return whole.mapInArrow(report, "part string, filter_order string, step int, filter string, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long")
