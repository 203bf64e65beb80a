"""Tiles of many images in one call of a Python function: small images would otherwise cost a call each."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Samples of a call, about: a call holds whole tiles, dealt by their hash. It changes the work, never the result.
CALL = 200_000
#: Cells of the arrays made at once.
CELLS = 1 << 20


def dealt(rows: DataFrame, tile: list[str]) -> tuple[DataFrame, str]:
    """rows with a column that deals whole tiles to calls, and its name."""
    calls = max(1, -(-rows.count() // CALL))
    return rows.withColumn("call_of_tiles", F.pmod(F.hash(*tile), F.lit(calls))), "call_of_tiles"


def reached(place: Column, tile: int, border: int, last: Column) -> Column:
    """Numbers of the tiles that a place is in or borders on."""
    first, last = F.greatest(F.floor((place - border) / tile), F.lit(0)), F.least(F.floor((place + border) / tile), last)
    return F.when(first <= last, F.sequence(first, last))


def split(table: pa.Table, tile: list[str], cells: int) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """(rows, number of each row's tile, a row of each tile) of some tiles at a time; cells: of one tile."""
    number = np.zeros(len(table), np.int64)
    for name in tile:
        own = pc.dictionary_encode(table[name].combine_chunks(), null_encoding="encode").indices.to_numpy()
        number = np.unique(number * (int(own.max(initial=0)) + 1) + own, return_inverse=True)[1]
    order = np.argsort(number, kind="stable")
    table, number = table.take(pa.array(order)), number[order]
    starts = np.flatnonzero(np.diff(number, prepend=-1))
    ends, some = np.append(starts[1:], len(number)), max(1, CELLS // cells)
    for i in range(0, len(starts), some):
        a, b = int(starts[i]), int(ends[min(i + some, len(starts)) - 1])
        yield table.slice(a, b - a), number[a:b] - i, starts[i : i + some] - a
