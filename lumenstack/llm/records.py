"""Length-delimited binary records with a separate offset index.

A shard file holds one record after another: the payload's length (8 bytes), a masked checksum of those
8 bytes (4), the payload, a masked checksum of the payload (4); all little-endian. The checksum is CRC-32
(zlib), masked by a rotation and an added constant. The payload is the document's id (8 bytes, signed), a
flag byte (1: the id is null) and the token ids, 2 bytes each if all are below 65,536, else 4. The index
file beside it has a row of 4 unsigned 64-bit numbers for each record: offset, frame length, ids before
it in the shard, ids in it. So a reader can seek to any record of a shuffled order.

Shards are ranges of document ids in ascending order (null first), records ascend within a shard; rows
with equal ids keep all their records, ordered by a hash of the text and the text. A null text is an empty one: its
record has the closing id alone. An empty table writes no records and reads back as no rows. The two files of a shard
have the number of the task's attempt in their name, and the manifest, which Spark commits once a task, tells which
attempt counts; files of lost attempts are in no manifest and are never read.
"""

from __future__ import annotations

import functools
import itertools
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenstack.llm.common import slices

#: Fixed values of the checksum mask.
MASK_SHIFT, MASK_ADD = 15, 0xA282EAD8
HEAD = struct.Struct("<qB")
#: White space, as RE2 writes it. A space between other white space is one that tokens may reach over.
SPACE = r"[\s\x0b\x1c-\x1f\x{85}\pZ]"
#: Where tokens always part: a line's end between words or marks, and marks after a letter.
CUTS = ((r"([A-Za-z.,;:!?])\n([A-Za-z])", "\\1\0\n\0\\2"), (r"([A-Za-z])([.,;:!?])", "\\1\0\\2"))
#: Chunks of more characters are not kept.
LONG_CHUNK = 64
MANIFEST = "shard int, path string, records long, ids long, width int"
RECORD = "doc_id long, start long, n_tokens long, ids array<int>, ids_crc32 long"


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return ((c >> MASK_SHIFT | c << 32 - MASK_SHIFT) + MASK_ADD) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload))))


def payload_of(doc: int | None, ids: np.ndarray) -> bytes:
    return HEAD.pack(doc or 0, doc is None) + ids.tobytes()


def unframe(data: memoryview) -> bytes:
    """The payload; ValueError if a checksum or the length is wrong."""
    (n,), (check,) = struct.unpack_from("<Q", data), struct.unpack_from("<I", data, 8)
    if check != masked(bytes(data[:8])) or len(data) != n + 16:
        raise ValueError("a record's length is damaged")
    payload = bytes(data[12 : 12 + n])
    if struct.unpack_from("<I", data, 12 + n)[0] != masked(payload):
        raise ValueError("a record's payload is damaged")
    return payload


class ChunkEncoder:
    """Encodes with the tokenizers library under a byte-level tokenizer, whose tokens start at most one space
    early: chunks that each begin at a space stand alone. A batch's chunks are told apart by Arrow, and the ids of
    those of up to LONG_CHUNK characters are kept in two generations of `limit` chunks each. New chunks go to the
    library as one text: a chunk's first token is the one that begins with its space; words without a space stand on
    lines. Chunks are cut further where the tokenizer always parts (CUTS). Texts with special tokens,
    with runs of spaces, or with a space between other white space go to the library whole."""

    def __init__(self, path: str, limit: int):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the threads
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.whole = "|".join(["  ", r"\x00", f"{SPACE} {SPACE}", *map(re.escape, special)])
        self.starts = np.zeros(1 + max(self.tokenizer.get_vocab().values()), bool)
        self.starts[[i for token, i in self.tokenizer.get_vocab().items() if token.startswith("Ġ")]] = True
        self.ends_line = np.zeros_like(self.starts)
        self.ends_line[self.tokenizer.get_vocab()["Ċ"]] = True
        self.limit, self.young, self.old = limit, {}, {}

    def encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def learn(self, chunks: list[str]) -> dict[str, bytes]:
        """The ids of chunks."""
        spaced = [c for c in chunks if len(c) > 1 and c[0] == " " and not c[1].isspace()]
        bare, found = [c for c in chunks if c.isalpha()], {}
        for own, between, opens in ((spaced, "", self.starts), (bare, "\n", self.ends_line)):
            data = self.encode(between.join([*own, ""]))
            at = 4 * (np.flatnonzero(opens[np.frombuffer(data, "<u4")]) + len(between))
            starts = at.tolist() if not between else [0, *at[:-1].tolist()]
            ends = [*at[1:].tolist(), len(data)] if not between else (at - 4).tolist()
            if len(at) == len(own):
                found.update(zip(own, [data[a:b] for a, b in zip(starts, ends)]))
        if len(found) < len(chunks):
            found.update((c, self.encode(c)) for c in chunks if c not in found)
        return found

    def of_chunks(self, chunks: list[str]) -> list[bytes]:
        """The ids of distinct chunks."""
        out = list(map(self.young.get, chunks))
        missing = [i for i, x in enumerate(out) if x is None]
        if len(self.young) + len(missing) > self.limit:
            self.young, self.old = {}, self.young
        wanted = [chunks[i] for i in missing]
        known = list(map(self.old.get, wanted))
        new = self.learn([c for c, x in zip(wanted, known) if x is None])
        for i, c, x in zip(missing, wanted, known):
            out[i] = x = new[c] if x is None else x
            if len(c) <= LONG_CHUNK:
                self.young[c] = x
        return out

    def encode_batch(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text."""
        texts = pc.fill_null(texts, "")
        whole = pc.match_substring_regex(texts, self.whole)
        marked = pc.replace_substring(texts.filter(pc.invert(whole)), " ", "\0 ")
        for pattern, apart in CUTS:
            marked = pc.replace_substring_regex(marked, pattern, apart)
        split = pc.split_pattern(marked, "\0")
        coded = split.flatten().dictionary_encode()
        joined = pc.binary_join(pa.ListArray.from_arrays([0, len(coded.dictionary)], coded.dictionary), "\0")[0].as_py()
        parts = self.of_chunks(joined.split("\0") if len(coded.dictionary) else [])
        flat, sizes = np.frombuffer(b"".join(parts), "<u4"), np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        chunk = coded.indices.to_numpy()
        own, first = sizes[chunk], (np.cumsum(sizes) - sizes)[chunk]
        ends = np.cumsum(own)
        ids = flat[np.repeat(first - ends + own, own) + np.arange(ends[-1] if len(ends) else 0)]
        bounds = np.append(0, ends)[np.append(0, np.cumsum(split.value_lengths().to_numpy()))]
        rest = iter(np.split(ids, bounds[1:-1]))
        alone = iter(texts.filter(whole).to_pylist())
        return [np.frombuffer(self.encode(next(alone)), "<u4") if w else next(rest) for w in whole.to_pylist()]


@functools.lru_cache(4)
def encoder(path: str, limit: int) -> ChunkEncoder:
    return ChunkEncoder(path, limit)


def write_records(df: DataFrame, folder: str, path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", ids_per_record_width: int = 2, partitions: int | None = None, cache_chunks: int = 600_000) -> DataFrame:
    """Encodes the texts, adds end_id to each and writes shards to folder; returns the manifest, a row a shard.

    folder: a URI that all executors share. ids_per_record_width: bytes an id, 2 or 4.
    """
    kind = {2: "<u2", 4: "<u4"}[ids_per_record_width]

    def encoded(batch: pa.RecordBatch) -> Iterator[tuple[int | None, np.ndarray]]:
        docs, at = batch.column(0).to_pylist(), 0
        for texts in slices(batch.column(1), 4_000_000):
            yield from zip(docs[at : at + len(texts)], encoder(path, cache_chunks).encode_batch(texts))
            at += len(texts)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        shard, attempt = context.partitionId(), context.taskAttemptId()
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        name = f"shard-{shard:06d}-{attempt}"
        at = before = records = 0
        with fs.open_output_stream(f"{root}/{name}.rec") as data, fs.open_output_stream(f"{root}/{name}.idx") as index:
            for batch in batches:
                for doc, ids in encoded(batch):
                    ids = np.append(ids, np.uint32(end_id))
                    if ids.max() >> 8 * ids_per_record_width:
                        raise ValueError(f"id {ids.max()} needs more than {ids_per_record_width} bytes")
                    out = frame(payload_of(doc, ids.astype(kind)))
                    data.write(out)
                    index.write(struct.pack("<4Q", at, len(out), before, len(ids)))
                    at, before, records = at + len(out), before + len(ids), records + 1
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [f"{folder}/{name}"], "records": pa.array([records]), "ids": pa.array([before]), "width": pa.array([ids_per_record_width], pa.int32())})

    doc = F.col(id_col).cast("long").alias("doc_id")
    rows = df.select(doc, F.col(text_col).alias("text"))
    order = ["doc_id", F.xxhash64("text"), "text"]  # rows of one id may fill several shards
    ranged = rows.repartitionByRange(partitions, *order[:2]) if partitions else rows.repartitionByRange(*order[:2])
    manifest = ranged.sortWithinPartitions(*order).mapInArrow(write, MANIFEST)
    manifest.write.parquet(f"{folder}/manifest")
    return df.sparkSession.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_records(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """The records of all shards in folder, checksums verified: doc_id, start (ids of all records before),
    n_tokens, ids (null unless with_ids) and ids_crc32 (of the ids as unsigned 32-bit numbers)."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").where("records > 0")
    so_far = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    placed = manifest.select("shard", "path", "width", F.coalesce(F.sum("ids").over(so_far), F.lit(0)).alias("base"))
    shards = placed.repartition(max(1, manifest.count()), "shard")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from _read_shard(row["path"], row["width"], row["base"], with_ids)

    return shards.select("path", "width", "base").mapInArrow(read, RECORD)


def _read_shard(path: str, width: int, base: int, with_ids: bool, at_once: int = 1024) -> Iterator[pa.RecordBatch]:
    fs, root = pafs.FileSystem.from_uri(path)
    with fs.open_input_stream(f"{root}.idx") as f:
        index = np.frombuffer(f.read(), "<u8").reshape(-1, 4)
    with fs.open_input_stream(f"{root}.rec") as f:
        for i in range(0, len(index), at_once):
            part = index[i : i + at_once]
            block = memoryview(f.read(int(part[:, 1].sum())))
            first, docs, crcs, lists = int(part[0, 0]), [], [], []
            for offset, length in part[:, :2].tolist():
                payload = unframe(block[offset - first : offset - first + length])
                doc, missing = HEAD.unpack_from(payload)
                ids = np.frombuffer(payload, f"<u{width}", offset=HEAD.size).astype("<u4")
                docs.append(None if missing else doc)
                crcs.append(zlib.crc32(ids))
                if with_ids:
                    lists.append(ids.astype(np.int32))
            n = len(docs)
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(docs, pa.int64()), "start": pa.array(part[:, 2].astype(np.int64) + base), "n_tokens": pa.array(part[:, 3].astype(np.int64)), "ids": pa.array(lists if with_ids else [None] * n, pa.list_(pa.int32())), "ids_crc32": pa.array(crcs, pa.int64())})


def read_at(path: str, number: int, width: int = 2) -> tuple[int | None, np.ndarray]:
    """One record of a shard by its number, by two seeks: its document's id and token ids."""
    fs, root = pafs.FileSystem.from_uri(path)
    with fs.open_input_file(f"{root}.idx") as f:
        offset, length, _, _ = struct.unpack("<4Q", f.read_at(32, 32 * number))
    with fs.open_input_file(f"{root}.rec") as f:
        payload = unframe(memoryview(f.read_at(length, offset)))
    doc, missing = HEAD.unpack_from(payload)
    return None if missing else doc, np.frombuffer(payload, f"<u{width}", offset=HEAD.size)
