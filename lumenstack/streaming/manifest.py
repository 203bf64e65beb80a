"""What a run has done, kept beside its sums, and whether another run may go on from there.

A manifest names the settings, the finalisation mode, how many inputs of the ordered plan are in the sums, and a table of these inputs
with their size and SHA-256, made by the tasks that read them, a piece at a time. It is written to a file of another
name and then moved, so what stands there is whole, and it carries the digest of its own text. resume() refuses, with a reason, what would
give another result: an unknown form, other settings, an input processed before that has changed, moved or gone, a
damaged manifest. Inputs after the last processed one may change, and more may come. A folder without a manifest starts from 0.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenstack.sources.bands import store

#: The form of the manifests written here.
FORM = 1
PIECE = 1 << 20


def described(plan: DataFrame) -> DataFrame:
    """(position, path, size, sha256) of a plan (position, path); size and digest are null where a file cannot be read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, digests = [], []
            for path in b.column("path").to_pylist():
                digest, size = hashlib.sha256(), 0
                try:
                    fs, name = store(path)
                    with fs.open_input_stream(name) as f:
                        while piece := f.read(PIECE):
                            digest.update(piece)
                            size += len(piece)
                    sizes.append(size)
                    digests.append(digest.hexdigest())
                except (OSError, ValueError, TypeError, AttributeError):  # no path, no such store, no such file
                    sizes.append(None)
                    digests.append(None)
            yield pa.RecordBatch.from_arrays([b.column("position"), b.column("path"), pa.array(sizes, pa.int64()), pa.array(digests, pa.string())], ["position", "path", "size", "sha256"])

    rows = plan.select(F.col("position").cast("long").alias("position"), "path")
    return rows.mapInArrow(run, "position long, path string, size long, sha256 string")


def sealed(body: dict) -> bytes:
    text = json.dumps(body, sort_keys=True)
    return json.dumps({"digest": hashlib.sha256(text.encode()).hexdigest(), "body": text}).encode()


def opened(content: bytes) -> dict:
    try:
        whole = json.loads(content)
        body = whole["body"]
        if hashlib.sha256(body.encode()).hexdigest() != whole["digest"]:
            raise ValueError
        return json.loads(body)
    except (ValueError, KeyError, TypeError, AttributeError):
        raise ValueError("the manifest is damaged") from None


def save(folder: str, plan: DataFrame, settings: dict, processed: int, mode: str) -> None:
    """Records that the first `processed` inputs of the plan are in the sums of the folder."""
    name = f"inputs-{uuid.uuid4().hex}"
    described(plan.where(F.col("position") < processed)).write.parquet(f"{folder}/manifest/{name}")
    fs, root = store(folder)
    fs.create_dir(f"{root}/manifest", recursive=True)
    tried = f"{root}/manifest/.{uuid.uuid4().hex}"
    with fs.open_output_stream(tried) as f:
        f.write(sealed({"form": FORM, "settings": settings, "processed": processed, "mode": mode, "inputs": name}))
    fs.move(tried, f"{root}/manifest/manifest.json")
    for old in fs.get_file_info(pafs.FileSelector(f"{root}/manifest")):
        if old.type == pafs.FileType.Directory and old.base_name.startswith("inputs-") and old.base_name != name:
            fs.delete_dir(old.path)


def load(folder: str) -> dict | None:
    fs, root = store(folder)
    path = f"{root}/manifest/manifest.json"
    if fs.get_file_info(path).type == pafs.FileType.NotFound:
        return None
    with fs.open_input_stream(path) as f:
        return opened(f.read())


def resume(spark: SparkSession, folder: str, plan: DataFrame, settings: dict, mode: str) -> int:
    """The position from which to go on, or ValueError."""
    known = load(folder)
    if known is None:
        return 0
    if known.get("form") != FORM:
        raise ValueError(f"a manifest of form {known.get('form')}, not {FORM}")
    changed = sorted(k for k in known["settings"].keys() | settings.keys() if known["settings"].get(k) != json.loads(json.dumps(settings.get(k))))
    if changed:
        raise ValueError(f"other settings: {', '.join(changed)}")
    if known["mode"] != mode:
        raise ValueError(f"finalisation was {known['mode']}, not {mode}")
    before = spark.read.parquet(f"{folder}/manifest/{known['inputs']}")
    now = described(plan.where(F.col("position") < known["processed"]))
    same = [F.col(f"n.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("path", "size", "sha256")]
    met = before.alias("b").join(now.alias("n"), F.col("b.position") == F.col("n.position"), "full")
    other = met.where(~(same[0] & same[1] & same[2]) | F.col("n.sha256").isNull()).select(F.coalesce("b.path", "n.path").alias("path")).limit(5).collect()
    if other:
        raise ValueError(f"inputs are not what they were: {', '.join(str(r['path']) for r in other)}")
    return known["processed"]
