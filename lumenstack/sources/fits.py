"""FITS frames as rows, and rows as FITS files.

Files are read by Spark's binaryFile source, so that any store that Spark reads will do; one file is one row.
The first image unit is taken, SCI, IMAGE or PRIMARY before others. Layouts CHW and HWC are told apart by the axis
of 1, 3 or 4 beside two of over 4; data come out row-major with channels last. BSCALE and BZERO are applied, NaN
and infinities are null. A file that cannot be read gives a row with null data and the reason in `error`, and with its
header if that could be read.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenstack.functions import wcs

#: Fixed values of the format.
BLOCK, CARD = 2880, 80
KINDS = {8: ">u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}
PREFERRED = ("SCI", "IMAGE", "PRIMARY")
FRAME = "h int, w int, c int, data array<float>, header map<string,string>, error string"


def cards(data: bytes, at: int) -> tuple[dict[str, str], int]:
    """The header unit at a position and where its data begin; continued strings are joined."""
    header: dict[str, str] = {}
    last = None
    while True:
        block = data[at : at + BLOCK]
        if len(block) < BLOCK:
            raise ValueError("the header has no end")
        at += BLOCK
        for i in range(0, BLOCK, CARD):
            card = block[i : i + CARD].decode("ascii", "replace")
            key = card[:8].rstrip()
            if key == "END":
                return header, at
            if key == "CONTINUE" and last:
                header[last] = header[last].rstrip("&") + text_value(card[8:])
            elif card[8:10] == "= ":
                header[key], last = text_value(card[10:]), key


def text_value(field: str) -> str:
    field = field.strip()
    if field.startswith("'"):
        out, i = [], 1
        while i < len(field):
            if field[i] == "'":
                if field[i + 1 : i + 2] != "'":
                    break
                i += 1
            out.append(field[i])
            i += 1
        return "".join(out).rstrip()
    return field.split("/", 1)[0].strip()


def units(data: bytes) -> Iterator[tuple[dict[str, str], int, int]]:
    """(header, start of data, bytes of data) of each unit."""
    at = 0
    while at + BLOCK <= len(data):
        header, at = cards(data, at)
        axes = [int(header[f"NAXIS{i + 1}"]) for i in range(int(header.get("NAXIS", 0)))]
        size = int(np.prod(axes)) * abs(int(header["BITPIX"])) // 8 if axes else 0
        size += int(header.get("PCOUNT", 0))
        yield header, at, size
        at += -(-size // BLOCK) * BLOCK


def image_unit(data: bytes) -> tuple[dict[str, str], int]:
    """Header and start of data of the unit to read: SCI, IMAGE or PRIMARY before others."""
    found = [u for u in units(data) if int(u[0].get("NAXIS", 0)) in (2, 3) and u[2] and u[0].get("XTENSION", "IMAGE") == "IMAGE"]
    if not found:
        raise ValueError("no image")
    name = lambda u: u[0].get("EXTNAME", "" if "XTENSION" in u[0] else "PRIMARY").upper()
    header, at, _ = min(found, key=lambda u: PREFERRED.index(name(u)) if name(u) in PREFERRED else len(PREFERRED))
    return header, at


def pixels_of(data: bytes, header: dict[str, str], at: int) -> np.ndarray:
    """(H, W, C) doubles."""
    shape = tuple(int(header[f"NAXIS{i}"]) for i in range(int(header["NAXIS"]), 0, -1))
    image = np.frombuffer(data, KINDS[int(header["BITPIX"])], int(np.prod(shape)), at).astype(np.float64)
    if "BLANK" in header and int(header["BITPIX"]) > 0:
        image[image == int(header["BLANK"])] = np.nan
    image = (image * float(header.get("BSCALE", 1)) + float(header.get("BZERO", 0))).reshape(shape)
    if image.ndim == 2:
        return image[:, :, None]
    if image.shape[0] in (1, 3, 4) and min(image.shape[1:]) > 4:
        return image.transpose(1, 2, 0)
    if image.shape[2] in (1, 3, 4) and min(image.shape[:2]) > 4:
        return image
    raise ValueError(f"no layout of channels in {shape}")


def _rows(found: list[tuple[np.ndarray | None, dict[str, str] | None, str | None]]) -> pa.Array:
    """FRAME structs; samples that are not finite are null."""
    flat = [np.zeros(0, np.float32) if i is None else i.astype(np.float32).ravel() for i, _, _ in found]
    values = np.concatenate([*flat, np.zeros(0, np.float32)])
    missing = np.array([i is None for i, _, _ in found], bool)
    ends = pa.array(np.cumsum([0, *map(len, flat)], dtype=np.int32), mask=np.append(missing, False))
    data = pa.ListArray.from_arrays(ends, pa.array(values, mask=~np.isfinite(values)))
    side = lambda n: pa.array([None if i is None else i.shape[n] for i, _, _ in found], pa.int32())
    headers = pa.array([None if h is None else list(h.items()) for _, h, _ in found], pa.map_(pa.string(), pa.string()))
    return pa.StructArray.from_arrays([side(0), side(1), side(2), data, headers, pa.array([e for _, _, e in found], pa.string())], ["h", "w", "c", "data", "header", "error"])


def read_fits(spark: SparkSession, path: str, glob: str = "*.fit*", exclude: str = "stacked") -> DataFrame:
    """(path, h, w, c, data, header, error) of each file below path, but those in a folder of the excluded name below it."""

    def run(contents: pa.Array) -> pa.Array:
        found = []
        for content in contents:
            header = None
            try:
                data = content.as_py()
                header, at = image_unit(data)
                found.append((pixels_of(data, header, at), header, None))
            except (ValueError, KeyError) as e:
                found.append((None, header, f"{type(e).__name__}: {e}"))
        return _rows(found)

    files = _listed(spark, path, glob, exclude)
    return files.select("path", F.arrow_udf(run, FRAME)("content").alias("f")).select("path", "f.*")


def _listed(spark: SparkSession, path: str, glob: str, exclude: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    below = F.substring_index("path", path.rstrip("/").split(":")[-1].lstrip("/") + "/", -1)
    return files.where(~below.rlike(f"(^|/){exclude}/")) if exclude else files


def read_headers(spark: SparkSession, path: str, glob: str = "*.fit*", exclude: str = "stacked", most: int = 200) -> DataFrame:
    """(path, h, w, header, error) of each file's image unit, of which only header blocks are read (at most so many); a
    file may lack its SIMPLE card."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name in batch.column(0).to_pylist():
                row = {"path": name, "h": None, "w": None, "header": None, "error": None}
                try:
                    fs, root = pafs.FileSystem.from_uri(name.replace("file:/", "file:///", 1) if name.startswith("file:/") and not name.startswith("file:///") else name)
                    with fs.open_input_file(root) as f:
                        header, at = _first_image(f, most)
                    row |= {"h": int(header["NAXIS2"]), "w": int(header["NAXIS1"]), "header": list(header.items())}
                except (ValueError, KeyError, OSError) as e:
                    row["error"] = f"{type(e).__name__}: {e}"
                rows.append(row)
            kind = pa.schema([("path", pa.string()), ("h", pa.int32()), ("w", pa.int32()), ("header", pa.map_(pa.string(), pa.string())), ("error", pa.string())])
            yield pa.RecordBatch.from_pylist(rows, kind)

    return _listed(spark, path, glob, exclude).select("path").mapInArrow(run, "path string, h int, w int, header map<string,string>, error string")


def _first_image(f, most: int) -> tuple[dict[str, str], int]:
    """Header and start of data of the first unit with an image, by reads of whole blocks."""
    at, end = 0, f.size()
    while at < end:
        held = b""
        while len(held) < most * BLOCK:
            block = f.read_at(BLOCK, at + len(held))
            held += block
            if len(block) < BLOCK or any(block[i : i + 8].rstrip() == b"END" for i in range(0, BLOCK, CARD)):
                break
        header, size = cards(held, 0)
        at += size
        axes = [int(header[f"NAXIS{i + 1}"]) for i in range(int(header.get("NAXIS", 0)))]
        if len(axes) in (2, 3) and header.get("XTENSION", "IMAGE") == "IMAGE":
            return header, at
        length = (int(np.prod(axes)) * abs(int(header["BITPIX"])) // 8 if axes else 0) + int(header.get("PCOUNT", 0))
        at += -(-length // BLOCK) * BLOCK
    raise ValueError("no image")


def read_npy(spark: SparkSession, path: str, glob: str = "*.npy") -> DataFrame:
    """(path, h, w, c, data, header, error) of NumPy array files of two or three dimensions, channels last."""

    def run(contents: pa.Array) -> pa.Array:
        found = []
        for content in contents:
            try:
                image = np.load(io.BytesIO(content.as_py()), allow_pickle=False)
                if image.ndim not in (2, 3):
                    raise ValueError(f"{image.ndim} dimensions")
                found.append((image.astype(np.float64).reshape(*image.shape[:2], -1), {}, None))
            except (ValueError, EOFError) as e:
                found.append((None, None, f"{type(e).__name__}: {e}"))
        return _rows(found)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return files.select("path", F.arrow_udf(run, FRAME)("content").alias("f")).select("path", "f.*")


def normalised(frames: DataFrame) -> DataFrame:
    """frames with data in [0, 1] by their own extremes, missing samples being 0 before; a constant image is 0.5, one
    without any sample 0. Rows without data keep their header and error."""
    some = F.exists("data", lambda v: v.isNotNull())
    filled = F.transform("data", lambda v: F.coalesce(v, F.lit(0.0).cast("float")).cast("double"))
    held = frames.withColumns({"_some": some, "_d": filled}).withColumns({"_lo": F.array_min("_d"), "_hi": F.array_max("_d")})
    value = F.when(~F.col("_some"), F.transform("_d", lambda v: F.lit(0.0))).when(F.col("_hi") > F.col("_lo"), F.transform("_d", lambda v: (v - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))).otherwise(F.transform("_d", lambda v: F.lit(0.5)))
    return held.withColumn("data", value.cast("array<float>")).drop("_some", "_d", "_lo", "_hi")


def three_channels(frames: DataFrame) -> DataFrame:
    """Normalised mono frames as three equal channels in 256 levels; others as they are."""
    level = lambda v: (F.floor(v * 255) / 255).cast("float")
    copies = F.flatten(F.transform("data", lambda v: F.array(level(v), level(v), level(v))))
    return frames.withColumns({"data": F.when(F.col("c") == 1, copies).otherwise(F.col("data")), "c": F.when(F.col("c") == 1, 3).otherwise(F.col("c"))})


def drizzle_inputs(frames: DataFrame) -> DataFrame:
    """Frames of three channels with celestial coordinates in their header; of others data and header are null."""
    number = lambda k: F.try_element_at("header", F.lit(k)).cast("double")
    ok = (F.col("c") == 3) & wcs.is_celestial({"cd11": number("CD1_1"), "cd12": F.coalesce(number("CD1_2"), F.lit(0.0)), "cd21": F.coalesce(number("CD2_1"), F.lit(0.0)), "cd22": number("CD2_2")})
    good = F.coalesce(ok, F.lit(False))
    return frames.withColumns({"data": F.when(good, F.col("data")), "header": F.when(good, F.col("header"))})


def image_bytes(image: np.ndarray, header: dict[str, str], u16: bool) -> bytes:
    """A file with one image unit: 32-bit floats, or clip(v, 0, 1) * 65535 truncated, as 16-bit with BZERO."""
    planes = image.transpose(2, 0, 1) if image.shape[2] > 1 else image[:, :, 0]
    axes = planes.shape[::-1]
    own: list[tuple[str, object]] = [("SIMPLE", "T"), ("BITPIX", 16 if u16 else -32), ("NAXIS", len(axes)), *((f"NAXIS{i + 1}", n) for i, n in enumerate(axes))]
    if u16:
        own += [("BSCALE", 1), ("BZERO", 32768)]
        data = (np.trunc(np.clip(np.nan_to_num(planes), 0, 1) * 65535) - 32768).astype(">i2").tobytes()
    else:
        data = planes.astype(">f4").tobytes()
    structural = {k for k, _ in own} | {"EXTEND", "BSCALE", "BZERO", "BLANK", "XTENSION", "PCOUNT", "GCOUNT"}
    lines = [f"{k:<8}= {v!s:>20}" for k, v in own] + [f"{k[:8].upper():<8}= {_card_value(v):>20}"[:CARD] for k, v in header.items() if k.upper() not in structural]
    head = "".join(f"{x:<{CARD}}" for x in [*lines, "END"]).encode("ascii", "replace")
    return head + b" " * (-len(head) % BLOCK) + data + bytes(-len(data) % BLOCK)


def _card_value(v: str) -> str:
    try:
        float(v)
        return v
    except ValueError:
        return v if v in ("T", "F") else "'" + v.replace("'", "''")[:66] + "'"


def write_fits(frames: DataFrame, folder: str, name: str, u16: bool = False) -> list[str]:
    """Writes each row (h, w, c, data, header) to folder/<column name>.fits, whole or not at all; the names written.

    The folder is a URI that all executors share. Only names come to the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        for batch in batches:
            names = []
            for row in batch.to_pylist():
                data = np.array([np.nan if v is None else v for v in row["data"]], np.float64).reshape(row["h"], row["w"], row["c"])
                tried, file = f"{root}/.{row['name']}-{attempt}", f"{row['name']}.fits"
                with fs.open_output_stream(tried) as f:
                    f.write(image_bytes(data, dict(row["header"] or ()), u16))
                fs.move(tried, f"{root}/{file}")
                names.append(file)
            yield pa.RecordBatch.from_pydict({"file": pa.array(names, pa.string())})

    rows = frames.select(F.col(name).cast("string").alias("name"), "h", "w", "c", "data", "header")
    return sorted(r[0] for r in rows.mapInArrow(run, "file string").collect())
