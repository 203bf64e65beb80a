"""Frames of FITS files as a Spark data source: batch reader by bands of rows, stream of files, and writer in two phases.

    spark.dataSource.register(FrameFiles)
    spark.read.format("frame_files").option("header", "EXPTIME,FILTER").load("file:///data/night1,file:///data/night2")

A row is a band of rows of one file: (path, y0, h, w, c, data, header, error) and a string column for each named header card;
data are the band's samples, row-major with channels last, h, w and c those of the whole frame. A file is cut into
as many bands as its size asks for when it is listed; a task reads the header and then, by seek, its own band alone, so one large
file is read by many tasks. A schema given to the reader names the columns wanted: without data no sample is read.
Filters on the path are applied to the list, filters on h, w, c, y0 and header columns before the band is read.

A stream's files get numbers in a log, in the order in which they are seen and by path within a look; an offset is how many
have numbers. A path counts once, whatever roots it lies under, after restarts too; `roots_file` may name more roots while the query runs.

A file that cannot be read gives one row with its path and the reason. An empty folder gives no rows; a missing one is an
error in batch and an empty folder for a stream. The writer moves files into place only after all tasks have ended.
"""

from __future__ import annotations

import fnmatch
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, IntegerType, MapType, StringType, StructField, StructType

from lumenstack.model import unmasked
from lumenstack.sources import fits

#: Names under which Spark and Arrow know the same store.
SCHEMES = {"s3a": "s3", "s3n": "s3", "gcs": "gs"}
FIXED = {"path": StringType(), "y0": IntegerType(), "h": IntegerType(), "w": IntegerType(), "c": IntegerType(), "data": ArrayType(FloatType()), "header": MapType(StringType(), StringType()), "error": StringType()}
BAND_BYTES = 64 << 20


def store(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI or local path, and the path in it."""
    scheme, colon, rest = uri.partition(":")
    if not colon or "/" in scheme:
        return pafs.LocalFileSystem(), uri
    if scheme == "file":
        return pafs.LocalFileSystem(), "/" + rest.lstrip("/")
    return pafs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}:{rest}")


def beside(uri: str, root: str, path: str) -> str:
    """The URI of a path found below the root of another."""
    return uri.rstrip("/") + path[len(root.rstrip("/")) :]


def listed(uris: list[str], glob: str, exclude: str, missing: bool) -> dict[str, int]:
    """Size by URI of the files of each root (a folder or a file), a path once; folders of the excluded name are left out.
    missing: whether a root that is not there is an empty one."""
    found: dict[tuple[str, str], tuple[str, int]] = {}
    for uri in uris:
        fs, root = store(uri)
        info = fs.get_file_info(root)
        if info.type == pafs.FileType.NotFound:
            if missing:
                continue
            raise FileNotFoundError(uri)
        if info.type == pafs.FileType.File:
            found.setdefault((fs.type_name, root), (uri, info.size))
            continue
        for f in fs.get_file_info(pafs.FileSelector(root, recursive=True)):
            below = f.path[len(root.rstrip("/")) + 1 :].split("/")
            hidden = any(part.startswith((".", "_")) for part in below)
            if f.type == pafs.FileType.File and fnmatch.fnmatch(below[-1], glob) and exclude not in below[:-1] and not hidden:
                found.setdefault((fs.type_name, f.path), (beside(uri, root, f.path), f.size))
    return dict(sorted(found.values()))


@dataclass
class Band(ds.InputPartition):
    path: str
    part: int
    parts: int


def image_at(f) -> tuple[dict[str, str], int]:
    """Header and start of data of the unit to read; only header blocks are read."""
    at, end, found = 0, f.size(), []
    while at + fits.BLOCK <= end:
        held = b""
        while True:
            block = f.read_at(fits.BLOCK, at + len(held))
            held += block
            if len(block) < fits.BLOCK or any(block[i : i + 8].rstrip() == b"END" for i in range(0, fits.BLOCK, fits.CARD)):
                break
        header, size = fits.cards(held, 0)
        axes = [int(header[f"NAXIS{i + 1}"]) for i in range(int(header.get("NAXIS", 0)))]
        length = (int(np.prod(axes)) * abs(int(header["BITPIX"])) // 8 if axes else 0) + int(header.get("PCOUNT", 0))
        if len(axes) in (2, 3) and length and header.get("XTENSION", "IMAGE") == "IMAGE":
            name = header.get("EXTNAME", "" if "XTENSION" in header else "PRIMARY").upper()
            found.append((fits.PREFERRED.index(name) if name in fits.PREFERRED else len(fits.PREFERRED), len(found), header, at + size))
        at += size + -(-length // fits.BLOCK) * fits.BLOCK
    if not found:
        raise ValueError("no image")
    return min(found, key=lambda u: u[:2])[2:]


def layout(header: dict[str, str]) -> tuple[int, int, int, bool]:
    """(h, w, c, whether channels are planes)."""
    shape = [int(header[f"NAXIS{i}"]) for i in range(int(header["NAXIS"]), 0, -1)]
    if len(shape) == 2:
        return shape[0], shape[1], 1, False
    if shape[0] in (1, 3, 4) and min(shape[1:]) > 4:
        return shape[1], shape[2], shape[0], True
    if shape[2] in (1, 3, 4) and min(shape[:2]) > 4:
        return shape[0], shape[1], shape[2], False
    raise ValueError(f"no layout of channels in {tuple(shape)}")


def band_of(f, header: dict[str, str], at: int, y0: int, y1: int) -> np.ndarray:
    """Samples of the rows y0 to y1 - 1 as floats, row-major with channels last."""
    h, w, c, planes = layout(header)
    kind = np.dtype(fits.KINDS[int(header["BITPIX"])])

    def part(start: int, n: int) -> np.ndarray:
        data = f.read_at(n * kind.itemsize, at + start * kind.itemsize)
        if len(data) < n * kind.itemsize:
            raise ValueError("the file ends before its data")
        return np.frombuffer(data, kind).astype(np.float64)

    if planes:
        image = np.stack([part((k * h + y0) * w, (y1 - y0) * w) for k in range(c)], axis=1).ravel()
    else:
        image = part(y0 * w * c, (y1 - y0) * w * c)
    if "BLANK" in header and int(header["BITPIX"]) > 0:
        image[image == int(header["BLANK"])] = np.nan
    return (image * float(header.get("BSCALE", 1)) + float(header.get("BZERO", 0))).astype(np.float32)


#: What a filter asks of a value that is not null.
TESTS = {
    ds.EqualTo: lambda v, f: v == f.value, ds.GreaterThan: lambda v, f: v > f.value, ds.GreaterThanOrEqual: lambda v, f: v >= f.value, ds.LessThan: lambda v, f: v < f.value, ds.LessThanOrEqual: lambda v, f: v <= f.value,
    ds.In: lambda v, f: v in f.value, ds.IsNotNull: lambda v, f: True, ds.StringStartsWith: lambda v, f: v.startswith(f.value), ds.StringEndsWith: lambda v, f: v.endswith(f.value), ds.StringContains: lambda v, f: f.value in v,
}


def passes(filters: list[ds.Filter], row: dict) -> bool:
    return all(row.get(f.attribute[0]) is not None and TESTS[type(f)](row[f.attribute[0]], f) for f in filters)


class BandReader:
    """What batch and stream share: bands of listed files, and a band's rows."""

    def __init__(self, options: dict, schema: StructType):
        self.schema, self.filters = schema, []
        self.columns = [f.name for f in schema.fields]
        self.roots = [p for p in options.get("path", "").split(",") if p]
        self.glob, self.exclude = options.get("glob", "*.fit*"), options.get("exclude", "stacked")
        self.band_bytes = int(options.get("bandBytes", BAND_BYTES))

    def bands(self, files: dict[str, int]) -> list[Band]:
        cut = self.band_bytes if "data" in self.columns or "y0" in self.columns else 1 << 62
        return [Band(path, k, n) for path, size in files.items() for n in [max(1, -(-size // cut))] for k in range(n)]

    def read(self, band: Band | None) -> Iterator[pa.RecordBatch]:
        if band is None:  # what Spark reads of a source without files
            return
        row: dict = {"path": band.path, "error": None}
        try:
            fs, path = store(band.path)
            with fs.open_input_file(path) as f:
                header, at = image_at(f)
                h, w, c, _ = layout(header)
                y0, y1 = h * band.part // band.parts, h * (band.part + 1) // band.parts
                row |= {k: v for k, v in header.items() if k not in FIXED} | {"y0": y0, "h": h, "w": w, "c": c, "header": list(header.items())}
                if y0 == y1 or not passes(self.filters, row):
                    return
                if "data" in self.columns:
                    image = band_of(f, header, at, y0, y1)
                    row["data"] = pa.array(image, pa.float32(), mask=~np.isfinite(image))
        except (ValueError, KeyError, OSError) as e:
            row = {"path": band.path, "error": f"{type(e).__name__}: {e}"}
            if band.part or not passes(self.filters, row):
                return
        arrays = []
        for field in self.schema.fields:
            value = row.get(field.name)
            if field.name == "data":
                arrays.append(pa.ListArray.from_arrays(pa.array([0, len(value)], pa.int32()), value) if value is not None else pa.array([None], pa.list_(pa.float32())))
            else:
                kind = {"header": pa.map_(pa.string(), pa.string())}.get(field.name, pa.int32() if isinstance(field.dataType, IntegerType) else pa.string())
                arrays.append(pa.array([value], kind))
        yield pa.RecordBatch.from_arrays(arrays, self.columns)


class BatchReader(BandReader, ds.DataSourceReader):
    def pushFilters(self, filters: list[ds.Filter]) -> Iterator[ds.Filter]:
        """Keeps what it can apply to the columns of a file; the rest goes back to Spark."""
        for f in filters:
            if type(f) in TESTS and len(f.attribute) == 1 and f.attribute[0] in self.columns and f.attribute[0] not in ("data", "header", "error"):
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[Band]:
        by_path = [f for f in self.filters if f.attribute[0] == "path"]
        return self.bands({p: n for p, n in listed(self.roots, self.glob, self.exclude, False).items() if passes(by_path, {"path": p})})


class StreamReader(BandReader, ds.DataSourceStreamReader):
    """Files by their number in the log, a folder with one file a look that found new ones."""

    def __init__(self, options: dict, schema: StructType):
        super().__init__(options, schema)
        if "log" not in options:
            raise ValueError("a stream needs the option log, a folder that is kept and shared")
        self.log, self.roots_file = options["log"], options.get("roots_file", options.get("rootsFile"))
        self.most = int(options.get("filesPerTrigger", 1 << 62))
        self.given = 0

    def entries(self) -> list[tuple[str, int]]:
        fs, root = store(self.log)
        if fs.get_file_info(root).type == pafs.FileType.NotFound:
            return []
        names = sorted(f.path for f in fs.get_file_info(pafs.FileSelector(root)) if f.path.endswith(".json"))
        out: list[tuple[str, int]] = []
        for name in names:
            with fs.open_input_stream(name) as f:
                out += [tuple(e) for e in json.loads(f.read())]
        return out

    def look(self) -> int:
        """Gives numbers to files that have none; how many have."""
        known = self.entries()
        roots = list(self.roots)
        if self.roots_file:
            fs, path = store(self.roots_file)
            if fs.get_file_info(path).type == pafs.FileType.File:
                with fs.open_input_stream(path) as f:
                    roots += [x for x in f.read().decode().splitlines() if x.strip()]
        seen = {store(p)[1] for p, _ in known}
        new = [(p, n) for p, n in listed(roots, self.glob, self.exclude, True).items() if store(p)[1] not in seen]
        if new:
            fs, root = store(self.log)
            fs.create_dir(root, recursive=True)
            tried = f"{root}/.{uuid.uuid4().hex}"
            with fs.open_output_stream(tried) as f:
                f.write(json.dumps(new).encode())
            fs.move(tried, f"{root}/{len(known):012d}.json")
        return len(known) + len(new)

    def initialOffset(self) -> dict:
        return {"files": 0}

    def latestOffset(self) -> dict:
        self.given = min(self.look(), self.given + self.most)
        return {"files": self.given}

    def partitions(self, start: dict, end: dict) -> list[Band]:
        self.given = max(self.given, end["files"])
        return self.bands(dict(self.entries()[start["files"] : end["files"]]))


@dataclass
class Written(ds.WriterCommitMessage):
    files: list[tuple[str, str]]


class TwoPhaseWriter(ds.DataSourceWriter):
    """Rows (name, h, w, c, data, header) as files. Tasks write below a folder of the job's own; commit moves, abort removes."""

    def __init__(self, options: dict, overwrite: bool):
        self.folder, self.u16, self.overwrite = options["path"], options.get("u16", "false").lower() == "true", overwrite
        self.job = f"_job-{uuid.uuid4().hex}"

    def write(self, iterator) -> Written:
        fs, root = store(self.folder)
        attempt = TaskContext.get().taskAttemptId()
        fs.create_dir(f"{root}/{self.job}", recursive=True)
        files = []
        for row in iterator:
            data = np.array([np.nan if v is None else v for v in row["data"]], np.float64).reshape(row["h"], row["w"], row["c"])
            content = checked(fits.image_bytes(data, dict(row["header"] or ()), self.u16))
            name, tried = f"{row['name']}.fits", f"{root}/{self.job}/{attempt}-{len(files)}"
            with fs.open_output_stream(tried) as f:
                f.write(content)
            if fs.get_file_info(tried).size != len(content):
                raise OSError(f"{name}: {fs.get_file_info(tried).size} bytes of {len(content)} are there")
            files.append((tried, name))
        return Written(files)

    def commit(self, messages: list) -> None:
        fs, root = store(self.folder)
        files = [f for m in messages if m for f in m.files]
        names = [name for _, name in files]
        twice = {n for n in names if names.count(n) > 1} if len(set(names)) < len(names) else set()
        there = {f.path.rsplit("/", 1)[-1] for f in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)) if f.type == pafs.FileType.File}
        if twice or (not self.overwrite and there & set(names)):
            self.abort(messages)
            raise ValueError(f"files of one name: {sorted(twice or there & set(names))[:5]}")
        for tried, name in files:
            fs.move(tried, f"{root}/{name}")
        if self.overwrite:
            for name in there - set(names):
                if fnmatch.fnmatch(name, "*.fits"):
                    fs.delete_file(f"{root}/{name}")
        self.abort(messages)

    def abort(self, messages: list) -> None:
        fs, root = store(self.folder)
        if fs.get_file_info(f"{root}/{self.job}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{root}/{self.job}")


def ones_sum(data: bytes, start: int = 0) -> int:
    """The sum of 32-bit words, carries added again."""
    total = start + int(np.frombuffer(data, ">u4").sum(dtype=np.uint64))
    while total >> 32:
        total = (total & 0xFFFFFFFF) + (total >> 32)
    return total


def encoded(value: int) -> str:
    """16 letters or digits whose sum, at the place of a CHECKSUM card's value, is the value's complement."""
    value ^= 0xFFFFFFFF
    columns = []
    for byte in value.to_bytes(4, "big"):
        quarter, rest = divmod(byte, 4)
        four = [quarter + 48 + rest, quarter + 48, quarter + 48, quarter + 48]
        while any(58 <= c <= 64 or 91 <= c <= 96 for c in four):
            for i in (0, 2):
                if any(58 <= c <= 64 or 91 <= c <= 96 for c in four[i : i + 2]):
                    four[i], four[i + 1] = four[i] + 1, four[i + 1] - 1
        columns.append(four)
    text = "".join(chr(columns[byte][k]) for k in range(4) for byte in range(4))
    return text[-1] + text[:-1]


def checked(content: bytes) -> bytes:
    """A file of one unit with the cards DATASUM and CHECKSUM."""
    header, at = fits.cards(content, 0)
    lines = [content[i : i + fits.CARD].decode("ascii") for i in range(0, at, fits.CARD)]
    lines = [x for x in lines[: next(i for i, x in enumerate(lines) if x.rstrip() == "END")] if x[:8].rstrip() not in ("DATASUM", "CHECKSUM")]
    head = lambda sums: ("".join(f"{x:<{fits.CARD}}" for x in [*lines, f"DATASUM = '{ones_sum(content[at:])}'", f"CHECKSUM= '{sums}'", "END"])).encode()
    filled = lambda sums: head(sums) + b" " * (-len(head(sums)) % fits.BLOCK)
    total = ones_sum(content[at:], ones_sum(filled("0" * 16)))
    return filled(encoded(total)) + content[at:]


class FrameFiles(ds.DataSource):
    """Options: path (roots, by commas), glob, exclude, header (cards that become columns, by commas), bandBytes; of a stream log,
    filesPerTrigger and roots_file; of the writer path and u16."""

    @classmethod
    def name(cls) -> str:
        return "frame_files"

    def schema(self) -> StructType:
        cards = [k.strip() for k in self.options.get("header", "").split(",") if k.strip()]
        return StructType([StructField(n, t) for n, t in FIXED.items()] + [StructField(k, StringType()) for k in cards if k not in FIXED])

    def reader(self, schema: StructType) -> BatchReader:
        return BatchReader(self.options, schema)

    def streamReader(self, schema: StructType) -> StreamReader:
        return StreamReader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> TwoPhaseWriter:
        return TwoPhaseWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to the session and lets Spark hand it filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", True)
    spark.dataSource.register(FrameFiles)


def samples(bands: DataFrame, frame: Column | None = None) -> DataFrame:
    """(frame_id, ch, y, x, v) of bands; frame: what identifies the frame, its path by default. Rows of files that could not
    be read have none."""
    at = bands.where(F.col("data").isNotNull()).select((F.col("path") if frame is None else frame).alias("frame_id"), "y0", "w", "c", F.posexplode("data").alias("p", "s"))
    pixel = F.expr("p div c")
    return at.select("frame_id", F.expr("cast(p % c as int)").alias("ch"), (F.col("y0") + F.floor(pixel / F.col("w"))).cast("int").alias("y"), (pixel % F.col("w")).cast("int").alias("x"), unmasked(F.col("s")).alias("v"))
