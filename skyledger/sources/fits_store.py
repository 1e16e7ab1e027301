"""FITS files in a store, read by byte ranges and written unit by unit.

Tasks list the files, folder by folder; their contents are never read whole. A scan of headers reads header blocks
and seeks over the data. Pixels are planned as bands of rows within each unit, so that a large
image is many tasks, and a task reads its bands' bytes alone. Products are streams of parts,
sorted by unit and place, of which the writer holds one at a time.

Stores are those that Arrow opens (local and shared folders, S3, HDFS, GCS). What can't be read is
a row with a status of `error` and a message, and fails no job.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import math
import sys
import uuid
import zlib
from collections.abc import Iterator
from fnmatch import fnmatchcase
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.fs as pf
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..operators.headers import card_parse
from ..scratch import stored

# Bytes of a card and of a block, and the number types by BITPIX.
CARD, BLOCK = 80, 2880
TYPES = {8: ">u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}
#: Header blocks that are read at a time; bytes of a band, and of the bands of a task.
AHEAD, BAND, TASK = 4, 8 << 20, 64 << 20

UNITS = "path string, hdu_num int, ext_type string, bitpix int, naxes array<bigint>, compressed boolean, cards array<string>, data_at bigint, data_bytes bigint, status string, error string"
TILES = "path string, hdu_num int, plane bigint, tile_x int, tile_y int, x0 bigint, y0 bigint, width int, height int, bitpix int, data binary, status string, error string"


def opened(path: str) -> tuple[pf.FileSystem, str]:
    """The store of a path as Spark writes it, and the place in it."""
    if path.startswith("file:"):
        return pf.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return (pf.LocalFileSystem(), path) if path.startswith("/") else pf.FileSystem.from_uri(path)


#: Folders that a task lists, and files whose headers a task reads.
FOLDERS, FILES = 64, 2048


def list_files(spark: SparkSession, root: str, pattern: str = "*.{fit,fits}") -> DataFrame:
    """path and length of the files under a root, dealt out so that a task gets about FILES of them.

    Tasks list the folders, level by level; the driver sees how many there are, and no names. Names that
    begin with a point or a line are hidden, as for Spark's readers.
    """
    store, at = opened(root)
    kind = store.get_file_info(at).type
    if kind == pf.FileType.NotFound:
        raise FileNotFoundError(root)
    begin = "file:" if root.startswith(("file:", "/")) else root.rstrip("/").removesuffix(at.rstrip("/"))
    head, _, tail = pattern.partition("{")
    ends = tail.partition("}")
    patterns = [head + x + ends[2] for x in ends[0].split(",")] if tail else [pattern]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column("path").to_pylist():
                store, at = opened(path)
                found = [x for x in store.get_file_info(pf.FileSelector(at)) if x.base_name[:1] not in ("_", ".")]
                for lo in range(0, len(found), 1 << 13):
                    rows = [(begin + x.path, x.size or 0, x.type == pf.FileType.Directory) for x in found[lo : lo + (1 << 13)] if x.type == pf.FileType.Directory or any(fnmatchcase(x.base_name, p) for p in patterns)]
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 3, (pa.string(), pa.int64(), pa.bool_()), strict=True)], names=["path", "length", "is_dir"])

    if kind == pf.FileType.File:
        return spark.createDataFrame([(begin + at, store.get_file_info(at).size)], "path string, length bigint")
    folders, files = spark.createDataFrame([(root,)], "path string"), []
    while folders is not None:
        listed = stored(folders.mapInArrow(run, "path string, length bigint, is_dir boolean"), "listed")
        files.append(listed.where("NOT is_dir").select("path", "length"))
        n = listed.where("is_dir").count()
        folders = listed.where("is_dir").select("path").repartition(-(-n // FOLDERS), "path") if n else None
    found = reduce(DataFrame.unionAll, files)
    return found.repartition(max(1, -(-found.count() // FILES)), "path")


def relative(path: Column, root: str) -> Column:
    """A path from its root on."""
    plain = "/" + root.removeprefix("file:").lstrip("/").rstrip("/") if root.startswith(("file:", "/")) else root.rstrip("/")
    own = F.regexp_replace(path, "^file:/+", "/") if plain.startswith("/") else path
    return F.substring(own, len(plain) + 2, 1 << 20)


def _value(card: str) -> str:
    body = card[10:]
    if body.lstrip().startswith("'"):
        return body.split("'")[1]
    return body.partition("/")[0].strip()


def units_of(read, length: int) -> Iterator[tuple]:
    """(number, cards, place and bytes of the data) of every unit; read(n, at) gives bytes. Data are passed over."""
    at, number = 0, 0
    while at < length:
        number += 1
        cards: list[str] = []
        while not cards or cards[-1][:8] != "END     ":
            some = read(min(AHEAD * BLOCK, length - at), at)
            if len(some) < BLOCK:
                raise ValueError("header without END")
            for i in range(0, len(some) - len(some) % BLOCK, CARD):
                cards.append(some[i : i + CARD].decode("ascii", "replace"))
                if cards[-1][:8] == "END     ":
                    at += -(-(i + CARD) // BLOCK) * BLOCK
                    break
            else:
                at += len(some) - len(some) % BLOCK
        values = {c[:8].strip(): _value(c) for c in cards if c[8:10] == "= "}
        axes = [int(values[f"NAXIS{i}"]) for i in range(1, int(values.get("NAXIS", 0)) + 1)]
        size = (math.prod(axes) if axes else 0) + int(values.get("PCOUNT", 0))
        size *= abs(int(values.get("BITPIX", 8))) // 8 * int(values.get("GCOUNT", 1))
        if at + size > length:
            raise ValueError(f"unit {number}: data end early")
        yield number, values, axes, cards[:-1], at, size
        at += -(-size // BLOCK) * BLOCK


def scan_units(files: DataFrame) -> DataFrame:
    """Every unit of the files (path, length) with its cards and the place of its data; header blocks alone are read."""
    names = [f.split(" ")[0] for f in UNITS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(list(zip(names, [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.list_(pa.int64()), pa.bool_(), pa.list_(pa.string()), pa.int64(), pa.int64(), pa.string(), pa.string()], strict=True)))
        for b in batches:
            for path, length in zip(b.column("path").to_pylist(), b.column("length").to_pylist(), strict=True):
                rows = []
                try:
                    store, place = opened(path)
                    with store.open_input_file(place) as f:
                        for number, values, axes, cards, at, size in units_of(f.read_at, length):
                            kind = values.get("XTENSION", "IMAGE").strip().lower()
                            packed = kind == "bintable" and values.get("ZIMAGE") == "T"
                            rows.append((path, number, kind, int(values.get("BITPIX", 8)), axes, packed, cards, at, size, "ok", None))
                except (ValueError, KeyError, OSError, pa.ArrowException) as e:
                    rows.append((path, len(rows) + 1, *[None] * 7, "error", str(e) or type(e).__name__))
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema)

    return files.mapInArrow(run, UNITS)


def hdus(units: DataFrame) -> DataFrame:
    return units.select("path", "hdu_num", "ext_type", "bitpix", "naxes", "compressed", F.size("cards").alias("n_keywords"), "status", "error")


def keywords(units: DataFrame) -> DataFrame:
    """Each keyword of each unit, in order, with its card."""
    rows = units.where("status = 'ok'").select("path", "hdu_num", F.posexplode("cards").alias("at", "card"))
    return rows.select("path", "hdu_num", (F.col("at") + 1).alias("pos"), card_parse(F.col("card")).alias("k"), "card").select("path", "hdu_num", "pos", "k.*", "card")


def bands(units: DataFrame, tile: int, band: int = BAND) -> DataFrame:
    """Runs of whole rows of tiles of each plane of the plain images, with the place of their bytes."""
    n1, n2, size = F.get("naxes", 0), F.get("naxes", 1), F.abs("bitpix") / 8
    rows = units.where("status = 'ok' AND ext_type = 'image' AND size(naxes) >= 2 AND array_min(naxes) > 0").where(F.col("bitpix").isin(list(TYPES)))
    high = F.greatest(F.floor(F.lit(band) / (n1 * size * tile)), F.lit(1)) * tile
    rows = rows.select("path", "hdu_num", "bitpix", "data_at", n1.alias("n1"), n2.alias("n2"), size.cast("long").alias("size"), high.cast("long").alias("high"), F.aggregate(F.slice("naxes", 3, F.size("naxes")), F.lit(1).cast("long"), lambda a, b: a * b).alias("planes"))
    per = F.ceil(F.col("n2") / F.col("high"))
    rows = rows.withColumn("per", per).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("per") * F.col("planes") - 1)).alias("k"))
    first = F.col("k") % F.col("per") * F.col("high")
    rows = rows.withColumns({"plane": F.floor(F.col("k") / F.col("per")), "y0": first, "height": F.least("high", F.col("n2") - first)})
    at = F.col("data_at") + (F.col("plane") * F.col("n2") + F.col("y0")) * F.col("n1") * F.col("size")
    return rows.select("path", "hdu_num", "bitpix", "n1", "plane", "y0", "height", at.alias("at"), (F.col("height") * F.col("n1") * F.col("size")).alias("bytes"))


def dealt(ranges: DataFrame, task: int = TASK) -> DataFrame:
    """Byte ranges dealt out so that a task reads about `task` bytes."""
    total = ranges.agg(F.sum("bytes")).first()[0] or 0
    return ranges.repartition(max(1, -(-total // task)), "path", "at")


def scan_fits_tiles(units: DataFrame, tile: int = 64, band: int = BAND, task: int = TASK) -> DataFrame:
    """Pixels of plain images as big-endian tiles, plane by plane; nothing is scaled."""
    names = [f.split(" ")[0] for f in TILES.split(", ")]
    types = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    schema = pa.schema([(n, types[f.split(" ")[1]]) for n, f in zip(names, TILES.split(", "), strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                own = (r["path"], r["hdu_num"], r["plane"])
                try:
                    store, place = opened(r["path"])
                    with store.open_input_file(place) as f:
                        image = np.frombuffer(f.read_at(r["bytes"], r["at"]), TYPES[r["bitpix"]]).reshape(r["height"], r["n1"])
                except (ValueError, OSError, pa.ArrowException) as e:
                    rows = [(*own, *[None] * 6, r["bitpix"], None, "error", str(e) or type(e).__name__)]
                else:
                    rows = []
                    for y in range(0, r["height"], tile):
                        for x in range(0, r["n1"], tile):
                            t = image[y : y + tile, x : x + tile]
                            rows.append((*own, x // tile, (r["y0"] + y) // tile, x + 1, r["y0"] + y + 1, t.shape[1], t.shape[0], r["bitpix"], t.tobytes(), "ok", None))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return dealt(bands(units, tile, band), task).mapInArrow(run, TILES)


def card_value(name: str) -> Column:
    """A keyword's value among a unit's `cards`, without quotes; null where there is none."""
    own = F.filter("cards", lambda c: c.startswith(f"{name:<8}= "))
    return F.trim(F.regexp_replace(card_parse(F.get(own, 0))["value"], "'", ""))


def plain_units(units: DataFrame) -> DataFrame:
    """Units with compressed images as what they hold: kind, number type and sides of the image; `tile_w` and `tile_h` are their tiles' sides."""
    number = lambda name: card_value(name).try_cast("long")
    z = F.col("compressed")
    sides = F.transform(F.sequence(F.lit(1), F.greatest(number("ZNAXIS"), F.lit(1)).cast("int")), lambda i: F.element_at(F.array(*[number(f"ZNAXIS{k}") for k in range(1, 10)]), i))
    # without ZTILEn a tile is a row
    own = {"ext_type": F.when(z, "image").otherwise(F.col("ext_type")), "bitpix": F.when(z, number("ZBITPIX").cast("int")).otherwise(F.col("bitpix")), "naxes": F.when(z, sides).otherwise(F.col("naxes"))}
    tile = {"tile_w": F.when(z, F.coalesce(number("ZTILE1"), number("ZNAXIS1"))), "tile_h": F.when(z, F.coalesce(number("ZTILE2"), F.lit(1).cast("long")))}
    return units.withColumns(own | tile)


#: Tiles of a compressed image that are read at a time.
PACKED = 256


def scan_packed_tiles(units: DataFrame, run: int = PACKED, task: int = TASK) -> DataFrame:
    """Tiles of compressed two-dimensional images whose pixels are kept whole (GZIP_1 and NOCOMPRESS), as in scan_fits_tiles.

    A table row begins with the length and the place of a tile in the heap. Runs of rows are dealt out;
    a task reads their rows and their part of the heap. Other ways of compression, and numbers that
    are scaled tile by tile, are rows with an error.
    """
    number = lambda name: card_value(name).try_cast("long")
    rows = units.where("status = 'ok' AND compressed").select("path", "hdu_num", "data_at", "data_bytes", number("NAXIS1").alias("row_bytes"), number("NAXIS2").alias("n"), F.coalesce(number("THEAP"), number("NAXIS1") * number("NAXIS2")).alias("heap"), card_value("TFORM1").alias("form"), card_value("ZCMPTYPE").alias("how"), F.exists("cards", lambda c: c.contains("ZSCALE")).alias("scaled"), number("ZBITPIX").cast("int").alias("bitpix"), *[F.coalesce(number(f"ZNAXIS{k}"), F.lit(1).cast("long")).alias(f"n{k}") for k in (1, 2)], F.coalesce(number("ZTILE1"), number("ZNAXIS1")).alias("w"), F.coalesce(number("ZTILE2"), F.lit(1).cast("long")).alias("h"))
    rows = rows.withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(run).cast("long"))))
    rows = rows.withColumns({"at": F.col("data_at") + F.col("first") * F.col("row_bytes"), "bytes": F.ceil(F.col("data_bytes") * F.least(F.lit(run), F.col("n") - F.col("first")) / F.col("n"))})
    names = [f.split(" ")[0] for f in TILES.split(", ")]
    types = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    schema = pa.schema([(n, types[f.split(" ")[1]]) for n, f in zip(names, TILES.split(", "), strict=True)])

    def tiles_of(r: dict) -> list[tuple]:
        kind = r["form"][1:2]
        if r["how"] not in ("GZIP_1", "NOCOMPRESS") or kind not in ("P", "Q") or r["scaled"]:
            raise ValueError(f"{r['how']} {r['form']}{' with scales' * r['scaled']} is not decoded")
        store, place = opened(r["path"])
        with store.open_input_file(place) as f:
            count = min(run, r["n"] - r["first"])
            table = np.frombuffer(f.read_at(count * r["row_bytes"], r["at"]), np.uint8).reshape(count, r["row_bytes"])
            pairs = table[:, : 8 if kind == "P" else 16].copy().view(">i4" if kind == "P" else ">i8").astype(np.int64)
            low, high = int(pairs[:, 1].min()), int(pairs.sum(1).max())
            heap = f.read_at(high - low, r["data_at"] + r["heap"] + low)
        across, out = -(-r["n1"] // r["w"]), []
        for t, (size, at) in enumerate(pairs.tolist(), r["first"]):
            data = heap[at - low : at - low + size]
            data = gzip.decompress(data) if r["how"] == "GZIP_1" else data
            x0, y0 = t % across * r["w"], t // across * r["h"]
            w, h = min(r["w"], r["n1"] - x0), min(r["h"], r["n2"] - y0)
            if len(data) != w * h * abs(r["bitpix"]) // 8:
                raise ValueError(f"tile {t + 1}: {len(data)} bytes")
            out.append((r["path"], r["hdu_num"], 0, t % across, t // across, x0 + 1, y0 + 1, w, h, r["bitpix"], data, "ok", None))
        return out

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                try:
                    rows = tiles_of(r)
                except (ValueError, OSError, EOFError, zlib.error, pa.ArrowException) as e:
                    rows = [(r["path"], r["hdu_num"], 0, *[None] * 6, r["bitpix"], None, "error", str(e) or type(e).__name__)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return dealt(rows, task).mapInArrow(read, TILES)


def raw_parts(units: DataFrame, keep: list[str], band: int = BAND) -> DataFrame:
    """The bytes of units' data as they are, in runs: `keep`, part and content."""
    cut = units.where("data_bytes > 0").select(*keep, "path", "data_at", "data_bytes", F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("data_bytes") - 1, F.lit(band).cast("long"))).alias("part", "from"))
    ranges = cut.select(*keep, "path", (F.col("part") + 1).cast("long").alias("part"), (F.col("data_at") + F.col("from")).alias("at"), F.least(F.lit(band), F.col("data_bytes") - F.col("from")).alias("bytes"))
    ddl = ", ".join(f"{c} {dict(ranges.dtypes)[c]}" for c in [*keep, "part"]) + ", content binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, (path, at, n) in enumerate(zip(*(b.column(c).to_pylist() for c in ("path", "at", "bytes")), strict=True)):
                store, place = opened(path)
                with store.open_input_file(place) as f:
                    yield pa.RecordBatch.from_arrays([*(b.column(c).slice(i, 1) for c in (*keep, "part")), pa.array([f.read_at(n, at)])], names=[*keep, "part", "content"])

    return dealt(ranges).mapInArrow(run, ddl)


def header_text(cards: Column) -> Column:
    """Cards of 80 characters with END, in whole blocks, as bytes."""
    text = F.concat(F.array_join(cards, ""), F.rpad(F.lit("END"), CARD, " "))
    return F.encode(F.rpad(text, (F.ceil(F.length(text) / BLOCK) * BLOCK).cast("int"), " "), "US-ASCII")


# Products


class _Written(WriterCommitMessage):
    """The list of a task's files, as a file in the store, and a hash of eight bytes of each one's name."""

    def __init__(self, manifest: str, hashes: bytes):
        self.manifest, self.hashes = manifest, hashes


class _Writer(DataSourceWriter):
    """Streams the parts of each product into a file of its own; commit gives it its name, abort takes it away."""

    def __init__(self, root: str, compress: bool):
        self.root, self.compress, self.job = root.rstrip("/"), compress, uuid.uuid4().hex

    @property
    def pending(self) -> str:
        return f"{self.root}/_pending-{self.job}"

    def write(self, rows: Iterator) -> WriterCommitMessage:
        store, root = opened(self.pending)
        store.create_dir(root, recursive=True)
        out, raw, path, unit, n = None, None, None, None, 0
        manifest, hashes = f"{self.pending}/{uuid.uuid4().hex}.list", bytearray()
        names = store.open_output_stream(opened(manifest)[1])

        def pad() -> None:
            out.write(b"\0" * (-n % BLOCK))

        def close() -> None:
            if out is not None:
                pad()
                if out is not raw:
                    out.close()
                raw.close()

        try:
            for r in rows:
                if r.path != path:
                    close()
                    path, unit, n = r.path, r.hdu_num, 0
                    pending = f"{self.pending}/{uuid.uuid4().hex}"
                    names.write(f"{json.dumps([pending, f'{self.root}/{path}'])}\n".encode())
                    hashes += hashlib.blake2b(path.encode(), digest_size=8).digest()
                    raw = store.open_output_stream(opened(pending)[1])
                    out = gzip.GzipFile(fileobj=raw, mode="wb", compresslevel=1, mtime=0) if self.compress else raw
                elif r.hdu_num != unit:
                    pad()  # a unit ends with its block
                    unit, n = r.hdu_num, 0
                out.write(r.content)
                n += len(r.content)
        finally:
            close()
            names.close()
        return _Written(manifest, bytes(hashes))

    def commit(self, messages) -> None:
        """Give the files their names, list by list; of all files at once only hashes of eight bytes are here."""
        messages = [m for m in messages if m]
        found, n = np.unique(np.frombuffer(b"".join(m.hashes for m in messages), "u8"), return_counts=True)
        twice, done = set(found[n > 1].tolist()), set()
        for final in (f for m in messages if twice & set(np.frombuffer(m.hashes, "u8").tolist()) for _, f in self._listed(m)):
            if int.from_bytes(hashlib.blake2b(final.removeprefix(f"{self.root}/").encode(), digest_size=8).digest(), sys.byteorder) in twice:
                if final in done:
                    raise ValueError(f"two tasks wrote {final}")
                done.add(final)
        made = None
        for m in messages:
            for pending, final in self._listed(m):
                store, place = opened(final)
                if (folder := place.rpartition("/")[0]) != made:
                    store.create_dir(made := folder, recursive=True)
                store.move(opened(pending)[1], place)
        self._clear()

    @staticmethod
    def _listed(m: _Written) -> Iterator[tuple[str, str]]:
        """The pending and the final name of a task's files, in the order of the task's rows."""
        store, place = opened(m.manifest)
        with io.TextIOWrapper(store.open_input_stream(place), "utf-8", newline="\n") as lines:
            for line in lines:
                pending, final = json.loads(line)
                yield pending, final

    def abort(self, messages) -> None:
        self._clear()

    def _clear(self) -> None:
        store, place = opened(self.pending)
        if store.get_file_info(place).type != pf.FileType.NotFound:
            store.delete_dir(place)


class FitsProducts(DataSource):
    """Write rows (path, hdu_num, part, content) as files; see write_products."""

    @classmethod
    def name(cls) -> str:
        return "fits_products"

    def schema(self) -> str:
        return "path string, hdu_num int, part bigint, content binary"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], self.options.get("compression") == "gzip")


def write_products(parts: DataFrame, root: str, compress: bool = False) -> None:
    """Write products: parts (path, hdu_num, part, content) follow each other by unit and number; a unit ends in a whole block."""
    parts.sparkSession.dataSource.register(FitsProducts)
    rows = parts.select("path", F.col("hdu_num").cast("int").alias("hdu_num"), F.col("part").cast("long").alias("part"), "content")
    rows = rows.repartition("path").sortWithinPartitions("path", "hdu_num", "part")
    rows.write.format("fits_products").option("compression", "gzip" if compress else "none").mode("append").save(root)


def stored_units(spark: SparkSession, root: str, pattern: str = "*.{fit,fits}") -> DataFrame:
    """The units of all files under a root, scanned once."""
    return stored(scan_units(list_files(spark, root, pattern)), "units")
