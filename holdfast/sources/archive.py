"""Dated archives: the wanted members of many ZIP files, unpacked in a task each and read as tables."""

from __future__ import annotations

import csv
import io
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.scale import checkpoint_folder, durable
from holdfast.sources import tables

# Bytes of a member that are expanded at a time.
BLOCK = 1 << 20
CUT = pa.schema([("archive", pa.string()), ("nth", pa.int32()), ("stored", pa.bool_()), ("bytes", pa.int64()),
                 ("crc", pa.int64()), ("packed", pa.binary())])


class ManifestError(ValueError):
    """An archive lacks a member, or a source came back empty."""


def members(spark: SparkSession, path: str) -> DataFrame:
    """(archive, member, bytes) of every archive under ``path``: one task per archive."""
    def listing(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    yield pd.DataFrame([(name, i.filename.rsplit("/", 1)[-1], i.file_size)
                                        for i in z.infolist() if not i.is_dir()],
                                       columns=["archive", "member", "bytes"])
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(listing, "archive string, member string, bytes long")


def records(spark: SparkSession, path: str, member: str, columns: Sequence[str]) -> DataFrame:
    """The records of one member of every archive: archive, the columns as text, ``_ragged``.

    Members are unpacked into the shared folder, each in a task of its own, and read from there as
    tables are (``read_table``). Another header than ``columns`` raises ``ManifestError``.
    """
    folder = unpacked(spark, path, member, list(columns))
    if folder is None:
        empty = ", ".join(["archive string", *[f"`{c}` string" for c in columns], f"{tables.RAGGED} boolean"])
        return spark.createDataFrame([], empty)
    read = tables.read_table(spark, folder, columns, check_header=False, folders=["archive", "nth"])
    return read.select("archive", *[f"`{c}`" for c in columns], tables.RAGGED)


def unpacked(spark: SparkSession, path: str, member: str, header: Sequence[str] | None = None) -> str | None:
    """A folder ``archive=.../nth=...`` with every such member of every archive as text, None without any.

    The compressed members are cut out of their archives as they lie there, and dealt one to a task. A
    task expands its member by ``BLOCK`` bytes at a time, cut after a line, and checks length and CRC.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                whole = content.as_buffer()
                with zipfile.ZipFile(pa.BufferReader(whole)) as z:
                    wanted = [i for i in z.infolist() if not i.is_dir() and i.filename.rsplit("/", 1)[-1] == member]
                for nth, info in enumerate(wanted):
                    if info.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED) or info.flag_bits & 1:
                        raise ManifestError(f"{name}/{info.filename}: packed in a way that cannot be read")
                    # The local header is 30 bytes, of which the last four are the lengths of the name and of what follows it.
                    name_length, extra = struct.unpack_from("<HH", whole, info.header_offset + 26)
                    start = info.header_offset + 30 + name_length + extra
                    packed = whole.slice(start, info.compress_size)
                    yield pa.RecordBatch.from_pylist([{
                        "archive": name, "nth": nth, "stored": info.compress_type == zipfile.ZIP_STORED, "bytes": info.file_size,
                        "crc": info.CRC, "packed": packed.to_pybytes()}], schema=CUT)

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k] for c in batch.schema.names}
                where = f"{row['archive']}/{member}"
                pieces = _expanded(row["packed"].as_buffer(), row["stored"].as_py(), row["bytes"].as_py(), row["crc"].as_py(), where)
                for at, text in enumerate(_whole_lines(pieces)):
                    if at == 0 and header is not None:
                        found = next(csv.reader(io.StringIO(text.decode("utf-8-sig", "replace"), newline="")), [])
                        if found != list(header):
                            raise ManifestError(f"{where}: expected {list(header)}, found {found}")
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row["archive"].as_py()]), pa.array([row["nth"].as_py()], pa.int32()), pa.array([at], pa.int64()),
                         pa.array([text], pa.binary())], names=["archive", "nth", "at", "value"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    cuts = durable(files.mapInArrow(cut, "archive string, nth int, stored boolean, bytes long, crc long, packed binary"))
    number = cuts.count()
    if not number:
        return None
    folder = f"{checkpoint_folder(spark)}/unpacked-{uuid.uuid4().hex}"
    each = cuts.repartitionByRange(number, "archive", "nth")
    blocks = each.mapInArrow(expand, "archive string, nth int, at long, value binary").sortWithinPartitions("archive", "nth", "at")
    blocks.select("archive", "nth", F.col("value").cast("string")).write.partitionBy("archive", "nth").text(folder)
    return folder


def _expanded(packed: pa.Buffer, stored: bool, size: int, crc: int, where: str) -> Iterator[bytes]:
    """The content, BLOCK bytes at most a time; raises when it is not what the archive says."""
    machine, seen, found, low = zlib.decompressobj(-zlib.MAX_WBITS), 0, 0, 0
    rest = b""
    while low < packed.size or rest:
        piece = rest or packed.slice(low, min(BLOCK, packed.size - low)).to_pybytes()
        low += 0 if rest else len(piece)
        out = piece if stored else machine.decompress(piece, BLOCK)
        rest = b"" if stored else machine.unconsumed_tail
        seen, found = seen + len(out), zlib.crc32(out, found)
        yield out
    while not stored and not machine.eof and (out := machine.decompress(b"", BLOCK)):
        seen, found = seen + len(out), zlib.crc32(out, found)
        yield out
    if seen != size or found != crc:
        raise ManifestError(f"{where}: {seen} bytes that differ from the {size} packed")


def _whole_lines(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Blocks that end before a line feed, which the writer of text adds again."""
    held: list[bytes] = []
    for piece in pieces:
        cut = piece.rfind(b"\n")
        if cut < 0:
            held.append(piece)
            continue
        yield b"".join([*held, piece[:cut]])
        held = [piece[cut + 1:]] if cut + 1 < len(piece) else []
    if held:
        yield b"".join(held)


def missing_members(found: DataFrame, expected: Sequence[str]) -> DataFrame:
    """(archive, member) pairs that were expected and are not there."""
    wanted = found.select("archive").distinct().withColumn(
        "member", F.explode(F.array(*[F.lit(m) for m in expected])))
    return wanted.join(found.select("archive", "member"), ["archive", "member"], "left_anti")


def require_members(found: DataFrame, expected: Sequence[str]) -> None:
    """Raise when any archive lacks an expected member, or there is no archive at all."""
    lost = missing_members(found, expected).orderBy("archive", "member").limit(20).collect()
    if lost:
        raise ManifestError("; ".join(f"{r['archive']} lacks {r['member']}" for r in lost))
    if found.limit(1).count() == 0:
        raise ManifestError("no archive found")


def require_rows(df: DataFrame, least: int, label: str) -> None:
    """Raise when a source that answered is nevertheless (nearly) empty."""
    found = df.limit(least).count()
    if found < least:
        raise ManifestError(f"{label}: expected at least {least} rows, got {found}")
