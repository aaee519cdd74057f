"""Model artifact scans: a row for each tensor; bytes are never unpickled or run, and no file is read whole.

Three steps, each a Spark stage. Spark lists the files (paths and sizes alone). A task reads a file's header by ranges (the table of safetensors, the fields of an
ONNX model, the directory of an archive) and says where each tensor lies. Then tensors, or pieces of a file, are dealt over all tasks, each of which reads its own range
with a buffer of `BUFFER` bytes: a large file's tensors are hashed by many tasks. A tensor's SHA-256 needs its bytes in order and is one task's stream; `file_roots` cuts
whole files into pieces of equal size, which need no order, and joins their hashes in a Merkle tree.

Tasks open files with pyarrow's file systems (local, hdfs, viewfs, s3, gs); for other stores give `open_file`, a function from a path to a seekable binary file."""

from __future__ import annotations

import hashlib
import io
import json
import re
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.integrity import leaf_hash, merkle_roots

Layout = tuple[str, str, list[int], int, list[tuple[int, int]], str, str]  # name, dtype, shape, byte_length, ranges (start, length), coding, status
BUFFER = 4 << 20
HEADER_LIMIT = 100_000_000  # fixed value: the greatest header that the safetensors format allows
NAME_LIMIT = 1 << 16

LAYOUT = "path string, format string, name string, dtype string, shape array<long>, byte_length long, ranges array<struct<start: long, length: long>>, coding string, status string"
SCHEMA = "path string, format string, name string, dtype string, shape array<long>, byte_length long, content_hash string, status string"
FAULTS = (ValueError, IndexError, KeyError, TypeError, EOFError, struct.error, zlib.error, zipfile.BadZipFile, NotImplementedError)


def sniff(content):
    """Column: format of an artifact by its first bytes."""
    head = F.hex(F.substring(content, 1, 16))
    json_at_8 = F.substring(head, 17, 2) == "7B"
    return F.when(head.startswith("504B0304"), "zip").when(head.startswith("80"), "pickle").when(json_at_8, "safetensors").when(head.startswith("08"), "onnx").otherwise("unknown")


def _kind(head: bytes) -> str:
    return "zip" if head[:4] == b"PK\3\4" else "pickle" if head[:1] == b"\x80" else "safetensors" if head[8:9] == b"{" else "onnx" if head[:1] == b"\x08" else "unknown"


def _store(path: str) -> tuple[fs.FileSystem, str]:
    local = re.fullmatch(r"(?:file:)?(/.*)", path)
    return (fs.LocalFileSystem(), re.sub("^/+", "/", local[1])) if local else fs.FileSystem.from_uri(quote(path, safe="/:@"))


def open_path(path: str) -> pa.NativeFile:
    """A seekable file of any store that pyarrow knows, read by ranges."""
    store, name = _store(path)
    return store.open_input_file(name)


def create_path(path: str) -> pa.NativeFile:
    store, name = _store(path)
    return store.open_output_stream(name)


def safetensors(f, size: int) -> Iterator[Layout]:
    f.seek(0)
    length = struct.unpack("<Q", f.read(8))[0]
    if length > HEADER_LIMIT or 8 + length > size:
        raise ValueError("header is cut short or too long")
    table, body, end = json.loads(f.read(length)), 8 + length, 0
    for name, t in sorted(((k, v) for k, v in table.items() if k != "__metadata__"), key=lambda x: x[1]["data_offsets"]):
        a, b = t["data_offsets"]
        if a != end or b < a or body + b > size:
            raise ValueError(f"offsets of {name} overlap, leave a hole or pass the end")
        end = b
        yield name, t["dtype"], t["shape"], b - a, [(body + a, b - a)], "stored", "VALID"


def _varint(f) -> int:
    value = 0
    for shift in range(0, 70, 7):
        b = f.read(1)
        if not b:
            raise ValueError("number is cut short")
        value |= (b[0] & 127) << shift
        if b[0] < 128:
            return value
    raise ValueError("number is too long")


def _fields(f, at: int, end: int) -> Iterator[tuple[int, int, int | None]]:
    """Fields of the protobuf message in [at, end): its number with a value and None, or with the place and length of its bytes, which are passed over."""
    while at < end:
        f.seek(at)
        key = _varint(f)
        if key & 7 == 0:
            value = _varint(f)
            at = f.tell()
            yield key >> 3, value, None
            continue
        if key & 7 not in (1, 2, 5):
            raise ValueError("unknown wire type")
        length = _varint(f) if key & 7 == 2 else 8 if key & 7 == 1 else 4
        start = f.tell()
        at = start + length
        if at > end:
            raise ValueError("message is cut short")
        yield key >> 3, start, length


# Element types of ONNX tensors, by number.
ONNX_TYPES = {1: "F32", 2: "U8", 3: "I8", 4: "U16", 5: "I16", 6: "I32", 7: "I64", 8: "STRING", 9: "BOOL", 10: "F16", 11: "F64", 12: "U32", 13: "U64", 16: "BF16"}


def _onnx_tensor(f, at: int, end: int) -> Layout:
    shape, kind, name, ranges, status = [], 0, "", [], "VALID"
    for number, value, length in _fields(f, at, end):
        if number == 1 and length is None:
            shape.append(value)
        elif number == 1:
            f.seek(value)
            while f.tell() < value + length:
                shape.append(_varint(f))
        elif number == 2:
            kind = value
        elif number == 8:
            if length is None or length > NAME_LIMIT:
                raise ValueError("name isn't a text or is too long")
            f.seek(value)
            name = f.read(length).decode()
        elif number == 14 and value == 1:
            status = "EXTERNAL"
        elif number in (4, 5, 6, 7, 9, 10, 11) and length is not None:
            ranges.append((value, length))
    return name, ONNX_TYPES.get(kind, f"TYPE_{kind}"), shape, sum(n for _, n in ranges), ranges, "stored", status


def onnx(f, size: int) -> Iterator[Layout]:
    """Initializers of the graph (field 7 of the model, field 5 of the graph), with raw data or their packed fields. Data in other files is EXTERNAL."""
    n = 0
    for number, graph, length in _fields(f, 0, size):
        if number == 7 and length is not None:
            for inner, tensor, long in _fields(f, graph, graph + length):
                if inner == 5 and long is not None:
                    n += 1
                    yield _onnx_tensor(f, tensor, tensor + long)
    if not n:
        raise ValueError("no initializers")


def zipped(f, size: int) -> Iterator[Layout]:
    """Members of an archive of weights as bytes; nothing in it is loaded. Encrypted members and codings other than deflate are UNSUPPORTED."""
    with zipfile.ZipFile(f) as z:
        members = sorted((i for i in z.infolist() if not i.is_dir()), key=lambda i: i.filename)
    for i in members:
        if i.header_offset + 30 > size:
            raise ValueError(f"{i.filename} is cut short")
        f.seek(i.header_offset)
        head = f.read(30)
        if head[:4] != b"PK\3\4":
            raise ValueError(f"{i.filename} isn't where the directory says")
        start = i.header_offset + 30 + sum(struct.unpack("<HH", head[26:30]))
        if start + i.compress_size > size:
            raise ValueError(f"{i.filename} is cut short")
        coding = {0: "stored", 8: "deflate"}.get(i.compress_type, "other")
        yield i.filename, "BYTES", [i.file_size], i.file_size, [(start, i.compress_size)], coding, "UNSUPPORTED" if coding == "other" or i.flag_bits & 1 else "VALID"


READERS = {"safetensors": safetensors, "onnx": onnx, "zip": zipped}


def _layouts(path: str, f, size: int) -> list[tuple]:
    """Rows of LAYOUT: all tensors of a file, or one row with what is wrong with it."""
    f.seek(0)
    kind = _kind(f.read(16))
    if kind not in READERS:
        return [(path, kind, None, None, None, None, None, None, "UNSUPPORTED")]
    try:
        return [(path, kind, *t) for t in READERS[kind](f, size)]
    except FAULTS as e:
        return [(path, kind, None, None, None, None, None, None, f"CORRUPT: {e}")]


def _pieces(f, start: int, length: int) -> Iterator[bytes]:
    f.seek(start)
    while length:
        data = f.read(min(BUFFER, length))
        if not data:
            raise EOFError("file is cut short")
        length -= len(data)
        yield data


def _digest(f, ranges: list, coding: str, byte_length: int) -> str:
    """SHA-256 of a tensor's bytes, decoded if they are deflated; what is decoded is never more than a buffer, nor more than the directory says."""
    h, n, decoder = hashlib.sha256(), 0, zlib.decompressobj(-15) if coding == "deflate" else None
    for start, length in ranges:
        for data in _pieces(f, start, length):
            while data:
                out = decoder.decompress(data, BUFFER) if decoder else data
                data = decoder.unconsumed_tail if decoder else b""
                h.update(out)
                n += len(out)
                if n > byte_length:
                    raise ValueError("more bytes than stated")
    if decoder:
        out = decoder.flush()
        h.update(out)
        n += len(out)
    if n != byte_length:
        raise ValueError("fewer or more bytes than stated")
    return h.hexdigest()


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


_TEXT, _LONG = pa.string(), pa.int64()
_SHAPE = pa.list_(_LONG)
_LAYOUT = pa.schema([("path", _TEXT), ("format", _TEXT), ("name", _TEXT), ("dtype", _TEXT), ("shape", _SHAPE), ("byte_length", _LONG), ("ranges", pa.list_(pa.struct([("start", _LONG), ("length", _LONG)]))), ("coding", _TEXT), ("status", _TEXT)])
_SCAN = pa.schema([("path", _TEXT), ("format", _TEXT), ("name", _TEXT), ("dtype", _TEXT), ("shape", _SHAPE), ("byte_length", _LONG), ("content_hash", _TEXT), ("status", _TEXT)])
_LEAF = pa.schema([("path", _TEXT), ("i", _LONG), ("hash", _TEXT)])


def files_of(spark: SparkSession, folder: str) -> DataFrame:
    """path, size of all files below a folder; no content is read. Spark's reader lists no file of no bytes."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return found.select("path", F.col("length").alias("size"))


def layouts(files: DataFrame, open_file: Callable = open_path) -> DataFrame:
    """LAYOUT of files (path, size): where each tensor lies, from headers alone. A file that isn't whole or isn't known is one row with its status."""

    def run(batches):
        def rows():
            for r in _rows(batches):
                try:
                    with open_file(r["path"]) as raw:
                        found = _layouts(r["path"], io.BufferedReader(raw, 1 << 16), r["size"])
                except (FileNotFoundError, PermissionError) as e:  # other errors fail the task, which is tried again
                    found = [(r["path"], None, None, None, None, None, None, None, f"UNREADABLE: {type(e).__name__}")]
                yield from ((*x[:6], x[6] and [{"start": a, "length": n} for a, n in x[6]], *x[7:]) for x in found)

        yield from _batches(rows(), _LAYOUT)

    return files.select("path", "size").repartition("path").mapInArrow(run, LAYOUT)


def scan_ranges(files: DataFrame, open_file: Callable = open_path) -> DataFrame:
    """A row of SCHEMA for each tensor of files (path, size), hashed where its range is read; one row with a status for a file that isn't whole or isn't known.
    A tensor whose bytes don't decode is CORRUPT and has no hash. Tensors without data have the empty hash; those in other files (EXTERNAL) have none."""

    def run(batches):
        def rows():
            path, f = None, None
            for r in _rows(batches):
                digest, status = None, r["status"]
                if status == "VALID":
                    if r["path"] != path:
                        if f is not None:
                            f.close()
                        path, f = r["path"], open_file(r["path"])
                    try:
                        digest = _digest(f, [(x["start"], x["length"]) for x in r["ranges"]], r["coding"], r["byte_length"])
                    except FAULTS as e:
                        status = f"CORRUPT: {e}"
                yield r["path"], r["format"], r["name"], r["dtype"], r["shape"], r["byte_length"], digest, status
            if f is not None:
                f.close()

        yield from _batches(rows(), _SCAN)

    return layouts(files, open_file).repartition("path", "name").mapInArrow(run, SCHEMA)


def file_leaves(files: DataFrame, piece: int = 8 << 20, open_file: Callable = open_path) -> DataFrame:
    """path, i, hash: RFC 6962 leaves of a file's pieces (the leaf of a piece's SHA-256), whatever its format. Pieces of one file are dealt over all tasks; an empty file is one empty piece."""
    last = F.greatest(F.floor((F.col("size") - 1) / F.lit(piece)), F.lit(0)).cast("long")
    dealt = files.select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("i"))
    dealt = dealt.select("path", "i", (F.col("i") * piece).alias("start"), F.least(F.lit(piece).cast("long"), F.col("size") - F.col("i") * piece).alias("length")).repartition("path", "i")

    def run(batches):
        def rows():
            for r in _rows(batches):
                with open_file(r["path"]) as f:
                    yield r["path"], r["i"], _digest(f, [(r["start"], r["length"])], "stored", r["length"])

        yield from _batches(rows(), _LEAF)

    return dealt.mapInArrow(run, "path string, i long, hash string").withColumn("hash", leaf_hash(F.col("hash")))


def file_roots(files: DataFrame, piece: int = 8 << 20, open_file: Callable = open_path) -> DataFrame:
    """path, n (pieces), root: the Merkle root of each file over its pieces."""
    return merkle_roots(file_leaves(files, piece, open_file), ["path"])


def scan(files: DataFrame) -> DataFrame:
    """As scan_ranges, of files that are small enough to be rows (path, content)."""

    def run(batches):
        def rows():
            for r in _rows(batches):
                data = r["content"] or b""
                f = io.BytesIO(data)
                for x in _layouts(r["path"], f, len(data)):
                    digest, status = None, x[8]
                    if status == "VALID":
                        try:
                            digest = _digest(f, x[6], x[7], x[5])
                        except FAULTS as e:
                            status = f"CORRUPT: {e}"
                    yield *x[:6], digest, status

        yield from _batches(rows(), _SCAN)

    return files.select("path", "content").mapInArrow(run, SCHEMA)
