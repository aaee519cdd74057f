"""Model files read by ranges against whole reads."""

import hashlib
import json
import random
import struct
import zipfile

import pytest

from wardenlake.operators import integrity
from wardenlake.sources import models

SHA = lambda b: hashlib.sha256(b).hexdigest()


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def field(n, b):
    return varint(n << 3 | 2) + varint(len(b)) + b


def safetensors(tensors):
    table, at = {"__metadata__": {"a": "b"}}, 0
    for name, data in tensors.items():
        table[name] = {"dtype": "U8", "shape": [len(data)], "data_offsets": [at, at + len(data)]}
        at += len(data)
    head = json.dumps(table).encode()
    return struct.pack("<Q", len(head)) + head + b"".join(tensors.values())


def onnx(tensors):
    body = b"".join(field(5, b"\x08" + varint(len(d)) + b"\x10\x02" + field(8, n.encode()) + field(9, d)) for n, d in tensors.items())
    outside = field(5, b"\x08\x03\x10\x01" + field(8, b"far") + b"\x70\x01")
    return b"\x08\x07" + field(2, b"maker") + field(7, field(1, b"node" * 50) + body + outside)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root, rng = tmp_path_factory.mktemp("models"), random.Random(3)
    tensors = {f"w{i}": rng.randbytes(n) for i, n in enumerate((0, 1, 5, 70_000, 300_001))} | {"ümläut": b"\0" * 100_000}
    (root / "a b%20c.safetensors").write_bytes(safetensors(tensors))
    (root / "m.onnx").write_bytes(onnx(tensors))
    for name, kind in (("s.pt", zipfile.ZIP_STORED), ("d.pt", zipfile.ZIP_DEFLATED), ("o.pt", zipfile.ZIP_BZIP2)):
        with zipfile.ZipFile(root / name, "w", kind) as z:
            for k, v in tensors.items():
                z.writestr(k, v)
    return root, tensors


def by_name(df):
    return {(r["path"].rsplit("/", 1)[1], r["name"]): (r["dtype"], r["shape"], r["byte_length"], r["content_hash"], r["status"]) for r in df.collect()}


def test_ranges_equal_whole_reads(spark, folder):
    root, tensors = folder
    got = by_name(models.scan_ranges(models.files_of(spark, str(root))))
    for name, data in tensors.items():
        for file, dtype in (("a b%20c.safetensors", "U8"), ("m.onnx", "U8"), ("s.pt", "BYTES"), ("d.pt", "BYTES")):
            assert got[file, name] == (dtype, [len(data)], len(data), SHA(data), "VALID")
        assert got["o.pt", name][3:] == (None, "UNSUPPORTED")
    assert got["m.onnx", "far"] == ("F32", [3], 0, None, "EXTERNAL") and len(got) == 5 * len(tensors) + 1
    rows = [(str(p), bytearray(p.read_bytes())) for p in root.iterdir()]
    assert by_name(models.scan(spark.createDataFrame(rows, "path string, content binary"))) == got


def test_reads_are_bounded(folder, monkeypatch):
    """No read asks for more than a buffer, and headers are found without the tensors' bytes."""
    root, tensors = folder
    monkeypatch.setattr(models, "BUFFER", 4096)

    class Watched:
        def __init__(self, path):
            self.f, self.asked = open(path, "rb"), []

        def read(self, n=-1):
            data = self.f.read(n)
            self.asked.append(len(data))
            return data

        def __getattr__(self, name):
            return getattr(self.f, name)

    for name in ("a b%20c.safetensors", "m.onnx", "d.pt"):
        path = root / name
        f = Watched(path)
        found = models._layouts(str(path), f, path.stat().st_size)
        assert len(found) >= len(tensors) and (name == "d.pt" or sum(f.asked) < 3000)
        f.asked.clear()
        assert {r[2]: models._digest(f, r[6], r[7], r[5]) for r in found if r[8] == "VALID"} == {k: SHA(v) for k, v in tensors.items()}
        assert max(f.asked) <= 4096


@pytest.mark.parametrize("name", ["a b%20c.safetensors", "m.onnx", "s.pt", "d.pt"])
def test_cut_and_damaged_files(spark, tmp_path, folder, name):
    """Whatever is cut off or changed, a file gives rows with a status, and never a hash of other bytes as VALID."""
    data, rng = (folder[0] / name).read_bytes(), random.Random(name)
    broken = [data[:n] for n in (0, 1, 7, 8, 20, 100, len(data) // 2, len(data) - 1)]
    for _ in range(40):
        b = bytearray(data)
        b[rng.randrange(0, 700) if rng.random() < 0.5 else -rng.randrange(1, 700)] ^= 1 << rng.randrange(8)
        broken.append(bytes(b))
    for i, b in enumerate(broken):
        (tmp_path / f"{i:02}").write_bytes(b)
    rows = models.scan_ranges(models.files_of(spark, str(tmp_path))).collect()
    assert {r["path"].rsplit("/", 1)[1] for r in rows} >= {f"{i:02}" for i in range(1, len(broken))}
    for r in rows:
        assert (r["status"] == "VALID") == (r["content_hash"] is not None)
    assert all(r["status"] != "VALID" or name == "m.onnx" for r in rows if r["path"][-2:] in ("00", "01", "02", "03", "04"))


def test_missing_and_null(spark, tmp_path):
    gone = spark.createDataFrame([(str(tmp_path / "gone"), 10), (None, 1)], "path string, size long").where("path is not null")
    assert models.scan_ranges(gone).first()["status"] == "UNREADABLE: FileNotFoundError"
    assert models.scan_ranges(gone.limit(0)).count() == 0
    assert models.scan(spark.createDataFrame([("x", None)], "path string, content binary")).first()["status"] == "UNSUPPORTED"


def rfc6962(leaves):
    if len(leaves) == 1:
        return leaves[0]
    k = 1 << (len(leaves) - 1).bit_length() - 1
    return SHA(b"\1" + bytes.fromhex(rfc6962(leaves[:k])) + bytes.fromhex(rfc6962(leaves[k:])))


@pytest.mark.parametrize("bits", [1, 2, 10])
def test_grouped_roots(spark, bits):
    sizes = (1, 2, 3, 5, 8, 21)
    rows = [(g if g != 5 else None, i, SHA(f"{g} {i}".encode())) for g in sizes for i in range(g)]
    got = {r["g"]: (r["n"], r["root"]) for r in integrity.merkle_roots(spark.createDataFrame(rows, "g long, i long, hash string"), ["g"], bits).collect()}
    assert got == {(g if g != 5 else None): (g, rfc6962([SHA(f"{g} {i}".encode()) for i in range(g)])) for g in sizes}
    assert integrity.merkle_roots(spark.createDataFrame([], "g long, i long, hash string"), ["g"]).count() == 0


def test_file_roots(spark, folder, tmp_path):
    (tmp_path / "empty").write_bytes(b"")
    (tmp_path / "big").write_bytes(random.Random(5).randbytes(100_001))
    files = models.files_of(spark, str(tmp_path)).union(spark.createDataFrame([(str(tmp_path / "empty"), 0)], "path string, size long"))
    got = {r["path"].rsplit("/", 1)[1]: (r["n"], r["root"]) for r in models.file_roots(files, 1000).collect()}
    for name in ("empty", "big"):
        data = (tmp_path / name).read_bytes()
        leaves = [SHA(b"\0" + hashlib.sha256(data[i : i + 1000]).digest()) for i in range(0, max(len(data), 1), 1000)]
        assert got[name] == (len(leaves), rfc6962(leaves))
