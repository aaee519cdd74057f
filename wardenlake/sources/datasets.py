"""Dataset scans: COCO, YOLO and image folders as the same two tables.

samples: sample_id, relative_path, file_size_bytes, width, height, channels; annotations: sample_id, category_name, x, y, w, h (COCO has more). Faults
(duplicate ids, dangling references, boxes that aren't) come as a table of code and detail; checked() raises on them."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.shared import materialize
from .json_elements import elements

IMAGE_SUFFIXES = ("png", "jpg", "jpeg", "webp", "bmp", "tif", "tiff")


class DatasetFault(ValueError):
    """A dataset that can't be read as what it claims to be."""


def checked(faults: DataFrame) -> None:
    if rows := faults.limit(5).collect():
        raise DatasetFault("; ".join(f"{r['code']}: {r['detail']}" for r in rows))


def safe_path(path: Column) -> Column:
    """Relative with forward slashes; null if it is absolute, has a drive, a null byte, or leaves its root."""
    p = F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"^(\./)+", "")
    bad = p.rlike(r"^/|^[A-Za-z]:|\x00") | F.concat(F.lit("/"), p, F.lit("/")).contains("/../") | (F.length(p) == 0)
    return F.when(~bad, p)


def list_files(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """relative_path, length (and content) of every file below root; Spark lists and reads them, so any of its stores will do."""
    columns = ["path", "length"] + ["content"] * content
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(*columns)
    tail = root.rstrip("/").rsplit("/", 1)[-1]
    return files.withColumn("relative_path", F.regexp_extract("path", rf".*?/{tail}/(.*)$", 1)).drop("path")


def detect_format(spark: SparkSession, root: str) -> str:
    """coco, yolo or imagefolder; a root that fits none or several raises."""
    p = F.lower("relative_path")
    image = p.rlike(rf"\.({'|'.join(IMAGE_SUFFIXES)})$")
    facts = list_files(spark, root).agg(
        F.count("*").alias("n"), F.max(p.rlike(r"^(annotations/)?[^/]*\.json$")).alias("coco"), F.max(p.rlike(r"^labels/.*\.txt$")).alias("yolo"),
        F.max(image & p.rlike(r"^[^/]+/[^/]+$") & ~p.rlike("^(images|annotations|labels)/")).alias("imagefolder"),
    ).first()
    found = [k for k in ("coco", "yolo", "imagefolder") if facts[k]]
    if len(found) != 1:
        raise DatasetFault(f"the format is {'ambiguous: ' + ', '.join(found) if found else 'unknown'} ({facts['n']} files)")
    return found[0]


# The fields of COCO's elements; all others are kept as attributes.
_COCO = {
    "images": "id bigint, file_name string, width int, height int",
    "annotations": "id bigint, image_id bigint, category_id bigint, bbox array<double>, area double, iscrowd string, is_crowd string, segmentation string",
    "categories": "id bigint, name string, supercategory string",
}


def read_coco(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """samples, annotations, faults of one COCO file or many, each read by many tasks (see json_elements).

    Annotations also have annotation_id, area, is_crowd, segmentation (JSON: polygons, or run lengths of a crowd), supercategory and attributes (all other
    fields, as JSON); samples have attributes too."""
    found, ends = elements(spark, path)

    def part(section: str) -> DataFrame:
        fields = T.StructType.fromDDL(_COCO[section])
        rest = F.map_filter(F.from_json("text", T.MapType(T.StringType(), T.StringType())), lambda k, _: ~k.isin(*fields.names))
        return found.where(F.col("section") == section).select(F.from_json("text", fields).alias("x"), rest.alias("attributes"), "text").select("x.*", "attributes", "text")

    images, notes, kinds = (materialize(part(s), f"coco_{s}") for s in _COCO)
    samples = images.select(F.col("id").cast("string").alias("sample_id"), safe_path(F.col("file_name")).alias("relative_path"), F.lit(None).cast("long").alias("file_size_bytes"), "width", "height", F.lit(3).alias("channels"), "attributes")
    joined = notes.join(kinds.select(F.col("id").alias("category_id"), F.trim("name").alias("category_name"), "supercategory"), "category_id", "left")
    crowd = F.coalesce(F.coalesce("iscrowd", "is_crowd").isin("1", "true"), F.lit(False))
    annotations = joined.select(F.col("image_id").cast("string").alias("sample_id"), "category_name", *(F.get("bbox", F.lit(i)).alias(c) for i, c in enumerate("xywh")), F.col("id").alias("annotation_id"), "area", crowd.alias("is_crowd"), "segmentation", "supercategory", "attributes")
    fault = lambda code, df, detail: df.select(F.lit(code).alias("code"), detail.cast("string").alias("detail"))
    twice = lambda df, key: df.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1")
    outline = F.from_json("segmentation", "array<array<double>>")
    bad_outline = F.col("segmentation").startswith("[") & (outline.isNull() | F.exists(outline, lambda p: F.coalesce((F.size(p) < 6) | (F.size(p) % 2 == 1), F.lit(True))))
    faults = (
        fault("DUPLICATE_IMAGE", twice(images, "id"), F.col("id")).union(fault("DUPLICATE_ANNOTATION", twice(notes, "id"), F.col("id"))).union(fault("DUPLICATE_CATEGORY", twice(kinds, "id"), F.col("id")))
        .union(fault("DUPLICATE_PATH", twice(samples, "relative_path"), F.col("relative_path")))
        .union(fault("DANGLING_IMAGE", notes.join(images, notes["image_id"] == images["id"], "left_anti"), F.col("id"))).union(fault("DANGLING_CATEGORY", joined.where("category_name is null"), F.col("id")))
        .union(fault("BAD_BOX", notes.where("size(bbox) <> 4 or bbox[2] <= 0 or bbox[3] <= 0"), F.col("id"))).union(fault("NEGATIVE_AREA", notes.where("area < 0"), F.col("id")))
        .union(fault("BAD_SEGMENTATION", notes.where(bad_outline), F.col("id"))).union(fault("UNSAFE_PATH", samples.where("relative_path is null"), F.col("sample_id")))
        .union(fault("BAD_CATEGORY", kinds.where("id is null or id < 0 or coalesce(trim(name), '') = ''"), F.col("text"))).union(fault("NO_ID", images.where("id is null").select("text").union(notes.where("id is null").select("text")), F.col("text")))
        .union(fault("MALFORMED", ends.where("depth not in (0, -1) or in_string = 1"), F.col("file")))  # the reader adds a brace behind the last one
    )
    return samples, annotations, faults


def read_yolo(spark: SparkSession, root: str, classes: list[str] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """samples, annotations, faults: a label line is class, center and size in shares of the image; unknown classes get a name."""
    files = list_files(spark, root, content=True)
    images = image_headers(files.where(F.lower("relative_path").rlike(rf"^images/.*\.({'|'.join(IMAGE_SUFFIXES)})$"))).withColumn("stem", F.regexp_extract("relative_path", r"^images/(.*)\.[^.]+$", 1))
    lines = files.where(F.lower("relative_path").rlike(r"^labels/.*\.txt$")).select(F.regexp_extract("relative_path", r"^labels/(.*)\.[^.]+$", 1).alias("stem"), F.posexplode(F.split(F.decode("content", "UTF-8"), r"\r?\n")).alias("line", "text")).where("trim(text) <> ''")
    t = F.split(F.trim("text"), r"\s+")
    v = [F.get(t, F.lit(i)).try_cast("double") for i in range(5)]
    parsed = lines.select("stem", "line", F.size(t).alias("n"), v[0].cast("int").alias("k"), *(x.alias(c) for x, c in zip(v[1:], ("cx", "cy", "bw", "bh"), strict=True)))
    good = (F.col("n") == 5) & F.col("k").isNotNull() & F.col("cx").between(0, 1) & F.col("cy").between(0, 1) & (F.col("bw") > 0) & (F.col("bw") <= 1) & (F.col("bh") > 0) & (F.col("bh") <= 1)
    parsed = parsed.withColumn("good", F.coalesce(good, F.lit(False)))
    names = F.array(*(F.lit(c) for c in classes)) if classes else F.array().cast("array<string>")
    j = parsed.where("good").join(images.select("stem", "relative_path", "width", "height"), "stem")
    annotations = j.select(
        F.col("relative_path").alias("sample_id"), F.coalesce(F.get(names, F.col("k")), F.concat(F.lit("class_"), F.col("k"))).alias("category_name"), ((F.col("cx") - F.col("bw") / 2) * F.col("width")).alias("x"),
        ((F.col("cy") - F.col("bh") / 2) * F.col("height")).alias("y"), (F.col("bw") * F.col("width")).alias("w"), (F.col("bh") * F.col("height")).alias("h"),
    )
    samples = images.select(F.col("relative_path").alias("sample_id"), "relative_path", F.col("length").alias("file_size_bytes"), "width", "height", "channels")
    faults = parsed.where(~F.col("good")).select(F.lit("BAD_LINE").alias("code"), F.concat_ws(":", "stem", F.col("line").cast("string")).alias("detail"))
    faults = faults.union(parsed.select("stem").distinct().join(images, "stem", "left_anti").select(F.lit("LABEL_WITHOUT_IMAGE"), "stem"))
    return samples, annotations, faults.union(images.where("status <> 'VALID'").select(F.lit("BAD_IMAGE"), "relative_path"))


def read_image_folder(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """samples, annotations, faults: the class is the folder's name."""
    images = image_headers(list_files(spark, root, content=True).where(F.lower("relative_path").rlike(rf"^[^/]+/.*\.({'|'.join(IMAGE_SUFFIXES)})$")))
    none = F.lit(None).cast("double")
    samples = images.select(F.col("relative_path").alias("sample_id"), "relative_path", F.col("length").alias("file_size_bytes"), "width", "height", "channels")
    annotations = images.select(F.col("relative_path").alias("sample_id"), F.regexp_extract("relative_path", "^([^/]+)/", 1).alias("category_name"), *(none.alias(c) for c in "xywh"))
    return samples, annotations, images.where("status <> 'VALID'").select(F.lit("BAD_IMAGE").alias("code"), F.col("relative_path").alias("detail"))


def header(data: bytes) -> tuple[str, str | None, int | None, int | None, int | None]:
    """status, format, width, height, channels from an image file's first bytes."""
    try:
        if data[:8] == b"\x89PNG\r\n\x1a\n" and data[12:16] == b"IHDR":
            w, h, _, kind = struct.unpack_from(">IIBB", data, 16)
            found = ("png", w, h, {0: 1, 2: 3, 3: 3, 4: 2, 6: 4}[kind])
        elif data[:2] == b"\xff\xd8":
            at = 2
            while True:
                if data[at] != 0xFF:
                    raise ValueError
                mark = data[at + 1]
                if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
                    h, w, c = struct.unpack_from(">HHB", data, at + 5)
                    found = ("jpeg", w, h, c)
                    break
                at += 2 if mark in (0x01, *range(0xD0, 0xD9)) else 2 + struct.unpack_from(">H", data, at + 2)[0]
        elif data[:4] == b"RIFF" and data[8:12] == b"WEBP":
            kind = data[12:16]
            if kind == b"VP8X":
                found = ("webp", 1 + int.from_bytes(data[24:27], "little"), 1 + int.from_bytes(data[27:30], "little"), 4 if data[20] & 0x10 else 3)
            elif kind == b"VP8L":
                bits = int.from_bytes(data[21:25], "little")
                found = ("webp", (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1, 4 if bits >> 28 & 1 else 3)
            else:
                w, h = struct.unpack_from("<HH", data, 26)
                found = ("webp", w & 0x3FFF, h & 0x3FFF, 3)
        elif data[:2] == b"BM":
            w, h, _, bits = struct.unpack_from("<iiHH", data, 18)
            found = ("bmp", w, abs(h), max(1, bits // 8) if bits >= 24 else 3)
        elif data[:4] in (b"II*\x00", b"MM\x00*"):
            e = "<" if data[:2] == b"II" else ">"
            at = struct.unpack_from(e + "I", data, 4)[0]
            tags = {}
            for i in range(struct.unpack_from(e + "H", data, at)[0]):
                tag, kind, _ = struct.unpack_from(e + "HHI", data, at + 2 + 12 * i)
                tags[tag] = struct.unpack_from(e + ("H" if kind == 3 else "I"), data, at + 10 + 12 * i)[0]
            found = ("tiff", tags[256], tags[257], tags.get(277, 1))
        else:
            return "UNSUPPORTED", None, None, None, None
    except (IndexError, KeyError, ValueError, struct.error):
        return "CORRUPT", None, None, None, None
    return ("VALID" if found[1] > 0 and found[2] > 0 else "CORRUPT", *found)


def image_headers(files: DataFrame, content: str = "content") -> DataFrame:
    """files with status, format, width, height, channels in place of the content."""
    keep = [c for c in files.columns if c != content]

    def run(batches):
        for pdf in batches:
            rows = [header(bytes(x or b"")) for x in pdf[content]]
            yield pd.concat([pdf[keep].reset_index(drop=True), pd.DataFrame(rows, columns=["status", "format", "width", "height", "channels"]).astype({c: "Int32" for c in ("width", "height", "channels")})], axis=1)

    schema = ", ".join(f"`{c}` {t}" for c, t in files.dtypes if c != content)
    return files.mapInPandas(run, schema + ", status string, format string, width int, height int, channels int")


def contents_digest(files: DataFrame) -> DataFrame:
    """relative_path, length, sha256 of each file."""
    return files.select("relative_path", "length", F.sha2("content", 256).alias("sha256"))
