"""Files read by many tasks: JSON elements across any block border, COCO files."""

import collections
import json
import random

import pytest
from pyspark.sql import functions as F

from wardenlake.sources import datasets, json_elements


@pytest.fixture
def blocks(spark):
    """Sets the size of the blocks that files are read in."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def of(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")

    yield of
    for k, v in old.items():
        spark.conf.set(k, v)


def by_section(df):
    got = collections.defaultdict(list)
    for r in df.collect():
        got[r["file"].rsplit("/", 1)[1], r["section"]].append(json.dumps(json.loads(r["text"]), sort_keys=True))
    return {k: sorted(v) for k, v in got.items()}


@pytest.mark.parametrize("size", ["128m", "400", "97"])
def test_elements_across_borders(spark, tmp_path, blocks, size):
    """Braces, brackets, quotes and backslashes in strings, nested objects, elements longer than blocks, objects that aren't arrays: every border gives the same."""
    rng = random.Random(1)
    text = lambda: rng.choice(["a", "}", '{"x":[', "\\", '"', "é}", '\\"}', ",[", " ", "\n"]) * rng.randrange(4)
    doc = {
        "info": {"year": 1, "more": {"a": [{"id": 0}]}}, "images": [{"id": i, "file_name": text()} for i in range(40)], "empty": [], "categories": [{"id": 1, "name": "}{"}], "note": "x",
        "annotations": [{"id": i, "attributes": {"t": text(), "deep": [{"k": text()}, [1, {"z": "}"}]]}, "long": "x}" * rng.choice((0, 0, 0, 500))} for i in range(40)],
    }
    for name, indent, end in (("a.json", None, ""), ("b.json", 1, "\n")):
        (tmp_path / name).write_text(json.dumps(doc, ensure_ascii=indent is None, indent=indent) + end)
    (tmp_path / "two.json").write_text('{"images": [{"id": 1}]}\n{"images": [{"id": 2}], "other": [{"y": {}}]}\n')
    (tmp_path / "none.json").write_text("")
    blocks(size)
    found, ends = json_elements.elements(spark, str(tmp_path))
    want = {(f, s): sorted(json.dumps(x, sort_keys=True) for x in doc[s]) for f in ("a.json", "b.json") for s in ("images", "annotations", "categories")}
    assert by_section(found) == want | {("two.json", "images"): ['{"id": 1}', '{"id": 2}'], ("two.json", "other"): ['{"y": {}}']}
    assert all(r["depth"] in (0, -1) and r["in_string"] == 0 for r in ends.collect())


def test_coco_over_many_blocks(spark, tmp_path, blocks):
    """One file over many blocks gives what a whole reader gives, with outlines, crowds and attributes."""
    doc = {
        "images": [{"id": i, "file_name": f"{i}.png", "width": 4, "height": 5, "license": 2} for i in range(50)], "categories": [{"id": 0, "name": " cat ", "supercategory": "pet"}, {"id": 1, "name": "dog"}],
        "annotations": [{"id": i, "image_id": i % 50, "category_id": i % 2, "bbox": [1, 2, 3, i + 1], "area": 3.5, "iscrowd": int(i % 3 == 0), "segmentation": {"counts": [1, 2], "size": [4, 5]} if i % 3 == 0 else [[0, 0, 1, 0, 1, 1]], "attributes": {"occluded": i % 2 == 0}} for i in range(120)],
    }
    (tmp_path / "c.json").write_text(json.dumps(doc))
    blocks("300")
    samples, notes, faults = datasets.read_coco(spark, str(tmp_path / "c.json"))
    assert faults.count() == 0
    assert sorted((r["sample_id"], r["relative_path"], r["width"], r["height"], r["attributes"]) for r in samples.collect()) == sorted((str(x["id"]), x["file_name"], 4, 5, {"license": "2"}) for x in doc["images"])
    got = {r["annotation_id"]: r for r in notes.collect()}
    assert len(got) == notes.count() == 120
    for x in doc["annotations"]:
        r = got[x["id"]]
        assert (r["sample_id"], r["category_name"], [r["x"], r["y"], r["w"], r["h"]], r["area"]) == (str(x["image_id"]), ("cat", "dog")[x["category_id"]], x["bbox"], 3.5)
        assert r["is_crowd"] == (x["id"] % 3 == 0) and json.loads(r["segmentation"]) == x["segmentation"] and json.loads(r["attributes"]["attributes"]) == x["attributes"]
        assert r["supercategory"] == ("pet", None)[x["category_id"]]


def test_coco_faults(spark, tmp_path):
    doc = {
        "images": [{"id": 1, "file_name": "a.png"}, {"id": 2, "file_name": "./a.png"}, {"file_name": "b.png"}], "categories": [{"id": 1, "name": "x"}, {"id": -1, "name": "y"}, {"id": 3, "name": " "}],
        "annotations": [{"id": 1, "image_id": 1, "category_id": 1, "bbox": [0, 0, 1, 1], "segmentation": [[1, 2, 3]]}, {"id": 2, "image_id": 1, "category_id": 1, "bbox": [0, 0, 1, 1], "segmentation": [["a"]]}],
    }
    (tmp_path / "c.json").write_text(json.dumps(doc))
    assert sorted(r["code"] for r in datasets.read_coco(spark, str(tmp_path))[2].collect()) == ["BAD_CATEGORY", "BAD_CATEGORY", "BAD_SEGMENTATION", "BAD_SEGMENTATION", "DUPLICATE_PATH", "NO_ID"]
    (tmp_path / "c.json").write_text(json.dumps(doc)[:-40])
    assert datasets.read_coco(spark, str(tmp_path))[2].where(F.col("code") == "MALFORMED").count() == 1
