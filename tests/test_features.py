import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoloom.functions import geo
from geoloom.sources import features, readers


def document(rng, n):
    """A collection with all that may mislead: braces, quotes and backslashes in texts, members before and after, nested lists."""
    odd = ['a"b', "c\\", '\\"', "}{", "][", '"features":[{', "é😀", "line\nbreak", "", "\\\\"]
    each = []
    for k in range(n):
        properties = {"id": k, "t": "".join(rng.choice(odd) for _ in range(rng.randint(0, 4))), "features": [{"x": rng.choice(odd)}] * rng.randint(0, 2), "o": {"p": {"q": rng.choice(odd)}}}
        each.append({"type": "Feature", "properties": properties, "geometry": None if k % 7 == 3 else {"type": "Polygon", "coordinates": [[[k, 0], [k + 1, 0], [k + 1, rng.randint(1, 9)], [k, 0]]]}})
    before = {"type": "FeatureCollection", "name": 'x"features":[', "crs": {"type": "name", "properties": {"name": "urn:ogc:def:crs:EPSG::3857"}}, "list": [{"a": 1}, {"b": [{}]}]}
    return {**before, "features": each, "bbox": [0, 0, 1, 1], "after": [{"type": "Feature"}]}


@pytest.mark.parametrize(("size", "indent"), [(97, None), (700, 2), (10**6, 2)])
def test_any_split_size(spark, tmp_path, size, indent):
    rng = random.Random(size)
    docs = [document(rng, 20), document(rng, 1), document(rng, 0)]
    for k, d in enumerate(docs):
        (tmp_path / f"{k}.geojson").write_text(json.dumps(d, indent=indent, ensure_ascii=False), encoding="utf-8")
    before = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        pieces = features.splits(spark, str(tmp_path))
        parts = pieces.select("file", "start").distinct().count()
        lines, beside = features.feature_lines(spark, str(tmp_path))
        got = [r.value for r in lines.collect()]
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    assert parts > 5 or size >= 4096
    by = lambda x: json.dumps(x, sort_keys=True)
    assert sorted(by(json.loads(t)) for t in got) == sorted(by(f) for d in docs for f in d["features"])
    assert [json.loads(t) for t in beside] == [{**d, "features": []} for d in docs]


def test_one_file_many_tasks(spark, tmp_path):
    d = document(random.Random(1), 400)
    path = tmp_path / "one.geojson"
    path.write_text(json.dumps(d), encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 20_000)
    try:
        assert features.splits(spark, str(path)).rdd.getNumPartitions() > 4
        l, crs = readers.read_geojson(spark, str(path))
        rows = {r.id: (r.t, r.g) for r in l.df.select("id", "t", geo.st_geometrytype(F.col("geometry")).alias("g")).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert crs == "EPSG:3857" and len(rows) == 400
    assert all(rows[f["properties"]["id"]] == (f["properties"]["t"], f["geometry"] and "POLYGON") for f in d["features"])


def test_what_is_no_collection(spark, tmp_path):
    for name, text in (("a", '{"x": [1, 2]}'), ("b", "nothing"), ("c", '{"features": {"a": 1}}')):
        (tmp_path / f"{name}.geojson").write_text(text)
        with pytest.raises(ValueError, match="isn't GeoJSON"):
            readers.read_geojson(spark, str(tmp_path / f"{name}.geojson"))
    (tmp_path / "d.geojson").write_text('{"type": "FeatureCollection", "features": [\n]}')
    assert readers.read_geojson(spark, str(tmp_path / "d.geojson"))[0].df.count() == 0


def test_quotes():
    text = rb'"a\"b" "\\" "\\\"" x'
    marks = features.quotes(np.frombuffer(text, np.uint8))
    assert [int(k) for k in np.flatnonzero(marks)] == [0, 5, 7, 10, 12, 17]
