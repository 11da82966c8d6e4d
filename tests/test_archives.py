"""Zip members and GeoJSON features read by many tasks: the same rows as the whole read."""

import json
import random
import zipfile

import pytest

from topicloom.sources import archives, catalogue


def feature(rng, k):
    tricky = rng.choice(["plain", 'quote " and \\ backslash', '{"type":"Feature",', "braces }}{{ [", "é😀" * 5, "x" * rng.randrange(3000)])
    body = {"type": "Feature", "properties": {"id": k, "name": tricky, "height": rng.choice([None, 1.5, 2]), "nested": {"a": [1, {"b": "}"}]}}, "geometry": {"type": rng.choice(["Point", "Polygon"]), "coordinates": [k, [k]]}}
    if rng.random() < 0.2:  # written in another order
        body = dict(sorted(body.items()))
    return body


@pytest.mark.parametrize("step", [0, 1, 37, 900, 20_000, 1 << 25])
def test_features_by_ranges(spark, tmp_path, step):
    rng = random.Random(step)
    want = []
    for n, (count, indent) in enumerate([(60, None), (40, 1), (0, None), (1, None)]):
        own = [feature(rng, 100 * n + k) for k in range(count)]
        want += own
        text = json.dumps({"type": "FeatureCollection", "name": "c", "features": own, "after": [{"type": "Feature", "x": 1}] if n == 3 and step == 0 else []}, indent=indent, ensure_ascii=rng.random() < 0.5)
        (tmp_path / f"f{n}.json").write_text(text)
    reader = archives.FeatureReader({"path": str(tmp_path), "rangebytes": step})
    parts = reader.partitions()
    got = [json.loads(text) for p in (parts if step != 1 else parts[:0] or parts) for _, _, text in reader.read(p)]
    assert len(parts) >= (4 if step else 4) and sorted(map(str, got)) == sorted(map(str, want))


def test_geojson_table(spark, tmp_path):
    rng = random.Random(3)
    own = [feature(rng, k) for k in range(80)]
    (tmp_path / "g.json").write_text(json.dumps({"type": "FeatureCollection", "features": own}))
    df = catalogue.read_geojson(spark, str(tmp_path), range_bytes=4000)
    assert df.columns == ["height", "id", "name", "geometry_type"] and df.rdd.getNumPartitions() > 4
    assert sorted((r["id"], r["name"], r["height"], r["geometry_type"]) for r in df.collect()) == sorted((f["properties"]["id"], f["properties"]["name"], f["properties"]["height"], f["geometry"]["type"]) for f in own)
    assert catalogue.read_geojson(spark, str(tmp_path), flat=False).columns == ["height", "id", "name", "nested", "geometry_type"]
    (tmp_path / "g.json").write_text('{"type": "FeatureCollection", "features": []}')
    assert catalogue.read_geojson(spark, str(tmp_path)).count() == 0


def test_a_feature_that_is_cut_short(spark, tmp_path):
    (tmp_path / "g.json").write_text('{"features": [{"type": "Feature", "properties": {"a": 1}}, {"type": "Feature", "prop')
    with pytest.raises(Exception, match="cut short"):
        catalogue.read_geojson(spark, str(tmp_path)).collect()


def test_members_by_tasks(spark, tmp_path):
    want = []
    for n in range(3):
        with zipfile.ZipFile(tmp_path / f"z{n}.zip", "w", zipfile.ZIP_DEFLATED) as z:
            z.mkdir("folder")
            for k in range(20):
                body = bytes([k]) * (500 * k)
                z.writestr(f"folder/m{k}" + (".json" if k % 2 else ""), body)
                want.append((f"m{k}.json" if k % 2 else f"m{k}.csv", body))
    parts = archives.MemberReader({"path": str(tmp_path), "rangebytes": 5000}).partitions()
    assert len(parts) > 20 and sum(len(p.names) for p in parts) == 60
    assert sorted((r["file"], bytes(r["content"])) for r in catalogue.read_zip(spark, str(tmp_path)).collect()) == sorted(want)


def test_ranges_are_bounded(tmp_path, monkeypatch):
    """However small the ranges asked for, a folder has a bounded number, and a feature is cut out of its block without copying the rest."""
    monkeypatch.setattr(archives, "MOST_RANGES", 50)
    rng = random.Random(8)
    own = [feature(rng, k) for k in range(3000)]
    for n in range(3):
        (tmp_path / f"f{n}.json").write_text(json.dumps({"type": "FeatureCollection", "features": own[n::3]}, indent=n or None))
    reader = archives.FeatureReader({"path": str(tmp_path), "rangebytes": 64})
    parts = reader.partitions()
    assert len(parts) <= 53
    got = [(at, json.loads(text)) for p in parts for _, at, text in reader.read(p)]
    assert sorted(str(f) for _, f in got) == sorted(map(str, own))
