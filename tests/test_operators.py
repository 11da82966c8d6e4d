"""Operators on small literal relations."""

import hashlib
import json
import random
import zipfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from topicloom.functions.drawing import Drawing
from topicloom.functions.similarity import array_cosine
from topicloom.operators import cluster, evaluate, kb, learn, lexicon, matchers, pairs, profile, select
from topicloom.plans import guiding, iterative
from topicloom.plans.params import Params
from topicloom.sources import catalogue
from topicloom.streaming.profile import stream_profile


def rows(df):
    return sorted(tuple(r) for r in df.collect())


PARKS = [(1, "Main St", "Green Park", None, "7", "North"), (2, "Second Ave", "Blue Park", None, "7", "South")]


def test_profile_and_unusable(spark):
    df = spark.createDataFrame(PARKS, "facilityid long, location string, park_name string, comments string, legacyid string, operating_location string")
    assert ("parks", "legacyid", "7", 2) in rows(profile.column_profile(df, "parks")) and not [r for r in rows(profile.column_profile(df, "parks")) if r[1] == "comments"]
    assert profile.clean_columns(df).columns[2] == "park name" and profile.drop_columns(df, ["legacyid", "nothing"]).columns[-1] == "operating_location"
    texts = spark.createDataFrame([("aaaa", "bbb", "ccc"), ("aaaa", "yyyy", "zzz"), ("xxx", "bbb", "zzz"), ("xxx", "None", "None")], "attr1 string, attr2 string, attr3 string")
    assert {r[1:] for r in rows(profile.column_profile(texts, "t"))} == {("attr1", "aaaa", 2), ("attr1", "xxx", 2), ("attr2", "bbb", 2), ("attr2", "yyyy", 1), ("attr2", "None", 1), ("attr3", "ccc", 1), ("attr3", "zzz", 2), ("attr3", "None", 1)}


def test_best_attribute_first_wins(spark):
    scores = spark.createDataFrame([("d", "youth", "location", 1, 0.25), ("d", "youth", "house no", 2, 0.25), ("d", "none", "location", 1, 0.0)], "dataset string, topic string, attribute string, ordinal int, score double")
    assert rows(select.best_attribute(scores)) == [("d", "none", None, 0.0), ("d", "youth", "location", 0.25)]


def test_potential_matches(spark):
    s = [("a", "x", 0.9), ("a", "y", 0.8), ("b", "x", 0.3), ("b", "y", 0.1), ("c", "x", 0.3), ("c", "y", 0.2), ("d", "x", 0.0), ("d", "y", 0.0)]
    assert rows(select.potential_matches(spark.createDataFrame(s, "r string, c string, score double"), "r", "c", 2.0)) == [("a", "x", 0.9), ("b", "x", 0.3), ("d", "x", 0.0), ("d", "y", 0.0)]


def test_fused_takes_the_last_of_equals(spark):
    s = spark.createDataFrame([("d", "a", f"t{i}", i, 0.9, 0.9) for i in range(6)], "dataset string, attribute string, topic string, ordinal int, n double, w double")
    assert [r["topic"] for r in select.fused_weighted(s, {"n": 0.4, "w": 0.6}).orderBy("rank").collect()] == ["t5", "t4", "t3", "t2"]


def test_instance_matrix(spark):
    source = spark.createDataFrame([("s", 1, "oak tree"), ("s", 2, "12"), ("s", 3, "None")], "attr string, ordinal int, value string")
    target = spark.createDataFrame([("t", 1, "oak trees"), ("t", 2, "13"), ("u", 1, None), ("u", 2, "oak tree")], "attr string, ordinal int, value string")
    stats = spark.createDataFrame([("t", "oak trees", 4), ("t", "13", 1), ("u", "oak tree", 2)], "attr string, value string, cnt long")
    from topicloom.functions.similarity import bigram_similarity

    got = {r[:2]: r[2] for r in rows(matchers.instance_matrix(source, target, stats, 0.6))}
    assert got[("s", "u")] == pytest.approx(2.0) and got[("s", "t")] == pytest.approx(4 * bigram_similarity(["oak tree"], ["oak trees"])[0] + bigram_similarity(["12"], ["13"])[0])
    assert matchers.confidence(1000, 50) == 10 * 10 / 50000 and matchers.confidence(0, 5) == 0


def test_positions(spark):
    from topicloom.operators.numbering import with_position, with_row_number

    df = spark.createDataFrame([("hot", i) for i in range(300)] + [("cold", 5), ("cold", 1), (None, 2), (None, 9)], "k string, o int").repartition(7)
    got = {(r["k"], r["o"]): (r["pos"], r["n"]) for r in with_position(df, "k", "o").collect()}
    assert all(got[("hot", i)] == (i, 300) for i in range(300)) and got[("cold", 5)] == (1, 2) and got[(None, 2)] == (0, 2)
    numbered, n = with_row_number(df.select(F.lit(1).alias("same")), ["same"])
    assert n == 304 and sorted(r["row_no"] for r in numbered.collect()) == list(range(304))
    assert with_row_number(df.limit(0), ["o"])[1] == 0
    folds = learn.folds(df.filter("k = 'hot'"), 7, "k", "o").groupBy("fold").count().orderBy("fold").collect()
    assert [r["count"] for r in folds] == [43] * 6 + [42]


def test_blocks_give_all_pairs(spark, monkeypatch):
    a, b = spark.range(30).withColumnRenamed("id", "a"), spark.range(50).withColumnRenamed("id", "b")
    keyed = lambda df, c: df.withColumn("k", F.col(c) % 2)
    assert pairs.all_pairs(keyed(a, "a"), keyed(b, "b"), ["k"]).distinct().count() == 750
    monkeypatch.setattr(pairs, "BROADCAST_ROWS", 10)
    assert pairs.all_pairs(a, b).distinct().count() == 1500
    assert pairs.all_pairs(keyed(a, "a"), keyed(b, "b"), ["k"]).distinct().count() == 750
    monkeypatch.setattr(pairs, "BLOCK_ROWS", 4)
    third = lambda df, c: df.withColumn("k", F.when(F.col(c) % 3 == 0, 0).otherwise(F.col(c)))
    assert sorted(map(tuple, pairs.salted_join(third(a, "a"), third(b, "b"), ["k"]).collect())) == sorted(map(tuple, third(a, "a").join(third(b, "b"), "k").collect()))
    assert pairs.salted_join(third(a, "a").limit(0), third(b, "b"), ["k"]).count() == 0


def test_long_sides_are_dealt(spark, monkeypatch):
    """Every pair once, in tasks of at most some blocks."""
    monkeypatch.setattr(pairs, "BROADCAST_ROWS", 100)
    a, b = spark.range(3_000).withColumnRenamed("id", "a"), spark.range(3_000).withColumnRenamed("id", "b")
    got = pairs.all_pairs(a, b).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.sum(F.col("a") * 7 + F.col("b")).alias("s")).collect()
    assert sum(r["n"] for r in got) == 3_000**2 and sum(r["s"] for r in got) == 8 * 3_000 * (3_000 * 2_999 // 2)
    assert len(got) > 1 and max(r["n"] for r in got) < 3_000**2 // 2


def test_kb(spark):
    base = spark.createDataFrame([("c", "d", "a", 0.5)], "concept string, dataset string, attribute string, match_score double")
    new = spark.createDataFrame([("c", "d", "b", 0.6, 1), ("c", "d", "z", 0.7, 2), ("c", "e", "b", 0.1, 1)], "concept string, dataset string, attribute string, match_score double, seq int")
    assert rows(kb.upsert(base, new, ["concept", "dataset"], "seq")) == [("c", "d", "z", 0.7), ("c", "e", "b", 0.1)]
    empty = spark.createDataFrame([], "concept string, src_dataset string, src_attr string, tar_dataset string, tar_attr string, score double")
    found = spark.createDataFrame([("c", "d", "other", "t", "x", 11.0), ("unknown", "d", "a", "t", "x", 12.0)], empty.schema)
    assert [tuple(r) for r in kb.add_to_clusters(empty, found, base).select("concept", "src_attr", "tar_attr").collect()] == [("c", "a", "x")]
    topics = spark.createDataFrame([("t1", ["a", "b"]), ("t2", ["b", "z"])], "topic string, sources array<string>")
    assert rows(kb.find_datasources(topics, spark.createDataFrame([("b",), ("a",)], "dataset string"))) == [("a", ["t1"]), ("b", ["t1", "t2"])]
    kb2 = spark.createDataFrame([("g", "trees", "x", ["o"]), ("g", "parks", "y", [])], "dataset string, concept string, attribute string, source_dataset array<string>")
    assert rows(kb.dataset_topics(kb2, "g")) == [("g", "parks"), ("o", "trees")]


def test_precision_recall(spark):
    ground = [(a, label) for label, attrs in {"l1": "abc", "l2": "def", "l3": "ghi"}.items() for a in attrs]
    first = [(1, a, label) for label, attrs in {"l1": "abx", "l2": "dyz", "l3": "gw"}.items() for a in attrs]
    second = [(2, a, label) for label, attrs in {"l1": "cq", "l2": "dv"}.items() for a in attrs]
    r = evaluate.precision_recall(spark.createDataFrame(ground, "item string, label string"), spark.createDataFrame(first + second, "labeling int, item string, label string")).first()
    assert tuple(r) == (5, 5 / 8, 5 / 9)
    none = evaluate.precision_recall(spark.createDataFrame([], "item string, label string"), spark.createDataFrame([], "labeling int, item string, label string")).first()
    assert none["precision"] == 0 and none["recall"] == 0


def test_clusters(spark):
    points = spark.createDataFrame([(i, [float(x), float(y)]) for i, (x, y) in enumerate([(1, 5), (2, 5), (3, 5), (1, -5), (2, -5), (3, -5)])], "id int, vec array<double>")
    assert {r["id"]: r["group"] for r in cluster.linkage(points, 0.2).collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 3}
    chain = spark.createDataFrame([(i, i + 1) for i in range(30)], "a int, b int")
    assert {r["root"] for r in cluster.connected(chain).collect()} == {0}
    two = cluster.two_means(spark.createDataFrame([(i, v) for i, v in enumerate([0.1, 0.2, 0.15, 0.9, 1.0])], "id int, value double"))
    assert [r["cluster"] for r in two.orderBy("id").collect()] == [0, 0, 0, 1, 1]


def test_inconsistent_groups():
    near, far = 0.1, 5.0
    d = np.full((6, 6), far)
    d[:3, :3] = d[3:, 3:] = near
    np.fill_diagonal(d, 0)
    got = cluster.inconsistent_groups(d, 0.9)
    assert len(set(got[:3])) == 1 and len(set(got[3:])) == 1 and got[0] == 1
    assert cluster.inconsistent_groups(np.zeros((1, 1)), 1).tolist() == [1]


def test_split_and_merge_lose_nothing(spark):
    members = spark.createDataFrame([("c", k, m) for k, ms in {"a": "xyz", "b": "xyz", "d": "pqr"}.items() for m in ms], "concept string, key string, member string")
    split = {r["key"]: r["new_concept"] for r in cluster.split_concepts(members, 0.5).collect()}
    assert set(split) == {"a", "b", "d"} and split["a"] == split["b"] == "c"
    full = spark.createDataFrame([(c, k, s, m) for c, k, s, ms in [("one", "k1", "s", "xyz"), ("two", "k2", "s", "xyz"), ("temp_one_2", "k3", "s", "xyz"), ("far", "k4", "t", "pq")] for m in ms], "concept string, key string, source string, member string")
    merged = {r["key"]: r["new_concept"] for r in cluster.merge_concepts(full, 0.1).collect()}
    assert merged == {"k1": "+one+two", "k2": "+one+two", "k3": "+one+two"}


def test_one_to_one(spark):
    c = spark.createDataFrame([("A", "x", "p"), ("B", "x", "p")], "topic string, `table` string, attr string")
    assert sorted(str(r["choice"]) for r in cluster.one_to_one(c).collect()) == sorted(map(str, [{"A": None, "B": None}, {"A": "p", "B": None}, {"A": None, "B": "p"}]))
    wide = spark.createDataFrame([(f"t{i:02}", "x", f"a{i}") for i in range(14)], "topic string, `table` string, attr string")
    assert cluster.one_to_one(wide).count() == 2**14
    assert cluster.linkage(spark.createDataFrame([(1, [1.0])], "id int, vec array<double>"), 0.2).count() == 0


@pytest.fixture(scope="module")
def lexicon_tables(spark):
    tree = spark.createDataFrame([("oak.n", "tree.n"), ("pine.n", "tree.n"), ("tree.n", "plant.n"), ("rose.n", "plant.n"), ("park.n", "place.n")], "child string, parent string")
    lemma = spark.createDataFrame([("oak", "n", "oak.n", 1), ("pine", "n", "pine.n", 1), ("tree", "n", "tree.n", 1), ("plant", "n", "plant.n", 1), ("rose", "n", "rose.n", 1), ("park", "n", "park.n", 1), ("green_space", "n", "park.n", 2)], "lemma string, pos string, synset string, sense_no int")
    return tree, lemma, lexicon.ancestors(tree).cache()


def test_lexicon(spark, lexicon_tables):
    tree, lemma, closure = lexicon_tables
    p = spark.createDataFrame([("oak.n", "pine.n"), ("oak.n", "rose.n"), ("oak.n", "park.n"), ("oak.n", "oak.n")], "a string, b string")
    assert rows(lexicon.path_similarity(closure, p)) == [("oak.n", "oak.n", 1.0), ("oak.n", "pine.n", 1 / 3), ("oak.n", "rose.n", 1 / 4)]
    assert dict((r[1], round(r[2], 6)) for r in rows(lexicon.wu_palmer(closure, p))) == {"pine.n": round(4 / 6, 6), "rose.n": round(2 / 5, 6), "oak.n": 1.0}
    assert rows(lexicon.synsets(spark.createDataFrame([("trees",), ("nothing",)], "word string"), lemma)) == [("trees", "tree.n", 1)]
    left, right = spark.createDataFrame([(1, "oak trees"), (2, "zzz")], "id int, text string"), spark.createDataFrame([(9, "tree")], "id int, text string")
    assert rows(lexicon.thesaurus_matcher(left, right, lemma, closure)) == [(1, 9, 1.0), (2, 9, 0.0)]
    names = spark.createDataFrame([("parks", "oak", ["pine", "big", "tree"])], "dataset string, name string, words array<string>")
    anti = spark.createDataFrame([], "lemma string, antonym string")
    got = lexicon.enrich(names, spark.createDataFrame([("oak.n", "a big tree; hard wood")], "synset string, definition string"), lemma, tree, anti).first()
    assert got["overlap"] == ["big", "tree"] and "oak" not in got["target_words"]
    done = spark.createDataFrame([("parks", "oak", "kept", ["a"], ["b"], ["c"])], "dataset string, name string, synset string, source_words array<string>, target_words array<string>, overlap array<string>")
    more = names.unionAll(spark.createDataFrame([("parks", "pine", ["tree"])], names.schema))
    found = lexicon.enrich_missing(more, done, spark.createDataFrame([("pine.n", "a tree")], "synset string, definition string"), lemma, tree, anti).collect()
    assert sorted((r["name"], r["synset"]) for r in found) == [("oak", "kept"), ("pine", "pine.n")]
    cover = lexicon.dictionary_coverage(spark.createDataFrame([("oak zzz",)], "topic string"), spark.createDataFrame([("oak",)], "word string"), lemma).first()
    assert (cover["english_percent"], cover["wordnet_percent"], cover["wordnet"]) == (0.5, 0.5, "oak")


def test_sentences_and_concepts(spark, lexicon_tables):
    _, lemma, _ = lexicon_tables
    texts = spark.createDataFrame([(1, "Big [old] oaks. A green_space?  It's new!")], "id int, text string")
    words = lexicon.sentence_words(texts)
    assert [(r["sentence"], r["word"]) for r in words.orderBy("sentence", "position").collect()] == [(0, "Big"), (0, "old"), (0, "oaks"), (1, "A"), (1, "green"), (1, "space"), (2, "It's"), (2, "new")]
    assert [r["word"] for r in lexicon.nouns(words, lemma).collect()] == ["oaks"]
    tags, groups = spark.createDataFrame([("d", "oak"), ("e", "oak")], "dataset string, topic string"), spark.createDataFrame([("d", "park zone")], "dataset string, topic string")
    got = lexicon.translated_concepts(tags, groups, spark.createDataFrame([("oak",)], "word string"), lemma)
    assert [(r["kind"], r["topic"], r["sources"], r["wordnet_percent"]) for r in got.orderBy("topic").collect()] == [("tags", "oak", ["d", "e"], 1.0), ("groups", "park zone", ["d"], 0.5)]


def test_command_line(spark, tmp_path):
    from topicloom.__main__ import main

    (tmp_path / "hubs.csv").write_text(",NAME\n0,a\n1,a\n")
    main(["profile", str(tmp_path / "hubs.csv"), str(tmp_path / "out")])
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == [("hubs", "NAME", "a", 2)]


def test_sources(spark, tmp_path):
    (tmp_path / "t.csv").write_text(',NAME,"LINE"\n0,a,"x\ny"\n1,b,\n')
    assert rows(catalogue.read_csv_table(spark, str(tmp_path / "t.csv"))) == [("a", "x\ny"), ("b", None)]
    (tmp_path / "g.json").write_text(json.dumps({"features": [{"properties": {"b": 1, "a": "x", "n": {"k": 1}}, "geometry": {"type": "Point"}}]}))
    got = catalogue.read_geojson(spark, str(tmp_path / "g.json"))
    assert got.columns == ["a", "b", "geometry_type"] and rows(got) == [("x", 1, "Point")]
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("dir/plain", "1")
        z.writestr("k.json", "{}")
    assert [r[0] for r in rows(catalogue.read_zip(spark, str(tmp_path / "z.zip")))] == ["k.json", "plain.csv"]
    (tmp_path / "hubs.json").write_text(json.dumps({"type": {"Hub": 5, "Site": 1}, "empty": {}}))
    assert rows(catalogue.read_stats_json(spark, str(tmp_path / "hubs.json"))) == [("hubs", "type", "Hub", 5), ("hubs", "type", "Site", 1)]
    stats = spark.createDataFrame([("d", "b", "2", 1), ("d", "a", "1", 3)], "dataset string, attr string, value string, cnt long")
    assert catalogue.stats_json(stats).first()["json"] == '{"a":{"1":3},"b":{"2":1}}'
    catalogue.write_stats(stats, str(tmp_path / "stats"))
    assert catalogue.attribute_stats(spark.read.parquet(str(tmp_path / "stats")), "d", "a").count() == 1
    files = spark.createDataFrame([("x/park trees.csv",), ("park_tree.csv",), ("zzz.csv",)], "file string")
    assert sorted((r["file"], r["dataset"]) for r in catalogue.link_files(files, spark.createDataFrame([("park trees",)], "dataset string")).collect()) == [("park_tree.csv", "park trees"), ("x/park trees.csv", "park trees")]
    probs = spark.createDataFrame([("[parks_oak].json", {"oak.n": ["big"], "tree.n": []}), ("[parks_oak].json", {"oak.n": ["old", "big"]})], "file string, probs map<string,array<string>>")
    assert rows(catalogue.consolidate_contexts(probs)) == [("parks", "oak", "oak.n", ["big", "old"])]


def test_layers(spark):
    body = [("x/SDE_Park.json", ([("PARK_NAME", "park_name", "esriFieldTypeString", None), ("Kind", "The Kind", "esriFieldTypeString", ("codedValue", [("a",), ("b",)]))],))]
    df = spark.createDataFrame(body, "file string, body struct<fields:array<struct<name:string,alias:string,type:string,domain:struct<type:string,codedValues:array<struct<name:string>>>>>>")
    assert [tuple(r) for r in catalogue.parse_layers(df).orderBy("ordinal").collect()] == [("sde park", 0, "park_name", None, None, None, "esriFieldTypeString"), ("sde park", 1, "kind", "the kind", "coded_values", ["a", "b"], "esriFieldTypeString")]


def test_learning(spark, tmp_path):
    tables = {"one": pd.DataFrame({"street": ["Main St", "Oak Ave", "Elm St", "Pine Rd"], "year": ["1999", "2004", "2010", "1987"]}), "two": pd.DataFrame({"addr": ["First St", "Lake Rd"], "built": ["1950", None]})}
    mapping = spark.createDataFrame([("one", "street", "road"), ("one", "year", "date"), ("two", "addr", "road"), ("two", "built", "date")], "dataset string, attr string, topic string")
    data = learn.training_data({k: spark.createDataFrame(v) for k, v in tables.items()}, mapping).cache()
    assert data.count() == 12 and data.filter("value = 'NA'").count() == 1
    same = learn.training_data({"t": spark.createDataFrame([("x",)] * 5 + [("y",)], "c string").repartition(3)}, spark.createDataFrame([("t", "c", "k")], "dataset string, attr string, topic string"))
    assert sorted(r["value"] for r in same.collect()) == ["x"] * 5 + ["y"] and same.select("row_id").distinct().count() == 6
    scores = learn.out_of_fold(learn.CharacterClassifier, data).withColumnRenamed("score", "chars")
    near = learn.NeighbourClassifier(k=1)
    near.fit(data)
    both = scores.join(near.predict(data).withColumnRenamed("score", "near"), ["row_id", "class"], "left").na.fill(0.0)
    weights = learn.meta_weights(both, data.select("row_id", "class"), ["chars", "near"])
    assert weights.count() == 4
    learn.save_weights(weights, str(tmp_path / "weights"))
    assert rows(learn.load_weights(spark, str(tmp_path / "weights"))) == rows(weights)
    long = both.select("row_id", "class", F.explode(F.create_map(F.lit("chars"), "chars", F.lit("near"), "near")).alias("classifier", "score"))
    mapped = {r["name"]: r["class"] for r in learn.predicted_mapping(data, long, weights).collect()}
    assert mapped["street"] == "road" and mapped["year"] == "date"


def test_drivers(spark):
    attrs = spark.createDataFrame([(d, n, i, "esriFieldTypeString", None, None) for d, names in {"parks": ["park name", "status"], "trees": ["tree species", "park"], "roads": ["road name"]}.items() for i, n in enumerate(names)], "dataset string, name string, ordinal int, data_type string, domain string, coded_values array<string>")
    cells = [("parks", "park name", i, v) for i, v in enumerate(["Green Park", "Blue Lake", "Old Mill"])] + [("trees", "park", i, v) for i, v in enumerate(["Green Park", "Green Park", "Old Mill"])] + [("roads", "road name", 0, "Main St")]
    values = spark.createDataFrame(cells, "dataset string, attr string, ordinal int, value string")
    stats = values.groupBy("dataset", "attr", "value").agg(F.count("*").alias("cnt"))
    topics = spark.createDataFrame([("parks", "parks")], "dataset string, topic string")
    vocabulary = spark.createDataFrame([("parks", "parks"), ("roads", "roads"), ("gone", "nowhere")], "dataset string, topic string")
    base = iterative.discover(topics, vocabulary, attrs, values, stats, Params(rounds=2, cluster_score=1.0))
    assert ("parks", "trees", "park") in {(r["src_dataset"], r["tar_dataset"], r["tar_attr"]) for r in base.cluster.collect()}
    assert {"parks", "roads"} <= {r["dataset"] for r in base.match.collect()}
    one = iterative.single_topic(topics, "parks", attrs, values, stats).collect()
    assert {(r["concept"], r["src_dataset"], r["src_attr"], r["tar_dataset"], r["tar_attr"]) for r in one} == {("parks", "parks", "park name", "trees", "park")}
    c = guiding.Catalogue(spark.createDataFrame([("g", "parks"), ("o", "park"), ("o", "zebra")], "dataset string, topic string"), spark.createDataFrame([("g", "park name", 0), ("o", "parks", 0)], "dataset string, attr string, ordinal int"))
    _, found = guiding.expand(c, "g", Params(rounds=2))
    assert ("g", "park") in {tuple(r) for r in found.collect()} and ("o", "parks") in {tuple(r) for r in found.collect()}


def test_stream(spark, tmp_path):
    spark.createDataFrame([("a", 1), ("a", 2)], "k string, n int").write.parquet(str(tmp_path / "in"))
    q = stream_profile(spark.readStream.schema("k string, n int").parquet(str(tmp_path / "in")), "d", "streamed")
    q.processAllAvailable()
    q.stop()
    assert ("d", "k", "a", 2) in rows(spark.table("streamed"))


def test_keys_of_many_pairs_are_dealt(spark):
    """A key of few rows but many pairs meets in many tasks."""
    a, b = spark.range(900).select(F.lit(1).alias("k"), F.col("id").alias("a")), spark.range(900).select(F.lit(1).alias("k"), F.col("id").alias("b"))
    got = pairs.salted_join(a, b, ["k"], most_pairs=10_000).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.sum(F.col("a") * 7 + F.col("b")).alias("s")).collect()
    assert sum(r["n"] for r in got) == 900**2 and sum(r["s"] for r in got) == 8 * 900 * (900 * 899 // 2)
    assert len(got) > 20 and max(r["n"] for r in got) < 900**2 // 8


@pytest.mark.parametrize(("least", "most"), [(1, None), (2, 3), (1, 1)])
def test_shared_topics_by_classes(spark, monkeypatch, least, most):
    """Items of equal topics share one ranking; pairs are neither counted nor sorted."""
    monkeypatch.setattr(matchers, "TASK_PAIRS", 50)
    rng = random.Random(5)
    sets = {i: set(rng.sample("abcd", rng.choice([0, 1, 2, 4]))) for i in range(40)}
    rows = [(i, t) for i, own in sets.items() for t in [*own, None]] * 2 + [(None, "a")]
    got = matchers.shared_topics(spark.createDataFrame(rows, "i int, t string"), "i", "t", least, most)
    want = []
    for a, own in sets.items():
        ranked = sorted((-len(own & other), b) for b, other in sets.items() if b != a and len(own & other) >= least)
        want += [(a, b, -n, k) for k, (n, b) in enumerate(ranked[:most], 1)]
    assert sorted((r["a"], r["b"], r["shared"], r["rank"]) for r in got.collect()) == sorted(want)
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_drawing_by_md5():
    rng = random.Random(1)
    names = ["".join(rng.choice("0123456789aé") for _ in range(rng.randrange(60))) for _ in range(700)]
    draw, free = Drawing(names), np.array([rng.random() < 0.7 for _ in names])
    digest = lambda p, x: hashlib.md5(p + x.encode()).hexdigest()
    for prefix in (b"3:1:", b"3:12:", b"", b"x" * 52, b"x" * 70):
        assert [f"{x:08x}" for x in draw.leading(prefix)] == [digest(prefix, x)[:8] for x in names]
        want = sorted((digest(prefix, x), k) for k, x in enumerate(names) if free[k])[:5]
        places, digests = draw.first(prefix, free, 5)
        assert [(d, int(k)) for k, d in zip(places, digests)] == want


@pytest.mark.parametrize("kind", ["long", "string"])
def test_table_mixes_by_cells(spark, monkeypatch, kind):
    """Blocks of tables give what all pairs give; tables without a name are never drawn."""
    monkeypatch.setattr(select, "CELL_TABLES", 20)
    rng = random.Random(2)
    sets = {(k if kind == "long" else f"t{k}"): set(rng.sample(range(25), rng.choice([0, 1, 2, 3]))) for k in range(70)}
    rows = [(k, t) for k, own in sets.items() for t in [*own, None]] * 2 + [(None, 1), (None, None)]
    got = select.table_mixes(spark.createDataFrame(rows, f"item {kind}, topic int"), 9, 4, seed=7).collect()
    want = []
    for a, own in sets.items():
        best = sorted((-len(own & other), b) for b, other in sets.items() if b != a and own & other)[:4]
        drawn = sorted((hashlib.md5(f"7:{a}:{b}".encode()).hexdigest(), b) for b, other in sets.items() if b != a and not own & other)[:5]
        want += [(a, b, True) for _, b in best] + [(a, b, False) for _, b in drawn if best]
    assert sorted((r["a"], r["b"], r["positive"]) for r in got) == sorted(want)
    assert select.table_mixes(spark.createDataFrame([], f"item {kind}, topic int"), 9, 4).count() == 0


def test_vector_neighbours_by_blocks(spark, monkeypatch):
    """Blocks of matrices give what all pairs give: copies, near ties in the tenth digit, odd vectors; and no pair leaves its task."""
    monkeypatch.setattr(matchers, "ITEM_NUMBERS", 300)
    monkeypatch.setattr(matchers, "QUERY_NUMBERS", 40)
    rng = np.random.default_rng(4)
    vecs = [list(map(float, rng.normal(size=6))) for _ in range(120)]
    vecs += [vecs[3]] * 30 + [[*vecs[3][:5], vecs[3][5] + rng.normal() * 1e-11] for _ in range(30)] + [[0.0] * 6, [], [1.0, 2.0], None, [1.0, None, 2.0, 3.0, 4.0, 5.0], [float("nan")] * 6]
    data = [*enumerate(vecs), (None, vecs[3])]
    items = spark.createDataFrame(data, "id int, vec array<double>")
    queries = items.filter("id % 9 = 3").select(F.col("id").alias("query_id"), F.col("vec").alias("query_vec"))
    found = matchers.vector_neighbours(queries, items, 7)
    scored = queries.crossJoin(items).filter("query_id <> id").withColumn("score", array_cosine(F.col("query_vec"), F.col("vec"))).filter("score IS NOT NULL")
    want = scored.withColumn("rank", F.expr("row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id)")).filter("rank <= 7")
    show = lambda df: sorted((r["query_id"], r["rank"], r["id"], str(r["score"])) for r in df.collect())
    assert show(found) == show(want)
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString() and found.columns == ["query_id", "id", "score", "rank"]
    assert matchers.vector_neighbours(queries, items.limit(0)).count() == 0 and matchers.vector_neighbours(queries.limit(0), items).count() == 0
