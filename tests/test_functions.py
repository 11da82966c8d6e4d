"""Scalar functions against fixed values and plain Python."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from topicloom.functions import similarity as sim
from topicloom.functions import text as tx

GOLDEN = [("activities", "facilityid", 0.35), ("environment", "comments", 0.318182), ("green", "work assignment", 0.3), ("health", "operational responsibility", 0.230769), ("nature", "status", 0.333333), ("parks", "park name", 0.5), ("walk", "park name", 0.333333), ("youth", "location", 0.25), ("trees", "tree", 0.8), ("trees", "tree species", 0.583333)]


def test_bigram_golden():
    got = sim.bigram_similarity([a for a, _, _ in GOLDEN], [b for _, b, _ in GOLDEN])
    assert [round(x, 6) for x in got] == [s for _, _, s in GOLDEN]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text("abc d", max_size=9), st.text("abc d", max_size=9)), min_size=1, max_size=20))
def test_bigram_properties(pairs):
    got = sim.bigram_similarity([a for a, _ in pairs], [b for _, b in pairs])
    assert all(0 <= s <= 1 for s in got)
    assert all(s == 1 for s, (a, b) in zip(got, pairs) if a == b)
    assert list(sim.bigram_similarity([a for a, _ in pairs] + ["longer than the others"], [b for _, b in pairs] + ["x y"]))[:-1] == list(got)  # a batch does not matter


def test_both_forms_agree(spark):
    rng = random.Random(7)
    words = ["", "a", None, *("".join(rng.choice("abcde ") for _ in range(rng.randrange(1, 12))) for _ in range(40))]
    df = spark.createDataFrame([(a, b) for a in words for b in words[:12]], "a string, b string")
    got = df.select("a", "b", sim.name_similarity(F.col("a"), F.col("b")).alias("x"), sim.name_similarity_native(F.col("a"), F.col("b")).alias("y")).collect()
    assert all(abs(r["x"] - r["y"]) < 1e-9 for r in got)
    sim.register_matchers(spark)
    assert round(spark.sql("SELECT name_similarity('parks', 'park name')").first()[0], 6) == 0.5


def test_argument_order_matters():
    a, b = sim.bigram_similarity(["tree species", "trees"], ["trees", "tree species"])
    assert a != b


@pytest.mark.parametrize("value,whole,number", [("12", True, True), (" -7 ", True, True), ("1_000", True, False), ("1.5", False, True), ("1e3", False, True), ("nan", False, True), ("1d", False, False), ("", False, False), ("_1", False, False), (None, False, False)])
def test_number_predicates(spark, value, whole, number):
    r = spark.createDataFrame([(value,)], "v string").select(tx.is_int(F.col("v")), tx.is_float(F.col("v"))).first()
    assert tuple(r) == (whole, number)


def test_names(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(tx.clean_name(F.lit("Park-Screen_Trees.csv"))) == "park screen trees csv"
    assert one(tx.clean_name(F.lit("SDE.Park  Trees.csv"), True, True)) == "park  trees"
    assert one(tx.strip_special(F.lit("  Étude_1: it's\tnew! "))) == "étude1 its new"
    assert one(tx.name_words(F.lit("parkNameID2x_FOO"))) == [w.lower() for w in re.findall("([a-z][a-z1-9]*|[1-9]+|[A-Z](?:[a-z1-9]+|[A-Z1-9]+))", "parkNameID2x_FOO")]
    assert one(tx.without_urls(F.lit("see http://x.y now (http://z)"))) == "see now"
    assert one(tx.value_text(F.lit("A https://b  C"))) == "a c" and one(tx.value_text(F.lit(None).cast("string"))) == ""


#: Everyday nouns whose plural adds s to the noun as it stands; those of other kinds follow in IRREGULAR_NOUNS.
REGULAR_NOUNS = """house course lease use gate park tree road street bridge river lake garden field school library hospital station office building
car truck bicycle boat train plane engine wheel driver traveller passenger ticket route signal lamp light pole pipe pump meter sensor cable
table chair desk door window wall floor roof room kitchen bed lamp mirror carpet clock picture frame shelf-mark bottle cup plate fork spoon knife-edge
dog cat horse cow-bell pig goat hen duck bird insect spider snake frog turtle rabbit bear tiger lion whale dolphin shark crab flower leaf-let seed root
branch-line stem forest mountain valley hill island coast harbour port market shop store bank hotel restaurant theatre museum gallery stadium arena pool
teacher student doctor nurse lawyer engineer farmer worker manager owner member guest visitor neighbour friend brother sister father mother son daughter
book page chapter letter word sentence paragraph story poem song film programme project plan report paper form file folder record note label name title
price cost rate tax fee fine loan debt budget grant fund account invoice payment receipt order purchase sale contract rule law court judge crime
number score point level grade rank test-case exam question answer problem solution method model system state stage step phase period decade
year month week day hour minute second season summer winter storm cloud wind temperature degree litre metre mile inch-mark gram tonne unit
apple orange banana grape lemon melon onion carrot bean pea egg steak cake sandwich-bar pizza burger salad soup sauce drink juice
game team player coach goal match-day race medal prize league tournament referee ball bat net racket helmet shirt jacket skirt sock hat scarf
computer screen keyboard printer network server client request response error warning message event user password token session image video
dataset column row value key index-card attribute topic concept catalogue resource format source target cluster group category type domain region zone
license initiative-paper archive native detective native motive archive fine lane cane zone tone stone phone microphone cone bone letterbox-key orchard vineyard meadow canal tunnel platform terminal airport runway corridor staircase balcony garage basement attic chimney fence hedge lawn fountain statue monument""".split()
IRREGULAR_NOUNS = {
    "activities": "activity", "cities": "city", "parties": "party", "facilities": "facility", "properties": "property", "countries": "country", "berries": "berry", "libraries": "library",
    "boxes": "box", "taxes": "tax", "foxes": "fox", "churches": "church", "benches": "bench", "watches": "watch", "branches": "branch", "bushes": "bush", "dishes": "dish", "classes": "class", "addresses": "address", "businesses": "business", "glasses": "glass",
    "potatoes": "potato", "tomatoes": "tomato", "heroes": "hero", "buses": "bus", "statuses": "status", "aliases": "alias", "shoes": "shoe", "movies": "movie", "wolves": "wolf", "halves": "half", "wives": "wife", "lives": "life", "knives": "knife",
    "analyses": "analysis", "crises": "crisis", "theses": "thesis", "diagnoses": "diagnosis", "bases": "basis", "matrices": "matrix", "vertices": "vertex", "indices": "index", "mice": "mouse", "databases": "database", "quizzes": "quiz",
    "people": "person", "men": "man", "women": "woman", "children": "child", "moves": "move", "media": "medium", "data": "datum", "news": "news", "series": "series", "species": "species", "sheep": "sheep", "fish": "fish", "equipment": "equipment", "glass": "glass", "initiatives": "initiative", "executives": "executive", "hives": "hive", "viruses": "viruse", "gas": "ga",
}


def test_singular(spark):
    want = {f"{w}s": w for w in REGULAR_NOUNS} | IRREGULAR_NOUNS
    got = {r["w"]: r["s"] for r in spark.createDataFrame([(w,) for w in want], "w string").select("w", tx.singular(F.col("w")).alias("s")).collect()}
    assert len(want) > 300 and {w: s for w, s in got.items() if s != want[w]} == {}


def test_module_names_are_unique():
    """Both test folders are collected together, without packages."""
    from pathlib import Path

    names = [f.name for f in Path(__file__).parent.rglob("test_*.py")]
    assert len(names) == len(set(names))


def test_composite(spark):
    row = spark.createDataFrame([(0.5, None), (1.0, 0.0), (None, None)], "a double, b double").select(sim.composite([F.col("a"), F.col("b")], [0.8, 0.2])).collect()
    assert round(row[0][0], 6) == 0.622459 and round(row[1][0], 6) == 0.689974 and row[2][0] is None
