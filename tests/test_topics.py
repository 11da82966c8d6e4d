"""Topic models by their properties."""

import random

from topicloom.operators.topics import topic_model


def test_topics_tell_vocabularies_apart(spark):
    rng = random.Random(1)
    kinds = [[f"{k}word{i}" for i in range(12)] for k in ("tree", "road")]
    texts = [(i, " ".join(rng.choice(kinds[i % 2]) for _ in range(40)) + " the and") for i in range(60)]
    df = spark.createDataFrame(texts, "id long, text string").repartition(2)
    rows = topic_model(df, k=2).collect()
    by = {}
    for r in rows:
        by.setdefault(r["id"], []).append((r["rank"], r["topic"], r["weight"]))
    assert len(by) == 60
    for own in by.values():
        own.sort()
        assert [x[0] for x in own] == [1, 2] and {x[1] for x in own} == {0, 1}
        assert abs(sum(x[2] for x in own) - 1) < 1e-9 and own[0][2] >= own[1][2] and own[0][2] > 0.9
    tops = [{by[i][0][1] for i in range(k, 60, 2)} for k in (0, 1)]
    assert len(tops[0]) == len(tops[1]) == 1 and tops[0] != tops[1]
    again = sorted((r["id"], r["topic"], round(r["weight"], 9)) for r in topic_model(df, k=2).collect())
    assert again == sorted((r["id"], r["topic"], round(r["weight"], 9)) for r in rows)


def test_words_that_are_not_counted(spark):
    """Words of one text alone and beyond the vocabulary are left out, so texts of such words have no weights."""
    texts = [(1, "park park tree"), (2, "park tree tree"), (3, "unique words only"), (4, "")]
    rows = topic_model(spark.createDataFrame(texts, "id long, text string"), k=2, vocabulary=1).collect()
    none = {r["id"] for r in rows if r["weight"] == 0}
    assert none == {3, 4} and len(rows) == 8
