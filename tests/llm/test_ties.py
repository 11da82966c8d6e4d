"""Which of tied rows stays doesn't depend on how rows lie."""

import pytest

from topicloom.llm import exact_dedup, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "one two three four five six seven eight nine ten eleven twelve"
ROWS = [
    (1, "Hello", "en", "a", 1), (1, "HELLO", "en", "b", 2), (2, "same", "en", "a", 1), (2, "same", "de", "b", 1), (2, "same", None, "c", 9), (None, "x", "en", "a", 1), (None, "X", "en", "b", 1),
    (5, WORDS, "en", "a", 1), (5, WORDS, "fr", "b", 2), (5, WORDS.upper(), "fr", "c", 2),
]


def kept(spark, drop, rows):
    return sorted(map(str, drop(spark.createDataFrame(rows, SCHEMA).coalesce(1)).collect()))


@pytest.mark.parametrize("drop", [exact_dedup.drop_exact_duplicates, lambda df: exact_dedup.drop_exact_duplicates(df, keep="smallest"), simhash.drop_near_duplicates], ids=["largest", "smallest", "near"])
def test_order_of_rows_changes_nothing(spark, drop):
    one = kept(spark, drop, ROWS)
    assert one == kept(spark, drop, ROWS[::-1]) == kept(spark, drop, ROWS[3:] + ROWS[:3])


def test_one_of_each_group_stays(spark):
    assert len(kept(spark, exact_dedup.drop_exact_duplicates, ROWS)) == 4
