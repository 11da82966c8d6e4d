"""Periodic runs of words: maximal repetitions, found with a dictionary of basic factors.

A run is a stretch of words with smallest period q that no neighbouring word extends and that is at least `exponent`
periods and `least` words long. For every power of two the factors of that length are numbered (only those that occur
again in their text; others cannot be part of a run's period). At each place the next occurrence of the same factor, if
it begins within twice the factor's length, proposes its distance as a period. Neighbouring places with the same
distance are one progression; its first place is extended to both sides as far as words one period apart agree, by the
numbers of ever shorter factors. Equal stretches are proposed at several places, lengths and multiples of their period:
each counts once, with the smallest.

That finds all: in a run of period q a factor of the power of two from q to below 2q has its next occurrence exactly q
words on (sooner would give a smaller period), and with four periods at least one such place lies in the run. A stretch
proposed with a multiple of its period has at least eight of them, so it is also proposed with the period itself.

Texts are handled many at a time, each word as a number; a text's words are equal to no other text's. A text of n words
takes some 4 n bytes for each length at which factors still repeat. Null and empty texts have no words and no runs; null
ids are carried; rows that repeat get the same result each; an empty table gives an empty result. Other columns are not
carried.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bytes_of, col, id_and_text, small, small_batches, table
from .factors import common_extension, repeated_factors


def find_runs(symbols: np.ndarray, bounds: np.ndarray, least: int = 6, exponent: int = 4) -> np.ndarray:
    """start, stop and period of every run, by start and period. symbols: those of all sequences end to end, equal only within one; bounds: where sequences begin and the last ends. exponent: 4 or more."""
    if exponent < 4:
        raise ValueError("runs of fewer than four periods may have no proposing place")
    n = len(symbols)
    rest = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(n)
    names, proposed = repeated_factors(symbols, rest), []
    for k, level in enumerate(names):
        at = np.nonzero(level >= 0)[0]
        at = at[np.argsort(level[at], kind="stable")]
        same = level[at[1:]] == level[at[:-1]]
        place, gap = at[:-1][same], (at[1:] - at[:-1])[same]
        near = gap <= 2 << k
        place, gap = place[near], gap[near]
        gaps = np.zeros(n + 1, np.int64)
        gaps[place] = gap
        first = gaps[place - 1] != gap  # place 0 looks at the unused last entry
        proposed.append(np.column_stack([place[first], gap[first]]))
    place, period = np.unique(np.concatenate(proposed), axis=0).T if proposed else np.empty((2, 0), np.int64)
    start = place - common_extension(names, place, place + period, back=True)
    stop = place + period + common_extension(names, place, place + period)
    long = stop - start >= np.maximum(least, exponent * period)
    runs = np.column_stack([start, stop, period])[long]
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    once = np.append(True, (runs[1:, :2] != runs[:-1, :2]).any(axis=1))[: len(runs)]  # the smallest period of each stretch
    runs = runs[once]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


#: Texts are searched together up to so many words.
BLOCK_WORDS = 1 << 18


def _searched(texts: list[bytes], least: int, exponent: int):
    """(words, runs) of each text; many texts share one search."""
    held, size = [], 0

    def search():
        bounds = np.cumsum([0, *map(len, held)])
        numbers: dict = {}
        words = np.fromiter((numbers.setdefault(w, len(numbers)) for own in held for w in own), np.int64, int(bounds[-1]))
        runs = find_runs(np.repeat(np.arange(len(held)), np.diff(bounds)) << 32 | words, bounds, least, exponent)
        cut = np.searchsorted(runs[:, 0], bounds)
        for k, own in enumerate(held):
            yield own, runs[cut[k] : cut[k + 1]] - np.array([bounds[k], bounds[k], 0])

    for t in texts:
        held.append(t.split())  # bytes split at \x20 and \x09-\x0D only
        size += len(held[-1])
        if size >= BLOCK_WORDS:
            yield from search()
            held, size = [], 0
    if held:
        yield from search()


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words that no run contains after its first period, joined by one space."""
    if not len(runs):
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 1], -1)
    return b" ".join([words[i] for i in np.nonzero(np.cumsum(change[:-1]) == 0)[0].tolist()])


_RUNS = "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
_RUN = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))


def periodic_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 6, exponent: int = 4) -> DataFrame:
    """doc_id, runs (by start, then period) and the text without repetitions of every row."""

    def compute(batches):
        for b in small(batches):
            runs, texts = [], []
            for words, own in _searched(bytes_of(b.column("text")), least, exponent):
                runs.append([{"start": s, "length": e - s, "period": p} for s, e, p in own.tolist()])
                texts.append(collapsed(words, own))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(runs, _RUN), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "runs", "collapsed"])

    return id_and_text(df, id_col, text_col).mapInArrow(compute, _RUNS)


def described(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run (ties: the first, then the smallest period) and digests of all runs and of the collapsed text."""
    best = F.element_at(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period")))), 1)
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))))
    best = F.when(F.size("runs") > 0, best)
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    length, period = -F.col("best.less"), F.col("best.period")
    return rows.select("doc_id", "n_runs", F.col("best.start").alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def planted(id_: Column, text: Column) -> Column:
    """The text, of every tenth id (by crc32) with words repeated from a place on: word i >= a becomes word a + (i - a) % p."""
    h = F.crc32(id_.cast("string").cast("binary"))
    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    g = F.floor(h / 10)

    def repeat(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.transform(words, lambda w, i: F.when(i < a, w).otherwise(F.get(words, (a + (i - a) % p).cast("int"))))

    chosen = F.coalesce(h % 10 == 0, F.lit(False))
    new = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, F.array_join(repeat(w), " ")).otherwise(text))
    return F.when(chosen, new[0]).otherwise(text)


def op12_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    small_batches(spark)
    return described(periodic_runs(docs.select("doc_id", planted(col("doc_id"), col("text")).alias("text"))))
