"""Lexicon operators on supplied tables.

lemma(lemma, pos, synset, sense_no), hypernym(child, parent), antonym(lemma, antonym).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicloom.functions.similarity import name_similarity
from topicloom.functions.text import singular
from topicloom.plans.checkpoints import checkpointed

from .names import similar_names
from .pairs import all_pairs, salted_join


def ancestors(hypernym: DataFrame) -> DataFrame:
    """L4: synset, ancestor, distance (the shortest; a synset is its own at 0), of trees and graphs of any depth. A cycle is an error.

    Distances double: who is 2^k away is reached over those exactly k away, so a chain of a thousand takes ten rounds.
    """
    edges = checkpointed(hypernym.select("child", "parent").distinct())
    nodes = edges.select(F.col("child").alias("synset")).unionAll(edges.select("parent")).distinct()
    found = checkpointed(nodes.select("synset", F.col("synset").alias("ancestor"), F.lit(0).alias("distance")).unionAll(edges.select(F.col("child").alias("synset"), F.col("parent").alias("ancestor"), F.lit(1).alias("distance"))))
    reach = 1
    while True:
        far = found.filter(F.col("distance") == reach).select("synset", F.col("ancestor").alias("via"))
        step = found.filter("distance > 0").select(F.col("synset").alias("via"), "ancestor", F.col("distance").alias("more"))
        beyond = far.join(step, "via").groupBy("synset", "ancestor").agg((F.min("more") + reach).alias("distance"))
        new = checkpointed(beyond.join(found.select("synset", "ancestor"), ["synset", "ancestor"], "left_anti"))
        if new.isEmpty():
            break
        found, reach = checkpointed(found.unionByName(new)), 2 * reach
    circle = edges.join(found.select(F.col("ancestor").alias("child"), F.col("synset").alias("parent")), ["child", "parent"]).first()
    if circle is not None:
        raise ValueError(f"{circle['child']} is an ancestor of itself")
    return found


def hyponyms(hypernym: DataFrame) -> DataFrame:
    """L4: synset, hyponym, distance."""
    return ancestors(hypernym).filter("distance > 0").select(F.col("ancestor").alias("synset"), F.col("synset").alias("hyponym"), "distance")


def path_similarity(closure: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) with score 1 / (1 + shortest path over a common ancestor); pairs without one are left out."""
    up = lambda s: closure.select(F.col("synset").alias(s), "ancestor", F.col("distance").alias(f"d{s}"))
    joined = pairs.select("a", "b").distinct().join(up("a"), "a").join(up("b"), ["b", "ancestor"])
    return joined.groupBy("a", "b").agg((1.0 / (1 + F.min(F.col("da") + F.col("db")))).alias("score"))


def wu_palmer(closure: DataFrame, pairs: DataFrame) -> DataFrame:
    """L2: pairs (a, b) with 2 depth(c) / (depth along c of a + of b), c the deepest common ancestor; a root has depth 1."""
    depth = closure.groupBy("synset").agg((F.max("distance") + 1).alias("depth"))
    up = lambda s: closure.select(F.col("synset").alias(s), "ancestor", F.col("distance").alias(f"d{s}"))
    joined = pairs.select("a", "b").distinct().join(up("a"), "a").join(up("b"), ["b", "ancestor"]).join(depth.withColumnRenamed("synset", "ancestor"), "ancestor")
    deepest = joined.withColumn("n", F.row_number().over(Window.partitionBy("a", "b").orderBy(F.desc("depth"), F.col("da") + F.col("db"), "ancestor"))).filter("n = 1")
    return deepest.select("a", "b", (2.0 * F.col("depth") / (2 * F.col("depth") + F.col("da") + F.col("db"))).alias("score"))


def synsets(words: DataFrame, lemma: DataFrame, pos: str = "n") -> DataFrame:
    """L3: word, synset, sense_no: senses of the word or of its singular, whichever has more."""
    nouns = lemma.filter(F.col("pos") == pos).select("lemma", "synset", "sense_no")
    as_is = words.select("word", F.col("word").alias("lemma"), F.lit(0).alias("form"))
    base = words.select("word", singular(F.col("word")).alias("lemma"), F.lit(1).alias("form"))
    found = as_is.unionAll(base).join(nouns, "lemma")
    counts = found.groupBy("word", "form").agg(F.count("*").alias("n"))
    better = counts.withColumn("r", F.row_number().over(Window.partitionBy("word").orderBy(F.desc("n"), "form"))).filter("r = 1").select("word", "form")
    return found.join(better, ["word", "form"]).select("word", "synset", "sense_no").distinct()


def lemma_names(synset: DataFrame, lemma: DataFrame, excluded: list[str]) -> DataFrame:
    """Synset, names: its lemmas with blanks, without excluded ones."""
    named = synset.select("synset").distinct().join(lemma, "synset").select("synset", F.replace("lemma", F.lit("_"), F.lit(" ")).alias("name")).filter(~F.col("name").isin(*excluded))
    return named.groupBy("synset").agg(F.sort_array(F.collect_set("name")).alias("names"))


def synonyms_antonyms(words: DataFrame, lemma: DataFrame, antonym: DataFrame) -> DataFrame:
    """Word, synonyms, antonyms."""
    own = words.join(lemma.select(F.col("lemma").alias("word"), "synset"), "word")
    same = own.join(lemma.select("synset", "lemma"), "synset")
    syn = same.groupBy("word").agg(F.sort_array(F.collect_set("lemma")).alias("synonyms"))
    anti = same.join(antonym, "lemma").groupBy("word").agg(F.sort_array(F.collect_set("antonym")).alias("antonyms"))
    return words.select("word").distinct().join(syn, "word", "left").join(anti, "word", "left").select("word", F.coalesce("synonyms", F.array().cast("array<string>")).alias("synonyms"), F.coalesce("antonyms", F.array().cast("array<string>")).alias("antonyms"))


def _words(df: DataFrame, id_: str, word: str) -> DataFrame:
    return df.select(F.col("id").alias(id_), F.explode(F.split("text", " ", -1)).alias(word)).filter(F.col(word) != "").distinct()


def thesaurus_matcher(left: DataFrame, right: DataFrame, lemma: DataFrame, closure: DataFrame, share: float = 0.4, threshold: float = 0.5, fallback: bool = False) -> DataFrame:
    """M6, M7: left_id, right_id, score of texts (id, text): a word pair's synset similarities, of which the best 40 % (one at least) count, if any is over the threshold; the highest of all word pairs, else 0.

    fallback=True keeps all similarities and gives words without senses their 2-gram similarity where it is over twice
    the threshold.
    """
    a, b = _words(left, "left_id", "wa"), _words(right, "right_id", "wb")
    pairs = all_pairs(a.select("wa").distinct(), b.select("wb").distinct())
    senses = synsets(a.select(F.col("wa").alias("word")).unionAll(b.select(F.col("wb").alias("word"))).distinct(), lemma).select("word", "synset")
    sense_pairs = pairs.join(senses.select(F.col("word").alias("wa"), F.col("synset").alias("a")), "wa").join(senses.select(F.col("word").alias("wb"), F.col("synset").alias("b")), "wb")
    scored = sense_pairs.join(path_similarity(closure, sense_pairs.select("a", "b").distinct()), ["a", "b"])
    order = Window.partitionBy("wa", "wb")
    ranked = scored.withColumn("n", F.row_number().over(order.orderBy(F.desc("score"), "a", "b"))).withColumn("all", F.count("*").over(order))
    kept = ranked if fallback else ranked.filter(F.col("n") <= F.greatest(F.ceil(F.col("all") * share), F.lit(1)))
    word_scores = kept.groupBy("wa", "wb").agg(F.max("score").alias("score")).filter(F.col("score") > threshold)
    if fallback:
        bare = pairs.join(sense_pairs.select("wa", "wb").distinct(), ["wa", "wb"], "left_anti").withColumn("score", name_similarity(F.col("wa"), F.col("wb"))).filter(F.col("score") > 2 * threshold)
        word_scores = word_scores.unionByName(bare.select("wa", "wb", "score"))
    best = a.join(word_scores, "wa").join(b, "wb").groupBy("left_id", "right_id").agg(F.max("score").alias("score"))
    every = all_pairs(left.select(F.col("id").alias("left_id")), right.select(F.col("id").alias("right_id")))
    return every.join(best, ["left_id", "right_id"], "left").select("left_id", "right_id", F.coalesce("score", F.lit(0.0)).alias("score"))


def phrase_wu_palmer(left: DataFrame, right: DataFrame, lemma: DataFrame, closure: DataFrame) -> DataFrame:
    """left_id, right_id, score: the sum over word pairs of the first noun senses' similarity, divided by the number of word pairs; unknown words add 0."""
    words = lambda df, i, w: df.select(F.col("id").alias(i), F.explode(F.split("text", " ", -1)).alias(w))
    first = lemma.filter("pos = 'n'").withColumn("n", F.row_number().over(Window.partitionBy("lemma").orderBy("sense_no", "synset"))).filter("n = 1").select("lemma", "synset")
    a = words(left, "left_id", "wa").join(first.select(F.col("lemma").alias("wa"), F.col("synset").alias("a")), "wa", "left")
    b = words(right, "right_id", "wb").join(first.select(F.col("lemma").alias("wb"), F.col("synset").alias("b")), "wb", "left")
    pairs = all_pairs(a, b)
    scores = wu_palmer(closure, pairs.filter("a is not null and b is not null").select("a", "b"))
    return pairs.join(scores, ["a", "b"], "left").groupBy("left_id", "right_id").agg((F.sum(F.coalesce("score", F.lit(0.0))) / F.count("*")).alias("score"))


def leaves_concept(members: DataFrame) -> DataFrame:
    """Concept, word, own, best_other: mean similarity of a word to its own concept's and the best other concept's words, and whether it should leave. members: concept, word, other_concept, score."""
    means = members.groupBy("concept", "word", "other_concept").agg(F.avg("score").alias("mean"))
    own = means.filter("concept = other_concept").select("concept", "word", F.col("mean").alias("own"))
    others = means.filter("concept <> other_concept").groupBy("concept", "word").agg(F.max("mean").alias("best_other"))
    return own.join(others, ["concept", "word"], "left").withColumn("leaves", F.coalesce(F.col("best_other") > F.col("own"), F.lit(False)))


def dictionary_coverage(phrases: DataFrame, english: DataFrame, lemma: DataFrame) -> DataFrame:
    """Topic, english_percent, wordnet_percent, english, wordnet, is_num. phrases: topic; english: word."""
    words = phrases.select("topic", F.explode(F.filter(F.split("topic", r"\s+"), lambda w: w != "")).alias("word"))
    marked = words.join(english.select("word", F.lit(1).alias("e")).distinct(), "word", "left").join(lemma.select(F.col("lemma").alias("word"), F.lit(1).alias("w")).distinct(), "word", "left")
    share = lambda c: F.avg(F.coalesce(F.col(c), F.lit(0)))
    known = lambda c: F.array_join(F.sort_array(F.collect_set(F.when(F.col(c) == 1, F.col("word")))), " ")
    return marked.groupBy("topic").agg(share("e").alias("english_percent"), share("w").alias("wordnet_percent"), known("e").alias("english"), known("w").alias("wordnet"), F.max(F.col("word").rlike(r"^[+-]?[0-9]+$")).alias("is_num"))


def context_overlap(left: DataFrame, right: DataFrame, parity: bool = False) -> DataFrame:
    """left_name, right_name, score: the most words that contexts (name, synset, overlap) of two names share. parity=True gives 0, as was observed of the original.

    Contexts meet by an equi-join on words, of which common ones are cut into blocks; names that share none get 0.
    """
    every = all_pairs(left.select(F.col("name").alias("left_name")).distinct(), right.select(F.col("name").alias("right_name")).distinct())
    if parity:
        return every.withColumn("score", F.lit(0))
    worded = lambda df, name, key, word: df.select(F.col("name").alias(name), F.struct("name", "overlap").alias(key), F.explode(F.array_distinct("overlap")).alias(word))
    a = worded(left, "left_name", "c", "word").select("left_name", F.xxhash64("c").alias("p"), F.hash("c").alias("p2"), "word").distinct()
    b = worded(right, "right_name", "c", "word").select("right_name", F.xxhash64("c").alias("q"), F.hash("c").alias("q2"), "word").distinct()
    shared = salted_join(a, b, ["word"]).groupBy("left_name", "p", "p2", "right_name", "q", "q2").agg(F.count("*").alias("n"))
    most = shared.groupBy("left_name", "right_name").agg(F.max("n").cast("int").alias("score"))
    return every.join(most, ["left_name", "right_name"], "left").select("left_name", "right_name", F.coalesce("score", F.lit(0)).alias("score"))


def context_similarity(attributes: DataFrame, topics: DataFrame, closure: DataFrame) -> DataFrame:
    """Attribute, topic, score, synsets and owner: the highest path similarity of any synsets of the two; a topic's contexts in the attribute's own table go before other tables' among equals. attributes: dataset, name, synset; topics: dataset, name, synset.

    Both sides' rings, each ancestor with the nearest synset below it, are made first, and meet by an equi-join on the
    ancestor: pairs of synsets are never listed. Of the ways over one ancestor only the nearest on either side can be
    the best, and of equally near ones the first. Common ancestors are cut into blocks.
    """
    a = attributes.select(F.col("dataset").alias("own"), F.col("name").alias("attribute"), F.col("synset").alias("a")).distinct()
    b = topics.select(F.col("dataset").alias("owner"), F.col("name").alias("topic"), F.col("synset").alias("b")).distinct()
    ring = lambda df, keys, s, near: df.join(closure.select(F.col("synset").alias(s), "ancestor", "distance"), s).groupBy(*keys, "ancestor").agg(F.min(F.struct("distance", s)).alias(near))
    left, right = ring(a, ["own", "attribute"], "a", "x"), ring(b, ["owner", "topic"], "b", "y")
    way = F.struct((F.col("x.distance") + F.col("y.distance")).alias("way"), (F.col("own") != F.col("owner")).alias("other"), "owner", F.col("x.a").alias("a"), F.col("y.b").alias("b"))
    best = salted_join(checkpointed(left), checkpointed(right), ["ancestor"]).groupBy("own", "attribute", "topic").agg(F.min(way).alias("best"))
    return best.select(F.col("own").alias("dataset"), "attribute", "topic", (1.0 / (1 + F.col("best.way"))).alias("score"), "best.a", "best.b", "best.owner")


def compare_words(source: Column, target: Column, guarded: Column) -> tuple[Column, Column, Column]:
    """Distinct source words, target words (both without guarded ones) and their overlap."""
    s = F.array_distinct(F.array_except(source, guarded))
    t = F.array_distinct(F.array_except(target, guarded))
    return s, t, F.array_intersect(s, t)


def enrich(names: DataFrame, synset: DataFrame, lemma: DataFrame, hypernym: DataFrame, antonym: DataFrame) -> DataFrame:
    """Dataset, name, synset, source_words, target_words, overlap: one context for each sense of a name.

    names: dataset, name, words (those of its description, notes and other topics); synset: synset, definition. The
    target words are those of the definition, its lemmas, antonyms, and its direct hypernyms' and hyponyms' lemmas.
    """
    tokens = lambda c: F.filter(F.split(F.lower(F.regexp_replace(c, r"[\[\]()_,;.:!?\"']", " ")), r"\s+"), lambda w: w != "")
    senses = names.join(synsets(names.select(F.col("name").alias("word")).distinct(), lemma).select(F.col("word").alias("name"), "synset"), "name")
    words_of = lemma.groupBy("synset").agg(F.flatten(F.collect_set(F.split("lemma", "_"))).alias("w"))
    near = hypernym.select(F.col("child").alias("synset"), F.col("parent").alias("other")).unionAll(hypernym.select(F.col("parent").alias("synset"), F.col("child").alias("other")))
    around = near.join(words_of.withColumnRenamed("synset", "other"), "other").groupBy("synset").agg(F.flatten(F.collect_list("w")).alias("around"))
    anti = lemma.join(antonym, "lemma").groupBy("synset").agg(F.collect_set("antonym").alias("anti"))
    empty = F.array().cast("array<string>")
    joined = senses.join(synset, "synset", "left").join(words_of, "synset", "left").join(around, "synset", "left").join(anti, "synset", "left")
    target = F.concat(tokens(F.coalesce("definition", F.lit(""))), F.coalesce("w", empty), F.coalesce("around", empty), F.coalesce("anti", empty))
    s, t, o = compare_words(F.coalesce("words", empty), target, F.split("name", " ", -1))
    return joined.select("dataset", "name", "synset", F.sort_array(s).alias("source_words"), F.sort_array(t).alias("target_words"), F.sort_array(o).alias("overlap"))


def enrich_missing(names: DataFrame, done: DataFrame, synset: DataFrame, lemma: DataFrame, hypernym: DataFrame, antonym: DataFrame) -> DataFrame:
    """The contexts that are there already (as of enrich) and those of names that have none yet; only these are made."""
    fresh = names.join(done.select("dataset", "name").distinct(), ["dataset", "name"], "left_anti")
    return done.unionByName(enrich(fresh, synset, lemma, hypernym, antonym))


def sentence_words(texts: DataFrame) -> DataFrame:
    """Id, sentence, position, word: sentences end at . ! ? followed by white space; brackets go and _ is a blank."""
    plain = F.translate(F.regexp_replace("text", r"[\[\](){}]", ""), "_", " ")
    cut = texts.select("id", F.posexplode(F.split(plain, r"(?<=[.!?])\s+")).alias("sentence", "s"))
    return cut.select("id", "sentence", F.posexplode(F.regexp_extract_all("s", F.lit(r"[\p{L}\p{N}]+(?:['-][\p{L}\p{N}]+)*"), F.lit(0))).alias("position", "word"))


def parts_of_speech(words: DataFrame, lemma: DataFrame) -> DataFrame:
    """Words with `base` and `pos` (n, v, a or r): the part of speech of the word's first sense in the lexicon, as it is or, for nouns, as a singular; of equal ones noun, verb, adjective, adverb in this order. Unknown words are nouns. A tagger can be put in its place."""
    forms = words.select("word").distinct().select("word", F.explode(F.array(F.lower("word"), singular(F.lower("word")))).alias("lemma")).distinct()
    found = forms.join(lemma.select("lemma", "pos", "sense_no"), "lemma").filter((F.col("lemma") == F.lower("word")) | (F.col("pos") == "n"))
    order = Window.partitionBy("word").orderBy("sense_no", F.array_position(F.array(*map(F.lit, "nvar")), F.col("pos")), "lemma")
    first = found.withColumn("n", F.row_number().over(order)).filter("n = 1").select("word", F.col("lemma").alias("base"), "pos")
    tagged = words.join(first, "word", "left")
    return tagged.withColumns({"base": F.coalesce("base", singular(F.lower("word"))), "pos": F.coalesce("pos", F.lit("n"))})


def nouns(words: DataFrame, lemma: DataFrame) -> DataFrame:
    """Words (with their singular as `base`) that the lexicon knows as nouns. A tagger can be put in its place."""
    based = words.withColumn("base", singular(F.lower("word")))
    return based.join(lemma.filter("pos = 'n'").select(F.col("lemma").alias("base")).distinct(), "base", "left_semi")


def translated_concepts(tags: DataFrame, groups: DataFrame, english: DataFrame, lemma: DataFrame) -> DataFrame:
    """Kind, topic, sources and dictionary coverage of tags and groups (dataset, topic)."""
    both = tags.select(F.lit("tags").alias("kind"), "dataset", "topic").unionByName(groups.select(F.lit("groups").alias("kind"), "dataset", "topic"))
    listed = both.groupBy("kind", "topic").agg(F.sort_array(F.collect_set("dataset")).alias("sources"))
    return listed.join(dictionary_coverage(listed.select("topic").distinct(), english, lemma), "topic", "left")


def attribute_words(stats: DataFrame, sample: int = 100, sentence: int = 30) -> DataFrame:
    """Dataset, name, words, is_text: an attribute's sampled values as words; long ones read as notes, short ones as topics."""
    from topicloom.functions.text import value_text

    from .profile import hashed_sample, mean_lengths

    sampled = hashed_sample(stats, ["dataset", "attr"], "value", sample)
    words = sampled.select("dataset", "attr", F.explode(F.split(value_text(F.col("value")), " ", -1)).alias("w")).filter("w <> ''").groupBy("dataset", "attr").agg(F.sort_array(F.collect_set("w")).alias("words"))
    return words.join(mean_lengths(stats, sentence), ["dataset", "attr"]).select("dataset", F.col("attr").alias("name"), "words", "is_text")


def recommended_labels(attrs: DataFrame, topics: DataFrame, exact: DataFrame, excluded: DataFrame, peers: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Dataset, attr, topic, why: candidates from an exact map (attr, topic), from names over the threshold, and from topics in a candidate's group (topic, peer), without excluded ones (attr, topic)."""
    by_map = attrs.select("dataset", "attr").join(exact, "attr").select("dataset", "attr", "topic", F.lit("exact").alias("why"))
    alike = similar_names(topics.select(F.col("topic").alias("a")), attrs.select(F.col("attr").alias("b")), threshold).select(F.col("a").alias("topic"), F.col("b").alias("attr"))
    by_name = attrs.select("dataset", "attr").distinct().join(alike, "attr").select("dataset", "attr", "topic", F.lit("name").alias("why"))
    direct = by_map.unionByName(by_name)
    by_group = direct.join(peers, "topic").select("dataset", "attr", F.col("peer").alias("topic"), F.lit("group").alias("why"))
    found = direct.unionByName(by_group).join(excluded, ["attr", "topic"], "left_anti")
    return found.groupBy("dataset", "attr", "topic").agg(F.min("why").alias("why"))


def accepted_labels(candidates: DataFrame, accepted: DataFrame, rejected: DataFrame, present: DataFrame) -> DataFrame:
    """The labels after a person's decisions: present ones and accepted candidates, without rejected ones."""
    keys = ["dataset", "topic"]
    new = candidates.select(keys).join(accepted.select(keys), keys, "left_semi")
    return present.select(keys).unionAll(new).distinct().join(rejected.select(keys), keys, "left_anti")
