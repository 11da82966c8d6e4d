"""Registered queries of lexicon, knowledge base, cluster, learning and catalogue operators. `queries` registers them when it is imported.

The lexicon is made from part: the nouns and adjectives of its names are words of a small tree, entity over thing over
the nouns over the names, and entity over quality over the adjectives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.functions import text as tx
from topicloom.operators import cluster, evaluate, kb, learn, lexicon, matchers, profile, select
from topicloom.operators.pairs import all_pairs
from topicloom.sources import catalogue

from .queries import BASE_SQL, PROFILE_SQL, PROFILED, TABLES, _base, inline, query, r6, stats, t, values_sql
from .sql import bigram_sql

joined = lambda c: F.array_join(c, "|").alias(c)

# ---- lexicon --------------------------------------------------------------------------------------------------

LEX_SQL = """nm AS (SELECT DISTINCT p_name AS name, split_part(p_name, ' ', 1) AS adj, split_part(p_name, ' ', 2) AS noun FROM part),
hyp AS (SELECT DISTINCT noun || '.n' AS child, 'thing.n' AS parent FROM nm UNION SELECT adj || '.n', 'quality.n' FROM nm UNION SELECT name || '.n', noun || '.n' FROM nm UNION SELECT 'thing.n', 'entity.n' FROM nm UNION SELECT 'quality.n', 'entity.n' FROM nm),
lem AS (SELECT DISTINCT noun AS lemma, noun || '.n' AS synset FROM nm UNION SELECT adj, adj || '.n' FROM nm UNION SELECT replace(name, ' ', '_'), name || '.n' FROM nm UNION SELECT name, noun || '.n' FROM nm),
opp AS (SELECT DISTINCT min(adj) AS lemma, max(adj) AS antonym FROM nm GROUP BY noun),
up AS (SELECT x AS synset, x AS ancestor, 0 AS distance FROM (SELECT child AS x FROM hyp UNION SELECT parent FROM hyp) UNION ALL SELECT synset, parent, distance + 1 FROM up JOIN hyp ON child = ancestor)"""
#: Path and Wu-Palmer similarity of every pair of synsets.
SIM_SQL = """dep AS (SELECT synset, max(distance) + 1 AS depth FROM up GROUP BY 1), common AS (SELECT x.synset AS a, y.synset AS b, depth, x.distance AS da, y.distance AS db FROM up x JOIN up y USING (ancestor) JOIN dep ON dep.synset = x.ancestor),
pathed AS (SELECT a, b, 1 / (1 + min(da + db)) AS path, max_by(2 * depth / (2 * depth + da + db), depth * 1000 - da - db) AS wup FROM common GROUP BY ALL)"""


class Lexicon:
    """lemma, hypernym, antonym and closure of the words of part."""

    def __init__(self, spark: SparkSession, d: str):
        words = F.split("p_name", " ")
        self.names = t(spark, d, "part").select(F.col("p_name").alias("name"), words[0].alias("adj"), words[1].alias("noun")).distinct()
        n = lambda c: F.concat(c, F.lit(".n"))
        edges = [(n("noun"), F.lit("thing.n")), (n("adj"), F.lit("quality.n")), (n("name"), n("noun")), (F.lit("thing.n"), F.lit("entity.n")), (F.lit("quality.n"), F.lit("entity.n"))]
        self.hypernym = self.names.select(F.explode(F.array(*[F.struct(a.alias("child"), b.alias("parent")) for a, b in edges])).alias("e")).select("e.*").distinct()
        lemmas = [(F.col("noun"), n("noun")), (F.col("adj"), n("adj")), (F.replace("name", F.lit(" "), F.lit("_")), n("name")), (F.col("name"), n("noun"))]
        self.lemma = self.names.select(F.explode(F.array(*[F.struct(a.alias("lemma"), b.alias("synset")) for a, b in lemmas])).alias("e")).select("e.*").distinct().withColumn("pos", F.lit("n")).withColumn("sense_no", F.lit(1))
        self.antonym = self.names.groupBy("noun").agg(F.min("adj").alias("lemma"), F.max("adj").alias("antonym")).select("lemma", "antonym").distinct()

    @property
    def closure(self) -> DataFrame:
        return lexicon.ancestors(self.hypernym)


@query(f"WITH RECURSIVE {LEX_SQL}, w AS (SELECT noun || 's' AS word, noun AS one FROM nm UNION SELECT adj, adj FROM nm) SELECT word, synset, 1 AS sense_no FROM w JOIN lem ON lemma = one")
def synset_lookup(spark, d):
    lex = Lexicon(spark, d)
    words = lex.names.select(F.concat("noun", F.lit("s")).alias("word")).unionAll(lex.names.select("adj")).distinct()
    return lexicon.synsets(words, lex.lemma)


@query(f"WITH RECURSIVE {LEX_SQL} SELECT synset, array_to_string(list_sort(list(DISTINCT replace(lemma, '_', ' '))), '|') AS names FROM lem WHERE replace(lemma, '_', ' ') NOT IN ('ring', 'red bolt') GROUP BY 1")
def synset_lemma_names(spark, d):
    lex = Lexicon(spark, d)
    return lexicon.lemma_names(lex.lemma, lex.lemma, ["ring", "red bolt"]).select("synset", joined("names"))


@query(f"""WITH RECURSIVE {LEX_SQL}, w AS (SELECT DISTINCT adj AS word FROM nm UNION SELECT noun FROM nm UNION SELECT 'unknown'), own AS (SELECT word, y.lemma FROM w JOIN lem x ON x.lemma = word JOIN lem y USING (synset))
SELECT word, coalesce((SELECT array_to_string(list_sort(list(DISTINCT lemma)), '|') FROM own o WHERE o.word = w.word), '') AS synonyms, coalesce((SELECT array_to_string(list_sort(list(DISTINCT antonym)), '|') FROM own o JOIN opp USING (lemma) WHERE o.word = w.word), '') AS antonyms FROM w""")
def synonyms_and_antonyms(spark, d):
    lex = Lexicon(spark, d)
    words = lex.names.select(F.col("adj").alias("word")).unionAll(lex.names.select("noun")).unionAll(inline(spark, [("unknown",)], "word string")).distinct()
    return lexicon.synonyms_antonyms(words, lex.lemma, lex.antonym).select("word", joined("synonyms"), joined("antonyms"))


THESAURUS_SQL = "l AS (SELECT DISTINCT p_name AS id, p_name AS text FROM part), r AS (SELECT DISTINCT p_type || p_name AS id, split_part(p_name, ' ', 2) || ' ' || lower(p_type) || ' ring' AS text FROM part), lw AS (SELECT DISTINCT id, unnest(string_split(text, ' ')) AS w FROM l), rw AS (SELECT DISTINCT id, unnest(string_split(text, ' ')) AS w FROM r)"


@query(f"""WITH RECURSIVE {LEX_SQL}, {SIM_SQL}, {THESAURUS_SQL}, wp AS (SELECT DISTINCT lw.w AS wa, rw.w AS wb FROM lw, rw), {bigram_sql("SELECT wa AS a, wb AS b FROM wp")},
known AS (SELECT wa, wb, max(path) AS score FROM wp JOIN lem x ON x.lemma = wa JOIN lem y ON y.lemma = wb JOIN pathed p ON p.a = x.synset AND p.b = y.synset GROUP BY ALL),
ws AS (SELECT * FROM known WHERE score > 0.3 UNION ALL SELECT wa, wb, score FROM wp JOIN sim s ON s.a = wa AND s.b = wb WHERE score > 0.6 AND NOT EXISTS (SELECT 1 FROM known k WHERE k.wa = wp.wa AND k.wb = wp.wb)),
best AS (SELECT lw.id AS left_id, rw.id AS right_id, max(score) AS score FROM lw JOIN ws ON wa = lw.w JOIN rw ON wb = rw.w GROUP BY ALL)
SELECT l.id AS left_id, r.id AS right_id, round(coalesce(score, 0), 6) AS score FROM l CROSS JOIN r LEFT JOIN best ON left_id = l.id AND right_id = r.id""")
def thesaurus_fallback(spark, d):
    lex, part = Lexicon(spark, d), t(spark, d, "part")
    left = part.select(F.col("p_name").alias("id"), F.col("p_name").alias("text")).distinct()
    right = part.select(F.concat("p_type", "p_name").alias("id"), F.concat(F.split("p_name", " ")[1], F.lit(" "), F.lower("p_type"), F.lit(" ring")).alias("text")).distinct()
    return lexicon.thesaurus_matcher(left, right, lex.lemma, lex.closure, threshold=0.3, fallback=True).select("left_id", "right_id", r6(F.col("score"), "score"))


@query(f"""WITH RECURSIVE {LEX_SQL}, {SIM_SQL}, lw AS (SELECT name AS id, unnest([adj, noun]) AS w FROM nm), rw AS (SELECT p_type AS id, unnest(string_split(lower(p_type) || ' ' || min(p_name), ' ')) AS w FROM part GROUP BY p_type),
one AS (SELECT lemma, synset FROM lem WHERE lemma NOT LIKE '% %')
SELECT lw.id AS left_id, rw.id AS right_id, round(sum(coalesce(wup, 0)) / count(*), 6) AS score FROM lw CROSS JOIN rw LEFT JOIN one x ON x.lemma = lw.w LEFT JOIN one y ON y.lemma = rw.w LEFT JOIN pathed p ON p.a = x.synset AND p.b = y.synset GROUP BY ALL""")
def phrase_wu_palmer(spark, d):
    lex = Lexicon(spark, d)
    left = lex.names.select(F.col("name").alias("id"), F.col("name").alias("text"))
    right = t(spark, d, "part").groupBy(F.col("p_type").alias("id")).agg(F.min("p_name").alias("n")).select("id", F.concat(F.lower("id"), F.lit(" "), "n").alias("text"))
    return lexicon.phrase_wu_palmer(left, right, lex.lemma, lex.closure).select("left_id", "right_id", r6(F.col("score"), "score"))


@query("""WITH m AS (SELECT x.o_orderpriority AS concept, x.o_orderstatus AS word, y.o_orderpriority AS other_concept, avg(y.o_totalprice) AS mean FROM orders x JOIN orders y USING (o_custkey) GROUP BY ALL),
o AS (SELECT concept, word, max(mean) AS best_other FROM m WHERE concept <> other_concept GROUP BY ALL)
SELECT m.concept, m.word, round(mean, 4) AS own, round(best_other, 4) AS best_other, coalesce(best_other > mean, false) AS leaves FROM m LEFT JOIN o USING (concept, word) WHERE m.concept = m.other_concept""")
def leaving_words(spark, d):
    orders = t(spark, d, "orders")
    mine = orders.select("o_custkey", F.col("o_orderpriority").alias("concept"), F.col("o_orderstatus").alias("word"))
    members = mine.join(orders.select("o_custkey", F.col("o_orderpriority").alias("other_concept"), F.col("o_totalprice").alias("score")), "o_custkey")
    return lexicon.leaves_concept(members).select("concept", "word", F.round("own", 4).alias("own"), F.round("best_other", 4).alias("best_other"), "leaves")


COVERAGE_SQL = """topics AS (SELECT DISTINCT p_name || ' ' || lower(p_type) || ' ' || p_size AS topic FROM part),
tw AS (SELECT topic, unnest(string_split(topic, ' ')) AS word FROM topics), mk AS (SELECT topic, word, word IN (SELECT noun FROM nm) AS e, word IN (SELECT lemma FROM lem) AS w FROM tw)"""


@query(f"""WITH RECURSIVE {LEX_SQL}, {COVERAGE_SQL} SELECT topic, round(avg(e::INT), 6) AS english_percent, round(avg(w::INT), 6) AS wordnet_percent, coalesce(array_to_string(list_sort(list(DISTINCT word) FILTER (e)), ' '), '') AS english, coalesce(array_to_string(list_sort(list(DISTINCT word) FILTER (w)), ' '), '') AS wordnet, max(regexp_matches(word, '^[+-]?[0-9]+$')) AS is_num FROM mk GROUP BY topic""")
def dictionary_coverage(spark, d):
    lex = Lexicon(spark, d)
    topics = t(spark, d, "part").select(F.concat_ws(" ", "p_name", F.lower("p_type"), "p_size").alias("topic")).distinct()
    found = lexicon.dictionary_coverage(topics, lex.names.select(F.col("noun").alias("word")), lex.lemma)
    return found.select("topic", r6(F.col("english_percent"), "english_percent"), r6(F.col("wordnet_percent"), "wordnet_percent"), "english", "wordnet", "is_num")


@query(f"""WITH RECURSIVE {LEX_SQL}, {SIM_SQL}, a AS (SELECT DISTINCT p_brand AS own, p_name AS attribute, unnest([split_part(p_name, ' ', 2) || '.n', p_name || '.n']) AS a FROM part), b AS (SELECT DISTINCT p_brand AS owner, split_part(p_name, ' ', 1) AS topic, unnest([split_part(p_name, ' ', 1) || '.n', 'small ring.n']) AS b FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY own, attribute, topic ORDER BY path DESC, own <> owner, owner, a, b) AS n FROM a CROSS JOIN b JOIN pathed p USING (a, b))
SELECT own AS dataset, attribute, topic, round(path, 6) AS score, a, b, owner FROM r WHERE n = 1""")
def context_similarity(spark, d):
    lex, part, words = Lexicon(spark, d), t(spark, d, "part"), F.split("p_name", " ")
    n = lambda c: F.concat(c, F.lit(".n"))
    attributes = part.select(F.col("p_brand").alias("dataset"), F.col("p_name").alias("name"), F.explode(F.array(n(words[1]), n("p_name"))).alias("synset"))
    topics = part.select(F.col("p_brand").alias("dataset"), words[0].alias("name"), F.explode(F.array(n(words[0]), F.lit("small ring.n"))).alias("synset"))
    return lexicon.context_similarity(attributes, topics, lex.closure).withColumn("score", F.round("score", 6))


ENRICHED_SQL = f"""WITH RECURSIVE {LEX_SQL}, names AS (SELECT p_brand AS dataset, name, list(DISTINCT type) || list(DISTINCT adj) || [name, 'thing'] AS words FROM (SELECT p_brand, split_part(p_name, ' ', 1) AS adj, split_part(p_name, ' ', 2) AS name, lower(p_type) AS type FROM part) GROUP BY p_brand, name),
defs AS (SELECT noun || '.n' AS synset, 'A ' || string_agg(DISTINCT adj, ', ' ORDER BY adj) || ' [thing]; large?' AS definition FROM nm GROUP BY noun),
near AS (SELECT child AS synset, parent AS other FROM hyp UNION ALL SELECT parent, child FROM hyp), lw AS (SELECT synset, unnest(string_split(lemma, '_')) AS w FROM lem),
tg AS (SELECT n.dataset, n.name, lem.synset, words, list_distinct(list_filter(string_split_regex(lower(regexp_replace(definition, '[\\[\\]()_,;.:!?"'']', ' ', 'g')), '\\s+'), lambda w: w <> '')
  || (SELECT coalesce(list(w), []) FROM lw WHERE lw.synset = lem.synset) || (SELECT coalesce(list(w), []) FROM near JOIN lw ON lw.synset = near.other WHERE near.synset = lem.synset) || (SELECT coalesce(list(antonym), []) FROM lem y JOIN opp USING (lemma) WHERE y.synset = lem.synset)) AS target
  FROM names n JOIN lem ON lem.lemma = n.name LEFT JOIN defs USING (synset))
SELECT dataset, name, synset, array_to_string(list_sort(list_filter(list_distinct(words), lambda w: w <> name)), '|') AS source_words, array_to_string(list_sort(list_filter(target, lambda w: w <> name)), '|') AS target_words,
array_to_string(list_sort(list_filter(list_distinct(words), lambda w: w <> name AND list_contains(target, w))), '|') AS overlap FROM tg"""


def _named(spark: SparkSession, d: str) -> tuple:
    """names, synset definitions and the lexicon of part."""
    lex, part, words = Lexicon(spark, d), t(spark, d, "part"), F.split("p_name", " ")
    names = part.groupBy(F.col("p_brand").alias("dataset"), words[1].alias("name")).agg(F.collect_set(F.lower("p_type")).alias("x"), F.collect_set(words[0]).alias("y")).select("dataset", "name", F.concat("x", "y", F.array("name", F.lit("thing"))).alias("words"))
    synset = lex.names.groupBy("noun").agg(F.sort_array(F.collect_set("adj")).alias("adjs")).select(F.concat("noun", F.lit(".n")).alias("synset"), F.concat(F.lit("A "), F.array_join("adjs", ", "), F.lit(" [thing]; large?")).alias("definition"))
    return names, synset, lex


@query(ENRICHED_SQL)
def enriched_names(spark, d):
    names, synset, lex = _named(spark, d)
    return lexicon.enrich(names, synset, lex.lemma, lex.hypernym, lex.antonym).select("dataset", "name", "synset", *map(joined, ("source_words", "target_words", "overlap")))


@query(ENRICHED_SQL)
def enriched_in_steps(spark, d):
    """The names of brands up to 3 first, then only those that have no contexts yet."""
    names, synset, lex = _named(spark, d)
    done = lexicon.enrich(names.filter("dataset < 'Brand#3'"), synset, lex.lemma, lex.hypernym, lex.antonym)
    return lexicon.enrich_missing(names, done, synset, lex.lemma, lex.hypernym, lex.antonym).select("dataset", "name", "synset", *map(joined, ("source_words", "target_words", "overlap")))


@query("""WITH s AS (SELECT doc_id AS id, unnest(string_split(regexp_replace(translate(regexp_replace(text, '[\\[\\](){}]', '', 'g'), '_', ' '), '([.!?])[ \\t\\n\\x0B\\f\\r]+', '\\1' || chr(1), 'g'), chr(1))) AS s, generate_subscripts(string_split(regexp_replace(translate(regexp_replace(text, '[\\[\\](){}]', '', 'g'), '_', ' '), '([.!?])[ \\t\\n\\x0B\\f\\r]+', '\\1' || chr(1), 'g'), chr(1)), 1) - 1 AS sentence FROM documents)
SELECT id, sentence::INT AS sentence, len(w) AS words, md5(array_to_string(w, ' ')) AS digest FROM (SELECT id, sentence, regexp_extract_all(s, '[\\p{L}\\p{N}]+(?:[''-][\\p{L}\\p{N}]+)*') AS w FROM s) WHERE len(w) > 0""")
def sentence_words(spark, d):
    words = lexicon.sentence_words(t(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"))
    listed = words.groupBy("id", "sentence").agg(F.transform(F.sort_array(F.collect_list(F.struct("position", "word"))), lambda x: x["word"]).alias("w"))
    return listed.select("id", "sentence", F.size("w").cast("long").alias("words"), F.md5(F.array_join("w", " ").cast("binary")).alias("digest"))


@query(f"""WITH RECURSIVE {LEX_SQL}, s AS (SELECT p_partkey AS id, ['The', split_part(p_name, ' ', 1), split_part(p_name, ' ', 2) || 's', p_type] AS w FROM part), x AS (SELECT id, unnest(w) AS word, unnest(range(0, 4)) AS position FROM s)
SELECT id, position::INT AS position, word, regexp_replace(lower(word), 's$', '') AS base FROM x WHERE regexp_replace(lower(word), 's$', '') IN (SELECT lemma FROM lem)""")
def noun_words(spark, d):
    lex = Lexicon(spark, d)
    words = lexicon.sentence_words(t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("The "), "p_name", F.lit("s ["), "p_type", F.lit("]!")).alias("text")))
    return lexicon.nouns(words, lex.lemma).select("id", "position", "word", "base")


@query(f"""WITH RECURSIVE {LEX_SQL}, x AS (SELECT DISTINCT 'tags' AS kind, p_brand AS dataset, p_name AS topic FROM part UNION SELECT 'groups', p_type, split_part(p_name, ' ', 2) || ' kinds' FROM part), tw AS (SELECT DISTINCT topic, unnest(string_split(topic, ' ')) AS word FROM x),
c AS (SELECT topic, avg((word IN (SELECT noun FROM nm))::INT) AS e, avg((word IN (SELECT lemma FROM lem))::INT) AS w FROM tw GROUP BY 1)
SELECT kind, x.topic, array_to_string(list_sort(list(dataset)), '|') AS sources, round(any_value(e), 6) AS english_percent, round(any_value(w), 6) AS wordnet_percent FROM x JOIN c USING (topic) GROUP BY kind, x.topic""")
def translated_concepts(spark, d):
    lex, part = Lexicon(spark, d), t(spark, d, "part")
    tags = part.select(F.col("p_brand").alias("dataset"), F.col("p_name").alias("topic")).distinct()
    groups = part.select(F.col("p_type").alias("dataset"), F.concat(F.split("p_name", " ")[1], F.lit(" kinds")).alias("topic")).distinct()
    found = lexicon.translated_concepts(tags, groups, lex.names.select(F.col("noun").alias("word")), lex.lemma)
    return found.select("kind", "topic", joined("sources"), r6(F.col("english_percent"), "english_percent"), r6(F.col("wordnet_percent"), "wordnet_percent"))


@query(f"""WITH s AS (SELECT *, row_number() OVER (PARTITION BY dataset, attr ORDER BY md5('1:' || value), value) AS n FROM ({PROFILE_SQL})), w AS (SELECT DISTINCT dataset, attr, unnest(string_split_regex(lower(value), '\\s+')) AS w FROM s WHERE n <= 100),
l AS (SELECT dataset, attr, avg(length(value)) >= 30 AS is_text FROM ({PROFILE_SQL}) GROUP BY ALL)
SELECT dataset, attr AS name, array_to_string(list_sort(list(w)), '|') AS words, any_value(is_text) AS is_text FROM w JOIN l USING (dataset, attr) WHERE w <> '' AND NOT contains(w, 'http') GROUP BY ALL""")
def attribute_words(spark, d):
    return lexicon.attribute_words(stats(spark, d)).select("dataset", "name", joined("words"), "is_text")


@query(f"""WITH RECURSIVE a AS (SELECT DISTINCT p_type AS dataset, p_name AS attr FROM part), tp AS (SELECT DISTINCT split_part(p_name, ' ', 2) AS topic FROM part UNION SELECT DISTINCT p_name FROM part WHERE p_name LIKE 'red %'), ex AS (SELECT DISTINCT p_name AS attr, split_part(p_name, ' ', 2) AS topic FROM part),
no AS (SELECT DISTINCT p_name AS attr, 'bolt' AS topic FROM part WHERE p_name LIKE 'hot %'), peers AS (SELECT DISTINCT split_part(p_name, ' ', 2) AS topic, split_part(p_name, ' ', 1) AS peer FROM part), {bigram_sql("SELECT topic AS a, attr AS b FROM tp, a")},
direct AS (SELECT dataset, attr, topic, 'exact' AS why FROM a JOIN ex USING (attr) UNION ALL SELECT dataset, attr, sim.a, 'name' FROM a JOIN sim ON sim.b = attr WHERE score > 0.5),
every AS (SELECT * FROM direct UNION ALL SELECT dataset, attr, peer, 'group' FROM direct JOIN peers USING (topic))
SELECT dataset, attr, topic, min(why) AS why FROM every e WHERE NOT EXISTS (SELECT 1 FROM no WHERE no.attr = e.attr AND no.topic = e.topic) GROUP BY ALL""")
def recommended_labels(spark, d):
    part, noun = t(spark, d, "part"), F.split("p_name", " ")[1]
    topics = part.select(noun.alias("topic")).unionAll(part.filter("p_name like 'red %'").select("p_name")).distinct()
    exact = part.select(F.col("p_name").alias("attr"), noun.alias("topic")).distinct()
    excluded = part.filter("p_name like 'hot %'").select(F.col("p_name").alias("attr"), F.lit("bolt").alias("topic")).distinct()
    peers = part.select(noun.alias("topic"), F.split("p_name", " ")[0].alias("peer")).distinct()
    return lexicon.recommended_labels(part.select(F.col("p_type").alias("dataset"), F.col("p_name").alias("attr")), topics, exact, excluded, peers)


@query("""WITH c AS (SELECT DISTINCT p_brand AS dataset, p_name AS topic FROM part), y AS (SELECT DISTINCT p_brand AS dataset, p_name AS topic FROM part WHERE p_size > 40), n AS (SELECT DISTINCT p_brand AS dataset, p_name AS topic FROM part WHERE p_size < 3), p AS (SELECT DISTINCT p_brand AS dataset, p_type AS topic FROM part UNION SELECT * FROM n)
SELECT * FROM p UNION SELECT * FROM (SELECT * FROM c INTERSECT SELECT * FROM y) EXCEPT SELECT * FROM n""")
def accepted_labels(spark, d):
    labels = lambda df, c: df.select(F.col("p_brand").alias("dataset"), F.col(c).alias("topic")).distinct()
    part = t(spark, d, "part")
    rejected = labels(part.filter("p_size < 3"), "p_name")
    return lexicon.accepted_labels(labels(part, "p_name"), labels(part.filter("p_size > 40"), "p_name"), rejected, labels(part, "p_type").unionAll(rejected))


@query("""WITH v AS (SELECT 'w' || vec_id AS word, list_transform(embedding, lambda x: x::DOUBLE) AS vec FROM embeddings UNION ALL SELECT 'w1 w2', list_transform(embedding, lambda x: x::DOUBLE) FROM embeddings WHERE vec_id = 99),
l AS (SELECT s_suppkey AS id, 'W' || s_nationkey || ' w' || (s_suppkey % 7) || CASE WHEN s_suppkey % 9 = 0 THEN ' w1 w2' ELSE ' none' END AS text FROM supplier), r AS (SELECT n_nationkey AS id, CASE WHEN n_nationkey = 24 THEN 'nothing' ELSE 'w' || (n_nationkey + 30) || ' w' || n_regionkey END AS text FROM nation),
lt AS (SELECT id, unnest(list_distinct(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS word FROM (SELECT id, string_split(lower(text), ' ') AS w FROM l)), rt AS (SELECT id, unnest(list_distinct(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS word FROM (SELECT id, string_split(lower(text), ' ') AS w FROM r)),
b AS (SELECT lt.id AS left_id, rt.id AS right_id, max(list_cosine_similarity(x.vec, y.vec)) AS best FROM lt JOIN v x ON x.word = lt.word, rt JOIN v y ON y.word = rt.word GROUP BY ALL)
SELECT l.id AS left_id, r.id AS right_id, round(coalesce(best, 0), 6) AS score FROM l CROSS JOIN r LEFT JOIN b ON left_id = l.id AND right_id = r.id""")
def phrase_vectors(spark, d):
    items = t(spark, d, "embeddings")
    vectors = items.select(F.concat(F.lit("w"), "vec_id").alias("word"), F.col("embedding").alias("vec")).unionAll(items.filter("vec_id = 99").select(F.lit("w1 w2"), "embedding"))
    left = t(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("W"), "s_nationkey", F.lit(" w"), F.col("s_suppkey") % 7, F.when(F.col("s_suppkey") % 9 == 0, " w1 w2").otherwise(" none")).alias("text"))
    right = t(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.when(F.col("n_nationkey") == 24, "nothing").otherwise(F.concat(F.lit("w"), F.col("n_nationkey") + 30, F.lit(" w"), "n_regionkey")).alias("text"))
    return matchers.phrase_similarity(left, right, vectors).select("left_id", "right_id", r6(F.col("score"), "score"))


# ---- knowledge base -------------------------------------------------------------------------------------------


@query("SELECT p_type AS concept, p_brand AS dataset FROM part UNION ALL SELECT lower(p_type), p_brand FROM part WHERE p_size > 25")
def added_datasources(spark, d):
    part = t(spark, d, "part")
    return kb.add_datasources(part.select(F.col("p_type").alias("concept"), F.col("p_brand").alias("dataset")), part.filter("p_size > 25").select(F.col("p_brand").alias("dataset"), F.lower("p_type").alias("concept")))


@query("SELECT l_suppkey AS dataset, array_to_string(list_sort(list(DISTINCT p_brand)), '|') AS topics FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000) GROUP BY 1")
def found_datasources(spark, d):
    owned = t(spark, d, "lineitem").join(t(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey")).groupBy(F.col("p_brand").alias("topic")).agg(F.collect_set("l_suppkey").alias("sources"))
    return kb.find_datasources(owned, t(spark, d, "supplier").filter("s_acctbal > 5000").select(F.col("s_suppkey").alias("dataset"))).select("dataset", joined("topics"))


CLUSTER_SQL = f"""{BASE_SQL}, old AS (SELECT concept, src_dataset, 'old' AS src_attr, 'O' AS tar_dataset, 'x' AS tar_attr, 1.0 AS score FROM (SELECT DISTINCT concept, src_dataset FROM sim_rows)),
found AS (SELECT concept, src_dataset, tar_dataset, tar_attr, score FROM (SELECT *, row_number() OVER (PARTITION BY concept, src_dataset, tar_dataset ORDER BY score DESC, src_attr, tar_attr) AS n FROM sim_rows) WHERE n = 1 AND score > 100),
known AS (SELECT f.concept, f.src_dataset, m.attribute AS src_attr, tar_dataset, tar_attr, score FROM found f JOIN m ON m.concept = f.concept AND m.dataset = f.src_dataset),
clusters AS (SELECT * FROM old o WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.concept = o.concept AND k.src_dataset = o.src_dataset AND k.tar_dataset = o.tar_dataset) UNION ALL SELECT * FROM known)"""


def _clusters(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    match, scores = _base(spark, d)
    old = scores.select("concept", "src_dataset", F.lit("old").alias("src_attr"), F.lit("O").alias("tar_dataset"), F.lit("x").alias("tar_attr"), F.lit(1.0).alias("score")).distinct()
    best = scores.select("concept", "src_dataset", "tar_dataset", "tar_attr", "score", "src_attr")
    found = select.best_per(best, ["concept", "src_dataset", "tar_dataset"], "src_attr").filter("score > 100").select("concept", "src_dataset", "src_attr", "tar_dataset", "tar_attr", "score")
    return match, kb.add_to_clusters(old, found, match).select("concept", "src_dataset", "src_attr", "tar_dataset", "tar_attr", "score")


@query(f"WITH {CLUSTER_SQL} SELECT concept, src_dataset, src_attr, tar_dataset, tar_attr, round(score, 4) AS score FROM clusters")
def extended_clusters(spark, d):
    return _clusters(spark, d)[1].withColumn("score", F.round("score", 4))


@query(f"WITH {CLUSTER_SQL} SELECT c.concept, src_dataset, tar_dataset, m.attribute AS src_attr, tar_attr, round(score, 4) AS score FROM clusters c JOIN m ON m.concept = c.concept AND m.dataset = c.src_dataset WHERE src_dataset = 'PROMO' OR tar_dataset = 'PROMO'")
def mappings_of_source(spark, d):
    return kb.mappings_of(kb.flatten(*_clusters(spark, d)), "PROMO").withColumn("score", F.round("score", 4))


@query(f"WITH {CLUSTER_SQL}, names AS (SELECT concept, src_dataset AS dataset, src_attr AS attr FROM clusters UNION SELECT concept, tar_dataset, tar_attr FROM clusters) SELECT DISTINCT a.dataset, b.attr AS topic FROM names a JOIN names b USING (concept)")
def cluster_topics(spark, d):
    return evaluate.cluster_topics(_clusters(spark, d)[1])


@query(f"WITH {BASE_SQL} SELECT DISTINCT dataset, concept AS topic FROM m")
def concepts_of_datasets(spark, d):
    return kb.concept_datasets(_base(spark, d)[0])[1]


@query("""WITH s AS (SELECT p_name AS topic, p_brand AS concept, avg(p_retailprice) AS score FROM part GROUP BY ALL), k AS (SELECT DISTINCT p_name AS concept FROM part WHERE p_size = 1)
SELECT topic, round(avg(score), 6) AS mean FROM s WHERE topic NOT IN (SELECT concept FROM k) GROUP BY 1 ORDER BY avg(score) DESC, topic LIMIT 5""")
def selected_new_concepts(spark, d):
    part = t(spark, d, "part")
    scores = part.groupBy(F.col("p_name").alias("topic"), F.col("p_brand").alias("concept")).agg(F.avg("p_retailprice").alias("score"))
    return kb.select_new_concepts(part.select(F.col("p_name").alias("topic")), part.filter("p_size = 1").select(F.col("p_name").alias("concept")), scores).withColumn("mean", F.round("mean", 6))


@query("SELECT DISTINCT o_orderpriority AS topic FROM orders WHERE o_orderpriority IN (SELECT o_orderpriority FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal < 500)")
def topics_in_scope(spark, d):
    orders = t(spark, d, "orders")
    owned = orders.select(F.col("o_orderpriority").alias("topic"), F.col("o_custkey").alias("dataset"))
    return kb.in_scope(orders.select(F.col("o_orderpriority").alias("topic")).distinct(), owned, t(spark, d, "customer").filter("c_acctbal < 500").select(F.col("c_custkey").alias("dataset")))


@query("SELECT DISTINCT l_suppkey AS dataset FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_brand = 'Brand#7'")
def donors_of_topic(spark, d):
    added = t(spark, d, "lineitem").join(t(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey")).select(F.col("l_suppkey").alias("dataset"), F.col("p_brand").alias("topic"))
    return kb.topic_sources(added, "Brand#7")


@query("SELECT DISTINCT 'parks' AS dataset, unnest([p_name, p_type]) AS topic FROM part")
def learned_topics(spark, d):
    return evaluate.learned_topics(t(spark, d, "part").select(F.col("p_name").alias("attr"), F.col("p_type").alias("topic")), "parks")


@query("""WITH s AS (SELECT c_custkey AS dataset, (c_acctbal > 0)::INT AS covered FROM customer), e AS (SELECT o_custkey AS dataset, max((o_orderstatus = 'F')::INT) AS covered FROM orders GROUP BY 1)
SELECT round(avg(0.5 * coalesce(s.covered, 0) + 0.5 * coalesce(e.covered, 0)), 6) AS coverage FROM s FULL JOIN e USING (dataset)""")
def toy_coverage(spark, d):
    schema = t(spark, d, "customer").select(F.col("c_custkey").alias("dataset"), (F.col("c_acctbal") > 0).cast("int").alias("covered"))
    entity = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("dataset")).agg(F.max((F.col("o_orderstatus") == "F").cast("int")).alias("covered"))
    return evaluate.coverage(schema, entity).select(r6(F.col("coverage"), "coverage"))


# ---- selection and clusters -----------------------------------------------------------------------------------


@query("SELECT o_orderkey, round(o_totalprice, 4) AS o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5")
def top_five(spark, d):
    return select.top_n(t(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey").withColumn("o_totalprice", F.round("o_totalprice", 4))


@query("""WITH c AS (SELECT p_brand AS dataset, p_type AS name, p_name AS synset, list(DISTINCT p_size) AS overlap FROM part GROUP BY ALL)
SELECT dataset, name, synset, len(overlap)::INT AS shared, (row_number() OVER (PARTITION BY dataset, name ORDER BY len(overlap) DESC, synset))::INT AS rank FROM c""")
def synsets_by_overlap(spark, d):
    contexts = t(spark, d, "part").groupBy(F.col("p_brand").alias("dataset"), F.col("p_type").alias("name"), F.col("p_name").alias("synset")).agg(F.collect_set("p_size").alias("overlap"))
    return select.ranked_by_overlap(contexts).select("dataset", "name", "synset", F.size("overlap").alias("shared"), "rank")


FEATURES_SQL = "f AS (SELECT n_nationkey AS id, [count(*) FILTER (c_mktsegment = 'AUTOMOBILE'), count(*) FILTER (c_mktsegment = 'BUILDING'), count(*) FILTER (c_mktsegment = 'MACHINERY'), count(*) FILTER (c_mktsegment = 'HOUSEHOLD')]::DOUBLE[] AS vec FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1)"


@query(f"""WITH RECURSIVE {FEATURES_SQL}, e AS (SELECT x.id AS a, y.id AS b FROM f x, f y WHERE x.id <> y.id AND 1 - list_cosine_similarity(x.vec, y.vec) <= 0.02), reach AS (SELECT id AS node, id AS seen FROM f UNION SELECT node, b FROM reach JOIN e ON a = seen)
SELECT node AS id, min(seen) AS "group" FROM reach GROUP BY 1""")
def single_linkage(spark, d):
    """Segments as features of nations; the distance is compared at nine places, as sums differ in the last."""
    counts = lambda s: F.sum((F.col("c_mktsegment") == s).cast("int")).cast("double")
    features = t(spark, d, "customer").groupBy(F.col("c_nationkey").alias("id")).agg(F.array(*map(counts, ("AUTOMOBILE", "BUILDING", "MACHINERY", "HOUSEHOLD"))).alias("vec"))
    return cluster.linkage(features, 0.02)


MATRIX_SQL = "mx AS (SELECT p_type AS a, p_brand AS b, avg(p_size) AS score FROM part GROUP BY ALL)"


@query(f"""WITH RECURSIVE {MATRIX_SQL}, v AS (SELECT r.a AS id, list(coalesce(mx.score, 0) ORDER BY al.a) AS vec FROM (SELECT DISTINCT a FROM mx) r CROSS JOIN (SELECT DISTINCT a FROM mx) al LEFT JOIN (SELECT a, replace(b, 'Brand#', '')::INT AS k, score FROM mx) mx ON mx.a = r.a AND mx.k = length(al.a) GROUP BY 1),
e AS (SELECT x.id AS a, y.id AS b FROM v x, v y WHERE x.id <> y.id AND 1 - list_cosine_similarity(x.vec, y.vec) <= 0.01), reach AS (SELECT id AS node, id AS seen FROM v UNION SELECT node, b FROM reach JOIN e ON a = seen)
SELECT "group", array_to_string(list_sort(list(node)), '|') AS topics FROM (SELECT node, min(seen) AS "group" FROM reach GROUP BY 1) GROUP BY 1""")
def topic_groups(spark, d):
    """A matrix of types by types: the mean size of the brand whose number is the length of the other type's name."""
    part = t(spark, d, "part")
    mean = part.groupBy(F.col("p_type").alias("a"), F.regexp_replace("p_brand", "Brand#", "").cast("int").alias("k")).agg(F.avg("p_size").alias("score"))
    matrix = all_pairs(part.select(F.col("p_type").alias("a")).distinct(), part.select(F.col("p_type").alias("b")).distinct()).withColumn("k", F.length("b")).join(mean, ["a", "k"], "left").select("a", "b", F.coalesce("score", F.lit(0.0)).alias("score"))
    return cluster.topic_groups(matrix, 0.01).select("group", joined("topics"))


@query(f"WITH {MATRIX_SQL}, k AS (SELECT a, b, round(score / 30, 4) AS score FROM mx WHERE score / 30 >= 0.85) SELECT a, b, score FROM k UNION ALL SELECT b, a, score FROM k WHERE a <> b")
def topic_pairs(spark, d):
    return cluster.topic_pairs(t(spark, d, "part").groupBy(F.col("p_type").alias("a"), F.col("p_brand").alias("b")).agg((F.avg("p_size") / 30).alias("score")), 0.85)


# ---- learning -------------------------------------------------------------------------------------------------


@query("SELECT attr AS name, coalesce(value, 'NA') AS value, class FROM (SELECT 'n_name' AS attr, n_name AS value, 'country' AS class FROM nation UNION ALL SELECT 'n_regionkey', nullif(n_regionkey, 2)::VARCHAR, 'key' FROM nation UNION ALL SELECT 'r_name', r_name, 'region' FROM region)")
def training_rows(spark, d):
    """Both tables are shorter than the sample, so all their cells are taken, repeated ones too."""
    tables = {"nation": t(spark, d, "nation").withColumn("n_regionkey", F.nullif("n_regionkey", F.lit(2))), "region": t(spark, d, "region")}
    mapping = inline(spark, [("nation", "n_name", "country"), ("nation", "n_regionkey", "key"), ("region", "r_name", "region")], "dataset string, attr string, topic string")
    return learn.training_data(tables, mapping).select("name", "value", "class")


@query("""WITH s AS (SELECT p_partkey AS row_id, p_brand AS name, p_type AS class, p_size / 50 AS x, p_retailprice / 2000 AS y FROM part), tk AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY md5('1:' || row_id), row_id) AS n FROM s),
m AS (SELECT name, class, avg(x * CASE class WHEN 'PROMO' THEN 2 ELSE 1 END + y * 0.5) AS score FROM tk WHERE n <= 100 GROUP BY ALL)
SELECT name, class, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY score DESC, class) AS k FROM m) WHERE k = 1""")
def predicted_classes(spark, d):
    part = t(spark, d, "part")
    one = lambda c, name: part.select(F.col("p_partkey").alias("row_id"), F.col("p_type").alias("class"), F.lit(name).alias("classifier"), c.alias("score"))
    scores = one(F.col("p_size") / 50, "x").unionAll(one(F.col("p_retailprice") / 2000, "y"))
    weights = part.select(F.col("p_type").alias("class")).distinct().select("class", F.explode(F.array(F.struct(F.lit("x").alias("classifier"), F.when(F.col("class") == "PROMO", 2.0).otherwise(1.0).alias("weight")), F.struct(F.lit("y").alias("classifier"), F.lit(0.5).alias("weight")))).alias("w")).select("class", "w.*")
    return learn.predicted_mapping(part.select(F.col("p_partkey").alias("row_id"), F.col("p_brand").alias("name")), scores, weights).withColumn("score", F.round("score", 6))


# ---- catalogue ------------------------------------------------------------------------------------------------

LINKS_SQL = "fl AS (SELECT DISTINCT 'x/' || replace(p_name, ' ', CASE WHEN p_size % 2 = 0 THEN '_' ELSE '-' END) || CASE WHEN p_size > 40 THEN 's' ELSE '' END || CASE WHEN p_size % 3 = 0 THEN '.csv' ELSE '.json' END AS file, p_name || CASE WHEN p_size > 40 THEN 's' ELSE '' END AS stem FROM part), ds AS (SELECT DISTINCT p_name AS dataset FROM part WHERE p_name NOT LIKE 'hot %')"


def _files(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    part = t(spark, d, "part")
    plural = F.when(F.col("p_size") > 40, "s").otherwise("")
    name = F.when(F.col("p_size") % 2 == 0, F.replace("p_name", F.lit(" "), F.lit("_"))).otherwise(F.replace("p_name", F.lit(" "), F.lit("-")))
    files = part.select(F.concat(F.lit("x/"), name, plural, F.when(F.col("p_size") % 3 == 0, ".csv").otherwise(".json")).alias("file")).distinct()
    return files, part.filter("p_name not like 'hot %'").select(F.col("p_name").alias("dataset")).distinct()


LINKED_SQL = f"""{LINKS_SQL}, rest AS (SELECT file, stem FROM fl WHERE stem NOT IN (SELECT dataset FROM ds)), {bigram_sql("SELECT stem AS a, dataset AS b FROM rest, ds")},
linked AS (SELECT file, stem AS dataset, 1.0::DOUBLE AS score FROM fl WHERE stem IN (SELECT dataset FROM ds) UNION ALL SELECT file, dataset, score FROM (SELECT file, b AS dataset, score, row_number() OVER (PARTITION BY file ORDER BY score DESC, b) AS n FROM rest JOIN sim ON a = stem WHERE score >= 0.8) WHERE n = 1)"""


@query(f"WITH RECURSIVE {LINKED_SQL} SELECT file, dataset, round(score, 6) AS score FROM linked")
def linked_files(spark, d):
    return catalogue.link_files(*_files(spark, d), threshold=0.8).withColumn("score", F.round("score", 6))


@query(f"""WITH RECURSIVE {LINKED_SQL}, dn AS (SELECT DISTINCT p_name AS dataset FROM part WHERE p_size = 1) SELECT file, dataset, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY ends_with(lower(file), '.csv') DESC, score DESC, file) AS n FROM linked) WHERE n = 1 AND dataset NOT IN (SELECT dataset FROM dn)""")
def files_to_convert(spark, d):
    done = t(spark, d, "part").filter("p_size = 1").select(F.col("p_name").alias("dataset")).distinct()
    return catalogue.files_to_convert(catalogue.link_files(*_files(spark, d), threshold=0.8), done).withColumn("score", F.round("score", 6))


@query(f"""WITH RECURSIVE {LINKED_SQL}, c AS (SELECT DISTINCT p_name AS dataset, p_type AS title FROM part) SELECT dataset, title, array_to_string(list_sort(list(file)), '|') AS files FROM c JOIN linked USING (dataset) GROUP BY ALL UNION ALL SELECT dataset, title, NULL FROM c WHERE dataset NOT IN (SELECT dataset FROM linked)""")
def datasources_and_tags(spark, d):
    shown = t(spark, d, "part").select(F.col("p_name").alias("dataset"), F.col("p_type").alias("title")).distinct()
    has, lacks = catalogue.datasources_and_tags(shown, catalogue.link_files(*_files(spark, d), threshold=0.8))
    return has.select("dataset", "title", F.array_join("source_filename", "|").alias("files")).unionAll(lacks.select("dataset", "title", F.lit(None).cast("string")))


@query("""SELECT lower(p_brand) AS dataset, (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1)::INT AS ordinal, lower(p_name) AS name, CASE WHEN lower(p_type) <> lower(p_name) THEN lower(p_type) END AS alias, CASE WHEN p_size > 25 THEN 'coded_values' END AS domain, CASE WHEN p_size > 25 THEN p_name || '|' || p_size END AS coded_values, 'esriFieldTypeString' AS data_type FROM part""")
def parsed_layers(spark, d):
    field = F.struct(F.upper("p_name").alias("name"), F.col("p_type").alias("alias"), F.lit("esriFieldTypeString").alias("type"), F.struct(F.when(F.col("p_size") > 25, "codedValue").otherwise("range").alias("type"), F.array(F.struct(F.col("p_name").alias("name")), F.struct(F.col("p_size").cast("string").alias("name"))).alias("codedValues")).alias("domain"))
    layers = t(spark, d, "part").groupBy("p_brand").agg(F.transform(F.sort_array(F.collect_list(F.struct("p_partkey", field.alias("f")))), lambda x: x["f"]).alias("fields"))
    return catalogue.parse_layers(layers.select(F.concat(F.lit("a/"), "p_brand", F.lit(".json")).alias("file"), F.struct("fields").alias("body"))).withColumn("coded_values", F.array_join("coded_values", "|"))


@query(f"""WITH a AS (SELECT dataset, attr, '{{' || string_agg('"' || value || '":' || cnt, ',' ORDER BY value) || '}}' AS j FROM ({PROFILE_SQL}) GROUP BY ALL) SELECT dataset, md5('{{' || string_agg('"' || attr || '":' || j, ',' ORDER BY attr) || '}}') AS digest FROM a GROUP BY 1""")
def stats_documents(spark, d):
    return catalogue.stats_json(stats(spark, d)).select("dataset", F.md5(F.col("json").cast("binary")).alias("digest"))


@query(f"SELECT dataset, attr, value, cnt FROM ({PROFILE_SQL}) WHERE dataset = 'customer' AND attr = 'c_mktsegment'")
def attribute_stats(spark, d):
    return catalogue.attribute_stats(stats(spark, d), "customer", "c_mktsegment")


@query("SELECT p_type AS topic, array_to_string(list_sort(list(DISTINCT p_brand)), '|') AS sources FROM part WHERE p_type IN (SELECT p_type FROM part WHERE p_size = 50 AND p_name LIKE '% ring') GROUP BY 1")
def wanted_topics(spark, d):
    part = t(spark, d, "part")
    topics = part.groupBy(F.col("p_type").alias("topic")).agg(F.sort_array(F.collect_set("p_brand")).alias("sources"))
    return catalogue.topic_sources(topics, part.filter("p_size = 50 and p_name like '% ring'").select(F.col("p_type").alias("topic"))).select("topic", joined("sources"))


@query(f"SELECT dataset, attr, value, cnt FROM ({PROFILE_SQL}) WHERE dataset = 'customer' AND attr IN ('c_name', 'c_acctbal')")
def source_bundle(spark, d):
    attrs = inline(spark, [("customer", "c_name"), ("customer", "c_acctbal"), ("customer", "latitude"), ("customer", "c_phone"), ("part", "p_name")], "dataset string, name string")
    topics = inline(spark, [("sales", ["customer"])], "topic string, sources array<string>")
    return catalogue.source_bundle("customer", attrs, stats(spark, d), topics)[1].select("dataset", "attr", "value", "cnt")


@query("SELECT p_type AS topic, p_brand AS dataset, array_to_string(list_sort(list(DISTINCT p_name)), '|') AS synsets FROM part WHERE p_size % 2 = 0 GROUP BY ALL")
def contexts_by_topic(spark, d):
    context = t(spark, d, "part").select(F.when(F.col("p_size") % 2 == 0, "topic").otherwise("attribute").alias("kind"), F.col("p_type").alias("name"), F.col("p_brand").alias("dataset"), F.col("p_name").alias("synset"))
    return catalogue.contexts_by_topic(context).select("topic", "dataset", joined("synsets"))


@query("""SELECT lower(p_type) AS dataset, p_brand AS name, p_name AS synset, array_to_string(list_sort(list(DISTINCT 's' || p_size)), '|') AS overlap FROM part WHERE p_size > 10 GROUP BY ALL""")
def consolidated_contexts(spark, d):
    own = F.when(F.col("p_size") > 10, F.array(F.concat(F.lit("s"), "p_size"))).otherwise(F.array().cast("array<string>"))
    files = t(spark, d, "part").select(F.concat(F.lit("x["), F.lower("p_type"), F.lit("_"), "p_brand", F.lit("].json")).alias("file"), F.create_map("p_name", own).alias("probs"))
    return catalogue.consolidate_contexts(files).select("dataset", "name", "synset", joined("overlap"))


@query("SELECT DISTINCT p_brand AS dataset, unnest([p_name, p_type]) AS topic FROM part")
def gold_labels(spark, d):
    return catalogue.ground_truth(t(spark, d, "part").select(F.concat(F.lit("["), "p_brand", F.lit("].csv")).alias("file"), F.array("p_name", "p_type").alias("topics")))


@query("""WITH e AS (SELECT event_id AS line_no, user_id AS file, event_type AS value FROM events), m AS (SELECT *, sum((value = 'click')::INT) OVER w AS section, sum((value = 'error')::INT) OVER w AS ended FROM e WINDOW w AS (PARTITION BY file ORDER BY line_no))
SELECT file, line_no, value, section::BIGINT AS section FROM m WHERE section > ended AND value <> 'click'""")
def running_sections(spark, d):
    return cluster.running_sections(t(spark, d, "events").select(F.col("user_id").alias("file"), F.col("event_id").alias("line_no"), F.col("event_type").alias("value")), "click", "error")


# ---- schema ---------------------------------------------------------------------------------------------------


@query("SELECT c_custkey AS \"c custkey\", c_name AS \"c name\", c_mktsegment AS \"c mktsegment\" FROM customer")
def cleaned_columns(spark, d):
    return profile.drop_columns(profile.clean_columns(t(spark, d, "customer")), ["c nationkey", "c acctbal", "not there"])


@query("""SELECT page_id, md5(array_to_string(list_filter(string_split_regex(lower(html), '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '' AND NOT contains(w, 'http')), ' ')) AS digest FROM pages""")
def value_texts(spark, d):
    return t(spark, d, "pages").select("page_id", F.md5(tx.value_text(F.col("html")).cast("binary")).alias("digest"))


@query("""WITH n AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1) SELECT a.n AS rows_source, b.n AS rows_target, round(least(greatest(floor(a.n * 0.01), 10), 100) * least(greatest(floor(b.n * 0.01), 10), 100) / (a.n * b.n), 9) AS confidence FROM (SELECT DISTINCT n FROM n) a, (SELECT DISTINCT n * 37 AS n FROM n) b""")
def match_confidence(spark, d):
    sizes = t(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).select("n").distinct()
    both = all_pairs(sizes.select(F.col("n").alias("rows_source")), sizes.select((F.col("n") * 37).alias("rows_target")))
    return both.withColumn("confidence", F.round(matchers.confidence_column(F.col("rows_source"), F.col("rows_target")), 9))


@query("SELECT 's' || min(p_size % 5) AS section, p_name AS dataset FROM part WHERE p_name NOT IN (SELECT p_name FROM part WHERE p_size = 50) GROUP BY p_name")
def open_batches(spark, d):
    part = t(spark, d, "part")
    sections = part.select(F.concat(F.lit("s"), F.col("p_size") % 5).alias("section"), F.col("p_name").alias("dataset"))
    return profile.open_batches(sections, part.filter("p_size = 50").select(F.col("p_name").alias("dataset")))


@query("SELECT o_custkey AS dataset FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderkey) >= 10 AND count(DISTINCT o_orderpriority) >= 5")
def guiding_candidates(spark, d):
    orders = t(spark, d, "orders")
    return profile.guiding_candidates(orders.select(F.col("o_custkey").alias("dataset"), F.col("o_orderkey").alias("attr")), orders.select(F.col("o_custkey").alias("dataset"), F.col("o_orderpriority").alias("topic")))


@query(f"""WITH l AS (SELECT dataset, attr, list(value ORDER BY rank) AS vals FROM (SELECT *, row_number() OVER (PARTITION BY dataset, attr ORDER BY cnt, value) AS rank FROM ({PROFILE_SQL})) WHERE rank <= 5 GROUP BY ALL), v AS (SELECT dataset, attr, [attr] || vals || list_transform(range(0, 5 - len(vals)), lambda i: vals[1]) AS v FROM l)
SELECT dataset, attr, unnest(range(0, 6))::INT AS row, unnest(v) AS value FROM v""")
def training_frames(spark, d):
    return learn.training_frame(stats(spark, d))


@query("""WITH p AS (SELECT DISTINCT o_orderpriority AS method, 'p' || (o_custkey % 4) AS plan, o_custkey AS dataset, o_orderstatus AS topic FROM orders), g AS (SELECT DISTINCT 'p' || (o_custkey % 4) AS plan, o_custkey AS dataset, o_orderstatus AS topic FROM orders WHERE o_totalprice > 200000), o AS (SELECT DISTINCT plan, dataset, topic FROM p WHERE method = '1-URGENT'),
n AS (SELECT plan, count(*) AS size, count(DISTINCT dataset) AS tables FROM g GROUP BY 1)
SELECT method, p.plan, round(count(*) FILTER ((p.plan, p.dataset, p.topic) IN (SELECT plan, dataset, topic FROM g)) / count(*), 6) AS "precision", round(count(*) FILTER ((p.plan, p.dataset, p.topic) IN (SELECT plan, dataset, topic FROM g)) / any_value(size), 6) AS recall,
round(count(*) FILTER (p.dataset IN (SELECT dataset FROM g) AND (p.plan, p.dataset, p.topic) NOT IN (SELECT plan, dataset, topic FROM o)) / any_value(tables), 6) AS new_topics FROM p JOIN n USING (plan) GROUP BY method, p.plan""")
def evaluated_runs(spark, d):
    orders = t(spark, d, "orders").select(F.col("o_orderpriority").alias("method"), F.concat(F.lit("p"), F.col("o_custkey") % 4).alias("plan"), F.col("o_custkey").alias("dataset"), F.col("o_orderstatus").alias("topic"), "o_totalprice")
    found = evaluate.evaluate_runs(orders, orders.filter("o_totalprice > 200000"), orders.filter("method = '1-URGENT'"))
    return found.select("method", "plan", *(r6(F.col(c), c) for c in ("precision", "recall", "new_topics")))


@query(f"""WITH RECURSIVE {LEX_SQL}, s AS (SELECT p_partkey AS id, unnest(['The', split_part(p_name, ' ', 1), split_part(p_name, ' ', 2) || 's', p_type]) AS word FROM part)
SELECT id, word, CASE WHEN lower(word) IN (SELECT adj FROM nm) THEN 'a' ELSE 'n' END AS pos, regexp_replace(lower(word), 's$', '') AS base FROM s""")
def parts_of_speech(spark, d):
    lex = Lexicon(spark, d)
    lemma = lex.lemma.join(lex.names.select(F.col("adj").alias("lemma"), F.lit("a").alias("p")).distinct(), "lemma", "left").withColumn("pos", F.coalesce("p", "pos"))
    words = lexicon.sentence_words(t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("The "), "p_name", F.lit("s ["), "p_type", F.lit("]!")).alias("text")))
    return lexicon.parts_of_speech(words, lemma).select("id", "word", "pos", "base")


@query("SELECT p_brand AS dataset, 'csv' AS format, p_name || '.csv' AS data FROM part")
def csv_resources(spark, d):
    files = t(spark, d, "part").select(F.col("p_brand").alias("dataset"), F.concat("p_name", F.lit(".csv")).alias("file"))
    return catalogue.csv_resources(files).select("dataset", "resource.format", "resource.data")


@query(f"""WITH RECURSIVE {LEX_SQL}, {SIM_SQL}, cl AS (SELECT unnest(['ring.n', 'bolt.n', 'red.n']) AS b, unnest(['r', 'b', 'r']) AS class), s AS (SELECT p_partkey AS row_id, p_name AS name FROM part), m AS (SELECT name, class, max(path) AS score FROM (SELECT DISTINCT name, unnest([adj || '.n', noun || '.n']) AS a FROM nm) n JOIN pathed p USING (a) JOIN cl USING (b) GROUP BY ALL)
SELECT row_id, class, round(coalesce(score, 0), 6) AS score FROM s CROSS JOIN (SELECT DISTINCT class FROM cl) c LEFT JOIN m USING (name, class)""")
def wordnet_classifier(spark, d):
    lex = Lexicon(spark, d)
    names = lex.names.select("name", F.explode(F.array(F.concat("adj", F.lit(".n")), F.concat("noun", F.lit(".n")))).alias("synset"))
    classes = inline(spark, [("r", "ring.n"), ("b", "bolt.n"), ("r", "red.n")], "class string, synset string")
    model = learn.WordNetClassifier(names, classes, lex.closure)
    model.fit(classes)
    return model.predict(t(spark, d, "part").select(F.col("p_partkey").alias("row_id"), F.col("p_name").alias("name"))).withColumn("score", F.round("score", 6))


@query("""WITH v AS (SELECT 'w' || vec_id AS word, list_transform(embedding, lambda x: x::DOUBLE) AS vec FROM embeddings), c AS (SELECT unnest(['w3 w4', 'w5', 'none']) AS class), n AS (SELECT DISTINCT p_size FROM part),
b AS (SELECT p_size, class, max(list_cosine_similarity(x.vec, y.vec)) AS score FROM n JOIN v x ON x.word = 'w' || p_size, c JOIN v y ON list_contains(string_split(class, ' '), y.word) GROUP BY ALL)
SELECT p_partkey AS row_id, class, round(coalesce(score, 0), 6) AS score FROM part CROSS JOIN c LEFT JOIN b USING (p_size, class)""")
def vector_classifier(spark, d):
    rows = t(spark, d, "part").select(F.col("p_partkey").alias("row_id"), F.concat(F.lit("w"), "p_size").alias("name"))
    classes = inline(spark, [("w3 w4",), ("w5",), ("none",)], "class string")
    model = learn.VectorClassifier(rows, classes, t(spark, d, "embeddings").select(F.concat(F.lit("w"), "vec_id").alias("word"), F.col("embedding").alias("vec")))
    model.fit(classes)
    return model.predict(rows).withColumn("score", F.round("score", 6))


# ---- entry B over the star schema -----------------------------------------------------------------------------

#: Table, topic, and the lexicon's word that it means.
TAGS = [("customer", "name", "ring"), ("customer", "account balance", "gear"), ("supplier", "names", "ring"), ("supplier", "money", "gear"), ("supplier", "nation", "plate"), ("part", "brand", "bolt"), ("part", "retail price", "anvil"), ("orders", "status", "red"), ("orders", "account", "blue"), ("lineitem", "price", "anvil"), ("lineitem", "tax", "gizmo"), ("nation", "state", "plate")]
#: What columns mean, by their names.
MEANT = {"name": "ring", "acctbal": "gear", "mktsegment": "widget", "nationkey": "plate", "brand": "bolt", "type": "widget", "retailprice": "anvil", "orderstatus": "red", "totalprice": "anvil", "orderdate": "old", "extendedprice": "anvil", "tax": "gizmo", "shipdate": "old"}


def star_catalogue(spark: SparkSession, d: str):
    """The star schema's columns and the tags above, with contexts in the lexicon of part and its closure."""
    from .guiding import Catalogue
    columns = [(name, c.partition("_")[2], i) for name in (*TABLES, "nation") for i, c in enumerate(t(spark, d, name).columns)]
    context = lambda rows: inline(spark, [(n, x, f"{m}.n", [m, x.split()[0]]) for n, x, m in rows], "dataset string, name string, synset string, overlap array<string>")
    meant = [(n, c, MEANT[c]) for n, c, _ in columns if c in MEANT]
    return Catalogue(inline(spark, [x[:2] for x in TAGS], "dataset string, topic string"), inline(spark, columns, "dataset string, attr string, ordinal int"), context(TAGS), context(meant), Lexicon(spark, d).closure)


_COLUMNS = [(name, c.partition("_")[2], i) for name, columns in {**TABLES, "nation": PROFILED["nation"]}.items() for i, c in enumerate(columns)]
STAR_SQL = f"""tags AS (SELECT * FROM {values_sql(TAGS, 'dataset, topic, m')}), cols AS (SELECT * FROM {values_sql(_COLUMNS, 'dataset, attr, ordinal')}), meant AS (SELECT * FROM {values_sql(list(MEANT.items()), 'attr, m')}),
words AS (SELECT c.dataset, c.attr, g.topic, max(path) AS word FROM cols c JOIN meant USING (attr) JOIN pathed ON a = meant.m || '.n' JOIN tags g ON b = g.m || '.n' GROUP BY ALL),
shared AS (SELECT attr, topic, max(len(list_intersect([meant.m, attr], [tags.m, split_part(topic, ' ', 1)]))) AS n FROM meant, tags GROUP BY ALL), {bigram_sql("SELECT topic AS a, attr AS b FROM tags, cols")}"""


def _mapped_sql(pairs: str, score: str, name: str) -> str:
    return f"""WITH RECURSIVE {LEX_SQL}, {SIM_SQL}, {STAR_SQL}, p AS (SELECT p.*, s.score AS ngram, coalesce(word, 0) AS wordnet, greatest(coalesce(n, 1), 1) AS overlap FROM ({pairs}) p JOIN sim s ON s.a = topic AND s.b = attr LEFT JOIN words w ON w.dataset = p.dataset AND w.attr = p.attr AND w.topic = p.topic LEFT JOIN shared h ON h.attr = p.attr AND h.topic = p.topic),
r AS (SELECT *, row_number() OVER (PARTITION BY dataset, attr ORDER BY score DESC, ordinal DESC, topic, score_name) AS n FROM (SELECT dataset, attr, topic, ordinal, {score} AS score, {name} AS score_name FROM p) WHERE score > 0.5)
SELECT dataset, topic AS concept, attr AS attribute, round(score, 6) AS match_score FROM r WHERE n <= 4"""


LOCAL_SQL = _mapped_sql("SELECT c.dataset, attr, ordinal, topic FROM cols c, (SELECT DISTINCT topic FROM tags)", "0.4::DOUBLE * ngram + 0.6::DOUBLE * wordnet", "CASE WHEN 0.4 * ngram >= 0.6 * wordnet THEN 'ngram' ELSE 'wordnet' END")


@query(LOCAL_SQL)
def local_topics(spark, d):
    """Every table's columns mapped to all tags, by names and meanings."""
    from .guiding import local_mapping

    return local_mapping(star_catalogue(spark, d)).drop("source_dataset").withColumn("match_score", F.round("match_score", 6))


@query(f"SELECT * FROM ({LOCAL_SQL}) WHERE dataset <> 'part'")
def local_topics_of_the_rest(spark, d):
    """The tables that are mapped already are left out."""
    from .guiding import local_mapping

    done = t(spark, d, "part").select(F.lit("part").alias("dataset")).distinct()
    return local_mapping(star_catalogue(spark, d), done=done).drop("source_dataset").withColumn("match_score", F.round("match_score", 6))


@query(_mapped_sql("SELECT DISTINCT c.dataset, attr, ordinal, topic FROM cols c JOIN tags USING (dataset)", "CASE WHEN ngram >= wordnet THEN ngram ELSE least(wordnet * overlap, 1) END", "CASE WHEN ngram >= wordnet THEN 'ngram' ELSE 'wordnet' END"))
def own_topics(spark, d):
    """Every table's columns mapped to the table's own tags; the winner of the matchers counts."""
    from .guiding import local_mapping

    return local_mapping(star_catalogue(spark, d), every_topic=False).drop("source_dataset").withColumn("match_score", F.round("match_score", 6))


@query()
def guiding_expansion(spark, d):
    """The whole of entry B over the star schema's tables."""
    from .guiding import expand

    return expand(star_catalogue(spark, d), "customer")[1]
