"""The registered queries of the engine's own operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.functions import similarity as sim
from topicloom.functions import text as tx
from topicloom.operators import cluster, evaluate, kb, learn, lexicon, matchers, profile, select
from topicloom.operators.pairs import all_pairs
from topicloom.sources import catalogue

from .sql import bigram_sql, profile_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL if there is any."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def inline(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def values_sql(rows: list[tuple], columns: str) -> str:
    """The same rows for DuckDB."""
    show = lambda v: "NULL" if v is None else repr(v) if not isinstance(v, str) else "'" + v.replace("'", "''") + "'"
    return f"(VALUES {', '.join('(' + ', '.join(map(show, r)) + ')' for r in rows)}) AS v({columns})"


def r6(c: Column, name: str) -> Column:
    return F.round(c, 6).alias(name)


# ---- profiles -------------------------------------------------------------------------------------------------

PROFILED = {
    "region": ["r_regionkey", "r_name"], "nation": ["n_nationkey", "n_name", "n_regionkey"], "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"], "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
}
PROFILE_SQL = " UNION ALL ".join(profile_sql(name, columns) for name, columns in PROFILED.items())


def stats(spark: SparkSession, d: str) -> DataFrame:
    """The profile of the five tables, all their columns."""
    return reduce(DataFrame.unionAll, [profile.column_profile(t(spark, d, name).select(*columns), name) for name, columns in PROFILED.items()])


@query(PROFILE_SQL)
def column_profile(spark, d):
    return stats(spark, d)


@query(f"SELECT dataset, attr, rank::INT AS rank, value, cnt FROM (SELECT *, row_number() OVER (PARTITION BY dataset, attr ORDER BY cnt DESC, value) AS rank FROM ({PROFILE_SQL})) WHERE rank <= 2")
def profile_top2(spark, d):
    return profile.top_values(stats(spark, d))


@query(f"""SELECT dataset, attr, array_to_string(list_concat(vals, list_transform(range(0, 5 - len(vals)), lambda i: vals[1])), '|') AS vals FROM (
SELECT dataset, attr, list(value ORDER BY rank) AS vals FROM (SELECT *, row_number() OVER (PARTITION BY dataset, attr ORDER BY cnt, value) AS rank FROM ({PROFILE_SQL})) WHERE rank <= 5 GROUP BY ALL)""")
def profile_rarest5(spark, d):
    return profile.rarest_values(stats(spark, d)).select("dataset", "attr", F.array_join("vals", "|").alias("vals"))


@query(f"SELECT dataset, attr, round(avg(length(value)), 6) AS mean_length, avg(length(value)) >= 15 AS is_text FROM ({PROFILE_SQL}) GROUP BY ALL")
def mean_value_length(spark, d):
    return profile.mean_lengths(stats(spark, d), sentence=15).select("dataset", "attr", r6(F.col("mean_length"), "mean_length"), "is_text")


def _values_sql(table: str, columns: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT '{table}' AS dataset, '{c}' AS attr, {c}::VARCHAR AS value FROM {table}" for c in columns)


MIXED = {"customer": ["c_name", "c_nationkey", "c_acctbal"], "orders": ["o_orderkey", "o_orderstatus", "o_orderpriority"], "events": ["user_id", "event_type", "value"]}
MIXED_SQL = " UNION ALL ".join(_values_sql(k, v) for k, v in MIXED.items())


def mixed(spark: SparkSession, d: str) -> DataFrame:
    parts = [profile.long_values(t(spark, d, k).select(*v), k) for k, v in MIXED.items()]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


@query(f"SELECT dataset, attr, CASE WHEN avg(CASE WHEN value IS NULL OR NOT regexp_matches(value, '(?i)^\\s*[+-]?((([0-9]+\\.?[0-9]*)|(\\.[0-9]+))(e[+-]?[0-9]+)?|nan|inf|infinity)\\s*$') THEN 1.0 ELSE 0.0 END) > 0.7 THEN 'str' ELSE 'num' END AS guess FROM ({MIXED_SQL}) GROUP BY ALL")
def type_guess(spark, d):
    return profile.guessed_types(mixed(spark, d))


@query(f"SELECT dataset, attr, count(*) FILTER (regexp_matches(value, '^\\s*[+-]?[0-9]+(_[0-9]+)*\\s*$')) AS ints, count(*) AS n FROM ({MIXED_SQL}) GROUP BY ALL")
def int_predicate(spark, d):
    return mixed(spark, d).groupBy("dataset", "attr").agg(F.sum(tx.is_int(F.col("value")).cast("long")).alias("ints"), F.count("*").alias("n"))


@query("SELECT p_type AS data_type, count(*) AS cnt FROM part GROUP BY 1")
def data_type_census(spark, d):
    return profile.type_census(t(spark, d, "part").select(F.col("p_type").alias("data_type")))


@query("""SELECT p_partkey, trim(lower(translate(p_brand || '_' || p_name || '.csv', '-_.', '   ')), ' ') AS cleaned,
trim(lower(array_to_string(string_split(translate(p_brand || '_' || p_name || '.csv', '-_.', '   '), ' ')[2:-2], ' ')), ' ') AS inner_name, replace(p_name, ' ', '-') AS rdf FROM part""")
def clean_names(spark, d):
    name = F.concat("p_brand", F.lit("_"), "p_name", F.lit(".csv"))
    return t(spark, d, "part").select("p_partkey", tx.clean_name(name).alias("cleaned"), tx.clean_name(name, True, True).alias("inner_name"), tx.rdf_name(F.col("p_name")).alias("rdf"))


@query("SELECT doc_id, length(c) AS n, md5(c) AS digest FROM (SELECT doc_id, lower(trim(regexp_replace(regexp_replace(text, '[^\\p{L}\\p{M}\\p{N}\\s]', '', 'g'), '\\s+', ' ', 'g'), ' ')) AS c FROM documents)")
def rm_special_chars(spark, d):
    cleaned = tx.strip_special(F.col("text"))
    return t(spark, d, "documents").select("doc_id", F.length(cleaned).cast("long").alias("n"), F.md5(cleaned.cast("binary")).alias("digest"))


@query("SELECT c_custkey, array_to_string(list_transform(regexp_extract_all(c_name || 'HomeAddress2Line_' || c_mktsegment, '([a-z][a-z1-9]*|[1-9]+|[A-Z](?:[a-z1-9]+|[A-Z1-9]+))'), lambda w: lower(w)), ' ') AS words FROM customer")
def split_camel(spark, d):
    return t(spark, d, "customer").select("c_custkey", F.array_join(tx.name_words(F.concat("c_name", F.lit("HomeAddress2Line_"), "c_mktsegment")), " ").alias("words"))


@query("SELECT page_id, md5(array_to_string(list_filter(string_split_regex(html, '\\s+'), lambda w: NOT contains(w, 'http://')), ' ')) AS digest FROM pages")
def url_word_filter(spark, d):
    return t(spark, d, "pages").select("page_id", F.md5(tx.without_urls(F.col("html")).cast("binary")).alias("digest"))


@query("SELECT page_id, split_part(url, '/', -1) AS file FROM pages")
def file_names(spark, d):
    return t(spark, d, "pages").select("page_id", tx.file_name(F.col("url")).alias("file"))


#: Everyday plurals, beside the words of the texts, so that every kind of ending occurs.
PLURALS = ["activities", "parks", "trees", "boxes", "churches", "berries", "wolves", "wives", "buses", "status", "analyses", "people", "children", "sheep", "news", "glass", "matrices", "potatoes", "shoes", "houses", "licenses", "databases", "initiatives", "archives", "women", "moves", "Movies", "data", "OXEN"]


def _singular_sql() -> str:
    cases = " ".join(f"WHEN regexp_matches(word, '{p}') THEN regexp_replace(word, '{p}', '{r.replace('$', chr(92))}')" for p, r in tx.singular_rules())
    return f"CASE {cases} ELSE word END"


@query(f"SELECT word, {_singular_sql()} AS single FROM (SELECT DISTINCT unnest(string_split_regex(text, '[^A-Za-z]+')) AS word FROM documents UNION SELECT * FROM {values_sql([(w,) for w in PLURALS], 'word')}) WHERE word <> ''")
def singular_words(spark, d):
    words = t(spark, d, "documents").select(F.explode(F.split("text", "[^A-Za-z]+")).alias("word")).unionAll(inline(spark, [(w,) for w in PLURALS], "word string"))
    return words.filter("word <> ''").distinct().select("word", tx.singular(F.col("word")).alias("single"))


@query("SELECT doc_id, length(text)::INT AS n_chars, length(regexp_replace(text, '[^\\p{Nd}]', '', 'g')) AS n_digit, length(regexp_replace(text, '[^\\p{L}]', '', 'g')) AS n_alpha, length(regexp_replace(text, '[^\\x{09}-\\x{0d}\\x{1c}-\\x{20}\\x{85}\\p{Z}]', '', 'g')) AS n_space, round(length(regexp_replace(text, '[^\\p{L}]', '', 'g')) / length(text), 6) AS share_alpha FROM documents")
def char_dist_features(spark, d):
    f = tx.character_features(F.col("text"))
    return t(spark, d, "documents").select("doc_id", f["n_chars"].alias("n_chars"), *(f[k].cast("long").alias(k) for k in ("n_digit", "n_alpha", "n_space")), r6(f["share_alpha"], "share_alpha"))


# ---- samples --------------------------------------------------------------------------------------------------


@query("SELECT o_orderpriority, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS n, count(*) OVER (PARTITION BY o_orderpriority) AS rows FROM orders) WHERE n <= least(greatest(floor(rows * 0.01::DOUBLE)::BIGINT, 10), 100)")
def head_sample(spark, d):
    return profile.head_sample(t(spark, d, "orders").select("o_orderpriority", "o_orderkey"), ["o_orderpriority"], "o_orderkey", 0.01, 10, 100)


@query("SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY md5('1:' || event_id), event_id) AS n FROM events) WHERE n <= 100")
def hashed_sample(spark, d):
    return profile.hashed_sample(t(spark, d, "events").select("event_type", "event_id"), ["event_type"], "event_id", 100)


@query("""WITH v AS (SELECT 'p_name' AS attr, p_partkey AS ordinal, p_name AS value FROM part UNION ALL SELECT 'p_size', p_partkey, p_size::VARCHAR FROM part),
k AS (SELECT *, regexp_matches(value, '^[0-9]+$') AS num, count(*) OVER (PARTITION BY attr) AS n, row_number() OVER (PARTITION BY attr ORDER BY ordinal) - 1 AS pos FROM v),
m AS (SELECT *, count(*) FILTER (NOT num) OVER (PARTITION BY attr) AS others FROM k)
SELECT attr, ordinal, value FROM m WHERE CASE WHEN n < 100 THEN true WHEN others < 0.3 * n THEN NOT num OR pos % greatest(n // 20, 1) = 0 ELSE pos % greatest(n // 100, 1) = 0 END""")
def systematic_sample(spark, d):
    part = t(spark, d, "part")
    values = part.select(F.lit("p_name").alias("attr"), F.col("p_partkey").alias("ordinal"), F.col("p_name").alias("value")).unionAll(part.select(F.lit("p_size"), "p_partkey", F.col("p_size").cast("string")))
    return profile.reduced_values(values)


@query("SELECT doc_id, quality, (ntile(2) OVER (PARTITION BY quality ORDER BY doc_id))::INT AS fold FROM labels")
def stratified_fold(spark, d):
    return learn.folds(t(spark, d, "labels").select("doc_id", "quality"), 2, "quality", "doc_id")


# ---- matchers -------------------------------------------------------------------------------------------------

NAMES_SQL = "SELECT p_name AS a, n_name AS b FROM (SELECT DISTINCT p_name FROM part), (SELECT DISTINCT lower(n_name) AS n_name FROM nation)"


def names(spark: SparkSession, d: str) -> DataFrame:
    return matchers.name_matrix(t(spark, d, "part").select(F.col("p_name").alias("a")).distinct(), t(spark, d, "nation").select(F.lower("n_name").alias("b")).distinct(), "a", "b")


@query(f"WITH RECURSIVE {bigram_sql(NAMES_SQL)} SELECT a, b, round(score, 6) AS score FROM sim")
def ngram_name_matrix(spark, d):
    return names(spark, d).select("a", "b", r6(F.col("score"), "score"))


@query(f"WITH RECURSIVE {bigram_sql(NAMES_SQL.replace('p_name AS a, n_name AS b', 'n_name AS a, p_name AS b'))} SELECT a, b, round(score, 6) AS score FROM sim")
def ngram_native_matrix(spark, d):
    pairs = all_pairs(t(spark, d, "nation").select(F.lower("n_name").alias("a")).distinct(), t(spark, d, "part").select(F.col("p_name").alias("b")).distinct())
    return pairs.select("a", "b", r6(sim.name_similarity_native(F.col("a"), F.col("b")), "score"))


TOPICS = ["name", "price", "status", "date", "key", "comment", "segment", "quantity", "brand", "balance", "tax", "user", "event", "country", "discount"]
TABLES = {
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"], "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"], "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"],
}
ATTRS = [(name, i, c, c.partition("_")[2]) for name, columns in TABLES.items() for i, c in enumerate(columns)]
ATTRS_SQL = values_sql(ATTRS, "dataset, ordinal, attribute, cleaned")
TOPICS_SQL = values_sql([(x,) for x in TOPICS], "topic")


@query(f"""WITH RECURSIVE {bigram_sql(f"SELECT topic AS a, cleaned AS b FROM (SELECT * FROM {TOPICS_SQL}), (SELECT * FROM {ATTRS_SQL})")},
pos AS (SELECT dataset, topic, attribute, score, row_number() OVER (PARTITION BY dataset, topic ORDER BY score DESC, ordinal) AS n FROM (SELECT * FROM {TOPICS_SQL}), (SELECT * FROM {ATTRS_SQL}) JOIN sim ON b = cleaned WHERE a = topic AND score > 0)
SELECT d.dataset, tp.topic, attribute, round(coalesce(score, 0), 6) AS score FROM (SELECT DISTINCT dataset FROM {ATTRS_SQL}) d CROSS JOIN (SELECT topic FROM {TOPICS_SQL}) tp LEFT JOIN pos ON pos.dataset = d.dataset AND pos.topic = tp.topic AND n = 1""")
def ngram_best_match(spark, d):
    """The profile's attributes of five tables against topic words: the best attribute of each topic and table."""
    schema = inline(spark, [(name, i, c) for name in TABLES for i, c in enumerate(t(spark, d, name).columns)], "dataset string, ordinal int, attribute string")
    attrs = schema.withColumn("cleaned", tx.clean_name(F.col("attribute"), has_prefix=True))
    scored = matchers.name_matrix(inline(spark, [(x,) for x in TOPICS], "topic string"), attrs, "topic", "cleaned")
    return select.best_attribute(scored).select("dataset", "topic", "attribute", r6(F.col("score"), "score"))


@query(f"""WITH RECURSIVE {bigram_sql(NAMES_SQL)}, top AS (SELECT *, max(score) OVER (PARTITION BY a) AS top FROM sim),
nxt AS (SELECT *, max(CASE WHEN score < top THEN score END) OVER (PARTITION BY a) AS next FROM top)
SELECT a, b, round(score, 6) AS score FROM nxt WHERE score = top AND (top >= 0.5 OR next IS NULL OR next < top / 1.2)""")
def potential_matches_ties(spark, d):
    return select.potential_matches(names(spark, d), "a", "b", 1.2).select("a", "b", r6(F.col("score"), "score"))


SOURCE_SQL = "SELECT 'p_brand' AS attr, p_partkey AS ordinal, p_brand AS value FROM part UNION ALL SELECT 'p_name', p_partkey, p_name FROM part UNION ALL SELECT 'p_size', p_partkey, p_size::VARCHAR FROM part"
TARGET_SQL = "SELECT 'c_mktsegment' AS attr, c_custkey AS ordinal, c_mktsegment AS value FROM customer UNION ALL SELECT 'c_name', c_custkey, c_name FROM customer UNION ALL SELECT 'c_nationkey', c_custkey, c_nationkey::VARCHAR FROM customer"


def _attr_values(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(c).alias("attr"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(F.col(key).alias("ordinal"), F.explode(cells).alias("x")).select("x.attr", "ordinal", "x.value")


@query(f"""WITH RECURSIVE src AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY attr ORDER BY ordinal) AS n, count(*) OVER (PARTITION BY attr) AS rows FROM ({SOURCE_SQL})) WHERE n <= least(greatest(floor(rows * 0.01::DOUBLE), 10), 100)),
tar AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY attr ORDER BY ordinal) AS n, count(*) OVER (PARTITION BY attr) AS rows, count(*) OVER (PARTITION BY attr, value) AS cnt FROM ({TARGET_SQL})) WHERE n <= least(greatest(floor(rows * 0.01::DOUBLE), 10), 100)),
{bigram_sql("SELECT s.value AS a, t.value AS b FROM src s, tar t WHERE regexp_matches(s.value, '^[0-9]+$') = regexp_matches(t.value, '^[0-9]+$')")},
hits AS (SELECT s.attr AS src_attr, t.attr AS tar_attr, sum(score * cnt) AS score FROM src s, tar t JOIN sim ON t.value = sim.b WHERE s.value = sim.a AND score > 0.35 GROUP BY ALL)
SELECT a.attr AS src_attr, b.attr AS tar_attr, round(coalesce(score, 0), 4) AS score FROM (SELECT DISTINCT attr FROM src) a CROSS JOIN (SELECT DISTINCT attr FROM tar) b LEFT JOIN hits h ON h.src_attr = a.attr AND h.tar_attr = b.attr""")
def instance_match_score(spark, d):
    source = _attr_values(t(spark, d, "part"), "p_partkey", ["p_brand", "p_name", "p_size"])
    target = _attr_values(t(spark, d, "customer"), "c_custkey", ["c_mktsegment", "c_name", "c_nationkey"])
    counts = target.groupBy("attr", "value").agg(F.count("*").alias("cnt"))
    return matchers.instance_matrix(source, target, counts, threshold=0.35).select("src_attr", "tar_attr", F.round("score", 4).alias("score"))


@query(f"""WITH RECURSIVE s AS (SELECT 'n_name' AS attr, n_name AS value, count(*) AS n FROM nation GROUP BY ALL UNION ALL SELECT 'n_regionkey', n_regionkey::VARCHAR, count(*) FROM nation GROUP BY ALL),
r AS (SELECT 'r_name' AS attr, r_name AS value, count(*) AS n FROM region GROUP BY ALL UNION ALL SELECT 'r_regionkey', r_regionkey::VARCHAR, count(*) FROM region GROUP BY ALL),
{bigram_sql("SELECT s.value AS a, r.value AS b FROM s, r")}
SELECT s.attr AS src_attr, r.attr AS tar_attr, round(sum(score * s.n * r.n), 4) AS score FROM s, r JOIN sim ON sim.b = r.value WHERE sim.a = s.value GROUP BY ALL""")
def value_match_simple(spark, d):
    nation = _attr_values(t(spark, d, "nation"), "n_nationkey", ["n_name", "n_regionkey"])
    region = _attr_values(t(spark, d, "region"), "r_regionkey", ["r_name", "r_regionkey"])
    return matchers.value_matrix_simple(nation, region).select("src_attr", "tar_attr", F.round("score", 4).alias("score"))


WORDS_SQL = "string_split(lower(trim(regexp_replace(regexp_replace(text, '[^\\p{L}\\p{M}\\p{N}\\s]', '', 'g'), '\\s+', ' ', 'g'), ' ')), ' ')"


def tf_sql(table: str, id_: str) -> str:
    return f"SELECT id, word, n, n / sum(n) OVER (PARTITION BY id) AS tf FROM (SELECT id, word, count(*) AS n FROM (SELECT {id_} AS id, unnest({WORDS_SQL}) AS word FROM {table}) WHERE word <> '' GROUP BY ALL)"


@query(f"SELECT id, word, n, round(tf, 9) AS tf FROM ({tf_sql('documents', 'doc_id')})")
def tf_vector(spark, d):
    return profile.term_frequencies(t(spark, d, "documents"), "doc_id", "text").select("id", "word", "n", F.round("tf", 9).alias("tf"))


@query(f"""WITH a AS ({tf_sql('benchmark', 'item_id')}), b AS ({tf_sql('benchmark', 'item_id')}), c AS ({tf_sql('(SELECT conv_id * 1000 + turn AS turn_id, text FROM conversations)', 'turn_id')}),
na AS (SELECT id, sum(tf * tf) AS n FROM a GROUP BY 1), nc AS (SELECT id, sum(tf * tf) AS n FROM c GROUP BY 1),
s AS (SELECT a.id AS left_id, c.id AS right_id, sum(a.tf * c.tf) * 4 AS dot, sum(a.tf * a.tf) * 3 AS dx, sum(c.tf * c.tf) * 3 AS dy FROM a JOIN c USING (word) GROUP BY 1, 2)
SELECT left_id, right_id, round(dot / (sqrt(na.n + dx) * sqrt(nc.n + dy)), 6) AS score FROM s JOIN na ON na.id = left_id JOIN nc ON nc.id = right_id""")
def tf_cosine_boost(spark, d):
    left = t(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text")
    right = t(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return matchers.document_cosine(left, right).select("left_id", "right_id", r6(F.col("score"), "score"))


@query("""WITH p AS (SELECT x.n_nationkey AS a, y.n_nationkey AS b, x.n_name AS u, y.n_name AS v, list_distinct(string_split(x.n_name || y.n_name, '')) AS l FROM nation x, nation y WHERE x.n_nationkey < y.n_nationkey),
c AS (SELECT a, b, list_transform(l, lambda c: (length(u) - length(replace(u, c, '')))::DOUBLE) AS x, list_transform(l, lambda c: (length(v) - length(replace(v, c, '')))::DOUBLE) AS y FROM p)
SELECT a, b, round(list_sum(list_transform(list_zip(x, y), lambda z: z[1] * z[2])) / (sqrt(list_sum(list_transform(x, lambda z: z * z))) * sqrt(list_sum(list_transform(y, lambda z: z * z)))), 6) AS score FROM c""")
def char_bag_cosine(spark, d):
    return matchers.attribute_graph(t(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))).select("a", "b", r6(F.col("score"), "score"))


@query(f"""WITH RECURSIVE g AS (SELECT dataset, attr, CASE WHEN avg(CASE WHEN value IS NULL OR NOT regexp_matches(value, '^-?[0-9.]+$') THEN 1.0 ELSE 0.0 END) > 0.7 THEN 'str' ELSE 'num' END AS guess FROM ({MIXED_SQL}) GROUP BY ALL),
{bigram_sql("SELECT s.attr AS a, t.attr AS b FROM g s JOIN g t USING (guess) WHERE s.dataset = 'customer' AND t.dataset <> 'customer'")}
SELECT a AS src_attr, b AS tar_attr, round(score, 6) AS score FROM sim""")
def pre_cluster_pairs(spark, d):
    guessed = profile.guessed_types(mixed(spark, d)).cache()
    return matchers.pre_clusters(guessed.filter("dataset = 'customer'"), guessed.filter("dataset <> 'customer'")).select("src_attr", "tar_attr", r6(F.col("score"), "score"))


@query("""WITH f AS (SELECT p_brand AS dataset, (l_linenumber % 3) AS frame, l_returnflag AS row_topic, l_linestatus AS col_topic, max(l_discount * 10) AS score FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY dataset, frame, col_topic ORDER BY score DESC, row_topic) AS n, max(score) OVER (PARTITION BY dataset) AS top FROM f)
SELECT dataset, frame, row_topic, col_topic, round(score, 6) AS score FROM r WHERE n = 1 AND top > 0.4""")
def table_score_rows(spark, d):
    joined = t(spark, d, "lineitem").join(t(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey"))
    frames = joined.groupBy(F.col("p_brand").alias("dataset"), (F.col("l_linenumber") % 3).alias("frame"), F.col("l_returnflag").alias("row_topic"), F.col("l_linestatus").alias("col_topic")).agg(F.max(F.col("l_discount") * 10).alias("score")).withColumn("row_ordinal", F.col("row_topic"))
    return matchers.table_scores(frames).withColumn("score", F.round("score", 6))


@query("""WITH o AS (SELECT DISTINCT user_id, event_type FROM events)
SELECT a, b, shared, (row_number() OVER (PARTITION BY a ORDER BY shared DESC, b))::INT AS rank FROM (SELECT x.user_id AS a, y.user_id AS b, count(*) AS shared FROM o x JOIN o y ON x.event_type = y.event_type AND x.user_id <> y.user_id GROUP BY ALL)""")
def topic_overlap_tables(spark, d):
    return matchers.shared_topics(t(spark, d, "events"), "user_id", "event_type")


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, i.vec_id AS id, list_cosine_similarity(q.e, i.e) AS score FROM v q, v i WHERE q.vec_id % 50 = 0 AND q.vec_id <> i.vec_id)
SELECT query_id, id, round(score, 6) AS score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM s) WHERE rank <= 10""")
def embedding_topk(spark, d):
    items = t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    queries_ = items.filter("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("vec").alias("query_vec"))
    return matchers.vector_neighbours(queries_, items).select("query_id", "id", r6(F.col("score"), "score"), "rank")


@query("""WITH k AS (SELECT DISTINCT n_name AS known, r_name AS class FROM nation JOIN region ON n_regionkey = r_regionkey), n AS (SELECT DISTINCT p_name AS name FROM part),
r AS (SELECT name, class, row_number() OVER (PARTITION BY name ORDER BY levenshtein(name, known), known, class) AS p FROM n, k)
SELECT name, class, round(count(*) / 3, 6) AS score FROM r WHERE p <= 3 GROUP BY ALL""")
def knn_levenshtein_vote(spark, d):
    known = t(spark, d, "nation").join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("known"), F.col("r_name").alias("class")).distinct()
    return learn.neighbour_votes(t(spark, d, "part").select(F.col("p_name").alias("name")).distinct(), known).select("name", "class", r6(F.col("score"), "score"))


@query("""SELECT event_id, round(1 / (1 + exp(-s)), 6) AS score FROM (SELECT event_id, (CASE WHEN value > 10 THEN value / 100 * 0.8 ELSE 0 END + user_id / 1000 * 0.2) / (CASE WHEN value > 10 THEN 0.8 ELSE 0 END + 0.2) AS s FROM events)""")
def composite_score(spark, d):
    present = F.when(F.col("value") > 10, F.col("value") / 100)
    return t(spark, d, "events").select("event_id", r6(sim.composite([present, F.col("user_id") / 1000], [0.8, 0.2]), "score"))


FUSED = "FROM (SELECT l_suppkey AS dataset, l_linenumber AS attribute, l_orderkey AS topic, l_orderkey AS ordinal, l_discount * 10 AS s1, l_tax * 10 AS s2, l_quantity / 25 AS m FROM lineitem)"


def _fused(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "lineitem").select(F.col("l_suppkey").alias("dataset"), F.col("l_linenumber").alias("attribute"), F.col("l_orderkey").alias("topic"), F.col("l_orderkey").alias("ordinal"), (F.col("l_discount") * 10).alias("s1"), (F.col("l_tax") * 10).alias("s2"), (F.col("l_quantity") / 25).alias("m"))


@query(f"""SELECT dataset, attribute, topic, round(score, 6) AS score, score_name, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY dataset, attribute ORDER BY score DESC, ordinal DESC, topic, score_name) AS rank FROM (
SELECT *, s1 * 0.4::DOUBLE + s2 * 0.6::DOUBLE AS score, CASE WHEN s1 * 0.4::DOUBLE >= s2 * 0.6::DOUBLE THEN 's1' ELSE 's2' END AS score_name {FUSED}) WHERE score > 0.5) WHERE rank <= 4""")
def fuse_weighted_top4(spark, d):
    return select.fused_weighted(_fused(spark, d), {"s1": 0.4, "s2": 0.6}).withColumn("score", F.round("score", 6))


@query(f"""SELECT dataset, attribute, topic, round(score, 6) AS score, score_name, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY dataset, attribute ORDER BY score DESC, ordinal DESC, topic, score_name) AS rank FROM (
SELECT *, CASE WHEN s1 >= s2 THEN s1 ELSE least(s2 * m, 1) END AS score, CASE WHEN s1 >= s2 THEN 's1' ELSE 's2' END AS score_name {FUSED}) WHERE score > 0.5) WHERE rank <= 4""")
def fuse_winner_multiplier(spark, d):
    return select.fused_winner(_fused(spark, d), "s1", "s2", "m").withColumn("score", F.round("score", 6))


@query("SELECT l_suppkey, l_partkey, l_orderkey, l_linenumber, round(score, 6) AS score FROM (SELECT *, l_discount * 10 AS score, row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_discount * 10, l_orderkey * 10 + l_linenumber) AS n FROM lineitem WHERE l_discount * 10 >= 0.5) WHERE n = 1")
def consumed_scores(spark, d):
    rows = t(spark, d, "lineitem").select("l_suppkey", "l_partkey", "l_orderkey", "l_linenumber", (F.col("l_discount") * 10).alias("score"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ordinal"))
    return select.consumed(rows, ["l_suppkey", "l_partkey"]).drop("ordinal").withColumn("score", F.round("score", 6))


@query("""WITH o AS (SELECT DISTINCT o_custkey AS item, o_orderdate AS topic FROM orders), s AS (SELECT x.item AS a, y.item AS b, count(*) AS shared FROM o x JOIN o y ON x.topic = y.topic AND x.item <> y.item GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY shared DESC, b) AS rank FROM s),
x AS (SELECT g.a, u.b FROM (SELECT DISTINCT a FROM r) g, (SELECT DISTINCT item AS b FROM o) u WHERE g.a <> u.b AND NOT EXISTS (SELECT 1 FROM r WHERE r.a = g.a AND r.b = u.b)),
y AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY md5('3:' || a || ':' || b), b) AS n FROM x)
SELECT a, b, true AS positive FROM r WHERE rank <= 5 UNION ALL SELECT a, b, false FROM y WHERE n <= 5""")
def table_mixes(spark, d):
    """Customers as tables, the days on which they order as topics."""
    orders = t(spark, d, "orders").select(F.col("o_custkey").alias("item"), F.col("o_orderdate").alias("topic"))
    return select.table_mixes(orders, 10, 5)


# ---- inversion, knowledge base, clusters ----------------------------------------------------------------------


@query("SELECT l_suppkey, array_to_string(list_sort(list_distinct(list(p_brand))), '|') AS p_brands FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1")
def tag_inversion(spark, d):
    pairs = t(spark, d, "lineitem").join(t(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey"))
    return profile.invert(pairs, "l_suppkey", "p_brand").select("l_suppkey", F.array_join("p_brands", "|").alias("p_brands"))


@query("SELECT c_mktsegment, count(*) AS n, min(k) AS first, max(k) AS last FROM (SELECT DISTINCT c_mktsegment, c_nationkey AS k FROM customer) GROUP BY 1")
def multimap_reverse(spark, d):
    inverted = profile.invert(t(spark, d, "customer"), "c_mktsegment", "c_nationkey")
    return inverted.select("c_mktsegment", F.size("c_nationkeys").cast("long").alias("n"), F.element_at("c_nationkeys", 1).alias("first"), F.element_at("c_nationkeys", -1).alias("last"))


@query("""WITH v AS (SELECT list_sort(list(DISTINCT event_type)) AS l FROM events), o AS (SELECT user_id, list(DISTINCT event_type) AS own FROM events GROUP BY 1)
SELECT user_id, array_to_string(list_transform(l, lambda t: list_contains(own, t)::INT), '') AS vec FROM o, v""")
def onehot_topics(spark, d):
    return profile.one_hot(t(spark, d, "events"), "user_id", "event_type").select("user_id", F.array_join(F.transform("vec", lambda x: x.cast("string")), "").alias("vec"))


@query("""WITH n AS (SELECT c_nationkey AS dataset, count(*) AS n FROM customer GROUP BY 1 HAVING count(*) >= 10)
SELECT DISTINCT s_nationkey AS dataset FROM supplier WHERE s_nationkey IN (SELECT dataset FROM n) AND s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)""")
def eligible_datasets(spark, d):
    tagged = t(spark, d, "supplier").select(F.col("s_nationkey").alias("dataset"))
    declared = t(spark, d, "customer").select(F.col("c_nationkey").alias("dataset"))
    return profile.eligible_datasets(tagged, declared, t(spark, d, "nation").filter("n_regionkey = 2").select(F.col("n_nationkey").alias("dataset")), 10)


@query(f"""WITH s AS ({PROFILE_SQL}), l AS (SELECT dataset, attr AS name, list_sort(list(DISTINCT value)) AS observed FROM s GROUP BY ALL), a(dataset, name, coded) AS (VALUES ('nation', 'n_name', NULL), ('nation', 'n_regionkey', ['9', '8']), ('customer', 'c_mktsegment', NULL), ('customer', 'c_phone', NULL))
SELECT a.dataset, a.name, CASE WHEN coded IS NULL AND observed IS NOT NULL THEN 'coded_values_groupby' WHEN coded IS NOT NULL THEN 'coded_values' END AS domain, array_to_string(coalesce(list_sort(coalesce(coded, observed)), []), '|') AS example_values, list_sort(coalesce(coded, observed))[1] AS example FROM a LEFT JOIN l USING (dataset, name)""")
def coded_value_backfill(spark, d):
    attrs = inline(spark, [("nation", "n_name", None, None, "s"), ("nation", "n_regionkey", "coded_values", ["9", "8"], "i"), ("customer", "c_mktsegment", None, None, "s"), ("customer", "c_phone", None, None, "s")], "dataset string, name string, domain string, coded_values array<string>, data_type string")
    filled = profile.coded_values(attrs, stats(spark, d)).cache()
    examples = profile.example_values(filled.select("dataset", F.col("name").alias("attribute")), filled)
    return examples.join(filled.select("dataset", F.col("name").alias("attribute"), "domain"), ["dataset", "attribute"]).select("dataset", F.col("attribute").alias("name"), "domain", F.array_join("example_values", "|").alias("example_values"), "example")


@query("""WITH d AS (SELECT DISTINCT l_suppkey AS dataset, p_brand AS attr FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'R'), m AS (SELECT DISTINCT l_suppkey AS dataset, p_brand AS attr FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_quantity > 40)
SELECT attr, array_to_string(list_sort(list(dataset)), '|') AS datasets FROM ((SELECT * FROM d EXCEPT SELECT * FROM m) UNION ALL (SELECT * FROM m EXCEPT SELECT * FROM d)) GROUP BY 1""")
def symmetric_difference_new_concepts(spark, d):
    pairs = t(spark, d, "lineitem").join(t(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey")).select(F.col("l_suppkey").alias("dataset"), F.col("p_brand").alias("attr"), "l_returnflag", "l_quantity")
    return kb.new_concepts(pairs.filter("l_returnflag = 'R'"), pairs.filter("l_quantity > 40")).select("attr", F.array_join(F.transform("datasets", lambda x: x.cast("string")), "|").alias("datasets"))


@query("""WITH o AS (SELECT o_custkey, o_orderpriority, o_orderstatus, o_orderkey FROM orders), n AS (SELECT o_custkey, o_orderpriority, o_orderstatus, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey DESC) AS k FROM o WHERE o_orderstatus = 'O') WHERE k = 1)
SELECT o_custkey, o_orderpriority, o_orderstatus FROM o WHERE o_orderstatus <> 'O' AND NOT EXISTS (SELECT 1 FROM n WHERE n.o_custkey = o.o_custkey AND n.o_orderpriority = o.o_orderpriority) UNION ALL SELECT o_custkey, o_orderpriority, o_orderstatus FROM n""")
def kb_upsert_last_writer(spark, d):
    orders = t(spark, d, "orders").select("o_custkey", "o_orderpriority", "o_orderstatus", "o_orderkey")
    return kb.upsert(orders.filter("o_orderstatus <> 'O'").drop("o_orderkey"), orders.filter("o_orderstatus = 'O'"), ["o_custkey", "o_orderpriority"], "o_orderkey")


BASE_SQL = """m AS (SELECT p_brand AS concept, p_type AS dataset, min(p_name) AS attribute, max(p_retailprice) AS match_score FROM part GROUP BY 1, 2),
sim_rows AS (SELECT p_brand AS concept, p_type AS src_dataset, p_name AS src_attr, l_linestatus AS tar_dataset, l_returnflag AS tar_attr, sum(l_quantity) AS score FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL)"""


def _base(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    part = t(spark, d, "part")
    match = part.groupBy(F.col("p_brand").alias("concept"), F.col("p_type").alias("dataset")).agg(F.min("p_name").alias("attribute"), F.max("p_retailprice").alias("match_score"))
    joined = t(spark, d, "lineitem").join(part, F.col("p_partkey") == F.col("l_partkey"))
    scores = joined.groupBy(F.col("p_brand").alias("concept"), F.col("p_type").alias("src_dataset"), F.col("p_name").alias("src_attr"), F.col("l_linestatus").alias("tar_dataset"), F.col("l_returnflag").alias("tar_attr")).agg(F.sum("l_quantity").alias("score"))
    return match, scores.withColumn("ordinal", F.col("tar_attr"))


@query(f"""WITH {BASE_SQL}, best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY concept, src_dataset, src_attr, tar_dataset ORDER BY score DESC, tar_attr) AS n FROM sim_rows) WHERE n = 1 AND score > 10)
SELECT concept, src_dataset, src_attr, tar_dataset, tar_attr, round(score, 4) AS score FROM best""")
def clusters_from_matrices(spark, d):
    return kb.clusters_from_matrices(_base(spark, d)[1]).select("concept", "src_dataset", "src_attr", "tar_dataset", "tar_attr", F.round("score", 4).alias("score"))


@query(f"""WITH {BASE_SQL}, c AS (SELECT DISTINCT concept, src_dataset, tar_dataset, tar_attr, score FROM sim_rows)
SELECT c.concept, c.src_dataset, tar_dataset, m.attribute AS src_attr, tar_attr, round(score, 4) AS score FROM c JOIN m ON m.concept = c.concept AND m.dataset = c.src_dataset""")
def kb_flatten(spark, d):
    match, scores = _base(spark, d)
    return kb.flatten(match, scores.select("concept", "src_dataset", "tar_dataset", "tar_attr", "score").distinct()).withColumn("score", F.round("score", 4))


@query(f"""WITH {BASE_SQL} SELECT s, p, o FROM (SELECT concept AS s, 'foaf:name' AS p, replace(attribute, ' ', '-') AS o FROM m UNION ALL SELECT replace(attribute, ' ', '-'), 'rdf:type', dataset FROM m UNION ALL SELECT dataset, 'rdfs:label', match_score::VARCHAR FROM m)""")
def kb_triples(spark, d):
    return kb.triples(_base(spark, d)[0])


KB2_SQL = "kb2 AS (SELECT o_orderpriority AS dataset, o_orderstatus AS concept, 'a' || (o_custkey % 97) AS attribute, max(o_totalprice) AS match_score FROM orders GROUP BY ALL)"


def _kb2(spark: SparkSession, d: str) -> DataFrame:
    orders = t(spark, d, "orders")
    return orders.groupBy(F.col("o_orderpriority").alias("dataset"), F.col("o_orderstatus").alias("concept"), F.concat(F.lit("a"), F.col("o_custkey") % 97).alias("attribute")).agg(F.max("o_totalprice").alias("match_score")).withColumn("source_dataset", F.array().cast("array<string>"))


@query(f"""WITH {KB2_SQL}, g AS (SELECT '1-URGENT' AS dataset, 'F' AS concept, attribute, match_score, '2-HIGH' AS source_dataset FROM kb2 WHERE dataset = '2-HIGH' AND concept = 'O'),
base AS (SELECT dataset, concept, attribute, match_score, '' AS source_dataset FROM kb2),
merged AS (SELECT * FROM base b WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.dataset = b.dataset AND g.concept = b.concept AND g.attribute = b.attribute) UNION ALL SELECT * FROM g),
alias AS (SELECT dataset, 'O' AS concept, attribute, match_score, source_dataset FROM merged WHERE dataset = '1-URGENT' AND concept = 'F')
SELECT * FROM merged x WHERE NOT EXISTS (SELECT 1 FROM alias a WHERE a.dataset = x.dataset AND a.concept = x.concept AND a.attribute = x.attribute) UNION ALL SELECT * FROM alias""")
def transfer_topic(spark, d):
    moved, _ = kb.transfer_topics(_kb2(spark, d), "1-URGENT", inline(spark, [("2-HIGH", "F", "O")], "dataset string, guiding_topic string, topic string"))
    return moved.withColumn("source_dataset", F.array_join("source_dataset", "|"))


GROUPS_SQL = "g AS (SELECT DISTINCT o_orderstatus AS topic, o_orderpriority AS dataset, 'm' || (o_custkey % 5) AS member_topic FROM orders)"


@query(f"""WITH {GROUPS_SQL}, ds AS (SELECT topic, dataset FROM g UNION SELECT topic, 'guide' FROM g), tp AS (SELECT topic, member_topic AS given FROM g UNION SELECT topic, topic FROM g) SELECT DISTINCT dataset, given AS topic FROM ds JOIN tp USING (topic)""")
def group_propagation(spark, d):
    groups = t(spark, d, "orders").select(F.col("o_orderstatus").alias("topic"), F.col("o_orderpriority").alias("dataset"), F.concat(F.lit("m"), F.col("o_custkey") % 5).alias("member_topic")).distinct()
    return kb.propagate_groups(groups, "guide")


EXPAND_SQL = f"""{KB2_SQL}, attrs AS (SELECT p.dataset, 'a' || i AS attr FROM (SELECT DISTINCT dataset FROM kb2) p, range(0, 120) r(i)), mapped AS (SELECT DISTINCT dataset, attribute AS attr FROM kb2), open_attrs AS (SELECT * FROM attrs EXCEPT SELECT * FROM mapped),
owned AS (SELECT DISTINCT dataset, concept AS topic FROM kb2 UNION SELECT '3-MEDIUM', 'extra')"""


def _expansion(spark: SparkSession, d: str):
    base = _kb2(spark, d).cache()
    attrs = base.select("dataset").distinct().withColumn("attr", F.explode(F.transform(F.sequence(F.lit(0), F.lit(119)), lambda i: F.concat(F.lit("a"), i.cast("string")))))
    owned = base.select("dataset", F.col("concept").alias("topic")).distinct().unionAll(inline(spark, [("3-MEDIUM", "extra")], "dataset string, topic string"))
    exposed = owned.filter("dataset = '1-URGENT'")
    return base, attrs, exposed, owned


@query(f"WITH {EXPAND_SQL} SELECT attr, o.dataset, o.topic FROM open_attrs a, owned o WHERE a.dataset = '1-URGENT' AND o.dataset <> '1-URGENT' AND o.topic NOT IN (SELECT topic FROM owned WHERE dataset = '1-URGENT')")
def coverage_unmapped(spark, d):
    base, attrs, exposed, owned = _expansion(spark, d)
    return kb.coverage_candidates(attrs, base, exposed, owned, "1-URGENT")


@query(f"WITH {EXPAND_SQL} SELECT a.dataset, attr, topic FROM open_attrs a, (SELECT topic FROM owned WHERE dataset = '1-URGENT') o WHERE a.dataset <> '1-URGENT'")
def importance_unmapped(spark, d):
    base, attrs, exposed, _ = _expansion(spark, d)
    return kb.importance_candidates(attrs, base, exposed, "1-URGENT")


@query(f"WITH {KB2_SQL} SELECT DISTINCT '1-URGENT' AS dataset, concept AS topic FROM kb2 WHERE dataset = '1-URGENT'")
def kb_dataset_topics(spark, d):
    return kb.dataset_topics(_kb2(spark, d).filter("dataset = '1-URGENT'"), "1-URGENT")


MEMBERS_SQL = "mem AS (SELECT DISTINCT p_brand AS concept, p_size::VARCHAR AS key, l_suppkey::VARCHAR AS member FROM lineitem JOIN part ON p_partkey = l_partkey)"


def _members(spark: SparkSession, d: str) -> DataFrame:
    """Of each brand (concept) and size (key) the suppliers of its parts."""
    joined = t(spark, d, "lineitem").join(t(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey"))
    return joined.select(F.col("p_brand").alias("concept"), F.col("p_size").cast("string").alias("key"), F.col("l_suppkey").cast("string").alias("member")).distinct()


@query(f"""WITH {MEMBERS_SQL}, l AS (SELECT concept, key, list(member) AS l FROM mem GROUP BY ALL)
SELECT concept, a, b, round(CASE WHEN x > 0.5 THEN x ELSE 0 END, 6) AS distance FROM (SELECT p.concept, p.key AS a, q.key AS b, (len(p.l) + len(q.l) - 2 * len(list_intersect(p.l, q.l))) / (len(p.l) + len(q.l)) AS x FROM l p JOIN l q ON p.concept = q.concept AND p.key < q.key)""")
def split_distance(spark, d):
    return cluster.split_distances(_members(spark, d)).withColumn("distance", F.round("distance", 6))


SOURCES_SQL = """src AS (SELECT DISTINCT p_type AS concept, p_type || p_brand AS key, l_suppkey::VARCHAR AS member FROM lineitem JOIN part ON p_partkey = l_partkey), o AS (SELECT key, member FROM src UNION SELECT key, 's' || key FROM src), s AS (SELECT key, count(*) AS n FROM o GROUP BY 1),
close AS (SELECT a, b, c / sqrt(x.n * y.n) AS cosine FROM (SELECT p.key AS a, q.key AS b, count(*) AS c FROM o p JOIN o q ON p.member = q.member AND p.key < q.key GROUP BY ALL) JOIN s x ON x.key = a JOIN s y ON y.key = b WHERE 1 - c / sqrt(x.n * y.n) <= 0.017 + 1e-12)"""


def _sources(spark: SparkSession, d: str) -> DataFrame:
    """The suppliers of the parts of each type (concept) and brand (source)."""
    joined = t(spark, d, "lineitem").join(t(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey"))
    key = F.concat("p_type", "p_brand")
    return joined.select(F.col("p_type").alias("concept"), key.alias("key"), F.concat(F.lit("s"), key).alias("source"), F.col("l_suppkey").cast("string").alias("member")).distinct()


@query(f"WITH {SOURCES_SQL} SELECT a, b, round(cosine, 6) AS cosine FROM close")
def merge_cosine_pairs(spark, d):
    return cluster.merge_pairs(_sources(spark, d), 0.017).withColumn("cosine", F.round("cosine", 6))


@query(f"""WITH RECURSIVE {SOURCES_SQL}, e AS (SELECT a, b FROM close UNION SELECT b, a FROM close), reach AS (SELECT DISTINCT a AS node, a AS seen FROM e UNION SELECT node, b FROM reach JOIN e ON a = seen), r AS (SELECT node AS key, min(seen) AS root FROM reach GROUP BY 1),
n AS (SELECT DISTINCT root, key, concept FROM r JOIN src USING (key)), m AS (SELECT root, string_agg('+' || concept, '' ORDER BY key, concept) AS new_concept FROM n GROUP BY 1) SELECT key, concept, new_concept FROM n JOIN m USING (root)""")
def merged_concepts(spark, d):
    return cluster.merge_concepts(_sources(spark, d), 0.017)


LINKS_SQL = "lk AS (SELECT DISTINCT l_partkey AS a, l_suppkey + 1000000000 AS b FROM lineitem), e AS (SELECT a, b FROM lk UNION ALL SELECT b, a FROM lk)"


@query(f"""WITH RECURSIVE {LINKS_SQL}, cc(node, root) USING KEY (node) AS (SELECT DISTINCT a, a FROM e UNION (SELECT e.b, min(cc.root) FROM cc JOIN e ON e.a = cc.node JOIN recurring.cc AS old ON old.node = e.b WHERE cc.root < old.root GROUP BY e.b)) SELECT node, root FROM cc""")
def connected_components(spark, d):
    """Parts and suppliers, linked by every lineitem."""
    return cluster.connected(t(spark, d, "lineitem").select(F.col("l_partkey").alias("a"), (F.col("l_suppkey") + 1000000000).alias("b")).distinct())


TREE_SQL = "h AS (SELECT n_name AS child, r_name AS parent FROM nation JOIN region ON r_regionkey = n_regionkey UNION ALL SELECT r_name, 'world' FROM region)"


def _tree(spark: SparkSession, d: str) -> DataFrame:
    nation, region = t(spark, d, "nation"), t(spark, d, "region")
    return nation.join(region, F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("n_name").alias("child"), F.col("r_name").alias("parent")).unionAll(region.select("r_name", F.lit("world")))


CLOSURE_SQL = f"{TREE_SQL}, up AS (SELECT x AS synset, x AS ancestor, 0 AS distance FROM (SELECT child AS x FROM h UNION SELECT parent FROM h) UNION ALL SELECT synset, parent, distance + 1 FROM up JOIN h ON child = ancestor)"


@query(f"WITH RECURSIVE {CLOSURE_SQL} SELECT synset, ancestor, min(distance)::INT AS distance FROM up GROUP BY ALL")
def hypernym_closure(spark, d):
    return lexicon.ancestors(_tree(spark, d))


@query(f"""WITH RECURSIVE {CLOSURE_SQL}, dep AS (SELECT synset, max(distance) + 1 AS depth FROM up GROUP BY 1), j AS (SELECT x.synset AS a, y.synset AS b, depth, x.distance AS da, y.distance AS db FROM up x JOIN up y USING (ancestor) JOIN dep ON dep.synset = x.ancestor),
k AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY depth DESC, da + db) AS n, min(da + db) OVER (PARTITION BY a, b) AS path FROM j) SELECT a, b, round(1 / (1 + path), 6) AS path_score, round(2 * depth / (2 * depth + da + db), 6) AS wup_score FROM k WHERE n = 1""")
def lexicon_similarities(spark, d):
    closure = lexicon.ancestors(_tree(spark, d)).cache()
    nodes = closure.select("synset").distinct()
    pairs = all_pairs(nodes.select(F.col("synset").alias("a")), nodes.select(F.col("synset").alias("b")))
    path = lexicon.path_similarity(closure, pairs).select("a", "b", r6(F.col("score"), "path_score"))
    return path.join(lexicon.wu_palmer(closure, pairs).select("a", "b", r6(F.col("score"), "wup_score")), ["a", "b"])


@query(f"""WITH RECURSIVE {CLOSURE_SQL}, s AS (SELECT x.synset AS a, y.synset AS b, max(1 / (1 + x.distance + y.distance)) AS score FROM up x JOIN up y USING (ancestor) GROUP BY ALL),
l AS (SELECT c_custkey AS id, upper(c_mktsegment) AS seg, n_name AS w FROM customer JOIN nation ON n_nationkey = c_nationkey), r AS (SELECT r_regionkey AS id, r_name AS w FROM region)
SELECT l.id AS left_id, r.id AS right_id, round(CASE WHEN s.score >= 0.5 THEN s.score ELSE 0 END, 6) AS score FROM l, r JOIN s ON s.b = r.w WHERE s.a = l.w""")
def thesaurus_names(spark, d):
    tree = _tree(spark, d)
    closure = lexicon.ancestors(tree)
    name = lambda c: F.replace(c, F.lit(" "), F.lit("_"))
    lemma = closure.select(name(F.col("synset")).alias("lemma"), F.lit("n").alias("pos"), "synset", F.lit(1).alias("sense_no")).distinct()
    left = t(spark, d, "customer").join(t(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).select(F.col("c_custkey").alias("id"), name(F.col("n_name")).alias("text"))
    right = t(spark, d, "region").select(F.col("r_regionkey").alias("id"), name(F.col("r_name")).alias("text"))
    return lexicon.thesaurus_matcher(left, right, lemma, closure, threshold=0.49).select("left_id", "right_id", r6(F.col("score"), "score"))


@query("""WITH e AS (SELECT DISTINCT p_brand AS s, n_regionkey AS tar, avg(l_discount) AS score FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey GROUP BY ALL),
k AS (SELECT s, tar::VARCHAR AS tar FROM e WHERE score > 0.05), m AS (SELECT s, tar AS dataset FROM k UNION SELECT s, s FROM k), tg AS (SELECT DISTINCT p_brand AS dataset, p_type AS tag FROM part UNION SELECT n_regionkey::VARCHAR, n_name FROM nation),
p AS (SELECT DISTINCT s, tag FROM m JOIN tg USING (dataset)) SELECT dataset, array_to_string(list_sort(list(DISTINCT tag)), '|') AS tags FROM m JOIN p USING (s) GROUP BY 1""")
def tag_pooling(spark, d):
    joined = t(spark, d, "lineitem").join(t(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey")).join(t(spark, d, "supplier"), F.col("s_suppkey") == F.col("l_suppkey")).join(t(spark, d, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    scores = joined.groupBy(F.col("p_brand").alias("src_dataset"), F.col("n_regionkey").cast("string").alias("tar_dataset")).agg(F.avg("l_discount").alias("score")).withColumns({"src_attr": F.lit("x"), "tar_attr": F.lit("y")})
    tags = t(spark, d, "part").select(F.col("p_brand").alias("dataset"), F.col("p_type").alias("tag")).unionAll(t(spark, d, "nation").select(F.col("n_regionkey").cast("string"), "n_name")).distinct()
    return cluster.pooled_tags(scores, tags, 0.05).select("dataset", F.array_join("tags", "|").alias("tags"))


# ---- evaluation -----------------------------------------------------------------------------------------------

PREDICTED_SQL = "SELECT doc_id AS item, CASE WHEN n_chars > 700 THEN 1 ELSE 0 END AS label FROM documents"


@query(f"""WITH g AS (SELECT doc_id AS item, quality AS label FROM labels), p AS (SELECT 1 AS labeling, * FROM ({PREDICTED_SQL}) UNION ALL SELECT 2, doc_id, 1 FROM documents WHERE lang = 'en'), c AS (SELECT count(*) AS correct FROM (SELECT DISTINCT item, label FROM p INTERSECT SELECT item, label FROM g))
SELECT correct, round(correct / (SELECT max(n) FROM (SELECT count(*) AS n FROM p GROUP BY labeling)), 6) AS "precision", round(correct / (SELECT count(*) FROM g), 6) AS recall FROM c""")
def precision_recall(spark, d):
    docs = t(spark, d, "documents")
    ground = t(spark, d, "labels").select(F.col("doc_id").alias("item"), F.col("quality").alias("label"))
    first = docs.select(F.lit(1).alias("labeling"), F.col("doc_id").alias("item"), (F.col("n_chars") > 700).cast("int").alias("label"))
    second = docs.filter("lang = 'en'").select(F.lit(2).alias("labeling"), F.col("doc_id").alias("item"), F.lit(1).alias("label"))
    return evaluate.precision_recall(ground, first.unionAll(second)).select("correct", r6(F.col("precision"), "precision"), r6(F.col("recall"), "recall"))


@query("""WITH p AS (SELECT DISTINCT o_custkey AS dataset, o_orderpriority AS topic FROM orders), o AS (SELECT DISTINCT o_custkey AS dataset, o_orderpriority AS topic FROM orders WHERE o_orderstatus = 'F')
SELECT (SELECT count(*) FROM (SELECT * FROM p EXCEPT SELECT * FROM o)) AS n_new, round((SELECT count(*) FROM (SELECT * FROM p EXCEPT SELECT * FROM o)) / (SELECT count(*) FROM customer), 6) AS average_new""")
def new_topic_count(spark, d):
    orders = t(spark, d, "orders").select(F.col("o_custkey").alias("dataset"), F.col("o_orderpriority").alias("topic"), "o_orderstatus")
    return evaluate.new_topics(orders, orders.filter("o_orderstatus = 'F'"), t(spark, d, "customer")).select("n_new", r6(F.col("average_new"), "average_new"))


@query("SELECT o_orderpriority AS method, o_orderstatus AS plan, round(avg(o_totalprice), 4) AS \"precision\", round(avg(o_custkey), 4) AS recall, round(avg(o_orderkey), 4) AS new_topics, count(*) AS runs FROM orders GROUP BY ALL")
def run_averages(spark, d):
    runs = t(spark, d, "orders").select(F.col("o_orderpriority").alias("method"), F.col("o_orderstatus").alias("plan"), F.col("o_totalprice").alias("precision"), F.col("o_custkey").alias("recall"), F.col("o_orderkey").alias("new_topics"))
    return evaluate.run_averages(runs, ["method", "plan"]).select("method", "plan", *(F.round(c, 4).alias(c) for c in ("precision", "recall", "new_topics")), "runs")


@query(f"""WITH b AS (SELECT item_id, list_distinct({WORDS_SQL}) AS w FROM benchmark), c AS (SELECT conv_id, turn, list_distinct({WORDS_SQL}) AS w FROM conversations)
SELECT item_id AS left_name, conv_id AS right_name, max(len(list_intersect(b.w, c.w)))::INT AS score FROM b, c GROUP BY ALL""")
def context_overlap(spark, d):
    words = F.array_distinct(F.split(tx.strip_special(F.col("text")), " ", -1))
    left = t(spark, d, "benchmark").select(F.col("item_id").alias("name"), words.alias("overlap"))
    right = t(spark, d, "conversations").select(F.col("conv_id").alias("name"), words.alias("overlap"))
    return lexicon.context_overlap(left, right)


@query(f"""SELECT doc_id, len(list_intersect(s, g))::INT AS n_overlap, len(s)::INT AS n_source FROM (SELECT doc_id, list_filter(list_distinct({WORDS_SQL}), lambda w: w NOT IN ('the', 'and')) AS s, list_filter(list_distinct(string_split(lower(source || ' of is was by with'), ' ')), lambda w: w NOT IN ('the', 'and')) AS g FROM documents)""")
def context_words(spark, d):
    s, _, o = lexicon.compare_words(F.split(tx.strip_special(F.col("text")), " ", -1), F.split(F.lower(F.concat("source", F.lit(" of is was by with"))), " ", -1), F.array(F.lit("the"), F.lit("and")))
    return t(spark, d, "documents").select("doc_id", F.size(o).alias("n_overlap"), F.size(s).alias("n_source"))


# ---- catalogue ------------------------------------------------------------------------------------------------


@query("""SELECT p_brand AS dataset, array_to_string(list_sort(list(DISTINCT lower(p_name))), '|') AS tags FROM part GROUP BY 1""")
def catalogue_tags(spark, d):
    part = t(spark, d, "part")
    tags = F.transform(F.collect_set("p_name"), lambda x: F.struct(F.upper(x).alias("name"), F.upper(x).alias("display_name")))
    package = part.groupBy("p_brand").agg(tags.alias("tags")).select(F.col("p_brand").alias("dataset_name"), F.array(F.struct(F.col("p_brand").alias("name"), F.col("p_brand").alias("title"), F.lit("Notes").alias("notes"), F.array(F.struct(F.lit("R").alias("name"), F.lit("CSV").alias("format"), F.lit("http://x/y.csv").alias("url"))).alias("resources"), "tags", F.array(F.struct(F.lit("G").alias("name"), F.lit("G").alias("display_name"), F.lit("D").alias("description"))).alias("groups"))).alias("results"))
    shaped = catalogue.shape_catalogue(package)
    return shaped.filter("count = 1").select(F.col("resources")[0]["file"].alias("file"), "dataset", "tags").join(part.select(F.col("p_brand")).distinct(), F.lower("p_brand") == F.col("dataset")).select(F.col("p_brand").alias("dataset"), F.array_join(F.array_sort(F.transform("tags", lambda x: x["name"])), "|").alias("tags"))


@query("SELECT n_name, count(*) FILTER (c_mktsegment = 'AUTOMOBILE') AS automobile, count(*) FILTER (c_mktsegment = 'BUILDING') AS building FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1")
def matrix_pivot(spark, d):
    counts = t(spark, d, "customer").join(t(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).groupBy("n_name", "c_mktsegment").agg(F.count("*").alias("score"))
    wide = catalogue.similarity_matrix(counts, "n_name", "c_mktsegment")
    own = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c.lower())
    return wide.select("n_name", *(own(c) if c in wide.columns else F.lit(0).cast("long").alias(c.lower()) for c in ("AUTOMOBILE", "BUILDING")))


# ---- queries that SQL does not express ------------------------------------------------------------------------


@query("""WITH RECURSIVE p AS (SELECT x.n_nationkey AS a, y.n_nationkey AS b, x.n_name AS u, y.n_name AS v, list_distinct(string_split(x.n_name || y.n_name, '')) AS l FROM nation x, nation y WHERE x.n_nationkey < y.n_nationkey),
c AS (SELECT a, b, list_transform(l, lambda c: (length(u) - length(replace(u, c, '')))::DOUBLE) AS x, list_transform(l, lambda c: (length(v) - length(replace(v, c, '')))::DOUBLE) AS y FROM p),
e AS (SELECT a || '-' || b AS id, list_sum(list_transform(list_zip(x, y), lambda z: z[1] * z[2])) / (sqrt(list_sum(list_transform(x, lambda z: z * z))) * sqrt(list_sum(list_transform(y, lambda z: z * z)))) AS value FROM c),
k AS (SELECT 0 AS n, min(value) AS low, max(value) AS high FROM e UNION ALL SELECT n + 1, (SELECT avg(value) FROM e WHERE value <= (low + high) / 2), (SELECT avg(value) FROM e WHERE value > (low + high) / 2) FROM k WHERE n < 20)
SELECT id, round(value, 6) AS value, (value > (SELECT (low + high) / 2 FROM k WHERE n = 20))::INT AS cluster FROM e""")
def kmeans_edges(spark, d):
    edges = matchers.attribute_graph(t(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")))
    return cluster.two_means(edges.select(F.concat_ws("-", "a", "b").alias("id"), F.col("score").alias("value"))).withColumn("value", F.round("value", 6))


@query()
def split_concept_parts(spark, d):
    return cluster.split_concepts(_members(spark, d))


@query()
def meta_weights(spark, d):
    rows = t(spark, d, "part").select(F.col("p_partkey").alias("row_id"), F.col("p_brand").alias("name"), F.col("p_name").alias("value"), F.col("p_type").alias("class"))
    base = learn.out_of_fold(learn.CharacterClassifier, rows).withColumnRenamed("score", "chars")
    gram = learn.out_of_fold(lambda: learn.NgramClassifier(hashed=True), rows).withColumnRenamed("score", "grams")
    return learn.meta_weights(base.join(gram, ["row_id", "class"]), rows.select("row_id", "class"), ["chars", "grams"]).withColumn("weight", F.round("weight", 4))


@query()
def lda_topics(spark, d):
    from topicloom.operators.topics import topic_model

    model = topic_model(t(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"))
    return model.select("id", "topic", F.round("weight", 4).alias("weight"), "rank")


def _profiled_values(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """attrs and values of the profiled tables, for entry A."""
    values, declared = None, []
    for name, columns in PROFILED.items():
        df = t(spark, d, name).select(*columns)
        cells = F.array(*[F.struct(F.lit(c).alias("attr"), F.col(c).cast("string").alias("value")) for c in columns])
        own = df.select(F.lit(name).alias("dataset"), F.col(columns[0]).alias("ordinal"), F.explode(cells).alias("x")).select("dataset", "x.attr", "ordinal", "x.value")
        values = own if values is None else values.unionAll(own)
        declared += [(name, c, i, "esriFieldTypeString" if k == "string" else "esriFieldTypeInteger", None, None) for i, (c, k) in enumerate(df.dtypes)]
    return inline(spark, declared, "dataset string, name string, ordinal int, data_type string, domain string, coded_values array<string>"), values


_MAPPED = ["concept", "src_dataset", "src_attr", "tar_dataset", "tar_attr"]


@query()
def iterative_discovery(spark, d):
    """The whole of entry A over the star schema's tables."""
    from .iterative import discover

    attrs, values = _profiled_values(spark, d)
    topics = inline(spark, [("nation", "name"), ("customer", "segment"), ("part", "brand")], "dataset string, topic string")
    found = discover(topics, topics.unionAll(inline(spark, [("part", "size")], "dataset string, topic string")), attrs, values, stats(spark, d))
    return found.cluster.select(*_MAPPED, F.round("score", 4).alias("score"))


#: Topics that several tables have, so that concepts have several sources, of which some are joined.
SHARED_TOPICS = [(x, "nationkey") for x in ("nation", "customer", "supplier")] + [("part", "size"), ("customer", "custkey"), ("supplier", "suppkey")] + [(x, "key") for x in ("part", "customer", "nation")] + [(x, "name") for x in ("region", "nation", "customer", "supplier")]


@query()
def merging_discovery(spark, d):
    """Entry A over topics that several tables share: one round, in which sources of different concepts are joined."""
    from .iterative import discover
    from .params import Params

    attrs, values = _profiled_values(spark, d)
    topics = inline(spark, SHARED_TOPICS, "dataset string, topic string")
    found = discover(topics, topics, attrs, values, stats(spark, d), Params(rounds=1))
    return found.cluster.select(*_MAPPED, F.round("score", 4).alias("score"))


from . import relation_queries, table_queries  # noqa: E402,F401  register their queries here
