"""Registered queries over table data of operators that had none: threshold joins, correspondences, type pruning, learning and drivers. `queries` registers them when it is imported."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from topicloom.functions import similarity as sim
from topicloom.operators import cluster, learn, matchers, matching, names, profile, select
from topicloom.operators.pairs import all_pairs
from topicloom.sources import archives, catalogue

from .checkpoints import shared_dir
from .iterative import toy_run
from .queries import PROFILE_SQL, inline, query, r6, stats, t, values_sql
from .sql import bigram_sql

# ---- names ----------------------------------------------------------------------------------------------------

WORDS_SQL = "SELECT DISTINCT lower(p_type) || ' ' || split_part(p_name, ' ', 2) AS a FROM part"
SHOWN_SQL = "SELECT DISTINCT p_name AS b FROM part UNION SELECT DISTINCT lower(c_mktsegment) FROM customer"


@query(f"WITH RECURSIVE {bigram_sql(f'SELECT a, b FROM ({WORDS_SQL}), ({SHOWN_SQL})')} SELECT a, b, round(score, 6) AS score FROM sim WHERE score > 0.6")
def similar_names(spark, d):
    """M1 at a threshold: kinds of parts against part names and segments."""
    part = t(spark, d, "part")
    left = part.select(F.concat_ws(" ", F.lower("p_type"), F.split("p_name", " ")[1]).alias("a"))
    right = part.select(F.col("p_name").alias("b")).unionAll(t(spark, d, "customer").select(F.lower("c_mktsegment")))
    return names.similar_names(left, right, 0.6).select("a", "b", r6(F.col("score"), "score"))


@query(f"""WITH RECURSIVE o AS (SELECT p_brand AS dataset, p_name AS attribute, min(p_partkey) AS ordinal FROM part GROUP BY ALL), k AS (SELECT DISTINCT lower(p_type) || ' ' || split_part(p_name, ' ', 2) AS topic FROM part),
{bigram_sql("SELECT topic AS a, attribute AS b FROM k, (SELECT DISTINCT attribute FROM o)")}
SELECT dataset, topic, attribute, round(score, 6) AS score FROM (SELECT o.dataset, a AS topic, o.attribute, score, row_number() OVER (PARTITION BY dataset, a ORDER BY score DESC, ordinal) AS n FROM o JOIN sim ON b = attribute WHERE score > 0) WHERE n = 1""")
def best_names_of_brands(spark, d):
    """The part name of each brand that is most like each kind of part."""
    part = t(spark, d, "part")
    attrs = part.groupBy(F.col("p_brand").alias("dataset"), F.col("p_name").alias("attribute")).agg(F.min("p_partkey").alias("ordinal"))
    topics = part.select(F.concat_ws(" ", F.lower("p_type"), F.split("p_name", " ")[1]).alias("topic")).distinct()
    pairs = matchers.name_matrix(topics, attrs.select("attribute").distinct(), "topic", "attribute")
    best = select.best_attribute(attrs.join(pairs, "attribute")).filter("attribute IS NOT NULL")
    return best.select("dataset", "topic", "attribute", r6(F.col("score"), "score"))


# ---- correspondences ------------------------------------------------------------------------------------------

CANDIDATES_SQL = "c AS (SELECT DISTINCT p_brand AS tab, p_type AS topic, p_size::VARCHAR AS attr FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_retailprice, p_partkey) AS n FROM part) WHERE n <= 3)"
LISTED_SQL = """tp AS (SELECT topic, row_number() OVER (ORDER BY topic) AS i FROM (SELECT DISTINCT topic FROM c)), o AS (SELECT tab, topic, attr FROM c UNION SELECT t.tab, tp.topic, NULL FROM (SELECT DISTINCT tab FROM c) t, tp),
w AS (SELECT DISTINCT tab, 0 AS i, []::VARCHAR[] AS used, []::VARCHAR[] AS choice FROM c UNION ALL
SELECT w.tab, w.i + 1, CASE WHEN attr IS NULL THEN used ELSE list_append(used, attr) END, CASE WHEN attr IS NULL THEN choice ELSE list_append(choice, o.topic || '=' || attr) END
FROM w JOIN tp ON tp.i = w.i + 1 JOIN o ON o.tab = w.tab AND o.topic = tp.topic WHERE attr IS NULL OR NOT list_contains(used, attr)), done AS (SELECT * FROM w WHERE i = (SELECT max(i) FROM tp))"""


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    """The sizes of the three cheapest parts of each brand (table) and type (topic)."""
    cheapest = Window.partitionBy("p_brand", "p_type").orderBy("p_retailprice", "p_partkey")
    top = t(spark, d, "part").withColumn("n", F.row_number().over(cheapest)).filter("n <= 3")
    return top.select(F.col("p_brand").alias("table"), F.col("p_type").alias("topic"), F.col("p_size").cast("string").alias("attr")).distinct()


@query(f'WITH RECURSIVE {CANDIDATES_SQL}, {LISTED_SQL} SELECT tab AS "table", array_to_string(choice, \';\') AS choice FROM done')
def one_to_one_matchings(spark, d):
    """All ways to give each type of a brand one size or none, no size twice."""
    choices = cluster.one_to_one(_candidates(spark, d))
    given = F.array_sort(F.filter(F.map_entries("choice"), lambda e: e["value"].isNotNull()))
    return choices.select("table", F.array_join(F.transform(given, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("choice"))


@query(f'WITH RECURSIVE {CANDIDATES_SQL}, {LISTED_SQL} SELECT tab AS "table", count(*) AS ways FROM done GROUP BY 1')
def matching_counts(spark, d):
    """How many ways there are, from the decision diagram."""
    return matching.matching_counts(matching.matching_diagram(_candidates(spark, d))).withColumn("ways", F.col("ways").cast("long"))


@query(f"""WITH RECURSIVE {CANDIDATES_SQL}, {LISTED_SQL}, own AS (SELECT tab, g.topic, list_filter(choice, lambda x: starts_with(x, g.topic || '=')) AS x FROM done JOIN (SELECT DISTINCT tab, topic FROM c) g USING (tab))
SELECT tab AS "table", topic, CASE WHEN len(x) > 0 THEN substr(x[1], length(topic) + 2) END AS attr, count(*) AS ways FROM own GROUP BY ALL""")
def topic_shares(spark, d):
    """In how many ways each type takes each size, from the decision diagram."""
    return matching.topic_shares(matching.matching_diagram(_candidates(spark, d))).withColumn("ways", F.col("ways").cast("long"))


@query(f'WITH {CANDIDATES_SQL} SELECT DISTINCT tab AS "table", topic FROM c')
def mapping_topics(spark, d):
    """Topics that some correspondence gives a size."""
    return cluster.table_topics(cluster.one_to_one(_candidates(spark, d)))


# ---- types ----------------------------------------------------------------------------------------------------

#: What layer metadata would declare of the profiled tables; some columns are declared but never observed.
DECLARED = [
    ("nation", "n_nationkey", "esriFieldTypeOID"), ("nation", "n_name", "esriFieldTypeString"), ("nation", "n_area", "esriFieldTypeDouble"), ("supplier", "s_name", "esriFieldTypeString"), ("supplier", "s_acctbal", "esriFieldTypeDouble"),
    ("customer", "c_name", "esriFieldTypeString"), ("customer", "c_acctbal", "esriFieldTypeDouble"), ("customer", "c_since", "esriFieldTypeDate"), ("part", "p_name", "esriFieldTypeString"), ("part", "p_size", "esriFieldTypeSmallInteger"), ("part", "p_type", "esriFieldTypeBlob"),
]
UNUSABLE_SQL = f"""obs AS (SELECT DISTINCT dataset, attr FROM ({PROFILE_SQL})), decl AS (SELECT * FROM {values_sql(DECLARED, 'dataset, attr, data_type')}),
unusable AS ((SELECT dataset, attr FROM decl EXCEPT SELECT * FROM obs) UNION (SELECT * FROM obs EXCEPT SELECT dataset, attr FROM decl))"""


def _declared(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return inline(spark, DECLARED, "dataset string, attr string, data_type string"), stats(spark, d).select("dataset", "attr").distinct()


@query(f"WITH {UNUSABLE_SQL} SELECT * FROM unusable")
def attrs_to_delete(spark, d):
    """Columns that are declared or hold values, but not both."""
    return profile.unusable_attributes(*_declared(spark, d))


@query(f"WITH {UNUSABLE_SQL} SELECT dataset, attr FROM decl WHERE data_type NOT IN ('esriFieldTypeString', 'esriFieldTypeBlob') UNION SELECT * FROM unusable")
def datatype_match_join(spark, d):
    """P5: columns of other types than text, and unusable ones."""
    declared, observed = _declared(spark, d)
    return profile.incompatible_attributes(declared, "esriFieldTypeString", profile.unusable_attributes(declared, observed))


@query(f"""WITH v AS ({PROFILE_SQL}), g AS (SELECT dataset, attr, CASE WHEN bool_and(regexp_matches(value, '^-?[0-9]+$')) THEN 'int' WHEN bool_and(regexp_matches(value, '^-?[0-9]+([.][0-9]+)?$')) THEN 'float' ELSE 'string' END AS kind FROM v GROUP BY ALL)
SELECT a.dataset AS src_dataset, a.attr AS src_attr, b.dataset AS tar_dataset, b.attr AS tar_attr, CASE WHEN a.kind = b.kind THEN 1.0 ELSE 0.0 END::DOUBLE AS score FROM g a JOIN g b ON a.dataset < b.dataset""")
def type_scores(spark, d):
    """The kinds of the values of all column pairs of different tables compared."""
    whole, number = F.bool_and(F.col("value").rlike("^-?[0-9]+$")), F.bool_and(F.col("value").rlike("^-?[0-9]+([.][0-9]+)?$"))
    kinds = stats(spark, d).groupBy("dataset", "attr").agg(F.when(whole, "int").when(number, "float").otherwise("string").alias("kind"))
    side = lambda p: kinds.select(F.col("dataset").alias(f"{p}_dataset"), F.col("attr").alias(f"{p}_attr"), F.col("kind").alias(f"{p}_kind"))
    pairs = side("src").join(side("tar"), F.col("src_dataset") < F.col("tar_dataset"))
    return pairs.select("src_dataset", "src_attr", "tar_dataset", "tar_attr", profile.same_type(F.col("src_kind"), F.col("tar_kind")).alias("score"))


# ---- scores and learning --------------------------------------------------------------------------------------

SPEND_SQL = "SELECT n_name AS row_topic, {} AS col_topic, avg(l_discount) * 10 AS s FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey WHERE {} GROUP BY ALL"


@query(f"""WITH x AS ({SPEND_SQL.format("p_type", "l_quantity < 25")}), y AS ({SPEND_SQL.format("p_type", "l_tax > 0.01")}) SELECT row_topic, col_topic, round(CASE WHEN x.s IS NULL AND y.s IS NULL THEN NULL ELSE 1 / (1 + exp(-(coalesce(x.s * 0.8, 0) + coalesce(y.s * 0.2, 0)) / (CASE WHEN x.s IS NULL THEN 0 ELSE 0.8 END + CASE WHEN y.s IS NULL THEN 0 ELSE 0.2 END))) END, 6) AS score FROM x FULL JOIN y USING (row_topic, col_topic)""")
def combined_matrices(spark, d):
    """M34 over two matrices of nations and part types."""
    joined = t(spark, d, "lineitem").join(t(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey")).join(t(spark, d, "supplier"), F.col("s_suppkey") == F.col("l_suppkey")).join(t(spark, d, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    matrix = lambda kept: joined.filter(kept).groupBy(F.col("n_name").alias("row_topic"), F.col("p_type").alias("col_topic")).agg((F.avg("l_discount") * 10).alias("score"))
    return matchers.combined_scores(matrix("l_quantity < 25"), matrix("l_tax > 0.01"), ["row_topic", "col_topic"]).select("row_topic", "col_topic", r6(F.col("score"), "score"))


@query(f"WITH RECURSIVE {bigram_sql('SELECT p_name AS a, lower(p_type) AS b FROM (SELECT DISTINCT p_name FROM part), (SELECT DISTINCT p_type FROM part)')} SELECT p_partkey AS row_id, b AS class, round(score, 6) AS score FROM part JOIN sim ON a = p_name")
def name_classifier(spark, d):
    """part names against the types as classes."""
    rows = t(spark, d, "part").select(F.col("p_partkey").alias("row_id"), F.col("p_name").alias("name"), F.lower("p_type").alias("class"))
    model = learn.NameClassifier()
    model.fit(rows)
    return model.predict(rows.select("row_id", "name")).select("row_id", "class", r6(F.col("score"), "score"))


@query(f"""WITH RECURSIVE {bigram_sql("SELECT b AS a, a AS b FROM (SELECT DISTINCT lower(p_type) AS b FROM part), (SELECT DISTINCT p_name AS a FROM part)")}, top AS (SELECT *, max(score) OVER (PARTITION BY a) AS top FROM sim), nxt AS (SELECT *, max(CASE WHEN score < top THEN score END) OVER (PARTITION BY a) AS next FROM top)
SELECT 'part' AS dataset, a AS topic, b AS attribute, round(score, 6) AS score FROM nxt WHERE score = top AND (top >= 0.5 OR next IS NULL OR next < top / 1.2)""")
def toy_matches(spark, d):
    """Part types against part names as a schema, the potential matches."""
    part = t(spark, d, "part")
    owned = part.select(F.lit("part").alias("dataset"), F.col("p_name").alias("attribute")).distinct()
    pairs = matchers.name_matrix(part.select(F.lower("p_type").alias("topic")).distinct(), owned.select("attribute").distinct(), "topic", "attribute")
    attrs = owned.select("dataset", F.col("attribute").alias("name"), F.lit(None).cast("string").alias("domain"), F.lit(None).cast("array<string>").alias("coded_values"), F.lit("s").alias("data_type"))
    return toy_run(pairs.join(owned, "attribute"), attrs, owned, 1.2).select("dataset", "topic", "attribute", r6(F.col("score"), "score"))


# ---- matchers as SQL functions --------------------------------------------------------------------------------


@query("""WITH c AS (SELECT DISTINCT p_name AS l, lower(p_type) AS r FROM part), k AS (SELECT l, r, unnest(list_distinct(list_filter(string_split(l || r, ''), lambda x: x <> ''))) AS x FROM c), n AS (SELECT l, r, length(l) - length(replace(l, x, '')) AS p, length(r) - length(replace(r, x, '')) AS q FROM k)
SELECT l, r, round(sum(p * q) / (sqrt(sum(p * p)) * sqrt(sum(q * q))), 6) AS characters FROM n GROUP BY ALL""")
def sql_character_cosine(spark, d):
    """M22 from SQL text."""
    sim.register_matchers(spark)
    return spark.sql("SELECT l, r, round(character_cosine(l, r), 6) AS characters FROM (SELECT DISTINCT p_name AS l, lower(p_type) AS r FROM {part})", part=t(spark, d, "part"))


@query("""WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), c AS (SELECT label, v FROM (SELECT label, v, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM e) WHERE n = 1)
SELECT vec_id, c.label AS centre, round(list_cosine_similarity(e.v, c.v), 6) AS score FROM e, c""")
def sql_vector_cosine(spark, d):
    """M9 from SQL text: each vector against the first of each label."""
    sim.register_matchers(spark)
    return spark.sql(
        """WITH e AS (SELECT vec_id, label, CAST(embedding AS ARRAY<DOUBLE>) AS v FROM {vectors}), c AS (SELECT label AS centre, min_by(v, vec_id) AS w FROM e GROUP BY 1)
        SELECT vec_id, centre, round(vector_cosine(v, w), 6) AS score FROM e JOIN c ON true""",
        vectors=t(spark, d, "embeddings"),
    )


@query("""WITH a AS (SELECT l_returnflag AS f, l_linestatus AS s, avg(l_discount) * 10 AS x, avg(l_tax) * 10 AS y FROM lineitem GROUP BY ALL) SELECT f, s, round(1 / (1 + exp(-(x * 0.7 + y * 0.3) / (0.7 + 0.3))), 6) AS score FROM a""")
def sql_composite_score(spark, d):
    """M34 from SQL text."""
    sim.register_matchers(spark)
    return spark.sql("SELECT f, s, round(composite_score(x, y, 0.7D, 0.3D), 6) AS score FROM (SELECT l_returnflag AS f, l_linestatus AS s, avg(l_discount) * 10 AS x, avg(l_tax) * 10 AS y FROM {lineitem} GROUP BY ALL)", lineitem=t(spark, d, "lineitem"))


@query("""WITH w AS (SELECT DISTINCT p_name AS l, 'big ' || split_part(p_name, ' ', 2) || ' box' AS r FROM part), k AS (SELECT l, r, unnest(list_distinct(string_split(l || ' ' || r, ' '))) AS x FROM w),
n AS (SELECT l, r, len(list_filter(string_split(l, ' '), lambda v: v = x)) / len(string_split(l, ' ')) * CASE WHEN list_contains(string_split(l, ' '), x) AND list_contains(string_split(r, ' '), x) THEN 2 ELSE 1 END AS p, len(list_filter(string_split(r, ' '), lambda v: v = x)) / len(string_split(r, ' ')) * CASE WHEN list_contains(string_split(l, ' '), x) AND list_contains(string_split(r, ' '), x) THEN 2 ELSE 1 END AS q FROM k)
SELECT l, r, round(sum(p * q) / (sqrt(sum(p * p)) * sqrt(sum(q * q))), 6) AS score FROM n GROUP BY ALL""")
def sql_text_cosine(spark, d):
    """M16-M18 from SQL text."""
    sim.register_matchers(spark)
    return spark.sql("SELECT l, r, round(text_cosine(l, r, 2D), 6) AS score FROM (SELECT DISTINCT p_name AS l, concat('big ', split_part(p_name, ' ', 2), ' box') AS r FROM {part})", part=t(spark, d, "part"))


# ---- files ----------------------------------------------------------------------------------------------------


def _folder(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


@query("SELECT p_name, p_brand, p_size::VARCHAR AS p_size FROM part")
def csv_rows(spark, d):
    """Part written as CSV with a row index, and read back as strings."""
    path = _folder(spark, "csv")
    t(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_size").write.csv(path, header=True)
    return catalogue.read_csv_table(spark, path)


@query("SELECT c_custkey AS custkey, c_mktsegment AS segment, round(c_acctbal, 6) AS balance, CASE WHEN c_custkey % 2 = 0 THEN 'Point' ELSE 'Polygon' END AS geometry_type FROM customer")
def geojson_rows(spark, d):
    """Customers written as a feature collection for each nation, and read back by ranges of bytes."""
    path = _folder(spark, "geojson")
    shape = F.struct(F.when(F.col("c_custkey") % 2 == 0, "Point").otherwise("Polygon").alias("type"), F.array("c_custkey").alias("coordinates"))
    properties = F.struct(F.col("c_custkey").alias("custkey"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"), F.struct("c_name").alias("more"))
    features = t(spark, d, "customer").select("c_nationkey", F.to_json(F.struct(F.lit("Feature").alias("type"), properties.alias("properties"), shape.alias("geometry"))).alias("f"))
    own = Window.partitionBy("c_nationkey").orderBy("f")  # a line for each feature, no collection in one row
    head = F.when(F.lag("f").over(own).isNull(), '{"type":"FeatureCollection","features":[').otherwise("")
    tail = F.when(F.lead("f").over(own).isNull(), "]}").otherwise(",")
    features.select("c_nationkey", F.concat(head, "f", tail).alias("value")).write.partitionBy("c_nationkey").text(path)
    return catalogue.read_geojson(spark, path, range_bytes=4096).select("custkey", "segment", F.round(F.col("balance").cast("double"), 6).alias("balance"), "geometry_type")


@query("SELECT doc_id, strlen(text) AS n_bytes, md5(text) AS digest FROM documents")
def zipped_documents(spark, d):
    """Documents written as members of zip archives, and read back member by member."""
    path = _folder(spark, "zip")
    members = t(spark, d, "documents").select(F.concat("doc_id", F.lit(".txt")).alias("name"), "text")
    archives.write_zips(members.repartition(4, "name"), path, "name", "text").count()
    return catalogue.read_zip(spark, path).select(F.split_part("file", F.lit("."), F.lit(1)).cast("long").alias("doc_id"), F.octet_length("content").cast("long").alias("n_bytes"), F.md5("content").alias("digest"))


# ---- drivers --------------------------------------------------------------------------------------------------


@query("SELECT p_type AS class, classifier, count(*) AS n FROM (SELECT DISTINCT p_type FROM part), (VALUES ('chars'), ('names')) AS v(classifier) GROUP BY ALL")
def kept_weights(spark, d):
    """weights of two scores of part rows for each type, saved and read again; the keys are compared here, the values in tests."""
    part = t(spark, d, "part").withColumn("name", F.split("p_name", " ")[1])
    rows = part.select(F.col("p_partkey").alias("row_id"), F.col("p_type").alias("class"))
    classes = rows.select("class").distinct()
    scored = all_pairs(part.select(F.col("p_partkey").alias("row_id"), "name"), classes).withColumn("chars", sim.character_cosine(F.col("name"), F.lower("class"))).withColumn("names", F.length("name") / (F.length("name") + F.length("class")))
    path = _folder(spark, "weights")
    learn.save_weights(learn.meta_weights(scored.select("row_id", "class", "chars", "names"), rows, ["chars", "names"]), path)
    return learn.load_weights(spark, path).filter("weight IS NOT NULL").groupBy("class", "classifier").agg(F.count("*").alias("n"))
