"""Profiling and sampling (A1-A19) and schema predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicloom.functions.text import is_float, strip_special

from .numbering import with_position

# Which declared types may be compared with each other.
TYPE_GROUPS = {
    "esriFieldTypeString": 1, "esriFieldTypeBlob": 1, "esriFieldTypeDate": 2, "esriFieldTypeDouble": 3, "esriFieldTypeInteger": 3,
    "esriFieldTypeSingle": 3, "esriFieldTypeSmallInteger": 3, "esriFieldTypeGeometry": 4, "esriFieldTypeGlobalID": 5, "esriFieldTypeOID": 5,
}
#: Columns that are never compared.
PLACE_COLUMNS = ("latitude", "longitude")


def clean_columns(df: DataFrame) -> DataFrame:
    """All columns under their clean names."""
    plain = lambda s: s.translate(str.maketrans("-_.", "   ")).lower().strip()
    return df.toDF(*map(plain, df.columns))


def drop_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """Without these columns, where they exist."""
    return df.drop(*names)


def long_values(df: DataFrame, dataset: str) -> DataFrame:
    """dataset, attr, ordinal, value (as string) of every cell: one scan for all columns."""
    cells = F.array(*[F.struct(F.lit(c).alias("attr"), F.lit(i).alias("ordinal"), F.col(f"`{c}`").cast("string").alias("value")) for i, c in enumerate(df.columns)])
    return df.select(F.lit(dataset).alias("dataset"), F.explode(cells).alias("cell")).select("dataset", "cell.*")


def column_profile(df: DataFrame, dataset: str) -> DataFrame:
    """A1, A2: dataset, attr, value, cnt; nulls do not count. One shuffle for all attributes, combined before it."""
    cells = long_values(df, dataset).filter(F.col("value").isNotNull())
    return cells.groupBy("dataset", F.col("attr"), "value").agg(F.count("*").alias("cnt"))


def head_limit(n: Column, ratio: float, least: int, most: int) -> Column:
    """A3: how many of n rows a head sample takes."""
    return F.least(F.greatest((n * ratio).cast("long"), F.lit(least)), F.lit(most))


def head_sample(df: DataFrame, by: list[str], order: str, ratio: float, least: int, most: int) -> DataFrame:
    """A3: the first rows of each group in the order of a column; at most `most`, which lets Spark prune rows before the shuffle."""
    within = Window.partitionBy(*by)
    numbered = df.withColumn("__n", F.row_number().over(within.orderBy(order))).filter(F.col("__n") <= most)
    sizes = df.groupBy(*by).agg(F.count("*").alias("__rows"))
    return numbered.join(sizes, by).filter(F.col("__n") <= head_limit(F.col("__rows"), ratio, least, most)).drop("__n", "__rows")


def hashed_sample(df: DataFrame, by: list[str], value: str, most: int, seed: int = 1) -> DataFrame:
    """A4, A5: a seeded sample of at most `most` rows of each group."""
    order = Window.partitionBy(*by).orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(value).cast("string")).cast("binary")), value)
    return df.withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= most).drop("__n")


def reduced_values(values: DataFrame, numeric_bins: int = 20, other_bins: int = 100) -> DataFrame:
    """Attr, ordinal, value thinned to every k-th in order; lists under 100 stay whole. Lists with less than 30 % other values keep 20 bins and all their other values, the rest 100 bins."""
    marked = with_position(values.select("attr", "ordinal", "value").withColumn("num", is_float(F.col("value"))), "attr", "ordinal")
    others = marked.groupBy("attr").agg(F.sum((~F.col("num")).cast("long")).alias("n_other"))
    placed = marked.join(others, "attr")
    every = lambda bins: F.col("pos") % F.greatest(F.floor(F.col("n") / bins), F.lit(1)) == 0
    keep = F.when(F.col("n") < other_bins, True).when(F.col("n_other") < 0.3 * F.col("n"), ~F.col("num") | every(numeric_bins)).otherwise(every(other_bins))
    return placed.filter(keep).select("attr", "ordinal", "value")


def rarest_values(stats: DataFrame, k: int = 5) -> DataFrame:
    """The k values of each attribute with the lowest counts, as a list filled up with its first (or '')."""
    order = Window.partitionBy("dataset", "attr").orderBy("cnt", "value")
    few = stats.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    lists = few.groupBy("dataset", "attr").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "value"))), lambda s: s["value"]).alias("vals"))
    filler = F.coalesce(F.element_at("vals", 1), F.lit(""))
    return lists.select("dataset", "attr", F.concat("vals", F.array_repeat(filler, F.lit(k) - F.size("vals"))).alias("vals"))


def top_values(stats: DataFrame, k: int = 2) -> DataFrame:
    """The k most frequent values of each attribute."""
    order = Window.partitionBy("dataset", "attr").orderBy(F.desc("cnt"), "value")
    return stats.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("dataset", "attr", "rank", "value", "cnt")


def type_census(attrs: DataFrame) -> DataFrame:
    """How many attributes have each declared type."""
    return attrs.groupBy("data_type").agg(F.count("*").alias("cnt"))


def invert(pairs: DataFrame, key: str, value: str) -> DataFrame:
    """Key, and the sorted distinct values that it has."""
    return pairs.select(key, value).distinct().groupBy(key).agg(F.sort_array(F.collect_list(value)).alias(f"{value}s"))


def one_hot(pairs: DataFrame, item: str, tag: str) -> DataFrame:
    """A 0/1 vector of each item over the sorted vocabulary."""
    distinct = pairs.select(item, tag).distinct()
    vocabulary = distinct.select(tag).distinct().agg(F.sort_array(F.collect_set(tag)).alias("vocabulary"))  # the tags, not the items
    tags = distinct.groupBy(item).agg(F.collect_set(tag).alias("own"))
    return tags.crossJoin(F.broadcast(vocabulary)).select(item, F.transform("vocabulary", lambda t: F.array_contains("own", t).cast("int")).alias("vec"))


def mean_lengths(stats: DataFrame, sentence: int = 30) -> DataFrame:
    """The mean length of an attribute's distinct values, and whether they read as sentences."""
    mean = F.avg(F.length("value"))
    return stats.groupBy("dataset", "attr").agg(mean.alias("mean_length"), (mean >= sentence).alias("is_text"))


def term_frequencies(docs: DataFrame, id_: str, text: str) -> DataFrame:
    """Id, word, n and tf of the cleaned text's words."""
    words = docs.select(F.col(id_).alias("id"), F.filter(F.split(strip_special(F.col(text)), " ", -1), lambda w: w != "").alias("words"))
    return words.select("id", F.size("words").alias("length"), F.explode("words").alias("word")).groupBy("id", "length", "word").agg(F.count("*").alias("n")).select("id", "word", "n", (F.col("n") / F.col("length")).alias("tf"))


def guessed_types(values: DataFrame) -> DataFrame:
    """P7: 'str' if over 70 % of an attribute's values are no numbers, else 'num'."""
    share = F.avg(F.when(is_float(F.col("value")), 0.0).otherwise(1.0))
    return values.groupBy("dataset", "attr").agg(F.when(share > 0.7, "str").otherwise("num").alias("guess"))


def same_type(left: Column, right: Column) -> Column:
    """1 for equal declared types, else 0."""
    return F.when(left == right, 1.0).otherwise(0.0)


def type_group(data_type: Column) -> Column:
    out = None
    for name, group in TYPE_GROUPS.items():
        out = F.when(data_type == name, group) if out is None else out.when(data_type == name, group)
    return out


def unusable_attributes(declared: DataFrame, observed: DataFrame) -> DataFrame:
    """Dataset and attr that are declared or observed but not both, and the place columns."""
    keys = ["dataset", "attr"]
    one_sided = declared.select(keys).exceptAll(observed.select(keys)).unionAll(observed.select(keys).exceptAll(declared.select(keys)))
    places = observed.select(keys).filter(F.col("attr").isin(*PLACE_COLUMNS))
    return one_sided.unionAll(places).distinct()


def incompatible_attributes(attrs: DataFrame, data_type: str, unusable: DataFrame) -> DataFrame:
    """P5: attributes whose type group differs from a source type's, and unusable ones."""
    group = TYPE_GROUPS.get(data_type)
    other = attrs.filter(~type_group(F.col("data_type")).eqNullSafe(F.lit(group)))
    return other.select("dataset", "attr").unionAll(unusable.select("dataset", "attr")).distinct()


def eligible_datasets(tagged: DataFrame, declared: DataFrame, excluded: DataFrame, least: int = 1) -> DataFrame:
    """Datasets with tags and at least `least` usable attributes that are not excluded."""
    enough = declared.groupBy("dataset").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return tagged.select("dataset").distinct().join(enough.select("dataset"), "dataset", "left_semi").join(excluded, "dataset", "left_anti")


def guiding_candidates(attrs: DataFrame, topics: DataFrame, least_attrs: int = 10, least_topics: int = 5) -> DataFrame:
    """Datasets with at least so many attributes (dataset, attr) and topics (dataset, topic)."""
    many = lambda df, c, n: df.groupBy("dataset").agg(F.count_distinct(c).alias("n")).filter(F.col("n") >= n).select("dataset")
    return many(attrs, "attr", least_attrs).join(many(topics, "topic", least_topics), "dataset", "left_semi")


def open_batches(sections: DataFrame, saved: DataFrame) -> DataFrame:
    """P10: section, dataset still to be done: those not saved yet, each in the first section that names it."""
    first = sections.groupBy("dataset").agg(F.min("section").alias("section"))
    return first.join(saved.select("dataset"), "dataset", "left_anti").select("section", "dataset")


def coded_values(attrs: DataFrame, stats: DataFrame) -> DataFrame:
    """Attributes without a domain get their sorted observed values."""
    lists = stats.groupBy("dataset", F.col("attr").alias("name")).agg(F.sort_array(F.collect_set("value")).alias("observed"))
    joined = attrs.join(lists, ["dataset", "name"], "left")
    fill = F.col("domain").isNull() & F.col("observed").isNotNull()
    return joined.withColumns({"coded_values": F.when(fill, F.col("observed")).otherwise(F.col("coded_values")), "domain": F.when(fill, F.lit("coded_values_groupby")).otherwise(F.col("domain"))}).drop("observed")


def example_values(keys: DataFrame, attrs: DataFrame) -> DataFrame:
    """The coded values of attributes ([] if none) and the first of them."""
    known = attrs.select("dataset", F.col("name").alias("attribute"), "coded_values", "data_type")
    values = F.sort_array(F.coalesce("coded_values", F.array().cast("array<string>")))
    return keys.join(known, ["dataset", "attribute"], "left").withColumn("example_values", values).withColumn("example", F.try_element_at("example_values", F.lit(1))).drop("coded_values")


