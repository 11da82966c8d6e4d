"""Catalogue and table sources and sinks (S2-S27). Downloads (S1, S4, S5) are left to whatever fetches files; the readers take what they save."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topicloom.functions.text import clean_name, file_name
from topicloom.operators.names import similar_names

from .archives import RANGE_BYTES, register_sources


def file_stem(path: str) -> str:
    """A path's last part without its ending."""
    return path.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[0]


def shape_catalogue(responses: DataFrame) -> DataFrame:
    """One row for each searched name (dataset_name, results): the result with exactly that name, its csv and json resources, all lower-case."""
    exact = responses.select("dataset_name", F.explode("results").alias("r")).filter(F.col("r.name") == F.col("dataset_name"))
    lowered = lambda s, names: F.struct(*[F.lower(s[n]).alias(n) for n in names])
    usable = F.filter("r.resources", lambda x: F.lower(x["format"]).isin("json", "csv"))
    return exact.select(
        F.lower("r.name").alias("dataset"), F.lower("r.title").alias("title"), F.lower("r.notes").alias("notes"), F.size(usable).alias("count"),
        F.transform(usable, lambda x: F.struct(F.lower(x["name"]).alias("name"), F.lower(x["format"]).alias("format"), x["url"].alias("url"), file_name(x["url"]).alias("file"))).alias("resources"),
        F.transform("r.tags", lambda x: lowered(x, ("name", "display_name"))).alias("tags"),
        F.transform("r.groups", lambda x: lowered(x, ("name", "display_name", "description"))).alias("groups"),
    )


def read_csv_table(spark: SparkSession, path: str, index: bool = True) -> DataFrame:
    """A CSV with a header, all strings; the first column is a row index unless index=False."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"')
    return df.drop(df.columns[0]) if index and df.columns else df


def csv_resources(links: DataFrame) -> DataFrame:
    """Dataset and resource (format, data: the file that holds it) of files (dataset, file)."""
    return links.select("dataset", F.struct(F.lit("csv").alias("format"), F.col("file").alias("data")).alias("resource"))


def read_geojson(spark: SparkSession, path: str, flat: bool = True, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """A row for each feature: its properties, in name order and without nested ones if flat, and geometry_type. A file is cut at feature boundaries and read by many tasks (archives.FeatureSource); types are inferred from all features."""
    register_sources(spark)
    text = spark.read.format("geojson_features").option("rangebytes", range_bytes).load(path).select("feature")
    kinds = text.select(F.schema_of_variant_agg(F.parse_json("feature")).alias("kind")).first()["kind"]
    if not kinds or kinds == "VOID":
        return spark.createDataFrame([], "geometry_type string")
    features = text.select(F.from_json("feature", kinds.replace("OBJECT<", "STRUCT<")).alias("f"))
    inner = features.schema["f"].dataType
    properties = inner["properties"].dataType if "properties" in inner.names else None
    fields = properties.fields if isinstance(properties, T.StructType) else []
    plain = [x.name for x in fields if not flat or not isinstance(x.dataType, (T.StructType, T.ArrayType, T.MapType))]
    names = sorted(plain) if flat else plain
    shape = F.col("f.geometry.type") if "geometry" in inner.names and isinstance(inner["geometry"].dataType, T.StructType) else F.lit(None).cast("string")
    return features.select(*[F.col(f"f.properties.`{n}`").alias(n) for n in names], shape.alias("geometry_type"))


def read_zip(spark: SparkSession, path: str) -> DataFrame:
    """File, content of every member of zip files; a member without an ending counts as .csv. An archive's members are read by many tasks (archives.MemberSource)."""
    register_sources(spark)
    name = F.element_at(F.split("member", "/"), -1)
    return spark.read.format("zip_members").load(path).select(F.when(F.instr(name, ".") > 0, name).otherwise(F.concat(name, F.lit(".csv"))).alias("file"), "content")


def parse_layers(layers: DataFrame) -> DataFrame:
    """Dataset, ordinal, name, alias, domain, coded_values, data_type of every field of layer files (file, body)."""
    stem = clean_name(F.regexp_replace(file_name(F.col("file")), r"\.[^.]*$", ""))
    fields = layers.select(stem.alias("dataset"), F.posexplode("body.fields").alias("ordinal", "f"))
    name, alias = F.lower("f.name"), F.lower("f.alias")
    coded = F.col("f.domain.type") == "codedValue"
    return fields.select("dataset", "ordinal", name.alias("name"), F.nullif(alias, name).alias("alias"), F.when(coded, "coded_values").alias("domain"), F.when(coded, F.transform("f.domain.codedValues", lambda x: x["name"])).alias("coded_values"), F.col("f.type").alias("data_type"))


def link_files(files: DataFrame, datasets: DataFrame, threshold: float = 0.85) -> DataFrame:
    """File, dataset, score: the dataset with the file's cleaned name, else the most similar one at or over the threshold. Only names that share enough bigrams are compared (names.similar_names)."""
    named = files.select("file", clean_name(file_name(F.col("file")), has_extension=True).alias("stem"))
    exact = named.join(datasets.select("dataset"), F.col("stem") == F.col("dataset")).select("file", "dataset", F.lit(1.0).alias("score"))
    rest = named.join(exact.select("file"), "file", "left_anti")
    alike = similar_names(rest.select(F.col("stem").alias("a")), datasets.select(F.col("dataset").alias("b")), threshold - 1e-9).filter(F.col("score") >= threshold)
    scored = rest.join(alike.select(F.col("a").alias("stem"), F.col("b").alias("dataset"), "score"), "stem")
    best = scored.withColumn("n", F.row_number().over(Window.partitionBy("file").orderBy(F.desc("score"), "dataset"))).filter("n = 1")
    return exact.unionByName(best.select("file", "dataset", "score"))


def datasources_and_tags(catalogue: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The catalogue with the files of each dataset, and the datasets without any."""
    paths = links.groupBy("dataset").agg(F.sort_array(F.collect_list("file")).alias("source_filename"))
    return catalogue.join(paths, "dataset"), catalogue.join(paths, "dataset", "left_anti")


def files_to_convert(links: DataFrame, done: DataFrame) -> DataFrame:
    """The best file of each dataset that has no converted table yet; CSV goes before JSON, then the higher score."""
    order = Window.partitionBy("dataset").orderBy(F.desc(F.lower("file").endswith(".csv")), F.desc("score"), "file")
    best = links.withColumn("n", F.row_number().over(order)).filter("n = 1").drop("n")
    return best.join(done.select("dataset"), "dataset", "left_anti")


def attribute_stats(stats: DataFrame, dataset: str, attr: str | None = None) -> DataFrame:
    """The stored profile of a table or attribute; tables stored by dataset are pruned to it."""
    out = stats.filter(F.col("dataset") == dataset)
    return out if attr is None else out.filter(F.col("attr") == attr)


def write_stats(stats: DataFrame, path: str) -> None:
    """Profiles or matrices as Parquet, a folder for each dataset."""
    stats.write.partitionBy("dataset").mode("overwrite").parquet(path)


def stats_json(stats: DataFrame) -> DataFrame:
    """Dataset, json: {attr: {value: count}} with sorted keys."""
    attrs = stats.groupBy("dataset", "attr").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("value", "cnt")))).alias("m"))
    maps = attrs.groupBy("dataset").agg(F.array_sort(F.collect_list("attr")).alias("names"), F.map_from_entries(F.collect_list(F.struct("attr", "m"))).alias("by"))
    return maps.select("dataset", F.to_json(F.map_from_arrays("names", F.transform("names", lambda n: F.col("by")[n]))).alias("json"))


def read_stats_json(spark: SparkSession, path: str) -> DataFrame:
    """Attr, value, cnt of a profile file {attr: {value: count}}, with its dataset's name."""
    whole = spark.read.text(path, wholetext=True).select(F.regexp_replace(file_name(F.input_file_name()), r"\.json$", "").alias("dataset"), F.from_json("value", "map<string,map<string,bigint>>").alias("m"))
    attrs = whole.select("dataset", F.explode("m").alias("attr", "values"))
    return attrs.select("dataset", "attr", F.explode("values").alias("value", "cnt"))


def similarity_matrix(sim: DataFrame, row: str, column: str) -> DataFrame:
    """The long form as a matrix, for export; columns in name order."""
    return sim.groupBy(row).pivot(column).agg(F.first("score"))


def topic_sources(topics: DataFrame, wanted: DataFrame) -> DataFrame:
    """Topic and sources of the topics wanted."""
    return topics.join(wanted.select("topic").distinct(), "topic", "left_semi").select("topic", "sources")


def source_bundle(dataset: str, attrs: DataFrame, stats: DataFrame, topics: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A table's effective attributes (declared, observed, no place columns), their profile, and its topics."""
    observed = stats.filter(F.col("dataset") == dataset)
    own = attrs.filter((F.col("dataset") == dataset) & ~F.col("name").isin("latitude", "longitude")).join(observed.select(F.col("attr").alias("name")).distinct(), "name", "left_semi")
    return own, observed.join(own.select(F.col("name").alias("attr")), "attr", "left_semi"), topics.filter(F.array_contains("sources", dataset))


def contexts_by_topic(context: DataFrame) -> DataFrame:
    """Topic, dataset, synsets."""
    return context.filter(F.col("kind") == "topic").groupBy(F.col("name").alias("topic"), "dataset").agg(F.sort_array(F.collect_set("synset")).alias("synsets"))


def consolidate_contexts(files: DataFrame) -> DataFrame:
    """Dataset, name, synset, overlap from enrichment files (file, probs: map synset -> overlap): [dataset_name].json; empty overlaps are dropped, repeated ones united."""
    stem = F.regexp_extract("file", r"\[([^\]]*)\]", 1)
    parts = files.select(F.substring_index(stem, "_", 1).alias("dataset"), F.regexp_extract(stem, "_(.*)$", 1).alias("name"), F.explode("probs").alias("synset", "overlap")).filter(F.size("overlap") > 0)
    return parts.groupBy("dataset", "name", "synset").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("overlap")))).alias("overlap"))


def ground_truth(labels: DataFrame) -> DataFrame:
    """Dataset, topic from rows (file, topics), the dataset's name standing in brackets."""
    return labels.select(F.regexp_extract("file", r"\[([^\]]*)\]", 1).alias("dataset"), F.explode("topics").alias("topic")).distinct()
