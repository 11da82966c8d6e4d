"""Command line (S6, P18): shape a saved catalogue, convert layer files, profile a table, find a topic's position."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from topicloom.operators.profile import column_profile
from topicloom.sources import catalogue


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="topicloom")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, what in (("catalogue", "JSON of search responses"), ("layers", "folder of layer JSON files"), ("profile", "CSV table")):
        one = commands.add_parser(name, help=f"reads a {what}, writes Parquet")
        one.add_argument("source")
        one.add_argument("target")
    topic = commands.add_parser("topic", help="the position of a topic in a saved vocabulary")
    topic.add_argument("source")
    topic.add_argument("--s", required=True)
    a = parser.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if a.command == "catalogue":
        out = catalogue.shape_catalogue(spark.read.json(a.source, multiLine=True))
    elif a.command == "layers":
        out = catalogue.parse_layers(spark.read.json(a.source, multiLine=True).withColumn("file", F.input_file_name()))
    elif a.command == "profile":
        out = column_profile(catalogue.read_csv_table(spark, a.source), catalogue.file_stem(a.source))
    else:
        spark.read.parquet(a.source).filter(F.col("topic") == a.s).select("ordinal", "topic").show(truncate=False)
        return
    out.write.mode("overwrite").parquet(a.target)


if __name__ == "__main__":
    main()
