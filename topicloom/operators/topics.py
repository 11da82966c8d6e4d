"""Topic models of texts."""

from __future__ import annotations

from pyspark.ml.clustering import LDA
from pyspark.ml.feature import CountVectorizer, StopWordsRemover
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.functions.text import strip_special


def topic_model(docs: DataFrame, k: int = 3, rounds: int = 20, seed: int = 100, vocabulary: int = 20_000, least: int = 2) -> DataFrame:
    """id, topic, weight, rank: LDA over the cleaned words of texts (id, text) without stop words, topics by falling weight.

    The model counts the `vocabulary` most frequent words that occur in `least` texts or more, and no others; a text
    without any has weight 0 in all topics.
    """
    words = docs.select("id", F.filter(F.split(strip_special(F.col("text")), " ", -1), lambda w: w != "").alias("words"))
    kept = StopWordsRemover(inputCol="words", outputCol="kept").transform(words)
    counted = CountVectorizer(inputCol="kept", outputCol="features", vocabSize=vocabulary, minDF=least).fit(kept).transform(kept).select("id", "features")
    model = LDA(k=k, maxIter=rounds, seed=seed, optimizer="online").fit(counted)
    weighted = model.transform(counted).select("id", F.posexplode(vector_to_array("topicDistribution")).alias("topic", "weight"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("o"), "topic", "weight")))
    return weighted.groupBy("id").agg(ordered.alias("all")).select("id", F.posexplode("all").alias("rank", "x")).select("id", "x.topic", "x.weight", (F.col("rank") + 1).alias("rank"))
