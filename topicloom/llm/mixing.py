"""Mixing sources to target weights: budgets flow down a tree of domain, language and source.

Weights are integers for each child of a node; a child without one gets the default. A node's capacity is the tokens
below it times max_epochs. The budget is a share of all tokens. Each node divides its budget among its children in
proportion to their weights; a child that cannot use its part gets its capacity, and what it leaves goes to its
siblings by weight until they are full too. As capacities are sums over the leaves below, a node never gets more
than its children can use: what a whole family lacks has gone to the parent's siblings, that is, shortages are
settled among siblings before ancestors. (Sort children by capacity over weight: one running sum settles a family.)

A leaf with budget b and T tokens takes b div T whole epochs, then the prefix of one more, in the order of
md5(seed:epoch:id), that fits the remainder. A prefix ends between ids, so a leaf stays under its budget by less than
the next document. Running sums are made in two steps, over at most 65,536 hash buckets of a leaf and within a
bucket, so no leaf is gathered in one task.

A child of weight 0 is left out: it has no capacity and gets nothing, and neither does a family of such children.
Weights are whole numbers of 0 or more; others are an error. A text's tokens are its UTF-8 bytes div 4, plus 1. Null domain, language or source count as empty strings, null ids
as empty too; rows that repeat an id are taken together or not at all. A source with budget 0 gives nothing. An
empty table gives an empty result. Other columns are kept, in m_row.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, col, packed, table, unpacked

LEAF = ["m_domain", "m_lang", "m_source"]
#: Leaf tables of at most so many rows are broadcast; larger ones are shuffled.
BROADCAST_LEAVES = 50_000


@dataclass(frozen=True)
class Mix:
    share: float = 0.6
    max_epochs: int = 4
    seed: int = 17
    domains: dict[str, int] = field(default_factory=lambda: {"domain0": 40, "domain1": 30, "domain2": 20, "domain3": 10})
    languages: dict[str, int] = field(default_factory=lambda: {"en": 50, "de": 20, "fr": 20, "es": 10})
    sources: dict[str, int] = field(default_factory=dict)
    default: int = 5

    def __post_init__(self) -> None:
        if any(not isinstance(w, int) or w < 0 for w in (self.default, *self.domains.values(), *self.languages.values(), *self.sources.values())):
            raise ValueError("weights are whole numbers of 0 or more")


def domain_of(source: Column) -> Column:
    """The domain of a source: sources named src<number> are dealt to four domains by number, others are `other`."""
    number = F.regexp_extract(source, "^src([0-9]{1,9})$", 1)
    return F.when(number != "", F.concat(F.lit("domain"), (number.cast("int") % 4).cast("string"))).otherwise(F.lit("other"))


def _weight(names: Column, weights: dict[str, int], default: int) -> Column:
    out = None
    for name, w in weights.items():
        out = F.when(names == name, w) if out is None else out.when(names == name, w)
    return (F.lit(default) if out is None else out.otherwise(default)).cast("long")


def divide(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Adds `part`, each child's part of its parent's `budget`: children have `weight` and `capacity`, both 0 or neither."""
    family = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    order = family.orderBy(F.when(F.col("weight") > 0, F.col("capacity") / F.col("weight")).otherwise(0.0), name)
    before = F.coalesce(F.sum("capacity").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_weight = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = F.when(F.col("open_weight") > 0, (F.col("budget") - F.col("before")) / F.col("open_weight")).otherwise(0.0)
    settled = nodes.withColumn("before", before).withColumn("open_weight", open_weight).withColumn("level", level).withColumn("full", F.col("capacity") <= F.col("level") * F.col("weight")).withColumn("place", F.row_number().over(order))
    shared = F.min(F.when(~F.col("full"), F.struct("place", "level"))).over(family)["level"]
    return settled.withColumn("shared", shared).withColumn("part", F.when(F.col("full"), F.col("capacity").cast("double")).otherwise(F.col("shared") * F.col("weight"))).drop("before", "open_weight", "level", "full", "place", "shared")


def budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """Adds `allowed`, the token budget of each leaf (m_domain, m_lang, m_source, tokens)."""
    weigh = lambda nodes, name, weights: nodes.withColumn("weight", _weight(F.col(name), weights, mix.default)).withColumn("capacity", F.when(F.col("weight") > 0, F.col("capacity")).otherwise(F.lit(0)))
    low = weigh(leaves.withColumn("capacity", F.col("tokens") * mix.max_epochs), "m_source", mix.sources)
    middle = weigh(low.groupBy("m_domain", "m_lang").agg(F.sum("capacity").alias("capacity")), "m_lang", mix.languages)
    top = weigh(middle.groupBy("m_domain").agg(F.sum("capacity").alias("capacity")), "m_domain", mix.domains)
    # A node without capacity has no weight either, and leaves below it none that counts.
    live = lambda nodes: nodes.withColumn("weight", F.when(F.col("capacity") > 0, F.col("weight")).otherwise(F.lit(0)))
    total = leaves.agg(F.floor(F.coalesce(F.sum("tokens"), F.lit(0)) * mix.share).cast("double").alias("budget"))
    top = divide(live(top).crossJoin(F.broadcast(total)), [], "m_domain")  # one row is joined to all
    middle = divide(live(middle).join(top.select("m_domain", F.col("part").alias("budget")), "m_domain"), ["m_domain"], "m_lang")
    low = divide(live(low).join(middle.select("m_domain", "m_lang", F.col("part").alias("budget")), ["m_domain", "m_lang"]), ["m_domain", "m_lang"], "m_source")
    return low.select(*LEAF, "tokens", F.floor("part").cast("long").alias("allowed"))


def _order_key(mix: Mix, epoch: Column, id_: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{mix.seed}:"), epoch.cast("string"), F.lit(":"), F.coalesce(id_.cast("string"), F.lit(""))).cast("binary"))


def _join_leaves(rows: DataFrame, leaves: DataFrame, n_leaves: int) -> DataFrame:
    return rows.join(F.broadcast(leaves) if n_leaves <= BROADCAST_LEAVES else leaves.hint("merge"), LEAF)


def mix(df: DataFrame, plan: Mix | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """For every row of df: m_row (all its columns), m_id, m_domain, m_lang, m_source, m_tokens and m_copies, how often it is taken (0 too)."""
    plan = plan or Mix()
    name = lambda c: F.coalesce(col(c).cast("string"), F.lit(""))
    tokens = (F.floor(F.octet_length(F.coalesce(col(text_col), F.lit(""))) / 4) + 1).cast("long")
    keyed = df.select(packed(df, "m_row"), col(id_col).alias("m_id"), domain_of(name(source_col)).alias("m_domain"), name(lang_col).alias("m_lang"), name(source_col).alias("m_source"), tokens.alias("m_tokens"))
    slim = checkpointed(keyed.select(*LEAF, "m_id", "m_tokens"))
    leaves = checkpointed(budgets(slim.groupBy(*LEAF).agg(F.sum("m_tokens").alias("tokens")), plan))
    n_leaves = leaves.count()
    wholes = F.least(F.floor(F.col("allowed") / F.col("tokens")), F.lit(plan.max_epochs)).cast("long")
    leaves = leaves.withColumn("wholes", wholes).withColumn("rest", F.when(F.col("wholes") < plan.max_epochs, F.col("allowed") - F.col("wholes") * F.col("tokens")).otherwise(F.lit(0)))
    ordered = _join_leaves(slim, leaves.filter("rest > 0").select(*LEAF, "wholes", "rest"), n_leaves).withColumn("key", _order_key(plan, F.col("wholes"), F.col("m_id"))).withColumn("bucket", F.substring("key", 1, 4))
    sums = ordered.groupBy(*LEAF, "rest", "bucket").agg(F.sum("m_tokens").alias("held"))
    running = F.sum("held").over(Window.partitionBy(*LEAF).orderBy("bucket"))
    # Only the bucket in which the remainder runs out needs its rows in order; buckets before it are whole.
    edges = sums.withColumn("upto", running).withColumn("before", F.col("upto") - F.col("held")).filter("before <= rest")
    last_whole = edges.filter("upto <= rest").groupBy(*LEAF).agg(F.max("bucket").alias("whole_bucket"))
    split = checkpointed(edges.filter("upto > rest").select(*LEAF, "bucket", "before"))  # at most one row for each leaf
    within = F.sum("m_tokens").over(Window.partitionBy(*LEAF).orderBy("key"))  # ties share a frame
    few = ordered.join(F.broadcast(split) if n_leaves <= BROADCAST_LEAVES else split.hint("merge"), [*LEAF, "bucket"])
    cut = few.withColumn("upto", F.col("before") + within).filter("upto <= rest").groupBy(*LEAF).agg(F.max("key").alias("last_key"))
    decided = leaves.join(last_whole, LEAF, "left").join(cut, LEAF, "left").select(*LEAF, "wholes", "whole_bucket", "last_key")
    taken = _join_leaves(keyed, checkpointed(decided), n_leaves)
    key = _order_key(plan, F.col("wholes"), F.col("m_id"))
    more = F.coalesce(F.substring(key, 1, 4) <= F.col("whole_bucket"), F.lit(False)) | F.coalesce(key <= F.col("last_key"), F.lit(False))
    return taken.withColumn("m_copies", (F.col("wholes") + more.cast("long")).cast("int")).drop("wholes", "whole_bucket", "last_key")


def take_mix(df: DataFrame, plan: Mix, **columns: str) -> DataFrame:
    """df's rows, its own columns, each as often as it is taken."""
    mixed = mix(df, plan, **columns).filter("m_copies > 0").withColumn("m_copy", F.explode(F.sequence(F.lit(1), "m_copies")))
    return mixed.select(*unpacked("m_row", df.columns))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    mixed = mix(docs)
    return mixed.select("m_row.c0", "m_row.c1", "m_row.c2", "m_domain", "m_tokens", "m_copies").toDF("doc_id", "lang", "source", "domain", "tokens", "copies")


def _level_sql(source: str, parent: str, name: str, out: str) -> str:
    family = f"PARTITION BY {parent}" if parent else ""
    order = f"{family} ORDER BY capacity / weight, {name}"
    return f"""
{out}_a AS (SELECT *, (budget - coalesce(sum(capacity) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT) / (sum(weight) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT) AS level, row_number() OVER ({order}) AS place FROM {source}),
{out}_b AS (SELECT *, capacity <= level * weight AS "full" FROM {out}_a),
{out} AS (SELECT *, CASE WHEN "full" THEN capacity::DOUBLE ELSE (min(CASE WHEN NOT "full" THEN {{'place': place, 'level': level}} END) OVER ({family})).level * weight END AS part FROM {out}_b)"""


OP6_SQL = f"""
WITH d AS (SELECT doc_id, lang, source, CASE WHEN regexp_matches(source, '^src[0-9]{{1,9}}$') THEN 'domain' || (substr(source, 4)::INT % 4) ELSE 'other' END AS domain, strlen(coalesce(text, '')) // 4 + 1 AS tokens FROM documents),
leaves AS (SELECT domain, lang, source, sum(tokens)::BIGINT AS tokens FROM d GROUP BY ALL),
top AS (SELECT domain, (sum(tokens) * 4)::BIGINT AS capacity, (SELECT floor(sum(tokens)::DOUBLE * 0.6::DOUBLE) FROM leaves) AS budget, CASE domain WHEN 'domain0' THEN 40 WHEN 'domain1' THEN 30 WHEN 'domain2' THEN 20 WHEN 'domain3' THEN 10 ELSE 5 END AS weight FROM leaves GROUP BY domain),
{_level_sql("top", "", "domain", "top_parts")},
middle AS (SELECT l.domain, l.lang, (sum(l.tokens) * 4)::BIGINT AS capacity, any_value(t.part) AS budget, CASE l.lang WHEN 'en' THEN 50 WHEN 'de' THEN 20 WHEN 'fr' THEN 20 WHEN 'es' THEN 10 ELSE 5 END AS weight FROM leaves l JOIN top_parts t USING (domain) GROUP BY l.domain, l.lang),
{_level_sql("middle", "domain", "lang", "middle_parts")},
low AS (SELECT l.domain, l.lang, l.source, l.tokens, l.tokens * 4 AS capacity, m.part AS budget, 5 AS weight FROM leaves l JOIN middle_parts m USING (domain, lang)),
{_level_sql("low", "domain, lang", "source", "low_parts")},
wholes AS (SELECT domain, lang, source, tokens AS leaf_tokens, floor(part)::BIGINT AS allowed, least(floor(part)::BIGINT // tokens, 4) AS whole FROM low_parts),
keyed AS (SELECT d.*, w.whole, CASE WHEN whole < 4 THEN allowed - whole * leaf_tokens ELSE 0 END AS rest, md5('17:' || whole || ':' || doc_id) AS key FROM d JOIN wholes w USING (domain, lang, source))
SELECT doc_id, domain, lang, source, tokens, (whole + (sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY key) <= rest)::INT)::INT AS copies FROM keyed
"""
