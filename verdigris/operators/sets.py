"""Set operations over append logs and layers: unions, intersections, last-wins and consume-once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_layer_union(rows: DataFrame, key: list[str], layer: str) -> DataFrame:
    """One row a key of all layers together: that of the smallest layer."""
    return rows.groupBy(*key).agg(F.min(layer).alias(layer), F.count(F.lit(1)).alias("layers"))


def in_all(rows: DataFrame, owner: str, item: str, order: str) -> DataFrame:
    """The items that every owner has, numbered as the first owner orders them."""
    pairs = rows.groupBy(owner, item).agg(F.min(order).alias("place"))
    # two numbers: the owners there are, and the first of them
    total = pairs.agg(F.count_distinct(owner).alias("owners"), F.min(owner).alias("leader"))
    shared = pairs.groupBy(item).agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(total), F.col("n") == F.col("owners"))
    lead = shared.join(pairs.select(F.col(item).alias("_item"), F.col(owner).alias("_owner"), "place"), (F.col(item) == F.col("_item")) & (F.col("leader") == F.col("_owner")))
    return lead.select(item, "place")


def last_wins(rows: DataFrame, key: str, seq: str, value: str) -> DataFrame:
    """One row a key with its last ``value``; ``first_seen`` orders keys by their first row. One aggregation, no sort."""
    return rows.groupBy(key).agg(F.max_by(value, seq).alias(value), F.min(seq).alias("first_seen"), F.count(F.lit(1)).alias("rows"))


def distinct_trials(rows: DataFrame, family: str, config: list[str]) -> DataFrame:
    """How many different configurations of each family an append log holds: by hash of the JSON of all their values, so
    that null, an empty text and a separator within a value are told apart."""
    whole = F.to_json(F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(config)]), {"ignoreNullFields": "false"})
    hashed = rows.select(family, F.sha2(whole, 256).alias("hash"))
    return hashed.groupBy(family).agg(F.count_distinct("hash").alias("trials"), F.count(F.lit(1)).alias("runs"))


def consume_once(asked: DataFrame, used: DataFrame, key: list[str], seq: str) -> DataFrame:
    """The rows of ``asked`` whose key is neither in ``used`` nor asked for before; ties go to the smallest ``seq``. A null
    is a value like others: once used it is used."""
    spent = used.select(*[F.col(c).alias(f"_used_{i}") for i, c in enumerate(key)]).distinct()
    fresh = asked.join(spent, [asked[c].eqNullSafe(spent[f"_used_{i}"]) for i, c in enumerate(key)], "left_anti")
    return fresh.withColumn("_turn", F.row_number().over(Window.partitionBy(*key).orderBy(seq))).filter("_turn = 1").drop("_turn")
