"""Splits that keep related records together (problem 1).

Records are bound when they share a key and bonds carry over.  Components of the key graph are found by hash-to-min:
every node keeps a cluster of nodes, sends the cluster to its smallest member and that member to all others, until
nothing changes.  The number of rounds grows with the logarithm of the longest chain.  Only distinct links between keys
enter the graph, so a key shared by a third of all records is one node.

Weighted rendezvous hashing then gives each unit a split.  The split depends on the unit's key and the proportions alone:
a unit that grows, or any other that comes or goes, moves nothing.  The shares of records that come out are near the
proportions as far as the largest units allow; ``split_shares`` reports them.

Defined results: null, blank and invisible keys bind nothing; a record without any key is its own unit
``qid:<record id>``; repeated rows count once; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexispark.cluster import checkpointed, salted_lookup
from lexispark.llm.charforms import skeleton

MAX_ROUNDS = 100

_BLANKS = re.compile(r"\s+")


def clean_key(key: str | None) -> str | None:
    """One spelling of a key: look-alike characters made one, no blanks or invisible characters, lower case."""
    if key is None:
        return None
    return _BLANKS.sub("", skeleton(key)).lower() or None


@F.pandas_udf(T.StringType())
def clean_key_udf(keys: pd.Series) -> pd.Series:
    return keys.map(clean_key, na_action="ignore")


def hash_to_min(links: DataFrame, left: str, right: str) -> DataFrame:
    """Connected components of the graph with edges ``left`` - ``right``.

    Gives ``node`` and ``root``, the smallest node of its component, for every node of a link.
    """
    a, b = F.col(left).alias("node"), F.col(right).alias("member")
    ends = links.select(left, right).dropna().distinct()
    clusters = checkpointed(
        ends.select(a, b)
        .union(ends.select(b.alias("node"), a.alias("member")))
        .union(ends.select(a, a.alias("member")))
        .union(ends.select(b.alias("node"), b.alias("member")))
        .distinct()
    )
    before = None
    for _ in range(MAX_ROUNDS):
        state = clusters.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("node", "member").cast("decimal(38,0)")).alias("h")
        ).first()
        if state == before or not state["n"]:
            return clusters.groupBy("node").agg(F.min("member").alias("root"))
        before = state
        smallest = clusters.groupBy("node").agg(F.min("member").alias("low"))
        sent = salted_lookup(clusters, smallest, ["node"], ["member"], salts=8)
        clusters = checkpointed(
            sent.select(F.col("low").alias("node"), "member")
            .union(sent.select(F.col("member").alias("node"), F.col("low").alias("member")))
            .distinct()
        )
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")


def bound_units(records: DataFrame, record_id: str, bonds: DataFrame, key: str) -> DataFrame:
    """``record_id`` and ``unit_key`` for every distinct record of ``records``.

    ``bonds`` has ``record_id`` and ``key``, any number of rows a record; keys are cleaned here.
    """
    ids = records.select(F.col(record_id).alias("_id")).where("_id is not null").distinct()
    owned = checkpointed(
        bonds.select(F.col(record_id).alias("_id"), clean_key_udf(key).alias("_key")).where("_id is not null and _key is not null").distinct()
    )
    first = owned.groupBy("_id").agg(F.min("_key").alias("_first"), F.count("*").alias("_n"))
    links = owned.join(first.where("_n > 1"), "_id").where("_key <> _first").select("_first", "_key").distinct()
    roots = checkpointed(hash_to_min(links, "_first", "_key").where("node <> root").withColumnRenamed("node", "_first"))
    placed = salted_lookup(first.select("_id", "_first"), roots, ["_first"], ["_id"], "left")
    return ids.join(placed, "_id", "left").select(
        F.col("_id").alias(record_id),
        F.coalesce("root", "_first", F.concat(F.lit("qid:"), F.col("_id").cast("string"))).alias("unit_key"),
    )


def _unit_hash(*parts) -> F.Column:
    """A number in (0, 1) from the first 52 bits of an MD5."""
    digest = F.md5(F.concat_ws("|", *parts))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def assign_splits(units: DataFrame, unit: str, proportions: Mapping[str, float]) -> DataFrame:
    """Add ``split``: all rows of one ``unit`` get the same one, in about the given proportions of units."""
    # rendezvous: the split with the smallest -ln(u) / weight wins
    bids = [
        F.struct((-F.log(_unit_hash(F.col(unit), F.lit(s))) / F.lit(float(w))).alias("bid"), F.lit(s).alias("split"))
        for s, w in proportions.items()
        if w > 0
    ]
    if not bids:
        raise ValueError("no split has a positive proportion")
    return units.withColumn("split", (bids[0] if len(bids) == 1 else F.least(*bids))["split"])


def split_shares(rows: DataFrame, unit: str) -> DataFrame:
    """Per split: records, units, the share of all records and the records of the largest unit."""
    sizes = rows.groupBy("split", unit).agg(F.count("*").alias("n"))
    sums = sizes.groupBy("split").agg(F.sum("n").alias("questions"), F.count("*").alias("units"), F.max("n").alias("largest_unit"))
    total = sums.agg(F.sum("questions").alias("total"))
    return sums.join(F.broadcast(total)).select(  # one row
        "split", "questions", "units", F.round(F.col("questions") / F.col("total"), 6).alias("share"), "largest_unit"
    )
