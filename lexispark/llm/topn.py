"""Top N items within every group (problem 6).

Every input partition reduces its rows to the N best distinct items of each group it holds; the N-th best is a lower
bound for the group's N-th best overall.  The largest bound of each group is joined back, rows below it are dropped, and
only survivors (about N a group and partition) are shuffled and ranked.  A bound is a pair of score and item, so ties at
the bound don't survive either.

Up to ``broadcast_rows`` groups the bounds meet the rows in the scan.  Beyond, the same pass has counted the rows of each
group, and the bounds meet the rows in a join in which a group has as many salts as its rows need, so that neither
millions of groups nor one with a third of all rows make a large task.

Defined results: null and NaN scores, null groups and null items don't count; an item counts once a group with its best
score; equal scores go by item in code-point order; groups with fewer items give fewer rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexispark.cluster import BROADCAST_ROWS, checkpointed, spread_lookup

#: Rows that a partition gathers before it reduces them to the best N of each group.
BUFFER = 400_000


def _best(table: pa.Table, n: int) -> pa.Table:
    """The n best distinct items of each group, ordered, with their place in the group."""
    table = table.group_by(["grp", "item"]).aggregate([("score", "max")]).rename_columns(["grp", "item", "score"])
    order = pc.sort_indices(table, sort_keys=[("grp", "ascending"), ("score", "descending"), ("item", "ascending")])
    table = table.take(order).combine_chunks()
    if not len(table):
        return table.append_column("place", pa.array([], pa.int64()))
    codes = table["grp"].dictionary_encode().combine_chunks()
    codes = (codes.chunk(0) if isinstance(codes, pa.ChunkedArray) else codes).indices.to_numpy(zero_copy_only=False)
    new = np.r_[True, codes[1:] != codes[:-1]]
    place = np.arange(len(codes)) - np.maximum.accumulate(np.where(new, np.arange(len(codes)), 0)) + 1
    keep = place <= n
    return table.filter(pa.array(keep)).append_column("place", pa.array(place[keep]))


def _partition_bounds(n: int):
    """Per group of a partition its rows and, if it has as many distinct items, the n-th best of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, counts, held, rows = None, None, [], 0

        def reduce():
            now = pa.Table.from_batches(held)
            own = now.group_by("grp").aggregate([([], "count_all")]).rename_columns(["grp", "rows"])
            if best is None:
                return _best(now, n), own
            both = pa.concat_tables([counts, own]).group_by("grp").aggregate([("rows", "sum")])
            return _best(pa.concat_tables([now, best.drop_columns(["place"])]), n), both.rename_columns(["grp", "rows"])

        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= BUFFER:
                best, counts = reduce()
                held, rows = [], 0
        if held:
            best, counts = reduce()
        if best is not None:
            nth = best.filter(pc.equal(best["place"], n)).select(["grp", "score", "item"])
            out = counts.join(nth, "grp", join_type="left outer").select(["grp", "rows", "score", "item"])
            yield from out.combine_chunks().to_batches()

    return run


def top_n(rows: DataFrame, group: str, item: str, score: str, n: int, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``group``, ``hit_rank`` (1 to n), ``item``, ``score``: the n best items of every group."""
    v = F.col(score).cast("double")
    usable = rows.select(
        F.col(group).cast("string").alias("grp"), F.col(item).cast("string").alias("item"), v.alias("score")
    ).where("grp is not null and item is not null and score is not null and not isnan(score)")
    # smallest first: a higher bound has the smaller (-score, item)
    place = F.struct((-F.col("score")).alias("s"), F.col("item").alias("i"))
    groups = checkpointed(
        usable.mapInArrow(_partition_bounds(n), "grp string, rows long, score double, item string")
        .groupBy("grp")
        .agg(F.sum("rows").alias("n"), F.min(F.when(F.col("item").isNotNull(), place)).alias("bound"))
    )
    bounds = groups.where("bound is not null").select("grp", "bound")
    if bounds.limit(broadcast_rows + 1).count() <= broadcast_rows:
        held = usable.join(F.broadcast(bounds), "grp", "left")
    else:
        held = spread_lookup(usable, bounds, ["grp"], ["item"], groups.select("grp", "n"), "left")
    once = held.where(F.col("bound").isNull() | (place <= F.col("bound"))).groupBy("grp", "item").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("score"), "item"))
    return (
        once.withColumn("hit_rank", rank)
        .where(F.col("hit_rank") <= n)
        .select(F.col("grp").alias(group), "hit_rank", F.col("item").alias(item), F.col("score").alias(score))
    )
