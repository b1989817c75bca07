"""Filling fixed-capacity containers with items (problem 7).

Texts are measured in tokens of a public tokenizer.  A text over the capacity fills whole containers and leaves a
remainder as an item.  Items are dealt by hash into bins of about 128 containers and each bin is packed by Karmarkar-Karp
multiway differencing: partial partitions with the largest spreads are merged with their imbalances opposed, which gives
near-equal windows; while a window exceeds the capacity the number of windows rises.  Only ids and sizes reach a bin, so
its memory has a bound that doesn't depend on texts or sources.

Defined results: null and empty texts have no tokens and get no container (null); repeated rows are items of their own;
every token of every text lies in exactly one container.
"""

from __future__ import annotations

import base64
import heapq
import math
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.cluster import checkpointed

CAPACITY = 4096
BIN_CONTAINERS = 128
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the splitting pattern that byte-level BPE vocabularies of this kind are made with.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, doc_id: str, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """``doc_id`` and ``n_tokens`` of every row; the texts stay in the scan."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoding(tokenizer).encode_ordinary
        for batch in batches:
            sizes = [len(encode(t)) if isinstance(t, str) else 0 for t in batch["_text"]]
            yield pd.DataFrame({doc_id: batch[doc_id], "n_tokens": sizes})

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, F.col(text).alias("_text")).mapInPandas(run, f"{doc_id} {kind}, n_tokens long")


def difference(sizes: Sequence[int], windows: int) -> list[int]:
    """Karmarkar-Karp multiway differencing: the window of each item, in 0 .. windows - 1."""
    if windows <= 1 or len(sizes) <= windows:
        return [i if windows > 1 else 0 for i in range(len(sizes))]
    # a partial partition: its sums in descending order, short of zeros at the end, and the items behind each sum
    heap = [(-s, i, [s], [[i]]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    stamp = len(sizes)
    while len(heap) > 1:
        _, _, sums_a, items_a = heapq.heappop(heap)
        _, _, sums_b, items_b = heapq.heappop(heap)
        if len(sums_a) + len(sums_b) <= windows:
            sums, items = sums_a + sums_b, items_a + items_b
        else:
            # the largest sums of one meet the smallest of the other
            gap = windows - len(sums_b)
            sums, items = list(sums_a), list(items_a)
            for j in range(len(sums_b)):
                at = windows - 1 - j
                if at < len(sums_a):
                    sums[at] += sums_b[j]
                    small, large = sorted((items[at], items_b[j]), key=len)
                    large.extend(small)
                    items[at] = large
                else:
                    sums.append(sums_b[j])
                    items.append(items_b[j])
            assert gap >= 0
        order = sorted(range(len(sums)), key=lambda k: -sums[k])
        sums, items = [sums[k] for k in order], [items[k] for k in order]
        if len(sums) == windows and sums[-1]:
            low = sums[-1]
            sums = [s - low for s in sums]
        heapq.heappush(heap, (-(sums[0]), stamp, sums, items))
        stamp += 1
    place = [0] * len(sizes)
    for w, members in enumerate(heap[0][3]):
        for i in members:
            place[i] = w
    return place


def pack(sizes: Sequence[int], capacity: int) -> list[int]:
    """The window of each item; no window holds more than ``capacity``, no item may exceed it."""
    if not sizes:
        return []
    windows = max(math.ceil(sum(sizes) / capacity), sum(2 * s > capacity for s in sizes), 1)
    while True:
        place = difference(sizes, windows)
        filled = [0] * windows
        for w, s in zip(place, sizes, strict=True):
            filled[w] += s
        over = sum(max(0, f - capacity) for f in filled)
        if not over:
            return place
        windows += max(1, over // capacity)


def pack_documents(
    docs: DataFrame, doc_id: str, text: str, capacity: int = CAPACITY, tokenizer: str = TOKENIZER
) -> DataFrame:
    """``doc_id``, ``piece_no``, ``token_start``, ``n_tokens``, ``container_id`` of every piece of every text."""
    sizes = checkpointed(token_counts(docs, doc_id, text, tokenizer).withColumn("_row", F.monotonically_increasing_id()))
    total = sizes.agg(F.sum("n_tokens")).first()[0] or 0
    bins = max(1, math.ceil(total / (capacity * BIN_CONTAINERS)))
    last = F.greatest(F.ceil(F.col("n_tokens") / capacity) - 1, F.lit(0)).cast("int")
    pieces = sizes.select(doc_id, "_row", "n_tokens", F.explode(F.sequence(F.lit(0), last)).alias("piece_no")).select(
        doc_id,
        "piece_no",
        (F.col("piece_no").cast("long") * capacity).alias("token_start"),
        F.least(F.col("n_tokens") - F.col("piece_no") * F.lit(capacity).cast("long"), F.lit(capacity)).alias("n_tokens"),
        F.pmod(F.xxhash64("_row", "piece_no"), F.lit(bins)).alias("_bin"),
        "_row",
    )
    full = pieces.where(F.col("n_tokens") == capacity).select(
        doc_id, "piece_no", "token_start", "n_tokens", F.format_string("full-%d-%d", "_row", "piece_no").alias("container_id")
    )
    none = pieces.where("n_tokens = 0").select(
        doc_id, "piece_no", "token_start", "n_tokens", F.lit(None).cast("string").alias("container_id")
    )
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["n_tokens", "_row", "piece_no"], ascending=[False, True, True], ignore_index=True)
        place = pack([int(s) for s in frame["n_tokens"]], capacity)
        label = int(frame["_bin"].iloc[0])
        out = frame[[doc_id, "piece_no", "token_start", "n_tokens"]].copy()
        out["container_id"] = [f"bin-{label}-{w}" for w in place]
        return out

    packed = (
        pieces.where((F.col("n_tokens") > 0) & (F.col("n_tokens") < capacity))
        .groupBy("_bin")
        .applyInPandas(run, f"{doc_id} {kind}, piece_no int, token_start long, n_tokens long, container_id string")
    )
    return packed.unionByName(full).unionByName(none)
