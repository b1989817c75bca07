"""Splitting oversized items at natural boundaries (problem 3).

Lexical-cohesion segmentation: the similarity of the blocks of words before and after every possible cut is measured
along the text; valleys of that curve mark topic boundaries.  A piece is cut at the deepest valley within its size
window, among the strongest kind of boundary that the window holds: the beginning of an article, else of a paragraph,
else of a sentence; of one kind those in the window's upper half go before those in the lower.  Where a window holds none of them the cut falls on white space, and only where there is not even
that between two characters.  Consecutive pieces overlap by a fixed number of characters.

Defined results: a null text gives one piece with null text, an empty or small one gives itself; repeated rows give
repeated pieces; ``page_ids`` come out distinct and in page order, null as null.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexispark.llm.charforms import lower_tr, skeleton

LIMIT = 5000
OVERLAP = 200
#: Words in each of the two blocks that are compared at a cut.
BLOCK = 40
ARTICLE, PARAGRAPH, SENTENCE = 3, 2, 1
KIND_NAMES = {3: "article", 2: "paragraph", 1: "sentence", 0: "blank", -1: "hard", 9: "start"}

# Kinds of article and the dashes that may follow its number.
_ARTICLE = re.compile(r"\s*(?:(?:ek|ge[çc][iı]c[iı]|mükerrer)\s+)?madde\s+\d+\s*(?:/\s*[^\W\d_]\s*)?[-–—]")
_PARAGRAPH = re.compile(r"\n\s*(?=\S)")
_SENTENCE = re.compile(r"[.!?…][\"'”’»)\]]*\s+(?=\S)")
_BLANK = re.compile(r"\s+(?=\S)")
_WORD = re.compile(r"[^\W_]+")


def article_starts(text: str) -> list[int]:
    """Offsets of the lines on which an article begins."""
    found, at = [], 0
    for line in text.split("\n"):
        # nothing before the dash is long: kind, word, number and letter, with room for invisible characters
        if _ARTICLE.match(lower_tr(skeleton(line[:400]))) or len(line) > 400 and _ARTICLE.match(lower_tr(skeleton(line))):
            found.append(at)
        at += len(line) + 1
    return found


def boundaries(text: str, starts: list[int]) -> dict[int, int]:
    """Offset -> strongest kind of boundary there."""
    kinds = {m.end(): SENTENCE for m in _SENTENCE.finditer(text)}
    kinds.update((m.end(), PARAGRAPH) for m in _PARAGRAPH.finditer(text))
    kinds.update((s, ARTICLE) for s in starts)
    kinds.pop(0, None)
    return kinds


def valley_depths(text: str, cuts: list[int], block: int = BLOCK) -> dict[int, float]:
    """How deep the similarity of neighbouring blocks dips at each cut (cuts in ascending order)."""
    spans = [(m.start(), lower_tr(m[0])[:5]) for m in _WORD.finditer(text)]
    words = [w for _, w in spans]
    sims, k = [], 0
    for cut in cuts:
        while k < len(spans) and spans[k][0] < cut:
            k += 1
        a, b = Counter(words[max(0, k - block) : k]), Counter(words[k : k + block])
        norm = math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))
        sims.append(sum(v * b[w] for w, v in a.items()) / norm if norm else 0.0)
    # the peaks on both sides are reached by climbing while the curve rises
    rising_left, rising_right = list(sims), list(sims)
    for i in range(1, len(sims)):
        if sims[i - 1] >= sims[i]:
            rising_left[i] = rising_left[i - 1]
    for i in range(len(sims) - 2, -1, -1):
        if sims[i + 1] >= sims[i]:
            rising_right[i] = rising_right[i + 1]
    return {c: rising_left[i] + rising_right[i] - 2 * sims[i] for i, c in enumerate(cuts)}


def cut_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> tuple[list[tuple[int, int, int]], list[int]]:
    """Pieces (start, end, kind of the boundary at which the piece's new text begins) and the article starts."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be smaller than the limit")
    starts = article_starts(text)
    if len(text) <= limit:
        return [(0, len(text), 9)], starts
    kinds = boundaries(text, starts)
    cuts = sorted(kinds)
    depth = valley_depths(text, cuts)
    pieces, begin, kind, lo_i = [], 0, 9, 0
    while len(text) - begin > limit:
        while lo_i < len(cuts) and cuts[lo_i] < begin + overlap + 1:
            lo_i += 1
        window, i = [], lo_i
        while i < len(cuts) and cuts[i] <= begin + limit:
            window.append(cuts[i])
            i += 1
        if window:
            # the window's lower half makes small pieces, so among boundaries of one kind the upper half goes first
            cut = max(window, key=lambda c: (kinds[c], c >= begin + limit // 2, depth[c], c))
            new_kind = kinds[cut]
        else:
            part = list(_BLANK.finditer(text, begin + overlap + 1, begin + limit + 1))
            part = [m.end() for m in part if begin + overlap < m.end() <= begin + limit]
            cut, new_kind = (part[-1], 0) if part else (begin + limit, -1)
        pieces.append((begin, cut, kind))
        begin, kind = cut - overlap, new_kind
    pieces.append((begin, len(text), kind))
    return pieces, starts


def ordered_pages(page_ids) -> list[str] | None:
    """Distinct page ids by document and page number."""
    if page_ids is None:
        return None

    def key(p: str):
        doc, _, no = p.rpartition(":")
        return (doc, 0, int(no), "") if no.isdecimal() else (p, 1, 0, p)

    return sorted({p for p in page_ids if p is not None}, key=key)


def _piece_rows(limit: int, overlap: int, names: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for chunk_id, text, pages in zip(batch["chunk_id"], batch["text"], batch["page_ids"], strict=True):
                pages = ordered_pages(pages)
                if not isinstance(text, str):
                    rows = [(chunk_id, 0, 0, 0, "start", None, pages, [])]
                else:
                    pieces, starts = cut_text(text, limit, overlap)
                    rows = [
                        (chunk_id, n, s, e, KIND_NAMES[k], text[s:e], pages, [x for x in starts if s <= x < e])
                        for n, (s, e, k) in enumerate(pieces)
                    ]
                yield pd.DataFrame(rows, columns=names)

    return run


PIECE_SCHEMA = T.StructType(
    [
        T.StructField("chunk_id", T.StringType()),
        T.StructField("piece_no", T.IntegerType()),
        T.StructField("piece_start", T.IntegerType()),
        T.StructField("piece_end", T.IntegerType()),
        T.StructField("cut_kind", T.StringType()),
        T.StructField("piece_text", T.StringType()),
        T.StructField("page_ids", T.ArrayType(T.StringType())),
        T.StructField("article_starts", T.ArrayType(T.IntegerType())),
    ]
)


def split_oversized(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of at most ``limit`` characters of every chunk; needs ``chunk_id``, ``text``, ``page_ids``.

    ``article_starts`` lists the offsets in the whole text at which articles begin inside the piece.  Small texts, the
    bulk of a corpus, become their one piece without leaving the JVM; ``article_starts`` is null there, as nothing had
    to be cut.
    """
    need = chunks.select("chunk_id", "text", "page_ids")
    big = F.length("text") > limit
    parts = need.where(big).mapInPandas(_piece_rows(limit, overlap, PIECE_SCHEMA.names), PIECE_SCHEMA)
    page_no = lambda p: F.coalesce(F.regexp_extract(p, r":(\d+)$", 1).try_cast("long"), F.lit(-1))
    ordered = F.transform(
        F.array_sort(
            F.transform(
                F.array_distinct(F.filter("page_ids", lambda p: p.isNotNull())),
                lambda p: F.struct(F.regexp_replace(p, r":\d+$", "").alias("d"), page_no(p).alias("n"), p.alias("p")),
            )
        ),
        lambda s: s["p"],
    )
    whole = need.where(~F.coalesce(big, F.lit(False))).select(
        "chunk_id",
        F.lit(0).alias("piece_no"),
        F.lit(0).alias("piece_start"),
        F.coalesce(F.length("text"), F.lit(0)).alias("piece_end"),
        F.lit("start").alias("cut_kind"),
        F.col("text").alias("piece_text"),
        ordered.alias("page_ids"),
        F.lit(None).cast("array<int>").alias("article_starts"),
    )
    return parts.unionByName(whole)
