"""Abusive, hateful or sexual content (problem 9).

A text is brought to a plain form that undoes disguises (look-alike characters, digits and signs for letters, letters
set apart, stretched letters, words broken at a line's end), then cut into segments of a few words.  A segment is the
average of the embeddings of its words and character n-grams, followed by a linear softmax over the classes; embeddings
and softmax are trained jointly in numpy, so unseen spellings share the vectors of their n-grams.  A text scores as its
worst segment.

Labels are given to whole texts and some are wrong, so training goes in rounds: at first all segments of a text carry
its label, then only those that a model trained on other texts finds, and texts not labelled clean in which it finds none
drop out.  The segments of texts labelled clean stay clean however much they look like others, since talk about offences
is told from offences by them.  What more texts labelled clean than others have is not what a label is for and counts in
no text that is not labelled clean.

The classifier is fitted on a bounded sample of labelled texts (``MAX_DOCS``, ``MAX_SEGMENTS``, ``SEGMENTS_A_DOC``,
``DIRTY_SEGMENTS``, taken by hash of the id, each text with all or none of the segments that count; how many texts have a
segment is asked of ``EVIDENCE_DOCS`` texts a side); every text of the corpus is scored whole.

Defined results: null and empty texts score 0; texts labelled twice with different labels start as their share of each
and are on the side not labelled clean, unless most votes are clean;
null labels are ignored; without any positive label every text scores 0.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.cluster import checkpointed
from lexispark.llm.charforms import lower_tr, skeleton

CLASSES = ("clean", "abusive", "hateful", "sexual")
#: Bounds of the training sample of labelled texts: texts a side (labelled clean, labelled otherwise) and segments in all.
MAX_DOCS = 4000
MAX_SEGMENTS = 50_000
#: Labelled texts a side that are asked which segments they have.
EVIDENCE_DOCS = 50_000
#: A feature is known, for training and scoring, if it stands in at least so many training texts.
MIN_TEXTS = 2
#: Segments that one training text gives, evenly over it, so a long text may enter without the one its label is for.
SEGMENTS_A_DOC = 40
#: Segments of all texts that are not labelled clean by most votes: with 12 a text some 1,000 of ``MAX_DOCS`` texts fill it.
DIRTY_SEGMENTS = 12_000
#: Hash values of features; a table of as many small numbers says which of them are known.
BUCKETS = 1 << 22
WIDTH = 10
#: Features that say nothing and are counted into every average, so that one feature alone does not decide.
SHRINK = 4
WINDOW, STRIDE = 8, 4
#: Features that stand in a larger share of the training texts than this tell nothing and are left out.
COMMON = 0.4
THRESHOLD = 0.5

# Signs and digits that stand for letters, and letters whose marks are ignored here.
_LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "i", "€": "e"})
_FOLD = str.maketrans("çğıöşüâîûêôäëïñéèáàíóú", "cgiosuaiueoaeineeaaiou")
_TAG = re.compile(r"<[/!]?[A-Za-z][^<>]*>")
_BROKEN = re.compile("[-\u2010\u00ad][^\\S\n]*\n\\s*(?=[^\\W\\d_])")
_LEET_SIGN = re.compile(r"[0-9@$!|€]")
_MIXED = re.compile(r"(?<![0-9@$!|€])[0-9@$!|€]*[a-z][\w@$!|€]*[\w@$|€]")
_APART = re.compile(r"(?<![a-z])[a-z](?:[.\-_*·/]{1,2}[a-z]){2,}(?![a-z])")
_STRETCHED = re.compile(r"([a-z])\1{2,}")
_MASK = re.compile(r"(?<=[a-z])[*#._](?=[a-z])")
_END = re.compile(r"[.!?…]+[\"'”’»)\]]*$")
_TOKEN = re.compile(r"[a-z]+")


def plain_token(token: str) -> tuple[str, ...]:
    """The words of a run of non-blank characters in plain form (lower case Latin letters, no marks, disguises undone);
    a closing ``"."`` says that a sentence ends."""
    text = lower_tr(skeleton(token)).translate(_FOLD)
    end = (".",) if _END.search(text) else ()
    if not text.isalpha():
        if _LEET_SIGN.search(text):
            text = _MIXED.sub(lambda m: m[0].translate(_LEET), text)
        if _APART.search(text):
            text = _APART.sub(lambda m: re.sub(r"[^a-z]", "", m[0]), text)
        text = _MASK.sub("", text)
    text = _STRETCHED.sub(r"\1", text)
    return (*_TOKEN.findall(text), *end)


class _Plain(dict):
    """Cache of ``plain_token`` for tokens of up to 1,000 characters; emptied when it holds ``most``, so that it stays bounded
    on any corpus."""

    def __init__(self, most: int = 300_000):
        super().__init__()
        self.most = most

    def __missing__(self, token: str) -> tuple[str, ...]:
        out = plain_token(token)
        if len(token) <= 1000:
            if len(self) >= self.most:
                self.clear()
            self[token] = out
        return out


_plain = _Plain()


def sentences(text: str | None) -> list[list[str]]:
    """The words of every sentence in plain form; letters that stand alone in a row are one word."""
    if not text:
        return []
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "\n" in text:
        text = _BROKEN.sub("", text)
    out, now, single = [], [], 0
    for token in text.split():
        for word in _plain[token]:
            if word == ".":
                if single > 2:
                    now[-single:] = ["".join(now[-single:])]
                single = 0
                if now:
                    out.append(now)
                    now = []
            else:
                if len(word) == 1:
                    single += 1
                else:
                    if single > 2:
                        now[-single:] = ["".join(now[-single:])]
                    single = 0
                now.append(word)
    if single > 2:
        now[-single:] = ["".join(now[-single:])]
    if now:
        out.append(now)
    return out


def windows(words: int) -> range:
    """Where the segments of a sentence begin: every ``STRIDE`` words, each at most ``WINDOW`` words long."""
    return range(0, max(words - STRIDE, 1), STRIDE)


def segments(text: str | None) -> list[str]:
    """Runs of at most ``WINDOW`` words within a sentence, overlapping by half."""
    return [f" {' '.join(s[at : at + WINDOW])} " for s in sentences(text) for at in windows(len(s))]


_P = np.uint64(0x100000001B3)


def _bucket_of(h: np.ndarray) -> np.ndarray:
    return ((h ^ (h >> np.uint64(29))) % np.uint64(BUCKETS)).astype(np.int32)


def _pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return (first * np.uint64(0x9E3779B97F4A7C15) ^ second) * _P


def _features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the character n-grams and the whole of each word (given with a blank on both sides), the word that each
    belongs to, in order of words, and the words' own hashes."""
    codes = np.frombuffer("\n".join(words).encode("ascii"), np.uint8).astype(np.uint64)
    word = np.cumsum(codes == 10)
    space = (codes == 32) | (codes == 10)
    # before[i]: number of separators before i; an n-gram may touch one only at its ends
    before = np.concatenate([[0], np.cumsum(space)])
    got_h, got_w = [], []
    for n in (3, 4, 5):
        m = len(codes) - n + 1
        if m <= 0:
            continue
        h = np.full(m, 1469598103934665603 + n, np.uint64)
        for k in range(n):
            h = (h ^ codes[k : k + m]) * _P
        ok = (before[n - 1 : n - 1 + m] - before[1 : 1 + m]) == 0
        ok &= word[:m] == word[n - 1 :]
        got_h.append(h[ok])
        got_w.append(word[:m][ok])
    whole = np.zeros(len(words), np.uint64)
    starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    ends = np.flatnonzero(~space & np.concatenate([space[1:], [True]]))
    if len(starts):
        power = np.cumprod(np.full(len(codes) + 1, _P))
        sums = np.concatenate([[np.uint64(0)], np.cumsum(codes * power[:-1])])
        inverse = np.uint64(pow(int(_P), -1, 1 << 64))
        back = np.cumprod(np.full(len(codes) + 1, inverse))
        whole[word[starts]] = (sums[ends + 1] - sums[starts]) * back[starts]
        got_h.append((whole ^ np.uint64(0x5BD1E995)) * _P)
        got_w.append(np.arange(len(words)))
    h, w = np.concatenate(got_h or [[]]).astype(np.uint64), np.concatenate(got_w or [[]]).astype(np.int64)
    order = np.argsort(w, kind="stable")
    return _bucket_of(h)[order], w[order], whole


class _Batch:
    """The places of some segments' features, worked out once and gone through in every epoch.

    Words stand between segments and features: a word's vector is summed from its n-grams once, however often the word
    stands in the batch.  ``rows`` are the segments; of each array the starts of the groups to sum are kept.
    """

    def __init__(self, rows, words, word_at, pairs, pair_at, feats, feat_at):
        self.rows = rows
        tokens, sizes = _gathered(words, word_at, rows)
        own, token_word = np.unique(tokens, return_inverse=True)
        self.word_feats, many = _gathered(feats, feat_at, own)
        self.word_start = _starts(many)
        self.some_words = np.flatnonzero(many)
        self.token_word, self.token_start, self.some_tokens = token_word, _starts(sizes), np.flatnonzero(sizes)
        pair_feats, pair_sizes = _gathered(pairs, pair_at, rows)
        self.pair_feats, self.pair_start, self.some_pairs = pair_feats, _starts(pair_sizes), np.flatnonzero(pair_sizes)
        counts = pair_sizes.astype(np.float64)
        counts += np.bincount(np.repeat(np.arange(len(rows)), sizes), many[token_word], len(rows))
        self.share = (1 / (counts + SHRINK))[:, None].astype(np.float32)
        # the way back: tokens by word, then occurrences by feature
        seg = np.repeat(np.arange(len(rows)), sizes)
        order = np.argsort(token_word, kind="stable")
        self.back_seg, self.back_word_start = seg[order], _starts(np.bincount(token_word, minlength=len(own)))
        source = np.concatenate([np.repeat(np.arange(len(own)), many), len(own) + np.repeat(np.arange(len(rows)), pair_sizes)])
        every = np.concatenate([self.word_feats, pair_feats])
        order = np.argsort(every, kind="stable")
        self.which, self.back_start = np.unique(every[order], return_index=True)
        self.back_source = source[order]

    def hidden(self, vectors: np.ndarray) -> np.ndarray:
        words = np.zeros((len(self.word_start), WIDTH), np.float32)
        if len(self.some_words):
            words[self.some_words] = np.add.reduceat(vectors[self.word_feats], self.word_start[self.some_words])
        out = np.zeros((len(self.rows), WIDTH), np.float32)
        if len(self.some_tokens):
            out[self.some_tokens] = np.add.reduceat(words[self.token_word], self.token_start[self.some_tokens])
        if len(self.some_pairs):
            out[self.some_pairs] += np.add.reduceat(vectors[self.pair_feats], self.pair_start[self.some_pairs])
        return out * self.share

    def back(self, d_hidden: np.ndarray) -> np.ndarray:
        """The gradient of each of ``which``."""
        d = d_hidden * self.share
        d_words = np.add.reduceat(d[self.back_seg], self.back_word_start) if len(self.back_seg) else d[:0]
        return np.add.reduceat(np.concatenate([d_words, d])[self.back_source], self.back_start)


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64) if len(sizes) else np.zeros(0, np.int64)


def _gathered(values: np.ndarray, at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of the given rows one after the other, and how many each has."""
    sizes = at[rows + 1] - at[rows]
    return values[np.repeat(at[rows] - _starts(sizes), sizes) + np.arange(sizes.sum())], sizes


class _Model:
    """Subword-bag embeddings averaged into a linear softmax."""

    def __init__(self, features: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.rng = rng
        self.vectors = (rng.random((features, WIDTH), dtype=np.float32) - 0.5) / WIDTH
        self.weights = np.zeros((WIDTH, len(CLASSES)), np.float32)
        self.bias = np.zeros(len(CLASSES), np.float32)

    def fit(self, batches: list[_Batch], target, weight, epochs: int, rate: float = 0.5) -> None:
        """Minibatch AdaGrad on cross-entropy; ``target`` is a distribution for each segment."""
        sq_v, sq_w, sq_b = np.full(len(self.vectors), 0.05, np.float32), np.full_like(self.weights, 1e-2), np.full_like(self.bias, 1e-2)
        live = [b for b in batches if weight[b.rows].any() and len(b.which)]
        # few batches are gone through more often, so that small samples get enough steps
        epochs = math.ceil(epochs * min(max(100 / max(len(live), 1), 1), 10))
        for _ in range(epochs):
            for k in self.rng.permutation(len(live)):
                b = live[k]
                hidden = b.hidden(self.vectors)
                grad = ((_softmax(hidden @ self.weights + self.bias) - target[b.rows]) * weight[b.rows, None]).astype(np.float32)
                dv = b.back(grad @ self.weights.T)
                dw, db = hidden.T @ grad / len(b.rows), grad.mean(0)
                sq_w += dw * dw
                sq_b += db * db
                self.weights -= rate * dw / np.sqrt(sq_w)
                self.bias -= rate * db / np.sqrt(sq_b)
                sq = sq_v[b.which] + (dv * dv).mean(1)
                sq_v[b.which] = sq
                self.vectors[b.which] -= rate * dv / np.sqrt(sq)[:, None]

    def scores(self, batches: list[_Batch], n: int) -> np.ndarray:
        """Share of the classes of each of the ``n`` segments."""
        out = np.zeros((n, len(CLASSES)), np.float32)
        for b in batches:
            out[b.rows] = _softmax(b.hidden(self.vectors) @ self.weights + self.bias)
        return out

    def table(self) -> np.ndarray:
        """Each feature's share of the class scores: embedding times softmax weights, for averaging."""
        return (self.vectors @ self.weights).astype(np.float32)


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


#: Segments of a batch.
BATCH = 192


def _known_features(segs: list[str], owner: np.ndarray, docs: int):
    """Of the segments: buckets of the known features in order, the words of each segment, the known features of each word
    and the known pairs of words of each segment, all as values with offsets."""
    ids: dict[str, int] = {}
    tokens = [[ids.setdefault(w, len(ids)) for w in s.split()] for s in segs]
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    words, word_at = np.fromiter((w for t in tokens for w in t), np.int64, sizes.sum()), np.concatenate([[0], np.cumsum(sizes)])
    feats, of_word, hashes = _features([f" {w} " for w in ids])
    seg = np.repeat(np.arange(len(segs)), sizes)
    inner = seg[1:] == seg[:-1]
    pairs, pair_seg = _bucket_of(_pair_hash(hashes[words[:-1]], hashes[words[1:]]))[inner], seg[:-1][inner]
    # a feature seen in hardly any text says nothing, one seen in most does neither; a word counts once a text
    held = np.unique(words * docs + owner[seg])
    counts = np.bincount(held // docs, minlength=len(ids))  # texts of each word
    most = np.bincount(feats, counts[of_word], BUCKETS)  # no fewer than the feature's texts, exact if one word has it
    maybe = most[feats] >= MIN_TEXTS
    # several words of one text may share a feature, so texts are counted exactly, some words at a time
    texts_with = np.zeros(BUCKETS, np.int64)
    kept, kept_word = feats[maybe], of_word[maybe]
    kept_at = np.searchsorted(kept_word, np.arange(len(ids) + 1))
    by_text = held[np.argsort(held % docs, kind="stable")]
    edges = np.searchsorted(by_text % docs, np.arange(0, docs + 200, 200))
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        got, many = _gathered(kept, kept_at, by_text[low:high] // docs)
        texts_with += np.bincount(np.unique(got.astype(np.int64) * docs + np.repeat(by_text[low:high] % docs, many)) // docs, minlength=BUCKETS)
    texts_with += np.bincount(np.unique(pairs.astype(np.int64) * docs + owner[pair_seg]) // docs, minlength=BUCKETS)
    known = np.flatnonzero((texts_with >= MIN_TEXTS) & (texts_with <= max(COMMON * docs, 20)))
    slot = slots(known)
    in_word, in_pair = slot[feats], slot[pairs]
    feats, of_word = in_word[in_word > 0] - 1, of_word[in_word > 0]
    pairs, pair_seg = in_pair[in_pair > 0] - 1, pair_seg[in_pair > 0]
    feat_at = np.searchsorted(of_word, np.arange(len(ids) + 1))
    return known, (words, word_at, pairs, np.searchsorted(pair_seg, np.arange(len(segs) + 1)), feats, feat_at)


def slots(known: np.ndarray) -> np.ndarray:
    """Bucket -> 1 + its place among the known ones, 0 for all others."""
    slot = np.zeros(BUCKETS, np.int32)
    slot[known] = np.arange(1, len(known) + 1)
    return slot


def train(docs: list[tuple[list[str], np.ndarray]], rounds: int = 3, seed: int = 7):
    """``table``, ``bias`` and the ``known`` buckets of the table's rows, from texts given as segments and a distribution over
    ``CLASSES``."""
    segs = [s for own, _ in docs for s in own]
    owner = np.repeat(np.arange(len(docs)), [len(own) for own, _ in docs])
    if not segs or not any(y[0] < 1 for _, y in docs):
        return np.zeros((0, len(CLASSES)), np.float32), np.array([9.0, 0, 0, 0], np.float32), np.zeros(0, np.int64)
    known, places = _known_features(segs, owner, len(docs))
    # segments are judged by a model that was not trained on their own text, else it would only remember them
    fold, batches = (np.arange(len(docs)) % FOLDS)[owner], []
    for k in range(FOLDS):
        order = np.random.default_rng(seed + k).permutation(np.flatnonzero(fold == k))
        batches.append([_Batch(np.sort(order[at : at + BATCH]), *places) for at in range(0, len(order), BATCH)])
    label = np.array([y for _, y in docs], np.float32)[owner]
    dirty_doc = np.array([y[0] <= 0.5 for _, y in docs])
    dirty = dirty_doc[owner]
    target, weight = label.copy(), np.ones(len(segs), np.float32)
    for turn in range(rounds):
        share = float(weight[target[:, 0] < 0.5].sum() / max(weight.sum(), 1))
        # a handful of segments would hardly move the model, so they weigh like a few hundred
        lift = max((8, 2, 1)[min(turn, 2)], min(300 / max(weight[target[:, 0] < 0.5].sum(), 1), 10))
        balance = np.where(target[:, 0] < 0.5, min(max(0.5 / max(share, 1e-6), 1), lift), CLEAN_WEIGHT if turn else 1).astype(np.float32)
        if turn == rounds - 1:
            model = _Model(len(known), seed + turn)
            model.fit([b for own in batches for b in own], target, weight * balance, EPOCHS[min(turn, 2)])
            return model.table(), model.bias, known
        bad = np.zeros(len(segs), np.float32)
        for k in range(FOLDS):
            model = _Model(len(known), seed + turn)
            model.fit([b for j, own in enumerate(batches) if j != k for b in own], target, weight * balance, EPOCHS[min(turn, 2)])
            bad += np.where(fold == k, 1 - model.scores(batches[k], len(segs))[:, 0], 0)
        # what the segments of clean texts rarely reach
        n_clean = int((~dirty).sum())
        usual = float(np.quantile(bad[~dirty], 1 - max(USUAL, 5 / n_clean))) if n_clean > 5 else 0.5
        line = min(max(usual, LINE[min(turn, 1)]), 0.95)
        found = bad > line
        worst = np.zeros(len(docs))
        np.maximum.at(worst, owner, bad)
        target = np.where((dirty & found)[:, None], label, np.eye(len(CLASSES), dtype=np.float32)[0])
        target[dirty & found, 0] = 0
        target /= np.maximum(target.sum(1, keepdims=True), 1e-6)
        # a dirty text without any such segment is doubtful; a clean one with some is not, it may be a near miss
        doubtful = dirty & ~found & (worst[owner] <= line)
        weight = np.where(doubtful, 0, 1).astype(np.float32)
    raise AssertionError("rounds must be positive")


#: Share of the segments of clean texts that a segment of another text must surpass to count, and the least score for it
#: in the first and the second round.
USUAL, LINE = 0.002, (0.1, 0.2)
#: Weight of clean segments once those of other texts are told apart: texts labelled clean are a smaller part of the sample
#: than of the corpus.
CLEAN_WEIGHT = 2
#: Parts of the sample, by text; the first rounds judge each by a model trained on the others.
FOLDS = 2
#: Times that the sample is gone through in the first, second and later rounds.
EPOCHS = (5, 3, 6)


def _label_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        ids, parts = [], []
        for doc_id, text in zip(batch["doc_id"], batch["_text"], strict=True):
            own = segments(text)
            if len(own) > SEGMENTS_A_DOC:  # evenly over the text
                own = [own[i * len(own) // SEGMENTS_A_DOC] for i in range(SEGMENTS_A_DOC)]
            ids.append(doc_id)
            parts.append("\n".join(own))
        yield pd.DataFrame({"doc_id": ids, "segs": parts})


def _hashes(segs: list[str]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, segs), np.uint64, len(segs))


def _texts_with(asked: np.ndarray):
    """Of each of the ``asked`` hashes (in order), in how many texts of either side it stands."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros((2, len(asked)), np.int64)
        for batch in batches:
            for text, clean in zip(batch["_text"], batch["_clean"], strict=True):
                own = np.unique(_hashes(segments(text)))
                at = np.minimum(np.searchsorted(asked, own), len(asked) - 1)
                counts[int(clean), at[asked[at] == own]] += 1
        at = np.flatnonzero(counts.any(0))
        yield pd.DataFrame({"place": at, "clean": counts[1, at], "other": counts[0, at]})

    return run


def usual_segments(texts: DataFrame, votes: DataFrame, segs: list[str]) -> set[str]:
    """Those of the segments that stand in more texts labelled clean than in others."""
    if not segs:
        return set()
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    sides = [votes.where(side).orderBy(*order).limit(EVIDENCE_DOCS) for side in ("clean > 0.5", "clean <= 0.5")]
    sides = checkpointed(sides[0].union(sides[1]).select("doc_id", (F.col("clean") > 0.5).alias("_clean")))
    hashes = _hashes(segs)
    asked = np.unique(hashes)
    rows = texts.join(F.broadcast(sides), "doc_id").select("_text", "_clean")
    counts = rows.mapInPandas(_texts_with(asked), "place long, clean long, other long")
    usual = counts.groupBy("place").agg(F.sum("clean").alias("clean"), F.sum("other").alias("other")).where("clean > other")
    places = usual.select("place").toPandas()["place"].to_numpy(np.int64)
    return {segs[i] for i in np.flatnonzero(np.isin(hashes, asked[places]))}


def training_texts(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS) -> list[tuple[list[str], np.ndarray]]:
    """The bounded sample of labelled texts, as segments with their distribution over the classes."""
    votes = (
        labels.where(F.col("label").isin(*CLASSES) & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(*[F.avg((F.col("label") == c).cast("double")).alias(c) for c in CLASSES])
    )
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    votes = checkpointed(votes)
    picked = checkpointed(
        votes.where("clean > 0.5").orderBy(*order).limit(max_docs).union(votes.where("clean <= 0.5").orderBy(*order).limit(max_docs))
    )
    texts = docs.select("doc_id", F.col("text").alias("_text")).where("_text is not null and _text <> ''")
    rows = texts.join(F.broadcast(picked.select("doc_id")), "doc_id", "left_semi").mapInPandas(_label_rows, "doc_id long, segs string")
    # another order than the one texts were picked in, so that the room is shared by all of them
    found = rows.join(picked, "doc_id").dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id", F.lit("cut")), "doc_id").toPandas()
    found["dirty"] = found["clean"] <= 0.5
    found["own"] = [segs.split("\n") if segs else [] for segs in found["segs"]]
    usual = usual_segments(texts, votes, sorted({s for own in found["own"][found["dirty"]] for s in own}))
    out, room = [], {True: DIRTY_SEGMENTS, False: MAX_SEGMENTS}
    for row in found.sort_values("dirty", ascending=False, kind="stable").itertuples(index=False):
        own = [s for s in row.own if s not in usual] if row.dirty else row.own
        if own and len(own) <= room[row.dirty]:  # all or none
            room = {side: max(n - len(own), 0) for side, n in room.items()}
            out.append((own, np.array([getattr(row, c) for c in CLASSES], np.float64)))
    return out


_MODELS: dict[tuple, tuple] = {}


def model_of(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS):
    """The trained model; queries over the same tables in one process, with the same sample, train once.

    Tables read from other places are trained on anew even if they hold the same rows, so that a run's time is its own.
    """
    sample = training_texts(docs, labels, max_docs)
    seen = xxhash.xxh3_128()
    for own, share in sample:
        seen.update("\n".join(own).encode() + share.tobytes())
    key = (docs.semanticHash(), labels.semanticHash(), seen.hexdigest())
    if key not in _MODELS:
        _MODELS.clear()  # one model is kept
        _MODELS[key] = train(sample)
    return _MODELS[key]


class _Scorer:
    """Scores texts by words: what a word and its n-grams add to a segment is looked up once and remembered."""

    def __init__(self, table: np.ndarray, bias: np.ndarray, known: np.ndarray, most: int = 200_000):
        self.table, self.bias, self.slot, self.most = np.concatenate([np.zeros((1, len(CLASSES)), np.float32), table]), bias, slots(known), most
        self._forget()

    def _forget(self) -> None:
        self.ids: dict[str, int] = {}
        self.sums, self.counts = np.zeros((0, len(CLASSES))), np.zeros(0)
        self.hashes = np.zeros(0, np.uint64)

    def _learn(self, words: list[str]) -> None:
        feats, of_word, hashes = _features([f" {w} " for w in words])
        place = self.slot[feats]
        sums = np.stack([np.bincount(of_word, self.table[place, c], len(words)) for c in range(len(CLASSES))], axis=1)
        self.sums = np.concatenate([self.sums, sums])
        self.counts = np.concatenate([self.counts, np.bincount(of_word, place > 0, len(words))])
        self.hashes = np.concatenate([self.hashes, hashes])

    def __call__(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """Highest share of the not clean classes over the segments of each text, and the likeliest such class there."""
        score, kind = np.zeros(len(texts)), np.ones(len(texts), np.int64)
        words, start, stop, owner = [], [], [], []
        for i, text in enumerate(texts):
            for sentence in sentences(text) if isinstance(text, str) else ():
                base, n = len(words), len(sentence)
                words.extend(sentence)
                for at in windows(n):
                    start.append(base + at)
                    stop.append(min(base + at + WINDOW, base + n))
                    owner.append(i)
        if not owner:
            return score, kind
        if len(self.ids) > self.most:
            self._forget()
        new = [w for w in dict.fromkeys(words) if w not in self.ids]
        if new:
            self.ids.update(zip(new, range(len(self.ids), len(self.ids) + len(new)), strict=True))
            self._learn(new)
        at = np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words))
        start, stop, owner = np.array(start), np.array(stop), np.array(owner)
        pair = self.slot[_bucket_of(_pair_hash(self.hashes[at[:-1]], self.hashes[at[1:]]))]
        adds = np.concatenate([np.zeros((1, len(CLASSES))), np.cumsum(self.sums[at], axis=0)])
        many = np.concatenate([[0], np.cumsum(self.counts[at])])
        pair_adds = np.concatenate([np.zeros((1, len(CLASSES))), np.cumsum(self.table[pair], axis=0, dtype=np.float64)])
        pair_many = np.concatenate([[0], np.cumsum(pair > 0)])
        z = adds[stop] - adds[start] + pair_adds[stop - 1] - pair_adds[start]
        n = many[stop] - many[start] + pair_many[stop - 1] - pair_many[start]
        p = _softmax(z / (n + SHRINK)[:, None] + self.bias)
        bad = 1 - p[:, 0]
        order = np.argsort(bad, kind="stable")  # the last write is the worst segment's
        score[owner[order]] = bad[order]
        kind[owner[order]] = p[order, 1:].argmax(1) + 1
        return score, kind


def _score_rows(table: np.ndarray, bias: np.ndarray, known: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = _Scorer(table, bias, known)
        for batch in batches:
            score, kind = np.zeros(len(batch)), np.zeros(len(batch), np.int64)
            for low in range(0, len(batch), 2000):
                score[low : low + 2000], kind[low : low + 2000] = scorer(batch["_text"].to_numpy()[low : low + 2000])
            names = np.where(score >= THRESHOLD, np.array(CLASSES)[kind], CLASSES[0])
            yield pd.DataFrame({"doc_id": batch["doc_id"], "source": batch["source"], "score": score, "kind": names})

    return run


def score_documents(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """``doc_id``, ``source``, ``score`` (0 to 1) and ``kind`` of every document; not clean from ``THRESHOLD``."""
    table, bias, known = model_of(docs, labels, max_docs)
    rows = docs.select("doc_id", "source", F.col("text").alias("_text"))
    return rows.mapInPandas(_score_rows(table, bias, known), "doc_id long, source string, score double, kind string")


def rates_by_source(scores: DataFrame) -> DataFrame:
    """Documents, flagged documents and their share per source."""
    flagged = F.sum((F.col("score") >= THRESHOLD).cast("long"))
    return scores.groupBy("source").agg(
        F.count("*").alias("documents"),
        flagged.alias("flagged"),
        (flagged / F.count("*")).alias("rate"),
        F.avg("score").alias("mean_score"),
    )
