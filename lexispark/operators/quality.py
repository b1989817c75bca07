"""Splits, duplicate questions, reconciliation of keys and violation queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispark.cluster import checkpointed
from lexispark.functions.text import ascii_fold, page_doc, tr_lower
from lexispark.operators import sparse

# Strengths of verification kinds, byte limit and salt of the inner split, near-duplicate similarity.
LEVELS = {"model-cross-check": 1, "human": 2}
INNER_FIT_BELOW, INNER_SALT = 170, "late-calibration-v1"
NEAR_DUPLICATE = 0.8


def verification_level(kind: Column) -> Column:
    """0 for mechanical checks and unknown kinds, 1 for a model's, 2 for a human's; null stays null."""
    level = F.when(kind.isNull(), F.lit(None).cast("int"))
    for name, value in LEVELS.items():
        level = level.when(kind == name, F.lit(value))
    return level.otherwise(F.lit(0))


def hash_half(text: Column) -> Column:
    """``dev`` or ``test`` by the parity of SHA-256."""
    last = F.conv(F.right(F.sha2(text, 256), F.lit(1)), 16, 10).cast("int")
    return F.when(last % 2 == 0, "dev").otherwise("test")


def assign_split(questions: DataFrame, test_docs: DataFrame) -> DataFrame:
    """``question_id``, ``assigned``: by gold document, else by anchor, else by subject, else by hash of the id."""
    gold = F.col("gold_doc_ids")
    first = F.when(F.size(gold) > 0, gold[0])
    about = F.coalesce(first, F.when(F.col("unanswerable_reason") == "eksik-kanit", F.col("subject_doc")))
    known = test_docs.select(F.col("doc_id").alias("_doc"), F.lit(True).alias("_test")).distinct()
    by_doc = F.when(F.col("_test"), "test").otherwise("dev")
    anchored = (F.col("unanswerable_reason") == "korpus-disi") & F.col("anchor_law").isNotNull()
    return (
        questions.withColumn("_doc", about).join(known, "_doc", "left")
        .select(
            "question_id",
            F.when(first.isNotNull(), by_doc)
            .when(anchored, hash_half(F.concat(F.lit("anchor:"), "anchor_law")))
            .when(F.col("_doc").isNotNull(), by_doc)
            .otherwise(hash_half(F.concat(F.lit("qid:"), "question_id")))
            .alias("assigned"),
        )
        .distinct()
    )


def question_group_key() -> Column:
    """What a question belongs to: its first gold document, else its anchor law if it is outside the corpus, else its
    subject document if evidence is lacking, else itself."""
    reason = F.col("unanswerable_reason")
    return (
        F.when(F.size("gold_doc_ids") > 0, F.concat(F.lit("doc:"), F.get("gold_doc_ids", F.lit(0))))
        .when((reason == "korpus-disi") & (F.coalesce("anchor_law", F.lit("")) != ""), F.concat(F.lit("anchor:"), "anchor_law"))
        .when((reason == "eksik-kanit") & (F.coalesce("subject_doc", F.lit("")) != ""), F.concat(F.lit("doc:"), "subject_doc"))
        .otherwise(F.concat(F.lit("qid:"), "question_id"))
    )


def question_split(questions: DataFrame, test_docs: DataFrame) -> DataFrame:
    """``question_id``, ``assigned``: test if the first gold document is a test document, dev if it is another; without one
    the parity of SHA-256 of the id decides."""
    first = F.get("gold_doc_ids", F.lit(0))
    known = test_docs.select(F.col("doc_id").alias("_doc"), F.lit(True).alias("_test")).distinct()
    rows = questions.select("question_id", first.alias("_doc")).join(known, "_doc", "left")
    side = F.when(F.col("_doc").isNull(), hash_half(F.col("question_id"))).when(F.col("_test"), "test").otherwise("dev")
    return rows.select("question_id", side.alias("assigned")).distinct()


def derive_test_docs(docs: DataFrame, seed: str, pinned: list[str], blocked: list[str], size: int, scarce: str = "rg_tarihi", least: int = 2) -> DataFrame:
    """``doc_id``: the pinned documents, filled up to ``size`` in the order of SHA-256 of seed and id.

    At least ``least`` of type ``scarce`` are taken, the rest from the other types; blocked documents only if pinned.
    ``docs`` has ``doc_id``, ``doc_type``; a handful of ids is pinned or blocked, the documents themselves stay distributed.
    """
    rows = docs.where("doc_id is not null").groupBy("doc_id").agg(F.min("doc_type").alias("doc_type"))
    own = rows.where(F.col("doc_id").isin(pinned)) if pinned else rows.limit(0)
    n_pinned, n_scarce = (own.agg(F.count("*"), F.count_if(F.col("doc_type") == scarce)).first()) if pinned else (0, 0)
    free = rows.where(~F.col("doc_id").isin([*pinned, *blocked])) if pinned or blocked else rows
    order = [F.sha2(F.concat(F.lit(f"{seed}|"), "doc_id"), 256), F.col("doc_id")]
    of_scarce = max(least - n_scarce, 0)
    others = max(size - n_pinned - of_scarce, 0)
    kind = F.col("doc_type").eqNullSafe(scarce)
    parts = [own.select("doc_id"), free.where(kind).orderBy(*order).limit(of_scarce).select("doc_id"), free.where(~kind).orderBy(*order).limit(others).select("doc_id")]
    return union_violations(parts)


def inner_split(group_key: Column, salt: str = INNER_SALT) -> Column:
    """``fit`` or ``calibration`` by the first byte of SHA-256 of salt and group."""
    byte = F.conv(F.left(F.sha2(F.concat(F.lit(f"{salt}:"), group_key), 256), F.lit(2)), 16, 10).cast("int")
    return F.when(group_key.isNull(), F.lit(None).cast("string")).when(byte < INNER_FIT_BELOW, "fit").otherwise("calibration")


def fold_tokens(text: Column) -> Column:
    """Distinct tokens of letters and digits after lower case and folding."""
    folded = ascii_fold(tr_lower(F.coalesce(text, F.lit(""))))
    return F.filter(F.array_distinct(F.split(folded, "[^0-9a-z]+")), lambda w: w != "")


def near_duplicates(texts: DataFrame, text_id: str, text: str, threshold: float = NEAR_DUPLICATE) -> DataFrame:
    """Links between distinct token sets at or above a Jaccard similarity, as ``id_a`` < ``id_b`` and ``similarity``.

    Texts with equal token sets are one class, represented by its smallest id.  Candidates share one of the rarest tokens
    of either set (prefix filtering), which loses no pair.
    """
    sets = texts.select(F.col(text_id).alias("id"), F.array_sort(fold_tokens(F.col(text))).alias("tokens")).where(F.size("tokens") > 0)
    classes = sets.groupBy("tokens").agg(F.min("id").alias("id"))
    words = classes.select("id", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    common = words.groupBy("token").agg(F.count("*").alias("df"))
    ranked = words.join(common, "token").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("r"))
    keep = F.col("n") - F.ceil(F.col("n") * threshold - 1e-9).cast("int") + 1
    prefix = ranked.select("id", "n", F.explode(F.slice("r", 1, keep)).alias("e")).select("id", "n", "e.token")
    other = prefix.select(F.col("id").alias("id_b"), F.col("n").alias("n_b"), "token")
    pairs = (
        prefix.select(F.col("id").alias("id_a"), F.col("n").alias("n_a"), "token").join(other, "token")
        .where(F.expr(f"id_a < id_b and n_a >= {threshold} * n_b - 1e-9 and n_b >= {threshold} * n_a - 1e-9"))
        .select("id_a", "id_b").distinct()
    )
    left = classes.select(F.col("id").alias("id_a"), F.col("tokens").alias("t_a"))
    right = classes.select(F.col("id").alias("id_b"), F.col("tokens").alias("t_b"))
    shared = F.size(F.array_intersect("t_a", "t_b"))
    return (
        pairs.join(left, "id_a").join(right, "id_b")
        .withColumn("similarity", shared / (F.size("t_a") + F.size("t_b") - shared))
        .where(F.col("similarity") >= threshold - 1e-12)
        .select("id_a", "id_b", "similarity")
    )


def near_reference(texts: DataFrame, reference: DataFrame, text_id: str, text: str, threshold: float = NEAR_DUPLICATE) -> DataFrame:
    """``id_a`` of ``texts``, ``id_b`` of ``reference``, ``similarity``: links between the classes of equal token sets of
    either side at or above a similarity, equal sets included; a class is represented by its smallest id on its side."""
    def classes(df: DataFrame) -> DataFrame:
        sets = df.select(F.col(text_id).cast("string").alias("id"), F.array_sort(fold_tokens(F.col(text))).alias("tokens"))
        return checkpointed(sets.where(F.size("tokens") > 0).groupBy("tokens").agg(F.min("id").alias("id")).where("id is not null"))

    return sparse.similar_sets(classes(texts), classes(reference), threshold)


def closest_names(names: DataFrame, corpus: DataFrame) -> DataFrame:
    """``name``, ``doc_id``, ``similarity``: the corpus name most like each name by Jaccard of tokens, the first document
    on a tie; names that share no token with any are left out.  ``corpus`` has ``doc_id``, ``name``."""
    own = names.select("name").where("name is not null").distinct().select("name", fold_tokens(F.col("name")).alias("a"))
    theirs = corpus.where("name is not null").select("doc_id", fold_tokens(F.col("name")).alias("b")).distinct()
    near = own.select("name", F.size("a").alias("n"), F.explode("a").alias("token")).join(theirs.select("doc_id", F.size("b").alias("m"), F.explode("b").alias("token")), "token")
    rated = near.groupBy("name", "doc_id", "n", "m").agg(F.count("*").alias("both")).withColumn("similarity", F.col("both") / (F.col("n") + F.col("m") - F.col("both")))
    best = rated.groupBy("name").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "doc_id")).alias("r"))
    return best.select("name", "r.doc_id", (-F.col("r.s")).alias("similarity"))


def abstention_violations(questions: DataFrame, corpus: DataFrame) -> DataFrame:
    """``question_id``, ``rule`` for every broken rule of a set of unanswerable questions.

    Such questions hold no gold, no reference and no visual or multi-hop mark, and say how they were checked; those outside
    the corpus name an anchor law that is not in it and stands in the question; those that lack evidence name a subject
    document of the corpus.  ``corpus`` has ``doc_id``; laws are documents ``k<number>``.
    """
    docs = corpus.select("doc_id").where("doc_id is not null").distinct()
    is_law = docs.select(F.expr("substring(doc_id, 2)").alias("anchor_law"), F.lit(True).alias("_law")).where("doc_id like 'k%'")
    subjects = docs.select(F.col("doc_id").alias("subject_doc"), F.lit(True).alias("_subject"))
    rows = questions.join(is_law, "anchor_law", "left").join(subjects, "subject_doc", "left")
    none = lambda c: F.size(F.coalesce(c, F.array().cast("array<string>"))) == 0
    outside, lacking = F.col("slice") == "korpus-disi", F.col("slice") == "eksik-kanit"
    words, name = fold_tokens(F.col("question")), fold_tokens(F.col("anchor_name"))
    named = F.array_contains(words, F.col("anchor_law")) | ((F.size(name) > 0) & (F.size(F.array_except(name, words)) == 0))
    has_anchor = F.col("anchor_law").isNotNull() & F.col("anchor_name").isNotNull()
    rules = {
        "answerable": ~F.coalesce(~F.col("answerable"), F.lit(False)),
        **{f"{c}-not-empty": ~none(c) for c in ("gold_doc_ids", "gold_page_ids", "gold_article_ids", "minimal_evidence_spans")},
        "reference-not-empty": F.trim(F.coalesce("reference_answer", F.lit(""))) != "",
        "visual-or-multi-hop": F.coalesce("requires_visual", F.lit(False)) | F.coalesce("requires_multi_hop", F.lit(False)),
        "no-verification-note": F.trim(F.coalesce("verification_note", F.lit(""))) == "",
        "reason-of-other-slice": (outside & ~F.col("unanswerable_reason").eqNullSafe("korpus-disi")) | (lacking & ~F.col("unanswerable_reason").eqNullSafe("eksik-kanit"))
        | ((F.col("slice") == "anlamsiz-ood") & ~F.col("unanswerable_reason").eqNullSafe("anlamsiz")),
        "no-anchor": outside & ~has_anchor,
        "anchor-in-corpus": outside & has_anchor & F.col("_law").isNotNull(),
        "anchor-not-in-question": outside & has_anchor & ~named,
        "no-subject": lacking & F.col("subject_doc").isNull(),
        "subject-not-in-corpus": lacking & F.col("subject_doc").isNotNull() & F.col("_subject").isNull(),
    }
    broken = F.array_compact(F.array(*[F.when(cond, F.lit(n)) for n, cond in rules.items()]))
    return rows.select("question_id", F.explode(broken).alias("rule")).distinct()


def metric_differences(stored: DataFrame, recomputed: DataFrame, keys: list[str], tolerance: float = 1e-12) -> DataFrame:
    """``keys``, ``metric``, ``stored``, ``recomputed`` where a stored number isn't the recomputed one; a key or number that
    only one side has differs too."""
    names = [c for c in recomputed.columns if c not in keys]
    cell = lambda df, name: df.select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias(name)) for c in names])).alias("c")).select(*keys, "c.*")
    both = cell(stored, "stored").join(cell(recomputed, "recomputed"), [*keys, "metric"], "full")
    near = F.coalesce(F.abs(F.col("stored") - F.col("recomputed")) <= tolerance, F.col("stored").isNull() & F.col("recomputed").isNull())
    return both.where(~near)


def duplicate_classes(texts: DataFrame, text_id: str, text: str) -> DataFrame:
    """``id``, ``class_id``, ``tokens``: texts with equal token sets share the smallest id; texts without tokens are left out."""
    sets = texts.select(F.col(text_id).alias("id"), F.array_sort(fold_tokens(F.col(text))).alias("tokens")).where(F.size("tokens") > 0)
    first = sets.groupBy("tokens").agg(F.min("id").alias("class_id"))
    return sets.join(first, "tokens").select("id", "class_id", "tokens")


def reconcile(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: keys in both, only left, only right."""
    a = left.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_l", F.lit(1))
    b = right.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_r", F.lit(1))
    return a.join(b, key, "full").agg(
        F.count_if(F.col("_l").isNotNull() & F.col("_r").isNotNull()).alias("both"),
        F.count_if(F.col("_r").isNull()).alias("only_left"),
        F.count_if(F.col("_l").isNull()).alias("only_right"),
    )


def assert_same_keys(left: DataFrame, right: DataFrame, key: str) -> None:
    """Raise unless both frames hold the same keys."""
    row = reconcile(left, right, key).first()
    if row["only_left"] or row["only_right"]:
        raise ValueError(f"keys differ: {row['only_left']} only left, {row['only_right']} only right")


def question_violations(questions: DataFrame) -> DataFrame:
    """``question_id``, ``rule`` for every broken rule of the question table."""
    gold_pages, gold_docs = F.coalesce("gold_page_ids", F.array()), F.coalesce("gold_doc_ids", F.array())
    reference = F.trim(F.coalesce("reference_answer", F.lit("")))
    rules = {
        "answerable-without-gold": F.col("answerable") & (F.size(gold_pages) == 0),
        "answerable-without-reference": F.col("answerable") & (reference == ""),
        "answerable-with-reason": F.col("answerable") & F.col("unanswerable_reason").isNotNull(),
        "unanswerable-with-gold": ~F.col("answerable") & (F.size(gold_pages) > 0),
        "unanswerable-without-reason": ~F.col("answerable") & F.col("unanswerable_reason").isNull(),
        "gold-page-without-number": F.exists(gold_pages, lambda p: ~F.contains(p, F.lit(":"))),
        "gold-page-of-other-doc": F.exists(gold_pages, lambda p: ~F.array_contains(gold_docs, page_doc(p))),
        "verified-by-nobody": (F.col("verification_status") == "verified") & F.col("verified_by").isNull(),
    }
    broken = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in rules.items()]))
    return questions.select("question_id", F.explode(broken).alias("rule")).distinct()


def threshold_violation(scale: Column, threshold: Column) -> Column:
    """Why a threshold doesn't fit its score scale, null if it does."""
    return (
        F.when((scale == "hybrid-bm25") & (threshold > 0) & (threshold <= 1.5), "looks normalised")
        .when((scale == "hybrid-bm25") & (threshold > 200), "too large")
        .when((scale == "visual-normalized") & (threshold > 1.5), "looks like BM25")
    )


def union_violations(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
