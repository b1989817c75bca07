"""Text functions as native columns: Turkish lower case, folding, tokens, overlaps, keys and markers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Maps, closed word lists and limits that results depend on.
LOWER_FROM, LOWER_TO = "İI", "iı"
FOLD_FROM, FOLD_TO = "çğıöşüâîû", "cgiosuaiu"
MIN_TOKEN_CHARS = 2
PREFIX = 5
STOPWORDS = (
    "ve veya ile için gibi göre kadar sonra önce bir bu şu o ne nasıl neden niçin hangi kaç kim mi mı mu mü midir "
    "mıdır mudur müdür da de ki en çok az her ise olan olarak üzere ancak ama fakat yoksa değil nedir sayılı"
).split()
GENERIC_NAME_TOKENS = ["kanun", "türk", "türki", "cumhu"]
TITLE_KEYWORDS = ["KANUN", "ANAYASA"]
TITLE_LINE = "^[A-ZÇĞİÖŞÜÂÎÛ0-9 ()'’.,;:-]{8,}$"
HONEST_MISS = "verilen sayfalarda bulamadım"
WORD = r"([\p{L}\p{N}_]+)"

FOLDED_STOPWORDS = sorted({w.translate(str.maketrans(FOLD_FROM, FOLD_TO)) for w in STOPWORDS})


def tr_lower(text: Column) -> Column:
    """Lower case by Turkish rules; the two special letters go first because ``lower`` would split one of them."""
    return F.lower(F.translate(text, LOWER_FROM, LOWER_TO))


def ascii_fold(text: Column) -> Column:
    """Turkish letters without their marks; expects lower case."""
    return F.translate(text, FOLD_FROM, FOLD_TO)


def tokenize(text: Column) -> Column:
    """Index tokens of a text: words of two letters or more, folded, without stop words, cut to five characters.

    Null gives an empty array; repeated tokens stay.
    """
    words = F.regexp_extract_all(tr_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(1))
    words = F.filter(words, lambda w: F.length(w) >= MIN_TOKEN_CHARS)
    words = F.transform(words, ascii_fold)
    words = F.filter(words, lambda w: ~w.isin(FOLDED_STOPWORDS))
    return F.transform(words, lambda w: F.substring(w, 1, PREFIX))


def page_doc(page_id: Column) -> Column:
    """Document part of ``doc:page``."""
    return F.split_part(page_id, F.lit(":"), F.lit(1))


def page_number(page_id: Column) -> Column:
    """Page part of ``doc:page`` as a number, null if it is none."""
    return F.split_part(page_id, F.lit(":"), F.lit(2)).try_cast("int")


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of distinct values; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / F.size(F.array_union(a, b)))


def containment(query: Column, page: Column) -> Column:
    """Share of the distinct values of ``query`` found in ``page``; 0 if there are none."""
    asked = F.array_distinct(query)
    return F.when(F.size(asked) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(asked, page)) / F.size(asked))


def squeeze_blanks(text: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def span_in(span: Column, page: Column) -> Column:
    """Whether a span stands in a page after white space and case are normalised; a blank span does."""
    needle = squeeze_blanks(tr_lower(F.coalesce(span, F.lit(""))))
    return (needle == "") | F.contains(squeeze_blanks(tr_lower(F.coalesce(page, F.lit("")))), needle)


def hash_prefix(text: Column, digits: int) -> Column:
    """First hex digits of SHA-256."""
    return F.substring(F.sha2(text, 256), 1, digits)


def slug(text: Column) -> Column:
    """Characters that are unsafe in a path become one hyphen."""
    return F.regexp_replace(text, "[^A-Za-z0-9._-]+", "-")


def cited_sources(text: Column) -> Column:
    """Distinct numbers of ``[Sn]`` markers, ascending."""
    found = F.regexp_extract_all(text, F.lit(r"\[\s*S\s*(\d+)\s*\]"), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, lambda n: n.cast("int"))))


def without_markers(text: Column) -> Column:
    """Text without ``[Sn]`` markers and without the blanks they leave before punctuation."""
    bare = squeeze_blanks(F.regexp_replace(text, r"\[\s*S\s*\d+\s*\]", " "))
    return F.regexp_replace(bare, r" ([.,;:!?…»)\]])", "$1")


def honest_miss(status: Column, abstained: Column, answer: Column) -> Column:
    """Whether an answer admits that the pages hold nothing; null unless an answer was given."""
    said = F.contains(tr_lower(answer), F.lit(HONEST_MISS))
    return F.when(status != "ok", F.lit(None).cast("boolean")).when(abstained, F.lit(False)).otherwise(said)


def parse_verdict(raw: Column) -> Column:
    """``verdict`` (supported, unsupported or belirsiz) and ``parsed`` from a model's reply.

    A JSON object, fenced or not, or the first of a list, has the verdict under its key in any letter case; else the key
    and its value are looked for in the text.  What holds neither is undecided and not parsed; a bare word is not enough.
    """
    body = F.trim(F.regexp_replace(F.coalesce(raw, F.lit("")), r"(?m)^\s*```(?:json)?\s*|\s*```\s*$", ""))
    as_json = F.lower(F.trim(F.coalesce(F.get_json_object(body, "$.verdict"), F.get_json_object(body, "$[0].verdict"))))
    loose = F.lower(F.regexp_extract(body, r"(?i)[\"']?verdict[\"']?\s*[:=]\s*[\"']?(supported|unsupported|belirsiz)\b", 1))
    known = lambda c: F.when(c.isin("supported", "unsupported", "belirsiz"), c)
    found = F.coalesce(known(as_json), known(loose))
    return F.struct(F.coalesce(found, F.lit("belirsiz")).alias("verdict"), found.isNotNull().alias("parsed"))
