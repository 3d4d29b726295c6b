"""Text measures of messages and names."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import dice, edit_ratio, jaccard, trigrams

#: Endings that make a bare name a link, and the smart signs with their plain ones.
LINK = r"(?i)\b(?:https?://)?(?:www\.)?[a-z0-9](?:[a-z0-9-]*[a-z0-9])?(?:\.[a-z0-9](?:[a-z0-9-]*[a-z0-9])?)+(?:/\S*)?"
ENDINGS = ("com", "net", "org", "io", "co", "uk", "me", "app", "dev", "xyz", "info", "link", "gg", "tv", "to", "ru", "cn", "de", "fr", "nl")
SMART = {"'": "‘’‛′", '"': "“”″", "-": "–—−"}


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Compatibility composition, which Spark has no function for."""
    return text.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def squeezed(text: Column) -> Column:
    """Runs of three or more of a character cut to two, and single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"(.)\1{2,}", "$1$1"), r"\s+", " "))


def canonical_link(link: Column) -> Column:
    """Lower case without scheme, www., query, fragment, closing signs and a last slash."""
    for pattern in (r"^https?://", r"^www\.", r"[?#].*$", r"[.,!?;:)\]}'\"]+$", r"/$"):
        link = F.regexp_replace(link, pattern, "")
    return link


def links_of(text: Column) -> Column:
    """The canonical links of a text, in order; a name without a path is one only with a known ending."""
    found = F.regexp_extract_all(F.lower(text), F.lit(LINK), F.lit(0))
    ending = r"\.(" + "|".join(ENDINGS) + r")\b"
    return F.filter(F.transform(F.filter(found, lambda m: m.contains("/") | m.rlike(ending)), canonical_link), lambda m: m.contains("."))


def normalised(text: Column) -> Column:
    """Lower case with plain signs; links kept in their canonical form; else only letters and digits."""
    t = F.lower(text)
    for plain, signs in SMART.items():
        t = F.translate(t, signs, plain * len(signs))
    words = F.split(t, r"\s+")
    whole = F.transform(words, lambda w: F.when(F.size(links_of(w)) > 0, F.concat(F.lit("url:"), links_of(w)[0])).otherwise(squeezed(F.regexp_replace(w, r"[^\p{L}\p{N}]", " "))))
    return F.trim(F.regexp_replace(F.array_join(whole, " "), r"\s+", " "))


def normalised_name(name: Column) -> Column:
    return squeezed(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}\s]", " "))


def message_similarity(a: Column, b: Column, links_a: Column, links_b: Column) -> Column:
    """0 to 1 for normalised texts: the edit ratio of short ones; else the largest of it, of trigrams' Dice and of words'
    Jaccard measure; 0.85 at least for a shared link."""
    edits = edit_ratio(a, b)
    long = F.greatest(F.length(a), F.length(b)) >= 12
    words = jaccard(F.array_distinct(F.split(a, " ")), F.array_distinct(F.split(b, " ")))
    rest = F.when(F.arrays_overlap(links_a, links_b), F.greatest(F.lit(0.85), edits)).when(long, F.greatest(edits, dice(trigrams(a), trigrams(b)), words)).otherwise(edits)
    return F.when(a == b, 1.0).when((F.length(a) == 0) | (F.length(b) == 0), 0.0).otherwise(rest)


def name_similarity(a: Column, b: Column) -> Column:
    """0 to 1 for normalised names; one that begins or holds the other is near."""
    first = F.length(a) <= F.length(b)
    short, long = F.when(first, a).otherwise(b), F.when(first, b).otherwise(a)
    begins = F.when((F.length(short) >= 3) & long.startswith(short), 0.85 + 0.1 * F.length(short) / F.length(long)).when((F.length(short) >= 4) & long.contains(short), 0.8).otherwise(0.0)
    near = F.least(F.lit(1.0), F.greatest(edit_ratio(a, b), begins, dice(trigrams(a), trigrams(b))))
    return F.when((F.length(a) == 0) | (F.length(b) == 0), 0.0).when(a == b, 1.0).otherwise(near)


def name_hint(name: Column) -> Column:
    """The first two characters and an ellipsis, which tell variants apart but not who it is."""
    t = F.trim(F.coalesce(name, F.lit("")))
    return F.when(t == "", "unknown").otherwise(F.concat(F.substring(t, 1, 2), F.lit("…")))


def public_sample(text: Column, most: int = 160) -> Column:
    """The text without links, mentions and long ids, cut to ``most`` characters."""
    t = F.regexp_replace(text, LINK, "[link]")
    t = F.regexp_replace(F.regexp_replace(t, r"@\[[^\]]*\]", "[mention]"), r"@\S+", "[mention]")
    t = F.trim(F.regexp_replace(F.regexp_replace(t, r"(?i)\b[0-9a-f]{8,}\b", "[id]"), r"\s+", " "))
    return F.when(t == "", "[message]").when(F.length(t) > most, F.concat(F.rtrim(F.substring(t, 1, most - 1)), F.lit("…"))).otherwise(t)


def fnv1a(text: Column) -> Column:
    """The 32-bit FNV-1a hash over a text's characters, unsigned."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(codes, F.lit(2166136261).cast("long"), lambda h, c: (h.bitwiseXOR(c) * 16777619).bitwiseAND(0xFFFFFFFF))


def sampled(key: Column, percent: int) -> Column:
    """Whether a key is in the sample of so many percent: by its MD5, so alike in every run and engine."""
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("long") % 100 < percent


def nibbles_apart(a: Column, b: Column) -> Column:
    """In how many of 64 hex digits two ids differ; 64 for anything else than ids."""
    good = a.rlike("^[0-9A-Fa-f]{64}$") & b.rlike("^[0-9A-Fa-f]{64}$")
    differ = F.filter(F.sequence(F.lit(1), F.lit(64)), lambda i: F.upper(F.substr(a, i, F.lit(1))) != F.upper(F.substr(b, i, F.lit(1))))
    return F.when(good, F.size(differ)).otherwise(64)


def ordinal_variants(a: Column, b: Column) -> Column:
    """Whether two lists of words differ in the last one alone, as numbered or directed names do."""
    n = F.size(a)
    return (n >= 2) & (n == F.size(b)) & (F.slice(a, 1, n - 1) == F.slice(b, 1, n - 1)) & (F.element_at(a, -1) != F.element_at(b, -1))
