"""Scalar text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize(text: Column) -> Column:
    """Lower case, white space collapsed, ends trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def lines(text: Column) -> Column:
    return F.split(F.regexp_replace(text, r"\r\n?|[\u000B\u000C\u0085  ]", "\n"), "\n")


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once, however often a lambda inside body looks at it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ngrams(tokens: Column, n: int) -> Column:
    """Every n consecutive tokens joined by a space; none where there are fewer."""

    def cut(w: Column) -> Column:
        spots = F.sequence(F.lit(1), F.size(w) - (n - 1))
        return F.when(F.size(w) >= n, F.transform(spots, lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(F.array().cast("array<string>"))

    return let(tokens, cut)


def shingles(tokens: Column, k: int = 5) -> Column:
    """Distinct k-grams; fewer tokens than k make one shingle, none make none."""

    def cut(w: Column) -> Column:
        short = F.when(F.size(w) == 0, F.array().cast("array<string>")).otherwise(F.array(F.array_join(w, " ")))
        return F.when(F.size(w) < k, short).otherwise(F.array_distinct(ngrams(w, k)))

    return let(tokens, cut)


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, null for an empty whole."""
    return part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0))


def quantised(x: Column, places: int = 6) -> Column:
    """Rounded by the arithmetic that every engine shares."""
    return F.floor(x * 10**places + 0.5) / float(10**places)


def ascii_ratio(text: Column) -> Column:
    return ratio(F.length(F.regexp_replace(text, r"[^\x00-\x7F]", "")), F.length(text))


def alnum_ratio(text: Column) -> Column:
    return ratio(F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]", "")), F.length(text))


def est_tokens(chars: Column) -> Column:
    """Four characters a token, floored on the sum."""
    return F.floor(chars / 4.0).cast("long")


def bucket_of(key: Column, seed: str, size: int = 10_000) -> Column:
    """A stable number below size from a key, the same in SQL engines that have md5."""
    digest = F.md5(F.concat(key.cast("string"), F.lit(":" + seed)))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(size))


def extract_block(text: Column, tag: str) -> Column:
    """The trimmed inside of the first closed block of a tag; null where there is none."""
    found = F.regexp_extract(text, f"(?s)<{tag}>(.*?)</{tag}>", 1)
    return F.when(text.rlike(f"(?s)<{tag}>.*?</{tag}>"), F.trim(found))


def neutralise_specials(text: Column) -> Column:
    """No reserved token can form: a space goes between < and |."""
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def license_from_card(card: Column, tags: Column) -> Column:
    """A card's licence: a text, a list joined by commas, else the first license: tag."""
    plain, many = F.get_json_object(card, "$.license"), F.from_json(F.get_json_object(card, "$.license"), "array<string>")
    tagged = F.get(F.filter(tags, lambda t: t.startswith("license:")), F.lit(0))
    return F.coalesce(F.when(plain.startswith("["), F.array_join(many, ",")).otherwise(plain), F.regexp_replace(tagged, "^license:", ""))
