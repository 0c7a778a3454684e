"""Quality rules as Column expressions; thresholds are the fixed values of the corpus recipe."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from graintide.functions import text as T

#: Thresholds of the prose, code, SQL and notebook rules.
MIN_LINE_CHARS, MAX_NONALNUM, MIN_DOC_CHARS = 40, 0.30, 600
TOP_GRAMS, MAX_REPEATED, GRAM, MIN_WORDS = 10, 0.50, 4, 8
LANG_CHARS, ASCII_YES, ASCII_NO, ASCII_FALLBACK = 5000, 0.99, 0.90, 0.95
CODE_MIN, CODE_MAX, MAX_AVG_LINE, MAX_LINE, MIN_ALNUM, MAX_COMMENT = 200, 100_000, 100, 1000, 0.25, 0.50
MAX_INSERTS, SQL_MAX_LINE, SQL_HEAD, NOTEBOOK_MAX_LINE = 50, 5000, 20_000, 5000

#: Lines of boilerplate, secrets, e-mail addresses, IPv4 addresses and what replaces them.
BOILERPLATE = [
    r"^\s*form\s+10[-\s]?[kq]\b.*$",
    r"^\s*page\s+\d+\s+of\s+\d+\s*$",
    r"^\s*table\s+of\s+contents\s*$",
    r"^\s*/s/\s*.*$",
    r"^\s*all\s+rights\s+reserved.*$",
    r"^\s*united\s+states\s+securities\s+and\s+exchange\s+commission\s*$",
    r"^\s*securities\s+and\s+exchange\s+commission\s*$",
    r"^\s*washington,?\s+d\.?\s?c\.?\s+\d{5}\s*$",
    r"^\s*\[?\s*x\s*\]?\s*$",
]
SECRETS = [
    r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |PGP )?PRIVATE KEY",
    r"\bAKIA[0-9A-Z]{16}\b",
    r"\bgh[pousr]_[A-Za-z0-9]{36,}\b",
    r"\bhf_[A-Za-z0-9]{30,}\b",
    r"\bsk-[A-Za-z0-9]{32,}\b",
    r"\bxox[baprs]-[A-Za-z0-9-]{10,}\b",
    r"\bAIza[0-9A-Za-z_-]{35}\b",
]
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IPV4 = rf"(?:{OCTET}\.){{3}}{OCTET}"
EMAIL_TOKEN, IP_TOKEN = "user@example.com", "192.0.2.1"
AUTOGENERATED = r"(?i)auto[- ]?generated|generated by|do not edit|@generated|this file was generated"
IMAGE = r"data:image/[A-Za-z0-9.+-]+;base64,[A-Za-z0-9+/=\s]+"
INSERT = r"(?i)^\s*insert\s+into\b"
#: Addresses that are not public, by their first octets.
NOT_PUBLIC = r"(?:0|10|127)\.|169\.254\.|192\.168\.|192\.0\.[02]\.|198\.1[89]\.|198\.51\.100\.|203\.0\.113\.|172\.(?:1[6-9]|2\d|3[01])\.|100\.(?:6[4-9]|[7-9]\d|1[01]\d|12[0-7])\.|2[45]\d\."


def tidy_lines(x: Column) -> Column:
    return F.transform(T.lines(x), lambda line: F.trim(F.regexp_replace(line, r"\s+", " ")))


def line_ok(line: Column) -> Column:
    rest = F.length(F.regexp_replace(line, "[A-Za-z0-9]", ""))
    return (F.length(line) >= MIN_LINE_CHARS) & (rest <= MAX_NONALNUM * F.length(line))


def filter_lines(x: Column) -> Column:
    return F.array_join(F.filter(tidy_lines(x), line_ok), "\n")


def strip_boilerplate(x: Column) -> Column:
    # all begin alike: one anchor fails at once where nine would be tried
    pattern = r"(?i)^\s*(?:" + "|".join(p.removeprefix(r"^\s*") for p in BOILERPLATE) + ")"
    return F.array_join(F.filter(T.lines(x), lambda line: ~line.rlike(pattern)), "\n")


def is_english(x: Column) -> Column:
    """By the share of ASCII in the head; between the bands the documented fallback without a detector."""
    share = F.coalesce(T.ascii_ratio(F.substring(x, 1, LANG_CHARS)), F.lit(0.0))
    return F.when(share >= ASCII_YES, True).when(share < ASCII_NO, False).otherwise(share > ASCII_FALLBACK)


def is_repetitive(x: Column) -> Column:
    """Whether the ten commonest word 4-grams are more than half of all; native counting of their hashes by sorting within the row."""
    tokens = F.filter(F.split(F.lower(x), r"\s+"), lambda w: w != "")

    def hashed(w: Column) -> Column:
        spots = F.sequence(F.lit(0), F.size(w) - GRAM)
        grams = F.transform(spots, lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(GRAM))))
        return F.when(F.size(w) >= MIN_WORDS, grams).otherwise(F.array().cast("array<bigint>"))

    def judge(grams: Column) -> Column:
        # each other gram occurs once at least, so that with many different ones the commonest can't be half of all
        varied = F.size(F.array_distinct(grams)) - TOP_GRAMS >= (1 - MAX_REPEATED) * F.size(grams)
        return F.when(varied, False).otherwise(T.let(F.sort_array(grams), count))

    def count(grams: Column) -> Column:
        ends = F.filter(F.transform(grams, lambda g, i: F.when(~F.get(grams, i + 1).eqNullSafe(g), i + 1)), lambda e: e.isNotNull())
        counts = T.let(ends, lambda e: F.transform(e, lambda v, i: v - F.coalesce(F.get(e, i - 1), F.lit(0))))
        top = F.aggregate(F.slice(F.sort_array(counts, asc=False), 1, TOP_GRAMS), F.lit(0), lambda total, c: total + c)
        return top > MAX_REPEATED * F.size(grams)

    return T.let(T.let(tokens, hashed), judge)


def has_secret(x: Column) -> Column:
    return x.rlike("|".join(f"(?:{p})" for p in SECRETS))


def redact(x: Column) -> Column:
    """E-mail addresses first, then public IPv4 addresses; a second pass changes nothing."""
    mailed = F.when(x.contains("@"), F.regexp_replace(x, EMAIL, EMAIL_TOKEN)).otherwise(x)
    return F.regexp_replace(mailed, rf"\b(?!{NOT_PUBLIC}){IPV4}\b", IP_TOKEN)


def line_stats(x: Column) -> tuple[Column, Column]:
    sizes = F.transform(T.lines(x), F.length)
    return F.aggregate(sizes, F.lit(0).cast("long"), lambda a, n: a + n) / F.size(sizes), F.array_max(sizes)


def comment_fraction(x: Column, mark: str = "#") -> Column:
    filled = F.filter(F.transform(T.lines(x), F.trim), lambda line: line != "")
    return F.coalesce(T.ratio(F.size(F.filter(filled, lambda line: line.startswith(mark))), F.size(filled)), F.lit(1.0))


def autogenerated(x: Column) -> Column:
    return F.array_join(F.slice(T.lines(x), 1, 5), "\n").rlike(AUTOGENERATED)


def is_data_dump(x: Column) -> Column:
    rows = T.lines(x)
    inserts = F.size(F.filter(rows, lambda line: line.rlike(INSERT)))
    return (inserts > MAX_INSERTS) & (inserts > 0.5 * F.size(rows))


def mostly_ascii(x: Column, share: float = 0.97) -> Column:
    return F.coalesce(T.ascii_ratio(x) >= share, F.lit(True))


def canonical(x: Column, kind: str) -> Column:
    """What exact hashing sees: code and SQL without blank and comment lines, then normalised."""
    marks = {"code": "#", "sql": "(?:--|#)"}.get(kind)
    kept = x if marks is None else F.array_join(F.filter(T.lines(x), lambda line: ~line.rlike(rf"^\s*(?:$|{marks})")), "\n")
    return T.normalize(kept)
