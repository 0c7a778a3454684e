"""Cleaning chains per document kind: one pass, one reason column, the first failing rule wins.

Kept rows have an empty reason and the cleaned text. Native rules come first; the rules that need a parser run only
on rows that all others kept, since Python functions would otherwise see every row.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graintide.functions import quality as Q
from graintide.functions import text as T


Rules = Callable[[Column], list[tuple[str, Column]]]


def verdict(body: Column, rules: Rules) -> Column:
    """struct(reason, text, size) of a text: body and reason are computed once, however many rules look at them.

    Dropped rows carry an empty text and their size where they failed; kept ones the redacted text and its size."""

    def settle(b: Column) -> Column:
        def final(r: Column) -> Column:
            kept = T.let(Q.redact(b), lambda t: F.struct(F.lit("").alias("reason"), t.alias("text"), F.length(t).cast("long").alias("size")))
            return F.when(r == "", kept).otherwise(F.struct(r.alias("reason"), F.lit("").alias("text"), F.length(b).cast("long").alias("size")))

        return T.let(first_reason(*rules(b)), final)

    return T.let(body, settle)


def _finish(df: DataFrame, body: Column, rules: Rules) -> DataFrame:
    rows = df.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("_v", verdict(body, rules))
    return rows.select(
        *[c for c in df.columns if c not in ("kept", "reason", "clean_text", "raw_chars", "clean_chars")], (F.col("_v.reason") == "").alias("kept"), F.col("_v.reason").alias("reason"),
        F.col("_v.text").alias("clean_text"), F.length("text").cast("long").alias("raw_chars"), F.col("_v.size").alias("clean_chars"))


def first_reason(*rules: tuple[str, Column]) -> Column:
    chain = F.when(rules[0][1], rules[0][0])
    for name, broken in rules[1:]:
        chain = chain.when(broken, name)
    return chain.otherwise("")


def prose_body(x: Column) -> Column:
    return Q.strip_boilerplate(Q.filter_lines(x))


def prose_rules(text: Column) -> Rules:
    return lambda b: [("empty_or_unfetched", text == ""), ("too_short", F.length(b) < Q.MIN_DOC_CHARS), ("repetitive", Q.is_repetitive(b)), ("non_english", ~Q.is_english(b))]


def clean_prose(df: DataFrame, light: bool = False) -> DataFrame:
    """Web prose: line filter, boilerplate, then too_short, repetitive, non_english; light keeps lines as they are."""
    text = F.col("text")
    return _finish(df, text if light else prose_body(text), prose_rules(text))


def _size_gate(b: Column) -> list[tuple[str, Column]]:
    return [("too_short", F.length(b) < Q.CODE_MIN), ("too_long", F.length(b) > Q.CODE_MAX), ("secret", Q.has_secret(b))]


def _parsed_later(df: DataFrame, check: Callable[[str], bool], reason: str) -> DataFrame:
    """Apply a Python predicate to rows that are kept so far; the others reach Python as nulls, which it passes over."""

    @F.pandas_udf("boolean")
    def passes(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t is None or check(t))

    judged = df.withColumn("_ok", passes(F.when(F.col("kept"), F.col("clean_text"))))
    return judged.withColumn("kept", F.col("kept") & F.col("_ok")).withColumn("reason", F.when(F.col("_ok"), F.col("reason")).otherwise(reason)).withColumn("clean_text", F.when(F.col("_ok"), F.col("clean_text")).otherwise("")).drop("_ok")


def python_parses(text: str) -> bool:
    try:
        ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return False
    return True


def sql_dialects(text: str) -> list[str]:
    """A text as it is, with names in backticks and # remarks made standard, and with names in brackets and GO lines made so."""
    plain = re.sub(r"`([^`]*)`", r'"\1"', re.sub(r"(?m)#[^\n]*$", "", text))
    plain = re.sub(r"(?i)\bauto_increment\b(?:\s*=\s*\d+)?|\bengine\s*=\s*\w+|\b(?:default\s+)?charset\s*=\s*\w+|\bunsigned\b", "", plain)
    bracketed = re.sub(r"\[(\w+(?: \w+)*)\]", r'"\1"', re.sub(r"(?im)^\s*go\s*;?\s*$", ";", text))
    return [text, plain, bracketed, re.sub(r"\\'", "''", plain)]


def sql_parses(text: str) -> bool:
    """Whether a parser takes the head, cut at its last semicolon, as one statement at least in one of the dialects."""
    import duckdb

    head = text[: Q.SQL_HEAD]
    if len(text) > Q.SQL_HEAD and ";" in head:
        head = head[: head.rindex(";") + 1]
    for form in dict.fromkeys(sql_dialects(head)):
        try:
            if duckdb.extract_statements(form):
                return True
        except duckdb.Error:
            continue
    return False


def clean_code(df: DataFrame) -> DataFrame:
    def rules(b: Column) -> list[tuple[str, Column]]:
        average, longest = Q.line_stats(b)
        cell = b.rlike(r"(?m)^# In\[[ \d]*\]:")
        return [*_size_gate(b), ("autogenerated", Q.autogenerated(b)), ("long_lines", (average > Q.MAX_AVG_LINE) | (longest > Q.MAX_LINE)), ("low_alnum", F.coalesce(T.alnum_ratio(b), F.lit(0.0)) < Q.MIN_ALNUM), ("comment_heavy", ~cell & (Q.comment_fraction(b) > Q.MAX_COMMENT))]

    return _parsed_later(_finish(df, F.col("text"), rules), python_parses, "syntax_error")


def clean_sql(df: DataFrame, parser: Callable[[str], bool] = sql_parses) -> DataFrame:
    rules = lambda b: [*_size_gate(b), ("data_dump", Q.is_data_dump(b)), ("long_lines", Q.line_stats(b)[1] > Q.SQL_MAX_LINE)]
    return _parsed_later(_finish(df, F.col("text"), rules), parser, "parse_error")


def clean_notebook(df: DataFrame) -> DataFrame:
    plain = F.regexp_replace("text", Q.IMAGE, "<image>")
    short = F.array_join(F.filter(T.lines(plain), lambda line: F.length(line) <= Q.NOTEBOOK_MAX_LINE), "\n")
    rules = lambda b: [("too_short", F.length(b) < Q.CODE_MIN), ("secret", Q.has_secret(b)), ("low_alnum", F.coalesce(T.alnum_ratio(b), F.lit(0.0)) < Q.MIN_ALNUM)]
    return _finish(df, F.trim(short), rules)


KINDS = {"text": clean_prose, "light": lambda df: clean_prose(df, light=True), "code": clean_code, "sql": clean_sql, "notebook": clean_notebook}


def clean_documents(df: DataFrame, kind: str) -> DataFrame:
    if kind not in KINDS:
        raise ValueError(f"unknown kind: {kind}")
    return KINDS[kind](df)
