"""Question templates over a database: slots filled by a seed, examples made by running what they ask."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from graintide.operators import sqlcheck

#: Given a session and a chance in [0, 1), the value of a slot.
Slot = Callable[[SparkSession, float], object]


@dataclass(frozen=True)
class SqlTemplate:
    domain: str
    name: str
    questions: tuple[str, ...]
    sql: str
    slots: dict[str, Slot] = field(default_factory=dict)
    holdout: bool = False


def chance(*parts: object) -> float:
    digest = hashlib.blake2b(":".join(map(str, parts)).encode(), digest_size=6).digest()
    return int.from_bytes(digest, "big") / float(1 << 48)


def choice(*values: object) -> Slot:
    return lambda spark, u: values[int(u * len(values))]


def pick(table: str, column: str) -> Slot:
    """One of the values of a column: the one whose hash with the seed is first, found without gathering them."""
    def draw(spark: SparkSession, u: float) -> object:
        values = spark.table(table).where(F.col(column).isNotNull()).groupBy(column).agg(F.first(F.lit(1)))
        found = values.orderBy(F.xxhash64(F.col(column), F.lit(u)), column).select(column).first()
        return found[0] if found else None

    return draw


def instantiate(template: SqlTemplate, spark: SparkSession, seed: int) -> tuple[str, str]:
    """(question, sql) with all slots filled."""
    values = {k: slot(spark, chance(template.name, seed, k)) for k, slot in sorted(template.slots.items())}
    question = template.questions[int(chance(template.name, seed, "question") * len(template.questions))]
    return question.format(**values), template.sql.format(**values)


def trace_set(spark: SparkSession, templates: list[SqlTemplate], seeds: range, schema: str, repeats: int = 12, holdout: bool = False) -> list[dict]:
    """Examples of templates and seeds that run and return rows, no (question, sql) more than so many times."""
    seen: Counter = Counter()
    made = []
    for template in (t for t in templates if t.holdout == holdout):
        for seed in seeds:
            question, sql = instantiate(template, spark, seed)
            if seen[question, sql] >= repeats:
                continue
            turns = sqlcheck.sql_trace(spark, schema, question, sql, think=chance(template.name, seed, "think") < 0.7)
            if turns is not None:
                seen[question, sql] += 1
                made.append({"source": "templates", "id": f"{template.name}-{seed}", "domain": template.domain, "turns": turns})
    return made
