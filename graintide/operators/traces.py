"""Question templates run over all their seeds at once: examples, repairs and judgements as DataFrames.

A template's slots are columns of a table of seeds, drawn from lists or from the values of a table's column. Its statement,
with slots in place of literals, is joined laterally to that table, so that one query gives the results of all seeds;
the first rows of each result, its number of rows and the sentence about it are aggregates and expressions over them.
What a broken statement says is found by analysing it once for a template and a kind of fault, which runs nothing."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graintide.functions import text
from graintide.operators import sample, sqlcheck, sqltext
from graintide.session import staged

#: Rows that a result may have, rows that an example shows, and how often one question and statement may occur.
MOST_ROWS, SHOWN, REPEATS = 200, 10, 12
#: Sentences about a result.
ONE_VALUE, ONE_ROW, MANY, EXTREMES, FIRST = "The result is {v}.", "The result is: {v}.", "The query returned {n} rows.", " {c} is highest for {h} ({hv}) and lowest for {l} ({lv}).", " The first row is {v}."
SHORTENED = "The query returned {n} rows; only the first {k} are shown."
NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


@dataclass(frozen=True)
class Values:
    """A slot: one of some constants, or of the distinct values of a table's column."""

    among: tuple = ()
    table: str = ""
    column: str = ""


@dataclass(frozen=True)
class Template:
    """body: a SELECT without ORDER BY and LIMIT, with slots as {name}, quoted where they are texts; order: its ORDER BY; limit: a number or a slot."""

    name: str
    domain: str
    questions: tuple[str, ...]
    body: str
    order: tuple[str, ...] = ()
    limit: int | str | None = None
    slots: dict[str, Values] = field(default_factory=dict)

    def statement(self) -> str:
        """The whole statement, slots as they are."""
        order = f" ORDER BY {', '.join(self.order)}" if self.order else ""
        limit = "" if self.limit is None else f" LIMIT {'{' + self.limit + '}' if isinstance(self.limit, str) else self.limit}"
        return self.body + order + limit

    def lateral(self) -> str:
        """body with slots as columns of s."""
        return re.sub(r"'?\{(\w+)\}'?", r"s.\1", self.body)


def filled(pattern: str, slots: dict[str, Values]) -> Column:
    """A text with its slots filled from columns of their names."""
    out = F.lit(pattern)
    for name in slots:
        out = F.replace(out, F.lit("{" + name + "}"), F.col(name).cast("string"))
    return out


def seeds_of(spark: SparkSession, template: Template, seeds: DataFrame) -> DataFrame:
    """seeds (column seed) with the slots, the question and the statement."""
    rows = seeds
    for name, values in sorted(template.slots.items()):
        key = F.concat_ws(":", F.lit(template.name), F.col("seed"))
        if values.among:
            rows = rows.withColumn(name, F.get(F.array(*map(F.lit, values.among)), text.bucket_of(key, name, len(values.among)).cast("int")))
            continue
        distinct = spark.table(values.table).where(F.col(values.column).isNotNull()).select(F.col(values.column).alias(name)).distinct()
        places = sample.placed(staged(distinct.orderBy(name).withColumn("_p", F.spark_partition_id()), "slot"), name)
        many = max(1, places.count())
        rows = rows.withColumn("i", F.pmod(text.bucket_of(key, name, 1_000_000), F.lit(many)).cast("long")).join(places, "i").drop("i")
    question = F.get(F.array(*(filled(q, template.slots) for q in template.questions)), text.bucket_of(F.concat_ws(":", F.lit(template.name), F.col("seed")), "question", len(template.questions)).cast("int"))
    return rows.withColumn("question", question).withColumn("sql", filled(template.statement(), template.slots))


def results_of(spark: SparkSession, template: Template, rows: DataFrame) -> DataFrame:
    """seed, pos (from 1, in the template's order) and the columns of the result, for the seeds of rows; MOST_ROWS + 1 rows of each at most."""
    view = f"seeds_of_{template.name}"
    rows.createOrReplaceTempView(view)
    found = spark.sql(f"SELECT s.seed AS _seed, {'s.' + template.limit if isinstance(template.limit, str) else 'NULL'} AS _limit, r.* FROM {view} s, LATERAL ({template.lateral()}) r")
    place = F.row_number().over(W.partitionBy("_seed").orderBy(*(F.expr(o.rsplit(" ", 1)[0]).desc() if o.upper().endswith(" DESC") else F.expr(o) for o in template.order or ("_seed",))))
    most = F.least(F.coalesce(F.col("_limit").cast("long"), F.lit(template.limit if isinstance(template.limit, int) else MOST_ROWS + 1)), F.lit(MOST_ROWS + 1))
    return found.withColumn("pos", place).where(F.col("pos") <= most).withColumnRenamed("_seed", "seed").drop("_limit")


def cell(x: Column, kind: T.DataType) -> Column:
    """How a value is shown: NULL, a fractional number by six digits, anything else as it is."""
    if not isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)):
        return F.coalesce(x.cast("string"), F.lit("NULL"))
    exact = x.cast("decimal(38,10)")
    size = F.abs(exact)
    plain = F.lit(None).cast("string")
    for digits in range(0, 10):  # of a number below 10 ** (6 - digits) so many decimals make six digits
        plain = F.when(size < 10.0 ** (6 - digits), F.round(exact, digits).cast("string")).otherwise(plain)
    trimmed = F.when(plain.contains("."), F.regexp_replace(plain, r"\.?0+$", "")).otherwise(plain)
    power = F.floor(F.log10(size.cast("double"))).cast("int")
    mantissa = F.regexp_replace(F.round((exact.cast("double") / F.pow(F.lit(10.0), power)).cast("decimal(20,10)"), 5).cast("string"), r"\.?0+$", "")
    large = F.concat(mantissa, F.lit("e+"), F.lpad(power.cast("string"), 2, "0"))
    return F.when(x.isNull(), "NULL").when(size == 0, "0").otherwise(F.coalesce(trimmed, large))


def results_shown(results: DataFrame) -> DataFrame:
    """seed, n (rows), shown (the first rows as text) and said (a sentence that holds no number but those of the result)."""
    fields = [f for f in results.schema.fields if f.name not in ("seed", "pos")]
    numbers = [k for k, f in enumerate(fields) if isinstance(f.dataType, NUMBERS)]
    row = F.struct("pos", F.array(*(cell(F.col(f.name), f.dataType) for f in fields)).alias("cells"), F.array(*((F.col(f.name).cast("double") if k in numbers else F.lit(None).cast("double")) for k, f in enumerate(fields))).alias("numbers"))
    first = F.when(F.col("pos") <= SHOWN, row)  # so that a list holds SHOWN rows at most
    made = results.groupBy("seed").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(first)).alias("rows"))
    line = lambda cells: F.array_join(cells, " | ")
    names = [f.name for f in fields]
    shown = F.concat_ws("\n", F.lit(" | ".join(names)), F.transform("rows", lambda r: line(r["cells"])), F.when(F.col("n") > SHOWN, F.concat(F.lit("("), F.col("n") - SHOWN, F.lit(" more rows)"))))
    return made.select("seed", "n", shown.alias("shown"), _said(names, numbers).alias("said"))


def _put(pattern: str, **values: Column | str) -> Column:
    out = F.lit(pattern)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value if isinstance(value, Column) else F.lit(value))
    return out


def _said(names: list[str], numbers: list[int]) -> Column:
    """The sentence, from n and rows: the value or row if there is one, else the extremes of the last column of numbers, or the first row."""
    top = F.get("rows", F.lit(0))["cells"]
    single = _put(ONE_VALUE, v=F.get(top, F.lit(0))) if len(names) == 1 else _put(ONE_ROW, v=F.concat_ws(", ", *(F.concat(F.lit(f"{c} = "), F.get(top, F.lit(k))) for k, c in enumerate(names))))
    head = F.when(F.col("n") > SHOWN, _put(SHORTENED, n=F.col("n").cast("string"), k=str(SHOWN))).otherwise(_put(MANY, n=F.col("n").cast("string")))
    tail = _put(FIRST, v=F.get(top, F.lit(0)))
    for k in numbers:  # the last one with any number decides
        tail = F.when(F.exists("rows", _filled_at(k)), _extremes(names[k], k)).otherwise(tail)
    return F.when(F.col("n") == 1, single).otherwise(F.concat(head, tail))


def _filled_at(k: int):
    return lambda r: F.get(r["numbers"], F.lit(k)).isNotNull()


def _extremes(name: str, k: int) -> Column:
    """Where column k is highest and lowest among the rows, the earliest of equals; rows go by their first cell, or by number where that is it."""
    have = F.filter("rows", _filled_at(k))
    ranked = lambda sign: F.transform(have, lambda r: F.struct(F.get(r["numbers"], F.lit(k)).alias("v"), (r["pos"] * sign).alias("p"), r["cells"].alias("cells")))
    high, low = F.array_max(ranked(-1)), F.array_min(ranked(1))
    label = lambda r: F.get(r["cells"], F.lit(0)) if k else F.concat(F.lit("row "), F.abs(r["p"]).cast("string"))
    return _put(EXTREMES, c=name, h=label(high), hv=F.get(high["cells"], F.lit(k)), l=label(low), lv=F.get(low["cells"], F.lit(k)))


def _turn(role: str, said: Column, trained: bool = True) -> Column:
    return F.struct(F.lit(role).alias("role"), said.alias("text"), F.lit(trained).alias("trained"))


def _block(tag: str, said: Column) -> Column:
    return F.concat(F.lit(f"<|{tag}|>\n"), said, F.lit(f"\n<|/{tag}|>"))


def template_traces(spark: SparkSession, templates: list[Template], seeds: DataFrame, schema: str, system: str = "", think: float = 0.7, repeats: int = REPEATS) -> DataFrame:
    """id, domain, template, seed, question, sql, n, shown, said, plan and turns of all templates and seeds that give 1 to MOST_ROWS rows.

    No question and statement occur more than `repeats` times. `plan` is the sentence about what the statement does, which
    is in the turns of a share `think` of the examples."""
    made = None
    for template in templates:
        rows = staged(seeds_of(spark, template, seeds), "seeds")
        plan = sqlcheck.plan_sentence(spark, template.statement().replace("{", "").replace("}", ""))
        found = results_shown(results_of(spark, template, rows)).where(F.col("n") <= MOST_ROWS)
        part = rows.select("seed", "question", "sql").join(found, "seed").withColumn("template", F.lit(template.name)).withColumn("domain", F.lit(template.domain)).withColumn("plan", F.lit(plan))
        made = part if made is None else made.unionByName(part)
    # a pair occurs once for a seed at most, so that the groups ranked here are no larger than the seeds are many
    nth = F.row_number().over(W.partitionBy("question", "sql").orderBy("template", "seed"))
    kept = made.withColumn("_nth", nth).where(F.col("_nth") <= repeats).drop("_nth").withColumn("id", F.concat_ws("-", "template", "seed"))
    thinks = text.bucket_of(F.col("id"), "think") < int(think * 10_000)
    call = F.when(thinks & (F.col("plan") != ""), F.concat(_block("think", F.col("plan")), F.lit("\n"), _block("sql", F.col("sql")))).otherwise(_block("sql", F.col("sql")))
    asked = F.concat(_block("schema", F.lit(schema.strip())), F.lit("\n"), F.col("question"))
    turns = F.array(_turn("system", F.lit(system)), _turn("user", asked), _turn("assistant", call), _turn("tool", _block("result", F.col("shown"))), _turn("assistant", _block("insight", F.col("said"))))
    return kept.withColumn("turns", turns)


#: What is said about a fault.
CORRECTED = {"column": "column name", "table": "table name", "syntax": "syntax"}


def _fault(spark: SparkSession, sql: str) -> str:
    """Why a statement can't be run, from its analysis; empty where it can."""
    try:
        spark.sql(sql)
    except (AnalysisException, ParseException) as why:
        return str(why).strip().split(" SQLSTATE", 1)[0].splitlines()[0].strip()[:300].rstrip(".")
    return ""


def repair_traces(spark: SparkSession, templates: list[Template], traces: DataFrame) -> DataFrame:
    """traces with kind, broken and fault, and turns in which a broken statement, which isn't trained, fails and is put right; one row for each kind."""
    rows, known = [], {t.name for t in templates}
    firsts = traces.groupBy("template").agg(F.min_by("sql", "seed").alias("sql"))  # a row for each template
    for name, plain in (tuple(r) for r in firsts.collect() if r["template"] in known):
        columns, tables = sqlcheck.names_used(spark, plain)
        broken = spark.range(1).select(sqltext.mutations(F.lit(plain), F.array(*map(F.lit, columns)).cast("array<string>"), F.array(*map(F.lit, tables)).cast("array<string>"))).first()[0]
        rows += [(name, columns, tables, m["kind"], why) for m in broken if (why := _fault(spark, m["sql"]))]
    faults = spark.createDataFrame(rows, "template string, columns array<string>, tables array<string>, kind string, fault string")
    # a few rows for each template
    joined = traces.join(F.broadcast(faults), "template")
    of_kind = F.filter(sqltext.mutations(F.col("sql"), F.col("columns"), F.col("tables")), lambda m: m["kind"] == F.col("kind"))
    made = joined.withColumn("broken", F.get(of_kind, F.lit(0))["sql"]).where("broken is not null")
    wrong = F.element_at(F.create_map(*(F.lit(x) for kv in CORRECTED.items() for x in kv)), F.col("kind"))
    thought = F.format_string(sqlcheck.FAILED.format("%s", sqlcheck.CORRECT.format("%s")), F.col("fault"), wrong)
    again = F.array(
        _turn("assistant", _block("sql", F.col("broken")), False), _turn("tool", _block("result", F.concat(F.lit("Error: "), F.col("fault")))),
        _turn("assistant", F.concat(_block("think", thought), F.lit("\n"), _block("sql", F.col("sql")))))
    return made.withColumn("turns", F.concat(F.slice("turns", 1, 2), again, F.slice("turns", 4, 2))).drop("columns", "tables")


def judged_candidates(gold: DataFrame, candidates: DataFrame, failed: DataFrame, key: list[str]) -> DataFrame:
    """key, candidate, status (match, match_rounding, mismatch or error) of candidates' results against the right ones.

    gold: key and columns c0, c1, ...; candidates: key, candidate and the same columns, which as many rows as results
    have; failed: key, candidate of those that didn't run. Results are compared as multisets, by sums of their rows' digests:
    numbers to 4 places, then each column to the fewest decimals that either side shows, halves going up."""
    names = [c for c in gold.columns if c not in key]
    numeric = {f.name for f in gold.schema.fields if isinstance(f.dataType, NUMBERS)}
    sides = gold.withColumn("candidate", F.lit(None).cast("string")).unionByName(candidates)
    fraction = lambda c: F.length(F.regexp_replace(F.regexp_extract(F.format_string("%.6f", F.col(c).cast("double")), r"\.(\d*)$", 1), "0+$", ""))
    decimals = lambda c: F.min(F.when(F.col(c).cast("double") != F.floor(F.col(c).cast("double")), fraction(c)))
    exact = lambda c: F.round(F.col(c).cast("decimal(38,10)"), 4).cast("string") if c in numeric else F.col(c).cast("string")
    row = lambda cells: F.conv(F.substring(F.md5(F.to_json(F.struct(*(x.alias(f"c{k}") for k, x in enumerate(cells))), {"ignoreNullFields": "false"})), 1, 15), 16, 10).cast("decimal(38,0)")
    summed = sides.groupBy(*key, "candidate").agg(F.count("*").alias("n"), F.sum(row([exact(c) for c in names])).alias("digest"), *(decimals(c).alias(f"p_{c}") for c in names if c in numeric))
    right = summed.where("candidate is null").drop("candidate")
    right = right.select(*key, F.col("n").alias("gn"), F.col("digest").alias("gdigest"), *(F.col(f"p_{c}").alias(f"g_{c}") for c in names if c in numeric))
    met = staged(summed.where("candidate is not null").join(right, key, "left"), "summed")
    strict = met.where("n = gn and digest = gdigest").select(*key, "candidate", F.lit("match").alias("status"))
    open_ = met.where("not coalesce(n = gn and digest = gdigest, false)")
    places = open_.select(*key, "candidate", *(F.coalesce(F.least(f"p_{c}", f"g_{c}"), F.lit(4)).alias(f"q_{c}") for c in names if c in numeric))
    coarse = lambda c: (F.floor(F.col(c).cast("double") * F.pow(F.lit(10.0), F.col(f"q_{c}")) + 0.5)).cast("string") if c in numeric else F.col(c).cast("string")
    again = candidates.join(places, [*key, "candidate"]).withColumn("side", F.lit(0)).unionByName(gold.join(places, key).withColumn("side", F.lit(1)))
    digests = again.groupBy(*key, "candidate", "side").agg(F.count("*").alias("n"), F.sum(row([coarse(c) for c in names])).alias("digest"))
    equal = digests.groupBy(*key, "candidate").agg((F.count("*") == 2).alias("both"), (F.min("digest") == F.max("digest")).alias("d"), (F.min("n") == F.max("n")).alias("m"))
    rounded = open_.select(*key, "candidate").join(equal, [*key, "candidate"], "left").select(*key, "candidate", F.when(F.col("both") & F.col("d") & F.col("m"), "match_rounding").otherwise("mismatch").alias("status"))
    return strict.unionByName(rounded).unionByName(failed.select(*key, "candidate", F.lit("error").alias("status")))
