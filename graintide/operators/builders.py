"""Sets of examples and what is measured of a model's answers, each as one plan over all records.

Records of text-to-SQL sets have id, domain, task_type, prompt, context (a script that makes the tables) and sql; any of them
may be null, and other columns are carried through. Selections go by a hash of the id, so that they are the same on every cluster."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graintide.functions import text as T
from graintide.operators import convo, examples, sample, sqltext, traces
from graintide.session import staged

#: Caps of a domain and of one that weighs double, shares that are kept aside, and what a refusal, clarification or lack is capped at.
CAP_GENERAL, CAP_TARGET, VAL_SHARE, GENERAL_VAL = 600, 1_500, 0.02, 0.01
REFUSALS, CLARIFICATIONS, LACKS, OF_EACH_UNSEEN = 6_000, 3_000, 2_500, 100
#: Words that an answer of a kind has, and how a repair says what it mends.
EXPECTED = {"refusal": ["read-only", "can't", "cannot", "not able"], "missing": ["no data about"], "clarify": ["clarify"]}
REWRITTEN, MENDED = "using only columns from the schema", "correct the {}"
TRAIN, VAL, UNSEEN = "train", "val", "test_unseen"


def stripped(x: Column) -> Column:
    return F.regexp_replace(F.coalesce(x, F.lit("")), r"^\s+|\s+$", "")


def judged_records(records: DataFrame) -> DataFrame:
    """records with question, schema and reason, which is empty for those that can become examples of reading.

    In this order: task_type (not one that reads), no_question, not_read_only, forbidden_script, no_schema. A null text is an empty one."""
    made = records.withColumn("question", stripped(F.col("prompt"))).withColumn("schema", sqltext.schema_of(F.coalesce("context", F.lit(""))))
    known = F.coalesce(sqltext.task_kind(F.col("task_type")) == "read", F.lit(False))
    reason = (
        F.when(~known, "task_type").when(F.col("question") == "", "no_question")
        .when(~sqltext.is_read_only(F.coalesce("sql", F.lit(""))), "not_read_only")
        .when(F.size(sqltext.forbidden_in_script(F.coalesce("context", F.lit("")))) > 0, "forbidden_script")
        .when(F.col("schema") == "", "no_schema").otherwise(""))
    return made.withColumn("reason", reason)


def asked(schema: Column, question: Column) -> Column:
    return F.concat(F.lit("<|schema|>\n"), stripped(schema), F.lit("\n<|/schema|>\n"), question)


def _turn(role: str, said: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), said.alias("text"), F.lit(True).alias("trained"))


def sql_examples(records: DataFrame, results: DataFrame, system: str = "", think: float = 0.7) -> DataFrame:
    """judged records with turns, null where there is a reason; besides those above, no_rows and truncated.

    results: what the statements gave when they were run, as traces.results_shown returns it for seed = id (n, shown, said),
    with `plan`, a sentence about the statement, if it is known; it opens a share `think` of the examples."""
    extra = [F.col("plan")] if "plan" in results.columns else [F.lit(None).cast("string").alias("plan")]
    ran = results.select(F.col("seed").alias("id"), "n", "shown", "said", *extra)
    made = judged_records(records).join(ran, "id", "left")
    reason = F.when(F.col("reason") != "", F.col("reason")).when(F.coalesce("n", F.lit(0)) == 0, "no_rows").when(F.col("n") > traces.MOST_ROWS, "truncated").otherwise("")
    block = lambda tag, x: F.concat(F.lit(f"<|{tag}|>\n"), x, F.lit(f"\n<|/{tag}|>"))
    call = block("sql", F.regexp_replace(stripped(F.col("sql")), r"[;\s]*\z", ""))
    thinks = (T.bucket_of(F.col("id"), "think") < int(think * 10_000)) & (F.coalesce("plan", F.lit("")) != "")
    turns = F.array(
        _turn("system", F.lit(system)), _turn("user", asked(F.col("schema"), F.col("question"))), _turn("assistant", F.when(thinks, F.concat(block("think", F.col("plan")), F.lit("\n"), call)).otherwise(call)),
        _turn("tool", block("result", F.col("shown"))), _turn("assistant", block("insight", F.col("said"))))
    return made.withColumn("reason", reason).withColumn("turns", F.when(F.col("reason") == "", turns)).drop("n", "shown", "said", "plan")


def kept_aside(key: Column, share: float) -> Column:
    """train, or val for a share of the keys by their hash."""
    return F.when(examples.split_by(key, share), VAL).otherwise(TRAIN)


def split_domains(made: DataFrame, held_out: list[str], general: int = CAP_GENERAL, target: int = CAP_TARGET, share: float = VAL_SHARE) -> DataFrame:
    """Examples with split: those of held-out domains are test_unseen, all of them; of each other domain as many as its cap, in train and val.

    A null domain is a domain like any other. A domain that holds most examples is capped part by part."""
    unseen = F.coalesce(F.col("domain").isin(*held_out), F.lit(False))
    cap = F.when(sqltext.domain_weight(F.coalesce("domain", F.lit(""))) > 1, target).otherwise(general)
    pool = sample.cap_per_group(made.where(~unseen), ["domain"], cap, "domain", "id").withColumn("split", kept_aside(F.col("id"), share))
    return pool.unionByName(made.where(unseen).withColumn("split", F.lit(UNSEEN)))


def split_by_group(made: DataFrame, group: str, share: float, seed: str = "group") -> DataFrame:
    """Examples with split, test_unseen for a share of the groups: no group, such as a database, is on both sides."""
    return made.withColumn("split", F.when(T.bucket_of(F.coalesce(F.col(group).cast("string"), F.lit("")), seed) < int(share * 10_000), UNSEEN).otherwise(TRAIN))


def split_report(made: DataFrame) -> DataFrame:
    """(split, examples, target_examples, domains)."""
    target = sqltext.domain_weight(F.coalesce("domain", F.lit(""))) > 1
    return made.groupBy("split").agg(F.count("*").alias("examples"), F.count_if(target).alias("target_examples"), F.countDistinct("domain").alias("domains"))


def refusal_set(records: DataFrame, held_out: list[str], quotas: tuple[int, int, int] = (REFUSALS, CLARIFICATIONS, LACKS), unseen: int = OF_EACH_UNSEEN, share: float = VAL_SHARE) -> DataFrame:
    """(id, domain, kind, split, question, answer): answers to requests to write, to vague questions and to ones without data.

    In the order of a hash a record takes the first kind that it is able for and that has room. Only records that don't
    write are asked vaguely or for what isn't there, and each schema once. Held-out domains have quotas of their own."""
    script = F.coalesce("context", F.lit(""))
    reads = F.coalesce(sqltext.task_kind(F.col("task_type")) != "write", F.lit(True))
    schema = F.nullif(sqltext.schema_of(script), F.lit(""))
    made = records.select("id", "domain", F.when(reads, schema).alias("schema"), stripped(F.col("prompt")).alias("prompt"), F.when(~reads & (stripped(F.col("prompt")) != "") & schema.isNotNull(), sqltext.refusal(F.col("sql"), F.col("id"))).alias("refused"))
    made = made.withColumn("vague", sqltext.clarification(F.col("schema"), F.col("id"))).withColumn("lacking", sqltext.missing_data(F.col("schema"), F.col("id")))
    made = staged(made, "answers")  # three selections on each side read it
    steps = lambda q: [("refusal", F.col("refused").isNotNull(), q[0]), ("clarify", F.col("vague").isNotNull(), q[1]), ("missing", F.col("lacking").isNotNull(), q[2])]
    apart = F.coalesce(F.col("domain").isin(*held_out), F.lit(False))
    seen = examples.quota_cascade(made.where(~apart), "id", steps(quotas), "schema").withColumn("split", kept_aside(F.col("id"), share))
    other = examples.quota_cascade(made.where(apart), "id", steps((unseen,) * 3), "schema").withColumn("split", F.lit(UNSEEN))
    of = lambda refusal, name: F.when(F.col("kind") == "refusal", refusal).when(F.col("kind") == "clarify", F.col(f"vague.{name}")).otherwise(F.col(f"lacking.{name}"))
    return seen.unionByName(other).select("id", "domain", "kind", "split", of(F.col("prompt"), "question").alias("question"), of(F.col("refused"), "answer").alias("answer"))


def general_set(conversations: DataFrame, caps: dict[str, int], make: Callable[[], examples.Encoder], max_len: int, share: float = GENERAL_VAL) -> DataFrame:
    """conversations (id, source, turns) that are valid, not too long and within their source's cap, with ids, mask and split."""
    valid = conversations.where(convo.drop_reason(F.col("turns")) == "")
    fit = examples.encode_examples(valid, make, max_len)
    return examples.cap_by_source(fit, caps, "id").withColumn("split", kept_aside(F.col("id"), share))


def repair_kind(thought: Column) -> Column:
    """What a repair mends, by the words in which it says so."""
    out = F.when(thought.contains(REWRITTEN), "rewrite")
    for kind, named in traces.CORRECTED.items():
        out = out.when(thought.contains(MENDED.format(named)), kind)
    return out.otherwise("other")


def repair_set(repairs: DataFrame, train: DataFrame, caps: dict[str, int], share: float = VAL_SHARE) -> DataFrame:
    """Repair traces (id, source, turns) of training examples (id), one of each, as many as their source's cap, with kind and split.

    Of the repairs of one example that with the smallest hash of its broken statement is taken."""
    mine = repairs.join(train.select("id").distinct(), "id", "left_semi")
    first = mine.groupBy("id").agg(F.min(F.struct(F.md5("broken").alias("h"), F.col("broken").alias("b"))).alias("_f")).select(F.col("id").alias("_i"), F.col("_f.b").alias("_b"))
    one = mine.join(first, (F.col("id") == F.col("_i")) & (F.col("broken") == F.col("_b"))).drop("_i", "_b")
    thought = F.get(F.col("turns"), F.lit(4))["text"]
    return examples.cap_by_source(one, caps, "id").withColumn("kind", repair_kind(thought)).withColumn("split", kept_aside(F.col("id"), share))


def drawn_items(made: DataFrame, records: DataFrame, n: int, seed: str = "items") -> DataFrame:
    """The records of n examples, drawn by a hash of their ids."""
    return records.join(sample.first_by_hash(made.select("id").distinct(), "id", n, seed), "id", "left_semi")


def ordered_matches(gold: DataFrame, given: DataFrame, key: str, pos: str = "pos") -> DataFrame:
    """(key, match) for each key of gold: whether given has the same rows in the same order, cells compared as texts.

    Both have key, pos (a row's place in its result) and as many further columns, met by place; gold's names count. A null
    cell equals a null cell alone. Rows meet at their places, so that no result is gathered."""
    plain = lambda df: F.to_json(F.struct(*(F.col(c).cast("string").alias(f"c{k}") for k, c in enumerate(x for x in df.columns if x not in (key, pos)))), {"ignoreNullFields": "false"})
    sides = [df.select(F.col(key).alias(key), F.col(pos).alias(pos), F.md5(plain(df)).alias("_row"), F.lit(side).alias("_side")) for side, df in enumerate((gold, given))]
    places = sides[0].unionByName(sides[1]).groupBy(key, pos).agg(F.count("*").alias("_n"), F.sum("_side").alias("_given"), F.min("_row").alias("_a"), F.max("_row").alias("_b"))
    same = (F.col("_n") == 2) & (F.col("_given") == 1) & (F.col("_a") == F.col("_b"))
    return places.groupBy(key).agg(F.min(same).alias("match"), F.max(F.col("_n") > F.col("_given")).alias("_asked")).where("_asked").drop("_asked")


def ordered_rates(matches: DataFrame, outputs: DataFrame, key: str, template: str = "template") -> DataFrame:
    """(template, n, matching, ran, strict) of outputs (key, template, status, strict); the total has a null template."""
    joined = outputs.join(matches, key, "left")
    rate = lambda c: T.quantised(F.avg(F.coalesce(c, F.lit(False)).cast("int")))
    ran = F.col("status") == "ran"
    return joined.rollup(template).agg(F.count("*").alias("n"), rate(F.col("match") & ran).alias("matching"), rate(ran).alias("ran"), rate(F.col("strict")).alias("strict"))


def behaviour(outputs: DataFrame, kind: str = "kind", text: str = "text", expected: dict[str, list[str]] = EXPECTED) -> DataFrame:
    """(kind, n, correct, wrote_sql): how many answers of a kind have a remark with one of its words and no statement; only kinds that are expected."""
    low, calls, remarks = F.lower(text), F.coalesce(F.col(text).contains("<|sql|>"), F.lit(False)), F.coalesce(F.col(text).contains("<|insight|>"), F.lit(False))
    worded = F.lit(False)
    for name, words in expected.items():
        worded |= (F.col(kind) == name) & F.exists(F.array(*map(F.lit, words)), lambda w: F.coalesce(low.contains(w), F.lit(False)))
    rate = lambda c: T.quantised(F.avg(c.cast("int")))
    return outputs.where(F.col(kind).isin(*expected)).groupBy(kind).agg(F.count("*").alias("n"), rate(remarks & ~calls & worded).alias("correct"), rate(calls).alias("wrote_sql"))
