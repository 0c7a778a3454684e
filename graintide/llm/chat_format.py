"""Chat formatting by quotation linking (DataFrame and SQL operations only).

A line's quote level is the number of `>` that it begins with. Consecutive lines of one level form a passage. The
normalised passages of a message and their lines are hashed, at every level, and joined to the hashed lines and whole own
texts of earlier messages of the conversation; of the shallowest level that is known the latest message is the parent.
A message that quotes nothing known replies to the one before it. For each passage the latest earlier message is a
running maximum over turns, so that a line that all messages have makes no pairs.

The result has each message without quotes and attribution lines, with its parent and its place in the conversation as
its replies order it: depth first, a message's replies following it by turn, each with all that replies to it. Messages
that each reply to the one before form a run, so that only runs are ordered: a tour enters a run, goes through those that
branch off it and leaves it, each step knowing the next one, and pointer doubling sums up what lies between a step and the
tour's end. Rows keep one size however deep runs branch; long conversations are dealt in blocks of turns.

Defined cases: a null text is empty; a message of quotes alone has empty content; empty and repeated lines never
make a passage by themselves; of several rows with one turn each keeps its row, their places following role and
content; rows with a null conversation or turn have no parent and no place; an empty table gives no rows; columns beside
the four take no part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graintide.functions.text import let
from graintide.session import staged

#: Turns of a conversation that share a window partition, so that a very long one is dealt over tasks.
BLOCK = 1024
#: Patterns of quote marks, of white space and of lines that introduce a quote.
QUOTE = r"^[ \t]*(?:>[ \t]?)+"
SPACE = r"[ \t\r\n\f]+"
ATTRIBUTION = r"^[ \t]*(On|Le|Am|El) .*(wrote|écrit|schrieb|escribió) ?:[ \t]*$"


def normalised(x):
    return F.trim(F.regexp_replace(F.lower(x), SPACE, " "))


def parsed(messages: DataFrame) -> DataFrame:
    """Messages with `lines` (level, body of each line), `depth` (deepest quote) and `content` (own text)."""
    lines = F.transform(F.split(F.coalesce(F.col("text"), F.lit("")), "\n"), lambda x: F.struct(
        F.length(F.regexp_replace(F.regexp_extract(x, QUOTE, 0), "[^>]", "")).alias("level"), F.regexp_replace(x, QUOTE, "").alias("body")))
    rows = messages.select("conv_id", "turn", "role", lines.alias("lines"))
    rows = rows.withColumn("depth", F.coalesce(F.array_max(F.transform("lines", lambda x: x["level"])), F.lit(0)))
    own = F.filter("lines", lambda x: (x["level"] == 0) & ~((F.col("depth") > 0) & x["body"].rlike(ATTRIBUTION)))
    return rows.withColumn("content", F.trim(F.regexp_replace(F.array_join(F.transform(own, lambda x: x["body"]), "\n"), r"^\s+|\s+$", "")))


def passages(lines):
    """Passages with their level: bodies of consecutive lines of one level, a line of another level being a break."""
    starts = F.filter(F.transform(lines, lambda x, i: F.when((i == 0) | (F.get(lines, i - 1)["level"] != x["level"]), i)), lambda i: i.isNotNull())

    def cut(s):
        body = lambda at, k: F.transform(F.slice(lines, at + 1, F.coalesce(F.get(s, k + 1), F.size(lines)) - at), lambda x: x["body"])
        return F.transform(s, lambda at, k: F.struct(F.get(lines, at)["level"].alias("level"), F.array_join(body(at, k), "\n").alias("body")))

    return let(starts, cut)


def quoted(lines):
    """Distinct (level, hash) of the normalised passages and lines of every quote level that aren't empty."""
    units = F.filter(F.concat(passages(lines), lines), lambda x: x["level"] > 0)
    plain = F.filter(F.transform(units, lambda x: F.struct(x["level"].alias("level"), normalised(x["body"]).alias("unit"))), lambda x: x["unit"] != "")
    return F.array_distinct(F.transform(plain, lambda x: F.struct(x["level"].alias("level"), F.md5(x["unit"]).alias("passage"))))


def hashes(units):
    """Distinct hashes of the normalised units that aren't empty."""
    return F.array_distinct(F.transform(F.filter(F.transform(units, normalised), lambda x: x != ""), lambda x: F.md5(x)))


def running_max(rows: DataFrame, keys: list[str], value, name: str, upto: int = 0) -> DataFrame:
    """rows with the maximum of value over the rows of the same keys up to their own turn (upto 0) or before it (-1).

    Taken within blocks of turns and then over blocks, so that keys with very many rows are dealt over tasks."""
    blocked = rows.withColumn("_v", value).withColumn("_block", F.floor(F.col("turn") / BLOCK))
    earlier = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocked.groupBy(*keys, "_block").agg(F.max("_v").alias("_last"))
    blocks = blocks.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("_block").alias("_b"), F.max("_last").over(earlier).alias("_carried"))
    here = W.partitionBy(*keys, "_block").orderBy("turn").rangeBetween(W.unboundedPreceding, upto)
    blocked = blocked.withColumn("_here", F.max("_v").over(here))
    same = F.col("_block").eqNullSafe(F.col("_b"))
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    joined = blocked.join(blocks, same)
    return joined.withColumn(name, F.greatest("_here", "_carried")).drop("_v", "_block", "_b", "_here", "_carried", *(f"_{k}" for k in keys))


def quoted_passages(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, level, passage) of all that messages quote, written out."""
    return staged(messages.where("depth > 0 and conv_id is not null and turn is not null").select("conv_id", "turn", F.inline(quoted(F.col("lines")))).distinct(), "quoting")


def quote_links(messages: DataFrame, quoting: DataFrame) -> DataFrame:
    """(conv_id, turn, quoted_turn): the latest earlier message whose text or line the message quotes at the shallowest level known."""
    original = messages.select("conv_id", "turn", F.explode(hashes(F.concat(F.split("content", "\n"), F.array("content")))).alias("passage"))
    original = original.join(quoting.select("conv_id", "passage").distinct().hint("merge"), ["conv_id", "passage"], "left_semi")
    events = original.select("conv_id", "passage", "turn", F.col("turn").alias("source"), F.lit(None).cast("int").alias("level"))
    events = events.union(quoting.select("conv_id", "passage", "turn", F.lit(None).cast("bigint"), "level"))
    met = running_max(events, ["conv_id", "passage"], F.col("source"), "latest", -1).where("level is not null and latest is not null")
    return met.groupBy("conv_id", "turn").agg(F.max_by("latest", F.struct(-F.col("level"), "latest")).alias("quoted_turn"))


def in_order(messages: DataFrame) -> DataFrame:
    """Messages with `before` (the previous turn) and `place` (from 1, by turn); long conversations are dealt in blocks."""
    rows = messages.withColumn("block", F.floor(F.col("turn") / BLOCK))
    blocks = rows.groupBy("conv_id", "block").agg(F.count("*").alias("n"))
    earlier = W.partitionBy("conv_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.select(F.col("conv_id").alias("_c"), F.col("block").alias("_b"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    rows = rows.withColumn("here", F.row_number().over(W.partitionBy("conv_id", "block").orderBy("turn", "role", "content")))
    rows = rows.join(blocks, F.col("conv_id").eqNullSafe(F.col("_c")) & F.col("block").eqNullSafe(F.col("_b"))).drop("_c", "_b")
    rows = rows.withColumn("place", F.col("base") + F.col("here")).drop("base", "here")
    known = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    return running_max(rows, ["conv_id"], F.when(known, F.col("turn")), "before", -1).withColumn("before", F.when(known, F.col("before")))


def siblings(heads: DataFrame) -> DataFrame:
    """heads with `older` (whether none of the runs at the same one comes before) and `next` (the one that comes after).

    Runs that branch off one come by the turn they reply to, the latest first, then by their own. They are sorted all
    together, so that one with very many is dealt over tasks, and neighbours across tasks are found by the first of each."""
    order = ["conv_id", "up", F.desc("attach"), "head"]
    dealt = staged(heads.orderBy(*order).withColumn("part", F.spark_partition_id()), "siblings")
    here = W.partitionBy("conv_id", "up", "part").orderBy(F.desc("attach"), "head")
    rows = dealt.withColumn("after", F.lead("head").over(here)).withColumn("nth", F.row_number().over(here))
    firsts = rows.where("nth = 1").select("conv_id", "up", "part", F.col("head").alias("first"))
    parts = W.partitionBy("conv_id", "up").orderBy("part")
    firsts = firsts.select(F.col("conv_id").alias("_c"), F.col("up").alias("_u"), F.col("part").alias("_p"), F.lead("first").over(parts).alias("across"), F.row_number().over(parts).alias("_nth"))
    joined = rows.join(firsts, (F.col("conv_id") == F.col("_c")) & F.col("up").eqNullSafe(F.col("_u")) & (F.col("part") == F.col("_p")))
    return joined.select("conv_id", "head", "up", ((F.col("nth") == 1) & (F.col("_nth") == 1)).alias("older"), F.coalesce("after", "across").alias("next"))


def run_bases(sizes: DataFrame, heads: DataFrame, rounds: int = 64) -> DataFrame:
    """sizes (conv_id, head, n, ...) of conversations that branch, with `base`, the messages of its runs that come before.

    heads: conv_id, head, up, each run that branches off the one whose head is up (null for a conversation's first)."""
    known = sizes.join(heads.select("conv_id").distinct(), "conv_id", "left_semi")
    step = lambda leaves, head: F.struct(F.lit(leaves).alias("leaves"), head.isNotNull().alias("branch"), F.coalesce(head, F.lit(0)).cast("bigint").alias("head"))
    beside = siblings(heads)
    first = beside.where("older").select(F.col("conv_id").alias("_c"), F.col("up").alias("_u"), F.col("head").alias("child"))
    entering = known.join(first, (F.col("conv_id") == F.col("_c")) & F.col("head").eqNullSafe(F.col("_u")), "left")
    into = F.when(F.col("child").isNotNull(), step(False, F.col("child"))).otherwise(step(True, F.col("head")))
    entering = entering.select("conv_id", step(False, F.col("head")).alias("step"), into.alias("to"), "n")
    after = F.when(F.col("next").isNotNull(), step(False, F.col("next"))).otherwise(step(True, F.col("up")))
    leaving = beside.select("conv_id", step(True, F.col("head")).alias("step"), after.alias("to"), F.lit(0).cast("bigint").alias("n"))
    ends = known.where("head is null").select("conv_id", step(True, F.col("head")).alias("step"), F.lit(None).cast(entering.schema["to"].dataType).alias("to"), F.lit(0).cast("bigint").alias("n"))
    tour = staged(entering.unionByName(leaving).unionByName(ends), "tour")
    for _ in range(rounds):
        if tour.where("to is not null").isEmpty():
            break
        there = tour.select("conv_id", F.col("step").alias("to"), F.col("to").alias("_next"), F.col("n").alias("_n"))
        tour = staged(tour.join(there, ["conv_id", "to"], "left").select("conv_id", "step", F.col("_next").alias("to"), (F.col("n") + F.coalesce("_n", F.lit(0))).alias("n")), "tour")
    rest = tour.where("not step.leaves").select("conv_id", F.when(F.col("step.branch"), F.col("step.head")).alias("_h"), F.col("n").alias("rest"))
    whole = rest.where("_h is null").select("conv_id", F.col("rest").alias("whole"))
    bases = rest.join(whole, "conv_id").select(F.col("conv_id").alias("_c"), "_h", (F.col("whole") - F.col("rest")).alias("base"))
    return known.join(bases, (F.col("conv_id") == F.col("_c")) & F.col("head").eqNullSafe(F.col("_h"))).drop("_c", "_h")


def linked_conversations(messages: DataFrame) -> DataFrame:
    """Per message: conv_id, turn, role, parent_turn, by_quote, quote_depth, position (in the order of replies), content."""
    rows = parsed(messages.withColumn("turn", F.col("turn").cast("bigint")))
    ordered = in_order(rows.drop("lines"))
    quoting = quoted_passages(rows)
    if quoting.isEmpty():  # nobody quotes anything, so that all reply to the one before
        headed, heads = ordered.withColumn("quoted_turn", F.lit(None).cast("bigint")), None
    else:
        links = quote_links(rows, quoting).withColumnsRenamed({"conv_id": "_c", "turn": "_t"})
        joined = ordered.join(links, (F.col("conv_id") == F.col("_c")) & (F.col("turn") == F.col("_t")), "left").drop("_c", "_t")
        branches = F.col("quoted_turn").isNotNull() & ~F.col("quoted_turn").eqNullSafe(F.col("before"))
        headed = staged(running_max(joined, ["conv_id"], F.when(branches, F.col("turn")), "head"), "messages")
        known = headed.where("conv_id is not null and turn is not null")
        heads = known.where(branches).select("conv_id", F.col("turn").alias("head"), F.col("quoted_turn").alias("attach")).distinct()
        # several rows can have one turn
        owner = known.select("conv_id", F.col("turn").alias("attach"), F.col("head").alias("up")).distinct()
        heads = staged(heads.join(owner, ["conv_id", "attach"]), "heads")
    if heads is None or heads.isEmpty():
        position = F.when(F.col("conv_id").isNotNull() & F.col("turn").isNotNull(), F.col("place"))
        return _result(headed, position)
    sizes = known.groupBy("conv_id", "head").agg(F.count("*").alias("n"), F.min("place").alias("first"), F.min("block").alias("low"), F.max("block").alias("high"))
    runs = run_bases(sizes, heads)
    # a run may hold most rows: it is met block by block
    spread = runs.select(F.col("conv_id").alias("_c"), F.col("head").alias("_h"), (F.col("base") - F.col("first") + 1).alias("shift"), F.explode(F.sequence("low", "high")).alias("_b"))
    placed = headed.join(spread, (F.col("conv_id") == F.col("_c")) & F.col("head").eqNullSafe(F.col("_h")) & (F.col("block") == F.col("_b")), "left")
    return _result(placed, F.when(F.col("conv_id").isNotNull() & F.col("turn").isNotNull(), F.col("place") + F.coalesce("shift", F.lit(0))))


def _result(placed: DataFrame, position) -> DataFrame:
    return placed.select(
        F.col("conv_id"), F.col("turn"), "role", F.coalesce("quoted_turn", "before").alias("parent_turn"), F.col("quoted_turn").isNotNull().alias("by_quote"),
        F.col("depth").cast("long").alias("quote_depth"), position.cast("long").alias("position"), "content")


def rendered(linked: DataFrame) -> DataFrame:
    """Each message with `chat`, its text under its role's mark; ordered by position they make the conversation."""
    role, content = F.coalesce("role", F.lit("user")), F.regexp_replace("content", r"<\|", "< |")
    return linked.withColumn("chat", F.concat(F.lit("<|im_start|>"), role, F.lit("\n"), content, F.lit("<|im_end|>\n")))


#: The same in DuckDB, over a view named conversations.
SQL = r"""
WITH RECURSIVE l AS (
  SELECT row_number() OVER () AS rid, conv_id, CAST(turn AS BIGINT) AS turn, role,
         list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: {
           'level': length(regexp_replace(regexp_extract(x, '^[ \t]*(?:>[ \t]?)+', 0), '[^>]', '', 'g')),
           'body': regexp_replace(x, '^[ \t]*(?:>[ \t]?)+', '')}) AS lines
  FROM conversations),
d AS (SELECT *, coalesce(list_max(list_transform(lines, lambda x: x.level)), 0) AS depth FROM l),
p AS (SELECT *, trim(regexp_replace(array_to_string(list_transform(list_filter(lines, lambda x: x.level = 0 AND NOT (depth > 0
        AND regexp_matches(x.body, '^[ \t]*(On|Le|Am|El) .*(wrote|écrit|schrieb|escribió) ?:[ \t]*$'))), lambda x: x.body), chr(10)), '^\s+|\s+$', '', 'g'), ' ') AS content FROM d),
v AS (SELECT conv_id, turn, lines, unnest(generate_series(1, CAST(depth AS BIGINT))) AS lv FROM p WHERE depth > 0),
q AS (SELECT DISTINCT conv_id, turn, lv, trim(regexp_replace(lower(u), '[ \t\r\n\f]+', ' ', 'g')) AS unit FROM (
        SELECT conv_id, turn, lv, unnest(list_concat(
          list_transform(string_split(array_to_string(list_transform(lines, lambda x: CASE WHEN x.level = lv THEN x.body ELSE chr(1) END), chr(10)), chr(1)), lambda x: trim(x, chr(10))),
          list_transform(list_filter(lines, lambda x: x.level = lv), lambda x: x.body))) AS u FROM v)),
o AS (SELECT DISTINCT conv_id, turn AS source, trim(regexp_replace(lower(u), '[ \t\r\n\f]+', ' ', 'g')) AS unit FROM (
        SELECT conv_id, turn, unnest(list_append(string_split(content, chr(10)), content)) AS u FROM p)),
k AS (SELECT conv_id, turn, source AS quoted_turn FROM (SELECT q.conv_id, q.turn, source, row_number() OVER (PARTITION BY q.conv_id, q.turn ORDER BY lv, source DESC) AS r
        FROM q JOIN o USING (conv_id, unit) WHERE unit <> '' AND source < q.turn) WHERE r = 1),
s AS (SELECT *, CASE WHEN conv_id IS NOT NULL AND turn IS NOT NULL THEN max(turn) OVER (PARTITION BY conv_id ORDER BY turn RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS before,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, content) AS place FROM p),
j AS (SELECT s.*, quoted_turn, quoted_turn IS NOT NULL AND quoted_turn IS DISTINCT FROM before AS jump FROM s LEFT JOIN k ON s.conv_id = k.conv_id AND s.turn = k.turn),
h AS (SELECT *, max(CASE WHEN jump THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS head FROM j),
b AS (SELECT DISTINCT a.conv_id, a.turn AS head, a.quoted_turn AS attach, u.head AS up FROM h a JOIN h u ON u.conv_id = a.conv_id AND u.turn = a.quoted_turn WHERE a.jump),
w AS (SELECT conv_id, head, [-attach, head] AS path FROM b WHERE up IS NULL
      UNION ALL SELECT b.conv_id, b.head, list_concat(w.path, [-b.attach, b.head]) FROM b JOIN w ON b.conv_id = w.conv_id AND b.up = w.head),
n AS (SELECT conv_id, head, count(*) AS n, min(place) AS first FROM h WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL),
r AS (SELECT n.conv_id, n.head, first, coalesce(sum(n) OVER (PARTITION BY n.conv_id ORDER BY coalesce(path, CAST([] AS BIGINT[])) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base
      FROM n LEFT JOIN w ON n.conv_id = w.conv_id AND n.head = w.head)
SELECT h.conv_id, h.turn, role, coalesce(quoted_turn, before) AS parent_turn, quoted_turn IS NOT NULL AS by_quote,
       CAST(depth AS BIGINT) AS quote_depth, CAST(place - first + base + 1 AS BIGINT) AS position, content
FROM h LEFT JOIN r ON h.conv_id = r.conv_id AND h.head IS NOT DISTINCT FROM r.head AND h.turn IS NOT NULL
"""
