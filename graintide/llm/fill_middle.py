"""Fill-in-the-middle examples by ropes.

A text becomes a rope: a balanced tree whose leaves hold whole units (white space and the word after it) and cache how
many units and code points they have, as inner nodes do for what is below them. Two unit ranks split the tree into
prefix, middle and suffix; these are joined in another order with sentinels between them, and read off once. The way
back builds a rope of the output, splits it at the code points where the sentinels stand, and joins the parts.

Defined cases: a null text is empty; an empty text, one that holds a sentinel, and one that isn't drawn stay plain, so
that their output is the text; a text of white space is one unit; a null id is drawn as if it were written `null`;
repeated rows and ids give a row each; an empty table gives no rows; columns beside id and text take no part.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graintide.session import small_batches

UNIT = re.compile(r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++")
#: Units of a full leaf; any word but the last few of a text is in one.
LEAF_UNITS = 64
LEAF = re.compile(r"(?:[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++){1,%d}+|[\x20\x09-\x0D]++" % LEAF_UNITS)
#: Code points of a leaf where units don't matter.
LEAF_CHARS = 4096
SENTINELS = ("<P>", "<S>", "<M>")


class Rope:
    """A leaf (text is set) or a node of two ropes; both know their units, code points and height."""

    __slots__ = ("text", "left", "right", "units", "chars", "height")

    def __init__(self, text: str | None, units: int, left: "Rope | None" = None, right: "Rope | None" = None):
        self.text, self.left, self.right = text, left, right
        if text is None:
            self.units, self.chars = left.units + right.units, left.chars + right.chars
            self.height = 1 + max(left.height, right.height)
        else:
            self.units, self.chars, self.height = units, len(text), 0

    def __str__(self) -> str:
        out, todo = [], [self]
        while todo:
            node = todo.pop()
            if node.text is None:
                todo += (node.right, node.left)
            else:
                out.append(node.text)
        return "".join(out)

    def by_units(self, rank: int) -> tuple["Rope", "Rope"]:
        """The first `rank` units, and the rest."""
        return self._split(rank, "units")

    def by_chars(self, rank: int) -> tuple["Rope", "Rope"]:
        return self._split(rank, "chars")

    def _split(self, rank: int, measure: str) -> tuple["Rope", "Rope"]:
        if rank <= 0:
            return EMPTY, self
        if rank >= getattr(self, measure):
            return self, EMPTY
        if self.text is not None:
            if measure == "chars":
                return Rope(self.text[:rank], 0), Rope(self.text[rank:], 0)
            at = 0
            for _ in range(rank):
                at = UNIT.match(self.text, at).end()
            return Rope(self.text[:at], rank), Rope(self.text[at:], self.units - rank)
        before = getattr(self.left, measure)
        if rank <= before:
            one, two = self.left._split(rank, measure)
            return one, joined(two, self.right)
        one, two = self.right._split(rank - before, measure)
        return joined(self.left, one), two


EMPTY = Rope("", 0)


def joined(*ropes: Rope) -> Rope:
    """The ropes one after another; a lower one goes down the side of a higher one, so that the height stays logarithmic."""
    whole = EMPTY
    for rope in ropes:
        whole = _pair(whole, rope)
    return whole


def _pair(a: Rope, b: Rope) -> Rope:
    if not a.chars:
        return b
    if not b.chars:
        return a
    if a.height > b.height + 1:
        return Rope(None, 0, a.left, _pair(a.right, b))
    if b.height > a.height + 1:
        return Rope(None, 0, _pair(a, b.left), b.right)
    return Rope(None, 0, a, b)


def _balanced(level: list[Rope]) -> Rope:
    while len(level) > 1:
        level = [Rope(None, 0, *level[k : k + 2]) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
    return level[0] if level else EMPTY


def rope_of_units(text: str) -> Rope:
    leaves = LEAF.findall(text)
    # all leaves are full but the last one of words and one of white space at the end
    full = max(0, len(leaves) - 2)
    return _balanced([Rope(x, LEAF_UNITS) for x in leaves[:full]] + [Rope(x, len(UNIT.findall(x))) for x in leaves[full:]])


def rope_of_chars(text: str) -> Rope:
    return _balanced([Rope(text[k : k + LEAF_CHARS], 0) for k in range(0, len(text), LEAF_CHARS)])


def draws(seed: int, key: object) -> tuple[int, int, int, int]:
    """Four numbers below 2**32 that follow from seed and key."""
    digest = hashlib.sha256(f"{seed}:{'null' if key is None else key}".encode()).hexdigest()
    return tuple(int(digest[k : k + 8], 16) for k in range(0, 32, 8))


def transform(text: str, key: object, seed: int, percent: int, spm_percent: int, sentinels: tuple[str, str, str]) -> tuple[int, str, int | None, int | None, str]:
    """Units, form, code points of prefix and middle (None if plain), output."""
    rope = rope_of_units(text)
    first, second, drawn, order = draws(seed, key)
    if not text or drawn % 100 >= percent or any(s in text for s in sentinels):
        return rope.units, "plain", None, None, text
    low, high = sorted((first % (rope.units + 1), second % (rope.units + 1)))
    head, suffix = rope.by_units(high)
    prefix, middle = head.by_units(low)
    p, s, m = (Rope(x, 0) for x in sentinels)
    spm = order % 100 < spm_percent
    out = joined(s, suffix, p, prefix, m, middle) if spm else joined(p, prefix, s, suffix, m, middle)
    return rope.units, "spm" if spm else "psm", prefix.chars, middle.chars, str(out)


def invert(output: str, form: str, sentinels: tuple[str, str, str]) -> str:
    """The text that became this output; a sentinel that is missing is an error."""
    if form == "plain":
        return output
    marks = [sentinels[k] for k in ((1, 0, 2) if form == "spm" else (0, 1, 2))]
    places, at = [], 0
    for mark in marks:
        places.append(output.index(mark, at))
        at = places[-1] + len(mark)
    rest, last = rope_of_chars(output).by_chars(places[2])
    rest, second = rest.by_chars(places[1])
    parts = [part.by_chars(len(mark))[1] for part, mark in zip((rest, second, last), marks, strict=True)]
    prefix, suffix = (parts[1], parts[0]) if form == "spm" else (parts[0], parts[1])
    return str(joined(prefix, parts[2], suffix))


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, percent: int = 50, spm_percent: int = 80, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """Per document: doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars, output."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        for batch in batches:
            found = [transform(t or "", key, seed, percent, spm_percent, sentinels) for key, t in zip(*(batch.column(k).to_pylist() for k in (0, 1)), strict=True)]
            cols = [pa.array(col, kind) for col, kind in zip(zip(*found, strict=True) if found else [[]] * 5, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(examples: DataFrame, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """examples with `restored`, rebuilt from output and form alone; null where one of these is null."""
    small_batches(examples.sparkSession)
    names = [c for c in examples.columns if c != "restored"]
    at, form_at = names.index("output"), names.index("form")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column(at).to_pylist(), batch.column(form_at).to_pylist(), strict=True)
            texts = [None if x is None or form is None else invert(x, form, sentinels) for x, form in pairs]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*names, "restored"])

    kept = examples.select(*names)
    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField("restored", T.StringType())]))


#: The same by lists of units, as a check.
SQL = r"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
         sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h FROM documents),
drawn AS (
  SELECT *, len(u) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM units),
cut AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain'
              WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
parts AS (
  SELECT *, array_to_string(u[1:lo], '') AS p, array_to_string(u[lo + 1:hi], '') AS m, array_to_string(u[hi + 1:n], '') AS s FROM cut)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts
"""
