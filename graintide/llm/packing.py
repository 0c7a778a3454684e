"""Packing of tokenised documents by shortest-pack-first over the length histogram.

Documents become token ids with an end id, cut into pieces of at most `width`. The histogram of piece lengths (at
most `width` rows) goes to the driver, where lengths are placed longest first, each into the pack that is shortest so
far; where not even that has room, as many new packs open as the rest of that length fills. Packs are never listed one
by one: a pattern holds the lengths in a pack, each with how often, and how many packs share them. Pieces are ranked
within their length, and each rank is looked up in the patterns.

Lengths that don't fit one another leave gaps, as where all pieces are longer than half a pack. Packs with a gap of more
than one in TOLERANCE are taken apart: their pieces are cut along a chain of lengths that divide one another (powers of
two, where the width is one), and these parts, longest first, fill packs without any gap. What is left at the end
becomes packs of one such length each, which for powers of two need no padding. Tokenising has given every piece the
checksums of its parts, so that cutting reads no ids.

Defined cases: a null text is empty and becomes the end id alone; no documents give no rows; documents with the same
id are packed apart, each as its own; equal lengths throughout, or null texts only, fill packs like any others; columns
beside id and text take no part.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graintide.llm.bytebpe import ByteBpe
from graintide.session import shuffle_partitions, small_batches, staged

WIDTH, END_ID = 1024, 0
#: A pack whose gap is more than this part of its width is taken apart.
TOLERANCE = 50


def chain_of(width: int) -> list[int]:
    """Lengths from below width to 1, each of which divides the one before and the width."""
    chain = [width]
    while chain[-1] > 1:
        n = chain[-1]
        chain.append(n // next(p for p in range(2, n + 1) if n % p == 0))
    return chain[1:]


def parts_of(length: int, width: int) -> list[tuple[int, int]]:
    """(start, length) of the parts that a piece is cut into along the chain, longest first."""
    out, at = [], 0
    for n in chain_of(width):
        while length - at >= n:
            out.append((at, n))
            at += n
    return out


def token_pieces(docs: DataFrame, vocab: str, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, end_id: int = END_ID, keep_ids: bool = True) -> DataFrame:
    """Per piece: doc_id, start, length, doc_tokens, ids_crc32, part_crcs and, with keep_ids, ids (little-endian unsigned 32-bit)."""
    small_batches(docs.sparkSession)
    schema = "doc_id long, row_key long, start long, length long, ids_crc32 long, doc_tokens long, part_crcs array<long>" + (", ids binary" if keep_ids else "")
    parts = [parts_of(n, width) for n in range(width)]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = ByteBpe.of(vocab)
        for batch in batches:
            cols: list[list] = [[] for _ in range(8)]
            for doc_id, key, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                ids = np.append(coder.encode(text or ""), end_id).astype("<u4")
                for start in range(0, len(ids), width):
                    raw = ids[start : start + width].tobytes()
                    n = len(raw) // 4
                    crcs = [zlib.crc32(raw[4 * a : 4 * (a + m)]) for a, m in parts[n]] if n < width else None
                    for col, v in zip(cols, (doc_id, key, start, n, zlib.crc32(raw), len(ids), crcs, raw), strict=True):
                        col.append(v)
            kinds = [pa.int64()] * 6 + [pa.list_(pa.int64()), pa.binary()]
            arrays = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)][: 8 if keep_ids else 7]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "row_key", "start", "length", "ids_crc32", "doc_tokens", "part_crcs", "ids"][: len(arrays)])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("row_key"), F.col(text_col).alias("text"))
    return rows.mapInArrow(cut, schema)


#: Lengths in a pack, each with how often, and the number of such packs.
Pattern = tuple[list[tuple[int, int]], int]


def shortest_pack_first(histogram: dict[int, int], width: int = WIDTH) -> list[Pattern]:
    """Patterns that hold every piece of the histogram once."""
    packs: list[tuple[int, int, list[tuple[int, int]], int]] = []  # used, tie-breaker, lengths, number
    serial = 0

    def put(used: int, lengths: list[tuple[int, int]], number: int) -> None:
        nonlocal serial
        serial += 1
        if number:
            heapq.heappush(packs, (used, serial, lengths, number))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left and packs and packs[0][0] + length <= width:
            used, _, lengths, number = heapq.heappop(packs)
            taken = min(left, number)
            put(used, lengths, number - taken)
            again = lengths[-1][0] == length
            put(used + length, [*lengths[:-1], (length, lengths[-1][1] + 1)] if again else [*lengths, (length, 1)], taken)
            left -= taken
        if left:
            # new packs for the rest of this length: dealt to the shortest in turn, they differ by one piece at most
            number = -(-left // (width // length))
            each, more = divmod(left, number)
            put((each + 1) * length, [(length, each + 1)], more)
            put(each * length, [(length, each)], number - more)
    return [(lengths, number) for _, _, lengths, number in sorted(packs)]


def placements(patterns: list[Pattern], width: int = WIDTH) -> tuple[list[tuple], int, int]:
    """Where ranks of each length go, the first sequence of taken packs, and the tokens of their parts.

    Each place is (length, first rank, end rank, part, part start, part length, packs, first sequence, offset). Of the
    ranks of a pattern that stays every `packs` make one more piece in each of its packs; parts of packs taken apart lie one after
    another from `offset`, with packs null."""
    taken: dict[int, int] = {}
    places: list[tuple] = []
    apart: list[tuple[int, int, int]] = []  # length, first rank, end rank
    sequence = 0
    for lengths, packs in patterns:
        gap = width - sum(n * times for n, times in lengths)
        offset = 0
        for length, times in lengths:
            first = taken.get(length, 0)
            taken[length] = end = first + packs * times
            if gap * TOLERANCE > width:
                apart.append((length, first, end))
            else:
                places.append((length, first, end, -1, 0, length, packs, sequence, offset))
            offset += length * times
        sequence += packs if gap * TOLERANCE <= width else 0
    at = 0
    for n in chain_of(width) or [1]:
        for length, first, end in sorted(apart, reverse=True):
            for part, (start, size) in enumerate(parts_of(length, width)):
                if size == n:
                    places.append((length, first, end, part, start, size, None, sequence, at))
                    at += (end - first) * n
    return places, sequence, at


def ranked_by_length(pieces: DataFrame) -> DataFrame:
    """pieces with `rank`, gapless from 0 within each length; a length that most pieces have is dealt over many tasks."""
    salts = max(2, shuffle_partitions(pieces.sparkSession))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "row_key", "start"), F.lit(salts)))
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    bases = counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    order = W.partitionBy("length", "salt").orderBy("doc_id", "row_key", "start", "ids_crc32")
    placed = salted.withColumn("place", F.row_number().over(order).cast("long") - 1)
    return placed.join(bases, ["length", "salt"]).withColumn("rank", F.col("base") + F.col("place")).drop("salt", "place", "base")


def pack(pieces: DataFrame, width: int = WIDTH) -> DataFrame:
    """pieces (written once, since they are counted first), cut where packs are taken apart, with sequence_id and offset."""
    pieces = staged(pieces, "pieces")
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `width` rows
    places, first_apart, tokens_apart = placements(shortest_pack_first(histogram, width), width)
    names = "length long, lo long, hi long, part int, part_start long, part_length long, packs long, first_sequence long, first_offset long"
    # the places follow from at most `width` lengths, however many documents there are
    side = F.broadcast(spark.createDataFrame(places, names))
    ranked = ranked_by_length(pieces)
    joined = ranked.join(side, (ranked["length"] == side["length"]) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))).drop(side["length"])
    nth = F.col("rank") - F.col("lo")
    at = F.col("first_offset") + nth * F.col("part_length")
    whole_packs = tokens_apart // width
    sequence, offset = F.lit(first_apart) + F.floor(at / width), at % width
    for k, (start, size) in enumerate(parts_of(tokens_apart % width, width)):
        rest = at - whole_packs * width
        inside = (rest >= start) & (rest < start + size)
        sequence, offset = F.when(inside, F.lit(first_apart + whole_packs + k)).otherwise(sequence), F.when(inside, rest - start).otherwise(offset)
    stays = F.col("packs").isNotNull()
    cut = F.col("part") >= 0
    columns = {
        "start": F.col("start") + F.col("part_start"), "length": F.col("part_length"), "ids_crc32": F.when(cut, F.get("part_crcs", F.col("part"))).otherwise(F.col("ids_crc32")),
        "sequence_id": F.when(stays, F.col("first_sequence") + nth % F.col("packs")).otherwise(sequence).cast("long"),
        "offset": F.when(stays, F.col("first_offset") + F.floor(nth / F.col("packs")) * F.col("part_length")).otherwise(offset).cast("long"),
    }
    if "ids" in pieces.columns:
        columns["ids"] = F.expr("substring(ids, cast(4 * part_start + 1 as int), cast(4 * part_length as int))")
    placed = joined.withColumns(columns)
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if "ids" in pieces.columns else []), "sequence_id", "offset")


def pack_documents(docs: DataFrame, vocab: str, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, end_id: int = END_ID, keep_ids: bool = True) -> DataFrame:
    """Tokenise, cut and pack; one row per piece."""
    return pack(token_pieces(docs, vocab, id_col, text_col, width, end_id, keep_ids), width)
