"""N-gram Jaccard self-join by T-occurrence search (DivideSkip), and the groups that its links form.

Where sets can meet: two sets linked at p percent differ in at most size * (100 - p) / p shingles, size being the
smaller one's. The shingle space is cut into more classes than that, so that linked sets agree on a whole class. Each
set sends a signature of each class, for the band of sizes that it is in and for the one below. A set can leave out
its few smallest classes, since classes exceed the bound by that number. This loses no link.

A signature has a leader, the first set that is met with it, and each other set that has it is tied to the leader by
so many signatures. Sets linked share more signatures than they may both set aside, so that each set can cut its
weakest ties up to half of what it has to spare: texts that merely share a passage come apart here, and no link is
lost. Sets tied by what is left, directly or along others, form a block. In a block the shingles are inverted lists. A
set needs T of its lists. DivideSkip sets L of the longest aside, L following from T and the longest; the others are
merged by a heap, which skips what can't be in T - L of them, and what is left is probed in the long ones by binary
search. Pairs that are already in one group aren't tested again, a block stops once it is one group, and of the links
a spanning forest is returned, so that a group of n near copies makes at most n rows. A large block is cut by bands of sizes, in
each of which its sets meet one another and those of the next band; where that is still large, it is cut into parts,
and each two parts meet in a task of their own.

Shingles are 64-bit hashes, under a key that is drawn for each job, so that no texts can be written whose shingles meet.

Defined cases: null and empty texts have no set and link with nothing; texts with fewer words than a shingle have
their whole word sequence as the one shingle; equal sets always link; rows with one id are one document with the
union of links; a null id is kept as a row with a null component; an empty table gives no rows; columns beside id and
text take no part.
"""

from __future__ import annotations

import bisect
import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graintide.llm.components import connected_components
from graintide.llm.wordbytes import blobs, give_back, hashed_words, mix, new_key, window_hash
from graintide.session import shuffle_partitions, small_batches, staged, staged_alone

#: Shingles of a block that one task takes from each of its two parts.
PART_SHINGLES = 2_000_000
#: Members of blocks up to which they are broadcast to the second reading of the texts (40 bytes each).
BROADCAST_ROWS = 500_000
CHUNK_POSTINGS = 1_500_000
#: What a step of the heap costs against a binary probe, as DivideSkip weighs them.
MU = 0.0085


def shingle_sets(texts: list[str | None], words: int, secret: int = 0) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text, A-Z lower-cased."""
    for first, end, raw, offsets in blobs(texts):
        starts, _, h = hashed_words(raw, lower=True, key=secret)
        edge = np.searchsorted(starts, offsets)
        spans = window_hash(h, words)
        for k in range(end - first):
            a, b = edge[k], edge[k + 1]
            if b - a >= words:
                s = np.sort(spans[a : b - words + 1])
                yield s[np.concatenate(([True], s[1:] != s[:-1]))]
            elif b > a:
                yield window_hash(h[a:b], int(b - a), seed=77)
            else:
                yield np.zeros(0, np.uint64)


def size_bands(percent: int, upto: int) -> list[tuple[int, int]]:
    """(smallest, largest) sizes; sets that can link are in one band or in neighbours."""
    bands, low = [], 1
    while low <= upto:
        bands.append((low, low * 100 // percent))
        low = bands[-1][1] + 1
    return bands


def class_plan(band: tuple[int, int], percent: int) -> tuple[int, int, int]:
    """(classes, how many of them can be missed, largest size of a small one); no classes where only equal sets link.

    Sets of the band that link, and such with one of the next band, agree on all classes but (classes - 1 - spare)."""
    low, high = band
    most = high * (100 - percent) // percent
    if most == 0:
        return 0, 0, 0
    for small in (2, 1, 0):
        spare = 1
        for _ in range(40):
            classes = most + 1 + spare
            mean = low / classes
            share = math.exp(-mean) * sum(mean**k / math.factorial(k) for k in range(small + 1))
            spare = math.ceil((1.15 * share + (100 - percent) / 100) * classes) + 1
            if spare > most + 4:
                break
        else:
            return most + 1 + spare, spare, small
    return most + 2, 1, 0


def signatures(s: np.ndarray, bands: list[tuple[int, int]], plans: list[tuple[int, int, int]], lows: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
    """Signatures of a set for its own band (0, as the smaller one) and the band below (1, as the larger): (0 or 1, how many it may cut, signatures).

    Small classes are left out where there are few enough; of what can then still be missed, each of two sets may cut half."""
    own = int(np.searchsorted(lows, len(s), side="right")) - 1
    out, scrambled, spread = [], mix(s, 5), mix(s, 9)
    for below in (0, 1):
        band = own - below
        if band < 0 or not plans[band][0]:
            continue
        classes, spare, small = plans[band]
        of = (spread % np.uint64(classes)).astype(np.int64)
        order = np.argsort(of, kind="stable")
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(scrambled[order], dtype=np.uint64)))
        sizes = np.bincount(of, minlength=classes)
        ends = np.cumsum(sizes)
        total = sums[ends] - sums[ends - sizes]
        sign = mix(mix(total, 13) + np.arange(classes, dtype=np.uint64), band + 1000)
        few = int((sizes <= small).sum())
        out.append((below, (spare - few) // 2, sign[sizes > small]) if few <= spare else (below, 0, sign))
    return out


SETS, SIGNS = 0, 1
#: Of a signature so many bytes travel, beside its bucket; equal ones of unequal classes only add candidates.
SIGN_BYTES = 6
#: Signatures that are met at once, or as many as there are distinct ones so far.
MEET_SIGNS = 1_000_000


def describe(docs: DataFrame, words: int, percent: int, buckets: int, secret: int) -> DataFrame:
    """Two kinds of rows, from one reading of the texts.

    SETS: id a, set size b, digest (128 bits of the set). SIGNS: bucket a, smallest id b and a payload of signatures of a
    batch with the sets that have them; of equal sets in a batch one sends them."""
    small_batches(docs.sparkSession)
    names = ["kind", "a", "b", "digest", "payload"]
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary())

    def rows(made: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([m[k] for m in made], kind) for k, kind in enumerate(kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=1)
        bands = size_bands(percent, 1 << 40)
        plans = [class_plan(b, percent) for b in bands]
        lows = np.array([b[0] for b in bands])
        for batch in batches:
            made: list[tuple] = []
            signs, senders, seen = [np.zeros(0, np.uint64)], [], set()
            for row_id, s in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1).to_pylist(), words, secret), strict=True):
                digest = np.array([mix(s, 21).sum(dtype=np.uint64), mix(s, 22).sum(dtype=np.uint64)], np.uint64).tobytes() if len(s) else None
                made.append((SETS, row_id, len(s), digest, None))
                if len(s) and row_id is not None and digest not in seen:
                    seen.add(digest)
                    for below, cut, sign in signatures(s, bands, plans, lows):
                        signs.append(sign)
                        senders.append((row_id, cut, below))
            sign = np.concatenate(signs)
            sender = np.array(senders, np.int64).reshape(-1, 3)
            owner = np.repeat(np.arange(len(sender)), [len(x) for x in signs[1:]])
            bucket = (mix(sign, 51) % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((sender[owner, 0], sign, bucket))
            sign, owner, bucket = sign[order], owner[order], bucket[order]
            # a batch of null, empty or short texts only has no signatures
            cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))).tolist() if len(sign) else []
            for at, end in zip(cuts, [*cuts[1:], len(sign)][: len(cuts)], strict=True):
                here, local = np.unique(owner[at:end], return_inverse=True)
                head = np.array([len(here), end - at], np.int64).tobytes() + sender[here].tobytes() + local.astype(np.uint32).tobytes()
                packed = sign[at:end].view(np.uint8).reshape(-1, 8)[:, :SIGN_BYTES].tobytes()
                made.append((SIGNS, int(bucket[at]), int(sender[here, 0].min()), None, squeeze.compress(head + packed)))
            yield rows(made)
        give_back()

    return docs.mapInArrow(run, "kind int, a long, b long, digest binary, payload binary")


class Meeting:
    """Signatures of one bucket as they arrive, each with its leader; holds distinct signatures, not their sets."""

    def __init__(self):
        self.known, self.leader = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def ties(self, payloads: list[bytes]) -> pa.RecordBatch:
        signs, senders, owners, count = [], [], [], 0
        for data in (np.frombuffer(p, np.uint8) for p in payloads):
            sets, n = (int(x) for x in data[:16].view(np.int64))
            at, end = 16 + 24 * sets, 16 + 24 * sets + 4 * n
            senders.append(data[16:at].view(np.int64).reshape(-1, 3))
            owners.append(data[at:end].view(np.uint32).astype(np.int64) + count)
            wide = np.zeros((n, 8), np.uint8)
            wide[:, :SIGN_BYTES] = data[end:].reshape(n, SIGN_BYTES)
            signs.append(wide.reshape(-1).view(np.uint64))
            count += sets
        sign, owner, sender = np.concatenate(signs), np.concatenate(owners), np.concatenate(senders)
        order = np.argsort(sign, kind="stable")
        sign, owner = sign[order], owner[order]
        new = np.concatenate(([True], sign[1:] != sign[:-1]))
        heads, lead = sign[new], sender[owner[new], 0]
        spot = np.searchsorted(self.known, heads)
        old = np.zeros(len(heads), bool)
        inside = spot < len(self.known)
        old[inside] = self.known[spot[inside]] == heads[inside]
        lead[old] = self.leader[spot[old]]
        self.known, self.leader = np.insert(self.known, spot[~old], heads[~old]), np.insert(self.leader, spot[~old], lead[~old])
        led = lead[np.cumsum(new) - 1]
        tied = sender[owner, 0] != led
        owner, led = owner[tied], led[tied]
        order = np.lexsort((led, owner))
        owner, led = owner[order], led[order]
        first = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (led[1:] != led[:-1])))) if len(owner) else np.zeros(0, np.int64)
        times = np.diff(np.append(first, len(owner)))
        u, cut, below = sender[owner[first]].T
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (u, below, cut, led[first], times)], names=["u", "below", "cut", "v", "times"])


def shared_signatures(described: DataFrame) -> DataFrame:
    """(u, v): sets tied to the leaders of their signatures, without the weakest ties that each may cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        expand = zstandard.ZstdDecompressor()
        bucket, held, size, meeting = None, [], 0, Meeting()
        for batch in batches:
            for b, p in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if held and (b != bucket or size >= max(MEET_SIGNS, len(meeting.known))):
                    yield meeting.ties(held)
                    held, size = [], 0
                if b != bucket:
                    bucket, meeting = b, Meeting()
                held.append(expand.decompress(p))
                size += len(held[-1]) // (SIGN_BYTES + 4)
        if held:
            yield meeting.ties(held)
        give_back()

    n = shuffle_partitions(described.sparkSession)
    # payloads come in the order of their smallest ids, so that few sets lead
    sent = described.where(F.col("kind") == SIGNS).select("a", "b", "payload").repartition(n, "a").sortWithinPartitions("a", "b")
    ties = sent.mapInArrow(run, "u long, below long, cut long, v long, times long")
    ties = ties.groupBy("u", "below", "cut", "v").agg(F.sum("times").alias("times"))
    weakest = Window.partitionBy("u", "below").orderBy("times", "v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return ties.withColumn("upto", F.sum("times").over(weakest)).where("upto > cut").select("u", "v").distinct()


class Forest:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, k: int) -> int:
        while self.up[k] != k:
            self.up[k] = self.up[self.up[k]]
            k = self.up[k]
        return k

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def long_lists(least: int, lengths: np.ndarray) -> int:
    """How many of the longest lists to probe instead of merging: least / (MU * log2(longest) + 1), DivideSkip's balance of the two costs."""
    return min(least - 1, int(least / (MU * math.log2(max(2, int(lengths.max()))) + 1)))


def heap_merge(lists: list[list[int]], need: int) -> list[tuple[int, int]]:
    """(element, lists that hold it) of those in at least `need` of the ascending lists.

    A heap holds the next element of each list; where its smallest can't reach `need`, lists skip to the element that still can."""
    heap = [(one[0], k, 0) for k, one in enumerate(lists)]
    heapq.heapify(heap)
    found = []
    while len(heap) >= need:
        top, popped = heap[0][0], []
        while heap and heap[0][0] == top:
            popped.append(heapq.heappop(heap))
        if len(popped) >= need:
            found.append((top, len(popped)))
            target = top + 1
        else:
            while len(popped) < need - 1 and heap:
                popped.append(heapq.heappop(heap))
            if not heap:
                break
            target = heap[0][0]
        for _, k, at in popped:
            at = bisect.bisect_left(lists[k], target, at)
            if at < len(lists[k]):
                heapq.heappush(heap, (lists[k][at], k, at))
    return found


def t_occurrence(sets: list[np.ndarray], group: np.ndarray, side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links within each group, as positions. Sets of side 0 and 2 search those of side 1, those of side 2 each other too."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(n), sizes)
    token = np.concatenate(sets) ^ mix(group.astype(np.uint64), 31)[owner]
    order = np.lexsort((owner, token))
    sorted_token = token[order]
    new = np.concatenate(([True], sorted_token[1:] != sorted_token[:-1]))
    list_of_sorted = np.cumsum(new) - 1
    starts = np.append(np.flatnonzero(new), len(order))
    lengths = np.diff(starts)
    posted = owner[order]
    key = list_of_sorted * n + posted
    list_of = np.empty(len(order), np.int64)
    list_of[order] = list_of_sorted
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    forest, found = Forest(n), []
    trees = np.bincount(group)  # of each group; where one is left, there is nothing more to link
    tree = np.arange(n)
    for x in range(n):
        if side[x] == 1 or trees[group[x]] == 1:
            continue
        mine = list_of[offsets[x] : offsets[x + 1]]
        size = len(mine)
        least = -(-size * percent // 100)  # overlap with any set it can link to
        by_length = mine[np.argsort(lengths[mine], kind="stable")]
        if lengths[by_length[size - least]] == 1:
            continue  # no other set is in as many lists as it takes
        probed = long_lists(least, lengths[by_length])
        short, long = by_length[: size - probed], by_length[size - probed :]
        # what is of x's own group already, comes before it or has no fitting size is taken out before lists are merged
        each = lengths[short]
        spot = np.repeat(starts[short] - np.cumsum(each) + each, each) + np.arange(int(each.sum()))
        other = posted[spot]
        keep = (tree[other] != tree[x]) & ((side[other] == 1) | (side[x] == 2) & (side[other] == 2) & (other > x))
        keep &= (100 * sizes[other] >= percent * size) & (100 * size >= percent * sizes[other])
        if not keep.any():
            continue
        other, of = other[keep], np.repeat(np.arange(len(short)), each)[keep]
        lists = [one.tolist() for one in np.split(other, np.flatnonzero(of[1:] != of[:-1]) + 1)]
        merged = heap_merge(lists, least - probed)
        if not merged:
            continue
        near, count = np.array(merged, np.int64).T
        rank = np.argsort(-count, kind="stable")
        near, count = near[rank], count[rank]
        need = -(-percent * (size + sizes[near]) // (100 + percent))  # 100 * o >= percent * (a + b - o)
        at, step = 0, 2
        while at < len(near):
            here = [k for k in range(at, min(at + step, len(near))) if forest.root(int(near[k])) != forest.root(x)]
            at, step = at + step, min(2 * step, 64)
            if not here:
                continue
            who, have, want = near[here], count[here].copy(), need[here]
            for part in range(0, len(long), 32):
                probe = long[part : part + 32]
                codes = probe[:, None] * n + who[None, :]
                spot = np.minimum(np.searchsorted(key, codes), len(key) - 1)
                have = have + (key[spot] == codes).sum(0)
                alive = have + (len(long) - part - len(probe)) >= want
                if not alive.all():
                    who, have, want = who[alive], have[alive], want[alive]
                    if not len(who):
                        break
            for y in who[have >= want]:
                if forest.join(x, int(y)):
                    found.append((x, int(y)))
                    trees[group[x]] -= 1
                    tree[tree == tree[y]] = tree[x]
    return found


def _search(percent: int):
    """mapInArrow function over rows sorted by block: row_id, block, side, shingles."""

    def links(rows: list[tuple]) -> list[tuple[int, int]]:
        ids = [r[0] for r in rows]
        group = np.unique(np.array([r[1] for r in rows]), return_inverse=True)[1]
        pairs = t_occurrence([np.frombuffer(r[3], np.uint64) for r in rows], group, np.array([r[2] for r in rows]), percent)
        return [(ids[a], ids[b]) for a, b in pairs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(found: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], names=["u", "v"])

        held, postings = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and postings >= CHUNK_POSTINGS and row[1] != held[-1][1]:
                    yield out(links(held))
                    held, postings = [], 0
                held.append(row)
                postings += len(row[3]) // 8
        if held:
            yield out(links(held))
        give_back()

    return run


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """Per row: id, n_shingles, component_id (smallest id reachable along links of at least `percent`)."""
    return staged_alone(docs.sparkSession, lambda: _groups(docs, id_col, text_col, words, percent), "groups")


def _groups(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> DataFrame:
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("row_id"), F.col(text_col).alias("text"))
    secret = new_key()
    found = staged(describe(rows, words, percent, 8 * shuffle_partitions(spark), secret), "described")
    described = found.where(F.col("kind") == SETS).select(F.col("a").alias("row_id"), F.col("b").alias("n"), "digest")
    keyed = described.where("digest is not null and row_id is not null")
    # written first, so that the join below has a shuffle on either side and a digest of very many rows is split
    classes = staged(keyed.groupBy("digest").agg(F.min("row_id").alias("rep")), "sets")
    member = staged(keyed.join(classes, "digest").select("row_id", "n", "rep"), "members")
    touches = shared_signatures(found)
    # copies of one set are one node from here on
    to_rep = member.select(F.col("row_id"), "rep")
    touches = touches.join(to_rep.withColumnsRenamed({"row_id": "u", "rep": "ru"}), "u").join(to_rep.withColumnsRenamed({"row_id": "v", "rep": "rv"}), "v")
    blocks = connected_components(touches.select(F.col("ru").alias("u"), F.col("rv").alias("v")))
    plan = staged(_block_plan(blocks, member, percent), "blocks")
    few = plan.count() <= BROADCAST_ROWS
    chosen = rows.join(F.broadcast(plan) if few else plan.hint("merge"), "row_id")
    edges = staged(_block_links(chosen, words, percent, secret), "links")
    groups = connected_components(edges)
    rep_group = groups.select(F.col("id").alias("rep"), "component")
    settled = member.join(rep_group, "rep", "left").select("row_id", F.coalesce("component", "rep").alias("component_id"))
    # rows that share an id are one document: its smallest component
    settled = settled.groupBy("row_id").agg(F.min("component_id").alias("component_id"))
    joined = described.select("row_id", "n").join(settled, "row_id", "left")
    return joined.select(F.col("row_id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "row_id").alias("component_id"))


def _block_plan(blocks: DataFrame, member: DataFrame, percent: int) -> DataFrame:
    """row_id and its tasks: struct(block, side, parts), two at most."""
    sized = blocks.join(member.where("row_id = rep").select("row_id", "n").distinct(), blocks["id"] == F.col("row_id")).select("row_id", "component", "n")
    sized = staged(sized, "sized")
    total = sized.groupBy("component").agg((F.sum("n") > PART_SHINGLES).alias("large"))
    rows = sized.join(total, "component")
    lows = F.array(*(F.lit(low).cast("long") for low, _ in size_bands(percent, 1 << 40)))
    band = F.size(F.filter(lows, lambda low: low <= F.col("n")))
    name = lambda b: F.concat_ws(":", F.col("component"), b)
    task = lambda block, side: F.struct(block.alias("block"), F.lit(side).alias("side"))
    whole, cut = F.array(task(name(F.lit(0)), 2)), F.array(task(name(band), 2), task(name(band - 1), 1))
    sent = rows.select("row_id", "n", F.explode(F.when(F.col("large"), cut).otherwise(whole)).alias("t")).select("row_id", "n", "t.block", "t.side")
    parts = sent.groupBy("block").agg(F.ceil(F.sum("n") / PART_SHINGLES).cast("int").alias("parts"))
    return sent.join(parts, "block").groupBy("row_id").agg(F.collect_list(F.struct("block", "side", "parts")).alias("tasks"))


def _block_links(chosen: DataFrame, words: int, percent: int, secret: int) -> DataFrame:
    """Links of all sets that share a block: chosen has row_id, text, tasks."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, tasks = (c.to_pylist() for c in batch.columns)
            place = mix(np.array(ids, np.int64).view(np.uint64), 41).tolist()
            made: list[tuple] = []
            for k, s in enumerate(shingle_sets(texts, words, secret)):
                raw = s.tobytes()
                for t in tasks[k]:
                    part = place[k] % t["parts"]
                    for other in range(t["parts"]):
                        a, b = sorted((part, other))
                        made.append((ids[k], f"{t['block']}.{a}.{b}", t["side"] if a == b else int(part == b), raw))
                if len(made) >= 256:
                    yield pack(made)
                    made = []
            if made:
                yield pack(made)

    def pack(made: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.string(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([m[k] for m in made], kind) for k, kind in enumerate(kinds)], names=["row_id", "block", "side", "shingles"])

    n = shuffle_partitions(chosen.sparkSession)
    dealt = chosen.select("row_id", "text", "tasks").mapInArrow(spread, "row_id long, block string, side int, shingles binary")
    return dealt.repartition(n, "block").sortWithinPartitions("block").mapInArrow(_search(percent), "u long, v long")
