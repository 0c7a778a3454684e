"""BPE encoding and decoding with word ends, by speculation and verification.

Greedy longest match proposes the tokens of each distinct word. A proposal is the true encoding exactly when every
two neighbours stay apart if they alone are merged, so numpy checks each distinct pair of neighbours by undoing the
merges on both sides of the border, latest first, and looking for a merge across it that would have come earlier.
Only words with a failing pair are merged exactly: many short ones at once, a round for each word's earliest merge,
long ones one by one with a heap.

A worker remembers the encoding of runs without white space, so that a text is split, looked up and joined. Decoding
is an operator of its own, from ids to text, and `round_trip` decodes what it has just encoded.

Defined cases: a null text encodes as the empty text, to no ids, and null ids decode to the empty text; special
tokens written out in a text become their ids; texts with characters outside a common range are normalised by the
tokenizers library itself; repeated rows and ids are rows of their own; an empty table gives no rows; columns beside
id and text take no part.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graintide.llm.bytebpe import byte_alphabet
from graintide.session import small_batches

#: The word split of the tokenizer file, and its mark of a word's end.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"
UNCOMMON = re.compile(r"[^\t\n\r -~\u00a1-\u024f\u2010-\u2027\u2030-\u205e\u20ac]")
#: One character for the mark while matching; the byte alphabet doesn't hold it.
END = "\ue000"
#: Runs whose encoding a worker remembers.
MEMORY = 700_000
#: Characters of a word from which it is merged with a heap.
LONG = 64
NEVER = np.int64(1) << 40


class WordBpe:
    _made: dict[str, "WordBpe"] = {}

    @classmethod
    def of(cls, path: str) -> "WordBpe":
        """One coder per worker process."""
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            content = json.load(f)
        self.exact = Tokenizer.from_str(json.dumps(content | {"truncation": None, "padding": None}))
        self.special = {t["content"]: t["id"] for t in content["added_tokens"]}
        vocab = {t: i for t, i in content["model"]["vocab"].items() if t not in self.special}
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        self.token = {str(i): t for t, i in (vocab | self.special).items()}
        self.name = [str(i) for i in range(self.size)]
        inner = lambda t: t[: -len(WORD_END)] + END if t.endswith(WORD_END) else t
        ids = {inner(t): i for t, i in vocab.items()}
        self.born = np.full(self.size, -1, np.int64)
        self.left = np.full(self.size, -1, np.int64)
        self.right = np.full(self.size, -1, np.int64)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        made = []
        for rank, pair in enumerate(content["model"]["merges"]):
            a, b = (inner(x) for x in (pair.split(" ") if isinstance(pair, str) else pair))
            one, two, both = ids[a], ids[b], ids[a + b]
            made.append(both)
            self.merges.setdefault((one, two), (rank, both))
            if self.born[both] < 0:
                self.born[both], self.left[both], self.right[both] = rank, one, two
        self.made = np.array(made, np.int64)
        codes = sorted((a * self.size + b, rank) for (a, b), (rank, _) in self.merges.items())
        self.codes, self.ranks = (np.array(x, np.int64) for x in zip(*codes, strict=True))
        units = {t: i for t, i in ids.items() if len(t.removesuffix(END)) == 1}
        self.inside, self.last = ({ord(t[0]): i for t, i in units.items() if t.endswith(END) == end} for end in (False, True))
        self.unit = np.zeros((2, 1 + max(ord(t[0]) for t in units)), np.int64)
        for row, found in enumerate((self.inside, self.last)):
            self.unit[row, list(found)] = list(found.values())
        # a token that its own characters don't merge to is never proposed
        self.proposed = {t: ids[t] for t, m in zip(ids, self.merged(list(ids)), strict=True) if m == [ids[t]]}
        # the longest proposal for each beginning of three characters
        self.reach: dict[str, int] = {}
        for t in self.proposed:
            self.reach[t[:3]] = max(self.reach.get(t[:3], 0), len(t))
        self.shown = {b: c for c, b in byte_alphabet().items()}
        self.split = regex.compile(SPLIT)
        self.mark = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.memory: dict[str, str] = {}
        self.failed = self.tried = 0

    def merged(self, words: list[str]) -> list[list[int]]:
        """Exact merging of each word: the earliest merge first, the leftmost of equals first."""
        out: list[list[int]] = [[] for _ in words]
        short = [k for k, w in enumerate(words) if len(w) < LONG]
        for k, w in enumerate(words):
            if len(w) >= LONG:
                out[k] = self._merged_long(w)
        for at in range(0, len(short), 20_000):
            part = short[at : at + 20_000]
            for k, ids in zip(part, self._merged_short([words[k] for k in part]), strict=True):
                out[k] = ids
        return out

    def _units(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """First ids of all words in turn, and how many each has; a last character takes the mark of the end with it."""
        ended = np.array([w.endswith(END) for w in words])
        bare = [w[:-1] if e else w for w, e in zip(words, ended.tolist(), strict=True)]
        sizes = np.fromiter(map(len, bare), np.int64, len(bare))
        code = np.frombuffer("".join(bare).encode("utf-32-le"), np.uint32)
        ids = self.unit[0, code]
        last = (np.cumsum(sizes) - 1)[ended]
        ids[last] = self.unit[1, code[last]]
        return ids, sizes

    def _merged_short(self, words: list[str]) -> list[list[int]]:
        """All words at once: in a round each takes its earliest merge wherever it stands."""
        ids, sizes = self._units(words)
        word = np.repeat(np.arange(len(words)), sizes)
        rank = self._next_ranks(ids, word)
        done_ids, done_word = [], []
        while len(ids):
            starts = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            counts = np.diff(np.append(starts, len(ids)))
            best = np.repeat(np.minimum.reduceat(rank, starts), counts)
            settled = best == NEVER
            if settled.any():
                done_ids.append(ids[settled])
                done_word.append(word[settled])
                ids, word, rank, best = ids[~settled], word[~settled], rank[~settled], best[~settled]
                if not len(ids):
                    break
            hit = np.flatnonzero(rank == best)
            if (hit[1:] == hit[:-1] + 1).any():  # of overlapping places every second, from the left
                run = np.cumsum(np.concatenate(([True], hit[1:] != hit[:-1] + 1))) - 1
                first = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1])))
                hit = hit[(np.arange(len(hit)) - first[run]) % 2 == 0]
            ids[hit] = self.made[rank[hit]]
            stay = np.ones(len(ids), bool)
            stay[hit + 1] = False
            place = hit - np.arange(len(hit))  # each merge before takes one place away
            ids, word, rank = ids[stay], word[stay], rank[stay]
            at = np.concatenate((place, place[place > 0] - 1))
            after = np.minimum(at + 1, len(ids) - 1)
            rank[at] = np.where((after > at) & (word[at] == word[after]), self.rank_of(ids[at], ids[after]), NEVER)
        flat, owner = np.concatenate(done_ids or [ids]), np.concatenate(done_word or [word])
        order = np.argsort(owner, kind="stable")
        flat, ends = flat[order].tolist(), np.cumsum(np.bincount(owner, minlength=len(words))).tolist()
        return [flat[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def _next_ranks(self, ids: np.ndarray, word: np.ndarray) -> np.ndarray:
        rank = np.full(len(ids), NEVER)
        same = np.flatnonzero(word[1:] == word[:-1])
        rank[same] = self.rank_of(ids[same], ids[same + 1])
        return rank

    def _merged_long(self, word: str) -> list[int]:
        """One word by a heap of merges over a linked list of its pieces."""
        ids = self._units([word])[0].tolist()
        before, after = list(range(-1, len(ids) - 1)), list(range(1, len(ids) + 1))
        heap = [(self.merges[p][0], k, p) for k, p in enumerate(zip(ids, ids[1:])) if p in self.merges]
        heapq.heapify(heap)
        while heap:
            _, k, (a, b) = heapq.heappop(heap)
            n = after[k]
            if ids[k] != a or n >= len(ids) or ids[n] != b:
                continue
            ids[k], ids[n] = self.merges[a, b][1], -1
            after[k] = after[n]
            if after[k] < len(ids):
                before[after[k]] = k
            for one, two in ((before[k], k), (k, after[k])):
                if one >= 0 and two < len(ids) and (found := self.merges.get((ids[one], ids[two]))) is not None:
                    heapq.heappush(heap, (found[0], one, (ids[one], ids[two])))
        return [i for i in ids if i >= 0]

    def proposal(self, word: str) -> list[int]:
        """Greedy longest match; the word ends in END, which no cut separates from the character before it."""
        ids, at, n = [], 0, len(word)
        find, reach = self.proposed.get, self.reach.get
        while at < n:
            end = min(n, at + (reach(word[at : at + 3]) or 2))
            while True:
                if end != n - 1 and (found := find(word[at:end])) is not None:
                    break
                end -= 1
                if end <= at:
                    raise ValueError(f"the vocabulary lacks a character of {word!r}")
            ids.append(found)
            at = end
        return ids

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        code = a * self.size + b
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[at] == code, self.ranks[at], NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the pieces a, b stay apart: at each moment no merge across the border precedes their own next one."""
        ok = np.ones(len(a), bool)
        a, b = a.copy(), b.copy()
        until_a, until_b = np.full(len(a), NEVER), np.full(len(a), NEVER)
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            across = self.rank_of(x, y)
            # merges of equal rank go from left to right: a's own comes first, b's own comes last
            crossed = (across < NEVER) & (across < until_a[live]) & (across <= until_b[live])
            ok[live[crossed]] = False
            live, x, y = live[~crossed], x[~crossed], y[~crossed]
            undo_a = self.born[x] > self.born[y]
            go = undo_a | (self.born[y] >= 0)
            live, x, y, undo_a = live[go], x[go], y[go], undo_a[go]
            p, q = live[undo_a], live[~undo_a]
            until_a[p], a[p] = self.born[x[undo_a]], self.right[x[undo_a]]
            until_b[q], b[q] = self.born[y[~undo_a]], self.left[y[~undo_a]]
        return ok

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of each word, a word being the characters between two splits."""
        shown = [(w if w.isascii() and w.isprintable() else w.encode("utf-8").decode("latin-1").translate(self.shown)) + END for w in words]
        ids = [*map(self.proposal, shown)]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((i for x in ids for i in x), np.int64, int(lengths.sum()))
        word_of = np.repeat(np.arange(len(ids)), lengths)
        inside = word_of[1:] == word_of[:-1]
        pairs, which = np.unique(flat[:-1][inside] * self.size + flat[1:][inside], return_inverse=True)
        good = self.compatible(pairs // self.size, pairs % self.size)
        failing = np.unique(word_of[1:][inside][~good[which]]).tolist()
        for k, exact in zip(failing, self.merged([shown[k] for k in failing]), strict=True):
            ids[k] = exact
        self.tried, self.failed = self.tried + len(words), self.failed + len(failing)
        return ids

    def runs(self, text: str) -> list[str]:
        """The runs without white space of a text, normalised; special tokens stay as they are, between them."""
        if self.mark and any(s in text for s in self.special):
            out = []
            for part in self.mark.split(text):
                out += [part] if part in self.special else self.runs(part) if part else []
            return out
        # normalised by the library, white space is plain spaces; a common text has no other kinds than these four
        return self.exact.normalizer.normalize_str(text).split(" ") if UNCOMMON.search(text) else text.lower().split()

    def learn(self, runs: set[str]) -> None:
        """Remember the decimal ids of the runs not yet known."""
        memory = self.memory
        if len(memory) > MEMORY:
            memory.clear()
        new = [r for r in runs if r not in memory]
        words = dict(zip(new, map(self.split.findall, new), strict=True))
        for s in self.special:
            if s in words:
                memory[s] = self.name[self.special[s]]
                del words[s]
        unknown = list({w for found in words.values() for w in found if w not in memory})
        for k in range(0, len(unknown), 50_000):
            part = unknown[k : k + 50_000]
            for w, ids in zip(part, self.encode_words(part), strict=True):
                memory[w] = " ".join([self.name[i] for i in ids])
        for r, found in words.items():
            if len(found) != 1 or found[0] != r:
                memory[r] = " ".join([memory[w] for w in found])

    def encode_texts(self, texts: list[str | None]) -> list[str]:
        """Decimal ids joined by one space."""
        split = [self.runs(t) if t else [] for t in texts]
        self.learn(set().union(*split))
        known = self.memory.__getitem__
        return [" ".join([x for x in map(known, runs) if x]) for runs in split]

    def encode(self, text: str) -> list[int]:
        return [int(i) for i in self.encode_texts([text])[0].split()]

    def decode_texts(self, ids: list[str | None]) -> list[str]:
        """The file names no decoder: tokens joined by one space, special ones too."""
        token = self.token.__getitem__
        return [" ".join(map(token, x.split(" "))) if x else "" for x in ids]


def _counted(ids: list[str]) -> pa.Array:
    return pa.array([x.count(" ") + 1 if x else 0 for x in ids], pa.int64())


def encode_documents(docs: DataFrame, vocab: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = False) -> DataFrame:
    """Per document: doc_id, n_tokens, ids (decimal, joined by one space) and, with decode, decoded (these ids decoded)."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = WordBpe.of(vocab)
        for batch in batches:
            ids = coder.encode_texts(batch.column(1).to_pylist())
            cols = [batch.column(0), _counted(ids), pa.array(ids, pa.string())] + [pa.array(coder.decode_texts(ids), pa.string())] * decode
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_tokens", "ids", "decoded"][: len(cols)])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids string" + ", decoded string" * decode)


def decode_documents(coded: DataFrame, vocab: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row: doc_id and decoded, from decimal ids joined by one space; an id that the file lacks fails the job."""
    small_batches(coded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = WordBpe.of(vocab)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(coder.decode_texts(batch.column(1).to_pylist()), pa.string())], names=["doc_id", "decoded"])

    return coded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, decoded string")
