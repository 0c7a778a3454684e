"""Token counts under a unigram model by dynamic programming over a trie of distinct pre-tokens.

Pieces come from a public vocabulary file. Their probabilities are learned from all documents: distinct pre-tokens are
counted, each is split into its best pieces, the pieces are counted, weighted by how often the pre-token occurs, and
new scores follow; the first scores are Zipf's law over the order of the file. Only one number for each piece reaches
the driver, and it is a sum of whole numbers, so that the scores don't depend on how rows are dealt.

The distinct pre-tokens that a worker hasn't met are inserted in a trie, in order, so that its nodes are made depth
first: at each node the best forward score of its prefix, the tokens on that path and the last piece are computed once
for all pre-tokens that share the prefix, and where a pre-token ends its count is stored and read from then on.

Pre-tokens are runs without ASCII white space, each with the word mark before it. A character that no piece covers
falls back to one token for each of its UTF-8 bytes. Of equal scores the path with fewer tokens counts.

Defined cases: a null or empty text has no pre-tokens and no tokens; rows with one id, repeated rows and rows with a
null id are separate rows; an empty table gives no rows; columns beside id and text take no part.
"""

from __future__ import annotations

import math
import os.path
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graintide.llm.wordbytes import give_back
from graintide.session import small_batches, staged

MARK = "▁"
#: Pre-tokens that a worker remembers, and distinct ones that are counted before they are sent on.
MEMORY, HELD = 1_000_000, 300_000
#: How often the probabilities are estimated anew.
ROUNDS = 2
#: Pre-tokens that share a trie while pieces are counted.
TOGETHER = 50_000
UNREACHED = float("-inf")
RUN = re.compile(r"[^\t-\r ]+")
#: White space beyond ASCII's own, which str.split takes too.
OTHER_SPACE = re.compile("[" + "".join(re.escape(chr(c)) for c in range(0x3001) if chr(c).isspace() and not (9 <= c <= 13 or c == 32)) + "]")


def pieces_of(path: str) -> list[str]:
    """The pieces of a vocabulary file that aren't control, unknown, byte or unused ones, in its order."""
    import sentencepiece

    file = sentencepiece.SentencePieceProcessor(model_file=path)
    return [file.id_to_piece(i) for i in range(file.vocab_size()) if not (file.is_control(i) or file.is_unknown(i) or file.is_byte(i) or file.is_unused(i))]


def first_scores(n: int) -> list[float]:
    """Log-probabilities of Zipf's law over the order."""
    total = math.log(sum(1 / (k + 2.7) for k in range(n)) or 1)
    return [-math.log(k + 2.7) - total for k in range(n)]


class Trie:
    """Prefixes of the pre-tokens inserted so far, as nodes in depth-first order."""

    def __init__(self):
        self.score, self.tokens, self.piece = [0.0], [0], [0]
        self.ends: dict[str, int] = {}  # the node at which a pre-token ends
        self.path, self.at = [0], ""  # nodes from the root to the last pre-token


class UnigramCounter:
    _made: dict[tuple, "UnigramCounter"] = {}

    @classmethod
    def of(cls, path: str, scores: list[float], key: str) -> "UnigramCounter":
        """One counter per worker process and fitted model."""
        if (path, key) not in cls._made:
            cls._made.clear()
            cls._made[path, key] = cls(pieces_of(path), scores)
        return cls._made[path, key]

    def __init__(self, pieces: list[str], scores: list[float] | None = None):
        import ahocorasick

        scores = first_scores(len(pieces)) if scores is None else scores
        self.score: dict[str, float] = {}
        self.number: dict[str, int] = {}
        for k, (piece, s) in enumerate(zip(pieces, scores, strict=True)):
            self.score.setdefault(piece, s)
            self.number.setdefault(piece, k)
        self.found = ahocorasick.Automaton()
        for piece, s in self.score.items():
            self.found.add_word(piece, (len(piece), s))
        self.found.make_automaton()
        self.longest = max(map(len, pieces), default=1)
        self.byte = min(self.score.values(), default=0.0) - 10.0
        self.memory: dict[str, complex] = {}  # tokens, and their score as the imaginary part, so that one sum adds both

    def insert(self, trie: Trie, word: str) -> int:
        """The node at which a pre-token ends, inserted in ascending order; only nodes that the trie lacks are computed."""
        shared, most, last = 0, min(len(trie.at), len(word)), trie.at
        while shared < most and last[shared] == word[shared]:
            shared += 1
        path, score, tokens, piece = trie.path, trie.score, trie.tokens, trie.piece
        del path[shared + 1 :]
        new = len(word) - shared
        path.extend(range(len(score), len(score) + new))
        score.extend([UNREACHED] * new)
        tokens.extend([0] * new)
        piece.extend([0] * new)
        covered = shared
        # the pieces that end in the new part, by their ends
        for last_char, (length, s) in self.found.iter(word, max(0, shared - self.longest + 1)) if self.score and new else ():
            end = last_char + 1
            if end <= shared:
                continue
            if end > covered + 1:
                self._by_bytes(trie, word, covered + 1, end)
            covered = end
            here, start = path[end], path[end - length]
            s += score[start]
            if s > score[here] or s == score[here] and tokens[start] + 1 < tokens[here]:
                score[here], tokens[here], piece[here] = s, tokens[start] + 1, length
            if word[last_char] not in self.score:
                self._by_bytes(trie, word, end, end + 1)
        self._by_bytes(trie, word, covered + 1, len(word) + 1)
        trie.at, trie.ends[word] = word, path[-1]
        return path[-1]

    def _by_bytes(self, trie: Trie, word: str, first: int, end: int) -> None:
        """Let the nodes of some ends be reached by the bytes of their character, which no piece of it alone does better."""
        path, score, tokens, piece = trie.path, trie.score, trie.tokens, trie.piece
        for at in range(first, end):
            n, here, before = len(word[at - 1].encode("utf-8")), path[at], path[at - 1]
            s = score[before] + n * self.byte
            if s > score[here] or s == score[here] and tokens[before] + n < tokens[here]:
                score[here], tokens[here], piece[here] = s, tokens[before] + n, 0

    def walk(self, words: list[str]) -> Iterator[tuple[str, int, float]]:
        """(pre-token, tokens, score) of distinct pre-tokens."""
        trie = Trie()
        for word in sorted(words):
            self.insert(trie, word)
        for word, node in trie.ends.items():
            yield word, trie.tokens[node], trie.score[node]

    def best_pieces(self, counts: list[tuple[str, int]]) -> Counter:
        """How often each piece, by its number, is in the best splits of pre-tokens that occur so often."""
        trie, used = Trie(), Counter()
        for word, n in sorted(counts):
            self.insert(trie, word)
            end = len(word)
            while end:
                length = trie.piece[trie.path[end]]
                if length:
                    used[self.number[word[end - length : end]]] += n
                end -= length or 1
        return used

    def learn(self, runs: set[str]) -> None:
        if len(self.memory) > MEMORY:
            self.memory.clear()
        for word, n, score in self.walk([MARK + r for r in runs if r not in self.memory]):
            self.memory[word[1:]] = complex(n, score)

    def totals(self, runs: list[str]) -> tuple[int, float]:
        both = sum(map(self.memory.__getitem__, runs), 0j)
        return int(both.real), both.imag


def runs_of(text: str | None) -> list[str]:
    """The runs of a text without ASCII white space."""
    text = text or ""
    return RUN.findall(text) if OTHER_SPACE.search(text) else text.split()


def count_runs(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(run, n): how often each occurs in all documents."""
    small_batches(docs.sparkSession)

    def flush(seen: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["run", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(runs_of(text))
                if len(seen) > HELD:
                    yield flush(seen)
                    seen = Counter()
        if seen:
            yield flush(seen)
        give_back()

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "run string, n long").groupBy("run").agg(F.sum("n").alias("n"))


def fit_scores(docs: DataFrame, vocab: str, text_col: str = "text", rounds: int = ROUNDS) -> list[float]:
    """Log-probabilities of the pieces, in the order of the file, from all documents (one is added to every count)."""
    counts = staged(count_runs(docs, text_col).sortWithinPartitions("run"), "runs")  # in order, so that those that meet share prefixes
    pieces = pieces_of(vocab)
    scores = first_scores(len(pieces))
    for _ in range(rounds):
        used = {r["piece"]: r["n"] for r in _pieces_used(counts, vocab, scores).collect()}  # a row for each piece at most
        total = math.log(sum(used.values()) + len(pieces)) if pieces else 0.0
        scores = [math.log(used.get(k, 0) + 1) - total for k in range(len(pieces))]
    return scores


def _pieces_used(counts: DataFrame, vocab: str, scores: list[float]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, used, held = UnigramCounter(pieces_of(vocab), scores), Counter(), []
        for batch in batches:
            held += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            if len(held) >= TOGETHER:
                used.update(counter.best_pieces([(MARK + w, n) for w, n in held]))
                held = []
        used.update(counter.best_pieces([(MARK + w, n) for w, n in held]))
        yield pa.RecordBatch.from_arrays([pa.array(list(used), pa.int64()), pa.array(list(used.values()), pa.int64())], names=["piece", "n"])
        give_back()

    return counts.mapInArrow(run, "piece long, n long").groupBy("piece").agg(F.sum("n").alias("n"))


def count_tokens(docs: DataFrame, vocab: str, id_col: str = "doc_id", text_col: str = "text", scores: list[float] | None = None) -> DataFrame:
    """Per row: id, n_pretokens, n_tokens and log_prob (of the best segmentation); without scores these are fitted to docs first."""
    small_batches(docs.sparkSession)
    fitted = fit_scores(docs, vocab, text_col) if scores is None else scores
    key = f"{os.path.basename(vocab)}:{hash(tuple(fitted))}"
    held = docs.sparkSession.sparkContext.broadcast(fitted)  # a number for each piece

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = UnigramCounter.of(vocab, held.value, key)
        for batch in batches:
            split = [runs_of(t) for t in batch.column(1).to_pylist()]
            counter.learn(set().union(*split))
            found = [counter.totals(runs) for runs in split]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([len(runs) for runs in split], pa.int64()), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.float64()),
            ], names=["doc_id", "n_pretokens", "n_tokens", "log_prob"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_pretokens long, n_tokens long, log_prob double")
