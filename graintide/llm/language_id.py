"""Language identification: averaged hashed subword embeddings and a linear softmax, trained by SGD in numpy.

Only labelled rows of the training side are learned from, at most `rows_per_language` of each language, chosen by a
hash of their id and text. They are cut where they are: of each language at most `pieces` runs of CHUNK words travel to
the driver to be learned, and of `held_texts` rows kept aside runs of every length, by which confidence is calibrated;
no whole text does. Of the model, which has a row of numbers for each language, only those for each hashed subword
reach the workers. Confidence is calibrated by a temperature. A text is rejected when its log-odds are
below those of all but a share `reject` of the calibration texts of about its length, so that short texts, which score
lower, stay. Where these are beyond a score of `surest`, half of them is enough, but no less than that score.

Defined cases: a text that is null or has no letter is `und` with score 0; without any labelled row every text is
`und`; rows with a null id or null label are predicted, not learned from; copies are predicted alike; an empty table
gives no rows; columns beside id, text and label take no part, and such as have the name of a result are replaced by it.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graintide.llm.wordbytes import mix
from graintide.session import small_batches, staged

WORD, LETTERS = re.compile(r"[^\W\d_]+"), regex.compile(r"\p{L}+")
BUCKETS, DIM, GRAMS = 1 << 15, 16, (1, 2, 3, 4)
#: Longest run of letters that is taken as one word; a longer one is read in pieces of this length.
LONGEST = 64
MEMORY = 300_000
#: Classes of length for rejection, by powers of two: one word, two or three, four to seven and so on.
LENGTHS = 10
#: Runs of each length that a text kept aside gives.
HELD_RUNS = 8
UNKNOWN = "und"


def words_of(text: str | None) -> list[str]:
    words = WORD.findall((text or "").lower())
    if words and not "".join(words).isalpha():  # signs of numbers such as one half are no letters
        words = LETTERS.findall(" ".join(words))
    if any(len(w) > LONGEST for w in words):
        words = [w[k : k + LONGEST] for w in words for k in range(0, len(w), LONGEST)]
    return words


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed subwords of all words in turn, and how many each word has."""
    joined = "".join(f"<{w}>" for w in words)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.array([len(w) + 2 for w in words])
    word = np.repeat(np.arange(len(words)), sizes)
    features, owners = [], []
    for n in GRAMS:
        h = np.full(max(0, len(codes) - n + 1), n, np.uint64)
        for k in range(n):
            h = mix(h * np.uint64(31) + codes[k : len(codes) - n + 1 + k])
        inside = word[: len(h)] == word[n - 1 :]
        features.append((h[inside] % np.uint64(BUCKETS)).astype(np.int32))
        owners.append(word[: len(h)][inside])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(features)[order], np.bincount(owner, minlength=len(words))


@dataclass
class LanguageModel:
    labels: list[str]
    logits: np.ndarray  # of each hashed subword
    bias: np.ndarray
    temperature: float = 1.0
    thresholds: list[float] = field(default_factory=lambda: [-math.inf] * LENGTHS)  # log-odds, of each length class
    memory: dict = field(default_factory=dict, repr=False)
    table: np.ndarray | None = field(default=None, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"memory": {}, "table": None}

    def _learn(self, new: list[str]) -> None:
        if len(self.memory) + len(new) > MEMORY:
            self.memory, self.table = {}, None
        features, counts = subwords(new)
        ends = np.cumsum(counts)
        sums = np.add.reduceat(self.logits[features], ends - counts, axis=0, dtype=np.float64)
        rows = np.concatenate((sums, counts[:, None]), axis=1)
        at = len(self.memory)
        if self.table is None or at + len(new) > len(self.table):
            grown = np.zeros((2 * (at + len(new)) + 1024, rows.shape[1]))
            if at:
                grown[:at] = self.table[:at]
            self.table = grown
        self.table[at : at + len(new)] = rows
        self.memory.update(zip(new, range(at, at + len(new)), strict=True))

    def logits_of(self, split: list[list[str]]) -> list[np.ndarray | None]:
        """Of each text, given as its words, a number for each label at temperature 1; None where it has no words or the model no labels."""
        out: list[np.ndarray | None] = []
        for k in range(0, len(split), 64):
            part = split[k : k + 64]
            distinct = set().union(*part)
            new = sorted(w for w in distinct if w not in self.memory)
            if new and self.labels:
                if len(self.memory) + len(new) > MEMORY:
                    new = sorted(distinct)
                self._learn(new)
            for words in part:
                if not words or not self.labels:
                    out.append(None)
                    continue
                sums = self.table[np.fromiter(map(self.memory.__getitem__, words), np.int64, len(words))].sum(axis=0)
                out.append(sums[:-1] / sums[-1] + self.bias)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        """Of each text its label, the probability of it, and whether that is too low for a text of its length."""
        split = [words_of(t) for t in texts]
        names, scores, rejected = [], [], []
        for words, z in zip(split, self.logits_of(split), strict=True):
            odds = -math.inf if z is None else float(log_odds(z[None] / self.temperature)[0])
            names.append(UNKNOWN if z is None else self.labels[int(z.argmax())])
            scores.append(1 / (1 + math.exp(-odds)) if z is not None else 0.0)
            rejected.append(z is None or odds < self.thresholds[length_class(len(words))])
        return names, scores, rejected


def log_odds(z: np.ndarray) -> np.ndarray:
    """Of each row the log-odds of its greatest number under a softmax."""
    best = z.argmax(axis=1)
    rest = z - z[np.arange(len(z)), best][:, None]
    rest[np.arange(len(z)), best] = -math.inf
    return -np.logaddexp.reduce(rest, axis=1) if z.shape[1] > 1 else np.full(len(z), math.inf)


#: Words of a run that is learned.
CHUNK = 20


def text_runs(text: str | None) -> list[tuple[bool, int, int, str]]:
    """(whether it is to calibrate by, first word, words, text) of the runs of a text: all of CHUNK words, and some of each power of two."""
    words = words_of(text)
    runs = [(False, k, CHUNK) for k in range(0, len(words), CHUNK)]
    for size in (1 << k for k in range(LENGTHS)):
        some = min(HELD_RUNS, len(words) // size)  # dealt over the text
        runs += [(True, k * (len(words) - size) // max(1, some - 1), size) for k in range(some)]
    return [(held, k, size, " ".join(words[k : k + size])) for held, k, size in runs]


def train(rows: list[tuple[str, str]], **options) -> LanguageModel:
    """A model from few (text, label) rows in a fixed order; every fifth is kept for calibration."""
    aside = [len(rows) >= 50 and not k % 5 for k in range(len(rows))]
    cut = lambda text, y, held: [(run, y) for of, _, _, run in text_runs(text) if of == held]
    learn = [r for (t, y), a in zip(rows, aside, strict=True) if not a for r in cut(t, y, False)]
    return train_runs(learn, [r for (t, y), a in zip(rows, aside, strict=True) if a or not any(aside) for r in cut(t, y, True)], **options)


def train_runs(learn: list[tuple[str, str]], held: list[tuple[str, str]], epochs: int = 4, rate: float = 8.0, reject: float = 0.001, surest: float = 0.9, seed: int = 7) -> LanguageModel:
    """A model from (text, label) runs in a fixed order, calibrated by the runs kept aside."""
    labels = sorted({y for _, y in learn})
    if not labels:
        return LanguageModel([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    number = {y: k for k, y in enumerate(labels)}
    rng = np.random.default_rng(seed)
    split = [(words, number[y]) for text, y in learn if (words := words_of(text))]
    made: list[tuple[np.ndarray, int]] = []
    for k in range(0, len(split), 256):
        part = split[k : k + 256]
        flat, counts = subwords([w for words, _ in part for w in words])
        ends = np.cumsum(counts)[np.cumsum([len(words) for words, _ in part]) - 1]
        made += [(f, y) for f, (_, y) in zip(np.split(flat, ends[:-1]), part, strict=True)]
    embed = (rng.random((BUCKETS, DIM)) - 0.5) / DIM
    weight, bias = np.zeros((DIM, len(labels))), np.zeros(len(labels))
    steps = max(1, epochs * -(-len(made) // 64))
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(made))
        for k in range(0, len(order), 64):
            batch = [made[j] for j in order[k : k + 64]]
            n = np.array([len(f) for f, _ in batch])
            flat = np.concatenate([f for f, _ in batch])
            starts = np.cumsum(n) - n
            mean = np.add.reduceat(embed[flat], starts, axis=0) / n[:, None]
            z = mean @ weight + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(batch)), [y for _, y in batch]] -= 1
            lr = rate * (1 - step / steps) / len(batch)
            back = (p @ weight.T) / n[:, None]
            weight -= lr * mean.T @ p
            bias -= lr * p.sum(axis=0)
            by_bucket = np.argsort(flat)
            used, firsts = np.unique(flat[by_bucket], return_index=True)
            embed[used] -= lr * np.add.reduceat(np.repeat(back, n, axis=0)[by_bucket], firsts, axis=0) * 8
            step += 1
    model = LanguageModel(labels, (embed @ weight).astype(np.float32), bias)
    return calibrate(model, held, reject, surest)


def length_class(words: int) -> int:
    return min(words.bit_length(), LENGTHS) - 1


def calibrate(model: LanguageModel, held: list[tuple[str, str]], reject: float, surest: float, fewest: int = 100) -> LanguageModel:
    """The temperature of least loss on the held runs, and for each length the log-odds that only `reject` of them fall below.

    A length with fewer than `fewest` runs has the threshold of the next shorter one. Beyond `surest` the threshold is
    half of the log-odds: where languages are far apart those of all held texts are high, and those of others still low.
    """
    number = {y: k for k, y in enumerate(model.labels)}
    split = [(words, number[y]) for text, y in held if y in number and (words := words_of(text))]
    if not split or len(model.labels) == 1:
        return model
    z = np.array(model.logits_of([words for words, _ in split]))
    truth = np.array([y for _, y in split])

    def loss(temperature: float) -> float:
        odds, right = log_odds(z / temperature), z.argmax(axis=1) == truth
        p = 1 / (1 + np.exp(-odds))
        return -float(np.log(np.maximum(np.where(right, p, (1 - p) / (len(model.labels) - 1)), 1e-9)).mean())

    model.temperature = min((0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0), key=loss)
    odds, sure = log_odds(z / model.temperature), math.log(surest / (1 - surest))
    of = np.array([length_class(len(words)) for words, _ in split])
    model.thresholds, last = [], -math.inf
    for k in range(LENGTHS):
        found = odds[of == k]
        if len(found) >= fewest:
            last = float(np.quantile(found, reject))
            last = min(last, max(sure, last / 2))
        model.thresholds.append(last)
    return model


def held_out(id_col: str = "doc_id"):
    """Whether crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", rows_per_language: int = 400) -> DataFrame:
    """(place, label, text, nth of its language): at most rows_per_language labelled rows of each language by a hash of id and text; repeated rows count once."""
    usable = docs.where(F.col(id_col).isNotNull() & ~held_out(id_col) & F.col(label_col).isNotNull() & F.col(text_col).isNotNull())
    place = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.col(text_col), F.lit(11)), F.lit(1 << 30))
    labelled = usable.select(place.alias("place"), F.col(label_col).cast("string").alias("label"), F.col(text_col).alias("text"))
    # few of a large language pass the limit of its place, before any text moves; there is a row here for each language
    limits = labelled.groupBy("label").agg((F.least(F.lit(1.0), 1.5 * rows_per_language / F.count("*")) * (1 << 30)).alias("limit"))
    drawn = labelled.join(limits, "label").where(F.col("place") < F.col("limit")).select("place", "label", "text").distinct()
    return drawn.withColumn("nth", F.row_number().over(W.partitionBy("label").orderBy("place", "text"))).where(F.col("nth") <= rows_per_language)


def training_runs(drawn: DataFrame, pieces: int = 3000, held_texts: int = 400) -> tuple[list[tuple[str, str]], list[tuple[str, str]]]:
    """(runs to learn, runs to calibrate by), of (text, label); every fifth row of a language is kept aside, but where there are few all serve both ways."""
    rows = drawn.withColumn("aside", F.col("nth") % 5 == 0)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: list[tuple] = []
            for place, label, text, aside in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                made += [(label, place, held, aside, k, size, run) for held, k, size, run in text_runs(text)]
            kinds = (pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([m[k] for m in made], kind) for k, kind in enumerate(kinds)], names=["label", "place", "held", "aside", "at", "size", "run"])

    runs = staged(rows.select("place", "label", "text", "aside").mapInArrow(cut, "label string, place long, held boolean, aside boolean, at long, size long, run string"), "runs")
    enough = runs.where("not held").select("place", "label").distinct().count() >= 50
    order = [F.xxhash64("place", "at", "size"), F.col("place"), F.col("at"), F.col("size"), F.col("run")]
    learn = runs.where("not held and not aside" if enough else "not held").withColumn("nth", F.row_number().over(W.partitionBy("label").orderBy(*order))).where(F.col("nth") <= pieces)
    texts = runs.where("held and aside" if enough else "held").select("place").distinct().orderBy("place").limit(held_texts)
    held = runs.where("held and aside" if enough else "held").join(F.broadcast(texts), "place")
    fetch = lambda df: [(r["run"], r["label"]) for r in df.orderBy(*order, "label").select("run", "label").collect()]
    return fetch(learn), fetch(held)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", rows_per_language: int = 400, pieces: int = 3000, held_texts: int = 400) -> LanguageModel:
    small_batches(docs.sparkSession)
    return train_runs(*training_runs(training_rows(docs, id_col, text_col, label_col, rows_per_language), pieces, held_texts))


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """docs with lang_pred, score and rejected (no letters, or a score below the threshold of its length)."""
    small_batches(docs.sparkSession)
    docs = docs.drop("lang_pred", "score", "rejected")
    names = docs.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pred, score, bad = model.predict(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(bad, pa.bool_())], names=[*names, "lang_pred", "score", "rejected"])

    results = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *results]))
