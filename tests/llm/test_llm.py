"""Each operator against brute force, a public library or a round trip, with the cases that its docstring defines."""

import base64
import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from graintide.llm import cap_filters, chat_format, exact_dedup, jaccard, language_id, packing, substring_dedup, token_counts, warc, wordbpe
from graintide.llm.bytebpe import ByteBpe
from graintide.llm import queries as op_queries
from graintide.llm.components import connected_components
from graintide.llm.queries import vocab_path

SCHEMA = "doc_id long, text string, kept string"
ODD = ["", None, " \t\n", "a", "a b", "İstanbul ΣΑΣ x́ é ﬁ <|endoftext|> naïve", "don't WE'LL 12345 !!!    日本語 🙂", "x" * 3000, "tail\x1c\x85end", "ab  " * 500]


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(200)]
    texts = [" ".join(rng.choice(vocab) for _ in range(rng.randint(1, 120))) for _ in range(n)]
    shared = " ".join(rng.choice(vocab) for _ in range(40))
    for k in range(n):
        if rng.random() < 0.3:
            texts[k] = texts[rng.randrange(n)]
        if rng.random() < 0.4:
            words = texts[k].split()
            words[rng.randrange(len(words))] = rng.choice(vocab)
            texts[k] = " ".join(words)
        if rng.random() < 0.3:
            texts[k] += "\n" + shared
    return texts


def frame(spark, texts):
    return spark.createDataFrame([(k, t, "extra") for k, t in enumerate(texts)], SCHEMA)


def words_of(text, lower=False):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "") if lower else text or ""
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def test_word_bpe_equals_the_library():
    from tokenizers import Tokenizer

    path = vocab_path("word_bpe_49k.json")
    theirs, ours = Tokenizer.from_file(path), wordbpe.WordBpe(path)
    rng = random.Random(3)
    texts = [t or "" for t in ODD] + corpus() + ["".join(rng.choice("aàeéiouthnrs' .-1") for _ in range(200)) for _ in range(300)]
    for t in texts:
        ids = theirs.encode(t, add_special_tokens=False).ids
        assert ours.encode(t) == ids
        assert ours.decode_texts([" ".join(map(str, ids))])[0] == theirs.decode(ids, skip_special_tokens=False)
    assert 0 < ours.failed < ours.tried


def test_byte_bpe_equals_the_library():
    from tokenizers import Tokenizer

    path = vocab_path("byte_bpe_50k.json")
    theirs, ours = Tokenizer.from_file(path), ByteBpe(path)
    for t in [t or "" for t in ODD] + corpus():
        assert ours.encode(t).tolist() == theirs.encode(t, add_special_tokens=False).ids


def test_long_words_merge_like_the_library_in_linear_time():
    from tokenizers import Tokenizer

    path = vocab_path("word_bpe_49k.json")
    theirs, ours = Tokenizer.from_file(path), wordbpe.WordBpe(path)
    rng = random.Random(4)
    for t in ["a" * 500, "abab" * 40 + " " + "ha" * 31, *("".join(rng.choice("abcdeth") for _ in range(n)) for n in (63, 64, 65, 130, 100_000))]:
        began = time.time()
        assert ours.encode(t) == theirs.encode(t, add_special_tokens=False).ids
        assert time.time() - began < 10


def test_op1_rows_equal_the_library(spark, tmp_path):
    from tokenizers import Tokenizer

    theirs = Tokenizer.from_file(vocab_path("word_bpe_49k.json"))
    rows = [(k, t) for k, t in enumerate(ODD + corpus())] + [(None, "null id"), (3, "repeated id"), (3, "repeated id")]
    spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, ids string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, op_queries.op1_bpe(spark, str(tmp_path)).collect()), key=str)

    def want(t):
        ids = theirs.encode(t or "", add_special_tokens=False).ids
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        return len(ids), sha(" ".join(map(str, ids))), sha(theirs.decode(ids, skip_special_tokens=False))

    assert got == sorted(((k, *want(t)) for k, t in rows), key=str)
    assert op_queries.op1_bpe(spark, str(tmp_path)).limit(0).count() == 0


def test_decode_documents(spark):
    path = vocab_path("word_bpe_49k.json")
    coded = wordbpe.encode_documents(frame(spark, ODD), path, decode=True)
    apart = {r["doc_id"]: r["decoded"] for r in wordbpe.decode_documents(coded, path).collect()}
    assert apart == {r["doc_id"]: r["decoded"] for r in coded.collect()}
    none = spark.createDataFrame([(1, None)], "doc_id long, ids string")
    assert wordbpe.decode_documents(none, path).collect()[0]["decoded"] == "" and wordbpe.decode_documents(none.limit(0), path).count() == 0


def test_exact_dedup_and_later_batches(spark):
    texts = corpus() + ODD
    index = exact_dedup.DigestIndex(spark)
    got = {r["doc_id"]: r for r in exact_dedup.exact_dedup(frame(spark, texts), index=index).collect()}
    for k, t in enumerate(texts):
        same = [j for j, u in enumerate(texts) if (u or "") == (t or "")]
        assert (got[k]["keep_id"], got[k]["group_size"], got[k]["kept"]) == (max(same), len(same), k == max(same))
    later = index.ingest(spark.createDataFrame([(900, texts[0]), (901, "new text")], "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["kept"] for r in later} == {900: False, 901: True}
    assert index.ingest(frame(spark, []).limit(0)).count() == 0


def test_language_id_learns_and_rejects(spark):
    rng = random.Random(5)
    langs = {"aa": "abcde", "zz": "vwxyz"}
    rows = [(k, " ".join("".join(rng.choice(langs[y]) for _ in range(5)) for _ in range(30)), y) for k in range(400) for y in [rng.choice(list(langs))]]
    rows += [(900, None, "aa"), (901, "123 ...", None), (None, "abc", "aa")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language_id.identify(docs, language_id.fit(docs, rows_per_language=80)).collect()
    real = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 900]
    assert sum(r["lang"] == r["lang_pred"] for r in real) / len(real) > 0.98 and not any(r["rejected"] for r in real)
    assert {r["lang_pred"] for r in got if r["doc_id"] in (900, 901)} == {"und"}
    none = docs.where("lang is null")
    assert {r["lang_pred"] for r in language_id.identify(none, language_id.fit(none)).collect()} == {"und"}


def test_language_id_rejects_what_it_did_not_learn():
    rng = random.Random(6)

    def text(letters, words):
        return " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(words))

    model = language_id.train([(text(letters, 60), name) for _ in range(200) for name, letters in (("aa", "abcdefgh"), ("zz", "stuvwxyz"))])
    known = [text(letters, n) for n in (1, 3, 10, 200) for letters in ("abcdefgh", "stuvwxyz") for _ in range(50)]
    other = [text("jklmnopq", n) for n in (10, 200) for _ in range(50)]
    assert sum(model.predict(known)[2]) <= 4 and all(model.predict(other)[2])
    assert model.predict([None, "12"])[:3] == (["und", "und"], [0.0, 0.0], [True, True])


def test_language_sample_is_bounded_where_one_row_repeats(spark):
    rows = [(1, "abc abd", "aa")] * 5000 + [(k, f"xyz {k}", "zz") for k in range(1000)]
    learned = language_id.training_rows(spark.createDataFrame(rows, "doc_id long, text string, lang string"), rows_per_language=100)
    learned = [(r["text"], r["label"]) for r in learned.collect()]
    assert sum(y == "aa" for _, y in learned) <= 1 and 50 < sum(y == "zz" for _, y in learned) <= 100


@pytest.mark.parametrize("width", [16, 1024])
def test_packing_places_every_id_once(spark, width):
    texts = corpus() + ODD
    got = packing.pack_documents(frame(spark, texts), vocab_path("byte_bpe_50k.json"), width=width).toPandas()
    coder = ByteBpe(vocab_path("byte_bpe_50k.json"))
    for k, t in enumerate(texts):
        ids = np.append(coder.encode(t or ""), 0).astype("<u4")
        mine = got[got.doc_id == k].sort_values("start")
        assert b"".join(mine.ids) == ids.tobytes()
        assert all(zlib.crc32(r.ids) == r.ids_crc32 and r.doc_tokens == len(ids) for r in mine.itertuples())
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() <= width
    assert packing.pack_documents(frame(spark, []).limit(0), vocab_path("byte_bpe_50k.json")).count() == 0


def test_substring_dedup_equals_brute_force(spark):
    texts = corpus(n=80) + ODD
    got = {r["doc_id"]: r for r in substring_dedup.substring_dedup(frame(spark, texts).withColumn("n_words", F.lit("x")).withColumn("_id", F.lit(1))).collect()}
    first = {}
    for k, t in enumerate(texts):
        w = words_of(t)
        gone = set()
        for a in range(len(w) - 12):
            if first.setdefault(tuple(w[a : a + 13]), k) < k:
                gone |= set(range(a, a + 13))
        assert (got[k]["n_words"], got[k]["n_removed"], got[k]["kept"]) == (len(w), len(gone), " ".join(x for a, x in enumerate(w) if a not in gone))


def test_token_counts_equal_a_plain_search(spark):
    counter = token_counts.UnigramCounter(["▁", "a", "b", "ab", "▁ab", "ba", "abab", "▁a"])
    for word, n, score in counter.walk({"▁abab", "▁ab", "▁aba", "▁bé", "▁"}):
        def best(at):
            if at == len(word):
                return (0.0, 0)
            size = len(word[at].encode())
            ways = [(counter.byte * size + best(at + 1)[0], best(at + 1)[1] - size)]
            ways += [(counter.score[word[at:e]] + best(e)[0], best(e)[1] - 1) for e in range(at + 1, len(word) + 1) if word[at:e] in counter.score]
            return max(ways)
        top = best(0)
        assert n == -top[1] and abs(score - top[0]) < 1e-9
    assert dict(counter.best_pieces([("▁abab", 3), ("▁aba", 2), ("▁é", 5)])) != {}


def test_op6_documents_equal_a_plain_search(spark, tmp_path):
    """Scores and totals of every document against a quadratic search without a trie."""
    path = vocab_path("piece_bpe_32k.model")
    rows = [(k, t) for k, t in enumerate(ODD + ["low lower lowest lowest", "newer wider", "tail\u00a0x\x1cy"] * 3)] + [(None, "low new"), (2, "low"), (2, "low")]
    docs = spark.createDataFrame([(k, t, 1, 2) for k, t in rows], "doc_id long, text string, n long, run long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    pieces = token_counts.pieces_of(path)
    score = dict(zip(pieces, token_counts.first_scores(len(pieces))))
    number = {p: k for k, p in enumerate(pieces)}

    def split(word):
        byte = min(score.values()) - 10.0
        best = [(0.0, 0, [])]
        for end in range(1, len(word) + 1):
            n = len(word[end - 1].encode())
            ways = [(best[end - 1][0] + n * byte, -best[end - 1][1] - n, best[end - 1][2])]
            ways += [(best[a][0] + score[word[a:end]], -best[a][1] - 1, [*best[a][2], word[a:end]]) for a in range(max(0, end - 32), end) if word[a:end] in score]
            top = max(ways, key=lambda w: w[:2])
            best.append((top[0], -top[1], top[2]))
        return best[-1]

    words = [["▁" + w for w in re.findall(r"[^\t-\r ]+", t or "")] for _, t in rows]
    for _ in range(token_counts.ROUNDS):
        used = Counter(p for w in words for one in w for p in split(one)[2])
        total = math.log(sum(used.values()) + len(pieces))
        score = {p: math.log(used[p] + 1) - total for p in pieces}
    found = token_counts.fit_scores(docs, path)
    assert all(abs(found[number[p]] - s) < 1e-9 for p, s in score.items())
    got = sorted(((r["doc_id"], r["n_pretokens"], r["n_tokens"], round(r["log_prob"], 6)) for r in op_queries.op6_token_counts(spark, str(tmp_path)).collect()), key=str)
    parts = [[split(one) for one in w] for w in words]
    assert got == sorted(((k, len(p), sum(x[1] for x in p), round(math.fsum(x[0] for x in p), 6)) for (k, _), p in zip(rows, parts)), key=str)
    assert token_counts.count_tokens(docs.limit(0), path).count() == 0


@pytest.mark.parametrize("words,percent,part", [(3, 90, 1_000_000), (5, 80, 1_000_000), (3, 90, 300)])
def test_jaccard_equals_brute_force(spark, monkeypatch, words, percent, part):
    monkeypatch.setattr(jaccard, "PART_SHINGLES", part)
    texts = corpus(seed=words, n=150) + ODD
    sets = []
    for t in texts:
        w = words_of(t, lower=True)
        sets.append({tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    forest = jaccard.Forest(len(sets))
    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                forest.join(a, b)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_groups(frame(spark, texts), words=words, percent=percent).collect()}
    assert got == {k: (len(s), forest.root(k)) for k, s in enumerate(sets)}


def test_chat_links_quotes(spark):
    rows = [
        (1, 0, "user", "How do I sort?\nThanks"), (1, 1, "assistant", "Use sort."), (1, 2, "user", "And  reverse?"),
        (1, 3, "assistant", "On Monday A wrote:\n> How do I  SORT?\n> Thanks\n>> older\nAs above."), (1, 4, "user", None), (2, 0, "user", "> unknown\nyes"), (None, 0, "user", "x"),
    ]
    got = {(r["conv_id"], r["turn"]): r for r in chat_format.linked_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got[1, 3]["parent_turn"] == 0 and got[1, 3]["by_quote"] and got[1, 3]["content"] == "As above." and got[1, 3]["quote_depth"] == 2
    assert got[1, 2]["parent_turn"] == 1 and got[1, 4]["parent_turn"] == 3 and got[1, 4]["content"] == ""
    assert got[2, 0]["content"] == "yes" and got[2, 0]["parent_turn"] is None and got[None, 0]["position"] is None
    assert [got[1, k]["position"] for k in range(5)] == [1, 2, 3, 4, 5]
    chat = {r["turn"]: r["chat"] for r in chat_format.rendered(chat_format.linked_conversations(spark.createDataFrame([(5, 0, "user", "a <|x|> b"), (5, 1, None, "> q")], "conv_id long, turn long, role string, text string"))).collect()}
    assert chat == {0: "<|im_start|>user\na < |x|> b<|im_end|>\n", 1: "<|im_start|>user\n<|im_end|>\n"}


def test_embeddings_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((60, 24))
    v = np.concatenate([base, base[:20] + 0.05 * rng.standard_normal((20, 24)), base[:5]])
    rows = [(k, x.tolist()) for k, x in enumerate(v)] + [(900, None), (901, [0.0] * 24), (902, [float("nan")] + [1.0] * 23), (903, [1.0, 2.0])]
    got = {r["vec_id"]: r for r in cap_filters.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    u = v / np.linalg.norm(v, axis=1)[:, None]
    close = (u @ u.T >= 0.9) & ~np.eye(len(u), dtype=bool)
    found = sum(got[k]["n_links"] for k in range(len(v)))
    assert 0.9 * close.sum() <= found <= close.sum() and all(got[k]["n_links"] <= close[k].sum() for k in range(len(v)))
    assert all(got[k]["n_links"] == 0 and got[k]["component_id"] == k and got[k]["kept"] for k in (900, 901, 902, 903))


@pytest.mark.parametrize("part", [8192, 64])
def test_embeddings_recall_of_many(spark, monkeypatch, part):
    """Links of 5,000 vectors, many of them near the threshold, with cells whole and cut."""
    monkeypatch.setattr(cap_filters, "PART", part)
    rng = np.random.default_rng(6)
    base = rng.standard_normal((2500, 48))
    v = np.concatenate([base, base + rng.uniform(0.3, 0.6, (2500, 1)) * rng.standard_normal((2500, 48))])
    docs = spark.createDataFrame([(k, x.tolist(), "x") for k, x in enumerate(v)], "vec_id long, embedding array<double>, n_links string")
    got = {r["vec_id"]: r for r in cap_filters.near_vectors(docs).collect()}
    u = v / np.linalg.norm(v, axis=1)[:, None]
    close = (u @ u.T >= 0.9) & ~np.eye(len(u), dtype=bool)
    assert 0.9 * close.sum() <= sum(r["n_links"] for r in got.values()) <= close.sum()
    assert all(got[k]["n_links"] <= close[k].sum() for k in got) and len(got) == 5000
    assert cap_filters.near_vectors(docs.limit(0)).count() == 0


def test_components(spark):
    rows = [(k, k + 1) for k in range(1, 40)] + [(100, 101), (7, None), (5, 5)]
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(rows, "u long, v long")).collect()}
    assert got == {**{k: 1 for k in range(1, 41)}, 100: 100, 101: 100}


def test_warc_round_trip(spark):
    rows = [(1, "http://a/ b", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "http://c", None), (4, "http://d", ""), (5, "http://e", "z" * 200_000)]
    got = {r["page_id"]: r for r in warc.warc_round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k, _, html in rows:
        raw = (html or "").encode()
        assert got[k]["payload_bytes"] == len(raw) and got[k]["payload_digest"] == base64.b32encode(hashlib.sha1(raw).digest()).decode()
    assert [(got[k]["record_type"], got[k]["refers_to"]) for k in range(1, 6)] == [("response", None), ("revisit", 1), ("response", None), ("revisit", 3), ("response", None)]
    raw = warc.make_record(1, "u", b"body", None)
    with pytest.raises(ValueError):
        warc.read_record(raw.replace(b"body", b"bodx"))


def test_pipeline_stages_keep_clean_documents(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(9)
    texts = [" ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(60)) for _ in range(40)]
    texts[5] = texts[3]
    texts[6] = texts[2] + " tail"
    rows = [(k, t, "aa", "s", len(t)) for k, t in enumerate(texts)] + [(99, "123", "aa", "s", 3)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == set(range(40)) - {3, 6}


def test_pipeline_exact_dedup_keeps_null_ids_and_tells_repeated_ids_apart(spark):
    import corpus_pipeline

    rows = [
        (None, "alone one"), (None, "alone two"), (None, "only null ids"), (None, "only null ids"), (None, "with an id too"), (4, "with an id too"),
        (5, "copy"), (9, "copy"), (5, "other text of 5"), (7, None), (8, ""),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(str, corpus_pipeline.without_copies(spark, docs, "").collect()))
    kept = [(None, "alone one"), (None, "alone two"), (None, "only null ids"), (None, "only null ids"), (4, "with an id too"), (9, "copy"), (5, "other text of 5"), (8, "")]
    assert got == sorted(str(r) for r in spark.createDataFrame(kept, docs.schema).collect())



def test_chat_links_nested_quotes(spark):
    rows = [
        (1, 0, "user", "First question?"), (1, 1, "assistant", "An answer\nin two lines"), (1, 2, "user", "Another thing"),
        (1, 3, "user", "> edited text\n>> First question?\nHm."), (1, 4, "user", "> > An answer\n> > in two lines\n>>> First question?\nYes."),
        (1, 5, "user", "> First question?\n>> Another thing\nBoth."), (1, 6, "user", ">> unknown\nNo."),
    ]
    got = {r["turn"]: (r["parent_turn"], r["by_quote"]) for r in chat_format.linked_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {0: (None, False), 1: (0, False), 2: (1, False), 3: (0, True), 4: (1, True), 5: (0, True), 6: (5, False)}



def test_warc_repeated_ids_are_records_of_their_own(spark):
    rows = [(1, "a"), (2, "a"), (2, "b"), (3, "a"), (3, "a"), (4, "b"), (4, "b")]
    got = warc.warc_round_trip(spark.createDataFrame([(k, "http://x", html) for k, html in rows], "page_id long, url string, html string")).collect()
    digest = {base64.b32encode(hashlib.sha1(x.encode()).digest()).decode(): x for x in "ab"}
    said = sorted((r["page_id"], digest[r["payload_digest"]], r["refers_to"] or 0) for r in got)
    assert said == [(1, "a", 0), (2, "a", 1), (2, "b", 0), (3, "a", 1), (3, "a", 1), (4, "b", 2), (4, "b", 2)]



def test_embeddings_of_one_id_stay_separate(spark):
    rng = np.random.default_rng(4)
    a, b, c = rng.standard_normal((3, 24))
    rows = [(1, a), (1, b), (2, a * 1.001 + 1e-3), (3, b + 1e-3), (3, a), (4, c), (4, c)]
    docs = spark.createDataFrame([(k, v.tolist()) for k, v in rows], "vec_id long, embedding array<double>")
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in cap_filters.near_vectors(docs).collect())
    assert got == [(1, 1, 1), (1, 2, 1), (2, 2, 1), (3, 1, 1), (3, 2, 1), (4, 1, 4), (4, 1, 4)]


def test_words_of_equal_polynomials_differ():
    from graintide.llm.wordbytes import hashed_words

    thue = "".join("ab"[bin(k).count("1") % 2] for k in range(2048))
    one, two = thue, thue.translate(str.maketrans("ab", "ba"))
    h = hashed_words(f"{one} {two} a b ab ba {one}".encode())[2]
    assert len(set(h.tolist())) == 6 and h[0] == h[-1]
    long = hashed_words((" ".join(["x" * 300_000, "y", "x" * 300_000])).encode())[2]
    assert long[0] == long[2] != long[1]


def test_heap_merge_counts_every_element_that_reaches():
    rng = random.Random(8)
    for _ in range(300):
        lists = [sorted(rng.sample(range(30), rng.randint(1, 20))) for _ in range(rng.randint(1, 9))]
        need = rng.randint(1, len(lists))
        want = [(v, c) for v in range(30) if (c := sum(v in one for one in lists)) >= need]
        assert jaccard.heap_merge(lists, need) == want


@pytest.mark.parametrize("texts", [["a", "b c", "b c"], [None, None, None], ["", " \n"], []])
def test_jaccard_without_signatures(spark, texts):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_groups(frame(spark, texts), words=3, percent=90).collect()}
    first = {}
    assert got == {k: (int(bool(words_of(t))), first.setdefault(t.strip(), k) if words_of(t) else k) for k, t in enumerate(texts)}


def test_jaccard_of_null_and_repeated_ids(spark):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(None, text), (1, text), (1, "other words that are alone here"), (7, text + " tail"), (9, "other words that are alone here"), (None, None)]
    docs = spark.createDataFrame([(k, t, 1, 2, 3) for k, t in rows], "doc_id long, text string, a long, component_id long, kind long")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_groups(docs, words=3, percent=90).collect()), key=str)
    assert got == sorted([(None, 58, None), (1, 58, 1), (1, 4, 1), (7, 59, 1), (9, 4, 1), (None, 0, None)], key=str)


def test_collisions_remove_and_link_nothing(spark):
    thue = "".join("ab"[bin(k).count("1") % 2] for k in range(1024))
    other = thue.translate(str.maketrans("ab", "ba"))
    body = [f"w{k}" for k in range(12)]
    docs = frame(spark, [" ".join([*body, thue]), " ".join([*body, other])])
    assert {r["n_removed"] for r in substring_dedup.substring_dedup(docs).collect()} == {0}
    assert {r["component_id"] for r in jaccard.jaccard_groups(docs, words=3, percent=90).collect()} == {0, 1}


def test_digest_index_reopens_from_its_path(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    first = exact_dedup.DigestIndex(spark, path=path, buckets=3)
    first.ingest(spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")).collect()
    spark.sql(f"DROP TABLE {first.name}")
    again = exact_dedup.DigestIndex(spark, path=path)
    assert again.buckets == 3 and again.entries().count() == 2
    got = {r["doc_id"]: (r["keep_id"], r["kept"]) for r in again.ingest(spark.createDataFrame([(5, "a"), (6, "c")], "doc_id long, text string")).collect()}
    assert got == {5: (1, False), 6: (6, True)} and again.entries().count() == 3
    before = {t.name for t in spark.catalog.listTables()}
    assert exact_dedup.exact_dedup(spark.createDataFrame([(None, None), (None, ""), (3, "x" * 200_000), (3, "x" * 200_000)], "doc_id long, text string")).where("kept").count() == 4
    assert {t.name for t in spark.catalog.listTables()} == before


def test_language_of_signs_clashing_columns_and_empty_tables(spark):
    rows = [(k, "abc abd " * 10, "aa", k) for k in range(40)] + [(50, "½ ² ① Ⅷ 12", "aa", 0), (50, "", None, 0), (None, "abc", None, 0), (51, "abc" * 50_000, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score long").withColumn("rejected", F.lit("x")).withColumn("label", F.lit(1))
    model = language_id.fit(docs)
    got = language_id.identify(docs, model).collect()
    assert {r["lang_pred"] for r in got if r["doc_id"] == 50} == {"und"} and {r["lang_pred"] for r in got if r["doc_id"] != 50} == {"aa"}
    assert all(0 <= r["score"] <= 1 for r in got) and language_id.identify(docs.limit(0), language_id.fit(docs.limit(0))).count() == 0


def test_op3_learns_from_its_side_only(spark, tmp_path):
    rows = [(k, "abc abd " * 10 if k % 2 else "xyz xyw " * 10, "aa" if k % 2 else "zz") for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = lambda k: zlib.crc32(str(k).encode()) % 4 == 2
    learned = language_id.training_rows(docs).collect()
    assert len(learned) == sum(not out(k) for k in range(400))
    wrong = docs.withColumn("lang", F.when(language_id.held_out(), F.lit("nonsense")).otherwise(F.col("lang")))
    wrong.write.parquet(str(tmp_path / "documents.parquet"))
    got = op_queries.op3_language_id(spark, str(tmp_path)).collect()
    assert all(r["held_out"] == out(r["doc_id"]) and r["lang_pred"] == rows[r["doc_id"]][2] for r in got) and len(got) == 400


def test_pipeline_stages_of_odd_rows(spark):
    import corpus_pipeline

    names = ["doc_id", "text", "lang", "n_chars", "score", "kept", "_kept", "_dropped", "n_words", "c0", "digest", "row_id"]
    schema = "doc_id long, text string, lang string, n_chars long, " + ", ".join(f"`{n}` string" for n in names[4:])
    body = " ".join(f"word{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10]}" for k in range(60))
    rows = [(None, None), (1, None), (2, ""), (3, body), (3, body), (4, body + " tail"), (None, body), (5, "123"), (6, "x" * 100_000), (7, "a b")]
    docs = spark.createDataFrame([(k, t, "aa", len(t or ""), *"stuvwxyz") for k, t in rows], schema)
    kept = {
        "language ID": [(3, body), (3, body), (4, body + " tail"), (None, body), (6, "x" * 100_000), (7, "a b")],
        "exact dedup": [(2, ""), (3, body), (3, body), (4, body + " tail"), (5, "123"), (6, "x" * 100_000), (7, "a b")],
        "n-gram Jaccard join": [r for r in rows if r[0] != 4],
        "substring dedup": [(k, "tail" if k == 4 else t) for k, t in rows],
    }
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, "").collect()
        assert stage(spark, docs.limit(0), "").count() == 0
        if name == "packing":
            assert sum(r["length"] for r in got) == sum(r["doc_tokens"] for r in got if r["start"] == 0) and len({r["doc_id"] for r in got}) == 8
            assert len({(r["sequence_id"], r["offset"]) for r in got}) == len(got)
            continue
        assert stage(spark, docs, "").columns == names
        assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == sorted(kept[name], key=str), name
        assert all(tuple(r)[4:] == tuple("stuvwxyz") for r in got)


@pytest.mark.parametrize("block", [1024, 4])
def test_op8_orders_by_replies_like_brute_force_and_sql(spark, tmp_path, monkeypatch, block):
    import duckdb

    monkeypatch.setattr(chat_format, "BLOCK", block)
    rng = random.Random(11)
    rows = []
    for conv in range(12):
        own = []
        for turn in range(rng.randint(1, 40)):
            own.append(f"Message {turn} of {conv}\nand  a line {rng.randrange(5)}")
            lines = []
            if turn and rng.random() < 0.6:
                at = rng.randrange(turn)
                lines = [("> " * rng.randint(1, 3)) + x for x in own[at].split("\n")[: rng.randint(1, 2)]]
                if rng.random() < 0.3:
                    lines += ["On Monday A wrote:", ">" + own[rng.randrange(turn)].split("\n")[0].upper()]
            rows.append((conv, turn, rng.choice(["user", "assistant"]), "\n".join([*lines, own[-1]])))
    rows += [(1, 0, "user", "again turn 0"), (1, 0, "user", "again turn 0"), (None, 3, "user", "> x"), (2, None, "user", None), (2, 50, None, None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("position", F.lit("x")).write.parquet(str(tmp_path / "conversations.parquet"))
    got = sorted(map(tuple, op_queries.op8_chat_format(spark, str(tmp_path)).select("conv_id", "turn", "role", "parent_turn", "by_quote", "quote_depth", "position", "content").collect()), key=str)
    duckdb.sql(f"CREATE OR REPLACE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert got == sorted(duckdb.sql(chat_format.SQL).fetchall(), key=str)
    assert sum(r[4] for r in got) > 100
    for conv in range(12):
        mine = [r for r in got if r[0] == conv and r[1] is not None]
        replies = {}
        for turn, parent in sorted({(r[1], r[3]) for r in mine}):
            replies.setdefault(parent, []).append(turn)
        order, stack = [], [None]
        while stack:
            turn = stack.pop()
            order += [turn] if turn is not None else []
            stack += replies.get(turn, [])[::-1]
        by_place = [r[1] for r in sorted(mine, key=lambda r: r[6])]
        assert by_place == sorted(by_place, key=order.index) and [r[6] for r in sorted(mine, key=lambda r: r[6])] == list(range(1, len(mine) + 1))


def test_op8_common_line_of_a_long_conversation(spark):
    rows = [(1, k, "user", f"> common line\ncommon line\nown {k}") for k in range(6000)]
    began = time.time()
    got = {r["turn"]: (r["parent_turn"], r["position"]) for r in chat_format.linked_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {k: (k - 1 if k else None, k + 1) for k in range(6000)} and time.time() - began < 60
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_format.linked_conversations(empty).count() == 0
