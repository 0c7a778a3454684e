"""HTML extraction, cross-tokenizer alignment and fill-in-the-middle: brute force, round trips and the cases their docstrings define."""

import hashlib
import html
import random
import re
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from graintide.llm import alignment, fill_middle, html_extract, packing
from graintide.llm import queries as op_queries
from graintide.llm.queries import vocab_path

SCHEMA = "doc_id long, text string, output string"
ODD = ["", None, " \t\n", "a", "a b", "  lead and  tail \n", "İstanbul ΣΑΣ x́ é ﬁ <|endoftext|> <s> naïve", "12345 !!!    日本語 🙂", "x" * 3000, "tail\x1c\x85end\x0b", "a▁b", "ab  " * 500, "has <P> in it", "a <S", "<0x41> </s>"]


def texts_of(seed=1, n=60):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefghié日") for _ in range(rng.randint(1, 7))) for _ in range(150)]
    texts = [" ".join(rng.choice(vocab) for _ in range(rng.randint(1, 300))) for _ in range(n)]
    return ODD + texts + texts[:5]


def frame(spark, texts):
    return spark.createDataFrame([(k, t, "extra") for k, t in enumerate(texts)], SCHEMA)


def plain_example(key, text):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    digest = hashlib.sha256(f"42:{'null' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    lo, hi = sorted(x % (len(units) + 1) for x in h[:2])
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(units), "plain", None, None, text
    p, m, s = ("".join(x) for x in (units[:lo], units[lo:hi], units[hi:]))
    form = "spm" if h[3] % 100 < 80 else "psm"
    return len(units), form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle_equals_lists_of_units(spark):
    docs = frame(spark, texts_of()).union(spark.createDataFrame([(None, "no id here", "x"), (3, "a", "x")], SCHEMA))
    found = fill_middle.restored(fill_middle.fill_in_middle(docs)).collect()
    expected = sorted((repr((r.doc_id, *plain_example(r.doc_id, r.text), r.text or "")) for r in docs.collect()))
    assert sorted(repr((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored)) for r in found) == expected
    assert {r.form for r in found} == {"plain", "psm", "spm"}
    assert fill_middle.fill_in_middle(docs.limit(0)).count() == 0


def test_op13_equals_its_sql(spark, tmp_path):
    frame(spark, texts_of(4)).drop("output").write.parquet(str(tmp_path / "documents.parquet"))
    rows = op_queries.op13_fill_middle(spark, str(tmp_path)).collect()
    base = duckdb.connect()
    base.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(map(tuple, rows)) == sorted(base.execute(fill_middle.SQL).fetchall())


def test_ropes_split_and_join_anywhere():
    rng = random.Random(5)
    text = " ".join("w" * rng.randint(1, 9) for _ in range(5000)) + "  \n"
    units = re.findall(fill_middle.UNIT, text)
    rope = fill_middle.rope_of_units(text)
    assert (rope.units, rope.chars, str(rope)) == (len(units), len(text), text)
    for _ in range(50):
        at = rng.randint(0, len(units))
        one, two = rope.by_units(at)
        assert (str(one), str(two), one.units, two.units) == ("".join(units[:at]), "".join(units[at:]), at, len(units) - at)
        rope = fill_middle.joined(one, two)
        assert str(rope) == text and rope.height < 20
    char = rng.randint(0, len(text))
    assert [*map(str, fill_middle.rope_of_chars(text).by_chars(char))] == [text[:char], text[char:]]


def test_very_long_texts_become_examples_in_time():
    began = time.time()
    for text in ("word " * 400_000, "x" * 2_000_000, " " * 1_000_000, "a" + "\n" * 1_000_000):
        for key in range(8):
            _, form, _, _, out = fill_middle.transform(text, key, 42, 50, 80, fill_middle.SENTINELS)
            assert fill_middle.invert(out, form, fill_middle.SENTINELS) == text
    assert time.time() - began < 30


def test_output_without_its_sentinels_fails():
    with pytest.raises(ValueError):
        fill_middle.invert("<P>a<S>b", "psm", fill_middle.SENTINELS)


def plain_alignment(texts):
    """Both libraries, byte sets and loops."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    from graintide.llm.bytebpe import byte_alphabet

    one, two = Tokenizer.from_file(vocab_path("byte_bpe_50k.json")), SentencePieceProcessor(model_file=vocab_path("piece_bpe_32k.model"))
    one.encode_special_tokens = True
    letters = byte_alphabet()
    rows, counts = [], Counter()
    for text in texts:
        spelt, a, b = (" " + text).encode() if text else b"", [], []
        if text:
            a = [(i, bytes(letters[c] for c in one.id_to_token(i))) for i in one.encode(" " + text, add_special_tokens=False).ids]
            for i in two.encode(text):
                p = two.id_to_piece(i)
                b.append((i, bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode()))
            if b"".join(x for _, x in a) != spelt or b"".join(x for _, x in b) != spelt:
                a, b = [], []
        ends = [[], []]
        for side, tokens in enumerate((a, b)):
            at = 0
            for i, x in tokens:
                at += len(x)
                ends[side].append((at, i))
        cuts = sorted({e for e, _ in ends[0]} & {e for e, _ in ends[1]})
        links = [(i, j) for e, i in ends[0] for f, j in ends[1] if e == f] if len(a) < 600 else [(i, dict(ends[1])[e]) for e, i in ends[0] if e in dict(ends[1])]
        groups = ";".join("|".join(",".join(str(i) for e, i in side if lo < e <= hi) for side in ends) for lo, hi in zip([0, *cuts], cuts))
        counts.update(links)
        rows.append((len(a), len(b), len(cuts), groups, links))
    best = Counter()
    for (i, j), n in counts.items():
        best[j] = max(best[j], n)
    return [(a, b, g, len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(groups.encode()).hexdigest() if groups else "") for a, b, g, groups, links in rows]


@pytest.mark.parametrize("broadcast_pairs", [alignment.BROADCAST_PAIRS, 0])
def test_alignment_equals_loops(spark, tmp_path, monkeypatch, broadcast_pairs):
    texts = [t[:600] if t and len(t) > 600 else t for t in texts_of(2, 40)]
    frame(spark, texts).drop("output").write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(alignment.align_tokenizers, "__defaults__", (*alignment.align_tokenizers.__defaults__[:-1], broadcast_pairs))
    rows = {r.doc_id: tuple(r)[1:] for r in op_queries.op12_alignment(spark, str(tmp_path)).collect()}
    assert rows == dict(enumerate(plain_alignment(texts)))
    assert rows[1] == (0, 0, 0, 0, 0, 0, "") and rows[ODD.index("a▁b")] == (0, 0, 0, 0, 0, 0, "")


def test_tokens_without_bytes_are_linked_by_products():
    import numpy as np

    one, two, group = alignment.Aligner._links(np.array([2, 2, 5]), np.array([2, 4, 5, 5]), np.array([2, 5]))
    assert [*zip(one.tolist(), two.tolist(), group.tolist())] == [(0, 0, 0), (1, 0, 0), (2, 2, 1), (2, 3, 1)]


def test_alignment_of_empty_tables_and_clashing_columns(spark):
    docs = spark.createDataFrame([(None, "some words", 1, 2), (7, None, 3, 4), (7, "some words", 5, 6)], "doc_id long, text string, pairs int, row_key int")
    rows = alignment.align_tokenizers(docs, vocab_path("byte_bpe_50k.json"), vocab_path("piece_bpe_32k.model"))
    found = sorted(map(tuple, rows.collect()), key=repr)
    assert [r[0] for r in found] == [7, 7, None] and found[0][1:] == (0, 0, 0, 0, "", 0, 0)
    assert found[1][1:] == found[2][1:] and found[1][6] == found[1][4] and found[1][7] == 2 * found[1][4]
    assert alignment.align_tokenizers(docs.limit(0), vocab_path("byte_bpe_50k.json"), vocab_path("piece_bpe_32k.model")).count() == 0


def labelled_page(rng, k):
    words = lambda n: " ".join(rng.choice(["sun", "moon &amp; stars", "über", "a", "of"]) for _ in range(n))
    title, body = words(5), [words(rng.randint(1, 60)) for _ in range(rng.randint(1, 6))]
    page = f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style><script>var t='</p>';</script></head><body><nav><ul>"
    page += "".join(f'<li><a href="/{k}">{words(1)}</a></li>' for _ in range(6)) + f'</ul></nav><!-- ad --><div class="ad">{words(9)}</div><article><h1>{title}</h1>'
    page += "".join(f"<p><b>{b}<br>" if rng.random() < 0.2 else f"<p>{b}</p>" for b in body) + f"</article><footer>&copy; {words(8)}</footer>" + "</body></html>" * (rng.random() < 0.9)
    return page, "\n".join(html.unescape(x) for x in (title, *body))


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(8)
    pages = spark.createDataFrame([(k, "u", labelled_page(rng, k)[0]) for k in range(200)], "page_id long, url string, html string")
    return html_extract.fit(pages)


def test_main_text_of_labelled_pages(spark, tmp_path):
    rng = random.Random(9)
    made = [labelled_page(rng, k) for k in range(120)] + [(None, ""), ("", "")]
    rows = [(k, f"http://x/{k}", p, "other") for k, (p, _) in enumerate(made)] + [(None, None, made[0][0], "other")]
    spark.createDataFrame(rows, "page_id long, url string, html string, text string").write.parquet(str(tmp_path / "pages.parquet"))
    found = op_queries.op11_html_extract(spark, str(tmp_path)).collect()
    assert {r.page_id: r.text for r in found if r.page_id is not None} == {k: t for k, (_, t) in enumerate(made)}
    assert all(r.n_chars == len(r.text) for r in found) and len(found) == len(rows)
    assert [r.text for r in found if r.page_id is None] == [made[0][1]]


P = "A long paragraph of the article with some words, <a href='/x'>a link</a> and <i>more</i> words in it."
Q = "A long paragraph of the article with some words, a link and more words in it."


@pytest.mark.parametrize(
    "page, text",
    [
        (f"<body><header><h1>Site</h1><a href=/>home</a></header><main><article><header><h1>Title</h1></header><p>{P}</p><aside class='x'><p>{P}</p></aside><p>End.</p><footer>tags</footer></article></main><footer><p>{P}</p></footer>", f"Title\n{Q}\nEnd."),
        (f"<body><div id=wrapper><div class='top-nav'><a href=/>one</a> <a href=/>two</a></div><div class='post-body'><h1>T</h1><p>{P}</p><p>{P}<p>x<br>y</div><div id='comments'><p>{P}</p><p>{P}</p><p>{P}</p></div></div>", f"T\n{Q}\n{Q}\nx y"),
        (f"<div class='cookie-notice'><p>{P}{P}</p></div><article><h1>T</h1><p>{P}</p><form><label>Mail</label><input><p>{P}</p></form><noscript>no</noscript><blockquote>said</blockquote></article><section class='reader-comments'><article class='comment'><p>{P}{P}</p></article></section>", f"T\n{Q}\nsaid"),
        (f"<form action=/><h1>T</h1><p>{P}</p></form><div class=sidebar><ul><li>a<li>b</ul></div>", f"T\n{Q}"),
        (f"<article><h1>T</h1><div class='ad'>buy</div><ul><li>first &lt;one&gt;<li>second&nbsp;&eacute; &#x41;</ul><p>{P}</article><p>Copyright of this site, all rights reserved by us.", f"T\nfirst <one>\nsecond é A\n{Q}"),
        ("<nav><a href=/>only</a></nav><footer>nothing here</footer>", ""),
        (f"<article><p>{P}</p><p>cut off <a href='", f"{Q}\ncut off"),
        (f"<article><p title=\"open>one two</p><p>{P}</p></article><!-- never closed <p>x", f"one two\n{Q}"),
        (f"<article><h1>T</h1><p>{P}</p><p>a <a href=/>b</a></p><ul><li><a href=/>c</a></ul></article><div><p>Copyright of this site", f"T\n{Q}\na b\nc"),
        (f"<article><p>1 < 2 and 3 > 2</p><p>{P}</p><script>if (a < b) document.write('<p>no</p>')", f"1 < 2 and 3 > 2\n{Q}"),
    ],
)
def test_main_text_of_other_pages(model, page, text):
    assert html_extract.extract(page, model) == text


def test_damaged_and_hostile_pages_end_in_time(model):
    rng = random.Random(3)
    began = time.time()
    for _ in range(300):
        page = list(labelled_page(rng, 1)[0])
        for _ in range(20):
            page[rng.randrange(len(page))] = rng.choice("<>\"'/ &a-")
        html_extract.extract("".join(page), model)
        html_extract.features("".join(page))
    for page in ("<a" * 300_000, "<a '\"" * 100_000, "<div class=ad>" * 50_000 + "<h1>x</h1>", "<b>" * 100_000 + "<p>" * 100_000, "<!--" * 200_000, "<" * 300_000, "<div>" * 100_000 + "</p></b>" * 100_000, "<script>" * 50_000, "&amp;" * 200_000, '<p a="' * 100_000 + ">"):
        html_extract.extract(page, model)
    assert time.time() - began < 60


def test_model_of_no_labelled_pages(spark):
    pages = spark.createDataFrame([(1, "u", f"<body><h1>T</h1><p>{P}</p></body>"), (2, "u", None)], "page_id long, url string, html string")
    found = html_extract.main_text(pages, html_extract.fit(pages)).collect()
    assert [r.text for r in found] == [f"T\n{Q}", ""]
    assert html_extract.main_text(pages.limit(0), html_extract.fit(pages.limit(0))).count() == 0


def placed_lengths(histogram, width):
    """All places of a plan, piece by piece: sequence -> [(offset, length)], and how each rank of a length was cut."""
    places, first_apart, tokens_apart = packing.placements(packing.shortest_pack_first(histogram, width), width)
    rest = packing.parts_of(tokens_apart % width, width)
    sequences, cut = {}, {}
    for length, lo, hi, _, part_start, part_length, packs, first, offset in places:
        for rank in range(lo, hi):
            nth = rank - lo
            if packs is not None:
                seq, at = first + nth % packs, offset + nth // packs * length
            else:
                at = offset + nth * part_length
                seq, at = first_apart + at // width, at % width
                if seq == first_apart + tokens_apart // width:
                    k = next(k for k, (a, n) in enumerate(rest) if a <= at < a + n)
                    seq, at = seq + k, at - rest[k][0]
            sequences.setdefault(seq, []).append((at, part_length))
            cut.setdefault((length, rank), []).append((part_start, part_length))
    return sequences, cut


@pytest.mark.parametrize("width", [1024, 100])
@pytest.mark.parametrize("histogram", [{100: 1000}, {340: 1000}, {1: 1000}, {1: 5}, {300: 500, 400: 500}, {600: 333}, {513: 77, 1: 20}, {1000: 40}, {700: 10, 90: 11, 7: 5000}, {1024: 5, 3: 1}, {}])
def test_every_length_packs_without_much_padding(histogram, width):
    histogram = {n: k for n, k in histogram.items() if n <= width} if width == 1024 else {min(n, 99): k for n, k in histogram.items()}
    sequences, cut = placed_lengths(histogram, width)
    tokens = sum(n * k for n, k in histogram.items())
    assert sorted(cut) == sorted((n, r) for n, k in histogram.items() for r in range(k))
    for (length, _), parts in cut.items():
        assert [a for a, _ in sorted(parts)] == [0, *np.cumsum([n for _, n in sorted(parts)]).tolist()[:-1]] and sum(n for _, n in parts) == length
    padding = 0
    for parts in sequences.values():
        parts.sort()
        used = sum(n for _, n in parts)
        assert [a for a, _ in parts] == [0, *np.cumsum([n for _, n in parts]).tolist()[:-1]] and used <= width
        padding += 0 if used & (used - 1) == 0 else width - used
    assert sorted(sequences) == list(range(len(sequences)))
    if width == 1024:
        assert padding <= 0.03 * (tokens + padding)


def test_like_texts_and_nulls_pack_well(spark):
    texts = ["word " * 560] * 120 + [None] * 200
    rows = packing.pack_documents(frame(spark, texts), vocab_path("byte_bpe_50k.json")).toPandas()
    used = rows.groupby("sequence_id")["length"].sum()
    assert rows.groupby("doc_id")["length"].sum().equals(rows.groupby("doc_id")["doc_tokens"].first().rename("length"))
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in rows.itertuples())
    assert sum(0 if n & (n - 1) == 0 else 1024 - n for n in used.tolist()) <= 0.03 * used.sum()
    for _, g in rows.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]]


#: Different words that a sum of bytes times fixed factors can't tell apart.
MEETING = ("knlmnnnmmmnolnkonnlomn", "olonmlmmmnmknmokmlokmm")


def test_words_that_met_under_a_linear_hash(spark):
    from graintide.llm import jaccard, substring_dedup
    from graintide.llm.wordbytes import hashed_words

    for key in (0, 1, 2**64 - 1):
        h = hashed_words(" ".join([*MEETING, "a" * 8, "a" * 9, "a" * 16, "a" * 300, "a" * 301, "b" * 300, MEETING[0]]).encode(), key=key)[2]
        assert len(set(h.tolist())) == 8 and h[0] == h[-1]
    assert hashed_words(b"Ab", lower=True)[2][0] == hashed_words(b"ab")[2][0] != hashed_words(b"ab", key=5)[2][0]
    body = [f"w{k}" for k in range(12)]
    docs = frame(spark, [" ".join([*body[:6], m, *body[6:]]) for m in MEETING])
    assert {r["n_removed"] for r in substring_dedup.substring_dedup(docs).collect()} == {0}
    assert {r["component_id"] for r in jaccard.jaccard_groups(docs, words=3, percent=90).collect()} == {0, 1}


@pytest.mark.parametrize("bits", [0, 1, 64])
def test_windows_of_equal_hashes_are_told_apart_by_their_words(bits):
    from graintide.llm import substring_dedup as sd
    from graintide.llm.wordbytes import hashed_words

    rng = random.Random(6)
    words = [rng.choice(["a", "b", "a" * 9, "a" * 8 + "b", "x" * 300, "x" * 299 + "y"]).encode() for _ in range(400)]
    raw = b" ".join(words)
    starts, ends, h = hashed_words(raw)
    at = np.arange(len(words) - 2)
    doc = np.array([rng.randint(0, 9) for _ in at])
    h1, h2 = (x % np.uint64(2**bits) if bits < 64 else x for x in sd.rolling(h, 3))
    found = sd.repeated(h1, h2, doc, at, sd.Words(np.frombuffer(raw, np.uint8), starts, ends, 3))
    least = {}
    for k in at.tolist():
        least[tuple(words[k : k + 3])] = min(int(doc[k]), least.get(tuple(words[k : k + 3]), 99))
    assert found.tolist() == [int(doc[k]) > least[tuple(words[k : k + 3])] for k in at.tolist()]


def replies_in_order(parents):
    """Depth first: turn k replies to parents[k] (None for the first); a run goes on before what branches off it, the latest branching first."""
    runs, run_of = {None: [0]}, {0: None}
    for k in range(1, len(parents)):
        head = run_of[k - 1] if parents[k] == k - 1 else k
        run_of[k] = head
        runs.setdefault(head, []).append(k)
    below = {}
    for head in runs:
        if head is not None:
            below.setdefault(run_of[parents[head]], []).append((-parents[head], head))
    out, todo = [], [None]
    while todo:
        head = todo.pop()
        out += runs[head]
        todo += [h for _, h in sorted(below.get(head, []), reverse=True)]
    return {turn: k + 1 for k, turn in enumerate(out)}


@pytest.mark.parametrize("shape", ["two threads", "star", "random"])
def test_chat_orders_deep_and_wide_branching_in_rows_of_one_size(spark, monkeypatch, shape):
    from graintide.llm import chat_format

    rng = random.Random(2)
    n = 3000 if shape != "random" else 400
    parents = [None] + [{"two threads": max(0, k - 2), "star": 0, "random": rng.randrange(k)}[shape] for k in range(1, n)]
    rows = [(1, k, "user", (f"> text {parents[k]} here\n" if parents[k] is not None else "") + f"text {k} here") for k in range(n)]
    widest = []
    stage = chat_format.staged
    monkeypatch.setattr(chat_format, "staged", lambda df, label: widest.append([f.dataType.typeName() for f in df.schema.fields]) or stage(df, label))
    got = {r["turn"]: (r["parent_turn"], r["position"]) for r in chat_format.linked_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    place = replies_in_order(parents)
    assert got == {k: (parents[k], place[k]) for k in range(n)}
    assert not any("array" in kinds for kinds in widest)


def test_language_model_of_many_languages_and_long_texts(spark, monkeypatch):
    from graintide.llm import language_id

    rng = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda y: letters[y // 26 % 26] + letters[y % 26] + letters[y // 676] + rng.choice("aeiou")
    rows = [(10 * y + k, " ".join(word(y) for _ in range(12)), f"l{y}") for y in range(1100) for k in range(2)] + [(99_000 + k, " ".join(word(3) for _ in range(40_000)), "l3") for k in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(8)
    seen = []
    trained = language_id.train_runs
    monkeypatch.setattr(language_id, "train_runs", lambda learn, held, **o: seen.append((len({y for _, y in learn}), max(len(t) for t, _ in learn + held), len(held))) or trained(learn, held, epochs=1, **o))
    model = language_id.fit(docs)
    learnt = {y for y in range(1100) if any(zlib.crc32(str(10 * y + k).encode()) % 4 != 2 for k in range(2))}
    assert seen[0][0] == len(learnt | {3}) > 1000 and seen[0][1] <= 512 * 5 and seen[0][2] <= 400 * 80 and len(model.labels) == seen[0][0]


def test_op3_equals_the_model_on_each_text(spark, tmp_path):
    from graintide.llm import language_id

    rng = random.Random(5)
    rows = [(k, None if k % 40 == 7 else " ".join("".join(rng.choice("abcd" if k % 2 else "wxyz") for _ in range(5)) for _ in range(rng.randint(1, 80))), "aa" if k % 2 else "zz") for k in range(300)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    model = language_id.fit(spark.read.parquet(str(tmp_path / "documents.parquet")))
    got = {r["doc_id"]: (r["lang_pred"], r["score"], r["rejected"]) for r in op_queries.op3_language_id(spark, str(tmp_path)).collect()}
    for k, text, _ in rows:
        words = (text or "").split()
        if not words:
            assert got[k] == ("und", 0.0, True)
            continue
        grams = [g for w in words for g in language_id.subwords([w])[0].tolist()]
        z = (model.logits[grams].astype(float).mean(axis=0) + model.bias) / model.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert got[k][0] == model.labels[int(z.argmax())] and abs(got[k][1] - p.max()) < 1e-9
