"""Decontamination, language, SentencePiece, fingerprints."""

import hashlib
import pickle
import random
import re
from pathlib import Path

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark import cloudpickle
from pyspark.sql import functions as F

from runnel.llm import decontamination, fingerprints, language_id, suffix_dedup
from runnel.llm._bytes import tidy
from runnel.llm.fm_index import FMIndex
from runnel.llm.queries import PIECE_MODEL, op10_language_id
from runnel.llm.sentencepiece_codec import Codec, _codec, decode, encode

from .helpers import LOW, SF, awkward, documents


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=60), st.lists(st.lists(st.integers(1, 4), min_size=1, max_size=5), min_size=1, max_size=6))
def test_fm_index_finds_every_occurrence(seq, patterns):
    seq = np.array([*seq, 0])
    index = FMIndex(seq, 5)
    m = np.zeros((len(patterns), 5), np.int64)
    for i, p in enumerate(patterns):
        m[i, 5 - len(p) :] = p
    lo, hi = index.search(m, np.array([len(p) for p in patterns]))
    for i, p in enumerate(patterns):
        want = [k for k in range(len(seq)) if seq[k : k + len(p)].tolist() == p]
        assert sorted(index.locate(np.arange(lo[i], hi[i])).tolist()) == want


def brute_hits(texts, items, width=8):
    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(LOW))
    wins = [(k, tuple(w[i : i + width])) for k, t in items for w in [split(t)] for i in range(max(1, len(w) - width + 1)) if w]
    for t in texts:
        w, hit, found = split(t), set(), set()
        for k, p in wins:
            for i in range(len(w) - len(p) + 1):
                if tuple(w[i : i + len(p)]) == p:
                    hit |= set(range(i, i + len(p)))
                    found.add(str(k))
        yield len(w), len(hit), sorted(found)


def test_decontamination(spark):
    texts = awkward()
    items = [(1, texts[25]), (2, "w1 w2"), (3, None), (4, ""), (10, " ".join(texts[26].split()[:9])), (11, texts[25]), (12, "the of and")]
    texts += ["Before. " + items[4][1].upper() + "! after", "w1, w2; w1 w2", "w1w2", "the of\nand the OF and"]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = documents(spark, texts)
    got = {r.doc_id: r for r in decontamination.scan(docs, bench).collect()}
    for i, want in enumerate(brute_hits(texts, items)):
        assert (got[i].n_words, got[i].n_hit, sorted(got[i]["items"])) == want
    cleaned = decontamination.decontaminated(docs, bench)
    assert cleaned.columns == docs.columns
    after = {r.doc_id: r for r in cleaned.collect()}
    for i, (t, want) in enumerate(zip(texts, brute_hits(texts, items), strict=True)):
        assert (after[i].text == t) == (want[1] == 0)
        assert after[i].n_chars == len(after[i].text or "")
    assert decontamination.scan(docs, bench.where("false")).where("n_hit > 0").count() == 0
    assert decontamination.scan(docs.where("false"), bench).count() == 0


def test_windows_in_blocks_give_the_same(spark, monkeypatch):
    items = [(i, f"w{i} w{i + 1} w{i + 2}") for i in range(20)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = documents(spark, [" ".join(f"w{i}" for i in range(k, k + 9)) for k in range(12)])
    whole = sorted((r.doc_id, r.n_hit, r["items"]) for r in decontamination.scan(docs, bench).collect())
    monkeypatch.setattr(decontamination, "MAX_WINDOWS", 10)
    assert sorted((r.doc_id, r.n_hit, r["items"]) for r in decontamination.scan(docs, bench).collect()) == whole


def test_items_that_share_their_windows_count_each(spark, monkeypatch):
    same, other = "alpha beta gamma delta", "one two three four"
    bench = spark.createDataFrame([(1, same), (2, same), (3, other)], "item_id long, text string")
    docs = documents(spark, [f"x {same} y", f"x {other} y", f"{other} and {same}"]).withColumn("n_chars", F.lit(7).cast("long"))
    for most in (decontamination.MAX_WINDOWS, 4):  # the items in one block, and in several
        monkeypatch.setattr(decontamination, "MAX_WINDOWS", most)
        cut = lambda n: [(r.text, r.n_chars) for r in decontamination.decontaminated(docs, bench, min_items=n).orderBy("doc_id").collect()]
        assert cut(1) == [("x  y", 4), ("x  y", 4), (" and ", 5)]
        assert cut(2) == [("x  y", 4), (f"x {other} y", 7), (" and ", 5)]
        assert cut(3) == [(f"x {same} y", 7), (f"x {other} y", 7), (" and ", 5)]


def test_language_of_held_out_documents(spark):
    rows = op10_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out and r.lang]
    assert len(held) > 20 and sum(r.lang_pred == r.lang for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_training_words_are_whole(spark):
    """Two languages whose words differ only after 100 bytes."""
    words = [chr(97 + i % 26) * 100 + chr(97 + i // 26) * 3 for i in range(60)]
    texts = [" ".join(w + end for w in words[k : k + 20]) for end in ("ing", "heit") for k in range(40)]
    docs = documents(spark, texts).withColumn("lang", F.when(F.col("doc_id") < 40, "aa").otherwise("bb"))
    assert {r.lang_pred for r in language_id.identify(docs.where("doc_id < 40"), language_id.train(docs)).collect()} == {"aa"}
    assert {r.lang_pred for r in language_id.identify(docs.where("doc_id >= 40"), language_id.train(docs)).collect()} == {"bb"}


def test_language_edges_and_switches(spark):
    train = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.train(train)
    some = {r.lang: r.text for r in train.where("lang IS NOT NULL AND n_chars > 400").collect()}
    en, fr = some["en"][:300], some["fr"][:300]
    texts = [None, "", "123 !? —", "Été", en + " " + fr, "a" * 100_000]
    rows = {r.doc_id: r for r in language_id.identify(documents(spark, texts).withColumn("score", F.lit("clash")), model).collect()}
    assert [rows[i].lang_pred for i in range(3)] == ["und"] * 3 and rows[0].score == 0
    assert rows[3].lang_pred != "und"
    n_words = len(re.findall("[A-Za-z\u0080-\U0010ffff]+", texts[4]))
    assert sum(x["words"] for x in rows[4].runs) == n_words and {x["lang"] for x in rows[4].runs} >= {"en", "fr"}
    nothing = language_id.train(train.where("false"))
    assert {r.lang_pred for r in language_id.identify(documents(spark, texts), nothing).collect()} == {"und"}


@pytest.fixture(scope="module")
def model_bytes():
    with open(PIECE_MODEL, "rb") as f:
        return f.read()


def test_sentencepiece_as_the_public_library(spark, model_bytes):
    library = sentencepiece.SentencePieceProcessor(model_proto=model_bytes)
    rng = random.Random(2)
    letters = "aabcdeé tthhe  in\n\t<s>漢字😀0123456789__==--/* ñx"
    texts = [t for t in awkward() if t] + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(800)] + ["  a b  ", "=" * 30, " " * 9 + "x", "\u0000a", "<s></s><0x0A>"]
    out = encode(documents(spark, texts), model_bytes)
    rows = {r.doc_id: r for r in out.collect()}
    for i, t in enumerate(texts):
        assert rows[i].ids == library.encode(t), t[:50]
        assert rows[i].exact and rows[i].n_ids == len(rows[i].ids) and rows[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    back = {r.doc_id: r.decoded for r in decode(out, model_bytes).collect()}
    assert back == dict(enumerate(texts))
    edge = encode(documents(spark, [None, ""]).withColumn("ids", F.lit(1)), model_bytes).collect()
    assert all(r.ids == [] and r.exact for r in edge)


def test_unigram_pieces_have_the_best_score(model_bytes):
    at = model_bytes.find(b"\x18\x02", model_bytes.rfind(b"<0xFF>"))
    while Codec(unigram := model_bytes[:at] + b"\x18\x01" + model_bytes[at + 2 :]).bpe:
        at = model_bytes.find(b"\x18\x02", at + 1)
    codec = Codec(unigram)
    for word in sorted(set(re.findall(r"\w+", " ".join(t for t in awkward() if t))))[:300]:
        text = "\u2581" + word
        best = [0.0] + [float("-inf")] * len(text)
        for i in range(1, len(text) + 1):
            for j in range(i):
                if text[j:i] in codec.ids:
                    best[i] = max(best[i], best[j] + codec.scores[codec.ids[text[j:i]]])
        ids = codec.encode(word)
        assert codec.decode(ids) == word
        if best[-1] > float("-inf"):
            assert sum(codec.scores[i] for i in ids) == best[-1], word


def test_fingerprints(spark):
    texts = awkward() + ["Same Words here now again", "same words  here now again"]
    docs = documents(spark, texts).where("doc_id <> 3")
    rows = {r.doc_id: r for r in fingerprints.edit_likeness(docs).collect()}
    kept = sorted(rows)

    def shingles(t):
        w = [x for x in re.split("[\x20\x09-\x0d]+", t.lower()) if x]
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    for n, i in enumerate(kept):
        t, nxt = texts[i] or "", texts[kept[(n + 1) % len(kept)]] or ""
        q = len(t) // 4
        e = t[: len(t) - q] + nxt[:q]
        assert rows[i].n_chars == len(t) and rows[i].edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        a, b = shingles(t), shingles(e)
        true = len(a & b) / len(a | b) if a | b else 1.0
        assert abs(rows[i].near_edited - true) < 0.2
    assert rows[len(texts) - 1].fingerprint == rows[len(texts) - 2].fingerprint != ""
    assert rows[0].fingerprint == "" and fingerprints.edit_likeness(docs.where("false")).count() == 0


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def plain_fingerprint(text):
    """The fingerprint by its definition, hash by hash."""
    from struct import pack

    from xxhash import xxh64_intdigest

    def chained(kind, *values):
        seed = 42
        for v in values:
            seed = xxh64_intdigest(pack(kind, v), seed)
        return signed(seed)

    words = [w for w in re.split("[\x20\x09-\x0d]+", (text or "").lower()) if w]
    if not words:
        return ""
    hashes = [signed(xxh64_intdigest(w.encode(), 42)) for w in words]
    shingles = [chained("<q", *hashes[i : i + 5]) for i in range(len(hashes) - 4)] if len(hashes) >= 5 else [signed(xxh64_intdigest(" ".join(map(str, hashes)).encode(), 42))]
    bins = {}
    for h in shingles:
        b = (h >> 56) + 128
        bins[b] = min(bins.get(b, h), h)
    out = []
    for i in range(256):
        if i in bins:
            h = bins[i]
        else:
            probe = next((p for j in range(8) if (p := chained("<i", i, j) % 256) in bins), None)
            h = bins[probe] if probe is not None else min((chained("<i", i, b), h) for b, h in bins.items())[1]
        out.append(f"{h & 255:02x}")
    return "".join(out)


def test_fingerprints_by_definition(spark):
    texts = awkward()
    rows = {r.doc_id: r for r in fingerprints.edit_likeness(documents(spark, texts)).collect()}
    prints = [plain_fingerprint(t) for t in texts]
    for i, t in enumerate(texts):
        after, t = texts[(i + 1) % len(texts)] or "", t or ""
        edited = t[: len(t) - len(t) // 4] + after[: len(t) // 4]
        assert (rows[i].n_chars, rows[i].fingerprint, rows[i].edited_fingerprint) == (len(t), prints[i], plain_fingerprint(edited))
        assert rows[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()

        def near(a, b):
            if a == b or not a or not b:
                return float(a == b)
            share = sum(a[k : k + 2] == b[k : k + 2] for k in range(0, 512, 2)) / 256
            return max(0.0, (share - 1 / 256) / (1 - 1 / 256))

        assert abs(rows[i].near_next - near(prints[i], prints[(i + 1) % len(texts)])) < 1e-12
        assert abs(rows[i].near_edited - near(prints[i], rows[i].edited_fingerprint)) < 1e-12


def test_fingerprints_of_repeated_and_null_ids(spark):
    rows = [(1, "a b c d e f"), (2, "first text of two"), (2, "second one with other words"), (2, "first text of two"), (None, "no id at all here"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fingerprint", F.lit(1)).withColumn("__place", F.lit(1))
    answer = lambda df: sorted(map(repr, fingerprints.edit_likeness(df).collect()))
    assert answer(docs) == answer(docs.repartition(5)) == answer(docs.orderBy(F.desc("text")))
    assert len(answer(docs)) == 6 and [r.doc_id for r in fingerprints.edit_likeness(docs.where("doc_id = 1")).collect()] == [1]


def test_null_items_extra_columns_and_long_texts(spark):
    said = " ".join(f"q{k}" for k in range(10))
    texts = [f"before {said} after", said.upper() + " " + " ".join(f"w{k}" for k in range(60_000)) + " " + said, None, "nothing of it"]
    docs = documents(spark, texts).withColumn("items", F.lit("x")).withColumn("id", F.lit(1)).withColumn("spans", F.lit(2))
    bench = spark.createDataFrame([(None, said), (7, said), (8, "short one"), (8, "short one"), (9, None)], "item_id long, text string")
    rows = {r.doc_id: r for r in decontamination.scan(docs, bench).collect()}
    assert [rows[i]["items"] for i in range(4)] == [["7"], ["7"], [], []] and [rows[i].n_hit for i in range(4)] == [10, 20, 0, 0]
    cut = decontamination.decontaminated(docs, bench)
    assert cut.columns == docs.columns and cut.where("doc_id = 0").first().text == "before  after"
    two = spark.createDataFrame([(1, said), (2, said), (None, said)], "item_id long, text string")
    kept = lambda n: decontamination.decontaminated(docs, two, min_items=n).where("doc_id = 0").first().text
    assert kept(2) == "before  after" and kept(3) == texts[0]


def test_viterbi_against_the_library(spark):
    """The model read as a unigram model: the library's segmentation scores what ours scores."""
    import sentencepiece

    raw = Path(PIECE_MODEL).read_bytes()
    codec = Codec(raw, merging=False)
    assert codec.bpe is False and Codec(raw).bpe

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    # field 3 of the trainer's part says which kind of model it is: 1 is unigram
    library = sentencepiece.SentencePieceProcessor(model_proto=raw + b"\x12" + varint(2) + b"\x18\x01")
    score = lambda ids: sum(codec.scores[i] for i in ids)
    for t in awkward():
        ours, theirs = codec.encode(t), library.encode(t or "")
        assert codec.decode(ours) == (t or "")
        if not any(codec.kinds[i] == 6 for i in ours + theirs):
            assert abs(score(ours) - score(theirs)) < 1e-3 * max(1.0, abs(score(theirs)))


def test_pairs_are_remembered_within_bounds(monkeypatch):
    from runnel.llm import sentencepiece_codec

    raw, text = Path(PIECE_MODEL).read_bytes(), " ".join(f"some words unlike others {k} naïve" for k in range(300))
    want = Codec(raw).encode(text)
    monkeypatch.setattr(sentencepiece_codec, "PAIRS", 5)
    small = Codec(raw)
    assert small.encode(text) == want and len(small._apart) <= 6


def test_encoding_of_no_rows_and_a_very_long_word(spark):
    from runnel.llm import sentencepiece_codec

    raw = Path(PIECE_MODEL).read_bytes()
    docs = documents(spark, ["ab" * 20_000, "x"])
    rows = sentencepiece_codec.encode(docs, raw, keep=["doc_id"]).collect()
    assert all(r.exact for r in rows) and sentencepiece_codec.encode(docs.where("false"), raw).count() == 0


def test_posteriors_by_all_labellings():
    """Forward-backward against the sum over every sequence of labels."""
    from itertools import product

    rng = np.random.default_rng(4)
    k, sizes = 3, [1, 4, 0, 6]
    model = language_id.Model(["a", "b", "c"], np.zeros((1, k)), rng.normal(size=(k, k)))
    scores = rng.normal(size=(sum(sizes), k)) * 2
    first = np.concatenate([[0], np.cumsum(sizes)])
    got = model.posteriors(scores, first)
    for a, b in zip(first[:-1], first[1:]):
        total, mass = 0.0, np.zeros((b - a, k))
        for labels in product(range(k), repeat=int(b - a)):
            p = np.exp(sum(scores[a + i, x] for i, x in enumerate(labels)) + sum(model.transitions[x, y] for x, y in zip(labels, labels[1:])))
            total += p
            for i, x in enumerate(labels):
                mass[i, x] += p
        assert np.allclose(got[a:b], mass / total, atol=1e-6)
    long = rng.normal(size=(100, k))
    whole = model.posteriors(long, np.array([0, 100]))
    ahead, back = np.zeros((100, k)), np.zeros((100, k))
    for i in range(100):
        ahead[i] = long[i] + (np.logaddexp.reduce(ahead[i - 1][:, None] + model.transitions, 0) if i else 0)
    for i in reversed(range(99)):
        back[i] = np.logaddexp.reduce(model.transitions + long[i + 1] + back[i + 1], 1)
    plain = np.exp(ahead + back - np.logaddexp.reduce(ahead + back, 1)[:, None])
    assert np.allclose(whole, plain, atol=1e-6)


def test_languages_of_repeated_rows_ties_and_no_rows(spark):
    texts = ["der hund und die katze", "the dog and the cat"] * 20
    docs = spark.createDataFrame([(i, t, "de" if i % 2 == 0 else "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    model = language_id.train(docs)
    assert len(model.lexicon.hashes) > 5
    rows = language_id.identify(docs.unionByName(docs), model).collect()
    assert len(rows) == 80 and all(r.lang_pred == r.lang for r in rows) and len({(r.doc_id, r.lang_pred, r.score) for r in rows}) == 40
    assert language_id.identify(docs.where("false"), model).count() == 0
    same = language_id.train(docs.select("doc_id", F.lit("same words").alias("text"), "lang"))
    tie = language_id.Model(["de", "en"], np.zeros_like(same.weights), np.zeros((2, 2), np.float32))
    assert language_id.identify(docs.limit(1), tie).first().lang_pred == "de"


def test_a_task_drops_the_tokenizer_that_another_operator_left():
    """Workers are used again: what tokenizing tasks keep for the next ones of theirs is gone when another operator's task begins."""
    _codec(Path(PIECE_MODEL).read_bytes())
    ran = []

    class Docs:
        select = lambda self, *names: self
        mapInArrow = lambda self, run, schema: ran.append(run)

    suffix_dedup._suffixes(Docs(), suffix_dedup.Ranges(np.zeros(0, "S12")), np.zeros(1, np.int32))
    own = lambda batches: iter(())
    own.__module__ = _codec.__module__
    list(tidy(own)([]))
    assert _codec.cache_info().currsize
    list(pickle.loads(cloudpickle.dumps(ran[0]))([]))
    assert _codec.cache_info().currsize == 0
