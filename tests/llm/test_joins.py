"""Near duplicates and repeated passages against brute force, on awkward texts."""

import hashlib
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from runnel.llm import ngram_join, suffix_dedup
from runnel.llm._graph import components
from runnel.llm._order import multikey_quicksort
from runnel.llm._shared import apart
from runnel.llm._sketches import members_apart

from .helpers import awkward, classes, documents, removed_bytes, word_sets


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80)])
def test_ngram_join(spark, width, percent):
    texts = awkward()
    got = {r.doc_id: r for r in ngram_join.ngram_join(documents(spark, texts), width, percent).collect()}
    sets = word_sets(texts, width)
    want = classes(sets, percent)
    assert len(got) == len(texts)
    for i, s in enumerate(sets):
        assert (got[i].n_shingles, got[i].component_id) == (len(s), want[i]), texts[i] and texts[i][:40]


def test_links_that_only_other_members_have(spark):
    """A chain: each document is like the next, the ends are not alike."""
    words = [f"w{i}" for i in range(100)]
    texts = [" ".join(words[k : k + 60]) for k in range(0, 20, 2)]
    rows = ngram_join.ngram_join(documents(spark, texts), 1, 90).collect()
    assert {r.component_id for r in rows} == {0}


def _walks(seed, families, steps):
    """Families of texts, each a random walk of single words away from a common beginning: many groups that are alike and barely linked."""
    rng = np.random.default_rng(seed)
    base = [f"w{i}" for i in range(60)]
    out = []
    for _ in range(families):
        now = list(base)
        for _ in range(rng.integers(0, 6)):
            now[rng.integers(60)] = f"x{rng.integers(40)}"
        for _ in range(steps):
            now[rng.integers(60)] = f"x{rng.integers(40)}"
            out.append(" ".join(now))
    return [out[i] for i in rng.permutation(len(out))]


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_that_are_alike_and_barely_linked(spark, seed):
    texts = _walks(seed, 12, 12)
    got = {r.doc_id: r.component_id for r in ngram_join.ngram_join(documents(spark, texts), 1, 90).collect()}
    want = classes(word_sets(texts, 1), 90)
    assert len(set(got.values())) > 1 and [got[i] for i in range(len(texts))] == list(want)


def test_one_link_joins_two_groups(spark, monkeypatch):
    """Two stars of like documents whose middles are apart; one pair is looked at, not each with each."""
    words = [f"w{i}" for i in range(80)]
    texts = []
    for gone in range(2):
        for k in range(40):
            texts.append(" ".join([f"g{gone}{i}" for i in range(4)] + words + [f"own{gone}-{k}"]))
    looked, links = [], ngram_join._links
    monkeypatch.setattr(ngram_join, "_links", lambda pairs, *rest: (looked.append(pairs.count()), links(pairs, *rest))[1])
    rows = ngram_join.ngram_join(documents(spark, texts), 1, 80).collect()
    want = classes(word_sets(texts, 1), 80)
    assert all(r.component_id == want[r.doc_id] for r in rows)
    assert sum(looked) < 200


def test_join_of_repeated_rows_null_ids_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", 1), (1, "a b c d e f", 2), (None, "a b c d e f", 3), (0, "a b c d e f", 4)], "doc_id long, text string, component_id int")
    rows = ngram_join.ngram_join(docs, 3, 90).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.component_id or 0) for r in rows)[:3] == [(False, 0, 0), (False, 1, 0), (False, 1, 0)] and len(rows) == 4
    assert ngram_join.ngram_join(docs.where("false"), 3, 90).count() == 0
    kept = ngram_join.first_of_each(docs, 3, 90)
    assert kept.columns == docs.columns and sorted(r.doc_id or -1 for r in kept.where("doc_id IS NOT NULL").collect()) == [-1]


def test_suffix_dedup(spark):
    texts = awkward()
    docs = documents(spark, texts)
    got = {r.doc_id: r for r in suffix_dedup.repeats(docs).collect()}
    masks = removed_bytes(texts)
    for i, (t, m) in enumerate(zip(texts, masks, strict=True)):
        b = (t or "").encode()
        kept = bytes(x for x, y in zip(b, m, strict=True) if not y)
        spans = sum(1 for j in range(len(m)) if m[j] and (j == 0 or not m[j - 1]))
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(b), sum(m), spans, hashlib.sha256(kept).hexdigest()), i
    cut = suffix_dedup.without_repeats(docs)
    assert cut.columns == docs.columns
    for r in cut.collect():
        b = (texts[r.doc_id] or "").encode()
        exact = bytes(x for x, y in zip(b, masks[r.doc_id], strict=True) if not y)
        assert len(exact) <= len((r.text or "").encode()) <= len(exact) + 3 * max(1, got[r.doc_id].n_spans) * 2
    assert suffix_dedup.repeats(docs.where("false")).count() == 0


def test_copies_are_answered_by_the_suffix_array(spark, monkeypatch):
    docs = documents(spark, ["a text of its own, long enough to be a passage of more than fifty bytes"] * 3 + ["short"] * 2)
    got = lambda: [(r.n_removed, r.n_spans) for r in suffix_dedup.repeats(docs).orderBy("doc_id").collect()]
    assert got() == [(0, 0), (71, 1), (71, 1), (0, 0), (0, 0)]
    none = spark.createDataFrame([], "doc_id long, row long, start int, finish int")
    monkeypatch.setattr(suffix_dedup, "repeated_spans", lambda docs: none)
    assert got() == [(0, 0)] * 5


def test_components(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(30)] + [(100, 101), (101, 102), (200, 200)], "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {i: 0 for i in range(31)} | {100: 100, 101: 100, 102: 100}


def test_members_apart(spark):
    df = spark.range(1000).withColumn("x", F.col("id") * 2)
    maybe, never = members_apart(df, "id", spark.range(10, 20))
    ids = {r.id for r in maybe.collect()}
    assert set(range(10, 20)) <= ids and maybe.count() + never.count() == 1000


def expected(rows):
    """n_removed and kept bytes of each (id, text): rows of one id do not count for each other, null ids not at all."""
    out = []
    for i, t in rows:
        earlier = set()
        for j, u in rows:
            if i is not None and j is not None and j < i:
                b = (u or "").encode()
                earlier |= {b[k : k + 50] for k in range(len(b) - 49)}
        b = (t or "").encode()
        mask = bytearray(len(b))
        for k in range(len(b) - 49):
            if b[k : k + 50] in earlier:
                mask[k : k + 50] = b"\x01" * 50
        out.append((sum(mask), hashlib.sha256(bytes(x for x, y in zip(b, mask, strict=True) if not y)).hexdigest()))
    return out


def test_repeated_and_null_ids(spark):
    say = lambda tag, n: " ".join(f"{tag}{k}" for k in range(n))
    rows = [(1, say("a", 40)), (2, say("x", 10) + say("a", 30)), (2, say("b", 40)), (2, say("b", 40)), (3, say("b", 20) + say("c", 20)), (None, say("c", 20)), (4, say("c", 20)), (None, None), (5, None), (5, say("a", 12))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit("x")).withColumn("spans", F.lit(1)).withColumn("__id", F.lit(2))
    got = sorted((r.doc_id or 0, r.n_removed, r.kept_sha256) for r in suffix_dedup.repeats(docs).collect())
    assert got == sorted((i or 0, n, sha) for (i, _), (n, sha) in zip(rows, expected(rows), strict=True))
    cut = suffix_dedup.without_repeats(docs)
    assert cut.columns == docs.columns
    assert sorted((r.doc_id or 0, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in cut.collect()) == sorted((i or 0, sha) for (i, _), (_, sha) in zip(rows, expected(rows), strict=True))


def test_hot_beginnings_are_split(spark, monkeypatch):
    """A passage that all documents share, in contexts of their own, with ranges so small that its beginnings fill several."""
    say = lambda tag, n: " ".join(f"{tag}{k}" for k in range(n))
    hot = say("hot", 30)
    texts = [f"{say(f'd{d % 20}', 4)} {hot} {say(f'e{d % 15}', 4)}" for d in range(120)]
    docs = documents(spark, texts)
    want = expected(list(enumerate(texts)))
    answer = lambda: [(r.n_removed, r.kept_sha256) for r in suffix_dedup.repeats(docs).orderBy("doc_id").collect()]
    assert answer() == want
    monkeypatch.setattr(suffix_dedup, "RANGE_BYTES", 300)
    made = []
    monkeypatch.setattr(suffix_dedup, "Ranges", lambda bounds, real=suffix_dedup.Ranges: made.append(real(bounds)) or made[-1])
    assert answer() == want
    assert len(made[0].hot)
    monkeypatch.setattr(suffix_dedup, "LARGE", 3)
    assert answer() == want


def test_multikey_quicksort():
    rng = np.random.default_rng(2)
    columns = [rng.integers(0, 3, 50_000).astype(np.uint64), rng.integers(0, 40, 50_000), rng.integers(0, 1 << 60, 50_000)]
    order = multikey_quicksort(*columns)
    assert np.array_equal(order, np.lexsort(columns[::-1]))
    assert len(multikey_quicksort(np.zeros(0))) == 0 and sorted(multikey_quicksort(np.zeros(20_000))) == list(range(20_000))


def test_packed_ranges_come_back():
    rng = np.random.default_rng(1)
    cols = [rng.integers(-5, 5, 999), rng.integers(0, 2, 999) * 77, rng.integers(0, 9, 999).astype(np.uint64), *[rng.integers(0, 9, 999).astype(k) for k in suffix_dedup._COLUMNS[1:]]]
    assert all(np.array_equal(a, b) for a, b in zip(cols, suffix_dedup._unpack(suffix_dedup._pack(*cols)), strict=True))


def test_places_are_partitions_of_their_own(spark):
    for n in (1, 7, 64, 301):
        at = spark.createDataFrame([(int(x),) for x in apart(n)], "x int").repartition(n, "x").select(F.spark_partition_id().alias("p"))
        assert sorted(r.p for r in at.collect()) == list(range(n))


def test_of_repeated_ids_the_same_row_stays(spark):
    rows = [(1, "a b c d e f g", 5), (1, "other words than those before it", 6), (1, "other words than those before it", 7), (2, "x y z x y w", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int")
    kept = lambda df: sorted((r.doc_id, r.text, r.n) for r in ngram_join.first_of_each(df).collect())
    assert kept(docs) == kept(docs.orderBy(F.desc("n"))) == kept(docs.repartition(3)) and len(kept(docs)) == 2


def test_tasks_over_texts_take_bounded_memory(spark, monkeypatch):
    """Workers of a stage share an executor with its JVM: what a task allocates beside a batch stays small, and no record is lost by it."""
    rng = random.Random(3)
    texts = ["".join(rng.choices("abcdefgh ", k=2500)) for _ in range(1600)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(1600)), "row": [0] * 1600, "text": texts})
    ran = []

    class Docs:
        select = lambda self, *names: self
        mapInArrow = lambda self, run, schema: ran.append(run)
        sparkSession = spark

    ranges = suffix_dedup.Ranges(np.zeros(0, "S12"))
    suffix_dedup._suffixes(Docs(), ranges, apart(ranges.count))
    ngram_join.signatures(Docs(), 5, 80, np.zeros(1 << ngram_join.COUNTER_BITS, np.uint8))
    for run, limit in zip(ran, (90, 80), strict=True):
        tracemalloc.start()
        rows = [out.num_rows for out in run([batch])]
        peak = tracemalloc.get_traced_memory()[1] >> 20
        tracemalloc.stop()
        assert sum(rows) and peak < limit, peak
