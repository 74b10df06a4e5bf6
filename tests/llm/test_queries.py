"""The registered queries against their SQL, and the pipeline against brute force."""

import re

import duckdb
import pytest

import corpus_pipeline
from runnel.llm.queries import ORACLES, QUERIES

from .helpers import LOW, SF, classes, removed_bytes, word_sets


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    got = df.collect()
    assert got
    if name not in ORACLES:
        return
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = con.execute(ORACLES[name])
    cols = [c[0] for c in found.description]
    assert sorted(cols) == sorted(df.columns)
    assert sorted(repr(tuple(r[c] for c in cols)) for r in got) == sorted(map(repr, found.fetchall()))


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    bench = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_join", "suffix_dedup", "decontamination", "sentencepiece"]
    stages = {}
    cur = docs
    for name, stage in corpus_pipeline.STAGES:
        cur = corpus_pipeline.written(stage(spark, cur, SF), name)
        stages[name] = cur
        if name != "sentencepiece":
            assert cur.columns == docs.columns
    # all documents have letters of one language
    kept = {r.doc_id for r in stages["language_id"].collect()}
    assert kept == {k for k, t in before.items() if t and re.search("[A-Za-z]", t)}
    ids = sorted(kept)
    found = classes(word_sets([before[i] for i in ids], 5), 80)
    firsts = [ids[k] for k in range(len(ids)) if found[k] == k]
    assert sorted(r.doc_id for r in stages["ngram_join"].collect()) == firsts
    masks = removed_bytes([before[i] for i in firsts])
    cut = {r.doc_id: r.text for r in stages["suffix_dedup"].collect()}
    for i, m in zip(firsts, masks, strict=True):
        exact = len(before[i].encode()) - sum(m)
        assert exact <= len(cut[i].encode()) <= exact + 6 * (1 + sum(m) // 50)
    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", t.translate(LOW))
    windows = {tuple(w[k : k + 8]) for t in bench for w in [split(t)] for k in range(max(1, len(w) - 7))}
    has = lambda t: any(tuple(w[k : k + n]) in windows for w in [split(t)] for n in {len(x) for x in windows} for k in range(len(w) - n + 1))
    clean = {r.doc_id: r.text for r in stages["decontamination"].collect()}
    assert any(has(t) for t in cut.values())
    assert {i for i in cut if clean[i] != cut[i]} == {i for i, t in cut.items() if has(t)}
    assert stages["sentencepiece"].where("NOT exact").count() == 0
