"""Sharding, chat formatting, WARC archives and token counts."""

import base64
import gzip
import hashlib
import zlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from runnel.llm import chat_format, sharding, token_counts, warc
from runnel.llm.queries import op6_chat_format, op8_sharding

from .helpers import SF, awkward, documents


def test_shards_are_even_and_slots_gapless(spark):
    texts = awkward() * 10
    rows = sharding.shard(documents(spark, texts), 8).collect()
    assert len(rows) == len(texts)
    size, slots = {}, {}
    for r in rows:
        t = texts[r.doc_id] or ""
        assert (r.size, r.text_crc32) == (len(t.encode()) + 1, zlib.crc32(t.encode()))
        size[r.shard] = size.get(r.shard, 0) + r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert max(size.values()) - min(size.values()) <= max(r.size for r in rows)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_a_hot_text_is_subdivided(spark):
    docs = documents(spark, ["copy of one text"] * 3000 + [f"text {i} of some length" for i in range(3000)])
    rows = sharding.shard(docs, 8).collect()
    size = [sum(r.size for r in rows if r.shard == s) for s in range(8)]
    assert max(size) < 1.1 * min(size)
    again = {(r.doc_id, r.shard, r.slot) for r in sharding.shard(docs.repartition(7), 8).collect()}
    assert again == {(r.doc_id, r.shard, r.slot) for r in rows}
    assert sharding.shard(docs.where("false"), 8).count() == 0


def test_written_shards(spark, tmp_path):
    docs = documents(spark, awkward())
    sharding.write_shards(docs, str(tmp_path / "out"), 4)
    assert spark.read.parquet(str(tmp_path / "out")).count() == docs.count()


CONVERSATIONS = [
    (1, 0, "user", "hi"), (1, 1, "user", "again </s> <\\s>"), (1, 2, "assistant", "[INST] no [/INST]"), (1, 3, "assistant", None), (1, 4, "assistant", "[+][\\+]<"),
    (2, 0, "system", "rules [SYS]"), (2, 1, "tool]x", "out [/ROLE]"), (2, 2, None, "[ROLE=abc]"), (3, 5, "assistant", ""), (4, 1, "user", "x\nyé\U0001f600"), (4, 1, "user", "x\nyé\U0001f600"), (4, 1, "assistant", "b"),
]


def test_chat_round_trip(spark):
    df = spark.createDataFrame(CONVERSATIONS, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    out = chat_format.format_chat(df)
    rows = out.withColumn("back", chat_format.read_back(F.col("formatted"))).withColumn("loss", chat_format.masked_texts(F.col("formatted"), F.col("loss_mask"))).collect()
    assert len(rows) == 4
    for r in rows:
        turns = sorted((t, role or "", text or "") for c, t, role, text in CONVERSATIONS if c == r.conv_id)
        assert [(b.role, b.text) for b in r.back] == [(x[1], x[2]) for x in turns]
        assert r["loss"] == [x[2] for x in turns if x[1] == "assistant"]
        assert r.n_turns == len(turns)
        for start, length in r.loss_mask:
            assert not any(m in r.formatted[start : start + length] for m in ("[INST]", "[/INST]", "</s>", "<s>", "[+]"))
    assert next(r.n_blocks for r in rows if r.conv_id == 1) == 2


def test_planted_conversation(spark):
    r = op6_chat_format(spark, SF).where("conv_id = -7").first()
    text = "</s>[INST] ok [/INST]"
    assert r.n_turns == 2 and r.loss_chars == len(text) and r.loss_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert r.turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()


PAGES = [(5, "http://a/ x", "same"), (2, "http://b", "same"), (9, None, "same"), (1, "u", None), (3, "u", ""), (4, "u", "é" * 50_000), (7, "u", "WARC/1.0\r\n\r\nx"), (7, "u", "WARC/1.0\r\n\r\nx"), (None, "u", "alone")]


def test_warc_round_trip(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("refers_to", F.lit("clash"))
    at = f"file://{tmp_path}/w"
    manifest = warc.write(pages, at, roll_bytes=300).collect()
    files = sorted(Path(tmp_path, "w", "data").glob("*.warc.gz"))
    assert [f.name for f in files] == sorted(r.name for r in manifest) and len(files) > 1
    rows = warc.read(spark, at, payloads=True).collect()
    assert len(rows) == len(PAGES)
    for r in rows:
        html = next((h or "") for p, _, h in PAGES if p == r.page_id).encode()
        assert (r.payload_bytes, r.payload_digest) == (len(html), base64.b32encode(hashlib.sha1(html).digest()).decode())
        assert r.payload is None or r.payload == html
    refers = {r.page_id: (r.record_type, r.refers_to) for r in rows}
    assert refers == {5: ("revisit", 2), 2: ("response", None), 9: ("revisit", 2), 1: ("response", None), 3: ("revisit", 1), 4: ("response", None), 7: ("response", None), None: ("response", None)}
    for f in files:
        assert gzip.decompress(f.read_bytes()).startswith(b"WARC/1.0\r\nWARC-Type: warcinfo")
    again = f"file://{tmp_path}/again"
    warc.write(pages.repartition(3), again, roll_bytes=300)
    assert [f.read_bytes() for f in files] == [f.read_bytes() for f in sorted(Path(tmp_path, "again", "data").glob("*.warc.gz"))]
    empty = f"file://{tmp_path}/empty"
    warc.write(pages.where("false"), empty)


def test_warc_ids_with_several_payloads(spark, tmp_path):
    """Only the rows whose own payload an earlier page has are revisits; an id may have several, and so may the null id."""
    pages = [(2, "u", "A"), (5, "u", "A"), (5, "u", "B"), (3, "u", "C"), (5, "v", "C"), (None, "u", "A"), (None, "u", "D"), (None, "v", "C"), (7, "u", None), (8, "u", ""), (8, "u", "E")]
    at = f"file://{tmp_path}/w"
    warc.write(spark.createDataFrame(pages, "page_id long, url string, html string"), at)
    digest = lambda html: base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()
    got = {(r.page_id, r.url, r.payload_digest, r.refers_to, r.payload and bytes(r.payload).decode()) for r in warc.read(spark, at, payloads=True).collect()}
    refers = {(5, "A"): 2, (5, "C"): 3, (None, "A"): 2, (None, "C"): 3, (8, ""): 7}
    assert got == {(p, u, digest(h), refers.get((p, h)), None if (p, h) in refers else h or b"") for p, u, h in pages}


def test_warc_files_roll_by_compressed_size(spark, tmp_path):
    """With ranges of the default size it is rolling that ends most files: a range fills several, compressed to a quarter."""
    assert [n // warc.range_count(n) // 4 // warc.ROLL_BYTES for n in (8 << 30, 64 << 30, 1 << 40)] == [4, 4, 4]
    word = "concat_ws(' ', transform(sequence(1, 500), i -> hex(xxhash64(id, i % 100))))"
    pages = spark.range(1200).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.expr(word).alias("html"))
    at, roll = f"file://{tmp_path}/w", 40_000
    files = warc.write(pages, at, roll_bytes=roll).collect()
    full = [f for f in files if f.bytes >= roll]
    assert len(full) > len(files) / 2 and max(f.bytes for f in files) < 1.5 * roll
    assert all(f.bytes == Path(tmp_path, "w", "data", f.name).stat().st_size for f in files)
    assert warc.read(spark, at).agg(F.count("*"), F.countDistinct("page_id"), F.sum("payload_bytes")).first() == (1200, 1200, pages.agg(F.sum(F.octet_length("html"))).first()[0])
    raw = Path(tmp_path, "w", "data", files[0].name).read_bytes()
    with pytest.raises(ValueError, match="cut off"):
        list(warc.records(raw[:-5]))


def changes(spark, rows):
    return spark.createDataFrame(rows, "op string, source string, lang string, tokenizer_version string, tokens long, old_tokens long")


def test_token_counts(spark, tmp_path):
    r = token_counts.Rollup(spark, f"file://{tmp_path}/r")
    one = changes(spark, [("insert", "a", "en", "v1", 10, None)] * 3 + [("insert", None, "en", "v1", None, None), ("insert", "b", "de", "v2", 5, None)])
    assert r.totals().count() == 0
    assert r.commit("1", one) and not r.commit("1", one)
    two = changes(spark, [("revise", "a", "en", "v1", 12, 10), ("delete", "b", "de", "v2", 5, None)])
    assert r.commit("2", two)
    want = {("a", "en", "v1"): (3, 32), (None, "en", "v1"): (1, 0)}
    got = lambda: {(x.source, x.lang, x.tokenizer_version): (x.docs, x.tokens) for x in r.totals().collect()}
    assert got() == want
    r.fold()
    assert got() == want and not r.commit("2", two) and got() == want
    r.commit("3", changes(spark, []))
    r.commit("4", changes(spark, [("insert", "c", None, "v1", 1, None)]))
    r.fold()
    assert got() == want | {("c", None, "v1"): (1, 1)}
    with pytest.raises(Exception, match="unknown op"):
        r.commit("5", changes(spark, [("upsert", "a", "en", "v1", 1, None)]))
    assert not r.committed("5")
    with pytest.raises(ValueError):
        r.commit("a/b", two)


def test_a_fold_may_stop_anywhere(spark, tmp_path):
    """Each step of a fold fails once; totals stay, and no batch counts again."""

    class Stop(Exception):
        pass

    class Steps:
        """A file system whose changes can be stopped before the nth one."""

        def __init__(self, fs):
            self.fs, self.left = fs, None

        def __getattr__(self, name):
            def call(*args):
                if name in ("rename", "delete") and self.left is not None:
                    if not self.left:
                        raise Stop
                    self.left -= 1
                return getattr(self.fs, name)(*args)

            return call

    want = {("a", "en", "v1"): (6, 60)}
    for stop in range(8):
        r = token_counts.Rollup(spark, f"file://{tmp_path}/r{stop}")
        r._fs = Steps(r._fs)
        got = lambda r=r: {(x.source, x.lang, x.tokenizer_version): (x.docs, x.tokens) for x in r.totals().collect()}
        one = changes(spark, [("insert", "a", "en", "v1", 10, None)] * 2)
        assert r.commit("1", one) and r.commit("2", one)
        r.fold()
        assert r.commit("3", one)
        r._fs.left = stop
        try:
            r.fold()
        except Stop:
            pass
        r._fs.left = None
        assert got() == want and not any(r.commit(b, one) for b in "123") and got() == want
        r.fold()
        assert got() == want and r._names("deltas") == [] and len(r._names("bases")) == 1
    # a fold that stops while it writes leaves a folder that does not count
    r.commit("4", one)
    r._fold_into(r._base(), r._open(r._base()), "bases/tmp-left")
    assert got() == {("a", "en", "v1"): (8, 80)}
    r.fold()
    assert got() == {("a", "en", "v1"): (8, 80)} and len(r._names("bases")) == 1


def test_two_tries_of_a_batch_count_once(spark, tmp_path):
    r = token_counts.Rollup(spark, f"file://{tmp_path}/r")
    one = changes(spark, [("insert", "a", "en", "v1", 10, None)])
    token_counts.deltas(one).write.parquet(f"file://{tmp_path}/r/deltas/1/zzzz")  # another sender's, complete
    assert not r.commit("1", one)
    (tmp_path / "r/deltas/2/0000").mkdir(parents=True)  # one that stopped
    assert r.commit("2", one)
    assert [(x.docs, x.tokens) for x in r.totals().collect()] == [(2, 20)]


def test_byte_pair_counts(spark):
    from tokenizers import Tokenizer

    texts = [*awkward(), "a" * 30_000, None]
    library = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    docs = documents(spark, texts)
    got = token_counts.with_bpe_counts(docs, {"v": Path("/opt/tokenizers/byte_bpe_50k.tiktoken").read_bytes()})
    assert got.columns == [*docs.columns, "v"]
    want = {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}
    assert {r.doc_id: r.v for r in got.collect()} == want
    with pytest.raises(ValueError, match="lang"):
        token_counts.with_bpe_counts(docs, {"lang": b""})


def test_the_sharding_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op8_sharding(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    size, slots = [0] * 16, {}
    for r in rows:
        raw = (docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        size[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(size) - min(size) <= max(r.size for r in rows)


def test_shards_of_null_ids_and_repeated_rows(spark):
    docs = spark.createDataFrame([(None, "x", 1), (None, None, 2), (1, "y", 3), (1, "y", 4)] * 3, "doc_id long, text string, shard int")
    rows = sharding.shard(docs, 4).collect()
    assert sorted(r.size for r in rows) == [1] * 3 + [2] * 9
    assert {s: sorted(r.slot for r in rows if r.shard == s) for s in {r.shard for r in rows}} == {s: list(range(sum(r.shard == s for r in rows))) for s in {r.shard for r in rows}}


def test_long_and_no_conversations(spark):
    turns = [(1, i, ("user", "user", "assistant")[i % 3], f"t{i} [+]") for i in range(5000)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    out = chat_format.format_chat(df)
    r = out.withColumn("back", chat_format.read_back(F.col("formatted"))).withColumn("loss", chat_format.masked_texts(F.col("formatted"), F.col("loss_mask"))).first()
    assert [(t.role, t.text) for t in r.back] == [(role, text) for _, _, role, text in turns]
    assert r.loss == [text for _, _, role, text in turns if role == "assistant"] and r.n_blocks == 3333
    assert chat_format.format_chat(df.where("false")).count() == 0


def test_an_archive_without_pages_and_a_manifest_renamed_twice(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://x/{i}", f"<p>{i}</p>" * 50) for i in range(40)], "page_id long, url string, html string")
    at = f"file://{tmp_path}/w"
    manifest = warc.write(pages, at, roll_bytes=400, range_bytes=2000)
    assert manifest.count() > 3 and warc.read(spark, at).count() == 40
    assert sorted(p.name for p in (tmp_path / "w/data").glob("*.gz")) == sorted(r.name for r in manifest.collect())
    empty = f"file://{tmp_path}/empty"
    warc.write(pages.where("false"), empty)
    (tmp_path / "empty/data").mkdir(parents=True, exist_ok=True)
    assert warc.read(spark, empty).count() == 0
