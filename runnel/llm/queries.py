"""Queries over the training-data operators, and DuckDB SQL where it can express them."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontamination, fingerprints, language_id, ngram_join, sentencepiece_codec, sharding, suffix_dedup, token_counts, warc
from ._shared import fresh_dir, table, written


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(table(spark, sf_dir, "documents"), 3, 90)


#: Shingles as joined words (or all words of a short text); pairs that share a shingle; documents reached by links.
OP1_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 2) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 90 * (x.n + y.n - shared)),
reached(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(least, d.doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a, min(b) AS least FROM reached GROUP BY 1) r ON r.a = d.doc_id
"""


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loads estimates for all documents, revises them to exact counts, adds a second tokenizer, removes toxic documents; sends a batch twice."""
    docs = table(spark, sf_dir, "documents")
    exact = [token_counts.count_tokens(F.col("text"), v).alias(v) for v in token_counts.TOKENIZERS]
    counted = written(docs.select("doc_id", "source", "lang", F.floor(F.coalesce(F.char_length("text"), F.lit(0)) / 4).alias("estimate"), *exact), "token-counts")
    rollup = token_counts.Rollup(spark, fresh_dir(spark, "token-rollup"))

    def change(df: DataFrame, op: str, version: str, tokens: str, old: str | None = None) -> DataFrame:
        return df.select("source", "lang", F.lit(op).alias("op"), F.lit(version).alias("tokenizer_version"), F.col(tokens).alias("tokens"), (F.col(old) if old else F.lit(None).cast("long")).alias("old_tokens"))

    toxic = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id").distinct()
    gone = counted.join(toxic, "doc_id", "left_semi")
    revised = change(counted, "revise", "words-1", "words-1", "estimate")
    rollup.commit("1-load", change(counted, "insert", "words-1", "estimate"))
    rollup.commit("2-exact", revised)
    rollup.commit("3-word-punct", change(counted, "insert", "word-punct-1", "word-punct-1"))
    rollup.commit("2-exact", revised)
    rollup.commit("4-toxic", change(gone, "delete", "words-1", "words-1").unionByName(change(gone, "delete", "word-punct-1", "word-punct-1")))
    return rollup.totals()


OP2_SQL = r"""
WITH kept AS (SELECT source, lang, coalesce(text, '') AS text FROM documents WHERE doc_id IS NULL OR doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL))
SELECT source, lang, tokenizer_version, count(*) AS docs, sum(n)::BIGINT AS tokens FROM (
  SELECT source, lang, 'words-1' AS tokenizer_version, len(regexp_extract_all(text, '[^\x09-\x0D\x20]+')) AS n FROM kept
  UNION ALL
  SELECT source, lang, 'word-punct-1', len(regexp_extract_all(text, '[0-9A-Za-z\x{80}-\x{10FFFF}]+|[^0-9A-Za-z\x{80}-\x{10FFFF}\x09-\x0D\x20]')) FROM kept)
GROUP BY ALL
"""


#: Public byte-pair vocabularies as rank files, by tokenizer version.
VOCABULARIES = {"byte-bpe-50k": "/opt/tokenizers/byte_bpe_50k.tiktoken", "byte-bpe-multi-50k": "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"}


def token_counts_bpe(spark: SparkSession, sf_dir: str, vocabularies: dict[str, str] | None = None) -> DataFrame:
    """The rollup over public byte-pair tokenizers: loads all documents under the first, then under the second, and folds in between."""
    read = {v: Path(p).read_bytes() for v, p in (vocabularies or VOCABULARIES).items()}
    counted = written(token_counts.with_bpe_counts(table(spark, sf_dir, "documents").select("source", "lang", "text"), read).drop("text"), "bpe-counts")
    rollup = token_counts.Rollup(spark, fresh_dir(spark, "token-rollup"))
    for v in read:
        rollup.commit(v, counted.select("source", "lang", F.lit("insert").alias("op"), F.lit(v).alias("tokenizer_version"), F.col(v).alias("tokens")))
        rollup.fold()
    return rollup.totals()


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeats(table(spark, sf_dir, "documents"))


#: Texts as hexadecimal digits in chunks of 500 bytes, each with the 49 bytes after it; each string's smallest document; runs of strings that are hit.
OP3_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
parts AS (SELECT doc_id, unnest(regexp_extract_all(h, '.{1,1000}')) AS part, generate_subscripts(regexp_extract_all(h, '.{1,1000}'), 1) - 1 AS i FROM d WHERE h <> ''),
chunks AS (SELECT doc_id, i, length(part) // 2 AS n, part || coalesce(substr(lead(part) OVER (PARTITION BY doc_id ORDER BY i), 1, 98), '') AS part FROM parts),
strings AS (SELECT doc_id, i * 500 + k AS pos, substr(part, 2 * k + 1, 100) AS s FROM (SELECT *, unnest(range(0, least(n, length(part) // 2 - 49))) AS k FROM chunks WHERE length(part) >= 100)),
firsts AS (SELECT s, min(doc_id) AS least FROM strings GROUP BY s HAVING min(doc_id) < max(doc_id)),
hits AS (SELECT doc_id, pos, lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM strings JOIN firsts USING (s) WHERE doc_id > least),
runs AS (SELECT doc_id, pos, sum(CASE WHEN before IS NULL OR pos > before + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM hits),
spans AS (SELECT doc_id, run, min(pos) AS a, max(pos) + 50 AS b FROM runs GROUP BY 1, 2),
kept AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since, row_number() OVER (PARTITION BY doc_id ORDER BY a DESC) = 1 AS last FROM spans),
cut AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(substr(h, (2 * since + 1)::BIGINT, (2 * (a - since))::BIGINT) || CASE WHEN last THEN substr(h, (2 * b + 1)::BIGINT) ELSE '' END, '' ORDER BY a) AS h
  FROM kept JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, (length(d.h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(cut.h, d.h))) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)
"""


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = fresh_dir(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), at)
    return warc.read(spark, at).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP4_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS h, min(page_id) OVER (PARTITION BY html) AS first FROM p),
b AS (
  SELECT *, array_to_string([substr('0000000100100011010001010110011110001001101010111100110111101111', 4 * (instr('0123456789abcdef', substr(h, i, 1)) - 1) + 1, 4) FOR i IN range(1, 41)], '') AS bits
  FROM d
)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * substr(bits, i, 1)::INT + 8 * substr(bits, i + 1, 1)::INT + 4 * substr(bits, i + 2, 1)::INT
    + 2 * substr(bits, i + 3, 1)::INT + substr(bits, i + 4, 1)::INT, 1) FOR i IN range(1, 161, 5)], '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM b
"""


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edit_likeness(table(spark, sf_dir, "documents"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    saying = "</s>[INST] ok [/INST]"
    planted = spark.createDataFrame([(-7, 0, "user", saying), (-7, 1, "assistant", saying)], "conv_id long, turn long, role string, text string")
    out = chat_format.format_chat(turns.unionByName(planted))
    back = out.withColumn("back", chat_format.read_back(F.col("formatted"))).withColumn("loss", F.array_join(chat_format.masked_texts(F.col("formatted"), F.col("loss_mask")), ""))
    turns_text = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("back").cast("long").alias("n_turns"), F.sha2(turns_text.cast("binary"), 256).alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


OP6_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, length(regexp_replace(text, '([\[<])(\\*(?:/?s>|/?INST\]|/?SYS\]|ROLE=|/ROLE\]|\+\]))', '\1\\\2', 'g')) AS escaped,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before
  FROM t
), p AS (
  SELECT *, escaped + CASE WHEN before = role THEN 3 ELSE CASE role WHEN 'user' THEN 7 + 8 WHEN 'assistant' THEN 4 + 5 WHEN 'system' THEN 6 + 7
    ELSE 8 + length(base64(encode(role))) + 8 END END AS chars
  FROM e
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM p GROUP BY conv_id
"""


#: A public tokenizer's model file.
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def op7_sentencepiece(spark: SparkSession, sf_dir: str, model_path: str = PIECE_MODEL) -> DataFrame:
    model = Path(model_path).read_bytes()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sentencepiece_codec.encode(docs, model, keep=["doc_id"])


def sentencepiece_viterbi(spark: SparkSession, sf_dir: str, model_path: str = PIECE_MODEL) -> DataFrame:
    """The same texts with the model's pieces and scores read as a unigram model: Viterbi on the scores."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sentencepiece_codec.encode(docs, Path(model_path).read_bytes(), keep=["doc_id"], merging=False)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(table(spark, sf_dir, "documents"), 16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontamination.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n = F.size("items").cast("long")
    return out.select("doc_id", "n_words", "n_hit", n.alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"), (n >= 2).alias("contaminated"))


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(w), 8) AS n, array_to_string(w[i : i + least(len(w), 8) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 7) + 1)) AS i FROM b WHERE len(w) > 0)
), lens AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)
), hits AS (SELECT doc_id, item_id, dw.n, i FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
marked AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hits) GROUP BY 1),
found AS (SELECT doc_id, count(s) AS n_items, sha256(string_agg(s, ',' ORDER BY s)) AS h FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hits) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, coalesce(h, sha256('')) AS items_sha256,
  coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN marked USING (doc_id) LEFT JOIN found USING (doc_id)
"""


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.train(docs.where(language_id.fold() != 1))
    held_out = F.coalesce(language_id.fold() == 1, F.lit(False)).alias("held_out")
    return language_id.identify(docs.select("doc_id", held_out, "text"), model, keep=["doc_id", "held_out"]).drop("runs")


QUERIES = {"op1_ngram_join": op1_ngram_join, "op2_token_counts": op2_token_counts, "op3_suffix_dedup": op3_suffix_dedup, "op4_warc": op4_warc, "op5_fingerprints": op5_fingerprints, "op6_chat_format": op6_chat_format, "op7_sentencepiece": op7_sentencepiece, "op8_sharding": op8_sharding, "op9_decontamination": op9_decontamination, "op10_language_id": op10_language_id, "token_counts_bpe": token_counts_bpe, "sentencepiece_viterbi": sentencepiece_viterbi}
ORACLES = {"op1_ngram_join": OP1_SQL, "op2_token_counts": OP2_SQL, "op3_suffix_dedup": OP3_SQL, "op4_warc": OP4_SQL, "op6_chat_format": OP6_SQL, "op9_decontamination": OP9_SQL}
