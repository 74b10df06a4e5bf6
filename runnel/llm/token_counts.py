"""Delta-maintained token counts by source, language and tokenizer version.

A batch of changes (inserts, deletes, revised counts) is summed to signed deltas per key and committed under its batch id: each try
writes a folder of its own under it, which counts once its write is complete, and of several complete ones only the first by name does. A
batch id that is committed already changes nothing, so batches may be sent again after any failure, also by two senders at once.
Totals are the sums of all committed deltas. Folding writes a base under the next version's name, with the ids of the batches in it; the newest
complete base counts, and batches that it names do not count again, so a fold that stops anywhere changes no total. Keys whose documents have all
gone disappear.

Tokens are counted by versioned tokenizers: two patterns as Spark expressions, and files of public byte-pair vocabularies, whose paths
are parameters.

Changes: op (insert, delete or revise), source, lang, tokenizer_version, tokens, and old_tokens for a revision (null: 0). Null
sources, languages and versions are keys of their own; null tokens count as 0; other ops fail. Repeated rows count each
time: a change is an event, and deduplication is the batch id's. Empty batches commit and change nothing.
"""

from __future__ import annotations

import uuid
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ._shared import small_batches

KEYS = ["source", "lang", "tokenizer_version"]
SCHEMA = "source string, lang string, tokenizer_version string, docs long, tokens long"

#: Characters of words beyond ASCII count as word characters.
TOKENIZERS = {
    "words-1": r"[^\x09-\x0D\x20]+",
    "word-punct-1": r"[0-9A-Za-z\x{80}-\x{10FFFF}]+|[^0-9A-Za-z\x{80}-\x{10FFFF}\x09-\x0D\x20]",
}


def count_tokens(text: Column, version: str) -> Column:
    """How many tokens the tokenizer of that version finds; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKENIZERS[version])), F.lit(0)).cast("long")


#: How the public byte-pair vocabularies part a text before merging: a fixed value that belongs to their files.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(4)
def _encoding(ranks: bytes):
    import base64

    import tiktoken

    merges = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in ranks.splitlines() if line)}
    return tiktoken.Encoding("own", pat_str=PIECES, mergeable_ranks=merges, special_tokens={})


def with_bpe_counts(docs: DataFrame, vocabularies: dict[str, bytes], text_col: str = "text") -> DataFrame:
    """docs with a column of token counts for each version, by the content of its rank file; null text has no token."""
    small_batches(docs.sparkSession)
    versions = [v for v in vocabularies if v not in docs.columns]
    if len(versions) < len(vocabularies):
        raise ValueError(f"columns of these names are there: {sorted(set(vocabularies) - set(versions))}")
    at = docs.columns.index(text_col)
    schema = StructType([*docs.schema.fields, *[StructField(v, LongType()) for v in versions]])

    def run(batches):
        encodings = [_encoding(vocabularies[v]) for v in versions]
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            counts = [pa.array([len(e.encode_ordinary(t)) for t in texts], pa.int64()) for e in encodings]
            yield pa.RecordBatch.from_arrays([*batch.columns, *counts], names=schema.names)

    return docs.mapInArrow(run, schema)


def deltas(changes: DataFrame) -> DataFrame:
    """Signed sums per key; partial sums are made before the shuffle, so a hot source is a few rows."""
    op, new = F.col("op"), F.coalesce(F.col("tokens"), F.lit(0)).cast("long")
    old = F.coalesce(F.col("old_tokens"), F.lit(0)).cast("long") if "old_tokens" in changes.columns else F.lit(0).cast("long")
    wrong = F.raise_error(F.concat(F.lit("unknown op "), F.coalesce(op, F.lit("null")))).cast("long")
    signed = changes.select(
        *[F.col(k).cast("string").alias(k) for k in KEYS],
        F.when(op == "insert", 1).when(op == "delete", -1).when(op == "revise", 0).otherwise(wrong).cast("long").alias("docs"),
        F.when(op == "insert", new).when(op == "delete", -new).when(op == "revise", new - old).otherwise(wrong).alias("tokens"),
    )
    return signed.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))


class Rollup:
    """Totals in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._at(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        for folder in ("deltas", "bases"):
            self._fs.mkdirs(self._at(f"{self.path}/{folder}"))

    def _names(self, folder: str) -> list[str]:
        at = self._at(f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _complete(self, folder: str) -> bool:
        return self._fs.exists(self._at(f"{self.path}/{folder}/_SUCCESS"))

    def _first_try(self, batch_id: str) -> str | None:
        """The folder that holds the batch."""
        return next((f"deltas/{batch_id}/{t}" for t in self._names(f"deltas/{batch_id}") if self._complete(f"deltas/{batch_id}/{t}")), None)

    def _base(self) -> str | None:
        """The newest base: complete when its batch ids, written last, are."""
        return next((f"bases/{v}" for v in reversed(self._names("bases")) if v.startswith("v-") and self._complete(f"bases/{v}/batches")), None)

    def _in_base(self, base: str | None, batch_ids: list[str]) -> set[str]:
        """Which of the batches the base holds."""
        if base is None or not batch_ids:
            return set()
        named = self.spark.read.schema("batch string").parquet(f"{self.path}/{base}/batches")
        return {r[0] for r in named.where(F.col("batch").isin(batch_ids)).collect()}

    def committed(self, batch_id: str) -> bool:
        return self._first_try(batch_id) is not None or bool(self._in_base(self._base(), [batch_id]))

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Whether this call committed the batch; False if it had been committed before."""
        if not batch_id or batch_id[0] in "._" or "/" in batch_id:
            raise ValueError(f"not a batch id: {batch_id!r}")
        if self.committed(batch_id):
            return False
        own = f"deltas/{batch_id}/{uuid.uuid4().hex}"
        deltas(changes).write.parquet(f"{self.path}/{own}")
        return self._first_try(batch_id) == own

    def _sums(self, base: str | None, folders: list[str]) -> DataFrame:
        at = [f"{self.path}/{f}" for f in [*folders, *([f"{base}/totals"] if base else [])]]
        every = self.spark.read.schema(SCHEMA).parquet(*at) if at else self.spark.createDataFrame([], SCHEMA)
        sums = every.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return sums.where((F.col("docs") != 0) | (F.col("tokens") != 0))

    def _open(self, base: str | None) -> dict[str, str]:
        """Committed batches that are not in the base, and their folders."""
        tries = {b: self._first_try(b) for b in self._names("deltas")}
        held = self._in_base(base, list(tries))
        return {b: t for b, t in tries.items() if t is not None and b not in held}

    def totals(self) -> DataFrame:
        """source, lang, tokenizer_version, docs, tokens."""
        base = self._base()
        return self._sums(base, list(self._open(base).values()))

    def fold(self) -> None:
        """All committed deltas in a new base; for a single maintainer, beside any number of senders. It may stop anywhere and be called again."""
        base = self._base()
        batches = self._open(base)
        if batches:
            version = f"{int(base.rsplit('-')[-1]) + 1 if base else 1:012d}"
            new = f"bases/tmp-{uuid.uuid4().hex}"
            self._fold_into(base, batches, new)
            self._fs.rename(self._at(f"{self.path}/{new}"), self._at(f"{self.path}/bases/v-{version}"))
            base = f"bases/v-{version}"
        self._sweep(base)

    def _fold_into(self, base: str | None, batches: dict[str, str], new: str) -> None:
        self._sums(base, list(batches.values())).write.parquet(f"{self.path}/{new}/totals")
        ids = self.spark.createDataFrame([(b,) for b in sorted(batches)], "batch string")
        if base:
            ids = ids.unionByName(self.spark.read.schema("batch string").parquet(f"{self.path}/{base}/batches"))
        ids.write.parquet(f"{self.path}/{new}/batches")

    def _sweep(self, base: str | None) -> None:
        """Deletes what the base replaces."""
        for b in self._in_base(base, self._names("deltas")):
            self._fs.delete(self._at(f"{self.path}/deltas/{b}"), True)
        for v in self._names("bases"):
            if f"bases/{v}" != base:
                self._fs.delete(self._at(f"{self.path}/bases/{v}"), True)
