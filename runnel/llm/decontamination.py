"""Benchmark decontamination with an FM-index per training shard.

Each shard (half a MB of text of one task, or up to two MB where there are many windows) becomes one sequence of all its words, as symbols, with separators at document ends, and
an FM-index is built over it once. All windows of the items are searched backward at once through wavelet-tree ranks;
occurrences are located by sampled suffix positions; overlapping removal spans merge. Shards need no shuffle.

A window is `width` consecutive item words; an item of fewer words, but not none, is one window. Windows reach the tasks as
broadcasts of at most MAX_WINDOWS each, made and used one after another, so neither driver nor task holds more than one block.
Null texts have no words; items without words have no windows; repeated item ids act as one item; windows of an item without an id hit, and the
item is not counted or listed. Repeated document rows are treated one by one; other columns are not read, or pass unchanged. Empty tables give no
rows, or no hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import BLOCK, LOWER, BYTE_HASH, Prefix, blocks, byte_class, tidy, words
from ._shared import small_batches
from .fm_index import FMIndex

#: Words: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z.
IN_WORD = byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
HASH = BYTE_HASH[LOWER]
WIDTH = 8
MAX_WINDOWS = 1 << 18


class Windows:
    """Benchmark windows as rows of symbols, right-aligned; shared words have one symbol."""

    def __init__(self, texts: list[str], ids: list, width: int = WIDTH):
        raw = [(t or "").encode() for t in texts]
        data = np.frombuffer(b"".join(raw), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
        s, e, first = words(data, offsets, IN_WORD)
        hashes = Prefix(data, HASH).ranges(s, e) if len(s) else np.zeros(0, np.uint64)
        self.vocabulary, symbols = np.unique(hashes, return_inverse=True)
        n = np.diff(first)
        count = np.where(n > 0, np.maximum(n - width + 1, 1), 0)
        item = np.repeat(np.arange(len(n)), count)
        at = first[item] + np.arange(len(item)) - np.repeat(np.cumsum(count) - count, count)
        size = np.minimum(n[item], width)
        rows = np.zeros((len(item), width), np.int64)
        for k in range(1, width + 1):
            live = size >= k
            rows[live, -k] = symbols[at[live] + size[live] - k] + 1
        self.ids = list(ids)
        self.patterns, which = np.unique(rows, axis=0, return_inverse=True) if len(rows) else (rows, np.zeros(0, np.int64))
        self.lengths = (self.patterns > 0).sum(1)
        pair = np.unique(np.stack([which.ravel(), item], 1), axis=0)
        self.owner_start = np.searchsorted(pair[:, 0], np.arange(len(self.patterns) + 1))
        self.owner = pair[:, 1]


class Shard:
    """The words of some documents, and an FM-index over all of them, one after another, documents parted by separators."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.starts, self.ends, self.first = words(data, offsets, IN_WORD)
        if not len(self.starts):
            return
        codes, self.vocabulary = pd.factorize(Prefix(data, HASH).ranges(self.starts, self.ends))
        # the commonest words have the smallest symbols
        by_count = np.argsort(-np.bincount(codes), kind="stable")
        symbol = np.empty(len(by_count), np.int64)
        symbol[by_count] = np.arange(1, len(by_count) + 1)
        self.vocabulary = self.vocabulary[by_count]
        self.order = np.argsort(self.vocabulary)
        ends = self.first[1:]
        self.word = np.insert(np.arange(len(codes)), ends, -1)
        self.index = FMIndex(np.insert(symbol[codes], ends, 0), len(by_count) + 1)

    def occurrences(self, w: Windows) -> tuple[np.ndarray, np.ndarray]:
        """The first word and the window of each occurrence."""
        none = np.zeros(0, np.int64)
        if not len(self.starts) or not len(w.patterns):
            return none, none
        ordered = self.vocabulary[self.order]
        at = np.minimum(np.searchsorted(ordered, w.vocabulary), len(ordered) - 1)
        symbols = np.concatenate([[0], np.where(ordered[at] == w.vocabulary, self.order[at] + 1, -1)])
        patterns = symbols[w.patterns]
        live = np.flatnonzero((patterns >= 0).all(1))  # a window with a word that the shard lacks is not in it
        if not len(live):
            return none, none
        lo, hi = self.index.search(patterns[live], w.lengths[live])
        found = hi - lo
        rows = np.arange(found.sum()) - np.repeat(np.cumsum(found) - found - lo, found)
        return self.word[self.index.locate(rows)], np.repeat(live, found)


def _windows(items: Iterator[tuple], width: int) -> Iterator[Windows]:
    part, n = [], 0
    for i, t in items:
        size = max(1, len((t or "").split()))
        if part and n + size > MAX_WINDOWS:
            yield Windows([x for _, x in part], [k for k, _ in part], width)
            part, n = [], 0
        part.append((i, t))
        n += size
    yield Windows([x for _, x in part], [k for k, _ in part], width)


def _broadcast(benchmark: DataFrame, width: int, item_col: str, item_text: str) -> list:
    small_batches(benchmark.sparkSession)
    sc = benchmark.sparkSession.sparkContext
    return [sc.broadcast(w) for w in _windows(((r[0], r[1]) for r in benchmark.select(item_col, item_text).toLocalIterator()), width)]


def _each(blocks_of: list) -> Iterator[Windows]:
    """The blocks in a task; of several only one stays loaded."""
    for b in blocks_of:
        yield b.value
        if len(blocks_of) > 1:
            b.__dict__.pop("_value", None)


def _shard_bytes(blocks_of: list) -> int:
    """Text of a shard: the more windows, each shard being asked for all of them, the more text."""
    windows = MAX_WINDOWS if len(blocks_of) > 1 else len(blocks_of[0].value.patterns)
    return min(4 * BLOCK, max(BLOCK, 8 * windows))


def scan(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per document: n_words, spans array of (start, end) bytes of merged hit runs, n_hit words, item ids whose windows occur."""
    blocks_of = _broadcast(benchmark, width, item_col, item_text)
    limit = _shard_bytes(blocks_of)
    df = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    kind = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("items", pa.list_(pa.string()))])

    def run(batches):
        for batch, data, offsets in blocks(batches, "text", limit):
            n = len(offsets) - 1
            shard = Shard(data, offsets)
            s, e, first, pairs = shard.starts, shard.ends, shard.first, []
            hit_marks = np.zeros(len(s) + 1, np.int64)
            for w in _each(blocks_of):
                at, window = shard.occurrences(w)
                np.add.at(hit_marks, at, 1)
                np.add.at(hit_marks, at + w.lengths[window], -1)
                own = w.owner_start[window + 1] - w.owner_start[window]
                owner = w.owner[np.arange(own.sum()) - np.repeat(np.cumsum(own) - own - w.owner_start[window], own)]
                doc = np.searchsorted(first, np.repeat(at, own), "right") - 1
                pairs += [(int(d), str(w.ids[i])) for d, i in np.unique(np.stack([doc, owner], 1), axis=0) if w.ids[i] is not None]
            hit = np.cumsum(hit_marks[:-1]) > 0
            items = [[] for _ in range(n)]
            for d, i in sorted(set(pairs)):
                items[d].append(i)
            doc = np.repeat(np.arange(n), np.diff(first))
            edge = np.ones(len(hit) + 1, bool)
            edge[1:-1] = (hit[1:] != hit[:-1]) | (doc[1:] != doc[:-1])
            runs = np.flatnonzero(edge)
            runs = [(a, b) for a, b in zip(runs[:-1], runs[1:], strict=True) if hit[a]] if hit.any() else []
            spans = [[] for _ in range(n)]
            for a, b in runs:
                o = offsets[doc[a]]
                spans[doc[a]].append({"start": int(s[a] - o), "end": int(e[b - 1] - o)})
            total = np.concatenate([[0], np.cumsum(hit)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(first)), pa.array(total[first[1:]] - total[first[:-1]]), pa.array(spans, kind.field("spans").type), pa.array(items, kind.field("items").type)], schema=kind)

    return df.mapInArrow(tidy(run), "id long, n_words long, n_hit long, spans array<struct<start: int, end: int>>, items array<string>").withColumnRenamed("id", id_col)


def decontaminated(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, min_items: int = 1, text_col: str = "text") -> DataFrame:
    """docs with the merged spans of hit words cut out of documents with windows of min_items items or more; columns stay as they are.

    A document without hits stays byte for byte; n_chars, if there is such a column, is renewed for a changed one.
    """
    blocks_of = _broadcast(benchmark, width, "item_id", "text")
    limit = _shard_bytes(blocks_of)
    schema = docs.schema
    names = docs.columns

    def run(batches):
        for batch, data, offsets in blocks(batches, text_col, limit):
            cuts: dict[int, list] = {}
            owners: dict[int, set] = {}
            shard = Shard(data, offsets)
            s, e, first = shard.starts, shard.ends, shard.first
            for w in _each(blocks_of):
                at, window = shard.occurrences(w)
                for a, k in zip(at.tolist(), window.tolist(), strict=True):
                    d = int(np.searchsorted(first, a, "right")) - 1
                    owners.setdefault(d, set()).update(w.ids[i] for i in w.owner[w.owner_start[k] : w.owner_start[k + 1]].tolist() if w.ids[i] is not None)
                    cuts.setdefault(d, []).append((int(s[a] - offsets[d]), int(e[a + w.lengths[k] - 1] - offsets[d])))
            cuts = {d: spans for d, spans in cuts.items() if len(owners[d]) >= min_items}
            if not cuts:
                yield batch
                continue
            texts = batch.column(names.index(text_col)).to_pylist()
            for d, spans in cuts.items():
                raw, out, to = (texts[d] or "").encode(), [], 0
                for a, b in sorted(spans):
                    if a > to:
                        out.append(raw[to:a])
                    to = max(to, b)
                texts[d] = b"".join([*out, raw[to:]]).decode()
            cols = list(batch.columns)
            cols[names.index(text_col)] = pa.array(texts, batch.schema.field(text_col).type)
            if "n_chars" in names:
                k = names.index("n_chars")
                n = batch.column(k).to_pylist()
                for d in cuts:
                    n[d] = len(texts[d] or "")
                cols[k] = pa.array(n, batch.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays(cols, schema=batch.schema)

    return docs.mapInArrow(tidy(run), schema)

