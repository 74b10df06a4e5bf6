"""Removal of repeated passages with a distributed sparse suffix array.

Every string of LENGTH bytes has one sample position that depends on the string alone: where its least hashed stretch of K bytes
begins. Suffixes are taken at sample positions; the strings that share a position form a run around it, and equal strings meet at
suffixes that begin alike. Splitters from a sample of documents range-partition the suffixes by their leading K bytes, in byte order.
Each range is sorted by multikey quicksort: by the leading bytes as two big-endian tokens, then by 128 bits of fingerprint
of the whole run, then by document; neighbours are compared. Equal runs are settled there. Runs that begin alike and agree on one side of the
leading bytes only are opened: their bytes are fetched, and all their strings are sorted by multikey quicksort over tokens of eight bytes and
compared, byte for byte.

Leading bytes that fill more than one range are dealt over several by the run's fingerprint, so that a hot passage is in no one
task; what then lies on both sides of a boundary is compared by its strings: their least documents are aggregated and joined back. So are
the runs of any suffix beginning that more than LARGE opened runs share. Of suffixes whose whole runs are equal, a task sends on only the
one of the smallest document: hot passages and groups of copies shrink to one record a task.

A byte goes if a LENGTH-byte string over it also starts in a document with a smaller id; judged on the input, inside documents.
Null texts are empty. Texts shorter than LENGTH stay whole. Equal texts are not treated apart. Rows that share an id are judged one by one and
never remove each other's bytes; equal rows get the same result each. Rows with a null id stay whole and remove nothing. An empty table gives no
rows. Other columns pass unchanged, whatever their names.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import BLOCK, BYTE_HASH, Prefix, U, blocks, mix, text_buffer, tidy
from ._order import heads, least_in_run, multikey_quicksort
from ._shared import apart, fresh_name, partitions, small_batches, written
from ._sketches import members_apart, only_members

LENGTH = 50
#: Leading bytes of a suffix: a token of eight and one of four.
K = 12
SIDE = (LENGTH - K) // 2
#: Text per range; the number of ranges follows the input, up to MOST_RANGES (the driver holds KEYS sampled suffixes for each).
RANGE_BYTES = 8 << 20
MOST_RANGES = 1 << 20
KEYS = 8
DOC_KEYS = 16
#: Suffixes that a task holds before it sends them on.
FLUSH = 100_000
#: Opened runs with the same leading bytes, of some 60 bytes each, that are compared in one task; of more, the strings are dealt.
LARGE = 1 << 16
OTHER_HASH = mix(BYTE_HASH ^ U(0xA0761D6478BD642F))


def tokens(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Big-endian numbers of the two, four and eight bytes from each position on, as far as there are so many."""
    one = data.astype(U)
    two = (one[:-1] << U(8)) | one[1:]
    four = (two[:-2] << U(16)) | two[2:]
    return two, four, (four[:-4] << U(32)) | four[4:]


class Runs:
    """The runs of a block: leading tokens, fingerprints, document row, first and last string, offset of the sample position, side hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n, width = len(data), LENGTH - K + 1
        empty = np.zeros(0, np.int64)
        self.t0, self.t1, self.p0, self.p1 = (np.zeros(0, U) for _ in range(4))
        self.doc = self.first = self.last = self.at = self.left = self.right = empty
        if n < LENGTH:
            return
        _, four, eight = tokens(data)
        lead, rest = eight[: n - K + 1], four[8:]
        h = mix(lead * U(0x9E3779B97F4A7C15) + rest)
        least, w = ((h >> U(32)) << U(32)) | np.arange(len(h), dtype=U), 1
        while w * 2 <= width:
            least = np.minimum(least[:-w], least[w:])
            w *= 2
        least = np.minimum(least[: len(least) - (width - w)], least[width - w :]) if w < width else least
        inside = np.zeros(n + 1, np.int8)
        size = np.diff(offsets)
        whole = size >= LENGTH
        np.add.at(inside, offsets[:-1][whole], 1)
        np.add.at(inside, offsets[1:][whole] - LENGTH + 1, -1)
        start = np.flatnonzero(np.cumsum(inside[: len(least)], dtype=np.int8))
        if not len(start):
            return
        sample = (least[start] & U(0xFFFFFFFF)).astype(np.int64)
        doc = np.searchsorted(offsets, start, "right") - 1
        head = np.flatnonzero(heads(sample, doc))
        first, last, at = start[head], start[np.append(head[1:], len(start)) - 1], sample[head]
        doc = doc[head]
        lo, hi = offsets[doc], offsets[doc + 1]
        prefix = Prefix(data)
        shape = ((at - first) * 64 + (last - first)).astype(U)
        self.t0, self.t1 = lead[at], rest[at]
        self.p0 = mix(prefix.ranges(first, last + LENGTH) + shape)
        self.p1 = mix(Prefix(data, OTHER_HASH).ranges(first, last + LENGTH) ^ (shape << U(40)))
        side = lambda a, b, good: np.where(good, (prefix.ranges(np.where(good, a, 0), np.where(good, b, 0)) & U(0xFFFF)).astype(np.int64) | 1, 0)
        self.left = side(at - SIDE, at, at - SIDE >= lo)
        self.right = side(at + K, at + K + SIDE, at + K + SIDE <= hi)
        self.doc, self.first, self.last, self.at = doc, first - lo, last - lo, at - first


def lead_bytes(t0: np.ndarray, t1: np.ndarray) -> np.ndarray:
    """The leading bytes, which numpy compares as bytes."""
    out = np.empty((len(t0), K), np.uint8)
    out[:, :8] = t0.astype(">u8").view(np.uint8).reshape(-1, 8)
    out[:, 8:] = t1.astype(">u4").view(np.uint8).reshape(-1, 4)
    return out.view(f"S{K}").ravel()


class Ranges:
    """Ranges of leading bytes. Bytes that are several boundaries at once are hot: they have so many ranges of their own."""

    def __init__(self, bounds: np.ndarray):
        self.bounds, times = np.unique(bounds, return_counts=True)
        self.hot, self.parts = self.bounds[times > 1], times[times > 1]
        self.first = len(self.bounds) + 1 + np.cumsum(self.parts) - self.parts
        self.count = len(self.bounds) + 1 + int(self.parts.sum())

    def is_hot(self, bucket: int) -> bool:
        return bucket > len(self.bounds)

    def buckets(self, lead: np.ndarray, prints: np.ndarray) -> np.ndarray:
        """The range of each suffix; the suffixes are sorted by their leading bytes."""
        begin = np.searchsorted(lead, self.bounds, "left")
        out = np.cumsum(np.bincount(begin, minlength=len(lead) + 1)[: len(lead)], dtype=np.int32)
        for a, b, first, parts in zip(np.searchsorted(lead, self.hot, "left").tolist(), np.searchsorted(lead, self.hot, "right").tolist(), self.first.tolist(), self.parts.tolist(), strict=True):
            if a < b:
                out[a:b] = first + (prints[a:b] % U(parts)).astype(np.int32)
        return out


def _splitters(docs: DataFrame, ranges: int, count: int) -> np.ndarray:
    """Boundaries of leading bytes, quantiles over a sample of documents chosen by a hash of the id."""
    share = min(1.0, max(2000, KEYS * ranges // DOC_KEYS) / max(1, count))
    chosen = docs.where(F.pmod(F.xxhash64("doc_id", F.lit("splitters")), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))

    def run(batches):
        for _, data, offsets in blocks(batches, "text", BLOCK // 2):
            r = Runs(data, offsets)
            if len(r.t0):
                pick = np.unique(np.linspace(0, len(r.t0) - 1, DOC_KEYS * (len(offsets) - 1)).astype(np.int64))
                yield _rows(k=pa.array([x.ljust(K, b"\0") for x in lead_bytes(r.t0[pick], r.t1[pick]).tolist()], pa.binary()))

    keys = np.sort(np.array([bytes(r.k) for r in chosen.select("text").mapInArrow(tidy(run), "k binary").collect()], f"S{K}"))
    return keys[(np.arange(1, ranges) * len(keys)) // ranges] if len(keys) else keys


def _planes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


#: The columns of a packed range after the document's: leading tokens, fingerprints, first string, shape of the run, side hashes.
_COLUMNS = (np.uint64, np.uint32, np.uint64, np.uint64, np.uint32, np.uint16, np.uint32)


def _pack(ids: np.ndarray, rows: np.ndarray, *columns: np.ndarray) -> bytes:
    """Columns in planes of bytes, compressed; documents as a table and places in it."""
    order = np.lexsort((rows, ids))
    new = heads(ids[order], rows[order])
    local = np.empty(len(ids), np.uint32)
    local[order] = (np.cumsum(new) - 1).astype(np.uint32)
    known = order[new]
    parts = [_planes(np.diff(ids[known], prepend=0)), _planes(rows[known]), _planes(local)]
    parts += [_planes(c.astype(kind)) for c, kind in zip(columns, _COLUMNS, strict=True)]
    raw = b"".join(parts)
    return np.array([len(ids), len(known), len(raw)], np.int64).tobytes() + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(body: bytes) -> tuple[np.ndarray, ...]:
    n, m, size = np.frombuffer(body, np.int64, 3).tolist()
    raw = pa.decompress(memoryview(body)[24:], size, codec="zstd", asbytes=True)
    at = 0

    def take(kind, count):
        nonlocal at
        size = np.dtype(kind).itemsize * count
        x = np.frombuffer(raw, np.uint8, size, at)
        at += size
        return np.ascontiguousarray(x.reshape(-1, count).T).view(kind).ravel()

    ids, rows, local = np.cumsum(take(np.int64, m)), take(np.int64, m), take(np.uint32, n)
    return (ids[local], rows[local], *[take(kind, n) for kind in _COLUMNS])


_ASK = "place int, bucket int, doc_id long, row long, start int, finish int, body binary"
_OUT = "doc_id long, row long, key binary, many boolean, start int, finish int"


def _rows(**cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(cols)


def _suffixes(docs: DataFrame, ranges: Ranges, places: np.ndarray) -> DataFrame:
    """Packed suffix records by range, and the spans that a task can settle by itself; `place` is what they are to be partitioned by."""

    def flush(held):
        t0, t1, p0, p1, ids, rows, first, shape, sides = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        order = multikey_quicksort(t0, t1, p0, p1, ids, rows)
        cols = [x[order] for x in (ids, rows, t0, t1, p0, p1, first, shape, sides)]
        ids, rows, t0, t1, p0, p1, first, shape, sides = cols
        settled = ids > least_in_run(ids, heads(t0, t1, p0, p1))
        if settled.any():
            finish = first + (shape & 63) + LENGTH
            k = int(settled.sum())
            # settled spans only pass through: dealt by document, not to the range of what may be a hot beginning
            yield _rows(place=pa.array(places[ids[settled] % len(places)]), bucket=pa.nulls(k, pa.int32()), doc_id=ids[settled], row=rows[settled], start=pa.array(first[settled].astype(np.int32)), finish=pa.array(finish[settled].astype(np.int32)), body=pa.nulls(k, pa.binary()))
        cols = [c[~settled] for c in cols]
        if not len(cols[0]):
            return
        bucket = ranges.buckets(lead_bytes(cols[2], cols[3]), cols[4])
        by = np.argsort(bucket, kind="stable")
        bucket, cols = bucket[by], [c[by] for c in cols]
        cut = np.append(np.flatnonzero(heads(bucket)), len(bucket)).tolist()
        bodies = [_pack(*[c[a:b] for c in cols]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
        n = len(bodies)
        names = bucket[cut[:-1]]
        yield _rows(place=pa.array(places[names]), bucket=pa.array(names), doc_id=pa.nulls(n, pa.int64()), row=pa.nulls(n, pa.int64()), start=pa.nulls(n, pa.int32()), finish=pa.nulls(n, pa.int32()), body=pa.array(bodies, pa.binary()))

    def run(batches):
        held, n = [], 0
        for batch, data, offsets in blocks(batches, "text", BLOCK // 2):
            r = Runs(data, offsets)
            if not len(r.t0):
                continue
            ids, rows = (batch.column(i).to_numpy(zero_copy_only=False)[r.doc] for i in (0, 1))
            held.append((r.t0, r.t1.astype(np.uint32), r.p0, r.p1, ids, rows, r.first.astype(np.uint32), (r.at * 64 + (r.last - r.first)).astype(np.uint16), (r.left * 65536 + r.right).astype(np.uint32)))
            n += len(ids)
            if n >= FLUSH:
                yield from flush(held)
                held, n = [], 0
        if held:
            yield from flush(held)

    return docs.select("doc_id", "row", "text").mapInArrow(tidy(run), _ASK)


def _compare(hot: bool, bodies: list[bytes]):
    """Spans that equal neighbours settle, and the runs to open; many: compared by their strings."""
    cols = [np.concatenate(x) for x in zip(*map(_unpack, bodies), strict=True)]
    order = multikey_quicksort(cols[2], cols[3], cols[4], cols[5], cols[0], cols[1], cols[6])
    ids, rows, t0, t1, p0, p1, first, shape, sides = (c[order] for c in cols)
    same_run = heads(t0, t1, p0, p1)
    settled = ids > least_in_run(ids, same_run)
    first, shape, sides = first.astype(np.int64), shape.astype(np.int64), sides.astype(np.int64)
    finish = first + (shape & 63) + LENGTH
    none = int(settled.sum())
    yield _rows(doc_id=ids[settled], row=rows[settled], key=pa.nulls(none, pa.binary()), many=pa.array(np.zeros(none, bool)), start=pa.array(first[settled].astype(np.int32)), finish=pa.array(finish[settled].astype(np.int32)))
    same_token = heads(t0, t1)
    group = np.cumsum(same_token) - 1
    wanted = np.zeros(len(t0), bool)
    if hot:
        wanted = ~settled
    else:
        # a string that two runs share has SIDE bytes in common before or after the leading bytes
        size = np.diff(np.append(np.flatnonzero(same_token), len(t0)))
        rest = np.flatnonzero(~settled & np.repeat(size > 1, size))
        for side in (sides[rest] >> 16, sides[rest] & 0xFFFF):
            r = rest[side > 0]
            if not len(r):
                continue
            key = group[r] * 65536 + side[side > 0]
            o = np.lexsort((ids[r], key))
            r, key = r[o], key[o]
            new = heads(key)
            at = np.flatnonzero(new)
            most = np.maximum.reduceat(ids[r], at)[np.cumsum(new) - 1]
            least = np.minimum.reduceat(ids[r], at)[np.cumsum(new) - 1]
            wanted[r[least < most]] = True
    w = np.flatnonzero(wanted)
    many = np.bincount(group[w], minlength=int(same_token.sum()))[group[w]] > LARGE if len(w) else np.zeros(0, bool)
    key = pa.array([x.ljust(K, b"\0") for x in lead_bytes(t0[w], t1[w]).tolist()], pa.binary())
    yield _rows(doc_id=ids[w], row=rows[w], key=key, many=pa.array(many | hot), start=pa.array(first[w].astype(np.int32)), finish=pa.array(finish[w].astype(np.int32)))


def _sorted_ranges(docs: DataFrame, ranges: Ranges) -> DataFrame:
    """Each range in a task of its own."""
    places = apart(ranges.count)

    def run(batches):
        bucket, bodies = None, []
        for batch in batches:
            passed = batch.filter(batch.column(6).is_null())
            if passed.num_rows:
                k = passed.num_rows
                yield _rows(doc_id=passed.column(2), row=passed.column(3), key=pa.nulls(k, pa.binary()), many=pa.array(np.zeros(k, bool)), start=passed.column(4), finish=passed.column(5))
            held = batch.filter(batch.column(6).is_valid())
            for b, body in zip(held.column(1).to_pylist(), held.column(6), strict=True):
                if b != bucket and bodies:
                    yield from _compare(ranges.is_hot(bucket), bodies)
                    bodies = []
                bucket = b
                bodies.append(body.as_py())
        if bodies:
            yield from _compare(ranges.is_hot(bucket), bodies)

    return _suffixes(docs, ranges, places).repartition(ranges.count, "place").sortWithinPartitions("bucket").mapInArrow(tidy(run), _OUT)


def _strings(body: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All LENGTH-byte strings of some contexts: the contexts' bytes, each string's context, its offset in it, its position in the bytes."""
    data, offsets = text_buffer(body)
    count = np.diff(offsets) - LENGTH + 1
    of = np.repeat(np.arange(len(count)), count)
    inner = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    return data, of, inner, offsets[:-1][of] + inner


def _spans(hit: np.ndarray, of: np.ndarray, pos: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
    """Stretches of strings that are hit, as spans."""
    edge = np.ones(len(of) + 1, bool)
    edge[1:-1] = (hit[1:] != hit[:-1]) | (of[1:] != of[:-1])
    cut = np.flatnonzero(edge)
    a, b = cut[:-1], cut[1:] - 1
    live = hit[a] if len(a) else np.zeros(0, bool)
    a, b = a[live], b[live]
    return _rows(doc_id=ids[of[a]], row=rows[of[a]], start=pa.array(pos[a].astype(np.int32)), finish=pa.array((pos[b] + LENGTH).astype(np.int32)))


def _contexts(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """The bytes of the runs to open: key, many, doc_id, row, start, body."""
    per_doc = asked.groupBy("doc_id", "row").agg(F.collect_list(F.struct("key", "many", "start", "finish")).alias("runs"))
    texts = only_members(docs, "doc_id", asked.select("doc_id").distinct()).dropDuplicates(["doc_id", "row"])

    def fetch(batches):
        for batch in batches:
            data, offsets = text_buffer(batch.column(2))
            raw = data.tobytes()
            runs = batch.column(3)
            cut = np.asarray(runs.offsets) if len(runs) else np.zeros(1, np.int64)
            flat = runs.values
            start, finish = np.asarray(flat.field(2)), np.asarray(flat.field(3))
            owner = np.repeat(np.arange(batch.num_rows), np.diff(cut))
            a = int(cut[0])
            while a < int(cut[-1]):
                b = min(int(cut[-1]), a + 8192)
                own = owner[a - int(cut[0]) : b - int(cut[0])]
                base = offsets[own]
                body = [raw[o + s : o + f] for o, s, f in zip(base.tolist(), start[a:b].tolist(), finish[a:b].tolist(), strict=True)]
                at = pa.array(own)
                yield _rows(key=flat.field(0).slice(a, b - a), many=flat.field(1).slice(a, b - a), doc_id=batch.column(0).take(at), row=batch.column(1).take(at), start=pa.array(start[a:b]), body=pa.array(body, pa.binary()))
                a = b

    joined = texts.join(per_doc, ["doc_id", "row"]).select("doc_id", "row", F.coalesce("text", F.lit("")).alias("text"), "runs")
    return joined.mapInArrow(tidy(fetch), "key binary, many boolean, doc_id long, row long, start int, body binary")


def _opened(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """Compares all strings of the opened runs; returns spans."""
    spark = docs.sparkSession
    size, some = asked.agg(F.sum(F.col("finish") - F.col("start")), F.coalesce(F.bool_or("many"), F.lit(False))).first()
    contexts = _contexts(docs, asked)
    contexts = written(contexts, "contexts") if some else contexts

    def neighbours(held):
        """Strings of whole groups in byte order; those that also start in a smaller document."""
        ids, rows, start = (np.concatenate([b.column(i).to_numpy() for b in held]) for i in (2, 3, 4))
        data, of, inner, at = _strings(pa.concat_arrays([b.column(5) for b in held]))
        two, _, eight = tokens(data)
        order = multikey_quicksort(*[eight[at + 8 * k] for k in range(LENGTH // 8)], two[at + LENGTH - 2], ids[of])
        new = heads(*[eight[at[order] + 8 * k] for k in range(LENGTH // 8)], two[at[order] + LENGTH - 2])
        hit = np.zeros(len(of), bool)
        hit[order] = ids[of[order]] > least_in_run(ids[of[order]], new)
        return _spans(hit, of, start[of].astype(np.int64) + inner, ids, rows)

    def compare(batches):
        held, size, last = [], 0, None
        for batch in batches:
            keys = batch.column(0).to_pylist()
            if held and size >= 1 << 14:
                # all rows of a key together: the last key may go on
                whole = next((i for i, k in enumerate(keys) if k != last), len(keys))
                held += [batch.slice(0, whole)] if whole else []
                batch = batch.slice(whole)
                if whole < len(keys):
                    yield neighbours(held)
                    held, size = [], 0
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
                last = keys[-1]
        if held:
            yield neighbours(held)

    schema = "doc_id long, row long, start int, finish int"
    n = max(partitions(spark), math.ceil((size or 0) / RANGE_BYTES))
    few = contexts.where("NOT many").repartition(n, "key").sortWithinPartitions("key").mapInArrow(tidy(compare), schema)
    return few.unionByName(_by_string(contexts.where("many"))) if some else few


def _by_string(contexts: DataFrame) -> DataFrame:
    """The same for groups of any size: the least document of each string by an aggregate, joined back."""

    def explode(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                data, of, inner, at = _strings(part.column(5))
                body = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, LENGTH)[at]) if len(at) else np.zeros((0, LENGTH), np.uint8)
                cut = pa.py_buffer(np.arange(0, (len(at) + 1) * LENGTH, LENGTH, dtype=np.int32))
                ids, rows, start = (part.column(i).to_numpy() for i in (2, 3, 4))
                text = pa.Array.from_buffers(pa.binary(), len(at), [None, cut, pa.py_buffer(body)])
                yield _rows(string=text, doc_id=ids[of], row=rows[of], start=pa.array((start[of] + inner).astype(np.int32)))

    strings = contexts.mapInArrow(tidy(explode), "string binary, doc_id long, row long, start int")
    shared = strings.groupBy("string").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").drop("most")
    return strings.join(shared, "string").where("doc_id > least").select("doc_id", "row", "start", (F.col("start") + LENGTH).alias("finish"))


def with_rows(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with `row`, which tells rows that share an id apart: a hash of the text for them, 0 for all others."""
    twice = docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id")
    zero = F.lit(0).cast("long")
    if not twice.limit(1).count():
        return docs.withColumn("row", zero)
    maybe, once = members_apart(docs, "doc_id", twice)
    told = maybe.join(twice.withColumn("again", F.lit(True)), "doc_id", "left")
    told = told.withColumn("row", F.when(F.col("again"), F.xxhash64(F.coalesce("text", F.lit("")))).otherwise(zero)).drop("again")
    return once.withColumn("row", zero).unionByName(told.select(*once.columns, "row"))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """doc_id, row, start, finish in bytes, from docs as of with_rows(): repeated stretches of LENGTH bytes or more, maybe overlapping."""
    small_batches(docs.sparkSession)
    known = docs.where("doc_id IS NOT NULL")
    size, count = known.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0))), F.count("*")).first()
    wanted = max(2 * partitions(docs.sparkSession), math.ceil((size or 0) / RANGE_BYTES))
    ranges = Ranges(_splitters(known, min(MOST_RANGES, wanted), count))
    found = written(_sorted_ranges(known, ranges), "suffix-ranges")
    spans = found.where("key IS NULL").select("doc_id", "row", "start", "finish")
    return spans.unionByName(written(_opened(known, found.where("key IS NOT NULL")), "opened-runs"))


def _per_doc(docs: DataFrame):
    """Spans of each document as one row."""
    return repeated_spans(docs).groupBy("doc_id", "row").agg(F.collect_set(F.struct("start", "finish")).alias("spans"))


def _merged(spans, d: int) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s in sorted((x["start"], x["finish"]) for x in spans[d].as_py()):
        if out and s[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s[1])
        else:
            out.append(list(s))
    return [tuple(x) for x in out]


def _cut(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, to = [], 0
    for a, b in spans:
        out.append(raw[to:a])
        to = b
    return b"".join([*out, raw[to:]])


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc id, n_bytes, n_removed, n_spans, kept_sha256. Texts are shuffled only for documents whose spans leave a part of their bytes."""
    docs = with_rows(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    whole = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    base = written(docs.select("doc_id", "row", F.octet_length(whole).cast("long").alias("n_bytes"), F.sha2(whole, 256).alias("sha")), "sizes")
    key = ["doc_id", "row"]

    def measure(batches):
        for batch in batches:
            spans = batch.column(2)
            cuts = [_merged(spans, d) for d in range(batch.num_rows)]
            removed = pa.array([sum(b - a for a, b in cut) for cut in cuts], pa.int64())
            merged = pa.array([[{"start": a, "finish": b} for a, b in cut] for cut in cuts], spans.type)
            yield _rows(doc_id=batch.column(0), row=batch.column(1), spans=merged, n_removed=removed, n_spans=pa.array([len(cut) for cut in cuts], pa.int64()))

    kind = "doc_id long, row long, spans array<struct<start: int, finish: int>>, n_removed long, n_spans long"
    cuts = written(_per_doc(docs).mapInArrow(tidy(measure), kind).join(base.select(*key, "n_bytes").dropDuplicates(key), key), "spans")
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    whole_gone = cuts.where("n_removed = n_bytes").select(*key, "n_removed", "n_spans", nothing.alias("kept"))
    partly = cuts.where("n_removed < n_bytes").select(*key, "spans", "n_removed", "n_spans")
    texts = only_members(docs, "doc_id", partly.select("doc_id").distinct()).dropDuplicates(key)

    def run(batches):
        for batch in batches:
            spans = batch.column(3)
            kept = [hashlib.sha256(_cut(text.as_buffer().to_pybytes() if text.is_valid else b"", _merged(spans, d))).hexdigest() for d, text in enumerate(batch.column(2))]
            yield _rows(doc_id=batch.column(0), row=batch.column(1), n_removed=batch.column(4), n_spans=batch.column(5), kept=pa.array(kept, pa.string()))

    joined = texts.join(partly, key).select(*key, "text", "spans", "n_removed", "n_spans")
    done = joined.mapInArrow(tidy(run), "doc_id long, row long, n_removed long, n_spans long, kept string")
    out = base.join(done.unionByName(whole_gone), key, "left")
    zero = F.lit(0).cast("long")
    return out.select(
        F.col("doc_id").alias(id_col), "n_bytes",
        F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept", "sha").alias("kept_sha256"),
    )


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with repeated passages cut out of their texts, to whole characters; columns stay as they are, n_chars is renewed."""
    names, schema = docs.columns, docs.schema
    of_id, of_row, of_spans = (fresh_name(x, names) for x in ("id", "row", "spans"))
    slim = with_rows(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    spans = written(_per_doc(slim), "spans").toDF(of_id, of_row, of_spans)
    at = names.index(text_col)

    def run(batches):
        for batch in batches:
            spans = batch.column(len(names))
            texts = batch.column(at).to_pylist()
            changed = []
            for d in np.flatnonzero(spans.is_valid().to_numpy(zero_copy_only=False)).tolist():
                raw = (texts[d] or "").encode()
                inner = []
                for a, b in _merged(spans, d):
                    while a < b and raw[a] & 0xC0 == 0x80:
                        a += 1
                    while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
                        b -= 1
                    inner.append((a, b))
                texts[d] = _cut(raw, inner).decode()
                changed.append(d)
            cols = [batch.column(i) for i in range(len(names))]
            if changed:
                cols[at] = pa.array(texts, batch.schema.field(at).type)
                if "n_chars" in names:
                    k = names.index("n_chars")
                    n = cols[k].to_pylist()
                    for d in changed:
                        n[d] = len(texts[d])
                    cols[k] = pa.array(n, batch.schema.field(k).type)
            yield pa.RecordBatch.from_arrays(cols, names=names)

    maybe, stays = members_apart(docs, id_col, spans.select(of_id).distinct())
    # a row of an id that comes once is row 0
    told = F.when(F.col(of_row) == 0, F.lit(0).cast("long")).otherwise(F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    joined = maybe.join(spans, (F.col(id_col).cast("long") == F.col(of_id)) & (told == F.col(of_row)), "left")
    return stays.unionByName(joined.select(*names, of_spans).mapInArrow(tidy(run), schema))
