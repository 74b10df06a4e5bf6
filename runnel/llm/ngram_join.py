"""N-gram Jaccard join with a token-group matrix.

Documents become sets of word shingles. Equal sets act as one, their first document. Tokens have a global order, rare ones first
(by a sketch of fixed size over all shingles, then by hash). The first tokens of a set, a little more than the part in which two
linked sets may differ, are its prefix; how many prefix tokens two linked sets share at least follows from their sizes. Documents
that share too few with all others together are settled by this alone.

Of the rest each document is compared with one other, the one closest to common of those it shares most with; what links
makes groups of similar documents. The token-group matrix then stores each group's union of prefix tokens, a row a token and group. For
a query document the number of its tokens in a union bounds from above what it shares with any member; only groups that
qualify are opened: first, of each two groups, one query meets the one member it shares most with, as one link joins both; where groups stay apart,
all members that share enough with a query are compared exactly. Pairs inside a group are never listed.

Links: 100 * intersection >= percent * union. Null, empty and word-free texts have empty sets and link with nothing. Repeated
rows are members of one class. The driver sees only sketches of a fixed size and, per round of the components, a count.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._bytes import BYTE_HASH, LOWER, Prefix, blocks, byte_class, mix, shingles, tidy, words
from ._graph import components
from ._shared import fresh_name, small_batches, written
from ._sketches import combined, members_apart, only_members

IN_WORD = ~byte_class((0x20, 0x20), (0x09, 0x0D))
HASH = BYTE_HASH[LOWER]
COUNTER_BITS = 20
LEVEL_BITS = 5
#: Percent of a set's tokens that its prefix has beyond the part that a linked set may lack.
MORE = 2


def _shingle_hashes(data, offsets, width):
    s, e, first = words(data, offsets, IN_WORD)
    hashes = Prefix(data, HASH).ranges(s, e) if len(s) else np.zeros(0, np.uint64)
    return shingles(hashes, first, width)


def _distinct(tokens, bounds):
    """Distinct tokens of each document, ascending, and their bounds."""
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((tokens, doc))
    tokens, doc = tokens[order], doc[order]
    new = np.ones(len(tokens), bool)
    new[1:] = (tokens[1:] != tokens[:-1]) | (doc[1:] != doc[:-1])
    tokens, doc = tokens[new], doc[new]
    return tokens, doc, np.searchsorted(doc, np.arange(len(bounds)))


def token_levels(docs: DataFrame, width: int) -> np.ndarray:
    """How far the tokens of each counter stand out from chance, in powers of two; 2^COUNTER_BITS bytes."""

    def add(batch, own):
        for _, data, offsets in blocks([batch], "text"):
            tokens, _ = _shingle_hashes(data, offsets, width)
            own += np.bincount((tokens >> np.uint64(64 - COUNTER_BITS)).astype(np.int64), minlength=len(own)).astype(np.int32)

    counts = combined(docs.select("text"), 1 << COUNTER_BITS, add)
    middle = max(1.0, float(np.median(counts)))
    return np.clip(np.log2(np.maximum((counts - middle) / np.sqrt(middle), 1.0)), 0, (1 << LEVEL_BITS) - 1).astype(np.uint8)


def signatures(docs: DataFrame, width: int, percent: int, levels: np.ndarray) -> DataFrame:
    """Per document: n (set size), d1 and d2 (digest of the set), prefix tokens."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)

    def run(batches):
        level = shared.value
        for batch, data, offsets in blocks(batches, "text"):
            raw, bounds = _shingle_hashes(data, offsets, width)
            top = level[(raw >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)].astype(np.uint64)
            tokens, _, at = _distinct((top << np.uint64(64 - LEVEL_BITS - 1)) | (mix(raw) >> np.uint64(LEVEL_BITS + 1)), bounds)
            n = np.diff(at)
            count = np.where(n > 0, n - rest_size(n, percent), 0)
            pick = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count - at[:-1], count)
            sums = [np.concatenate([[np.uint64(0)], np.cumsum(x)]) for x in (mix(tokens), mix(tokens * np.uint64(0xD6E8FEB86659FD93) + np.uint64(7)))]
            d1, d2 = ((s[at[1:]] - s[at[:-1]]).view(np.int64) for s in sums)
            prefix = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), pa.array(tokens[pick].view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(d1), pa.array(d2), prefix], names=["doc_id", "n", "d1", "d2", "prefix"])

    return docs.mapInArrow(tidy(run), "doc_id long, n long, d1 long, d2 long, prefix array<long>")


def rest_size(n, percent: int):
    """How many tokens of a set of n are not in its prefix."""
    return np.maximum(0, (percent * n + 99) // 100 - np.maximum(1, MORE * n // 100))


def _rest(n: Column, percent: int) -> Column:
    return F.greatest(F.lit(0), F.floor((n * percent + 99) / 100) - F.greatest(F.lit(1), F.floor(n * MORE / 100)))


def _least_shared(n: Column, m: Column, percent: int) -> Column:
    """How many prefix tokens linked sets of n and m tokens have in common at least.

    They share as many tokens as the threshold asks for. Common tokens that are not in both prefixes all lie in the rest
    of the set whose prefix ends first.
    """
    both = F.floor((percent * (n + m) + 99 + percent) / (100 + percent))
    return F.greatest(F.lit(1), both - F.greatest(_rest(n, percent), _rest(m, percent)))


def _sizes_fit(a: str, b: str, percent: int):
    return (F.col(a) * 100 >= F.col(b) * percent) & (F.col(b) * 100 >= F.col(a) * percent)


def _links(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) that link, from their texts; only documents of pairs are shuffled."""
    likely = written(pairs, "pairs")
    needed = only_members(docs, "doc_id", likely.select(F.col("a").alias("id")).unionByName(likely.select(F.col("b").alias("id"))).distinct())
    with_b = likely.join(needed.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    with_both = with_b.join(needed.select(F.col("doc_id").alias("a"), F.col("text").alias("text")), "a").select("a", "b", "text", "text_b")

    def run(batches):
        for batch, data, offsets in blocks(batches, "text"):
            at = 0
            for part, other, other_offsets in blocks([batch], "text_b"):
                to = at + part.num_rows
                hit = jaccard_at_least(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], other, other_offsets, width, percent)
                yield part.select(["a", "b"]).filter(pa.array(hit))
                at = to

    return with_both.mapInArrow(tidy(run), "a long, b long").distinct()


def jaccard_at_least(data, offsets, other, other_offsets, width: int, percent: int) -> np.ndarray:
    """For each row, whether the two texts' shingle sets link."""
    x, dx, bx = _distinct(*_shingle_hashes(data, offsets, width))
    y, dy, by = _distinct(*_shingle_hashes(other, other_offsets, width))
    both, doc = np.concatenate([x, y]), np.concatenate([dx, dy])
    order = np.lexsort((both, doc))
    both, doc = both[order], doc[order]
    same = (both[1:] == both[:-1]) & (doc[1:] == doc[:-1])
    inter = np.bincount(doc[1:][same], minlength=len(offsets) - 1)
    total = np.diff(bx) + np.diff(by)
    return (inter > 0) & (100 * inter >= percent * (total - inter))


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("query", "member").alias("a"), F.greatest("query", "member").alias("b")).distinct()


def _inside(opened: DataFrame, members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of opened groups (query, own, group) the members that share enough prefix tokens with the query, and how many: query, member, own, group, common."""
    nq, nm = F.col("nq"), F.col("nm")
    k = _least_shared(nq, nm, percent)
    early = (F.col("rq") <= nq - _rest(nq, percent) - k) & (F.col("rm") <= nm - _rest(nm, percent) - k)
    queries = members.select(F.col("token").alias("t"), F.col("doc_id").alias("query"), F.col("n").alias("nq"), F.col("rank").alias("rq")).join(opened.withColumnRenamed("group", "g"), "query")
    inside = members.select("token", F.col("doc_id").alias("member"), F.col("component").alias("group"), F.col("n").alias("nm"), F.col("rank").alias("rm"))
    near = queries.join(inside, (F.col("t") == F.col("token")) & (F.col("g") == F.col("group")) & _sizes_fit("nq", "nm", percent) & early)
    near = near.select("query", "member", "own", "group", "nq", "nm").distinct()
    prefix = lambda name: sets.select(F.col("doc_id").alias(name), F.col("prefix").alias(f"of_{name}"))
    found = near.join(prefix("query"), "query").join(prefix("member"), "member").withColumn("common", F.size(F.array_intersect("of_query", "of_member")))
    return found.where(F.col("common") >= k).select("query", "member", "own", "group", "common")


def ngram_join(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc id, n_shingles, component_id: the least doc id reachable by links. A row per row of docs; a null id is a class of its own."""
    small_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    every = written(signatures(base, width, percent, token_levels(base, width)), "signatures")
    first = every.where("n > 0 AND doc_id IS NOT NULL").groupBy("n", "d1", "d2").agg(F.min(F.struct("doc_id", "prefix")).alias("s"))
    sets = written(first.select("n", "d1", "d2", "s.*"), "sets")

    # postings of tokens that several sets have in their prefix, of documents that share enough of them with others of fitting sizes;
    # what a token's postings have in common is summed before shuffling and joined back, so that a frequent token's can be split
    by_doc = Window.partitionBy("doc_id")
    tokens = sets.select("doc_id", "n", F.posexplode("prefix").alias("rank", "token"))
    spread = tokens.groupBy("token").agg(F.count("*").alias("df"), F.min("n").alias("lo"), F.max("n").alias("hi")).where("df > 1")
    postings = tokens.join(spread.drop("df"), "token")
    n, common = F.col("n"), F.count("*").over(by_doc)
    smallest, largest = F.greatest("lo", F.floor(n * percent / 100)), F.least("hi", F.ceil(n * 100 / percent))
    # at the sizes in between the bound is at most 2 lower, by rounding
    enough = F.least(_least_shared(n, n, percent), _least_shared(n, smallest, percent), _least_shared(n, largest, percent)) - 2
    postings = postings.withColumn("common", common).where(F.col("common") >= enough).withColumns({"common": common, "enough": F.min(enough).over(by_doc)}).where("common >= enough")
    postings = written(postings.select("token", "doc_id", "n", "rank", "common"), "postings")

    # stars: the document of a token that has most in common with others is closest to what all share
    hubs = postings.groupBy("token").agg(F.max(F.struct("common", (-F.col("doc_id")).alias("id"), F.col("n").alias("size"))).alias("hub"))
    stars = postings.join(hubs, "token").where("doc_id <> -hub.id").groupBy("doc_id", "n", "hub").count().where(_sizes_fit("n", "hub.size", percent))
    best = stars.groupBy("doc_id").agg(F.max(F.struct("count", "hub")).alias("s")).select(F.least(-F.col("s.hub.id"), "doc_id").alias("a"), F.greatest(-F.col("s.hub.id"), "doc_id").alias("b")).distinct()
    links = written(_links(best, base, width, percent), "links")

    # groups so far, and the matrix: tokens that several groups have
    group = components(links)
    grouped = postings.select("token", "doc_id", "n", "rank").join(group.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    between = grouped.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("token")
    members = written(grouped.join(between, "token"), "members")
    matrix = members.groupBy("token", F.col("component").alias("group")).agg(F.min("n").alias("least"), F.max("n").alias("most"))
    # each two groups once: the documents of the one are the queries. Of k prefix tokens that two sets share, at least the half
    # are not among the last k / 2 of the query's prefix; so the union needs to hold that many of those before
    asking = members.select("token", F.col("doc_id").alias("query"), F.col("component").alias("own"), "n", "rank")
    fits = (F.col("least") * percent <= n * 100) & (F.col("most") * 100 >= n * percent)
    nearest = F.least(F.greatest("n", "least"), "most")
    at_least = F.greatest(F.lit(1), F.least(*[_least_shared(n, m, percent) for m in (nearest, F.greatest("least", F.floor(n * percent / 100)), F.least("most", F.ceil(n * 100 / percent)))]) - 2)
    met = asking.join(matrix, (asking["token"] == matrix["token"]) & (F.col("own") > F.col("group")) & fits & (F.col("rank") < n - _rest(n, percent) - F.floor(at_least / 2)))
    overlap = met.groupBy("query", "own", "group").agg(F.count("*").alias("shared"), F.min(F.ceil(at_least / 2)).alias("bound"))
    opened = written(overlap.where("shared >= bound").select("query", "own", "group", "shared"), "opened")

    # of each two groups the query with most in the other's union asks first, for the member it shares most with: one link joins both
    ask = opened.groupBy("own", "group").agg(F.max(F.struct("shared", "query")).alias("s")).select("s.query", "own", "group")
    likeliest = _inside(ask, members, sets, percent).groupBy("own", "group").agg(F.max(F.struct("common", "query", "member")).alias("s"))
    links = written(links.unionByName(_links(_ordered(likeliest.select("s.*")), base, width, percent)), "links")

    # members of opened groups that are still apart, one by one
    group = components(links)
    own, other = (group.select(F.col("node").alias(name), F.col("component").alias(f"{name}_now")) for name in ("own", "group"))
    now = opened.join(own, "own", "left").join(other, "group", "left")
    apart = now.where(F.coalesce("own_now", "own") != F.coalesce("group_now", "group")).select("query", "own", "group")
    more = written(_links(_ordered(_inside(apart, members, sets, percent)), base, width, percent), "links")

    final = components(links.unionByName(more)) if more.limit(1).count() else group
    classes = sets.select("n", "d1", "d2", F.col("doc_id").alias("node")).join(final, "node", "left").select("n", "d1", "d2", F.coalesce("component", "node").alias("component"))
    out = every.select("doc_id", "n", "d1", "d2").join(classes, ["n", "d1", "d2"], "left")
    return out.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def first_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs without those whose class has a document with a smaller doc_id; columns stay as they are. Of rows that repeat an id the one with the
    least hash of its text, then of its other columns, stays.

    Only rows that may have to go are shuffled.
    """
    classes = written(ngram_join(docs, width, percent), "classes")
    gone = classes.where("doc_id <> component_id").select("doc_id").distinct()
    twice = classes.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id")
    maybe, stays = members_apart(docs, "doc_id", gone.unionByName(twice))
    kept = maybe.join(gone, "doc_id", "left_anti").select(*docs.columns)
    hashed = [F.xxhash64(F.coalesce("text", F.lit(""))), F.xxhash64(*docs.columns)]
    row = fresh_name("row", docs.columns)
    one = kept.groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), F.struct(*hashed)).alias(row))
    return stays.unionByName(one.select(f"{row}.*"))
