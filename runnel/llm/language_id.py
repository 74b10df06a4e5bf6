"""Language identification of words by a linear-chain conditional random field.

Every word has hashed affix, n-gram and lexicon features: its own identity, and whether it stands in the lexicon of a language, the words
that are mostly seen in it. Learned transitions join neighbours; forward-backward gives each
word's posterior over the languages, so that code-switched text is labelled word by word. A document gets the language
with the most posterior mass, and its share as score.

Training uses a bounded sample of rows: about `docs_per_lang` labelled documents of each language, DOCS_PER_LANG by default, chosen by a hash of
the id, of each the whole text. The texts are cut into stretches of CHUNK_WORDS words; stretches of different documents follow each other in
the training sequences, so that switches are learned. Prediction reads every whole text. Only the text is a feature.

Null text, empty text and text without a letter: `und` with score 0. Labels that are null are not learned. With no
labelled row at all every document is `und`. Repeated rows are predicted alike; ties go to the first label in order.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._bytes import LOWER, Prefix, blocks, byte_class, tidy, words
from ._shared import small_batches

DOCS_PER_LANG = 300
CHUNK_WORDS = 24
#: A word is in a language's lexicon if it has come so often in the sample, and this share of times in that language.
LEXICON_COUNT, LEXICON_SHARE = 3, 0.8
BITS = 16
STEP = 32
RUNS = T.ArrayType(T.StructType().add("lang", "string").add("words", "integer"))
ROUNDS = 40
#: Bytes of ASCII letters and of all characters beyond ASCII.
LETTER = byte_class((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
ASCII_LETTER = byte_class((0x41, 0x5A), (0x61, 0x7A))
_K = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)


def folded(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with A-Z and the capitals of Latin-1 in lower case."""
    low = LOWER[data]
    lead = np.flatnonzero(low[:-1] == 0xC3) + 1
    low[lead[(low[lead] >= 0x80) & (low[lead] <= 0x9E) & (low[lead] != 0x97)]] += 0x20
    return low


class Lexicon:
    """Words, by their hashes, and the label that each mostly has."""

    def __init__(self, hashes: np.ndarray | None = None, labels: np.ndarray | None = None):
        self.hashes = np.zeros(0, np.uint64) if hashes is None else hashes
        self.labels = np.zeros(0, np.int64) if labels is None else labels

    @classmethod
    def learned(cls, distinct: np.ndarray, by_label: np.ndarray) -> Lexicon:
        """From how often each distinct word has come with each label."""
        total = by_label.sum(1)
        sure = np.flatnonzero((total >= LEXICON_COUNT) & (by_label.max(1) >= LEXICON_SHARE * total))
        sure = sure[np.argsort(distinct[sure])]
        return cls(distinct[sure], by_label[sure].argmax(1))

    def of(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the words stand in it, and with which label."""
        if not len(self.hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        found = np.flatnonzero(self.hashes[at] == hashes)
        return found, self.labels[at[found]]


def features(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    """Feature ids of words one after another, and where each word's begin."""
    size = ends - starts
    total = int(size.sum())
    begin = np.cumsum(size) - size
    of = np.repeat(np.arange(len(size)), size)
    byte = low[np.arange(total) - np.repeat(begin - starts, size)].astype(np.uint64)
    left = np.arange(total) - begin[of]
    right = size[of] - left
    padded = np.concatenate([byte, np.zeros(2, np.uint64)])
    two = byte * np.uint64(256) + padded[1:-1]
    three = two * np.uint64(256) + padded[2:]
    ident = lambda x, kind: ((x * np.uint64(8) + np.uint64(kind)) * _K[0]) >> np.uint64(64 - BITS)
    pick = lambda at, values, kind: (of[at], ident(values[at], kind))
    first, last = left == 0, right == 1
    parts = [
        (np.arange(len(size)), ident(hashes, 7)),
        pick(first, byte, 0), pick(first & (right >= 2), two, 1), pick(first & (right >= 3), three, 2),
        pick(last, byte, 3), pick(right == 2, two, 4), pick(right == 3, three, 5), pick(right >= 2, two, 6),
    ]
    at3 = right >= 3
    parts.append((of[at3], (three[at3] * _K[1]) >> np.uint64(64 - BITS)))
    listed, label = lexicon.of(hashes)
    parts.append((listed, ((label.astype(np.uint64) + np.uint64(1 << 40)) * _K[1]) >> np.uint64(64 - BITS)))
    owner, ids = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]).astype(np.int64)
    order = np.argsort(owner, kind="stable")
    return ids[order], np.searchsorted(owner[order], np.arange(len(size)))


class Model:
    def __init__(self, labels: list[str], weights: np.ndarray, transitions: np.ndarray, lexicon: Lexicon | None = None):
        self.labels, self.weights, self.transitions, self.lexicon = labels, weights, transitions, lexicon or Lexicon()

    def emissions(self, low, starts, ends, hashes):
        """Scores of the distinct words, and each word's row in them."""
        codes, distinct = pd.factorize(hashes)
        at = np.empty(len(distinct), np.int64)
        at[codes[::-1]] = np.arange(len(codes))[::-1]
        ids, begin = features(low, starts[at], ends[at], distinct, self.lexicon)
        return np.add.reduceat(self.weights[ids], begin, axis=0), codes

    def posteriors(self, scores: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Per word, the posterior of each label. Documents are cut into steps of STEP words whose transfer matrices are chained."""
        n, k = len(scores), len(self.labels)
        em = np.exp(scores - scores.max(1, keepdims=True))
        trans = np.exp(self.transitions - self.transitions.max()).astype(em.dtype)
        n_words = np.diff(first)
        n_steps = -(-n_words // STEP)
        begin = np.concatenate([[0], np.cumsum(n_steps)])
        doc = np.repeat(np.arange(len(n_words)), n_steps)
        start = first[doc] + (np.arange(begin[-1]) - begin[doc]) * STEP
        size = np.minimum(STEP, first[doc + 1] - start)
        at = np.minimum(start[:, None] + np.arange(STEP), n - 1)
        live = np.arange(STEP) < size[:, None]
        e = em[at]
        e[~live] = 0
        c = len(start)
        begins = (start == first[doc])[:, None]  # no transition leads into a document's first word
        move = np.broadcast_to(np.eye(k, dtype=em.dtype), (c, k, k))
        for t in range(STEP):
            nxt = (move.reshape(-1, k) @ trans).reshape(c, k, k)
            nxt = (nxt if t else np.where(begins[:, :, None], em.dtype.type(1), nxt)) * e[:, t, None, :]
            nxt /= np.maximum(nxt.max((1, 2), keepdims=True), 1e-30)
            move = np.where(live[:, t, None, None], nxt, move)
        ahead, back = np.empty((c, k), em.dtype), np.empty((c, k), em.dtype)
        order = np.argsort(-n_steps, kind="stable")
        a = np.full((len(order), k), 1.0 / k, em.dtype)
        b = np.ones((len(order), k), em.dtype)
        longest = int(n_steps.max()) if len(n_steps) else 0
        deep = np.searchsorted(-n_steps[order], -np.arange(longest), "left")  # documents with more steps than i
        for i in range(longest):
            d = order[: deep[i]]
            here, there = begin[d] + i, begin[d + 1] - 1 - i
            ahead[here], back[there] = a[: len(d)], b[: len(d)]
            a[: len(d)] = np.einsum("ci,cij->cj", a[: len(d)], move[here])
            b[: len(d)] = np.einsum("cij,cj->ci", move[there], b[: len(d)])
            a[: len(d)] /= a[: len(d)].sum(1, keepdims=True)
            b[: len(d)] /= b[: len(d)].max(1, keepdims=True)
        f = np.empty((STEP, c, k), em.dtype)
        cur = ahead
        for t in range(STEP):
            cur = (cur @ trans if t else np.where(begins, em.dtype.type(1), cur @ trans)) * e[:, t]
            cur /= np.maximum(cur.sum(1, keepdims=True), 1e-30)
            f[t] = cur
        cur = back
        for t in reversed(range(STEP)):
            f[t] *= cur
            nxt = (cur * e[:, t]) @ trans.T
            nxt /= np.maximum(nxt.max(1, keepdims=True), 1e-30)
            cur = np.where(live[:, t, None], nxt, cur)
        f /= np.maximum(f.sum(2, keepdims=True), 1e-30)
        return f.transpose(1, 0, 2)[live]

    def words(self, data: np.ndarray, offsets: np.ndarray):
        """Word bounds, each document's first word, posteriors."""
        s, e, first = words(data, offsets, LETTER)
        if not len(s) or not self.labels:
            return s, e, first, np.zeros((len(s), max(1, len(self.labels))))
        low = folded(data)
        scores, codes = self.emissions(low, s, e, Prefix(low).ranges(s, e))
        return s, e, first, self.posteriors(scores[codes], first)


def _texts(docs: DataFrame, text_col: str, label_col: str) -> DataFrame:
    """Per document: its label, and its whole text in lower case."""

    def run(batches):
        for batch, data, offsets in blocks(batches, "text"):
            low = folded(data).tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([low[x:y] for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], pa.binary())], names=["r", "label", "low"])

    return docs.select("r", F.col(label_col).alias("label"), F.col(text_col).alias("text")).mapInArrow(tidy(run), "r long, label string, low binary")


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", docs_per_lang: int = DOCS_PER_LANG) -> Model:
    """A model from a bounded sample of the labelled rows."""
    small_batches(labelled.sparkSession)
    rows = labelled.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull())
    counts = dict(rows.groupBy(label_col).count().collect())
    if not counts:
        return Model([], np.zeros((1, 1), np.float32), np.zeros((1, 1), np.float32))
    rate = F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, min(1.0, docs_per_lang / n))])
    rank = F.xxhash64(F.col(id_col), F.lit("sample"))
    chosen = rows.withColumn("r", rank).where(F.pmod("r", F.lit(1 << 30)) < rate[F.col(label_col)] * (1 << 30))
    return fit([(r.label, r.low) for r in sorted(_texts(chosen, text_col, label_col).collect(), key=lambda r: (r.r, r.low))], sorted(counts))


def fit(texts: list[tuple[str, bytes]], labels: list[str]) -> Model:
    """Maximises the likelihood of the labels of all words of the texts (in lower case) with Adam; three stretches make a sequence."""
    k, per = len(labels), 3
    width = per * CHUNK_WORDS
    data = np.frombuffer(b"".join(t for _, t in texts), np.uint8)
    starts, ends, first = words(data, np.concatenate([[0], np.cumsum([len(t) for _, t in texts])]).astype(np.int64), LETTER)
    if not len(starts):
        return Model([], np.zeros((1, 1), np.float32), np.zeros((1, 1), np.float32))
    # stretches of each text, in a random order, three a row
    parts = -(-np.diff(first) // CHUNK_WORDS)
    doc = np.repeat(np.arange(len(texts)), parts)
    begin = first[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)) * CHUNK_WORDS
    size = np.minimum(CHUNK_WORDS, first[doc + 1] - begin)
    order = np.random.default_rng(7).permutation(len(doc))
    doc, begin, size = doc[order], begin[order], size[order]
    row = np.arange(len(order)) // per
    before = np.cumsum(size) - size
    at = before - before[row * per]
    y = np.zeros((-(-len(order) // per), width), np.int32)
    mask, place = np.zeros(y.shape, bool), np.zeros(y.shape, np.int32)
    inner = np.arange(size.sum()) - np.repeat(before, size)
    cell = (np.repeat(row, size), np.repeat(at, size) + inner)
    label_of = np.array([labels.index(label) for label, _ in texts], np.int64)
    y[cell], mask[cell], place[cell] = np.repeat(label_of[doc], size), True, np.repeat(begin, size) + inner
    codes, distinct = pd.factorize(Prefix(data).ranges(starts, ends))
    at = np.empty(len(distinct), np.int64)
    at[codes[::-1]] = np.arange(len(codes))[::-1]
    row = codes.astype(np.int32)[place]
    gold = np.zeros((len(distinct), k))
    for j in range(k):
        gold[:, j] = np.bincount(row[mask & (y == j)], minlength=len(distinct))
    lexicon = Lexicon.learned(distinct, gold)
    ids, begin = features(data, starts[at], ends[at], distinct, lexicon)
    per_word = np.diff(np.append(begin, len(ids)))
    pair = mask[:, 1:] & mask[:, :-1]
    gold_pairs = np.zeros((k, k))
    np.add.at(gold_pairs, (y[:, :-1][pair], y[:, 1:][pair]), 1)
    w, t = np.zeros((1 << BITS, k)), np.zeros((k, k))
    m1, m2, n1, n2 = np.zeros_like(w), np.zeros_like(w), np.zeros_like(t), np.zeros_like(t)
    total = mask.sum()
    for step in range(1, ROUNDS + 1):
        by_word = np.add.reduceat(w[ids], begin, axis=0)
        em = np.exp(by_word - by_word.max(1, keepdims=True)).astype(np.float32)[row]
        move = np.exp(t).astype(np.float32)
        f = np.empty_like(em)
        cur = np.full((len(y), k), 1.0 / k, np.float32)
        for i in range(width):
            nxt = (cur @ move if i else cur) * em[:, i]
            nxt /= nxt.sum(1, keepdims=True)
            cur = np.where(mask[:, i, None], nxt, cur)
            f[:, i] = cur
        pairs, b = np.zeros((k, k)), np.ones((len(y), k), np.float32)
        for i in reversed(range(width)):
            x = f[:, i] * b
            f[:, i] = x / x.sum(1, keepdims=True)  # from here on the posteriors
            eb = em[:, i] * b
            if i:
                live = pair[:, i - 1]
                p = f[live, i - 1][:, :, None] * move * eb[live][:, None, :]
                pairs += (p / p.sum((1, 2), keepdims=True)).sum(0, dtype=np.float64)
            nb = eb @ move.T
            b = np.where(mask[:, i, None], nb / nb.max(1, keepdims=True), b)
        diff = gold.copy()
        for j in range(k):
            diff[:, j] -= np.bincount(row[mask], weights=f[:, :, j][mask], minlength=len(distinct))
        gw = np.stack([np.bincount(ids, weights=np.repeat(diff[:, j], per_word), minlength=1 << BITS) for j in range(k)], 1) / total - 1e-6 * w
        gt = (gold_pairs - pairs) / total
        for x, grad, a, c, rate in ((w, gw, m1, m2, 0.1), (t, gt, n1, n2, 0.2)):
            a += 0.1 * (grad - a)
            c += 0.01 * (grad * grad - c)
            x += rate * (a / (1 - 0.9**step)) / (np.sqrt(c / (1 - 0.99**step)) + 1e-8)
    return Model(labels, w.astype(np.float32), t.astype(np.float32), lexicon)


def _has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def identify(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (all by default) with lang_pred, score and runs: array of (lang, words) over the text's words in order."""
    small_batches(docs.sparkSession)
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score", "runs")]
    source = text_col if text_col in keep else "__text"  # a text that is kept is sent once
    df = docs.select(*keep) if source == text_col else docs.select(*keep, F.col(text_col).alias(source))
    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double").add("runs", RUNS)
    run_type = pa.list_(pa.struct([("lang", pa.string()), ("words", pa.int32())]))

    def run(batches):
        for batch, data, offsets in blocks(batches, source):
            _, _, first, post = model.words(data, offsets)
            n = len(offsets) - 1
            mass = np.concatenate([np.zeros((1, post.shape[1])), np.cumsum(post, 0, dtype=np.float64)])
            mass = mass[first[1:]] - mass[first[:-1]]
            total = mass.sum(1)
            best = mass.argmax(1)
            ascii_letters = np.concatenate([[0], np.cumsum(ASCII_LETTER[data])])
            sure = ascii_letters[offsets[1:]] > ascii_letters[offsets[:-1]]
            word_label = post.argmax(1)
            doc = np.repeat(np.arange(n), np.diff(first))
            edge = np.ones(len(doc) + 1, bool)
            edge[1:-1] = (word_label[1:] != word_label[:-1]) | (doc[1:] != doc[:-1])
            at = np.flatnonzero(edge)
            runs, langs, scores = [[] for _ in range(n)], ["und"] * n, np.zeros(n)
            known = bool(model.labels)
            for d in range(n):
                if known and total[d] > 0 and (sure[d] or _has_letter(bytes(data[offsets[d] : offsets[d + 1]]).decode("utf-8", "ignore"))):
                    langs[d], scores[d] = model.labels[best[d]], min(1.0, max(0.0, mass[d, best[d]] / total[d]))
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True) if known and len(doc) else ():
                if langs[doc[a]] != "und":
                    runs[doc[a]].append({"lang": model.labels[word_label[a]], "words": b - a})
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], pa.array(langs), pa.array(scores), pa.array(runs, run_type)], names=[*keep, "lang_pred", "score", "runs"])

    return df.mapInArrow(tidy(run), schema)


def fold(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo 3."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3
