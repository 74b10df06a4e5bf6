"""SentencePiece encoding and decoding.

An Aho-Corasick automaton over all pieces drives one pass over a word; at each position the output links give the pieces
that end there, and the best score at the position is relaxed through them. With a unigram model this is Viterbi on the
piece scores. A BPE model's scores are merge priorities, and adding them up gives other pieces than merging does; there
a position instead keeps the one piece that can stand last: the piece that ends there and that merging leaves apart
from the last piece before it (neighbours that merging keeps apart two by two are kept apart in a whole sequence), which
gives what the public library gives. Words (a run of meta spaces and what follows up to the next) are encoded once a batch each,
since no piece spans two words; a model with pieces that do is encoded text by text.

Characters without a piece become byte pieces, or the unknown id if the model has none. Null text is treated as empty, which
has no ids. Repeated rows are encoded alike. Decoding gives back the text exactly where the model normalises by identity, but for a literal meta
space (U+2581), which comes back as a space, as in the public library.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from ._bytes import give_back, kept_by_tasks, tidy
from ._shared import small_batches

_IDS = ArrayType(IntegerType())
SPACE = "▁"
#: Pairs of pieces of which a worker remembers whether merging keeps them apart.
PAIRS = 1 << 20
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6


def _fields(raw: bytes):
    """Wire-format fields of a protocol buffer message: number and value."""
    at = 0

    def varint():
        nonlocal at
        out = shift = 0
        while True:
            b = raw[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            value = varint()
        elif kind == 2:
            size = varint()
            value = raw[at : at + size]
            at += size
        else:
            size = 8 if kind == 1 else 4
            value = raw[at : at + size]
            at += size
        yield tag >> 3, value


class Codec:
    """merging: as a BPE model, or not: as a unigram model, by Viterbi on the scores; what the model says by default."""

    def __init__(self, model: bytes, merging: bool | None = None):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        kinds, trainer, normalizer = [], {}, {}
        for number, value in _fields(model):
            if number == 1:
                f = dict(_fields(value))
                self.pieces.append(f.get(1, b"").decode())
                self.scores.append(float(np.frombuffer(f[2], "<f4")[0]) if 2 in f else 0.0)
                kinds.append(f.get(3, NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normalizer = dict(_fields(value))
        self.bpe = trainer.get(3, 1) == 2 if merging is None else merging
        self.dummy_prefix = bool(normalizer.get(3, 1))
        self.squeeze = bool(normalizer.get(4, 1))
        self.kinds = kinds
        self.unknown = next((i for i, k in enumerate(kinds) if k == UNKNOWN), 0)
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, kinds, strict=True)) if k == BYTE}
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, kinds, strict=True)) if k in (NORMAL, USER)}
        self.by_word = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        self._apart: dict[int, bool] = {}
        self._alone: dict[int, bool] = {}
        self.letters = frozenset(p for p in self.ids if len(p) == 1)
        # no piece spans a space or, mostly, a line end: what stands between is a word
        self.split = re.compile(" *[^ \n]+|\n| +" if self.by_word and not any("\n" in p for p in self.ids) else " *[^ ]+| +" if self.by_word else "(?s).+")
        low = min(self.scores, default=0.0)
        self.unknown_score = low - 10.0

    # -- encoding

    def _merged(self, text: str) -> list[str]:
        """Merging by priority: the highest score first, the leftmost of equal ones."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                k = self.ids.get(parts[i] + parts[i + 1])
                if k is not None and (best is None or self.scores[k] > best):
                    best, at = self.scores[k], i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _keeps_apart(self, a: int, b: int) -> bool:
        """Whether merging leaves the two pieces as they are, side by side."""
        pair = a * len(self.pieces) + b
        if pair not in self._apart:
            if len(self._apart) >= PAIRS:
                self._apart.clear()
            x, y = self.pieces[a], self.pieces[b]
            self._apart[pair] = self._merged(x + y) == [x, y]
        return self._apart[pair]

    def _whole(self, a: int) -> bool:
        """Whether merging gives this piece from its own characters."""
        if a not in self._alone:
            self._alone[a] = len(self._merged(self.pieces[a])) == 1
        return self._alone[a]

    def _merge_word(self, word: str) -> list[int]:
        """encode_word for a merging model and a word whose characters all are pieces."""
        n = len(word)
        ids, sizes = [0] * (n + 1), [0] * (n + 1)
        apart, alone, many = self._apart, self._alone, len(self.pieces)
        for end, (i, size) in self.automaton.iter(word):  # at each end the longest piece first
            end += 1
            if sizes[end]:
                continue
            before = end - size
            if before:
                if not sizes[before]:
                    continue
                fits = apart.get(ids[before] * many + i)
                if fits is None:
                    fits = self._keeps_apart(ids[before], i) and self._whole(i)
                    apart[ids[before] * many + i] = fits
            else:
                fits = alone.get(i)
                if fits is None:
                    fits = self._whole(i)
            if fits:
                ids[end], sizes[end] = i, size
        out, at = [], n
        while at:
            out.append(ids[at])
            at -= sizes[at]
        out.reverse()
        return out

    def encode_word(self, word: str) -> list[int]:
        """Ids of one word, in one pass."""
        if self.bpe and self.letters.issuperset(word):
            return self._merge_word(word)
        n = len(word)
        ends: list[list[tuple[int, int]]] = [[] for _ in range(n + 1)]
        for last, (i, size) in self.automaton.iter(word):
            ends[last + 1].append((i, size))
        score = [0.0] + [-np.inf] * n
        # the last piece at each position: its id (minus one minus the code point for a character without a piece), and its length
        last: list[tuple[int, int] | None] = [None] * (n + 1)
        for at in range(1, n + 1):
            if self.bpe:
                for i, size in sorted(ends[at], key=lambda x: -x[1]):
                    before = at - size
                    if before and last[before] is None or not self._whole(i):
                        continue
                    if not before or last[before][0] < 0 or self._keeps_apart(last[before][0], i):
                        last[at] = (i, size)
                        score[at] = 0.0
                        break
            else:
                for i, size in ends[at]:
                    if score[at - size] + self.scores[i] > score[at]:
                        score[at], last[at] = score[at - size] + self.scores[i], (i, size)
            if word[at - 1] not in self.ids and (last[at] is None or score[at - 1] + self.unknown_score > score[at]):
                last[at] = (-1 - ord(word[at - 1]), 1)
                score[at] = score[at - 1] + self.unknown_score
        out, at = [], n
        while at:
            i, size = last[at]
            out.append(i)
            at -= size
        ids: list[int] = []
        for i in reversed(out):
            if i >= 0:
                ids.append(i)
            elif self.bytes:
                ids += [self.bytes[b] for b in chr(-1 - i).encode()]
            elif not ids or ids[-1] != self.unknown:
                ids.append(self.unknown)
        return ids

    def words(self, text: str) -> list[str]:
        """Words with the spaces before them; they make up the normalised text."""
        if SPACE in text:
            text = text.replace(SPACE, " ")  # the meta space stands for a space in texts, too
        if self.squeeze:
            text = " ".join(x for x in text.split(" ") if x)
        if not text:
            return []
        return self.split.findall(" " + text if self.dummy_prefix else text)

    def encode(self, text: str | None) -> list[int]:
        return [i for w in self.words(text or "") for i in self.encode_word(w.replace(" ", SPACE))]

    # -- decoding

    def raw_piece(self, i: int) -> bytes:
        k = self.kinds[i]
        if k == BYTE:
            return bytes([int(self.pieces[i][3:5], 16)])
        if k == CONTROL:
            return b""
        return b" \xe2\x81\x87 " if k == UNKNOWN else self.pieces[i].replace(SPACE, " ").encode()

    def decode(self, ids: list[int]) -> str:
        raw = b"".join(self.raw_piece(i) for i in ids)
        if self.dummy_prefix and raw.startswith(b" "):
            raw = raw[1:]
        return raw.decode("utf-8", "replace")


@kept_by_tasks
@lru_cache(2)
def _codec(model: bytes, merging: bool | None = None) -> Codec:
    return Codec(model, merging)


#: Words, and their characters, whose ids a task remembers; beyond it the memory starts anew, which changes no result.
REMEMBERED, REMEMBERED_CHARS = 1 << 18, 1 << 23


def encode(docs: DataFrame, model: bytes, text_col: str = "text", keep: list[str] | None = None, merging: bool | None = None) -> DataFrame:
    """The columns `keep` (all by default) with ids array<int>, n_ids, decoded_sha256 and exact: whether decoding gave the text back.

    model is the content of a model file, of a few MB at most; merging as in Codec.
    """
    small_batches(docs.sparkSession)
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("ids", "n_ids", "decoded_sha256", "exact")]
    column = keep.index(text_col) if text_col in keep else len(keep)  # a text that is kept is sent once
    df = docs.select(*keep) if column < len(keep) else docs.select(*keep, docs[text_col].alias("__text"))
    schema = docs.select(*keep).schema.add("ids", _IDS).add("n_ids", "long").add("decoded_sha256", "string").add("exact", "boolean")

    def run(batches):
        codec = _codec(model, merging)
        raw = [codec.raw_piece(i) for i in range(len(codec.pieces))]
        known: dict[str, int] = {}
        chars = 0
        decoded: list[bytes] = []
        flat, bounds = np.zeros(0, np.int32), np.zeros(1, np.int64)
        for batch in batches:
            texts = batch.column(column).to_pylist()
            for a in range(0, len(texts), 512):
                part = [t or "" for t in texts[a : a + 512]]
                if len(known) > REMEMBERED or chars > REMEMBERED_CHARS:
                    chars = 0
                    known, decoded, flat, bounds = {}, [], flat[:0], bounds[:1]
                rows, fresh = [], []
                for t in part:
                    ws = codec.words(t)
                    at = list(map(known.get, ws))
                    if None in at:
                        for j, k in enumerate(at):
                            if k is None:
                                w = ws[j]
                                k = known.get(w)
                                if k is None:
                                    k = known[w] = len(decoded)
                                    chars += len(w)
                                    fresh.append(codec.encode_word(w.replace(" ", SPACE)))
                                    decoded.append(b"".join([raw[i] for i in fresh[-1]]))
                                at[j] = k
                    rows.append(at)
                flat = np.concatenate([flat, np.array([i for ids in fresh for i in ids], np.int32)])
                bounds = np.concatenate([bounds, bounds[-1] + np.cumsum(np.array([len(ids) for ids in fresh], np.int64))])
                shas, exact = [], []
                for t, at in zip(part, rows, strict=True):
                    back = b"".join([decoded[k] for k in at])
                    if codec.dummy_prefix and back[:1] == b" ":
                        back = back[1:]
                    shas.append(hashlib.sha256(back).hexdigest())
                    exact.append(back == t.encode())
                words = np.array([k for at in rows for k in at], np.int64)
                size = bounds[words + 1] - bounds[words]
                ends = np.concatenate([[0], np.cumsum(size)])
                ids = flat[np.arange(ends[-1]) + np.repeat(bounds[words] - ends[:-1], size)]
                doc_ends = ends[np.concatenate([[0], np.cumsum([len(at) for at in rows])]).astype(np.int64)]
                cut = batch.slice(a, len(part))
                lists = pa.ListArray.from_arrays(pa.array(doc_ends.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([*[cut.column(i) for i in range(len(keep))], lists, pa.array(np.diff(doc_ends)), pa.array(shas), pa.array(exact)], names=[*keep, "ids", "n_ids", "decoded_sha256", "exact"])
            del batch, texts
            give_back()

    return df.mapInArrow(tidy(run), schema)


def decode(encoded: DataFrame, model: bytes, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """encoded with the text that its ids stand for; null ids give an empty text."""
    names = [c for c in encoded.columns if c != out]
    df = encoded.select(*names)

    def run(batches):
        codec = _codec(model)
        for batch in batches:
            texts = [codec.decode(ids or []) for ids in batch.column(names.index(ids_col)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*names, out])

    return df.mapInArrow(tidy(run), StructType([*df.schema.fields, StructField(out, StringType())]))

