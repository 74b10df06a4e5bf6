"""Document fingerprints by one-permutation MinHash with optimal densification, in Spark expressions only.

Word shingles (five words; fewer words: the whole sequence as one) are hashed once; the high bits of a hash choose its
bin, each bin keeps its least value; an empty bin copies the first filled bin in a random probing order of its own; the low
eight bits of each bin's value are packed, eight bins a long. likeness() compares packed fingerprints a long at a time and corrects for
matches by chance; shown, a fingerprint is its longs as hex digits.

Text is split at white space and lower-cased. Null or empty text has no shingle: its fingerprint is empty, alike (1.0)
to another empty one and to no other (0.0). Equal texts have equal fingerprints. Rows follow each other by id, those of one id by a hash of the
text, those without an id last; repeated rows follow themselves. An empty table gives no rows. Columns other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import apart, longs, text_of
from .sharding import range_of, splitters

BIN_BITS = 8
BINS = 1 << BIN_BITS
WIDTH = 5
#: Random probes of an empty bin before the rest of its probing order, in which the filled bin of the least hash comes first.
PROBES = 8
#: Text in an id range; the number of ranges follows the input, within bounds.
RANGE_BYTES = 16 << 20
LEAST_RANGES, MOST_RANGES = 16, 1 << 16


def fingerprint_hash_column(text: Column) -> Column:
    """Hashes of the words of a text."""
    return F.transform(F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != ""), lambda w: F.xxhash64(w))


def bin_minima(words: Column, width: int = WIDTH) -> Column:
    """The least shingle hash of each filled bin, ascending, from an array of word hashes."""
    n = F.size(words)
    several = F.transform(F.sequence(F.lit(0), n - width), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(width)]))
    one = F.array(F.xxhash64(F.array_join(words.cast("array<string>"), " ")))
    hashes = F.when(n == 0, F.array().cast("array<bigint>")).when(n < width, one).otherwise(several)
    return F.sort_array(hashes)


def with_fingerprint(df: DataFrame, text_col: str, out: str, width: int = WIDTH) -> DataFrame:
    """df with the packed fingerprint of a text column, an array of longs."""
    shift = 64 - BIN_BITS
    w, s, m, b, f = (f"__{out}_{x}" for x in "wsmbf")
    bin_of = lambda h: F.shiftright(h, shift).cast("int") + BINS // 2
    df = df.withColumn(w, fingerprint_hash_column(text_of(text_col)))
    df = df.withColumn(s, bin_minima(F.col(w), width))
    df = df.withColumn(m, F.filter(s, lambda h, i: (i == 0) | (F.shiftright(h, shift) != F.shiftright(F.get(s, i - 1), shift))))
    gap = lambda h, i: F.coalesce(bin_of(F.get(m, i + 1)), F.lit(BINS)) - bin_of(h) - 1
    none = F.lit(None).cast("bigint")
    spread = F.flatten(F.transform(m, lambda h, i: F.concat(F.array(h), F.array_repeat(none, gap(h, i)))))
    df = df.withColumn(b, F.when(F.size(m) == BINS, F.col(m)).when(F.size(m) > 0, F.concat(F.array_repeat(none, bin_of(F.get(m, F.lit(0)))), spread)))
    probes = lambda i: [F.get(b, F.pmod(F.xxhash64(i, F.lit(j)), F.lit(BINS)).cast("int")) for j in range(PROBES)]
    least = lambda i: F.array_min(F.transform(m, lambda h: F.struct(F.xxhash64(i, bin_of(h)).alias("r"), h.alias("h"))))["h"]
    df = df.withColumn(f, F.transform(b, lambda v, i: F.coalesce(v, *probes(i), least(i))))
    low = lambda i, k: F.shiftleft(F.get(f, i * 8 + k).bitwiseAND(F.lit(255)), 56 - 8 * k)
    packed = F.transform(F.sequence(F.lit(0), F.lit(BINS // 8 - 1)), lambda i: reduce(lambda x, y: x.bitwiseOR(y), [low(i, k) for k in range(8)]))
    return df.withColumn(out, F.when(F.size(m) > 0, packed).otherwise(F.array().cast("array<bigint>"))).drop(w, s, m, b, f)


def shown(packed: Column) -> Column:
    """A packed fingerprint as hex digits, two a bin."""
    return F.lower(F.array_join(F.transform(packed, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard likeness of two packed fingerprints, 0 to 1, corrected for low bits that agree by chance."""
    chance = 1.0 / 256

    def unlike_bytes(x: Column, y: Column) -> Column:
        """In how many of their eight bytes two longs differ: each byte of their difference is folded to one bit."""
        z = x.bitwiseXOR(y)
        for shift, mask in ((4, 0x0F0F0F0F0F0F0F0F), (2, 0x0303030303030303), (1, 0x0101010101010101)):
            z = z.bitwiseOR(F.shiftrightunsigned(z, shift)).bitwiseAND(F.lit(mask))
        return F.bit_count(z)

    unlike = F.aggregate(F.zip_with(a, b, unlike_bytes), F.lit(0), lambda n, x: n + x)
    share = 1 - unlike / F.lit(float(BINS))
    return F.when(a == b, F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), (share - chance) / (1 - chance)))


def with_next(docs: DataFrame, id_col: str, columns: list[str], size: Column, tie: Column, derive: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Each row with next_<column> of the row that follows it by id, then by `tie`; after the last, of the first. derive adds columns to each row.

    Rows are dealt into id ranges by size-weighted sampled splitters, a range a task; the first row of each range is copied to the range before
    it, so that no window spans ranges and columns are shuffled once, before others are derived from them. Of a range its least id
    reaches the driver.
    """
    base = docs.withColumns({"__key": F.coalesce(F.col(id_col), F.lit((1 << 63) - 1)), "__last": F.col(id_col).isNull(), "__tie": tie, "__size": size.cast("long")})
    total = base.agg(F.sum("__size")).first()[0] or 0
    bounds = splitters(base.select(F.col("__key").alias("key"), F.col("__key").alias("id"), F.col("__size").alias("size")), min(MOST_RANGES, max(LEAST_RANGES, total // RANGE_BYTES)))
    n = len(bounds) + 1
    base = base.withColumn("__place", F.get(longs(apart(n)), range_of(F.col("__key"), bounds)).cast("int")).drop("__size")
    least = sorted((r[1], r[0]) for r in base.groupBy("__place").agg(F.min("__key")).collect())
    ring = [(place, least[i - 1][1]) for i, (_, place) in enumerate(least)]
    order = ["__key", "__last", "__tie"]
    first = base.groupBy("__place").agg(F.min_by(F.struct(*order, *[c for c in columns if c in docs.columns]), F.struct(*order)).alias("__first"))
    to = docs.sparkSession.createDataFrame(ring, "__place int, __to int")
    copies = first.join(F.broadcast(to), "__place").select(F.col("__to").alias("__place"), "__first.*", F.lit(True).alias("__copy"))
    both = base.withColumn("__copy", F.lit(False)).unionByName(copies, allowMissingColumns=True).repartition(n, "__place")
    both = derive(both)
    w = Window.partitionBy("__place").orderBy("__copy", *order)
    return both.withColumns({f"next_{c}": F.lead(c).over(w) for c in columns}).where(~F.col("__copy")).drop("__place", "__copy", *order)


def edited(text: Column, following: Column, n: Column) -> Column:
    """The last quarter of the code points replaced by the first as many of the following text."""
    k = F.floor(n / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), (n - k).cast("int")), F.substring(following, F.lit(1), k))


def edit_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited form, and their likenesses."""
    base = docs.select(F.col(id_col), text_of(text_col).alias("text"))
    rows = with_next(base, id_col, ["text", "fingerprint"], F.octet_length("text") + 1, F.xxhash64("text"), lambda df: with_fingerprint(df, "text", "fingerprint"))
    rows = rows.withColumn("n_chars", F.char_length("text").cast("long")).withColumn("edited", edited(F.col("text"), F.coalesce("next_text", F.lit("")), F.col("n_chars")))
    rows = with_fingerprint(rows, "edited", "edited_fingerprint")
    return rows.select(
        id_col, "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), shown(F.col("fingerprint")).alias("fingerprint"), shown(F.col("edited_fingerprint")).alias("edited_fingerprint"),
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
