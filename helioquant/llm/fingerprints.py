"""Document fingerprints by one-permutation MinHash with optimal densification.

The 64-bit hashes of a text's five-word shingles are sorted once. Their upper bits name one of
``BINS`` bins, so the first hash of each bin is its minimum. An empty bin copies the first filled
bin in a random order of all bins that is its own (optimal densification); the orders are affine maps
modulo the prime BINS + 1. The minimum is hashed with the
number of its bin, so that bins that copy one value differ, and the lowest BITS bits are kept, one
hexadecimal digit a bin. Two fingerprints agree in a digit with
probability J + (1 - J) / 2**BITS; the likeness takes that chance off again.

Everything is made of Spark's own functions. Words are what lies between white space; a text of
fewer than five words is one shingle. Defined cases: a null text is empty; an empty text, or one
without a word, has a fingerprint of BINS dots, which is like itself (1) and unlike any other (0);
rows with the same doc_id follow each other in the order of their texts; rows without an
id have no next document, which counts as empty; a document alone is its own next one; no rows give
no rows; other columns play no part.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helioquant.llm.common import read_table

BINS, BITS, WORDS = 256, 4, 5
_PRIME = BINS + 1
#: Documents that are put in order together, about; ids are cut at quantiles so that a stretch holds so many.
STRETCH = 2000
EMPTY = "." * BINS
#: Places of an empty bin's order that are looked up one by one before all filled bins are compared.
_PROBES = 6
_RANDOM = random.Random(5)
_FACTORS = [_RANDOM.randrange(1, _PRIME) for _ in range(BINS)]
_SHIFTS = [_RANDOM.randrange(_PRIME) for _ in range(BINS)]


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """df with a fingerprint of a column of texts that are not null.

    Each step is a column of its own and is used more than once in the next, so that Spark keeps it
    and does not repeat it inside the lambda functions.
    """
    columns = df.columns
    words = F.filter(F.split(F.col(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    df = df.withColumn("__w", F.transform(words, lambda w: F.xxhash64(w)))
    w = F.col("__w")
    # Past the last word get() is null, which xxhash64 skips; those entries are cut off.
    shingles = F.transform(w, lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, WORDS)]))
    short = F.array(F.aggregate(w, F.lit(1).cast("long"), lambda h, x: F.xxhash64(h, x)))
    df = df.withColumn(
        "__s", F.sort_array(F.when(F.size(w) >= WORDS, F.slice(shingles, 1, F.greatest(F.size(w) - (WORDS - 1), F.lit(1)))).otherwise(short))
    )
    s = F.col("__s")

    def bin_of(x: Column) -> Column:
        return (F.shiftright(x, 64 - (BINS.bit_length() - 1)) + BINS // 2).cast("int")

    least = F.filter(s, lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(s, F.greatest(i - 1, F.lit(0))))))
    df = df.withColumn("__m", F.when(F.size(w) > 0, least).otherwise(F.slice(s, 1, 0)))
    m = F.col("__m")
    empty = F.lit(None).cast("long")

    def gap(x: Column, i: Column) -> Column:
        return bin_of(x) - F.when(i > 0, bin_of(F.get(m, F.greatest(i - 1, F.lit(0))))).otherwise(F.lit(-1)) - 1

    placed = F.flatten(F.transform(m, lambda x, i: F.concat(F.array_repeat(empty, gap(x, i)), F.array(x))))
    df = df.withColumn("__a", placed)
    found = F.col("__a")
    factors, shifts = F.array(*map(F.lit, _FACTORS)), F.array(*map(F.lit, _SHIFTS))
    inverses = F.array(*[F.lit(pow(x, -1, _PRIME)) for x in _FACTORS])

    def digit(b: Column) -> Column:
        probes = [F.pmod((F.lit(k) - F.get(shifts, b)) * F.get(inverses, b), F.lit(_PRIME)) - 1 for k in range(_PROBES)]
        ranked = F.transform(m, lambda x: F.struct(F.pmod(F.get(factors, b) * (bin_of(x) + 1) + F.get(shifts, b), F.lit(_PRIME)).alias("rank"), x.alias("x")))
        value = F.coalesce(F.get(found, b), *[F.get(found, p) for p in probes], F.when(F.size(m) > 0, F.array_min(ranked)["x"]))
        return F.lower(F.hex(F.xxhash64(value, b).bitwiseAND(F.lit(2**BITS - 1))))

    digits = F.concat_ws("", F.transform(F.array(*map(F.lit, range(BINS))), digit))
    return df.select(*columns, F.when(F.size(m) > 0, digits).otherwise(F.lit(EMPTY)).alias(name))


def likeness(a: Column, b: Column) -> Column:
    """Estimated similarity of the sets behind two fingerprints, chance agreements taken off."""
    same = F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
    chance = 1 / 2**BITS
    estimate = (same / F.lit(float(BINS)) - chance) / (1 - chance)
    return (
        F.when(a == b, F.lit(1.0)).when((a == EMPTY) | (b == EMPTY), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), estimate)))
    )


def cut_points(docs: DataFrame) -> list[int]:
    """Ids, rising, between which there are about STRETCH rows, however the ids are spread."""
    parts = docs.agg(F.count("doc_id")).first()[0] // STRETCH
    if parts < 2:
        return []
    shares = [k / parts for k in range(1, parts)]
    # Ranks are right to a quarter of a stretch.
    return sorted(set(docs.agg(F.percentile_approx("doc_id", shares, max(10_000, 4 * parts))).first()[0]))


def stretch_of(doc_id: Column, cuts: list[int]) -> Column:
    """How many of the cuts are at or below an id; null for null. Looks at a row of the cuts, then in it."""
    if not cuts:
        return F.when(doc_id.isNotNull(), F.lit(0).cast("long"))
    width = math.isqrt(len(cuts) - 1) + 1
    rows = [cuts[at : at + width] for at in range(0, len(cuts), width)]

    def below(array: Column) -> Column:
        return F.size(F.filter(array, lambda c: c <= doc_id))

    def longs(values: list[int]) -> Column:
        return F.array(*[F.lit(v).cast("long") for v in values])

    row = below(longs([x[0] for x in rows])) - 1
    within = below(F.get(F.array(*map(longs, rows)), F.greatest(row, F.lit(0))))
    return F.when(doc_id.isNotNull(), (F.greatest(row, F.lit(0)) * width + within).cast("long"))


def with_next(docs: DataFrame) -> tuple[DataFrame, Window]:
    """doc_id, text, stretch, guest and next_text, with rows in order of their ids inside a stretch.

    Ids are cut into stretches of about as many rows each. The first row of a stretch is also the last, a guest,
    of the stretch before, so that each window is all that a stretch needs; the last stretch has
    the first row of all as its guest.
    """
    docs = docs.withColumn("stretch", stretch_of(F.col("doc_id"), cut_points(docs)))
    firsts = docs.groupBy("stretch").agg(F.min("doc_id").alias("first")).where("stretch is not null")
    every = Window.orderBy("stretch")
    firsts = firsts.select(
        "first", F.coalesce(F.lag("stretch").over(every), F.max("stretch").over(Window.partitionBy())).alias("host"),
        F.lag("stretch").over(every).isNull().alias("around"),
    )
    rows = docs.join(firsts, docs.doc_id == firsts["first"], "left")
    # A row without an id is a guest of no stretch and has none after it.
    seats = F.when(F.col("host").isNull(), F.array(F.struct(F.lit(0).alias("guest"), F.col("stretch").alias("stretch")))).otherwise(
        F.array(
            F.struct(F.lit(0).alias("guest"), F.col("stretch").alias("stretch")),
            F.struct(F.lit(1).alias("guest"), F.col("host").alias("stretch")),
        )
    )
    rows = rows.select("doc_id", "text", F.explode(seats).alias("seat")).select("doc_id", "text", "seat.guest", "seat.stretch")
    alone = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("text"), F.lit(4096)))
    rows = rows.withColumn("nameless", alone)
    group = Window.partitionBy("stretch", "nameless")
    order = group.orderBy("guest", "doc_id", "text")
    following = F.when(F.col("doc_id").isNotNull(), F.lead("text").over(order))
    rows = rows.withColumn("next_text", F.coalesce(following, F.lit(""))).withColumn("place", F.row_number().over(order))
    return rows, group.orderBy("place")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document: its fingerprint, that of its edited text, and their likenesses.

    The edited text has the last quarter of the characters replaced by the first as many of the
    next document by id.
    """
    own = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows, order = with_next(own)
    size = F.length("text")
    quarter = F.floor(size / 4).cast("int")
    rows = rows.withColumn("n_chars", size.cast("long")).withColumn(
        "edited", F.concat(F.left(F.col("text"), size - quarter), F.left(F.col("next_text"), quarter))
    )
    rows = with_fingerprint(rows, "text", "fingerprint").drop("text", "next_text")
    rows = with_fingerprint(rows, "edited", "edited_fingerprint").withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256)).drop("edited")
    after = F.when(F.col("doc_id").isNotNull(), F.lead("fingerprint").over(order))
    rows = rows.withColumn("after", F.coalesce(after, F.lit(EMPTY))).where("guest = 0")
    fingerprint = F.col("fingerprint")
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(fingerprint, F.col("edited_fingerprint")).alias("near_edited"), likeness(fingerprint, F.col("after")).alias("near_next"),
    )


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return fingerprints(read_table(spark, sf_dir, "documents"))
