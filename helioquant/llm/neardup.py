"""Near-duplicate documents by banded MinHash, odd sketches and a check of the full shingle sets.

A document's set holds the hashes of its five-word shingles. Bands of ``ROWS`` MinHash values
propose pairs: two sets of similarity t meet in some of n bands with probability
1 - (1 - t**ROWS)**n, and a threshold t gets as many bands as leave a miss of ``MISS`` at most, 24
for 0.85 (the query) and 36 for 0.8 (the pipeline). The samples are also folded into an odd sketch,
a bitmap in which sample i with value v flips one bit: the XOR of two sketches counts the samples
that differ, so that high similarities are read precisely from a population count. Pairs whose
sketches leave a similarity within a slack of the threshold are confirmed on their full sets.

Pairs inside a band's bucket are never all formed. Equal sets are one class with its smallest id.
A first round compares each class of a bucket with the bucket's smallest class only. After linking
these, a second round compares the members of a bucket with the one that has the fewest shingles of
its own. The members of buckets that still hold more than one component then meet over a prefix
index (``prefix_pairs``): each orders its shingles from rare to common among them, and of two
sets that reach the threshold the smaller has a common one among so few of its first shingles that
sets just below the threshold, whose first shingles are their own, are not entered at all. Entries are
keyed by the sizes that their position leaves possible as well, and meet only entries of other
components than the key's commonest. Those are all the pairs that could still join components, so
that nothing is lost and no cap is needed.

Defined cases: texts without a word have an empty set and stay alone; rows that share a doc_id are
one node with all their links, and each row is returned; a row without an id is returned with a null
component and is kept; no rows give no rows; other columns play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helioquant.llm.common import bytes_of, cut_lineage, drop_kept, map_arrow, mix64, read_table, shingle_set

ROWS = 5
SKETCH_WORDS = 16
#: Chance that a pair at the threshold meets in no band, at most.
MISS = 8e-7
#: Contract of the query: similarity of 0.85 at least.
THRESHOLD = (85, 100)
#: The pipeline's stage has no contract of its own: 0.8 at least.
STAGE_THRESHOLD = (80, 100)


def bands_for(threshold: tuple[int, int]) -> int:
    """Bands that miss a pair at the threshold with a chance of MISS at most."""
    kept, whole = threshold
    return 1 if kept >= whole else math.ceil(math.log(MISS) / math.log(1 - (kept / whole) ** ROWS))


def slack_for(threshold: tuple[int, int]) -> float:
    """A pair goes to the full check unless its estimate is lower than the threshold by more than this.

    Six standard errors: of the share of samples that differ, and of differing samples whose bits
    meet in a sketch.
    """
    similarity = threshold[0] / threshold[1]
    error = similarity * (1 - similarity) / (bands_for(threshold) * ROWS) + 2 * (1 - similarity) ** 2 / (SKETCH_WORDS * 64)
    return math.ceil(600 * math.sqrt(error)) / 100


BANDS = bands_for(THRESHOLD)


def _seeds(samples: int) -> np.ndarray:
    """Factors of the permutations; fewer are the first of more."""
    return np.random.default_rng(11).integers(0, 1 << 64, samples, dtype=np.uint64) | np.uint64(1)


def _salts(samples: int) -> np.ndarray:
    return mix64(np.arange(1, samples + 1, dtype=np.uint64))


_SEEDS, _SALTS = _seeds(BANDS * ROWS), _salts(BANDS * ROWS)


def minhash(shingles: np.ndarray, seeds: np.ndarray = _SEEDS) -> np.ndarray:
    """The smallest of each permutation; the set must not be empty."""
    out = np.full(len(seeds), np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(shingles), 2048):
            np.minimum(out, (shingles[at : at + 2048, None] * seeds).min(axis=0), out=out)
    return out


def odd_sketch(samples: np.ndarray, salts: np.ndarray = _SALTS) -> np.ndarray:
    """Parity bitmap of the samples, as SKETCH_WORDS words."""
    bits = mix64(samples ^ salts) % np.uint64(SKETCH_WORDS * 64)
    odd = np.flatnonzero(np.bincount(bits.astype(np.int64), minlength=SKETCH_WORDS * 64) & 1)
    words = np.zeros(SKETCH_WORDS, np.uint64)
    np.bitwise_or.at(words, odd >> 6, np.uint64(1) << (odd & 63).astype(np.uint64))
    return words


def band_keys(samples: np.ndarray) -> np.ndarray:
    rows = samples.reshape(-1, ROWS)
    keys = np.arange(1, len(rows) + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for column in rows.T:
            keys = mix64(keys * np.uint64(0x9E3779B97F4A7C15) + column)
    return keys


def signatures(docs: DataFrame, key: str = "doc_id", text: str = "text", bands: int = BANDS) -> DataFrame:
    """doc_id, n_shingles, digest (two words of the whole set), bands, sketch."""
    seeds, salts = _seeds(bands * ROWS), _salts(bands * ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept()
        for batch in batches:
            n, first, second, keys, sketches = [], [], [], [], []
            for value in batch.column(1):
                s = shingle_set(value.as_py())
                n.append(len(s))
                with np.errstate(over="ignore"):
                    first.append(int(s.sum(dtype=np.uint64).view(np.int64)))
                    second.append(int(mix64(s ^ _SALTS[0]).sum(dtype=np.uint64).view(np.int64)))
                samples = minhash(s, seeds) if len(s) else None
                keys.append(band_keys(samples).view(np.int64) if len(s) else np.zeros(0, np.int64))
                sketches.append(odd_sketch(samples, salts).view(np.int64) if len(s) else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64()),
                 pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "digest1", "digest2", "bands", "sketch"],
            )

    schema = "doc_id long, n_shingles long, digest1 long, digest2 long, bands array<long>, sketch array<long>"
    return map_arrow(docs.select(key, bytes_of(text)), run, schema)


def full_sets(docs: DataFrame, ids: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the sorted shingle hashes, packed, of the documents in ids (a column id)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(x.as_py()).astype("<u8").tobytes() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(sets, pa.binary())], ["id", "members"])

    own = docs.select(F.col(key).alias("id"), bytes_of(text).alias("bytes"))
    return map_arrow(own.join(ids, "id", "left_semi"), run, "id long, members binary").distinct()


def sketch_similarity(a: str, b: str, samples: int = BANDS * ROWS):
    """Similarity read from the XOR of two sketches; 0 where the XOR is saturated."""
    size = float(SKETCH_WORDS * 64)
    ones = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    odd = F.when(ones < size / 2, F.log(1 - 2 * ones / size)).otherwise(F.lit(-1e9))
    return F.greatest(F.lit(0.0), 1 + odd * size / 4 / samples)


def confirmed(pairs: DataFrame, sketches: DataFrame, sets: DataFrame, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold; sketches and sets by id."""
    kept, whole = threshold
    samples, least = bands_for(threshold) * ROWS, kept / whole - slack_for(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                x, y = (np.frombuffer(v.as_buffer(), "<u8") for v in (x, y))
                small, large = (x, y) if len(x) < len(y) else (y, x)
                if whole * len(small) >= kept * len(large):
                    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                    both = int((large[at] == small).sum())
                    good[i] = whole * both >= kept * (len(x) + len(y) - both)
            yield batch.select([0, 1]).filter(pa.array(good))

    near = (
        pairs.join(sketches.select(F.col("id").alias("a"), F.col("sketch").alias("sa")), "a")
        .join(sketches.select(F.col("id").alias("b"), F.col("sketch").alias("sb")), "b")
        .where(sketch_similarity("sa", "sb", samples) >= least)
        .select("a", "b")
    )
    near = (
        near.join(sets.select(F.col("id").alias("b"), F.col("members").alias("mb")), "b")
        .join(sets.select(F.col("id").alias("a"), F.col("members").alias("ma")), "a")
        .select("a", "b", "ma", "mb")
    )
    return map_arrow(near, run, "a long, b long").distinct()


def own_shingles(sets: DataFrame, ids: DataFrame) -> DataFrame:
    """id and alone, how many of its shingles no other document of ids has (at least 1 of them)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, value in zip(batch.column(0), batch.column(1)):
                tokens = np.frombuffer(value.as_buffer(), "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(tokens), i.as_py())), pa.array(tokens)], ["id", "shingle"])

    tokens = map_arrow(sets.join(ids, "id", "left_semi").select("id", "members"), run, "id long, shingle long")
    by_one = tokens.groupBy("shingle").agg(F.min("id").alias("id"), F.max("id").alias("last")).where("id = last")
    return by_one.groupBy("id").agg(F.count("*").alias("alone"))


def _size_class(n):
    """Classes of sizes that grow by a fiftieth."""
    return F.floor(F.log(n) / math.log(1.02)).cast("int")


def prefix_pairs(members: DataFrame, sets: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """(a, b), a > b: pairs of different components (members: id, component) that could reach the threshold.

    Sets a and b of sizes m <= n reach it only with k = ceil(t (m + n) / (1 + t)) common shingles. In any one
    order of all shingles the first common one stands at m - k + 1 in a and n - k + 1 in b at the
    latest, so at m - ceil(2 t m / (1 + t)) + 1 in a, as n >= m. The order is from rare to common, and
    shingles of one member alone come first without an entry.
    """
    kept, whole = threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, which, value in zip(*batch.columns):
                tokens = np.frombuffer(value.as_buffer(), "<i8")
                fixed = [np.full(len(tokens), x) for x in (i.as_py(), which.as_py(), len(tokens))]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*fixed, tokens)], ["id", "which", "n", "shingle"])

    own = sets.join(members.select("id"), "id", "left_semi").select("id", F.xxhash64("members").alias("which"), "members")
    tokens = map_arrow(own, run, "id long, which long, n long, shingle long")
    common = tokens.groupBy("shingle").agg(F.count(F.lit(1)).alias("sets"), F.min("id").alias("x"), F.max("id").alias("y"))
    common = common.where("x < y").select("shingle", "sets")
    from_rare = Window.partitionBy("id", "which").orderBy("sets", "shingle")
    size = F.count(F.lit(1)).over(Window.partitionBy("id", "which"))
    # Shingles that no other member has stand before all others.
    at = F.col("n") - size + F.row_number().over(from_rare)
    last = F.expr(f"n - (n * {kept} + {whole - 1}) div {whole} + 1")
    entries = tokens.join(common, "shingle").withColumn("at", at).where(F.col("at") <= last).join(members, "id")
    entries = cut_lineage(entries.select("shingle", "id", "n", "at", "component"))

    small = entries.where(F.expr(f"at <= n - (2 * n * {kept} + {whole + kept - 1}) div {whole + kept} + 1"))
    small = small.withColumn("class", _size_class(F.col("n")))
    least = F.expr(f"(n * {kept} + {whole - 1}) div {whole}")
    most = F.least("n", F.expr(f"({whole + kept} * (n - at + 1)) div {kept} - n"))
    large = entries.where(most >= least).withColumn("class", F.explode(F.sequence(_size_class(least), _size_class(most))))
    keyed = small.select("shingle", "class", "component").union(large.select("shingle", "class", "component"))
    sizes = keyed.groupBy("shingle", "class", "component").count()
    commonest = sizes.groupBy("shingle", "class").agg(
        F.max_by("component", F.struct("count", "component")).alias("commonest"), F.count(F.lit(1)).alias("components")
    )
    commonest = commonest.where("components > 1").drop("components")

    def side(frame: DataFrame, to: str, outside: bool) -> DataFrame:
        rows = frame.join(commonest, ["shingle", "class"])
        rows = rows.where("component != commonest") if outside else rows
        return rows.select("shingle", "class", *[F.col(c).alias(f"{c}{to}") for c in ("id", "n", "at", "component")], (F.col("component") == F.col("commonest")).alias(f"most{to}"))

    reach = F.expr("1 + least(n1 - at1, n2 - at2)") * (whole + kept) >= (F.col("n1") + F.col("n2")) * kept
    good = (F.col("n1") <= F.col("n2")) & (F.col("component1") != F.col("component2")) & reach
    key = ["shingle", "class"]
    met = side(small, "1", True).join(side(large, "2", False), key).where(good)
    met = met.union(side(small, "1", False).where("most1").join(side(large, "2", True), key).where(good))
    return met.select(F.greatest("id1", "id2").alias("a"), F.least("id1", "id2").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """id and component, the smallest id that can be reached, of every id in links (a, b).

    Large-star and small-star steps in turn, each over edges only, until the edges stay the same.
    """
    edges = links.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("u < v").distinct()

    def star(edges: DataFrame, large: bool) -> DataFrame:
        # u gets as neighbours all (large) or the smaller ones (small); all but the least of them,
        # and u itself where small, are tied to the least.
        both = edges.select(F.col("v").alias("at"), F.col("u").alias("to"))
        if large:
            both = both.union(edges.select(F.col("u").alias("at"), F.col("v").alias("to")))
        least = both.groupBy("at").agg(F.min("to").alias("least")).select("at", F.least("at", "least").alias("least"))
        tied = both.join(least, "at")
        if large:
            tied = tied.where(F.col("to") > F.col("at")).select(F.col("to").alias("v"), F.col("least").alias("u"))
        else:
            tied = tied.select(F.col("to").alias("v"), F.col("least").alias("u")).union(
                least.select(F.col("at").alias("v"), F.col("least").alias("u"))
            )
        return tied.where("u < v").distinct()

    def mark(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    edges = cut_lineage(edges)
    before, now = None, mark(edges)
    while before != now:
        edges = cut_lineage(star(star(edges, True), False))
        before, now = now, mark(edges)
    return edges.select(F.col("v").alias("id"), F.col("u").alias("component"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of docs.

    threshold: the similarity that links two documents, as a fraction of two whole numbers.
    """
    rows = cut_lineage(signatures(docs, key, text, bands_for(threshold)))
    alike = ["n_shingles", "digest1", "digest2"]
    full = rows.where(F.col("n_shingles").cast("boolean") & F.col("doc_id").isNotNull())
    classes = full.groupBy(*alike).agg(F.min("doc_id").alias("first"))
    # A set for each class: of the rows of its smallest id, which may have other texts as well.
    owners = full.join(classes, alike).where(F.col("doc_id") == F.col("first"))
    entries = owners.select(F.col("doc_id").alias("id"), F.explode("bands").alias("bucket")).distinct()
    sketches = owners.select(F.col("doc_id").alias("id"), "sketch").distinct()
    # Of all texts of an id, those in the class of another id included: sets has them too.
    each = F.struct(*alike)
    whole_sizes = full.groupBy(F.col("doc_id").alias("id")).agg(
        F.min("n_shingles").alias("least"), F.max("n_shingles").alias("n"), (F.min(each) != F.max(each)).alias("several")
    )
    leaders = entries.groupBy("bucket").agg(F.min("id").alias("leader"), F.max("id").alias("last")).where("leader < last")
    shared = cut_lineage(entries.join(leaders.select("bucket", "leader"), "bucket"))

    first = shared.where("id > leader").select(F.col("id").alias("a"), F.col("leader").alias("b")).distinct()
    sets = cut_lineage(full_sets(docs, shared.select("id").distinct(), key, text))
    same = full.join(classes, alike).where("doc_id > first").select(F.col("doc_id").alias("a"), F.col("first").alias("b"))
    links = cut_lineage(confirmed(first, sketches, sets, threshold).union(same))
    found = components(links)

    placed = shared.join(found, "id", "left").select("bucket", "leader", "id", F.coalesce("component", "id").alias("component"))
    def unsettled(placed: DataFrame) -> DataFrame:
        mixed = placed.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y")
        return placed.join(mixed.select("bucket"), "bucket")

    kept, whole = threshold
    placed = cut_lineage(unsettled(placed))
    ids = placed.select("id").distinct()
    # An id with several different texts has no bound: no count tells which text has which shingles.
    bounds = ids.join(whole_sizes, "id").join(own_shingles(sets, ids), "id", "left").select(
        "id", "least", "several", F.when(F.col("several"), F.col("n")).otherwise(F.col("n") - F.coalesce("alone", F.lit(0))).alias("shared")
    )
    placed = placed.join(bounds.where(F.col("shared") * whole >= F.col("least") * kept), "id")
    placed = cut_lineage(unsettled(placed))

    # The member of a bucket with the fewest shingles of its own is the likeliest to be near the others.
    rank = F.struct(F.col("shared") / F.col("least"), -F.col("id"))
    hubs = placed.groupBy("bucket").agg(F.max_by(F.struct(F.col("id").alias("hub"), F.col("component").alias("its")), rank).alias("h"))
    star = placed.join(hubs.select("bucket", "h.*"), "bucket").where("component != its and id != leader and hub != leader")
    star = star.select(F.greatest("id", "hub").alias("a"), F.least("id", "hub").alias("b")).distinct()
    so_far = found.select(F.col("id").alias("a"), F.col("component").alias("b"))
    found = components(cut_lineage(confirmed(star.join(first, ["a", "b"], "left_anti"), sketches, sets, threshold).union(so_far)))
    placed = placed.drop("component").join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    placed = cut_lineage(unsettled(placed))
    second = prefix_pairs(placed.select("id", "component").distinct(), sets, threshold)
    more = confirmed(second.join(first, ["a", "b"], "left_anti"), sketches, sets, threshold)
    joined = cut_lineage(
        more.union(found.select(F.col("id").alias("a"), F.col("component").alias("b")))
    )
    final = components(joined)
    return (
        rows.select("doc_id", "n_shingles")
        .join(final, rows.doc_id == final.id, "left")
        .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its near-duplicate component."""
    return near_duplicates(read_table(spark, sf_dir, "documents"), threshold=THRESHOLD)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each component stays, the one with the smallest id."""
    gone = near_duplicates(docs, threshold=STAGE_THRESHOLD).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
