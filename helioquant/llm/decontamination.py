"""Benchmark passages in documents by a prefix-filtered join of shingles.

An item's text is cut into windows of ``window`` consecutive words, an item of fewer words is one
window. A window is the set of its word shingles (five words, or the whole window if that is
shorter). Containment has to be exact, so of a window's shingles in the order of rarity a prefix of
one is necessary: the shingle that the fewest places of all documents hold. Documents meet windows
on that token alone; the position of the token in the window and the length of the stretch around it
bound what can match, and the words of the item-sized stretch are then compared one by one.

Documents are read once. A bitmap of a fixed size (``BITMAP_BITS``) of the hashes of all item shingles
tells which words of a document can be part of a window: runs of positions whose shingles are all
marked. Only the words of these runs leave the scan. A wrongly marked shingle costs time, never a
result, and every occurrence of a window lies within one run.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z is lower-cased. Defined cases: null, empty
and wordless texts have no words and no hits, and such items no windows; equal windows of several
items are one window of all of them; rows of a repeated doc_id, or without one, are judged and returned
each; rows of one item_id are one item; items without an id hit words but are not listed; no items hit
nothing; very long texts are hashed in stretches and kept as 24 bytes a word within their task; other
columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helioquant.llm.common import bytes_of, cut_lineage, map_arrow, mix64, prefix_sums, read_table, span_hashes

WINDOW = 10
SHINGLE = 5
#: Size of the bitmap that the driver gathers and the tasks read, in bits: 2 MB for any benchmark.
BITMAP_BITS = 1 << 24
_STRETCH = 1 << 20
_FACTORS = mix64(np.arange(101, 101 + SHINGLE, dtype=np.uint64)) | np.uint64(1)
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def word_spans(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of each word of lower-cased bytes, a stretch at a time."""
    starts, ends, hashes = [], [], []
    at = 0
    while at < len(data):
        until = min(at + _STRETCH, len(data))
        while until < len(data) and _IN_WORD[data[until]]:
            until += 1
        part = np.frombuffer(data, np.uint8, until - at, at)
        edges = np.flatnonzero(np.diff(np.concatenate([[False], _IN_WORD[part], [False]]).view(np.int8)))
        hashes.append(span_hashes(prefix_sums(part), edges[::2], edges[1::2]))
        starts.append(edges[::2] + at)
        ends.append(edges[1::2] + at)
        at = until
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(starts), np.concatenate(ends), np.concatenate(hashes)


def shingle_bits(hashes: np.ndarray, size: int, bits: int = BITMAP_BITS) -> np.ndarray:
    """Place in the bitmap of each run of ``size`` words."""
    n = max(len(hashes) - size + 1, 0)
    total = np.full(n, size, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            total += hashes[k : n + k] * _FACTORS[k]
        return (mix64(total) % np.uint64(bits)).astype(np.int64)


def item_windows(benchmark: DataFrame, item: str, text: str, window: int, shingle: int) -> tuple[DataFrame, DataFrame]:
    """(windows, bits): item, words and shingle size of each distinct window; marked places."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, sizes, bits = [], [], []
            for value in batch.column(1):
                data = value.as_py().translate(_LOWER)
                starts, ends, hashes = word_spans(data)
                size = min(shingle, len(starts))
                words.append([data[a:b].decode() for a, b in zip(starts, ends)])
                sizes.append(size)
                bits.append(np.unique(shingle_bits(hashes, size)) if size else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(words, pa.list_(pa.string())), pa.array(sizes, pa.int32()), pa.array(bits, pa.list_(pa.int64()))],
                ["item", "words", "size", "bits"],
            )

    schema = T.StructType([
        T.StructField("item", benchmark.schema[item].dataType), T.StructField("words", T.ArrayType(T.StringType())),
        T.StructField("size", T.IntegerType()), T.StructField("bits", T.ArrayType(T.LongType())),
    ])
    items = map_arrow(benchmark.select(item, bytes_of(text)), run, schema).where("size > 0")
    length = F.least(F.size("words"), F.lit(window))
    cuts = F.transform(F.sequence(F.lit(0), F.size("words") - length), lambda i: F.slice("words", i + 1, length))
    windows = items.select("item", "size", F.explode(cuts).alias("window")).distinct()
    return cut_lineage(windows), items.select(F.explode("bits").alias("bit"))


def bitmap_of(bits: DataFrame) -> bytes:
    """The marked places as a bitmap; the driver gets one row a used 64-bit word of it."""
    words = bits.groupBy(F.shiftright("bit", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, int(bit & 63))")).alias("word"))
    out = np.zeros(BITMAP_BITS // 64, np.int64)
    for row in words.collect():
        out[row.at] = row.word
    return out.tobytes()


def marked(hashes: np.ndarray, owner: np.ndarray, bitmap: np.ndarray, least: dict[int, int]) -> np.ndarray:
    """Which words can be part of a window: least has, by shingle size, how many marked ones follow each other."""
    cover = np.zeros(len(hashes) + 1, np.int32)
    for size, run in least.items():
        bits = shingle_bits(hashes, size)
        hit = ((bitmap[bits >> 3] >> (bits & 7).astype(np.uint8)) & 1).astype(bool)
        at = np.flatnonzero(hit)
        at = at[owner[at] == owner[at + size - 1]]
        if run > 1 and len(at):
            first = np.flatnonzero(np.concatenate([[True], (np.diff(at) > 1) | (np.diff(owner[at]) != 0)]))
            lengths = np.diff(np.append(first, len(at)))
            at = at[np.repeat(lengths >= run, lengths)]
        np.add.at(cover, at, 1)
        np.add.at(cover, at + size, -1)
    return np.cumsum(cover[:-1]) > 0


def marked_runs(docs: DataFrame, key: str, text: str, bitmap: bytes, least: dict[int, int]) -> DataFrame:
    """key, n_words and runs (start, words) of every row: the stretches that windows may lie in."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            texts = batch.column(1)
            sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
            counts = np.zeros(len(texts), np.int64)
            row_of, starts_of, words_of = [], [], []
            at = 0
            while at < len(texts):
                until, load = at + 1, int(sizes[at])
                while until < len(texts) and load + sizes[until] < _STRETCH:
                    load += int(sizes[until])
                    until += 1
                values = [v.as_py() for v in texts[at:until]]
                data = b"\n".join(values).translate(_LOWER)
                begins = np.cumsum([0] + [len(v) + 1 for v in values])
                starts, ends, hashes = word_spans(data)
                owner = np.searchsorted(begins, starts, "right") - 1
                counts[at:until] = np.bincount(owner, minlength=until - at)
                first = np.searchsorted(owner, np.arange(until - at))
                inside = marked(hashes, owner, table, least)
                edges = np.flatnonzero(np.diff(np.concatenate([[-1], np.where(inside, owner, -1), [-1]])))
                for a, b in zip(edges[:-1], edges[1:]):
                    if inside[a]:
                        row_of.append(at + int(owner[a]))
                        starts_of.append(int(a - first[owner[a]]))
                        words_of.append([data[i:j].decode() for i, j in zip(starts[a:b], ends[a:b])])
                at = until
            offsets = np.searchsorted(np.array(row_of, np.int64), np.arange(len(texts) + 1))
            runs = pa.StructArray.from_arrays(
                [pa.array(starts_of, pa.int64()), pa.array(words_of, pa.list_(pa.string()))], names=["start", "words"]
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), runs)], [key, "n_words", "runs"]
            )

    run_type = T.StructType([T.StructField("start", T.LongType()), T.StructField("words", T.ArrayType(T.StringType()))])
    schema = T.StructType(
        [T.StructField(key, docs.schema[key].dataType), T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(run_type))]
    )
    return map_arrow(docs.select(key, bytes_of(text)), run, schema)


def _token(words: str, at: Column, size: Column | int) -> Column:
    return F.array_join(F.slice(words, at + 1, size), " ")


def contaminated_spans(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
    window: int = WINDOW, shingle: int = SHINGLE,
) -> DataFrame:
    """key, n_words, spans (start, end in words, merged) and items (ids as sorted text) for every row of docs."""
    shingle = min(shingle, window, SHINGLE)
    windows, bits = item_windows(benchmark, item, item_text, window, shingle)
    # A window of w words has w - shingle + 1 shingles in a row; at most five sizes.
    least = {r[0]: int(r[1]) - r[0] + 1 for r in windows.groupBy("size").agg(F.min(F.size("window"))).collect()}
    scanned = marked_runs(docs, key, text, bitmap_of(bits), least)
    scanned = cut_lineage(scanned.withColumn("row", F.monotonically_increasing_id()))

    runs = scanned.select("row", F.explode("runs").alias("r")).select("row", "r.start", "r.words")
    sizes = sorted(least)
    places = F.flatten(F.array(*[
        F.when(F.size("words") >= s, F.transform(F.sequence(F.lit(0), F.size("words") - s), lambda i: F.struct(i.alias("i"), F.lit(s).alias("s"))))
        .otherwise(F.array().cast("array<struct<i:int,s:int>>")) for s in sizes
    ])) if sizes else F.array().cast("array<struct<i:int,s:int>>")
    before = F.least(F.col("i"), F.lit(window) - F.col("s"))
    tokens = runs.select("row", "start", "words", F.explode(places).alias("p")).select("row", "start", "words", "p.i", "p.s").select(
        "row", (F.col("start") + F.col("i")).alias("at"), _token("words", F.col("i"), F.col("s")).alias("token"),
        before.alias("before"), F.slice("words", F.col("i") - before + 1, before + window).alias("around"),
    )

    # The rarest token of each window over all documents; a window with a token that no document has cannot occur.
    distinct = windows.select("window", "size").distinct()
    parts = F.transform(
        F.sequence(F.lit(0), F.size("window") - F.col("size")), lambda k: F.struct(_token("window", k, F.col("size")).alias("token"), k.alias("offset"))
    )
    own = distinct.select("window", F.explode(parts).alias("p")).select("window", "p.token", "p.offset")
    seen = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("places"))
    rarest = (
        own.join(seen, "token", "left")
        .groupBy("window")
        .agg(F.min(F.struct(F.coalesce("places", F.lit(0)).alias("places"), "offset", "token")).alias("best"))
        .where("best.places > 0")
        .select("window", "best.token", "best.offset")
    )
    length = F.size("window")
    fits = (F.col("offset") <= F.col("before")) & (F.col("before") - F.col("offset") + length <= F.size("around"))
    same = F.slice("around", F.col("before") - F.col("offset") + 1, length) == F.col("window")
    found = cut_lineage(
        tokens.join(rarest, "token").where(fits & same)
        .select("row", (F.col("at") - F.col("offset")).alias("start"), (F.col("at") - F.col("offset") + length).alias("end"), "window")
    )

    order = Window.partitionBy("row").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = found.select("row", "start", "end").distinct().withColumn("new", F.coalesce((F.col("start") > reach).cast("int"), F.lit(0)))
    islands = islands.withColumn("island", F.sum("new").over(order)).groupBy("row", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    spans = islands.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    ids = windows.where(F.col("item").isNotNull()).select("window", F.col("item").cast("string").alias("item"))
    items = found.select("row", "window").distinct().join(ids, "window").groupBy("row").agg(F.sort_array(F.collect_set("item")).alias("items"))
    hits = spans.join(items, "row", "left")
    return scanned.select("row", key, "n_words").join(hits, "row", "left").select(
        key, "n_words", F.coalesce("spans", F.array().cast("array<struct<start:bigint,end:bigint>>")).alias("spans"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def op13_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the words that benchmark windows hit, and the items."""
    found = contaminated_spans(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


_WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS_SQL} AS w FROM documents),
b AS (SELECT item_id, {_WORDS_SQL} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS n,
         unnest(list_transform(range(1, len(w) - least(len(w), {WINDOW}) + 2), lambda i: list_slice(w, i, i + least(len(w), {WINDOW}) - 1))) AS win
  FROM b WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT r, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM d JOIN sizes ON len(w) >= n),
found AS (
  SELECT r, i, p.n, item_id FROM (SELECT r, i, n, list_slice(w, i, i + n - 1) AS win FROM places) p JOIN windows USING (n, win)),
hit AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM found) GROUP BY r),
items AS (
  SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM found WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r)"""
