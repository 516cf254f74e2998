"""Spelling variants: words one edit apart, found by a frontier of states over a trie kept as a table.

A trie's edges are rows (parent prefix, next letter) with what lies below: how many words, the set of
lengths still to come and the set of next letters, each as a bitmap, and the count of the word that
ends there. A state is (word, position, node, edited): so far the word's letters up to the position
lead to the node, with one edit or none. Level by level, the states at nodes of one depth are joined
with the edges that leave them. An edge with the word's letter is followed; a state without an edit
also takes other edges, as a replaced letter or as one inserted before the position. A state with an edit whose
remaining length or next letter nothing below has is dropped at once, and so is one without an edit
below whose node there is the word alone. A state with an edit at the end of its word, at a node
where a word ends, is a pair of neighbours; deletions are the same pairs seen from the longer word.

An edit in the second half of a word is found in the trie of the words, one in the first half in the
trie of the reversed words. So a state starts at the node of half of its word, far below the root, where
few edges leave a node, and no level holds all words at a few nodes.

Words of more than ``TRIE_LETTERS`` letters, whose prefixes would take the square of their length, meet on
hashes of themselves less one letter (a row a letter) and are then compared letter by letter.

Defined cases: a null or empty text has no words; a null doc_id counts as empty text in the hash of a run;
repeated rows count each time; no words give no rows; of equally frequent neighbours the first in
code-point order is the form; very long texts and words have no limit; other columns play no part.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helioquant.llm.common import POWERS, cut_lineage, map_arrow, mix64, prefix_sums, read_table, shared_folder

MIN_LETTERS = 7
MIN_COUNT = 2
#: One run in so many, by its hash, loses a letter before it is counted.
ALTERED = 31
#: A form is at least so many times as frequent as its variant.
RATIO = 10
TRIE_LETTERS = 32
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def counted_words(
    docs: DataFrame, key: str = "doc_id", text: str = "text", letters: int = MIN_LETTERS, count: int = MIN_COUNT, altered: int = ALTERED
) -> DataFrame:
    """word and n of runs of letters (to U+00FF, A-Z lower-cased) after some of them lost a letter."""
    ascii_only = F.octet_length(text) == F.length(text)
    lower = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    runs = F.regexp_extract_all(lower, F.lit(f"[a-zÀ-ÿ]{{{letters},}}"), F.lit(0))
    rows = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    rows = rows.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = rows.select(F.when(F.col("h") % altered == 0, cut).otherwise(F.col("run")).alias("word"))
    counted = words.where(F.length("word") >= letters).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= count)


def _bit(position) -> F.Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), position.cast("int"))


def _letter(word: str, at) -> F.Column:
    """The letter at a position from 0; empty beyond the end."""
    return F.substring(word, at + 1, F.lit(1))


def _letter_bit(letter) -> F.Column:
    return _bit(F.ascii(letter).bitwiseAND(F.lit(63)))


def oriented(words: DataFrame) -> DataFrame:
    """side (0 as it is, 1 reversed), word, n, size of the words that go through the trie."""
    short = words.where(F.length("word") <= TRIE_LETTERS)
    both = F.array(F.struct(F.lit(0).alias("side"), F.col("word").alias("word")), F.struct(F.lit(1).alias("side"), F.reverse("word").alias("word")))
    return short.select("n", F.length("word").alias("size"), F.explode(both).alias("o")).select("o.side", "o.word", "n", "size")


def trie_edges(words: DataFrame) -> DataFrame:
    """side, depth and node of the parent, letter, and of what is below: words, sizes, letters, n (of a word that ends there).

    words: oriented. A word is entered from half of its length on, where the states of words that can
    be its neighbours start.
    """
    # A neighbour with at most one letter less starts at half of its own length or later.
    first = F.greatest(F.floor((F.col("size") - 1) / 2), F.lit(0)).cast("int")
    rows = words.select("side", "word", "n", "size", F.explode(F.sequence(first + 1, F.col("size"))).alias("depth"))
    rest = F.col("size") - F.col("depth")
    below = rows.groupBy("side", "depth", F.substring("word", F.lit(1), F.col("depth")).alias("child")).agg(
        F.count(F.lit(1)).alias("words"),
        F.bit_or(_bit(rest)).alias("sizes"),
        F.bit_or(F.when(rest > 0, _letter_bit(_letter("word", F.col("depth")))).otherwise(F.lit(0))).alias("letters"),
        F.max(F.when(rest == 0, F.col("n"))).alias("n_end"),
    )
    return below.select(
        "side", (F.col("depth") - 1).alias("depth"), F.substring("child", F.lit(1), F.col("depth") - 1).alias("node"),
        _letter("child", F.col("depth") - 1).alias("letter"), "words", "sizes", "letters", "n_end",
    )


def first_states(words: DataFrame) -> DataFrame:
    """side, word, n, at, node, edited: each oriented word at the node of half of its letters."""
    half = F.floor(F.col("size") / 2)
    at = F.when(F.col("side") == 0, half).otherwise(F.col("size") - half).cast("int")
    return words.select("side", "word", "n", at.alias("at"), F.substring("word", F.lit(1), at).alias("node"), F.lit(False).alias("edited"))


def step(states: DataFrame, edges: DataFrame) -> DataFrame:
    """States one level deeper; n_end is the count of the word that ends at the node, or null."""
    own = states.select(
        "side", "word", "n", "at", "node", "edited", (F.length("word") - F.col("at")).alias("rest"), _letter("word", F.col("at")).alias("here"),
        _letter_bit(_letter("word", F.col("at"))).alias("bit0"), _letter_bit(_letter("word", F.col("at") + 1)).alias("bit1"),
    )
    met = own.join(edges.drop("depth"), ["side", "node"])

    def viable(rest, bit) -> F.Column:
        ends = _bit(rest).bitwiseAND(F.col("sizes")) != 0
        return (rest >= 0) & ends & ((rest == 0) | (F.col("letters").bitwiseAND(bit) != 0))

    rest, same = F.col("rest"), F.col("letter") == F.col("here")
    fresh = ~F.col("edited")
    follow = same & F.when(F.col("edited"), viable(rest - 1, F.col("bit1"))).otherwise(F.col("words") > 1)
    # A pair of words of one length is found from the one with the smaller letter.
    replace = fresh & (F.col("letter") > F.col("here")) & (rest > 0) & viable(rest - 1, F.col("bit1"))
    insert = fresh & ~same & viable(rest, F.col("bit0"))

    def move(when, at, edited) -> F.Column:
        return F.when(when, F.struct(at.alias("at"), edited.alias("edited")))

    moves = F.array(move(follow, F.col("at") + 1, F.col("edited")), move(replace, F.col("at") + 1, F.lit(True)), move(insert, F.col("at"), F.lit(True)))
    return (
        met.where(follow | replace | insert)
        .select("side", "word", "n", F.concat("node", "letter").alias("node"), "n_end", F.explode(F.array_compact(moves)).alias("m"))
        .select("side", "word", "n", "m.at", "node", "m.edited", "n_end")
    )


def trie_pairs(words: DataFrame) -> DataFrame:
    """word, n, near, near_n: each pair of neighbours of up to TRIE_LETTERS letters, in one direction."""
    spark = words.sparkSession
    place = f"{shared_folder(spark)}/trie-{uuid.uuid4().hex}"
    both = oriented(words)

    def by_depth(rows: DataFrame, name: str) -> DataFrame:
        rows.write.partitionBy("depth").parquet(f"{place}/{name}")
        return spark.read.schema(rows.schema).parquet(f"{place}/{name}")

    edges = by_depth(trie_edges(both), "edges")
    starts = by_depth(first_states(both).withColumn("depth", F.col("at")), "states")
    depths = [r[0] for r in starts.select("depth").distinct().collect()]  # at most TRIE_LETTERS
    found, carried = [], None
    for depth in range(min(depths, default=1), TRIE_LETTERS + 1):
        if carried is None and depth not in depths:
            continue
        states = starts.where(F.col("depth") == depth).drop("depth")
        if carried is not None:
            states = states.unionByName(carried)
        reached = cut_lineage(step(states, edges.where(F.col("depth") == depth)))
        ended = F.col("edited") & (F.col("at") == F.length("word"))
        found.append(reached.where(ended))
        carried = reached.where(~ended).drop("n_end")
        carried = None if carried.isEmpty() else carried
    if not found:
        return words.select("word", "n", F.col("word").alias("near"), F.col("n").alias("near_n")).limit(0)

    def back(word: str) -> F.Column:
        return F.when(F.col("side") == 0, F.col(word)).otherwise(F.reverse(word))

    ends = reduce(DataFrame.unionByName, found)
    return ends.select(back("word").alias("word"), "n", back("node").alias("near"), F.col("n_end").alias("near_n"))


def long_pairs(words: DataFrame) -> DataFrame:
    """word, n, near, near_n: pairs of neighbours of TRIE_LETTERS letters or more, in one direction."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, value in zip(batch.column(0), batch.column(1)):
                data = np.frombuffer(value.as_py().encode("latin-1"), np.uint8)
                size = len(data)
                sums = prefix_sums(data)
                _, down = POWERS.get(2)
                places = np.arange(size, dtype=np.uint64)
                with np.errstate(over="ignore"):
                    whole = mix64(sums[-1:] + np.uint64(size))
                    less = mix64(sums[:-1] + (sums[-1] - sums[1:]) * down[1] + np.uint64(size - 1))
                    masked = mix64(sums[-1] - (sums[1:] - sums[:-1]) + mix64(places + np.uint64(size)))
                less = np.unique(less)
                kinds = np.concatenate([np.zeros(1, np.int8), np.ones(len(less), np.int8), np.full(size, 2, np.int8)])
                keys = np.concatenate([whole, less, masked]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), row.as_py())), pa.array(kinds), pa.array(keys)], ["row", "kind", "hash"])

    long = cut_lineage(words.where(F.length("word") >= TRIE_LETTERS).withColumn("row", F.monotonically_increasing_id()))
    keys = cut_lineage(map_arrow(long.select("row", "word"), run, "row long, kind byte, hash long"))

    def of(kind: int, name: str) -> DataFrame:
        return keys.where(F.col("kind") == kind).select(F.col("row").alias(name), "hash")

    shorter = of(0, "a").join(of(1, "b"), "hash").select("a", "b")
    alike = of(2, "a").join(of(2, "b"), "hash").where("a < b").select("a", "b")
    pairs = shorter.union(alike).distinct()
    pairs = pairs.join(long.select(F.col("row").alias("a"), "word", "n"), "a")
    pairs = pairs.join(long.select(F.col("row").alias("b"), F.col("word").alias("near"), F.col("n").alias("near_n")), "b")
    return pairs.where(F.levenshtein("word", "near", 1) == 1).select("word", "n", "near", "near_n")


def variant_forms(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n for every row of words (distinct word, with its count n)."""
    words = cut_lineage(words.select("word", F.col("n").cast("long").alias("n")))
    once = trie_pairs(words).unionByName(long_pairs(words))
    turned = once.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    pairs = once.unionByName(turned).distinct()
    best = pairs.groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("rank"), F.col("near").alias("form"))).alias("best")
    )
    best = best.select(F.col("word").alias("_word"), "n_near", "best.form", (-F.col("best.rank")).alias("form_n"))
    is_form = F.coalesce(F.col("form_n") >= F.col("n") * ratio, F.lit(False))
    placed = cut_lineage(
        words.join(best, words.word == best._word, "left").select(
            "word", F.when(is_form, F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(is_form, F.col("form_n")).alias("form_n"),
        )
    )
    # Each round doubles how far a word has followed its forms; counts grow by the ratio at each form.
    roots = placed.where("form is not null").select("word", F.col("form").alias("root"))
    moved = True
    while moved:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = cut_lineage(roots.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        moved = not roots.where("moved").isEmpty()
        roots = roots.drop("moved")
    return placed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every counted word of the documents with its form and root."""
    return variant_forms(counted_words(read_table(spark, sf_dir, "documents")))
