"""License scans: MinHash bands over overlapping windows retrieve templates, containment confirms them.

Words are runs of letters and digits, lower-cased; shingles are five words. Templates of n words are
looked for in windows that are at most four times as long in shingles, cut so that any n words lie
whole in one. A template inside a window thus has a similarity of at least 1/4 with it, and one of
BANDS bands of one MinHash value each finds it with probability 1 - (3/4)**BANDS, 1 - 1e-8. A
template so retrieved is a match if the window holds at least CONTAINED of its distinct shingles.

Two sets without a common shingle collide in no band, so windows without a shingle of any template
are left out before they are hashed. Permutations are XORs of a 64-bit shingle hash with a constant.

Everything is made of Spark's own functions. Defined cases: null and empty texts match nothing; a
template of fewer than five words is refused; matches of one template in overlapping windows are one
row, with the first and the best window; repeated rows are scanned each, and their windows count
together if they share an id; rows without an id are left out; no rows give no rows; other columns
play no part.
"""

from __future__ import annotations

import random
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helioquant.llm.common import read_table

# Names and public one-line notices of common licences.
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-2.1": "Distributed under the GNU Lesser General Public License, version 2.1.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}

WORDS, BANDS, CONTAINED = 5, 64, 0.8
_RANDOM = random.Random(23)
_MASKS = [_RANDOM.getrandbits(64) - (1 << 63) for _ in range(BANDS)]


def template_words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def window_size(words: int) -> tuple[int, int]:
    """Words of the windows for templates of so many words, and the step between windows."""
    shingles = 4 * (words - WORDS + 1)
    size = shingles + WORDS - 1
    return size, size - words + 1


def shingles(text: Column) -> Column:
    """Hash of the shingle that starts at each word; the last four words start none."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _signature(shingles: Column) -> Column:
    """The smallest hash under each permutation."""
    return F.transform(F.array(*map(F.lit, _MASKS)), lambda mask: F.array_min(F.transform(shingles, lambda x: x.bitwiseXOR(mask))))


def templates_frame(spark: SparkSession, notices: dict[str, str]) -> DataFrame:
    """license, window, step and members, the sorted distinct shingle hashes; a fixed small table."""
    rows = []
    for name, text in sorted(notices.items()):
        n = len(template_words(text))
        if n < WORDS:
            raise ValueError(f"a template needs {WORDS} words: {name}")
        rows.append((name, text, *window_size(n)))
    frame = spark.createDataFrame(rows, "license string, text string, window int, step int")
    return _with_shingles(frame).select("license", "window", "step", F.array_distinct("__s").alias("members"))


def _with_shingles(df: DataFrame) -> DataFrame:
    """df with __s, the shingle hashes of its text in order."""
    df = df.withColumn("__w", shingles(F.coalesce(F.col("text"), F.lit(""))))
    w = F.col("__w")
    every = F.transform(w, lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, WORDS)]))
    return df.withColumn("__s", F.when(F.size(w) >= WORDS, F.slice(every, 1, F.greatest(F.size(w) - WORDS + 1, F.lit(0)))).otherwise(F.slice(w, 1, 0))).drop("__w")


def _windows_with(hits: Column, size: int, step: int) -> Column:
    """Windows of one class that hold the first word of a hit; window j starts at word j * step."""
    def around(p: Column) -> Column:
        return F.sequence(F.greatest(F.lit(0), F.ceil((p - (size - WORDS)) / step).cast("int")), F.floor(p / step).cast("int"))

    numbers = F.array_distinct(F.flatten(F.transform(hits, around)))
    return F.transform(numbers, lambda j: F.struct(F.lit(size).alias("window"), (j * step).alias("start")))


def scan(docs: DataFrame, notices: dict[str, str] = NOTICES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, license, n_windows (that hold it), first_word (of the first of them, from 0) and containment (the best)."""
    spark = docs.sparkSession
    templates = templates_frame(spark, notices)
    known = templates.select("license", "members", "window", "step").collect()  # a fixed small table
    wanted = sorted({m for r in known for m in r.members})
    classes = sorted({(r.window, r.step) for r in known})
    rows = _with_shingles(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))).drop("text")
    s = F.col("__s")
    hits = F.filter(F.transform(s, lambda x, i: F.when(x.isin(wanted), i)), lambda i: i.isNotNull())
    rows = rows.withColumn("__h", hits).where("doc_id is not null")
    # The windows of each class that hold a hit: window j has the words from j * step on.
    windows = F.concat(*[_windows_with(F.col("__h"), size, step) for size, step in classes])
    # An outer explode and a filter behind it: a filter on the arrays would be pushed below the steps
    # that make them and repeat those for every word.
    windows = rows.select("doc_id", "__s", F.explode_outer(windows).alias("at")).where("at is not null").select(
        "doc_id", "at.window", "at.start", F.array_distinct(F.slice(s, F.col("at.start") + 1, F.col("at.window") - WORDS + 1)).alias("members")
    )
    banded = windows.select("*", F.posexplode(_signature(F.col("members"))).alias("band", "value"))
    bands = templates.select("license", "window", F.col("members").alias("wanted"), F.posexplode(_signature(F.col("members"))).alias("band", "value"))
    found = banded.join(F.broadcast(bands), ["window", "band", "value"])  # BANDS rows for each fixed template
    share = F.size(F.array_intersect("members", "wanted")) / F.size("wanted")
    found = found.select("doc_id", "license", "start", share.alias("containment")).where(F.col("containment") >= CONTAINED)
    return found.groupBy("doc_id", "license").agg(
        F.count_distinct("start").alias("n_windows"), F.min("start").cast("long").alias("first_word"), F.max("containment").alias("containment")
    )


def op1_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence notices in all documents."""
    return scan(read_table(spark, sf_dir, "documents"))
