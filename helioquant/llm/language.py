"""Language identification with hyperdimensional profiles.

Each letter has a random bipolar vector. A trigram is bound from its letters' vectors, rotated by
their place; a text's vector is the bundle (sum) of its trigrams' vectors. A language's prototype is
the bundle of the unit vectors of sample documents. A text takes the language whose prototype has
the largest cosine with it. Both are compared after taking off the mean of all prototypes, which
all languages share.

Letters are lower-cased code points for which ``str.isalpha`` holds; a run of others counts as one
blank. Defined cases: a null text, or one without a letter, is ``und`` with score 0; a text as close
to two languages takes the one that sorts first; without any labelled sample all texts are ``und``;
rows without an id are predicted but not learned from; repeated rows are repeated in the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helioquant.llm.common import held_out, map_arrow, read_table

DIMENSIONS = 1024
#: Documents of each language that a profile is made from, about; the bound of the training sample.
SAMPLE_PER_LANGUAGE = 2000
#: Code points handled at a time inside a task.
_BATCH_CHARS = 200_000
#: Texts handled at a time, and distinct trigrams: tables are texts x trigrams and trigrams x dimensions.
_BATCH_TEXTS = 1024
_BATCH_GRAMS = 4096
UNKNOWN = "und"


@dataclass
class Profiles:
    languages: list[str]
    prototypes: np.ndarray  # one row a language
    dimensions: int


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


@lru_cache(maxsize=32768)
def _letter_vector(code: int, dimensions: int) -> np.ndarray:
    return np.random.default_rng(code).integers(0, 2, dimensions, dtype=np.int8) * np.int8(2) - np.int8(1)


def _codes(text: str) -> np.ndarray:
    """Lower-cased letters as code points, with one 0 before, after and for each run between them."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.concatenate([[0], np.where(_letters()[codes], codes, 0), [0]]).astype(np.int64)
    return codes[np.concatenate([[True], (codes[1:] != 0) | (codes[:-1] != 0)])]


def _bundles(codes: list[np.ndarray], dimensions: int) -> np.ndarray:
    """A row for each text: the sum of its trigrams' vectors."""
    grams = [(c[:-2] << 42) | (c[1:-1] << 21) | c[2:] for c in codes]
    distinct, where = np.unique(np.concatenate(grams), return_inverse=True)
    row = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
    # Trigrams are taken a block at a time, so that many rare ones, as in short titles of a script
    # with thousands of letters, need no more memory than few. The sums are whole numbers.
    order = np.argsort(where, kind="stable")
    row, where = row[order], where[order]
    out = np.zeros((len(grams), dimensions), np.float32)
    for start in range(0, len(distinct), _BATCH_GRAMS):
        block = distinct[start : start + _BATCH_GRAMS]
        lo, hi = np.searchsorted(where, (start, start + len(block)))
        at = row[lo:hi] * len(block) + where[lo:hi] - start
        counts = np.bincount(at, minlength=len(grams) * len(block)).reshape(len(grams), -1)
        out += counts.astype(np.float32) @ _gram_vectors(block, dimensions)
    return out


def _gram_vectors(grams: np.ndarray, dimensions: int) -> np.ndarray:
    """A row for each trigram: its letters' vectors, each turned by its place, multiplied."""
    mask = (1 << 21) - 1
    vectors = np.ones((len(grams), dimensions), np.int8)
    for shift, turn in ((42, 2), (21, 1), (0, 0)):
        letters, at = np.unique((grams >> shift) & mask, return_inverse=True)
        vectors *= np.roll(np.stack([_letter_vector(int(x), dimensions) for x in letters]), turn, axis=1)[at]
    return vectors.astype(np.float32)


def text_vectors(texts: list[str | None], dimensions: int) -> np.ndarray:
    """A row for each text, of length 1, or 0 where the text has no letter."""
    out = np.zeros((len(texts), dimensions), np.float32)
    waiting: list[tuple[int, np.ndarray]] = []
    size = 0

    def flush() -> None:
        if waiting:
            for (i, _), v in zip(waiting, _bundles([c for _, c in waiting], dimensions)):
                out[i] += v
            waiting.clear()

    for i, text in enumerate(texts):
        codes = _codes(text or "")
        for at in range(0, len(codes) - 2, _BATCH_CHARS):  # a long text is the sum of its stretches
            part = codes[at : at + _BATCH_CHARS + 2]
            if size + len(part) > _BATCH_CHARS or len(waiting) == _BATCH_TEXTS:
                flush()
                size = 0
            waiting.append((i, part))
            size += len(part)
    flush()
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norm, out=out, where=norm > 0)


def learn_profiles(
    docs: DataFrame, text: str = "text", language: str = "lang", key: str = "doc_id",
    dimensions: int = DIMENSIONS, sample: int = SAMPLE_PER_LANGUAGE,
) -> Profiles:
    """Prototypes from about ``sample`` documents of each language, picked by a hash of their key.

    The driver gets a count and one sum of vectors a language and task of the bounded sample.
    """
    labelled = docs.where(F.col(language).isNotNull() & F.col(key).isNotNull())
    counts = {r[0]: r[1] for r in labelled.groupBy(language).count().collect()}
    if not counts:
        return Profiles([], np.zeros((0, dimensions), np.float32), dimensions)
    rates = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, sample / n))])
    draw = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(17)), F.lit(1_000_000)) / 1_000_000
    picked = labelled.where(draw < rates[F.col(language)]).select(language, text)

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            names = np.array(batch.column(0).to_pylist(), object)
            vectors = text_vectors(batch.column(1).to_pylist(), dimensions)
            for name in set(names):
                sums[name] = sums.get(name, 0) + vectors[names == name].sum(axis=0, dtype=np.float64)
        yield pa.RecordBatch.from_pydict(
            {"language": pa.array(list(sums), pa.string()), "bundle": pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))}
        )

    total: dict[str, np.ndarray] = {}
    parts = max(1, min(32, len(counts) * sample // 1000))
    rows = map_arrow(picked.repartition(parts), bundle, "language string, bundle array<double>").collect()
    for name, vector in sorted((r[0], r[1]) for r in rows):
        total[name] = total.get(name, 0) + np.array(vector)
    languages = sorted(name for name, vector in total.items() if np.any(vector))
    if not languages:
        return Profiles([], np.zeros((0, dimensions), np.float32), dimensions)
    prototypes = np.stack([total[x] / np.linalg.norm(total[x]) for x in languages])
    return Profiles(languages, prototypes.astype(np.float32), dimensions)


def predict_languages(docs: DataFrame, profiles: Profiles, keep: list[str], text: str = "text") -> DataFrame:
    """keep's columns, lang_pred and score, the cosine with the language's prototype (0 to 1)."""
    languages, prototypes = profiles.languages, profiles.prototypes
    centre = prototypes.mean(axis=0) if len(languages) > 1 else 0
    centred = prototypes - centre
    if len(languages):
        centred = centred / np.maximum(np.linalg.norm(centred, axis=1, keepdims=True), 1e-12)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = text_vectors(batch.column(len(keep)).to_pylist(), profiles.dimensions)
            found, score = [None] * len(vectors), np.zeros(len(vectors))
            known = vectors.any(axis=1)
            if len(languages):
                own = vectors - centre
                own /= np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-12)
                cosine = own @ centred.T
                best = cosine.argmax(axis=1)
                found = [languages[i] for i in best]
                score = cosine[np.arange(len(best)), best].clip(0, 1).astype(np.float64)
            names = [x if k and x else UNKNOWN for x, k in zip(found, known)]
            score[~known] = 0
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(len(keep))), pa.array(names, pa.string()), pa.array(score)],
                [*keep, "lang_pred", "score"],
            )

    own = docs.select(*keep, F.col(text).alias("__text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields[:-1])
    return map_arrow(own, predict, f"{fields}, lang_pred string, score double")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document, learned from those that are not held out."""
    docs = read_table(spark, sf_dir, "documents")
    profiles = learn_profiles(docs.where(~held_out("doc_id")))
    rows = predict_languages(docs, profiles, ["doc_id"])
    return rows.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
