"""Toxicity by compression distance with zstandard dictionaries.

Two dictionaries are made from labelled texts: one of the words of toxic texts, one of the words of
ordinary texts. Both hold the same common words, so that they compress ordinary text alike; the
first also has the words that toxic texts favour, the second as many that ordinary texts favour.
Each window of a text is compressed with either. A window's gain is how many bytes shorter it gets
with the toxic dictionary. A text's score is a logistic function of its gains, fitted on windows of
documents that the dictionaries have not seen, and shifted so that SCORE_CUT is where the labelled
sample is split best.

Training takes a sample of at most about ``TRAIN_DOCUMENTS`` documents of each label, picked by a
hash of their id; all documents are scored, over their whole texts.

Defined cases: null and empty texts have one empty window and get the score of no gain; without
labels of both kinds every text scores 0; rows without an id are scored but not learned from;
repeated rows are scored alike; a document labelled more than once is toxic if any label says so.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helioquant.llm.common import bytes_of, drop_kept, held_out, map_arrow, read_table, under_reserved_names

TRAIN_DOCUMENTS = 3000
#: Bytes of a document that may be learned from, at most; longer ones are not, but are scored.
TRAIN_BYTES = 200_000
SCORE_CUT = 0.7
#: Bytes of a dictionary, and of the windows that are compressed with it.
DICTIONARY_BYTES = 4096
WINDOW_BYTES = 60
#: Bytes of a stem that the dictionaries are made of, at least and at most.
STEM = (4, 12)
#: A stem is taken from so many surroundings on, if its share is so many times that on the other side.
LEAST_PLACES, LEAST_RATIO = 8, 5
#: Both dictionaries begin with it, and every window: else zstandard stores a short window as it is
#: rather than save a few bytes.
PREAMBLE = bytes(np.random.default_rng(3).integers(128, 192, 64, dtype=np.uint8))
#: Shortest match of the compressor, and the share of the other side's texts that a match may be in.
MIN_MATCH, MOST_OTHERS = 6, 0.002
#: A match that more of them have is allowed from this ratio of the shares of both sides on.
GRAM_RATIO = 4
#: How many missed toxic texts, in shares of their label, a falsely rejected one weighs.
FALSE_ALARM = 4
#: Bytes that a window must gain to count.
LEAST_GAIN = 3
FEATURES = 7
#: Words of a stem in a dictionary at most.
WORDS_OF_STEM = 32
PUNCTUATION = b".,;:!?*&%$#|\"'()"


@dataclass
class Model:
    """Trained parts; with empty dictionaries every text scores 0."""

    toxic: bytes
    ordinary: bytes
    weights: np.ndarray  # of the features


def windows(text: bytes) -> list[bytes]:
    """Lower-cased pieces of about WINDOW_BYTES, cut after a blank where there is one near."""
    text = text.lower()
    out, at = [], 0
    while at < len(text):
        end = at + WINDOW_BYTES
        if end < len(text):
            blank = text.rfind(b" ", at + WINDOW_BYTES // 2, end)
            end = blank + 1 if blank > 0 else end
        out.append(text[at:end])
        at = end
    return out or [b""]


class Gains:
    """Compressed lengths with either dictionary, compared window by window."""

    def __init__(self, toxic: bytes, ordinary: bytes) -> None:
        import zstandard as zstd

        def compressor(content: bytes):
            data = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
            parameters = zstd.ZstdCompressionParameters.from_level(
                1, strategy=zstd.STRATEGY_GREEDY, min_match=MIN_MATCH, window_log=14, hash_log=13, chain_log=13, search_log=4,
                write_content_size=False, write_checksum=False, write_dict_id=False,
            )
            data.precompute_compress(compression_params=parameters)
            return zstd.ZstdCompressor(dict_data=data, compression_params=parameters).compress

        self.toxic, self.ordinary = compressor(toxic), compressor(ordinary)

    def of(self, text: bytes) -> np.ndarray:
        toxic, ordinary = self.toxic, self.ordinary
        return np.fromiter((len(ordinary(PREAMBLE + w)) - len(toxic(PREAMBLE + w)) for w in windows(text)), np.float64)


def features(gains: np.ndarray) -> np.ndarray:
    """Excess of the three largest gains over LEAST_GAIN, how many windows gain, and the constant 1."""
    top = np.sort(gains)[::-1][:3]
    top = np.concatenate([top, np.zeros(3 - len(top))]).clip(0)
    hits = (gains >= LEAST_GAIN).sum()
    return np.array([top[0], top[1], top[2], np.log1p(hits), hits / len(gains), np.log(len(gains)), 1.0])


def _stems(word: bytes) -> list[bytes]:
    return [word[:n] for n in range(STEM[0], min(len(word), STEM[1]) + 1)]


def _words(text: bytes) -> list[bytes]:
    return [w.strip(PUNCTUATION) for w in text.split()]


def _telling_parts(words: list[bytes], mine: list[bytes], others: list[bytes]) -> dict[bytes, bytes]:
    """Of each word with the blanks around it the longest beginning that holds no common string.

    A string of MIN_MATCH bytes is common if more than MOST_OTHERS of the other side's texts have it
    and its share on this side is not GRAM_RATIO times as large. Words whose first such string is
    common are left out.
    """
    grams = {w: [(b" " + w + b" ")[i : i + MIN_MATCH] for i in range(len(w) + 3 - MIN_MATCH)] for w in words}
    wanted = {g for own in grams.values() for g in own}

    def shares(texts: list[bytes]) -> dict[bytes, float]:
        seen = Counter()
        for text in texts:
            seen.update(wanted.intersection({text[i : i + MIN_MATCH] for i in range(len(text) + 1 - MIN_MATCH)}))
        return {g: n / len(texts) for g, n in seen.items()}

    here, there = shares(mine), shares(others)
    common = {g for g, x in there.items() if x > MOST_OTHERS and here.get(g, 0) < GRAM_RATIO * x}
    out = {}
    for word, own in grams.items():
        good = next((i for i, g in enumerate(own) if g in common), len(own))
        if good:
            out[word] = (b" " + word + b" ")[: good + MIN_MATCH - 1]
    return out


def _favoured(mine: list[bytes], others: list[bytes]) -> list[bytes]:
    """Words that one side favours, those of the most telling stems first.

    A stem, the beginning of a word, tells if the share of texts with it is LEAST_RATIO times that
    on the other side and it stands in LEAST_PLACES different surroundings: copies of a passage
    count once. Of stems that begin alike one stands for all, the longest of about equal ones. Its
    commonest words are taken, as a whole word is a longer match than its stem.
    """
    texts = [Counter(s for t in side for s in {s for w in set(_words(t)) for s in _stems(w)}) for side in (mine, others)]
    share = {s: (n / len(mine)) / ((texts[1][s] + 1) / (len(others) + 1)) for s, n in texts[0].items() if n >= LEAST_PLACES // 2}
    places: dict[bytes, set[int]] = {s: set() for s, x in share.items() if x > LEAST_RATIO}
    spelled: dict[bytes, Counter] = {s: Counter() for s in places}
    for text in mine:
        words = _words(text)
        for before, word, after in zip([b"", *words], words, [*words[1:], b""]):
            for stem in _stems(word):
                if stem in places:
                    places[stem].add(zlib.crc32(before + b" " + after))
                    spelled[stem][word] += 1
    telling = {s: len(x) * np.log(share[s]) for s, x in places.items() if len(x) >= LEAST_PLACES}
    stems: list[bytes] = []
    for stem in sorted(telling, key=lambda x: (-round(np.log(telling[x]) / 0.15), -len(x), x)):
        if not any(x.startswith(stem) or stem.startswith(x) for x in stems):
            stems.append(stem)
    out, size = [], 0
    words = [[w for w, _ in spelled[s].most_common(WORDS_OF_STEM)] for s in stems]
    parts = _telling_parts([w for own in words for w in own], mine, others)
    for part in dict.fromkeys(parts[w] for own in words for w in own if w in parts):
        if size < DICTIONARY_BYTES // 2:
            out.append(part)
            size += len(part) + 1
    return out


def _dictionaries(common: list[bytes], own: list[list[bytes]]) -> list[bytes]:
    """Raw contents that hold the common words at the same place; what stands last is cheapest to refer to."""
    ends = [b"".join(x + bytes(1) for x in reversed(words)) for words in own]
    longest = max(map(len, ends))
    start = b" ".join(reversed(common))[-DICTIONARY_BYTES // 2 :]
    return [PREAMBLE + start + bytes(longest - len(x)) + x for x in ends]


def train(rows: list[tuple[bytes, int]]) -> Model:
    """A model from (text, label); labels 0 and 1."""
    empty = Model(b"", b"", np.zeros(FEATURES))
    texts = {y: [x for x, label in rows if label == y] for y in (0, 1)}
    if min(len(x) for x in texts.values()) < 2:
        return empty
    halves = {y: ([t.lower() for t in x[::2]], x[1::2]) for y, x in texts.items()}
    words = Counter(w for text in halves[0][0] for w in set(text.lower().split()))
    # Ties by the word itself, as a set's order differs from one Python process to the next.
    common = sorted(words, key=lambda w: (-words[w], w))[: DICTIONARY_BYTES // 8]
    toxic, ordinary = _dictionaries(common, [_favoured(halves[y][0], halves[1 - y][0]) for y in (1, 0)])
    model = Model(toxic, ordinary, np.zeros(FEATURES))
    gains = Gains(model.toxic, model.ordinary)
    x = np.array([features(gains.of(t)) for y in (0, 1) for t in halves[y][1]])
    y = np.repeat([0.0, 1.0], [len(halves[0][1]), len(halves[1][1])])
    model.weights = _calibrate(x, y)
    return model


def _calibrate(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic weights by Newton steps with both labels weighing the same, then shifted to SCORE_CUT."""
    w, weight = np.zeros(x.shape[1]), np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (y - p)) - 1e-2 * w
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w))
        w = w + np.linalg.solve(curve, slope)
    z = x @ w
    order = np.argsort(z)
    right = FALSE_ALARM * np.cumsum(y[order] == 0) / (y == 0).sum() - np.cumsum(y[order]) / y.sum()
    best = np.flatnonzero(right >= right.max() - 1e-12)
    i = int(best[len(best) // 2])
    cut = (z[order[i]] + z[order[min(i + 1, len(z) - 1)]]) / 2
    w[-1] += np.log(SCORE_CUT / (1 - SCORE_CUT)) - cut
    return w


def learn_toxicity(
    docs: DataFrame, labels: DataFrame, text: str = "text", sample: int = TRAIN_DOCUMENTS
) -> Model:
    """A model from labelled documents, joined on doc_id; the driver gets the bounded sample."""
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("__toxic"))
    counts = {r[0]: r[1] for r in marks.groupBy("__toxic").count().collect()}
    rate = F.when(F.col("__toxic") == 1, sample / max(counts.get(1, 1), 1)).otherwise(sample / max(counts.get(0, 1), 1))
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(29)), F.lit(1_000_000)) / 1_000_000
    picked = marks.where(draw < rate)
    own = docs.select("doc_id", bytes_of(text).alias("__bytes")).where(F.length("__bytes") <= TRAIN_BYTES)
    rows = own.join(F.broadcast(picked), "doc_id").select("doc_id", "__toxic", "__bytes").collect()
    return train([(bytes(r[2]), int(r[1])) for r in sorted(rows, key=lambda r: (r[0], r[1], bytes(r[2])))])


def score_toxicity(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """keep's columns, score (0 to 1) and predicted (1 from SCORE_CUT on)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept()
        gains = Gains(model.toxic, model.ordinary) if model.toxic else None
        for batch in batches:
            score = np.zeros(batch.num_rows)
            if gains:
                x = np.array([features(gains.of(t.as_py())) for t in batch.column(len(keep))]).reshape(-1, FEATURES)
                score = 1 / (1 + np.exp(-np.clip(x @ model.weights, -30, 30)))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(len(keep))), pa.array(score), pa.array((score >= SCORE_CUT).astype(np.int32))],
                [*keep, "score", "predicted"],
            )

    own = docs.select(*keep, bytes_of(text).alias("__bytes"))
    schema = T.StructType([*own.schema.fields[:-1], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return map_arrow(own, run, schema)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity score of every document, learned from those that are not held out."""
    docs = read_table(spark, sf_dir, "documents")
    labels = read_table(spark, sf_dir, "labels").where(~held_out("doc_id"))
    rows = score_toxicity(docs, learn_toxicity(docs, labels), ["doc_id"])
    return rows.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that score SCORE_CUT or more go."""
    labels = read_table(spark, sf_dir, "labels").where(~held_out("doc_id"))
    own, given = under_reserved_names(docs, ["doc_id", "text"])
    return given(score_toxicity(own, learn_toxicity(own, labels), own.columns).where("predicted = 0"))
