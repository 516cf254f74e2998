"""Shared helpers of the operators: tables, lineage cuts, hashing of bytes and words inside tasks."""

from __future__ import annotations

import hashlib
import shutil
import tempfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helioquant.session import checkpoint_dir

#: Bytes hashed at a time inside a task; eight-byte arrays of this length are the largest it makes.
SEGMENT_BYTES = 1 << 20
#: Words of more bytes are hashed by a cryptographic function.
LONG_WORD = 128

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE_VALUES = np.random.default_rng(7).integers(0, 1 << 64, 256, dtype=np.uint64) | np.uint64(1)
_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True
_SPACE_BYTES = b" \t\n\x0b\x0c\r"
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The context's checkpoint folder, which all executors see; set from the session where it is unset."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(checkpoint_dir(spark))
    return context.getCheckpointDir()


#: Spark removes the shuffle files of a query that is planned under it as soon as the query has run.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut_lineage(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared checkpoint folder; that survives lost executors.

    The shuffle files that led to them go at once. They would else stay until the driver happens to
    collect its garbage, which a large heap puts off for the whole run.
    """
    session = df.sparkSession
    shared_folder(session)
    before = session.conf.get(SHUFFLE_CLEANUP, None)
    session.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        return df.select("*").checkpoint()  # a plan of its own, made under the setting
    finally:
        if before is None:
            session.conf.unset(SHUFFLE_CLEANUP)
        else:
            session.conf.set(SHUFFLE_CLEANUP, before)


def map_arrow(df: DataFrame, function: Callable, schema: T.StructType | str) -> DataFrame:
    """df.mapInArrow, once the workers of this context have been given the package.

    Workers serve one operator after another; each task gives back the memory that it has freed.
    """
    ship_package(df.sparkSession)

    def run(batches: Iterator) -> Iterator:
        try:
            yield from function(batches)
        finally:
            give_back_memory()

    return df.mapInArrow(run, schema)


def apply_arrow(groups, function: Callable, schema: str) -> DataFrame:
    """groups.applyInArrow for a function of a key and a table, with memory given back as in map_arrow."""
    def run(key, table):  # Spark reads annotations here, so there are none
        try:
            return function(key, table)
        finally:
            give_back_memory()

    return groups.applyInArrow(run, schema)


def give_back_memory() -> None:
    """Returns freed memory of this worker to the system, which allocators would keep."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


_KEPT: dict = {}


def kept_between_tasks(key: tuple, make: Callable):
    """An object that a worker keeps for later tasks, until another one is asked for."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def drop_kept() -> None:
    _KEPT.clear()


def ship_package(spark: SparkSession) -> None:
    """Sends the package to the workers of the context, once, as a zip file.

    The driver's own file server sends it; no other machine reads the folder it lies in.
    """
    context = spark.sparkContext
    if getattr(context, "helioquant_shipped", False):
        return
    root = Path(__file__).resolve().parents[2]
    if root.is_dir():  # else it runs from a zip that the workers have
        target = Path(tempfile.mkdtemp(prefix="helioquant-package-")) / "helioquant"
        context.addPyFile(shutil.make_archive(str(target), "zip", root, "helioquant"))
    context.helioquant_shipped = True


def under_reserved_names(docs: DataFrame, needed: list[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with all columns but the needed ones under names no operator uses, and a function that gives the names back."""
    names = {c: c if c in needed else f"__own{i}" for i, c in enumerate(docs.columns)}
    renamed = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    return renamed, lambda rows: rows.select(*[F.col(n).alias(c) for c, n in names.items()])


def bytes_of(text: Column | str) -> Column:
    """UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).cast("binary")


def held_out(doc_id: Column | str) -> Column:
    """True for the third of the documents that nothing is learned from; false for a null id."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, element by element."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the base and of its inverse, grown when a longer stretch comes."""

    def __init__(self) -> None:
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            with np.errstate(over="ignore"):
                self.up = np.concatenate([np.ones(1, np.uint64), np.full(n, _BASE)]).cumprod(dtype=np.uint64)
                self.down = np.concatenate([np.ones(1, np.uint64), np.full(n, _INVERSE)]).cumprod(dtype=np.uint64)
        return self.up, self.down


POWERS = _Powers()


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """S with S[j] - S[i] the polynomial hash of data[i:j], times the base to the power i."""
    up, _ = POWERS.get(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(_BYTE_VALUES[data] * up[: len(data)], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each data[start:end], the same wherever the bytes stand."""
    _, down = POWERS.get(len(sums))
    with np.errstate(over="ignore"):
        body = (sums[ends] - sums[starts]) * down[starts]
        return mix64(body + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _stretches(data: bytes) -> Iterator[bytes]:
    """data in pieces of about SEGMENT_BYTES that cut no word."""
    at = 0
    while len(data) - at > SEGMENT_BYTES:
        cut = max(data.rfind(c, at, at + SEGMENT_BYTES) for c in (bytes([b]) for b in _SPACE_BYTES))
        if cut < at:
            later = [data.find(bytes([b]), at + SEGMENT_BYTES) for b in _SPACE_BYTES]
            cut = min((x for x in later if x >= 0), default=len(data))
        yield data[at : cut + 1]
        at = cut + 1
    yield data[at:]


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word, A-Z lower-cased; words are split at ASCII white space."""
    parts = []
    for piece in _stretches(text):
        data = np.frombuffer(piece.translate(_LOWER), np.uint8)
        edges = np.flatnonzero(np.diff(np.concatenate([[False], ~_SPACES[data], [False]]).view(np.int8)))
        starts, ends = edges[::2], edges[1::2]
        hashes = span_hashes(prefix_sums(data), starts, ends)
        # Polynomials modulo a power of two can be defeated by words of a thousand letters.
        for i in np.flatnonzero(ends - starts > LONG_WORD):
            hashes[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
        parts.append(hashes)
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def shingle_set(text: bytes, words: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; a shorter text is one shingle, an empty one none."""
    w = word_hashes(text)
    if not len(w):
        return w
    size = min(words, len(w))
    total = np.full(len(w) - size + 1, size, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(size):
            total = mix64(total * np.uint64(0xD1342543DE82EF95) + w[i : len(w) - size + 1 + i])
    return np.unique(total)
