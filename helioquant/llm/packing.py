"""Best-fit packing of tokenised documents under a vector of capacities.

``token_pieces`` turns texts into pieces of at most ``limit`` tokens; ``pack_pieces`` places pieces
into sequences. Each piece is a vector (tokens, documents, attention cost = tokens squared) and each
sequence has a capacity for every component. Pieces are taken by falling length; of the open
sequences in which a piece stays under every capacity, the one with the smallest weighted residual
norm after placing it is chosen (``rule="norm"``), or the one with the largest weighted dot product
of residual and piece (``rule="dot"``).

Full pieces fill a sequence alone and are never compared with others. The rest are dealt out by a
hash of their key and packed in blocks of ``block`` pieces, so memory is bounded and the loss is at
most a fraction of one sequence a block. Tasks pass on pieces a few texts at a time and copy no ids of
a block, whatever an Arrow batch holds. Defined cases: null and empty texts give one piece, the
separator alone; no rows give no rows; repeated rows are packed once each; columns named like the
results are left out of the input first.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import accumulate, chain, pairwise, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helioquant.llm.common import kept_between_tasks, map_arrow, read_table

SEQUENCE_TOKENS = 2048
BLOCK = 8192
#: Chunks whose ids a worker remembers; it forgets those not met for longest when there are twice as many.
CACHE_CHUNKS = 200_000
#: Texts numbered and passed on together.
_TEXT_BYTES = 1 << 20
#: Chunks encoded together.
_ENCODED = 4096
#: Packed pieces passed on together.
_PASSED = 1024
#: The letters up to U+00FF.
_LETTERS = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
_WORD = f"^[{_LETTERS}]+$"
#: Chunks of characters up to U+00FF that end in a letter and a full stop or comma.
_TAILED = rf"^[\x{{00}}-\x{{FF}}]*[{_LETTERS}][.,]$"


def _runs(pool: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of runs of these sizes that fill pool, those named by which, one after another, and where each ends."""
    first = np.cumsum(sizes) - sizes
    lengths = sizes[which]
    ends = np.cumsum(lengths)
    at = np.repeat(first[which] - (ends - lengths), lengths)
    at += np.arange(len(at))
    return pool[at], ends


class ChunkTokenizer:
    """Ids as little-endian 32-bit words, for tokenizers that drop white space.

    Such a tokenizer treats each run of other characters alone, so equal runs are encoded once. Up to
    U+00FF a letter stays a letter when it is lower-cased, and no two characters compose, so words of
    such letters need the tokenizer's model only, where normalizer and pre-tokenizer work letter by letter.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.model = self.tokenizer.model
        self.letters = self._letter_forms()
        self.known: dict[str, int] = {}  # chunk to its row in sizes and used, in the order of the rows
        self.pool = np.empty(0, "<u4")  # the ids of all rows
        self.sizes, self.used = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.turn = 0

    def _letter_forms(self) -> dict[int, str] | None:
        """What the model is given for each small letter up to U+00FF; None if words are more than their letters."""
        if not all(t.special for t in self.tokenizer.get_added_tokens_decoder().values()):
            return None
        normalizer, splitter = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer

        def given(word: str) -> list[str]:
            word = normalizer.normalize_str(word) if normalizer else word
            return [part for part, _ in splitter.pre_tokenize_str(word)] if splitter else [word]

        small = [c for c in map(chr, range(256)) if c.isalpha() and c == c.lower()]
        forms = [given(c) for c in small]
        if any(len(form) != 1 for form in forms) or given("".join(small)) != ["".join(form for form, in forms)]:
            return None
        if any(c.isascii() and form != c for c, (form,) in zip(small, forms)):
            return None
        self.letters = {ord(c): form for c, (form,) in zip(small, forms)}
        tried = [*small, "".join(small), "".join(reversed(small))]
        whole = self._ids(tried)
        ids, sizes = self._word_ids(tried)
        same = ids.tobytes() == b"".join(whole) and (4 * sizes).tolist() == [len(x) for x in whole]
        return self.letters if same else None

    def _ids(self, chunks: list[str]) -> list[bytes]:
        """The ids of each chunk; the encodings, far larger than their ids, are held for _ENCODED chunks at a time."""
        out = []
        for at in range(0, len(chunks), _ENCODED):
            some = chunks[at : at + _ENCODED]
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
            data = np.fromiter(chain.from_iterable(ids), "<u4").tobytes()
            ends = [0, *accumulate(4 * len(x) for x in ids)]
            out += [data[i:j] for i, j in pairwise(ends)]
        return out

    def _word_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, which have small letters up to U+00FF alone, and how many each has."""
        ids, sizes = [np.empty(0, "<u4")], []
        for at in range(0, len(words), _ENCODED):
            some = words[at : at + _ENCODED]
            tokens = [self.model.tokenize(w if w.isascii() else w.translate(self.letters)) for w in some]
            ids.append(np.array([t.id for of_one in tokens for t in of_one], "<u4"))
            sizes += map(len, tokens)
        return np.concatenate(ids), np.array(sizes, np.int64)

    @staticmethod
    def _stems(chunks: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """What is looked up for each chunk, and which full stop (1) or comma (2) follows it as a token of its own."""
        tailed = pc.match_substring_regex(chunks, _TAILED)
        stems = pc.if_else(tailed, pc.utf8_slice_codeunits(chunks, 0, -1), chunks)
        stems = pc.if_else(pc.match_substring_regex(stems, _WORD), pc.utf8_lower(stems), stems)
        tails = np.where(pc.ends_with(chunks, ",").to_numpy(zero_copy_only=False), 2, 1)
        return stems, np.where(tailed.to_numpy(zero_copy_only=False), tails, 0)

    def _rows(self, stems: list[str]) -> np.ndarray:
        """The rows of the stems; what was met lately is not encoded again."""
        if len(self.known) > 2 * CACHE_CHUNKS:
            keep = np.sort(np.argsort(-self.used, kind="stable")[:CACHE_CHUNKS])
            names = list(self.known)
            self.known = {names[row]: new for new, row in enumerate(keep.tolist())}
            self.pool, _ = _runs(self.pool, self.sizes, keep)
            self.sizes, self.used = self.sizes[keep], self.used[keep]
        rows = np.fromiter(map(self.known.get, stems, repeat(-1)), np.int64, len(stems))
        absent = np.flatnonzero(rows < 0)
        words, others = [], []
        for i in absent.tolist():
            stem = stems[i]
            (words if self.letters and stem.isalpha() and max(stem) <= "\u00ff" else others).append(stem)
        ids, sizes = self._word_ids(words)
        parts = self._ids(others)
        self.known.update(zip(words + others, range(len(self.known), len(self.known) + len(absent))))
        rows[absent] = [self.known[stems[i]] for i in absent.tolist()]
        self.pool = np.concatenate([self.pool, ids, np.frombuffer(b"".join(parts), "<u4")])
        self.sizes = np.concatenate([self.sizes, sizes, np.array([len(x) // 4 for x in parts], np.int64)])
        self.used = np.concatenate([self.used, np.zeros(len(absent), np.int64)])
        self.turn += 1
        self.used[rows] = self.turn
        return rows

    def parts_of(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all chunks, and how many each has."""
        stems, tails = self._stems(chunks)
        coded = pa.concat_arrays([stems, pa.array([".", ","], stems.type)]).dictionary_encode()
        rows = self._rows(coded.dictionary.to_numpy(zero_copy_only=False).tolist())[coded.indices.to_numpy()]
        rows, tail_rows = rows[:-2], rows[-2:]
        tailed = np.flatnonzero(tails)
        after = tail_rows[tails[tailed] - 1]
        ids, _ = _runs(self.pool, self.sizes, np.insert(rows, tailed + 1, after))
        sizes = self.sizes[rows]
        sizes[tailed] += self.sizes[after]
        return ids, sizes

    def encode(self, texts: pa.Array, separator: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with a separator at its end, and where each begins (and the last ends).

        Equal chunks of the texts are numbered by Arrow, and a chunk's ids are looked up once.
        """
        spaces = pc.replace_substring_regex(texts, "[\n\t\r\x0b\x0c]", " ")
        chunks = pc.split_pattern(spaces, " ")
        coded = chunks.flatten().dictionary_encode()
        pool, sizes = self.parts_of(coded.dictionary)
        pool, sizes = np.append(pool, np.array([separator], "<u4")), np.append(sizes, 1)
        bounds = np.cumsum(pc.list_value_length(chunks).to_numpy())
        codes = np.insert(coded.indices.to_numpy(), bounds, len(sizes) - 1)
        ids, ends = _runs(pool, sizes, codes)
        return ids, np.concatenate([[0], ends[bounds + np.arange(len(texts))]])


def _even_groups(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Runs of texts of about _TEXT_BYTES together, with the row of the first; a longer text is a run of its own.

    Null texts become empty.
    """
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        before = ends[at - 1] if at else 0
        until = max(int(np.searchsorted(ends, before + _TEXT_BYTES, "right")), at + 1)
        yield at, pc.fill_null(texts[at:until], "")
        at = until


def token_pieces(
    docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text",
    limit: int = SEQUENCE_TOKENS, separator: int = 0, with_ids: bool = False,
) -> DataFrame:
    """A row per piece: key, piece, start, length, ids_crc32 and, if asked for, ids as bytes.

    tokenizer: path of a file of the tokenizers library whose tokenizer drops white space.
    A document's ids end with the separator; only a document of more than limit ids is cut.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept_between_tasks(("tokenizer", tokenizer), lambda: ChunkTokenizer(tokenizer))
        for batch in batches:
            for first, texts in _even_groups(batch.column(1)):
                owner, piece, start, length, crc, ids = [], [], [], [], [], []
                every, begins = encoder.encode(texts, separator)
                data = memoryview(every).cast("B")
                for row in range(len(texts)):
                    begin, end = int(begins[row]), int(begins[row + 1])
                    for n, at in enumerate(range(begin, end, limit)):
                        part = data[4 * at : 4 * min(at + limit, end)]
                        owner.append(first + row)
                        piece.append(n)
                        start.append(at - begin)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        if with_ids:
                            ids.append(bytes(part))
                keys = batch.column(0).take(pa.array(owner, pa.int64()))
                out = [keys, pa.array(piece, pa.int32())] + [pa.array(x, pa.int64()) for x in (start, length, crc)]
                yield pa.RecordBatch.from_arrays(out + ([pa.array(ids, pa.binary())] if with_ids else []), names)

    names = [key, "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    schema = T.StructType(
        [T.StructField(key, docs.schema[key].dataType), T.StructField("piece", T.IntegerType())]
        + [T.StructField(n, T.LongType()) for n in names[2:5]]
        + [T.StructField("ids", T.BinaryType())] * with_ids
    )
    return map_arrow(docs.select(key, text), run, schema)


def best_fit(
    lengths: np.ndarray, capacities: tuple[int, int, int], weights: tuple[float, float, float], rule: str
) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece of a block."""
    capacity = np.array(capacities, np.float64)
    scale = np.array(weights) / capacity**2
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    left = np.empty((max(len(lengths), 1), 3))  # residuals of the open sequences
    number = np.zeros(max(len(lengths), 1), np.int64)
    opened = n = 0
    order = np.argsort(-lengths, kind="stable")
    shortest = int(lengths.min()) if len(lengths) else 0
    for step, i in enumerate(order):
        item = np.array([lengths[i], 1.0, float(lengths[i]) ** 2])
        if step % 256 == 255:  # sequences that no later piece fits
            keep = (left[:n] >= (shortest, 1, shortest**2)).all(axis=1)
            left[: keep.sum()], number[: keep.sum()] = left[:n][keep], number[:n][keep]
            n = int(keep.sum())
        rest = left[:n] - item
        fits = np.flatnonzero((rest >= 0).all(axis=1))
        if len(fits):
            if rule == "norm":
                at = fits[np.argmin((rest[fits] ** 2) @ scale)]
            else:
                at = fits[np.argmax((left[fits] * item) @ scale)]
        else:
            at, n = n, n + 1
            left[at], number[at] = capacity, opened
            opened += 1
        bins[i], offsets[i] = number[at], capacity[0] - left[at, 0]
        left[at] -= item
    return bins, offsets


def pack_pieces(
    pieces: DataFrame, keys: list[str], length: str = "length", tokens: int = SEQUENCE_TOKENS,
    documents: int | None = None, attention: int | None = None,
    weights: tuple[float, float, float] = (1.0, 1e-6, 1e-6), rule: str = "norm", block: int = BLOCK,
) -> DataFrame:
    """pieces with sequence_id and offset; keys: columns that deal the pieces out evenly.

    documents, attention: capacities of a sequence besides its tokens; None sets no limit. A piece
    that exceeds a capacity alone gets a sequence of its own.
    """
    capacities = (tokens, documents or tokens, attention or tokens * tokens)
    pieces = pieces.drop("sequence_id", "offset")
    at = pieces.columns.index(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = TaskContext.get().partitionId() << 40
        waiting: list[pa.RecordBatch] = []

        def flush(final: bool) -> Iterator[pa.RecordBatch]:
            nonlocal opened, waiting
            table = pa.Table.from_batches(waiting)  # no copy: ids are most of it
            whole = len(table) if final else len(table) // block * block
            for begin in range(0, whole, block):
                part = table.slice(begin, min(block, whole - begin))
                sizes = part.column(at).to_numpy().astype(np.int64)
                alone = (sizes >= tokens) | (sizes.astype(float) ** 2 > capacities[2])
                bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
                bins[~alone], offsets[~alone] = best_fit(sizes[~alone], capacities, weights, rule)
                used = int(bins[~alone].max()) + 1 if (~alone).any() else 0
                bins[alone] = used + np.arange(alone.sum())
                part = part.append_column("sequence_id", pa.array(bins + opened))
                opened += used + int(alone.sum())
                yield from part.append_column("offset", pa.array(offsets)).to_batches(_PASSED)
            waiting = table.slice(whole).to_batches()

        rows = 0
        for batch in batches:
            waiting.append(batch)
            rows += batch.num_rows
            if rows >= block:
                yield from flush(False)
                rows = sum(b.num_rows for b in waiting)
        if waiting:
            yield from flush(True)

    schema = T.StructType(
        [*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    )
    return map_arrow(pieces.repartition(*keys), run, schema)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, packed into sequences of 2048 tokens."""
    pieces = token_pieces(read_table(spark, sf_dir, "documents"), default_tokenizer())
    return pack_pieces(pieces, ["doc_id", "piece"])


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: pieces of the documents with their ids and their place in a sequence."""
    return pack_pieces(token_pieces(docs, default_tokenizer(), with_ids=True), ["doc_id", "piece"])
