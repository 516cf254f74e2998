"""What a run leaves on the executors' disks, and what one task sorts."""

from __future__ import annotations

import random
import time
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from helioquant.llm import packing, repeats
from helioquant.llm.common import SHUFFLE_CLEANUP, cut_lineage, drop_kept


def shuffle_files(spark):
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {f for f in manager.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in f}


def test_shuffle_files_go_with_the_lineage(spark):
    before, setting = shuffle_files(spark), spark.conf.get(SHUFFLE_CLEANUP, None)
    counted = spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count()
    kept = cut_lineage(counted)
    until = time.time() + 20
    while shuffle_files(spark) - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffle_files(spark) - before
    assert spark.conf.get(SHUFFLE_CLEANUP, None) == setting
    assert sorted(map(tuple, kept.join(counted, ["k", "count"]).collect())) == [(k, 100) for k in range(10)]


def test_buckets_follow_the_bytes_of_the_texts(spark, monkeypatch):
    words = [f"{i * 7919 % 1009}word{i}" for i in range(60)]
    texts = [" ".join(words[i : i + 25]) for i in range(30)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    seen = []
    send = repeats.send_digests
    monkeypatch.setattr(repeats, "send_digests", lambda rows, buckets: seen.append(buckets) or send(rows, buckets))

    def run():
        return sorted(map(tuple, repeats.without_repeats(docs, ["doc_id"]).collect()))

    few = run()
    monkeypatch.setattr(repeats, "BUCKET_BYTES", 100)
    assert run() == few
    size = sum(len(t or "") for t in texts)
    assert seen == [2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // 100)]


def held(function, batch):
    """The rows that a task's function makes of a batch, and the most bytes it holds meanwhile."""
    tracemalloc.start()
    try:
        rows = [(x.num_rows, x.nbytes) for x in function(iter([batch]))]
        return rows, tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_a_task_holds_a_slice_of_its_batch(spark, monkeypatch):
    monkeypatch.setattr(repeats, "map_arrow", lambda rows, function, schema: function)
    docs = spark.createDataFrame([(1, b"")], "doc_id long, bytes binary")
    asked = spark.createDataFrame([(1, b"")], "doc_id long, asked binary")
    rng = random.Random(3)
    texts = [rng.randbytes(20_000) for _ in range(600)]
    wanted = []
    for text in texts:
        _, _, key, context = repeats.window_runs(np.frombuffer(text, np.uint8), np.array([len(text)]))
        wanted.append(repeats._pack(context, key, np.zeros(len(key), np.int64)))
    columns = [pa.array(range(600)), pa.array(texts, pa.binary()), pa.array(wanted, pa.binary())]
    batch = pa.RecordBatch.from_arrays(columns, ["doc_id", "bytes", "asked"])
    contexts = sum(len(x) for x in wanted) // 24
    for function, each in ((repeats.send_digests(docs, 16), 12), (repeats.send_contexts(docs, asked, 16), 32 + repeats.WINDOW)):
        _, few = held(function, batch.slice(0, 300))
        rows, most = held(function, batch)
        assert most < 1.3 * few
        assert sum(size for _, size in rows) >= contexts * each  # all are sent


def test_slices_have_every_row_once():
    size = repeats.SLICE_BYTES
    texts = [b"a" * n for n in (0, size // 2, size // 2, size // 2, 3 * size, 5, 0)] + [None]
    batches = [pa.RecordBatch.from_arrays([pa.array(x, pa.binary())], ["bytes"]) for x in (texts, texts[:0], [None])]
    parts = list(repeats.slices(iter(batches)))
    assert [x.as_py() for p in parts for x in p.column(0)] == [*texts, None]
    assert all(sum(len(x.as_py() or b"") for x in p.column(0).slice(1)) <= size for p in parts)


def test_blocks_follow_the_contexts_asked_for(spark, monkeypatch):
    words = [f"{i * 7919 % 1009}word{i}" for i in range(60)]
    docs = spark.createDataFrame([(i, " ".join(words[i : i + 25])) for i in range(30)], "doc_id long, text string")
    seen = []
    sort = repeats.sort_blocks
    monkeypatch.setattr(repeats, "sort_blocks", lambda rows, blocks: seen.append(blocks) or sort(rows, blocks))

    def run():
        return sorted(map(tuple, repeats.without_repeats(docs, ["doc_id"]).collect()))

    few = run()
    monkeypatch.setattr(repeats, "BLOCK_BYTES", 100)
    assert run() == few
    assert seen[1] > seen[0] == 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_pieces_leave_a_few_texts_at_a_time(spark, monkeypatch, prose):
    monkeypatch.setattr(packing, "map_arrow", lambda rows, function, schema: function)
    docs = spark.createDataFrame([(1, "")], "doc_id long, text string")
    cut = packing.token_pieces(docs, packing.default_tokenizer(), with_ids=True)
    words = prose(11, 400).split()
    rng = random.Random(4)
    texts = [" ".join(rng.choices(words, k=3000)) for _ in range(800)] + [None, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(802)), pa.array(texts)], ["doc_id", "text"])
    try:
        held(cut, batch.slice(0, 1))  # loads the tokenizer
        _, few = held(cut, batch.slice(0, 400))
        parts, most = held(cut, batch)
        assert most < 1.3 * few and max(size for _, size in parts) < 4 * packing._TEXT_BYTES
        out = pa.Table.from_batches(cut(iter([batch]))).to_pydict()
    finally:
        drop_kept()
    assert sorted(set(out["doc_id"])) == list(range(802))
    assert [x for i, x in zip(out["doc_id"], out["ids"]) if i >= 800] == [bytes(4), bytes(4)]


def test_few_chunks_are_encoded_together(prose):
    encoder = packing.ChunkTokenizer(packing.default_tokenizer())
    chunks = sorted({f"{w}{i % 977}" for i, w in enumerate(prose(12, 3 * packing._ENCODED).split())}) + [""]
    plain, seen = encoder.tokenizer, []

    class Seen:
        @staticmethod
        def encode_batch_fast(some, **options):
            seen.append(len(some))
            return plain.encode_batch_fast(some, **options)

    encoder.tokenizer = Seen
    assert encoder._ids(chunks) == [np.array(plain.encode(c, add_special_tokens=False).ids, "<u4").tobytes() for c in chunks]
    assert sum(seen) == len(chunks) > packing._ENCODED >= max(seen)
    assert encoder._ids([]) == []


class Counted:
    """A tokenizer that notes the chunks it encodes."""

    def __init__(self, plain):
        self.plain, self.seen = plain, []

    def encode_batch_fast(self, some, **options):
        self.seen += some
        return self.plain.encode_batch_fast(some, **options)


def odd_texts(prose) -> list[str]:
    letters = [c for c in map(chr, range(256)) if c.isalpha()]
    rng = random.Random(6)
    words = ["".join(rng.choices(letters, k=rng.randint(1, 12))) for _ in range(600)] + letters + prose(13, 300).split()
    words += [w + t for w in words[::3] for t in (".", ",", "..", ".,", "'s", "-x,", "7.", "\u0301", "\u0301,", "\u0142.")]
    words += ["", ".", ",", "\x00.", "a\x00b,", "\u212a,", "J\u030c", "\u0130.", "don't", "<|endoftext|>", "\xa0a.", "\xadx", "\xd7,", "7", "\ufb01."]
    rng.shuffle(words)
    return [" \n".join(words[i : i + 40]) for i in range(0, len(words), 40)]


def test_words_need_the_model_only_and_give_the_ids_of_the_tokenizer(monkeypatch, prose):
    monkeypatch.setattr(packing, "CACHE_CHUNKS", 300)
    encoder = packing.ChunkTokenizer(packing.default_tokenizer())
    plain, encoder.tokenizer = encoder.tokenizer, Counted(encoder.tokenizer)
    texts = odd_texts(prose)
    for at in [*range(0, len(texts), 3), 0, 3]:
        some = texts[at : at + 3]
        ids, begins = encoder.encode(pa.array(some), 0)
        wanted = [[*plain.encode(t, add_special_tokens=False).ids, 0] for t in some]
        assert [ids[i:j].tolist() for i, j in zip(begins, begins[1:])] == wanted
        assert len(encoder.known) == len(encoder.sizes) == len(encoder.used) <= 2 * 300 + 3 * 40
    seen = set(encoder.tokenizer.seen)
    assert "don't" in seen and not [c for c in seen if c.isalpha() and max(c) <= "\u00ff"]


def test_words_go_to_the_tokenizer_where_letters_do_not_stand_alone(tmp_path, prose):
    from tokenizers import Regex, Tokenizer, pre_tokenizers

    cuts = Tokenizer.from_file(packing.default_tokenizer())
    cuts.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex("e"), "isolated"), cuts.pre_tokenizer])
    cuts.save(str(tmp_path / "cuts.json"))
    encoder = packing.ChunkTokenizer(str(tmp_path / "cuts.json"))
    text = prose(14, 200)
    ids, _ = encoder.encode(pa.array([text]), 7)
    assert encoder.letters is None
    assert ids.tolist() == [*cuts.encode(text, add_special_tokens=False).ids, 7]


def test_packing_copies_no_ids(spark, monkeypatch):
    monkeypatch.setattr(packing, "map_arrow", lambda rows, function, schema: function)
    monkeypatch.setattr(packing, "TaskContext", type("Task", (), {"get": staticmethod(lambda: type("Of", (), {"partitionId": staticmethod(lambda: 2)}))}))
    monkeypatch.setattr(packing, "_PASSED", 16)
    pieces = spark.createDataFrame([(1, 1, b"")], "doc_id long, length long, ids binary")
    pack = packing.pack_pieces(pieces, ["doc_id"], tokens=100, block=64)
    rng = random.Random(5)
    lengths = [rng.randint(1, 110) for _ in range(200)]
    rows = pa.table({"doc_id": range(200), "length": lengths, "ids": [rng.randbytes(40_000) for _ in range(200)]})
    batches = [b for i in range(0, 200, 40) for b in rows.slice(i, 40).combine_chunks().to_batches()]
    before, most, out = pa.total_allocated_bytes(), 0, []
    for part in pack(iter(batches)):
        most = max(most, pa.total_allocated_bytes() - before)
        assert part.num_rows <= 16
        out.append(part)
    assert most < 64 * 40_000 / 2
    got = pa.Table.from_batches(out)
    assert got.select(["doc_id", "length", "ids"]).equals(rows.cast(got.select(["doc_id", "length", "ids"]).schema))
    blocks = [np.array(lengths[i : i + 64]) for i in range(0, 200, 64)]
    wanted = [packing.best_fit(x[x < 100], (100, 100, 10_000), (1.0, 1e-6, 1e-6), "norm")[1] for x in blocks]
    offsets = np.array(got["offset"])
    assert list(offsets[np.array(lengths) < 100]) == list(np.concatenate(wanted)) and not offsets[np.array(lengths) >= 100].any()
    assert all(s >> 40 == 2 for s in got["sequence_id"].to_pylist())
