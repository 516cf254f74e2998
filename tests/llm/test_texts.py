"""Fingerprints, language, packing, repeats, near-duplicates against plain versions."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest

from helioquant.llm import fingerprints, language, neardup, packing, repeats
from helioquant.llm.common import mix64, shingle_set, word_hashes


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0d]+", text or "") if w]


def shingles(text, lower=True):
    w = words(text)
    if lower:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in w]
    return set(zip(*[w[k:] for k in range(5)])) if len(w) >= 5 else ({tuple(w)} if w else set())


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_word_hashes_do_not_depend_on_stretches(monkeypatch, prose):
    text = (prose(1, 300) + "\n\t x" + "y" * 5000 + " end ").encode()
    whole = word_hashes(text)
    monkeypatch.setattr("helioquant.llm.common.SEGMENT_BYTES", 64)
    assert len(whole) == len(text.split())
    assert (word_hashes(text) == whole).all()
    assert len(shingle_set(b"A b")) == 1 and len(shingle_set(b"")) == 0
    assert (shingle_set(b"A B c d e f") == shingle_set(b"a b  C D E F")).all()


# fingerprints


@pytest.fixture(scope="module")
def marks(hard):
    return fingerprints.fingerprints(hard).toPandas()


def test_fingerprints_edit_and_likeness(marks, hard_rows):
    rows = sorted(((r[0], r[1] or "") for r in hard_rows if r[0] is not None), key=lambda r: (r[0], r[1]))
    got = marks[marks.doc_id.notna()].sort_values(["doc_id", "fingerprint"]).reset_index(drop=True)
    assert len(marks) == len(hard_rows)
    for i, (doc_id, text) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1]
        k = len(text) // 4
        edited = text[: len(text) - k] + following[:k]
        row = got.iloc[i]
        assert (row.doc_id, row.n_chars) == (doc_id, len(text))
        if doc_id != 12:  # of two equal rows either may come first
            assert row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
            assert abs(row.near_edited - similarity(shingles(text, False), shingles(edited, False))) < 0.15
            assert abs(row.near_next - similarity(shingles(text, False), shingles(following, False))) < 0.15
    same = got.set_index("doc_id").fingerprint
    assert same[0] == same[5] and same[1] == same[2] == same[3] == "." * 256


def test_fingerprints_of_nothing_and_of_one(nothing, hard):
    assert fingerprints.fingerprints(nothing).count() == 0
    row = fingerprints.fingerprints(hard.where("doc_id = 7")).first()
    assert row.near_next == 1.0


def test_fingerprints_over_many_stretches(hard, monkeypatch, marks):
    monkeypatch.setattr(fingerprints, "STRETCH", 2)
    again = fingerprints.fingerprints(hard).toPandas()
    keys = ["doc_id", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    order = lambda d: sorted(map(repr, d[keys].itertuples(index=False)))
    assert order(again) == order(marks)


def test_stretches_hold_as_many_rows_for_any_ids(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "STRETCH", 50)
    ids = [*range(1000), 50_000_000_000, *range(-(10**15), -(10**15) + 300), *range(7 * 10**12, 7 * 10**12 + 90_000, 300)]
    rows = [(i, f"text {i}") for i in random.Random(8).sample(ids, len(ids))] + [(None, "nameless")]
    got = fingerprints.with_next(spark.createDataFrame(rows, "doc_id long, text string"))[0].toPandas()
    own = got[(got.guest == 0) & got.doc_id.notna()]
    assert len(own) == len(ids) and own.groupby("stretch").size().max() <= 100
    ids.sort()
    following = dict(zip(ids, [*ids[1:], ids[0]]))
    assert all(x == f"text {following[int(i)]}" for i, x in zip(own.doc_id, own.next_text))


# language


def test_language_of_hard_rows(hard, nothing):
    profiles = language.learn_profiles(hard)
    rows = language.predict_languages(hard, profiles, ["doc_id"]).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == 15 and all(0 <= r.score <= 1 for r in rows)
    assert by[1].lang_pred == by[2].lang_pred == by[3].lang_pred == "und" and by[1].score == 0
    assert by[0].lang_pred == by[5].lang_pred and by[10].lang_pred == "cc"
    empty = language.learn_profiles(nothing)
    assert {r.lang_pred for r in language.predict_languages(hard, empty, ["doc_id"]).collect()} == {"und"}
    assert language.predict_languages(nothing, profiles, ["doc_id"]).count() == 0


def test_text_vectors_are_bundles_of_bound_letters(monkeypatch):
    text = "Ab, ñ!"
    plain = np.zeros(64)
    letters = [0, *map(ord, "ab"), 0, ord("ñ"), 0]
    for a, b, c in zip(letters, letters[1:], letters[2:]):
        v = [language._letter_vector(x, 64).astype(int) for x in (a, b, c)]
        plain += np.roll(v[0], 2) * np.roll(v[1], 1) * v[2]
    got = language.text_vectors([text], 64)[0]
    assert np.allclose(got, plain / np.linalg.norm(plain), atol=1e-6)
    monkeypatch.setattr(language, "_BATCH_CHARS", 3)
    assert np.allclose(language.text_vectors([None, text, ""], 64), [np.zeros(64), got, np.zeros(64)], atol=1e-6)


def test_many_short_texts_of_many_letters_need_little_memory(monkeypatch):
    dice = np.random.default_rng(5)
    titles = ["".join(map(chr, dice.integers(0x4E00, 0x9FA5, 18))) for _ in range(10_000)]
    tracemalloc.start()
    got = language.text_vectors(titles, 64)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 500_000_000
    # The same sums whatever the blocks.
    monkeypatch.setattr(language, "_BATCH_GRAMS", 7)
    monkeypatch.setattr(language, "_BATCH_TEXTS", 3)
    assert np.array_equal(got[:40], language.text_vectors(titles[:40], 64))


def test_language_on_the_tables(spark):
    rows = language.op3_language_id(spark, "/root/testdata/sf0.01").toPandas()
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").toPandas()
    both = rows.merge(truth, on="doc_id")
    assert (both.lang_pred == both.lang)[both.held_out].mean() > 0.97
    assert all(both.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in both.doc_id])


# packing


def test_pieces_equal_the_tokenizer(hard, hard_rows, nothing):
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = True
    got = packing.token_pieces(hard, path, limit=100, with_ids=True).toPandas()
    for doc_id, text, *_ in hard_rows:
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        own = got[got.doc_id.isna() if doc_id is None else got.doc_id == doc_id].drop_duplicates("piece").sort_values("piece")
        assert list(own.ids) == [ids[i : i + 100].tobytes() for i in range(0, len(ids), 100)]
        assert list(own.ids_crc32) == [zlib.crc32(x) for x in own.ids]
        assert list(own.start) == list(range(0, len(ids), 100))
    assert packing.token_pieces(nothing, path).count() == 0


def test_packs_fill_sequences_without_gaps(hard, nothing):
    pieces = packing.token_pieces(hard, packing.default_tokenizer(), limit=100)
    got = packing.pack_pieces(pieces, ["doc_id", "piece"], tokens=100, block=64).toPandas().sort_values(["sequence_id", "offset"])
    ends = got.groupby("sequence_id").length.cumsum()
    assert len(got) == pieces.count() and (ends <= 100).all() and (ends - got.length == got.offset).all()
    assert packing.pack_pieces(packing.token_pieces(nothing, packing.default_tokenizer()), ["doc_id", "piece"]).count() == 0


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_best_fit_keeps_every_capacity(rule):
    lengths = np.array([random.Random(i).randint(1, 90) for i in range(400)])
    bins, offsets = packing.best_fit(lengths, (100, 3, 6000), (1.0, 0.1, 0.1), rule)
    for b in set(bins):
        own = lengths[bins == b]
        assert own.sum() <= 100 and len(own) <= 3 and (own**2).sum() <= max(6000, own.max() ** 2)
        assert sorted(offsets[bins == b]) == sorted(np.cumsum(own[np.argsort(offsets[bins == b])]) - own[np.argsort(offsets[bins == b])])
    if rule == "norm":
        plain, _ = packing.best_fit(lengths, (100, 400, 10**8), (1.0, 0.0, 0.0), rule)
        assert plain.max() + 1 <= 1.02 * -(-lengths.sum() // 100) + 1


# repeats


def plain_repeats(rows, size=50):
    first, out = {}, Counter()
    data = [(i, (t or "").encode()) for i, t in rows]
    for i, b in data:
        for j in range(len(b) - size + 1):
            if i is not None:
                first[b[j : j + size]] = min(first.get(b[j : j + size], i), i)
    for i, b in data:
        gone = np.zeros(len(b), bool)
        for j in range(len(b) - size + 1):
            if i is not None and first[b[j : j + size]] < i:
                gone[j : j + size] = True
        spans = int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum())
        out[(i, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())] += 1
    return out


@pytest.mark.parametrize("block", [2000, 2])
def test_repeats_equal_plain_search(hard, hard_rows, nothing, monkeypatch, block):
    # A key with many contexts is dealt out over blocks, with the same result.
    monkeypatch.setattr(repeats, "BLOCK", block)
    got = repeats.without_repeats(hard, ["doc_id"])
    rows = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect())
    assert rows == plain_repeats([r[:2] for r in hard_rows])
    assert repeats.without_repeats(nothing, ["doc_id"]).count() == 0


@pytest.mark.parametrize("segment", [1 << 20, 256])
def test_a_line_in_many_surroundings_goes_from_every_place(spark, prose, monkeypatch, segment):
    # One document owns the line in several blocks of its key; a smaller one has it in one block only.
    monkeypatch.setattr(repeats, "BLOCK", 2)
    monkeypatch.setattr(repeats, "SEGMENT_BYTES", segment)
    line = prose(30, 12)[:60]
    rows = [(1, f"{prose(31, 8)} {line} {prose(32, 8)}"), (2, " ".join(f"{prose(40 + i, 9)} {line} {prose(80 + i, 9)}" for i in range(24)))]
    rows += [(3, " ".join(f"{prose(140 + i, 9)} {line} {prose(180 + i, 9)}" for i in range(12)))]
    got = repeats.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"]).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == plain_repeats(rows)


def test_long_texts_are_cut_into_stretches_that_overlap(spark, prose, monkeypatch):
    monkeypatch.setattr(repeats, "SEGMENT_BYTES", 256)
    shared = prose(9, 100)
    rows = [(1, prose(7, 90) + shared), (2, shared + prose(8, 70)), (3, "x" * 700), (4, "x" * 300 + prose(8, 70))]
    got = repeats.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"]).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == plain_repeats(rows)


def test_two_stage_order_is_the_suffix_order():
    rng = np.random.default_rng(2)
    for text in (rng.integers(97, 100, 700).astype(np.uint8), np.full(200, 97, np.uint8), np.frombuffer(b"banana" * 30, np.uint8)):
        order = repeats.suffix_order(text, repeats._words(text))
        data = text.tobytes()
        assert sorted(order) == list(range(len(text)))
        heads = [data[i : i + 50] for i in order]
        assert heads == sorted(heads)


# near-duplicates


def plain_components(rows):
    sets, sizes = {}, Counter()
    for i, t in rows:
        s = shingles(t)
        sizes[(i, len(s))] += 1
        if i is not None and s:
            sets.setdefault(i, []).append(s)
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if any(100 * len(x & y) >= 85 * len(x | y) for x in sets[a] for y in sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return Counter({(i, n, None if i is None else find(i), i is None or find(i) == i): k for (i, n), k in sizes.items()})


def test_near_duplicates_equal_all_pairs(hard, hard_rows, nothing):
    got = neardup.near_duplicates(hard)
    assert Counter(map(tuple, got.collect())) == plain_components([r[:2] for r in hard_rows])
    assert neardup.near_duplicates(nothing).count() == 0


def test_a_large_group_with_chains_and_strangers(spark, prose):
    # Copies drift away step by step: ends of a chain are linked only through what lies between.
    rng = random.Random(4)
    rows, text = [], prose(20, 150).split()
    for i in range(60):
        rows.append((i, " ".join(text)))
        source = list(text)
        for _ in range(rng.choice([0, 1, 2, 6])):
            source[rng.randrange(150)] = f"w{rng.random()}"
        rows.append((1000 - i, " ".join(source)))
        if i % 3 == 0:
            text[rng.randrange(150)] = f"v{i}"
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter(map(tuple, got.collect())) == plain_components(rows)


@pytest.mark.parametrize("threshold", [neardup.THRESHOLD, neardup.STAGE_THRESHOLD])
def test_a_large_group_just_below_the_threshold_makes_few_pairs(spark, prose, threshold):
    # Copies with so many scattered words of their own changed that some reach the base and none another copy.
    rng = random.Random(9)
    base = prose(30, 104).split()
    rows = [(0, " ".join(base))]
    for i in range(1, 500):
        copy = list(base)
        for k in rng.sample(range(0, 100, 5), rng.choice([1, 2, 3, 3, 3, 4])):
            copy[k + 2] = f"own{i}x{k}"
        rows.append((i, " ".join(copy + (["more"] if i % 7 == 0 else []))))
    sets = {i: shingles(t) for i, t in rows}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs, threshold=threshold).collect()}
    kept, whole = threshold
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if whole * len(sets[a] & sets[b]) >= kept * len(sets[a] | sets[b])]
    root = dict(zip(sets, sets))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert got == {i: find(i) for i in sets}
    # Every document a member of a component of its own but those linked with the base.
    members = spark.createDataFrame([(i, find(i)) for i in sets], "id long, component long")
    pairs = neardup.prefix_pairs(members, neardup.full_sets(docs, members.select("id")), threshold)
    assert pairs.count() < 5 * len(rows)


def test_prefix_pairs_lose_no_pair(spark, prose):
    rng = random.Random(10)
    rows = []
    for g in range(12):
        base = prose(800 + g, rng.randint(60, 200)).split()
        for i in range(12):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(["changed", "other", f"w{i}"])
            rows.append((100 * g + i, " ".join(copy[rng.randint(0, 2) : len(copy) - rng.randint(0, 2)])))
    sets = {i: shingles(t) for i, t in rows}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    members = spark.createDataFrame([(i, i if i % 3 else 7) for i in sets], "id long, component long")
    component = {i: i if i % 3 else 7 for i in sets}
    for kept, whole in (neardup.THRESHOLD, (1, 2), (1, 1)):
        pairs = {(r.a, r.b) for r in neardup.prefix_pairs(members, neardup.full_sets(docs, members.select("id")), (kept, whole)).collect()}
        near = {(b, a) for a, b in itertools.combinations(sorted(sets), 2) if component[a] != component[b] and whole * len(sets[a] & sets[b]) >= kept * len(sets[a] | sets[b])}
        assert near and near <= pairs


def test_long_words_that_defeat_polynomials_differ(spark):
    word = "a"
    for _ in range(11):
        word += word.translate(str.maketrans("ab", "ba"))
    rows = [(1, word), (2, word.translate(str.maketrans("ab", "ba")))]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.component_id for r in got.collect()} == {1, 2}


def test_odd_sketches_estimate_high_similarities(spark):
    rng = np.random.default_rng(3)
    pairs = []
    for share in (0.05, 0.1, 0.2):
        a = mix64(rng.integers(0, 1 << 60, 600).astype(np.uint64))
        b = np.concatenate([a[int(600 * share) :], mix64(rng.integers(0, 1 << 60, int(600 * share)).astype(np.uint64))])
        sketch = [neardup.odd_sketch(neardup.minhash(x)).view(np.int64).tolist() for x in (a, b)]
        pairs.append((*sketch, len(np.intersect1d(a, b)) / len(np.union1d(a, b))))
    df = spark.createDataFrame(pairs, "a array<long>, b array<long>, truth double")
    for r in df.select(neardup.sketch_similarity("a", "b").alias("s"), "truth").collect():
        assert abs(r.s - r.truth) < 0.12


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r.id: r.component for r in neardup.components(links).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100}


def test_the_stage_drops_from_four_fifths_and_the_query_from_its_contract(spark, prose):
    # Copies with a few scattered words changed, at similarities from 0.7 to 0.95.
    rows, near = [], 0
    for i in range(24):
        base = prose(600 + i, 500).split()
        copy = list(base)
        for k in range(3 + i // 2):
            copy[10 + 31 * k] = f"changed{i}x{k}"
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(copy))]
        near += 0.8 <= similarity(shingles(rows[-1][1]), shingles(rows[-2][1])) < 0.85
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in neardup.drop_near_duplicates(spark, docs, "").collect()}
    sets = {i: shingles(t) for i, t in rows}
    assert near >= 3
    assert kept == {i for i in sets if i % 2 == 0 or similarity(sets[i], sets[i - 1]) < 0.8}
    asked = {r.doc_id for r in neardup.near_duplicates(docs).where("kept").collect()}
    assert asked == {i for i in sets if i % 2 == 0 or similarity(sets[i], sets[i - 1]) < 0.85}


def test_bands_and_slack_follow_the_threshold():
    assert [neardup.bands_for(t) for t in (neardup.THRESHOLD, neardup.STAGE_THRESHOLD)] == [24, 36]
    for kept, whole in ((85, 100), (80, 100), (1, 2)):
        assert (1 - (kept / whole) ** neardup.ROWS) ** neardup.bands_for((kept, whole)) <= neardup.MISS
    assert neardup.slack_for(neardup.THRESHOLD) == 0.2


@pytest.mark.parametrize("other", [14, 104])
def test_an_id_with_several_texts_is_compared_by_each(spark, prose, other):
    # Every bucket of 100 and 101 has a smaller document that is near neither and is its hub as well,
    # so that only the last round can link the two.
    base = prose(700, 104).split()
    rows = [(101, " ".join(base)), (100, " ".join([*base[:-1], "changed"])), (100, prose(701, other))]
    for i in range(40):
        copy = list(base)
        copy[5 + i], copy[55 + i] = f"one{i}", f"two{i}"
        rows += [(i, " ".join(copy)), (i, prose(710 + i, 9))]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    rows_of = Counter(map(tuple, got.collect()))
    assert rows_of == plain_components(rows)
    assert (101, 100, 100, False) in rows_of
