import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tapeworks.llm import packing
from tapeworks.llm.tokens import tokenizer_file

FILE = tokenizer_file("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(FILE)


def test_ids_are_the_library_s(library):
    rng = random.Random(3)
    parts = ["the", "a", "I'm", " ", "\n", "\t", "é", "<|endoftext|>", "漢字", "12", ".", "'s", " x", "don't", "\r\n", "😀", "ſ", "'S", "<|x|>", "\x00", " ", " "]
    enc = packing.encoder(FILE)
    for _ in range(3_000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert enc.ids(t).tolist() == library.encode(t, add_special_tokens=False).ids, t


def check(spark, library, rows, shard_docs):
    df = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, shard string")
    got = packing.packed(df, FILE, shard_docs=shard_docs).collect()
    ids = {i: [*library.encode(t or "", add_special_tokens=False).ids, 0] for i, t in rows}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
        own = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")
        assert r.ids_crc32 == zlib.crc32(own.tobytes()) and r.doc_tokens == len(ids[r.doc_id]) and r.length > 0
    for parts in (*sequences.values(),):
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 1024 or at < 1024 and at & (at - 1) == 0
    return pieces, ids


def test_every_id_lies_in_one_piece(spark, library):
    rng = random.Random(0)
    words = [f"{a}{b}" for a in ("lo", "ta", "mi", "ren") for b in ("x", "na", "tion", "er", "s")]
    rows = [(i, " ".join(rng.choices(words, k=rng.choice([0, 1, 5, 300, 2_000])))) for i in range(80)]
    rows += [(500, None), (501, ""), (502, "word " * 30_000)]
    for shard_docs in (3_000, 9):
        pieces, ids = check(spark, library, rows, shard_docs)
        assert set(pieces) == set(ids)
        for i, parts in pieces.items():
            at = 0
            for start, length in sorted(parts):
                assert start == at
                at += length
            assert at == len(ids[i])


def test_repeated_rows_null_ids_and_no_rows(spark, library):
    pieces, ids = check(spark, library, [(1, "same text"), (1, "same text"), (None, "x y z")], 3_000)
    assert sorted(pieces[1])[0][0] == 0 and sum(n for _, n in pieces[1]) == 2 * len(ids[1])
    assert packing.packed(spark.createDataFrame([], "doc_id long, text string"), FILE).count() == 0


def test_neighbours_share_words():
    """Windows are filled with texts on the seed's subject."""
    rng = np.random.default_rng(0)
    docs = [rng.integers(1_000 * (i % 4), 1_000 * (i % 4) + 60, 200).astype("<u2") for i in range(80)]
    full = [w for w in packing.pack_shard(docs) if sum(s for _, _, s in w) == 1024]
    same = np.mean([len({d % 4 for d, _, _ in w}) == 1 for w in full])
    assert len(full) == 80 * 200 // 1024 and same >= 0.7


def test_powers_of_two():
    out = packing.in_powers([(0, 5, 700), (1, 0, 301)])
    assert [sum(s for _, _, s in w) for w in out] == [512, 256, 128, 64, 32, 8, 1]
    assert [p for w in out for p in w if p[0] == 0] == [(0, 5, 512), (0, 517, 188)]


def test_related_documents_share_windows_at_every_size(spark):
    """Documents on a subject meet though the table holds many shards of others."""
    rng, rows = random.Random(4), []
    vocabulary = [[f"{a}{b}{s}" for a in ("lo", "ta", "mi") for b in ("x", "na", "er", "q")] for s in range(40)]
    for i in range(1_200):  # 40 subjects, one after another in the table's order
        rows.append((i, " ".join(rng.choices(vocabulary[i % 40], k=60))))
    got = packing.packed(spark.createDataFrame(rows, "doc_id long, text string"), FILE, shard_docs=60).collect()
    windows = defaultdict(list)
    for r in got:
        windows[r.sequence_id].append(r.doc_id % 40)
    mixed = [len(w) > 1 and w.count(max(set(w), key=w.count)) / len(w) for w in windows.values() if len(w) > 1]
    assert np.mean(mixed) >= 0.8


def test_statistics_and_query_are_whole():
    docs = [np.arange(i, i + 40).astype("<u2") for i in range(0, 100, 2)]
    stats = packing.Statistics.of(docs)
    index = packing.Index(docs, stats)
    assert max(map(len, index.query)) > 16 and np.isclose(stats.mean, 40)
    rare = np.zeros(packing.TERMS, np.int64)
    rare[:200] = 3  # in the whole table; in this shard more than half hold some
    same = [np.array([1, 2, 3, 100 + i], "<u2") for i in range(9)]
    assert set(packing.Index(same, packing.Statistics(rare, 10_000, 4.0)).query[0]) == {1, 2, 3}


def test_tree_keeps_neighbours_and_splits_copies(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(8, packing.WIDTH))
    points = (np.repeat(centres, 100, 0) + rng.normal(0, 0.01, (800, packing.WIDTH))).astype(np.float32)
    leaves = packing.Tree(points, 8).leaves(points).reshape(8, 100)
    assert len(np.unique(leaves)) == 8 and all(len(np.unique(x)) <= 2 for x in leaves)
    assert len(np.unique(packing.Tree(points[:1].repeat(50, 0), 8).leaves(points))) == 1
    copies = packing.packed(spark.createDataFrame([(i, "the same words") for i in range(500)], "doc_id long, text string"), FILE, shard_docs=10).collect()
    assert sorted(r.doc_id for r in copies if r.start == 0) == list(range(500)) and len({r.sequence_id for r in copies}) >= 25


def test_neighbours_by_brute_force():
    """BM25 of every pair by its formula; equal scores in order of number."""
    import math

    rng = np.random.default_rng(6)
    docs = [rng.integers(0, 90, int(rng.integers(1, 60))).astype("<u2") for _ in range(70)] + [np.array([7, 8, 9], "<u2")] * 4
    stats, n = packing.Statistics.of(docs), len(docs)
    index = packing.Index(docs, stats)
    index.used[[5, 9]] = True
    df = {t: sum(t in d for d in docs) for t in range(90)}
    mean = sum(map(len, docs)) / n
    for seed in (0, 3, 20, 70, 73):
        want = {}
        for j, d in enumerate(docs):
            score = 0.0
            for t in set(docs[seed].tolist()):
                tf, idf = int((d == t).sum()), math.log((n - df[t] + 0.5) / (df[t] + 0.5)) if df[t] else 0.0
                if tf and idf > 0 and df[t] > 1:
                    score += idf * tf * (packing.K1 + 1) / (tf + packing.K1 * (1 - packing.B + packing.B * len(d) / mean))
            if score > 0 and j not in (5, 9):
                want[j] = score
        got = list(index.neighbours(seed))
        assert sorted(got) == sorted(want)
        assert all(want[a] > want[b] - 1e-5 for a, b in zip(got, got[1:]))
    copies = [j for j in index.neighbours(70) if j >= 70]
    assert copies == [70, 71, 72, 73]


def test_sequence_ids_fit():
    top = 2**63
    assert 0 <= packing.window_id(2**26 - 1, 2**36 - 1) < packing.shard_sequence_id(2**46 - 1, 2**16 - 1) < top
    assert packing.window_id(3, 5) % 2 == 0 and packing.shard_sequence_id(3, 5) % 2 == 1 and packing.shard_sequence_id(3, 2**16 - 1) < packing.shard_sequence_id(4, 0)


def test_clashing_columns_are_left_out(spark):
    rows = spark.createDataFrame([(1, "some words", 5, "x", 9)], "doc_id long, text string, start long, ids string, leaf long")
    assert packing.packed(rows, FILE).columns == list(packing.PIECE)


def test_texts_without_spaces_in_a_row_take_the_pattern_without_look_ahead(library):
    rng = random.Random(8)
    spaces = [*" \t\n\r\x0b\x0c\x1c\x1f\x85\xa0", " ", " ", " ", " ", "　", "​"]
    words = ["the", "I'm", "é", "12", "...", "<|endoftext|>", "漢字", "'ll", "_"]
    enc, ways = packing.encoder(FILE), defaultdict(int)
    for k in range(4_000):
        t = "".join(rng.choice(spaces if k % 2 else [" ", "\n", "\t"]) * (rng.random() < 0.9) + rng.choice(words) for _ in range(rng.randint(0, 8)))
        t += rng.choice(["", " ", "\n", "\n\n", " \xa0 x"])
        ways[packing.spaces_in_a_row(t)] += 1
        assert enc.ids(t).tolist() == library.encode(t, add_special_tokens=False).ids, t
    assert min(ways.values()) > 500 and not packing.spaces_in_a_row("a b\nc é d") and packing.spaces_in_a_row("é 　")


def test_placed_remainders_leave_the_postings():
    rng = np.random.default_rng(4)
    docs = [rng.integers(1, 60, rng.integers(5, 40)).astype("<u2") for _ in range(200)]
    stats = packing.Statistics.of([*docs, *(np.array([k]) for k in range(100, 400))])
    index, whole = packing.Index(docs, stats), packing.Index(docs, stats)
    size = len(index.owner)
    index.used[:] = whole.used[:] = rng.random(200) < 0.7
    whole.live = 0  # never dropped
    for seed in range(0, 200, 7):
        assert [*index.neighbours(seed)] == [*whole.neighbours(seed)]
    assert len(index.owner) < 0.5 * size and not index.used[index.owner].any()
