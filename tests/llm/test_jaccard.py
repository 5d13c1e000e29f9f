import random

import numpy as np
import pytest

from tapeworks.llm import components, jaccard


def brute(rows, size=4, percent=85):
    """{row number: (set size, smallest id reachable)}"""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        n = min(size, len(w))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                root[find(i)] = find(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[find(i)] = min(ids.get(find(i), d), d)
    return sorted(((d, len(s), ids.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def corpus(seed, n=60):
    """Texts with chains of near copies, exact copies and shared passages."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = rng.choices(words, k=40)
    rows = []
    for _ in range(n):
        kind = rng.random()
        if rows and kind < 0.5 and rows[-1][1]:
            w = rng.choice(rows)[1].split()
            for _ in range(rng.choice([0, 1, 1, 2, 6])):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(words)
        else:
            w = rng.choices(words, k=rng.choice([1, 2, 3, 4, 9, 30, 120, 300]))
            if kind > 0.7:
                w = passage + w
        rows.append((len(rows) * 3 + 5, " ".join(w)))
    return rows


def result(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id").collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(documents, seed):
    rows = corpus(seed)
    assert result(jaccard.linked(documents(rows))) == brute(rows)


def test_cut_groups(documents, monkeypatch):
    """Chunks of three sets and small blocks: pivots and open pairs decide."""
    monkeypatch.setattr(jaccard, "CHUNK_SETS", 3)
    rng, base = random.Random(9), [f"v{i}" for i in range(200)]
    rows, w = [], list(base)
    for i in range(24):  # a drifting chain: neighbours link, the ends don't
        w = list(w)
        w[rng.randrange(200)] = f"x{i}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, t) for i, t in enumerate(t for _, t in corpus(4, 20))]
    assert result(jaccard.linked(documents(rows))) == brute(rows)


def test_large_groups_with_few_links(documents, monkeypatch):
    """More pivots than a block: they meet by signature, in blocks of a signature too."""
    monkeypatch.setattr(jaccard, "CHUNK_SETS", 4)
    rng, rows = random.Random(3), []
    base = [f"b{i}" for i in range(260)]
    for i in range(36):  # about half in common: candidates that don't link
        w = list(base)
        at = rng.randrange(0, 130)
        w[at : at + 110] = [f"x{i}_{k}" for k in range(110)]
        rows.append((i, " ".join(w)))
        if i % 4 == 0:
            w[rng.randrange(260)] = "zz"
            rows.append((100 + i, " ".join(w)))
    rng.shuffle(rows)
    assert result(jaccard.linked(documents(rows))) == brute(rows)


def test_hot_signatures(documents, monkeypatch):
    monkeypatch.setattr(jaccard, "SAMPLED", 1)
    monkeypatch.setattr(jaccard, "LEAST_SEEN", 3)
    rows = corpus(5)
    assert result(jaccard.linked(documents(rows))) == brute(rows)


def test_a_set_of_many_tasks_counts_once(spark, documents):
    """Every task gives the signatures of a copy; each is kept once."""
    rng = random.Random(7)
    base = [f"c{i}" for i in range(120)]
    texts = [" ".join(base), " ".join([*base[:60], "x", *base[61:]]), *(" ".join(rng.choices(base, k=80)) for _ in range(3))]
    df = documents([(i, t) for i, t in enumerate(texts * 12)]).repartition(9).selectExpr("doc_id AS id", "doc_id AS row_key", "cast(text AS binary) AS text")
    signed = jaccard.common.stored(df.mapInArrow(jaccard._describe(4, 85), jaccard._SIGNED))
    assert signed.where("signs IS NOT NULL").count() > len(texts)
    shared = jaccard._candidates(signed, jaccard.common.shared_dir(spark))
    assert shared.count() == shared.select("set_key", "sign").distinct().count() > 0


def test_equal_keys_of_different_sets(documents, monkeypatch):
    """Only a few keys are left, so most are shared by different sets."""
    rows = corpus(6, 40)
    real = jaccard.told_apart

    def poor(signed, path):
        key = jaccard.F.when(jaccard.F.col("set_key").isNotNull(), jaccard.F.pmod("set_key", jaccard.F.lit(5)))
        fewer = signed.withColumn("set_key", key.cast("long"))
        return real(jaccard.common.stored(fewer), path)

    monkeypatch.setattr(jaccard, "told_apart", poor)
    assert result(jaccard.linked(documents(rows))) == brute(rows)


def test_sets_that_fill_too_few_ranges():
    """All hashes in one range: the first hashes in the global order are shared."""
    rng = np.random.default_rng(2)
    for n in (2, 7, 30, 200):
        pool = np.unique(rng.integers(0, 2**20, 3 * n, dtype=np.uint64))
        for _ in range(20):
            a = np.sort(rng.permutation(pool)[:n])
            b = np.unique(np.concatenate([rng.permutation(a)[max(1, n // 15) :], rng.permutation(pool)[:max(1, n // 30)]]))
            both = len(np.intersect1d(a, b))
            if 100 * both >= 85 * (len(a) + len(b) - both):
                assert set(jaccard.signatures(a)[0].tolist()) & set(jaccard.signatures(b)[0].tolist())


def test_edges(spark, documents):
    long = " ".join(f"l{i % 977}x{i % 31}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "a b c"), (9, "A B c"), (5, "a b c d"), (None, "a b c d"), (None, None), (7, long), (6, long + " end"), (8, "x y z q r"), (8, "x y z q r"), (8, "other words here now")]
    assert result(jaccard.linked(documents(rows))) == brute(rows)
    extra = documents(rows).selectExpr("*", "1 AS n_shingles", "'x' AS root", "2 AS set_key")
    assert result(jaccard.linked(extra)) == brute(rows)
    assert result(jaccard.linked(documents([]))) == []


def test_copies_and_a_common_passage(documents):
    rng = random.Random(2)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, "same text over and over again " * 3) for i in range(50)]
    rows += [(100 + i, f"{passage} " + " ".join(f"u{i}_{j}" for j in range(30))) for i in range(80)]
    rng.shuffle(rows)
    assert result(jaccard.linked(documents(rows))) == brute(rows)


def test_prefix_tree_against_pairs():
    rng = np.random.default_rng(0)
    for _ in range(60):
        pool = rng.integers(0, 2**63, 60, dtype=np.uint64)
        sets = [np.unique(rng.choice(pool, rng.integers(1, 60))) for _ in range(rng.integers(1, 25))]
        sets += [np.unique(np.append(s, rng.integers(0, 2**63, 1, dtype=np.uint64))) for s in sets[:8]]
        roots = jaccard.Group(sets).join()
        want = list(range(len(sets)))
        for i in range(len(sets)):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                    a, b = want[i], want[j]
                    want = [b if x == a else x for x in want]
        assert len(set(zip(roots.tolist(), want))) == len(set(want)) == len(set(roots.tolist()))


def test_linked_sets_share_what_they_may_not_leave_out():
    rng = np.random.default_rng(1)
    for _ in range(300):
        a = np.unique(rng.integers(0, 2**64, int(rng.integers(2, 900)), dtype=np.uint64))
        loss = int(rng.integers(0, max(1, int(len(a) * 0.15)) + 1))
        b = np.unique(np.concatenate([a[rng.permutation(len(a))[loss:]], rng.integers(0, 2**64, int(rng.integers(0, 2 + len(a) // 12)), dtype=np.uint64)]))
        both = len(np.intersect1d(a, b))
        if len(b) == 0 or 100 * both < 85 * (len(a) + len(b) - both):
            continue
        best = 0
        for one, other in ((a, b), (b, a)):
            signs, cuts = jaccard.signatures(one)
            theirs, at = set(jaccard.signatures(other)[0].tolist()), 0
            for n, shares in zip(cuts[::2], cuts[1::2]):
                if len(theirs & set(signs[at : at + n].tolist())) >= shares:
                    best += 1
                at += n
        assert best >= 2


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1100)]
    root = {n: n for e in edges for n in e}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    want = {n: find(n) for n in root if any(a != b and n in (a, b) for a, b in edges)}
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("few", [0, 1 << 17])
def test_components_take_no_round_more_than_they_need(spark, monkeypatch, few):
    written, stored = [], components.common.stored
    monkeypatch.setattr(components, "FEW", few, raising=False)
    monkeypatch.setattr(components.common, "stored", lambda df, path=None: written.append(path) or stored(df, path))
    stars = [(i, i % 7) for i in range(7, 300)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(stars, "a long, b long")).collect()}
    assert got == {i: i % 7 for i in range(300)}
    assert len(written) == 2  # the first step alone: its minima and its edges
    written.clear()
    path = [(i, i + 1) for i in range(40)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert got == dict.fromkeys(range(41), 0)
    rounds = {p.rsplit("/", 1)[-1] for p in written} - {"small0"}
    assert not few or all(name.isdigit() for name in rounds)  # small graphs: one table a round
