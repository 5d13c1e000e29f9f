import random

from tapeworks.llm import importance


def test_kth_largest(spark):
    rng = random.Random(0)
    for values in ([rng.gauss(0, 100) for _ in range(500)], [1.0] * 20 + [2.0] * 5, [5.0], [1e-300, 1e300, -1e300, 0.0]):
        df = spark.createDataFrame([(v,) for v in values], "v double")
        ordered = sorted(values, reverse=True)
        for k in {1, 2, len(values) // 2, len(values) - 1}:
            if 0 < k < len(values):
                assert importance.kth_largest(df, "v", k) == ordered[k - 1]
        assert importance.kth_largest(df, "v", len(values)) == float("-inf")
        assert importance.kth_largest(df, "v", 0) == float("inf")


def data(spark, tmp_path, docs, labels):
    spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'c' AS key", "1 AS good").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return importance.op6_importance(spark, str(tmp_path))


def test_junk_goes_and_good_texts_stay(spark, tmp_path):
    rng = random.Random(1)
    text = lambda good: " ".join(rng.choice("river mill stone water bread".split() if good else "click buy now win cash".split()) for _ in range(rng.randint(20, 80)))
    docs = [(i, text(i % 5 > 0)) for i in range(400)]
    out = data(spark, tmp_path, docs, [(i, int(i % 5 > 0), 0) for i in range(100)] + [(1, 1, 0), (None, 1, 0)]).collect()
    kept = {r.doc_id for r in out if r.kept}
    assert len(out) == 400 and abs(len(kept) - 320) <= 5
    assert sum(i % 5 > 0 for i in kept) >= 0.98 * len(kept)


def test_edges(spark, tmp_path):
    out = data(spark, tmp_path, [(1, None), (2, ""), (3, "a"), (3, "a"), (None, "b c"), (4, "w " * 100_000)], []).collect()
    assert all(r.kept for r in out) and {r.n_features for r in out} == {0, 1, 3, 199_999}
    assert {r.log_weight for r in out} == {0.0}
    assert len({r.key for r in out if r.doc_id == 3}) == 1  # repeated rows share their fate


def test_empty(spark, tmp_path):
    assert data(spark, tmp_path, [], []).count() == 0


def test_noise_is_gumbel(spark):
    import numpy as np

    docs = spark.createDataFrame([(i, "x") for i in range(4_000)], "doc_id long, text string")
    keys = np.array([r.key for r in importance.weighed(docs, np.zeros(importance.BUCKETS)).collect()])
    assert abs(keys.mean() - 0.5772) < 0.08 and abs(keys.std() - 1.2825) < 0.08


def test_kth_among_fewer_floats_than_bins(spark):
    import math

    v, values = 1.0, []
    for i in range(300):
        values += [v] * (1 + i % 3)
        v = math.nextafter(v, 2)
    df, ordered = spark.createDataFrame([(x,) for x in values], "v double"), sorted(values, reverse=True)
    for k in (1, 2, 77, 301, len(values) - 1):
        assert importance.kth_largest(df, "v", k) == ordered[k - 1]


def test_weights_by_brute_force(spark):
    import math
    import zlib
    from collections import Counter

    rng = random.Random(4)
    docs = [(i, " ".join(rng.choices(["Mill", "oat", "rye", "é", "x1"], k=rng.randint(0, 12))), rng.random() < 0.4) for i in range(80)] + [(80, None, True)]

    def buckets(t):
        h = [zlib.crc32(w) for w in (t or "").encode().lower().split()]
        mask = 2**64 - 1
        return [((a * 0x9E3779B97F4A7C15) & mask) >> 40 for a in h] + [((a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F) & mask) >> 40 for a, b in zip(h, h[1:])]

    raw = Counter(b % importance.BUCKETS for _, t, _ in docs for b in buckets(t))
    good = Counter(b % importance.BUCKETS for _, t, g in docs if g for b in buckets(t))
    share = lambda c, b: (c[b] + 0.5) / (sum(c.values()) + 0.5 * importance.BUCKETS)
    df = spark.createDataFrame(docs, "doc_id long, text string, good boolean")
    got = {r.doc_id: r for r in importance.weighed(df, importance.learn(df)).collect()}
    for i, t, _ in docs:
        own = [b % importance.BUCKETS for b in buckets(t)]
        want = sum(math.log(share(good, b) / share(raw, b)) for b in own)
        assert got[i].n_features == len(own) and abs(got[i].log_weight - want) < 1e-9
