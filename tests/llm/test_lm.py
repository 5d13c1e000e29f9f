import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tapeworks.llm import lm


def tokens(t):
    return re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()) + [b"\n"]


def corpus(n=200):
    rng = random.Random(0)
    pairs = {"the": ["cat", "dog"], "a": ["bird", "fish"]}
    rows = []
    for i in range(n):
        w = []
        for _ in range(rng.randint(3, 30)):
            first = rng.choice(sorted(pairs))
            w += [first, rng.choice(pairs[first]), rng.choice(["runs", "sits", f"n{rng.randrange(400)}"])]
        rows.append((i, " ".join(w).title()))
    return rows


@pytest.mark.parametrize("own, counted", [(lm.LEAST_OWN, lm.COUNTED), (10, 25), (0, 0)])
def test_counts_scores_and_edges(spark, tmp_path, monkeypatch, own, counted):
    monkeypatch.setattr(lm, "own_words", lambda n: own)
    monkeypatch.setattr(lm, "COUNTED", counted)
    rows = corpus() + [(900, None), (901, ""), (902, "Unseen zzz"), (None, "the cat"), (7, "the dog"), (7, "the dog"), (903, "the cat sits " * 30_000)]
    spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, n string, row int").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = lm.op5_lm_score(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    counts = Counter()
    for i, t in rows:
        if i is not None and zlib.crc32(str(i).encode()) % 5 != 1:
            counts.update(tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(i), len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), round(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t)), 4)) for i, t in rows)
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 4)) for r in got) == want
    assert all(r.train_tokens == n and r.score < 0 for r in got)
    if own > 10:
        held = [r for r in got if r.held_out]
        size = sum(r.n_tokens for r in held)
        assert sum(r.score for r in held) > sum(r.base_score for r in held) + 0.15 * size  # context helps


def naive(params, shape, before, last):
    """Probability of every id after a context, by plain loops."""
    context, ids, classes, moves = shape.parts(params.astype(np.float64))
    query = context[before] @ moves[0] + context[last] @ moves[1]
    out = np.zeros(shape.ids)
    whole = np.array([math.exp(query @ c[:-1] + c[-1]) for c in classes])
    for c in range(shape.classes):
        mine = [i for i in range(c * shape.size, min((c + 1) * shape.size, shape.ids)) if i != lm.START]
        inside = [math.exp(query @ ids[i][:-1] + ids[i][-1]) for i in mine]
        for i, x in zip(mine, inside):
            out[i] = whole[c] / whole.sum() * x / sum(inside)
    return out


def test_log_probabilities_are_normalised_and_those_of_plain_loops():
    rng = np.random.default_rng(0)
    shape = lm.Shape(40)
    params = rng.normal(0, 0.7, (shape.rows, lm.WIDTH + 1)).astype(np.float32)
    for before, last in ((0, 0), (0, 5), (17, 17), (shape.ids - 1, 1)):
        want, every = naive(params, shape, before, last), np.arange(1, shape.ids)
        got = 10 ** lm.log_shares(params, shape, np.full(len(every), before), np.full(len(every), last), every)
        assert abs(got.sum() - 1) < 1e-5 and np.allclose(got, want[1:], rtol=1e-3)


def test_scores_by_brute_force(spark, tmp_path, monkeypatch):
    """The whole query against plain loops, for parameters that are given."""
    kept = {}

    def given(texts, words, counts, shape, total):
        kept.update(words=words, shape=shape, params=np.random.default_rng(1).normal(0, 0.5, (shape.rows, lm.WIDTH + 1)).astype(np.float32))
        return kept["params"]

    monkeypatch.setattr(lm, "trained", given)
    monkeypatch.setattr(lm, "own_words", lambda n: 12)
    monkeypatch.setattr(lm, "COUNTED", 30)
    rows = corpus(60) + [(900, None), (901, "Unseen the zzz")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.score for r in lm.op5_lm_score(spark, str(tmp_path)).collect()}
    counts = Counter(w for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1 for w in tokens(t))
    shape, own = kept["shape"], {b"\n": lm.END} | {w: lm.FIRST + i for i, w in enumerate(kept["words"])}
    assert kept["words"] == [w for w, _ in sorted(((w, n) for w, n in counts.items() if w != b"\n"), key=lambda x: (-x[1], x[0]))][:12]
    tails = Counter()
    for w, n in counts.items():
        if w not in own:
            tails[lm.tail(w)] += n + 0.5
    for i, t in rows:
        before, last, want = lm.START, lm.START, 0.0
        for w in tokens(t):
            now = own.get(w, lm.FIRST + 12 + lm.tail(w))
            want += math.log10(naive(kept["params"], shape, before, last)[now])
            if w not in own:
                want += math.log10((counts[w] + 0.5) / (tails[lm.tail(w)] + 0.5))
            before, last = last, now
        assert abs(got[i] - want) < 1e-3 * max(1, abs(want)), i


def test_training_is_shared_by_workers_and_averaged_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(lm, "FAN", 2)
    texts = [(t.lower().encode(), k % 2) for k, (_, t) in enumerate(corpus(400))]
    counts = Counter(w for t, _ in texts for w in lm.tokens(t))
    words = [w for w, _ in counts.most_common() if w != b"\n"][:8]
    shape = lm.Shape(8)
    n = np.array([0, counts[b"\n"], *(counts[w] for w in words), *np.bincount([lm.tail(w) for w in counts.elements() if w not in words and w != b"\n"], minlength=lm.TAILS)], float)
    df = spark.createDataFrame(texts, "text binary, turn int").repartition(5)
    params = lm.trained(df, words, n, shape, int(n.sum()), rounds=2)
    places = {w: lm.FIRST + i for i, w in enumerate(words)}
    the, cat, dog, bird = (places[w] for w in (b"the", b"cat", b"dog", b"bird"))
    after = naive(params, shape, lm.START, the)
    assert after[cat] + after[dog] > 0.4 and min(after[cat], after[dog]) > 4 * after[bird]  # unigrams: about 0.08 each
    assert (lm.fresh(n, shape) != params).any() and lm.trained(df.limit(0), words, n, shape, 0, rounds=1).shape == params.shape


def test_nothing_to_learn_from(spark, tmp_path):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    spark.createDataFrame([(held, "some words")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    (r,) = lm.op5_lm_score(spark, str(tmp_path)).collect()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (3, 0, 0, True) and math.isfinite(r.score)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert lm.op5_lm_score(spark, str(tmp_path)).count() == 0


def test_every_position_of_the_training_texts_is_learned_from(spark, monkeypatch):
    texts = [(" ".join(f"w{k}x{j}" for j in range(k % 50)).encode(), k % 3) for k in range(120)]
    total = sum(len(lm.tokens(t)) for t, _ in texts)
    rows = spark.createDataFrame(texts, "text binary, turn int").repartition(4)
    collect, weights = type(rows).toArrow, []

    def kept(self):
        out = collect(self)
        whole = b"".join(out.sort_by("piece").column("payload").to_pylist())
        weights.append(np.frombuffer(whole, np.float32).reshape(-1, lm.WIDTH + 2)[-1, -1])
        return out

    monkeypatch.setattr(type(rows), "toArrow", kept)
    # The matrices' last row weighs as many positions as moved it, in each round.
    lm.trained(rows, [b"the"] * 8, np.concatenate([[0, 120.0], np.ones(8 + lm.TAILS)]), lm.Shape(8), total)
    assert len(weights) == 3 and round(float(sum(weights))) == total
