import itertools
import re
from collections import Counter

import numpy as np
from pyspark.sql import Row

from tapeworks.llm import crf, quality


def base(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    often = Counter(windows)
    hit = {j for i, x in enumerate(windows) if often[x] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(w) < 10 or 100 * len(hit) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), failed


PROSE = "The river ran past the old mill and the miller looked out over it. Nobody came that day, and so he slept."
MENU = "home | login | cart\nabout | help | terms\n$ & # | * | >"
EDGES = [None, "", " \t\n", "one", PROSE, MENU, f"{PROSE}\n{PROSE}\n{PROSE}", "a b c d e f\na b c d e x", "é漢 x y " * 30, "\x1cq \x85 z\x0bw\x0cv\rend\n", "x y " * 50_000, "\n".join(f"line {i} of many" for i in range(9_000)), " ".join(f"w{i}" for i in range(8_000)) + " w1 w2 w3 w4 w5 w6"]


def table(spark, texts):
    return spark.createDataFrame([Row(doc_id=i, text=t, kept="k", n_words="n") for i, t in enumerate(texts)], "doc_id long, text string, kept string, n_words string")


def test_base_statistics(spark):
    got = {r.doc_id: r for r in quality.judged(table(spark, EDGES + EDGES[:4]), None).collect()}
    assert len(got) == len(EDGES) + 4
    for i, t in enumerate(EDGES + EDGES[:4]):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(t), t
        assert r.kept == (not r.base_failed)
    assert quality.judged(table(spark, []), None).count() == 0


def test_repeats_in_a_text_of_many_words():
    """More distinct words than fit into one key together."""
    w = [b"%d" % (i % 9_000) for i in range(9_500)]
    assert quality.repeated_words(w) == base(b" ".join(w).decode())[4]


def test_crf_tells_menus_from_prose(spark, tmp_path):
    docs = [(i, f"{PROSE} It was day {i}.\nSomeone else walked by the {i} wells and sat down under a tree." if i % 2 else f"x{i} | {MENU}") for i in range(200)]
    spark.createDataFrame([*docs, (500, None), (None, PROSE)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, i % 2, 0) for i in range(0, 100)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = {r.doc_id: r for r in quality.op4_line_labels(spark, str(tmp_path)).collect()}
    assert len(got) == 202
    held_out = [got[i] for i in range(100, 200)]
    assert all(r.kept == bool(r.doc_id % 2) for r in held_out) and all(0 <= r.content_share <= 1 for r in held_out)


def test_fit_without_labels(spark):
    docs = spark.createDataFrame([(1, PROSE)], "doc_id long, text string")
    assert quality.fit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")) is None


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(0)
    chain = crf.Chain(rng.normal(size=(2, 3)), rng.normal(size=(3, 3)), rng.normal(size=3))
    scores = [rng.normal(size=(n, 3)) for n in (1, 4, 0, 6, 2)]
    for s, found in zip(scores, crf.viterbi(chain, scores)):
        value = lambda p: chain.first[p[0]] + sum(s[i, k] for i, k in enumerate(p)) + sum(chain.moves[a, b] for a, b in zip(p, p[1:]))  # noqa: E731, B023
        best = max(itertools.product(range(3), repeat=len(s)), key=value) if len(s) else ()
        assert tuple(found) == best


def test_gradient_is_observed_minus_expected():
    rng = np.random.default_rng(1)
    chain = crf.Chain(rng.normal(size=(2, 2)), rng.normal(size=(2, 2)), rng.normal(size=2))
    xs, ys = [rng.normal(size=(n, 2)) for n in (3, 1, 4)], [rng.integers(0, 2, n) for n in (3, 1, 4)]

    def likelihood(c):
        out = 0.0
        for x, y in zip(xs, ys):
            s = x @ c.weights
            value = lambda p: c.first[p[0]] + sum(s[i, k] for i, k in enumerate(p)) + sum(c.moves[a, b] for a, b in zip(p, p[1:]))  # noqa: E731, B023
            out += value(y) - np.log(sum(np.exp(value(p)) for p in itertools.product(range(2), repeat=len(y))))
        return out

    weights, moves, first = crf._gradient(chain, xs, ys)
    for grad, name in ((weights, "weights"), (moves, "moves"), (first, "first")):
        for at in np.ndindex(grad.shape):
            parts = {k: getattr(chain, k).copy() for k in ("weights", "moves", "first")}
            parts[name][at] += 1e-5
            up = likelihood(crf.Chain(**parts))
            parts[name][at] -= 2e-5
            assert abs((up - likelihood(crf.Chain(**parts))) / 2e-5 - grad[at]) < 1e-4


def test_variety_is_of_the_whole_line():
    varied, poor = [b"w%d" % i for i in range(400)], [b"p%d" % (i * i % 7) for i in range(4_000)]
    low = quality.features([b" ".join(varied + poor)])[0, -2:]
    high = quality.features([b" ".join(poor[:400] + [b"v%d" % i for i in range(4_000)])])[0, -2:]
    assert low[0] < 0.3 and low[1] == 1 and high[0] > 0.8 and high[1] == 0
    assert quality.spread(varied) == 1 and quality.spread(varied * 5) == 1 and quality.spread([]) == 0
    assert quality.spread([b"a", b"b", b"a"]) == 2 / 3 and quality.spread(varied + [b"a"] * 100) == 401 / 500
