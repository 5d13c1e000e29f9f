import hashlib
import random
import re

import pytest

from tapeworks.llm import contamination


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items, window=13):
    found = {}
    for i, t in items:
        w = words(t)
        n = min(window, len(w))
        for k in range(len(w) - n + 1) if n else []:
            found.setdefault(tuple(w[k : k + n]), set()).add("" if i is None else str(i))
    out = []
    for d, t in docs:
        w, hit, ids = words(t), set(), set()
        for n in {len(k) for k in found}:
            for k in range(len(w) - n + 1):
                if f := found.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    ids |= f
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def data(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 5, 12, 13, 14, 40])))) for i in range(25)]
    items += [(90, None), (91, "?!"), (92, items[0][1]), (3, items[4][1]), (None, "alone here")]
    docs = []
    for i in range(60):
        w = rng.choices(vocabulary + ["zz", "Qq"], k=rng.choice([0, 3, 30, 200]))
        for _ in range(rng.randint(0, 2)):
            at = rng.randrange(len(w) + 1)
            w[at:at] = (rng.choice(items)[1] or "").upper().replace(" ", "-").split()
        docs.append((i, " ".join(w)))
    docs += [(100, None), (101, ""), (102, "é漢w1x"), (5, docs[5][1]), (None, items[1][1]), (103, "pad " * 20_000 + items[2][1])]
    return docs, items


@pytest.mark.parametrize("block_bytes", [contamination.BLOCK_BYTES, 600])
def test_against_a_scan(spark, block_bytes):
    for seed in (1, 2):
        docs, items = data(seed)
        d = spark.createDataFrame([(i, t, "c") for i, t in docs], "doc_id long, text string, n_hit string")
        b = spark.createDataFrame(items, "item_id long, text string")
        got = contamination.judged(d, b, block_bytes=block_bytes).drop("text").collect()
        assert sorted(map(tuple, got), key=str) == brute(docs, items)


def test_empty_tables(spark):
    d, b = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert contamination.judged(d.limit(0), b).count() == 0
    assert [r.n_hit for r in contamination.judged(d, b.limit(0)).collect()] == [0]


def test_windows_overlap_and_repeat():
    m = contamination.Matcher([(0, "a b c"), (1, "b c d")], window=2)
    assert m.hits([b"a", b"b", b"c", b"d", b"a", b"b"]) == ([(0, 6)], {0, 1})
    again = contamination.Matcher([(0, " ".join("xy" * 8))])
    assert again.hits([b"x", b"y"] * 9) == ([(0, 18)], {0})


@pytest.mark.parametrize("block_bytes", [contamination.BLOCK_BYTES, 100])
def test_clashing_columns_pass(spark, block_bytes):
    names = ["row", "_row", "own", "n", "spans", "items", "S"]
    rows = [(i, "w1 w2 w3" if i % 2 else None, *(f"{c}{i}" for c in names)) for i in range(6)]
    d = spark.createDataFrame(rows, ["doc_id", "text", *names])
    b = spark.createDataFrame([(k, f"w{k} w{k + 1}") for k in range(9)], "item_id long, text string")
    got = contamination.judged(d, b, block_bytes=block_bytes)
    assert got.columns == ["doc_id", "text", *names, *contamination.JUDGED]
    assert sorted(tuple(r)[:9] for r in got.collect()) == sorted(rows, key=lambda r: r[0])
    assert {(r.doc_id, r.n_hit) for r in got.collect()} == {(i, 3 if i % 2 else 0) for i in range(6)}
