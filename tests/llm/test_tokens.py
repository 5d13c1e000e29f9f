import random

import pytest
import sentencepiece

from tapeworks.llm import tokens

FILE = tokens.tokenizer_file("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=FILE)


def test_counts_are_the_library_s(library):
    rng = random.Random(1)
    letters = "the ing  er<s></s>\n\t▁éü漢字0123xyzABC,.-_=\x00😀ﬁ  aaaaahttp://www.example.com the and of"
    machine = tokens.Transducer(FILE)
    for k in range(4_000):
        t = "".join(rng.choice(letters) for _ in range(rng.randint(0, 60)))
        t = t.replace("e", "the").replace("a", "tion ") if k % 3 == 0 else t
        n = len(library.encode(t))
        assert machine.count(t) == n, t
        assert machine.count(t, rng.randint(1, 20)) == n, t  # chunks cut anywhere


def test_long_texts(library):
    machine = tokens.Transducer(FILE)
    for t in ("word " * 60_000, "x" * 5_000, " " * 3_000, "\n" * 3_000, "ab" * 4_000 + " end", "a\n" * 50_000, "▁" * 200):
        assert machine.count(t, 1_000) == machine.count(t) == len(library.encode(t))


def test_forgetting_does_not_change_counts(library, monkeypatch):
    monkeypatch.setattr(tokens, "KEPT_STEPS", 50)
    monkeypatch.setattr(tokens, "KEPT_WORDS", 5)
    machine = tokens.Transducer(FILE)
    for t in ("some words to count", "others that follow here", "some words again", "x1 y2 z3") * 3:
        assert machine.count(t) == len(library.encode(t))


def test_composition_is_associative():
    machine = tokens.Transducer(FILE)
    text = "▁one▁two\nthree▁▁four" * 4
    maps = [machine.chunk(text[i : i + 7]) for i in range(0, len(text), 7)]
    left = maps[0]
    for m in maps[1:]:
        left = machine.compose(left, m)
    right = maps[-1]
    for m in reversed(maps[:-1]):
        right = machine.compose(m, right)
    assert left == right == machine.scan(maps)


def test_long_texts_are_scanned_over_tasks(spark, library):
    rng = random.Random(5)
    texts = [None, "", "short", "x" * 400, "a b\n" * 300, *("".join(rng.choice("the ing  er\n▁é漢") for _ in range(rng.randint(0, 900))) for _ in range(30))]
    rows = spark.createDataFrame([(i, t, i * 2) for i, t in enumerate(texts)] * 2, "row long, text string, kept long")
    got = sorted(map(tuple, tokens.counted(rows, FILE, chunk=20).collect()), key=str)
    assert got == sorted([(i, t, i * 2, len(library.encode(t or ""))) for i, t in enumerate(texts)] * 2, key=str)


def test_bounds_hold_inside_a_text(library, monkeypatch):
    monkeypatch.setattr(tokens, "KEPT_STEPS", 100)
    monkeypatch.setattr(tokens, "KEPT_WORDS", 20)
    machine, rng = tokens.Transducer(FILE), random.Random(3)
    text = " ".join("".join(rng.choice("abcdefgh") for _ in range(9)) for _ in range(400))
    assert machine.count(text) == machine.count(text, 64) == len(library.encode(text))
    assert len(machine.steps) <= 101 and len(machine.after_space) <= 20


def test_query(spark, tmp_path, library):
    rows = [(1, None), (2, ""), (3, "Hello <s> wörld"), (3, "Hello <s> wörld"), (None, "x"), (4, "many words " * 3_000)]
    spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, n_tokens string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, tokens.op9_token_counts(spark, str(tmp_path)).collect()), key=str)
    count = lambda t: len(library.encode(t or ""))
    assert got == sorted(((i, len((t or "").encode()), count(t), count(t) > 4096) for i, t in rows), key=str)
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "none/documents.parquet"))
    assert tokens.op9_token_counts(spark, str(tmp_path / "none")).count() == 0
