import random
import zlib

from tapeworks.llm import language

SYLLABLES = {"aa": ["ka", "to", "mi", "shi", "ru"], "bb": ["schr", "ung", "ver", "keit", "ein"], "cc": ["ción", "ñe", "los", "ar", "que"]}


def texts(n, seed=0):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(sorted(SYLLABLES))
        out.append((i, " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 3))) for _ in range(rng.randint(8, 60))), lang))
    return out


def test_held_out_accuracy_and_edges(spark, tmp_path):
    rows = texts(300) + [(1000, None, "aa"), (1001, "", "aa"), (1002, "12 34 ?!", "bb"), (None, "kato mishi", "aa"), (1003, "kato " * 40_000, None), (5, rows_text := "ver ung", "bb"), (5, rows_text, "bb")]
    df = spark.createDataFrame([(*r, "s", "x") for r in rows], "doc_id long, text string, lang string, source string, score string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = language.op3_language(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    truth = {i: lang for i, _, lang in texts(300)}
    for r in got:
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.lang_pred in {*SYLLABLES, "und"}
    held = [r for r in got if r.doc_id in truth and r.held_out and r.doc_id != 5]
    assert sum(truth[r.doc_id] == r.lang_pred for r in held) >= 0.98 * len(held) > 0
    assert {r.lang_pred for r in got if r.doc_id in (1000, 1001, 1002)} == {"und"}
    assert [r.lang_pred for r in got if r.doc_id == 1003] == ["aa"]
    assert [r.held_out for r in got if r.doc_id is None] == [False]


def test_predictions_do_not_read_the_language(spark):
    train = spark.createDataFrame(texts(60), "doc_id long, text string, lang string")
    model = language.learn(train)
    asked = [(i, t, None) for i, t, _ in texts(40, 1)], [(i, t, "zz") for i, t, _ in texts(40, 1)]
    a, b = ([r.lang_pred for r in language.identify(spark.createDataFrame(x, "doc_id long, text string, lang string").coalesce(1), model).collect()] for x in asked)
    assert a == b


def test_nothing_to_learn_and_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = language.learn(none)
    one = spark.createDataFrame([(1, "kato")], "doc_id long, text string")
    assert [(r.lang_pred, r.score) for r in language.identify(one, model).collect()] == [("und", 0.0)]
    assert language.identify(none, model).count() == 0


def test_the_bundle_is_the_sum_of_bound_letters():
    import numpy as np

    grams = language.trigrams("ab c")
    a, b, c = language.letter_vectors()
    want = sum(a[g >> 12].astype(int) * b[g >> 6 & 63] * c[g & 63] for g in grams)
    kinds, counts = np.unique(grams, return_counts=True)
    assert (language.Bundler().bundle(kinds, counts) == want).all()
    assert (a[3] == np.roll(c[3], 2)).all()


def test_predictions_by_brute_force(spark):
    """Bundles by plain loops over letters, and cosines of them."""
    import numpy as np

    rows = texts(40) + [(500, "Ñandú, über-ÇA! 12 x", "cc"), (501, "é", "bb")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langs, prototypes = language.learn(df)
    places = language.letter_vectors().astype(np.int64)

    def bundle(text):
        kinds, out = [0], np.zeros(language.DIMENSIONS, np.int64)
        for c in [*text, " "]:
            k = int(language.letter_classes()[ord(c)])
            if k or kinds[-1]:
                kinds.append(k)
        for k in zip(kinds, kinds[1:], kinds[2:]):
            out += places[0][k[0]] * places[1][k[1]] * places[2][k[2]]
        return out

    total = {lang: sum(bundle(t) for _, t, x in rows if x == lang) for lang in SYLLABLES}
    assert langs == sorted(total)
    cosine = lambda a, b: float(a @ b) / (np.linalg.norm(a) * np.linalg.norm(b))
    for i, lang in enumerate(langs):
        assert abs(cosine(prototypes[i], total[lang]) - 1) < 1e-9
    for r in language.identify(df, (langs, prototypes)).collect():
        every = [cosine(total[x], bundle(r.text)) for x in langs]
        assert r.lang_pred == langs[int(np.argmax(every))] and abs(r.score - max(0.0, max(every))) < 1e-5


def test_ties_go_to_the_first_language_and_long_texts_are_whole(spark):
    rows = [(1, "kato mishi", "bb"), (2, "kato mishi", "aa")]
    model = language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    long = "verung " * 150_000 + "kato mishi " * 20
    got = language.identify(spark.createDataFrame([(1, "kato"), (2, long)], "doc_id long, text string"), model).collect()
    assert got[0].lang_pred == got[1].lang_pred == "aa" and 0 <= got[1].score < got[0].score
