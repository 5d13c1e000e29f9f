import os

import corpus_pipeline as pipeline
import pytest
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"


def small(spark, tmp_path):
    prose = "the river ran past the old mill and the miller looked out over it while nobody came that day to buy bread"
    item = "which of these thirteen words is the one that no document should ever hold again please"
    rows = [(1, prose), (2, prose), (3, prose.replace("bread", "flour") + " and eggs"), (4, "12 34"), (5, None), (6, "something quite different from the others is written here for once"), (7, item), (8, 'hidden token = "abcdef123456" among other plain words of the text'), (None, "a text without an id that stays in the table as it is today"), (9, ""), (6, "another text with the same id as one before but not the same words at all")]
    df = spark.createDataFrame([(i, t, "en" if i != 6 else None, "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return df.withColumn("score", F.lit("x")).withColumn("kept", F.lit(True)).withColumn("row", F.lit(7))


def test_stages(spark, tmp_path):
    docs = small(spark, tmp_path)
    ids = {}
    for name, stage in pipeline.STAGES:
        columns = docs.columns
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "pack":
            assert docs.columns == columns
        ids[name] = sorted(str(r[0]) for r in docs.select("doc_id").distinct().collect())
    assert ids["language"] == ["1", "2", "3", "6", "7", "8", "None"]
    assert "2" not in ids["near_duplicates"] and {"1", "6", "8", "None"} <= set(ids["near_duplicates"])
    assert "7" not in ids["decontaminate"] and ids["secrets"] == ids["decontaminate"] == ids["pack"]
    kept = spark.read.parquet(str(tmp_path / "secrets"))
    assert kept.where("doc_id = 6").count() == 2 and kept.where("lang IS NULL").isEmpty()
    masked = kept.where("doc_id = 8").first()
    assert "[SECRET]" in masked.text and "abcdef123456" not in masked.text and masked.n_chars == len(masked.text) and masked.score == "x"


def test_near_duplicates_between_the_thresholds(spark, tmp_path):
    """Near copies by five words and 0.8 that four words and 0.85 would leave."""
    words = [f"w{i}" for i in range(50)]
    changed = [*words[:25], "other", *words[26:]]  # 41 of 51 shingles of five, 43 of 51 of four
    longer = [f"v{i}" for i in range(100)]
    appended = longer + [f"x{i}" for i in range(20)]  # 96 of 116, 97 of 117
    apart = [f"u{i}" for i in range(50)]
    two = [*apart[:15], "other", *apart[16:35], "another", *apart[36:]]  # 36 of 56: no near copy
    rows = [(i, " ".join(w), "en", "s", 0) for i, w in enumerate([words, changed, longer, appended, apart, two])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "docs"))
    left = pipeline.drop_near_duplicates(spark, spark.read.parquet(str(tmp_path / "docs")), str(tmp_path))
    assert sorted(r.doc_id for r in left.collect()) == [0, 2, 4, 5]


def test_empty_table(spark, tmp_path):
    docs = small(spark, tmp_path).limit(0)
    for name, stage in pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_run(spark):
    out = pipeline.run(spark, DATA)
    assert out.columns == list(pipeline.packing.PIECE) and out.count() > 0
