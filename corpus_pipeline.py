"""From raw documents to packed training sequences, in five stages.

Every stage takes (spark, docs, sf_dir) and works on all documents that the one
before kept; all but the last return the columns of ``docs``, whatever these are.

* language: documents without a language (no letter; a null or empty text) go; a
  null ``lang`` gets the predicted one;
* near_duplicates: of each class of linked documents (word shingles of five, a
  Jaccard similarity of 0.8 or more) the one with the smallest doc_id stays (null
  ids last; among rows of equal ids the first stored). Texts without a word link
  with nothing and stay;
* decontaminate: documents contaminated with benchmark passages go; null and empty
  texts, and all texts if there is no benchmark item, stay;
* secrets: secrets in texts are masked, ``n_chars`` follows; no document goes, and a
  null text stays null;
* pack: documents become pieces of training sequences; a null or empty text is its
  end id.

Texts of any length are taken whole. Null ids pass, repeated rows are documents of
their own (copies of one class). An empty table gives no rows. Columns beside those of
``documents`` pass whatever their names; only pack leaves them out. Ties inside a
stage are those of its operator.

``docs`` must be a stored table, as ``run`` and the driver give it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks.llm import common, contamination, jaccard, language, packing, secrets, tokens

TOKENIZER = "byte_bpe_50k.json"
#: Near duplicates: words of a shingle, and the least similarity in percent.
NEAR_SIZE, NEAR_PERCENT = 5, 80


def _wrapped(docs: DataFrame) -> DataFrame:
    """Text, and everything else in a struct, out of the way of operators' names."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    return docs.select("text", F.struct(*others).alias("kept"))


def _unwrapped(rows: DataFrame, like: DataFrame, **new) -> DataFrame:
    own = lambda c: F.col("text") if c == "text" else F.col(f"kept.`{c}`")
    return rows.select(*((new[c] if c in new else own(c)).alias(c) for c in like.columns))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.session(spark)
    model = language.learn(docs.where(language.remainder("doc_id", 4) != 2))
    found = language.identify(_wrapped(docs), model).where(F.col("lang_pred") != language.UNDETERMINED)
    return _unwrapped(found, docs, lang=F.coalesce("kept.lang", "lang_pred"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.session(spark)
    numbered = _wrapped(docs).withColumn("row", F.monotonically_increasing_id())
    classes = jaccard.linked(numbered.select("row", "text"), id_col="row", size=NEAR_SIZE, percent=NEAR_PERCENT).select("row", "component_id")
    doc_id = F.col("kept.doc_id")
    order = F.struct(doc_id.isNull().alias("none"), doc_id.alias("doc_id"), F.col("row"))
    chosen = numbered.select("row", order.alias("order")).join(classes, "row").groupBy("component_id").agg(F.min("order").alias("best")).select(F.col("best.row").alias("row"))
    return _unwrapped(numbered.join(chosen, "row", "left_semi"), docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = contamination.judged(_wrapped(docs), common.table(spark, sf_dir, "benchmark"))
    return _unwrapped(judged.where(~F.col("contaminated")), docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.session(spark)
    found = secrets.scanned(_wrapped(docs), secrets.fit(docs)).select("text", "kept", "spans")

    def mask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [secrets.redacted(t, s) if t and s else t for t, s in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), *batch.columns[1:]], names=batch.schema.names)

    masked = found.mapInArrow(mask, found.schema)
    new = {"n_chars": F.when(F.col("spans") != "", F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("kept.n_chars"))} if "n_chars" in docs.columns else {}
    return _unwrapped(masked, docs, **new)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.session(spark)
    return packing.packed(docs, tokens.tokenizer_file(TOKENIZER))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontaminate", decontaminate),
    ("secrets", mask_secrets),
    ("pack", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: Language profiles, CRF tagging, packing and token ids are not for SQL.
ORACLE_SQL = None
