"""Quality by importance resampling.

Texts become bags of hashed words and word pairs. Two generative models over the
``BUCKETS`` buckets are counted: the target from at most ``GOOD_DOCS`` documents
labelled good (those with the smallest hash of their id), the raw model from all documents. A text's log weight is the sum of the log ratios of its
features; adding Gumbel noise to it and taking the ``k`` largest samples ``k``
documents without replacement in proportion to their weights. The noise comes
from a hash of id and text, so a run can be repeated.

Counting and scoring are passes without a wide shuffle: a task sends its counts
per bucket. The k-th largest key is found by refining a histogram of ``BINS``
bins over the stored keys, so no ranking of all rows is ever sorted or collected.

Defined results
* null or wordless text: no features, log weight 0;
* no good document: both models are equal and the noise alone decides;
* null ids pass (and are never labelled); keys equal to the k-th are all kept,
  so repeated rows share their fate; empty table: no rows;
* texts of any length count whole; the result has the id and its own columns
  alone, whatever else the input has.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BUCKETS = 1 << 14
BINS = 4096
#: Bound on the labelled documents that the target model is fitted on; their ids
#: are broadcast (half a MB).
GOOD_DOCS = 50_000
SMOOTHING = 0.5
SEED = 97


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        self[word] = out = zlib.crc32(word)
        return out


def features(texts: list[bytes | None], hashes: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words and word pairs of all texts, and each one's text."""
    words = [(t or b"").lower().split() for t in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    flat = np.fromiter(map(hashes.__getitem__, chain.from_iterable(words)), np.uint64, int(sizes.sum()))
    owner = np.repeat(np.arange(len(texts)), sizes)
    pair = owner[1:] == owner[:-1]
    mixed = (flat[:-1] * np.uint64(0x9E3779B97F4A7C15) + flat[1:] * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(40)
    single = (flat * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
    return (np.concatenate([single, mixed[pair]]) % np.uint64(BUCKETS)).astype(np.int64), np.concatenate([owner, owner[1:][pair]])


def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, good) to (bucket, target, raw)."""
    target, raw, hashes = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64), _Hashes()
    for batch in batches:
        if batch.num_rows:
            good = np.array(batch.column(1).to_pylist(), bool)
            buckets, owner = features(batch.column(0).to_pylist(), hashes)
            raw += np.bincount(buckets, minlength=BUCKETS)
            target += np.bincount(buckets[good[owner]], minlength=BUCKETS)
    at = np.flatnonzero(raw)
    yield from common.pieces({"bucket": pa.array(at, pa.int64()), "target": pa.array(target[at], pa.int64()), "raw": pa.array(raw[at], pa.int64())})


def learn(rows: DataFrame) -> np.ndarray:
    """Log ratio of each bucket from rows of (text, good)."""
    sums = rows.select(F.col("text").cast("binary"), "good").mapInArrow(count, "bucket long, target long, raw long").groupBy("bucket").agg(F.sum("target").alias("target"), F.sum("raw").alias("raw")).toArrow().to_pydict()
    both = np.full((2, BUCKETS), SMOOTHING)
    both[0, sums["bucket"]] += sums["target"]
    both[1, sums["bucket"]] += sums["raw"]
    if sum(sums["target"]) == 0:
        return np.zeros(BUCKETS)
    share = both / both.sum(1, keepdims=True)
    return np.log(share[0] / share[1])


def weighed(rows: DataFrame, ratios: np.ndarray, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """(id, n_features, log_weight, key) of every row."""
    shared = rows.sparkSession.sparkContext.broadcast(ratios)

    def weigh(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, own = _Hashes(), shared.value
        for batch in batches:
            buckets, owner = features(batch.column(1).to_pylist(), hashes)
            n = np.bincount(owner, minlength=batch.num_rows)
            total = np.bincount(owner, own[buckets], batch.num_rows).astype(np.float64)
            draw = (batch.column(2).to_numpy().astype(np.int64).view(np.uint64) >> np.uint64(11)).astype(np.float64)
            noise = -np.log(-np.log((draw + 0.5) / 2.0**53))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(total), pa.array(total + noise)], names=[id_col, "n_features", "log_weight", "key"])

    kind = rows.schema[id_col].dataType.simpleString()
    asked = rows.select(id_col, F.col(text_col).cast("binary").alias("text"), F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("draw"))
    return asked.mapInArrow(weigh, f"`{id_col}` {kind}, n_features long, log_weight double, key double")


def kth_largest(rows: DataFrame, col: str, k: int) -> float:
    """The k-th largest value, by a histogram that is refined around it."""
    low, high, n = rows.agg(F.min(col), F.max(col), F.count(col)).first()
    if k >= n:
        return float("-inf")
    if k <= 0:
        return float("inf")
    above = 0  # values over ``high``
    while low < high:
        width = (high - low) / BINS
        if low + width == low:  # fewer floats than bins: count each
            each = rows.where(F.col(col).between(low, high)).groupBy(F.col(col).alias("v")).agg(F.count("*").alias("n"))
            for v, n in sorted(each.collect(), reverse=True):
                above += n
                if above >= k:
                    return v
        inside = rows.where(F.col(col).between(low, high))
        place = F.least(F.lit(BINS - 1), F.floor((F.col(col) - F.lit(low)) / F.lit(width)))
        bins = sorted(inside.groupBy(place.alias("b")).agg(F.count("*").alias("n"), F.min(col).alias("lo"), F.max(col).alias("hi")).collect(), reverse=True)
        for b in bins:
            if above + b["n"] >= k:
                low, high = b["lo"], b["hi"]
                break
            above += b["n"]
    return high


def op6_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """kept: sampled; as many as there would be if all documents held the share
    of good ones that the labelled documents hold."""
    docs, labels = common.table(spark, sf_dir, "documents").select("doc_id", "text"), common.table(spark, sf_dir, "labels")
    # A document with several labels is judged by the worst.
    labels = labels.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    good = labels.where("doc_id is not null and quality = 1 and toxic = 0").select("doc_id", F.lit(True).alias("good"))
    # About twice as many as wanted by a hash, then the smallest hashes.
    chance = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / 1_000_003
    some = good.where(chance < 2 * GOOD_DOCS / max(1, good.count())).orderBy(chance, "doc_id").limit(GOOD_DOCS)
    ratios = learn(docs.join(F.broadcast(some), "doc_id", "left").select("text", F.coalesce("good", F.lit(False)).alias("good")))
    share = labels.agg(F.avg((F.col("quality") == 1).cast("double"))).first()[0]
    keys = common.stored(weighed(docs, ratios))
    k = round((1.0 if share is None else share) * keys.count())
    return keys.withColumn("kept", F.col("key") >= F.lit(kth_largest(keys, "key", k)))
