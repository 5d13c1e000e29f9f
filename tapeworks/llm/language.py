"""Language identification with hyperdimensional profiles.

Each letter class has a random vector of +1/-1. A trigram's vector binds its
three letters, each permuted (rotated) by its place, by multiplication; a text's
vector bundles (adds) the vectors of its trigrams. A language's prototype is the
bundle of its training texts, and a text gets the language whose prototype has
the largest cosine with it.

Bundling is linear, so training needs trigram counts only: every task adds up
its own counts, turns them into one vector per language and sends that, and the
sums per (language, dimension) reach the driver: languages x DIMENSIONS numbers,
whatever the number of documents. Counts are whole numbers, so prototypes do not
depend on the order of summation. Prediction is one pass without a shuffle.

Defined results
* null text, or no letter in it: ``und`` with score 0; likewise for every text
  if there is nothing to learn from;
* a null id is not held out, and is not learned from; null languages are not
  learned; equal cosines: the first language in string order;
* empty table: no rows; repeated rows count as often as they occur;
* texts of any length count whole; input columns named ``lang_pred`` and ``score``
  give way to the results, other extra columns pass.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

DIMENSIONS = 512
CLASSES = 64
SEED = 20240101
UNDETERMINED = "und"


@cache
def letter_classes() -> np.ndarray:
    """Class of each code point: 0 for what is no letter, 1-26 for a-z in either
    case, and 37 more that the other letters share by a multiplicative hash."""
    out = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        if (s := chr(c)).isalpha():
            low = ord(s.lower()[0])
            out[c] = low - 96 if 97 <= low <= 122 else 27 + ((low * 2654435761) >> 7) % (CLASSES - 27)
    return out


@cache
def letter_vectors() -> np.ndarray:
    """[place, class, dimension]: the letters' vectors, rotated by 2, 1 and 0."""
    letters = np.random.default_rng(SEED).choice(np.array([-1, 1], np.int8), (CLASSES, DIMENSIONS))
    return np.stack([np.roll(letters, 2, axis=1), np.roll(letters, 1, axis=1), letters])


class Bundler:
    """Bound trigram vectors, made when a trigram is first met."""

    def __init__(self) -> None:
        self.slot = np.full(CLASSES**3, -1, np.int32)
        self.rows = np.empty((0, DIMENSIONS), np.int8)
        self.used = 0

    def bundle(self, grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
        slots = self.slot[grams]
        if slots.min(initial=0) < 0:
            new = grams[slots < 0]
            a, b, c = letter_vectors()
            bound = a[new >> 12] * b[new >> 6 & 63] * c[new & 63]
            if self.used + len(new) > len(self.rows):
                self.rows = np.concatenate([self.rows[: self.used], np.empty((max(4096, len(new), self.used), DIMENSIONS), np.int8)])
            self.rows[self.used : self.used + len(new)] = bound
            self.slot[new] = np.arange(self.used, self.used + len(new))
            self.used += len(new)
            slots = self.slot[grams]
        return counts.astype(np.float32) @ self.rows[slots].astype(np.float32)


def trigrams(text: str) -> np.ndarray:
    """Trigram codes of a whole text; runs of other characters count as one."""
    kinds = letter_classes()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    kinds = np.concatenate([[0], kinds, [0]]).astype(np.int32)
    kinds = kinds[np.concatenate([[True], (kinds[1:] != 0) | (kinds[:-1] != 0)])]
    return kinds[:-2] << 12 | kinds[1:-1] << 6 | kinds[2:]


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def learn_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) to (lang, dimension, value): this task's part of the prototypes."""
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        found: dict[str, list] = {}
        for lang, text in zip(*map(pa.Array.to_pylist, batch.columns)):
            if has_letter(text):
                found.setdefault(lang, []).append(trigrams(text))
        for lang, grams in found.items():
            total = counts.setdefault(lang, np.zeros(CLASSES**3, np.int64))
            total += np.bincount(np.concatenate(grams), minlength=CLASSES**3)
    a, b, c = letter_vectors()
    for lang, total in counts.items():
        out = np.zeros(DIMENSIONS, np.int64)
        for at in np.array_split(np.flatnonzero(total), 64):
            out += total[at] @ (a[at >> 12] * b[at >> 6 & 63] * c[at & 63]).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * DIMENSIONS), pa.array(np.arange(DIMENSIONS, dtype=np.int32)), pa.array(out)], names=["lang", "dimension", "value"])


def learn(rows: DataFrame, lang_col: str = "lang", text_col: str = "text") -> tuple[list[str], np.ndarray]:
    """Languages in string order and their prototypes, as unit vectors."""
    parts = (rows.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
        .select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
        .mapInArrow(learn_batches, "lang string, dimension int, value long"))
    sums = parts.groupBy("lang", "dimension").agg(F.sum("value").alias("value")).toArrow().to_pydict()
    langs = sorted(set(sums["lang"]))
    out, at = np.zeros((len(langs), DIMENSIONS)), {x: i for i, x in enumerate(langs)}
    out[[at[x] for x in sums["lang"]], sums["dimension"]] = sums["value"]
    length = np.linalg.norm(out, axis=1, keepdims=True)
    return langs, out / np.where(length > 0, length, 1)


def identify(rows: DataFrame, model: tuple[list[str], np.ndarray], text_col: str = "text") -> DataFrame:
    """``rows`` with lang_pred and score appended; the text column comes last
    before them. Other columns pass as they are."""
    langs, prototypes = model[0], model[1].astype(np.float32)
    rows, schema = common.with_columns(rows, {"lang_pred": "string", "score": "double"})
    place = rows.columns.index(text_col)

    def predict(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundler = Bundler()
        for batch in batches:
            names, scores = [], []
            for text in batch.column(place).to_pylist():
                name, score = UNDETERMINED, 0.0
                if langs and has_letter(text):
                    grams, counts = np.unique(trigrams(text), return_counts=True)
                    vector = bundler.bundle(grams, counts)
                    cosines = prototypes @ vector / max(float(np.linalg.norm(vector)), 1e-12)
                    best = int(cosines.argmax())
                    name, score = langs[best], min(1.0, max(0.0, float(cosines[best])))
                names.append(name)
                scores.append(score)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    return rows.mapInArrow(predict, schema)


def remainder(id_col: str, by: int) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % by


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = learn(docs.where(remainder("doc_id", 4) != 2))
    asked = docs.select("doc_id", F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "text")
    return identify(asked, model).drop("text")
