"""Quality rules: base statistics, and a CRF that labels each line.

Every line of a text becomes a feature vector (length, symbols, sentence marks,
repeats, position); Viterbi decoding of a linear-chain CRF marks each line as
content or boilerplate, and a text is kept if lines of content hold at least
``MIN_SHARE`` of its words. The CRF is trained on ``SAMPLE_DOCS`` labelled
documents at most (those with the smallest hash of their id, and up to
``SAMPLE_CHARS`` characters, so the sample is a few hundred MB at the very most): lines of documents
of quality 1 are content, of quality 0 boilerplate. Statistics and labels of a
text depend on that text and the model alone, so the work is one pass without a
shuffle; only the bounded sample reaches the driver.

Defined results
* null text: no words, all counts 0, ``base_failed`` true, not kept; a text
  without words likewise; null ids pass; repeated rows are judged each;
* without labelled documents of both kinds every line counts as content, so the
  base rules alone decide; empty table: no rows;
* texts and lines of any length are judged whole; equal scores in decoding go to
  content; input columns with the names of the results give way to them, other extra
  columns pass.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, crf

#: Bound on the labelled documents that the CRF is fitted on.
SAMPLE_DOCS, SAMPLE_CHARS = 1500, 200_000
MIN_SHARE = 0.5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
#: Words of a block, over which a line's variety is taken.
BLOCK = 400
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
CONTENT, BOILERPLATE = 0, 1
_UPPER = bytes(range(65, 91))
_DIGITS = b"0123456789"
_ENDS = b".!?:;,"


def repeated_words(words: list[bytes], size: int = WINDOW) -> int:
    """Words inside a window of ``size`` words that occurs twice or more."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    if len(seen) == len(words):
        return 0
    v = len(seen)
    if v**size < 2**63:
        keys = sum(ids[j : j + n] * v**j for j in range(size))
    else:  # rank pairs, then pairs of ranks, and so on
        keys, span = ids, 1
        while span < size:
            step = min(span, size - span)
            keys = keys[: len(words) - span - step + 1] * len(words) + keys[step : len(words) - span + 1]
            span += step
            if span < size:
                keys = np.unique(keys, return_inverse=True)[1].astype(np.int64)
    ordered = np.sort(keys)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    hit = np.flatnonzero(np.isin(keys, twice))
    marks = np.zeros(len(words) + 1, np.int64)
    np.add.at(marks, hit, 1)
    np.add.at(marks, hit + size, -1)
    return int((np.cumsum(marks)[:-1] > 0).sum())


def line_features(lines: list[bytes]) -> np.ndarray:
    """[line, feature] for the lines that have a word; ``N_FEATURES`` columns."""
    rows, seen = [], set()
    for line in lines:
        n, size = len(line.split()), len(line)
        symbols = size - len(line.translate(None, SYMBOLS))
        digits = size - len(line.translate(None, _DIGITS))
        upper = size - len(line.translate(None, _UPPER))
        ends = size - len(line.translate(None, _ENDS))
        tail = line.rstrip()
        rows.append((n, size, symbols, digits, upper, ends, tail[-1:] in (b".", b"!", b"?"), line[:1].isupper() or line[:1] >= b"\x80", line in seen, line.count(b"|")))
        seen.add(line)
    x = np.array(rows, np.float64).reshape(-1, 10)
    n, size = np.maximum(x[:, 0], 1), np.maximum(x[:, 1], 1)
    place = np.arange(len(x))
    return np.column_stack([
        np.ones(len(x)), np.log1p(n) / 4, n < 4, n < 8, n > 200, np.minimum(size / n, 30) / 10,
        np.minimum(x[:, 2] / n, 3), x[:, 2] > 0, np.minimum(x[:, 3] / size * 5, 2), np.minimum(x[:, 4] / n, 2),
        np.minimum(x[:, 5] / n, 2), x[:, 6], x[:, 7], x[:, 8], np.minimum(x[:, 9] / n * 2, 2), place == 0, place == len(x) - 1,
    ]).astype(np.float64)


def worded_lines(text: bytes) -> list[bytes]:
    return [line for line in text.split(b"\n") if not line.isspace() and line]


def spread(words_in: list[bytes], block: int = BLOCK) -> float:
    """Distinct words over words, low in lines that repeat one word: the mean over
    all consecutive blocks of a line, weighted by their words, as the plain ratio
    falls with a line's length."""
    distinct = sum(len(set(words_in[at : at + block])) for at in range(0, len(words_in), block))
    return distinct / max(1, len(words_in))


def features(lines: list[bytes]) -> np.ndarray:
    if not lines:
        return np.zeros((0, 19))
    variety = [spread(line.split()) for line in lines]
    v = np.array(variety)
    return np.column_stack([line_features(lines), v, v < 0.3])


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> crf.Chain | None:
    """The CRF of a bounded sample of labelled documents."""
    some = labels.where("quality is not null").select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "quality").limit(sample_docs)
    rows = (docs.select("doc_id", "text").where(F.length("text") <= SAMPLE_CHARS).join(F.broadcast(some), "doc_id")
        .select("quality", F.col("text").cast("binary").alias("text"), F.xxhash64("doc_id").alias("at")).orderBy("at", "text").limit(sample_docs).toArrow().to_pydict())
    kinds = [CONTENT if q == 1 else BOILERPLATE for q in rows["quality"]]
    lines = [worded_lines(t) for t in rows["text"]]
    # A document has one label; in two documents that follow each other the chain
    # also sees where content and boilerplate meet.
    groups = [[i] for i in range(len(lines))] + [[i, i + 1] for i in range(0, len(lines) - 1, 2)]
    groups = [g for g in groups if all(lines[i] for i in g)]
    xs = [features([x for i in g for x in lines[i]]) for g in groups]
    ys = [np.concatenate([np.full(len(lines[i]), kinds[i]) for i in g]) for g in groups]
    return crf.fit(xs, ys, 2, epochs=12) if {int(k) for y in ys for k in y} == {0, 1} else None


#: The judged columns, in order.
KINDS = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "base_failed": "boolean", "content_share": "double", "kept": "boolean"}


def judged(rows: DataFrame, chain: crf.Chain | None, text_col: str = "text", min_share: float = MIN_SHARE) -> DataFrame:
    """``rows`` with the columns of ``KINDS`` appended."""
    rows, schema = common.with_columns(rows, KINDS)
    place = rows.columns.index(text_col)

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, scores, sizes = [], [], []
            for text in batch.column(place).to_pylist():
                raw = (text or "").encode("utf-8", "surrogatepass")
                words, lines = raw.split(), worded_lines(raw)
                chars = len(text or "") - len(raw) + len(raw.translate(None, SPACES))
                repeats = repeated_words(words)
                failed = len(words) < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * len(words)
                out.append([len(words), chars, len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeats, failed])
                sizes.append(np.array([len(x.split()) for x in lines]))
                scores.append(features(lines) @ chain.weights if chain else np.zeros((len(lines), 2)))
            found = crf.viterbi(chain, scores) if chain else [np.zeros(len(s), np.int64) for s in scores]
            shares = [float(n[y == CONTENT].sum() / n.sum()) if len(n) else 0.0 for n, y in zip(sizes, found)]
            kept = [not o[-1] and s >= min_share for o, s in zip(out, shares)]
            columns = [pa.array(c, pa.int64()) for c in list(zip(*out))[:5]] if out else [pa.array([], pa.int64())] * 5
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns, pa.array([o[-1] for o in out], pa.bool_()), pa.array(shares, pa.float64()), pa.array(kept, pa.bool_())], names=[*batch.schema.names, *KINDS])

    return rows.mapInArrow(judge, schema)


def op4_line_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    chain = fit(docs, common.table(spark, sf_dir, "labels"))
    return judged(docs.select("doc_id", "text"), chain).drop("text")
