"""Language-model scores: a log-bilinear model trained by noise-contrastive estimation.

The two words before a position have vectors; each goes through a matrix of its
place, and their sum (the query) is multiplied with the vectors of what may follow.
Words with vectors of their own are the most frequent of the training texts, and
grow in number with them: ``own_words``, the root of the tokens up to
``MOST_OWN``. All others share ``TAILS`` vectors by their last letters, and a word's
share of its tail comes from exact corpus counts. Ids in order of frequency are cut
into classes of about the root of their number, and the model predicts the class
and then the id in it, both log-bilinear. So normalised log-probabilities of every
token take two batches of matrix products over a few hundred columns each.

Training. Every position of every training document is learned from once. A step
takes ``BATCH`` of them: noise ids are shared by its rows of one class, noise classes by all, so
scores are small matrix products, and gradients are summed by id before they go
through the matrices. In each of ``ROUNDS`` rounds the executors
train on their share of the rows (dealt to the rounds by a hash), from the same
parameters; these are then averaged row by row, weighted by how often a worker saw
a word, in a tree of ``FAN`` workers a step. Classes and ids are told apart from noise
drawn from their unigram shares. The driver holds one set of parameters
(``MOST_OWN`` words: about 2.5 MB).

Counts. Counts of every word of the corpus are needed, and the vocabulary grows with
it, so it is never collected. Words more frequent than the ``COUNTED``-th travel with
the model; they are the hot ones. Occurrences of all other words are joined with the
vocabulary, none of them frequent, and summed by document; texts are not shuffled.

Defined results
* null text: as empty, so one token, the end; texts of any length are scored
  whole; repeated rows count and are scored each;
* a null id is not held out, and is not learned from;
* words of equal count: the smaller bytes first;
* nothing to learn from: N and V are 0, every known count is 0, and all ids are
  equally likely; empty table: no rows;
* the results are id, ``keep`` and ``SCORES``; other input columns are left out.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .importance import kth_largest
from .language import remainder

#: Ids: 0 stands before a text, 1 ends it, then words, then tails.
START, END, FIRST = 0, 1, 2
LEAST_OWN, MOST_OWN, TAILS = 254, 16_000, 256
#: Words whose counts travel with the model.
COUNTED = 1 << 17
WIDTH = 16
ROUNDS, WORKER_TOKENS, FAN = 3, 8_000_000, 64
BATCH, LEAST_BATCH, NOISE, CLASS_NOISE, RATE = 8192, 512, 16, 64, 0.15
#: Batches whose rows are mixed.
SHUFFLED = 64
#: Squares that Adagrad starts from, so a few rows of noise move a vector little.
SQUARES = 20
#: Rows of parameters in a piece that workers send.
PIECE = 1024
#: Positions scored at once.
SLICE = 16_384
#: The end of a text, as a token; no word holds a line break.
END_TOKEN = b"\n"


def tokens(text: bytes | None) -> list[bytes]:
    words = (text or b"").lower().split()
    words.append(END_TOKEN)
    return words


def tail(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % TAILS


def own_words(train_tokens: int) -> int:
    return min(MOST_OWN, max(LEAST_OWN, int(train_tokens**0.5)))


@dataclass(frozen=True)
class Shape:
    """Ids, and how they are cut into classes; the last class may be short."""
    own: int

    @property
    def ids(self) -> int:
        return FIRST + self.own + TAILS

    @property
    def size(self) -> int:
        return max(1, round(self.ids**0.5))

    @property
    def classes(self) -> int:
        return -(-self.ids // self.size)

    @property
    def rows(self) -> int:
        """Rows of parameters: contexts, ids, classes and the two matrices."""
        return 2 * self.ids + self.classes + 2 * WIDTH

    def parts(self, params: np.ndarray) -> list[np.ndarray]:
        """Views: contexts, ids, classes (each with its bias last), matrices."""
        cuts = np.cumsum([self.ids, self.ids, self.classes])
        context, ids, classes, moves = np.split(params, cuts)
        return [context[:, :WIDTH], ids, classes, moves[:, :WIDTH].reshape(2, WIDTH, WIDTH)]


class Places(dict):
    """Id of each word; words outside the table get their tail, remembered for a
    bounded number of them."""

    def __init__(self, words: list[bytes], own: int) -> None:
        self.table = {END_TOKEN: END} | {w: FIRST + i for i, w in enumerate(words)}
        self.tails = FIRST + own
        super().__init__(self.table)

    def __missing__(self, word: bytes) -> int:
        self[word] = out = self.tails + tail(word)
        return out

    def trim(self) -> None:
        if len(self) > len(self.table) + 300_000:
            self.clear()
            self.update(self.table)


def placed(texts: list[list[bytes]], places: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Places of all tokens in a row, and how many each text has."""
    sizes = np.array([len(t) for t in texts], np.int64)
    return np.fromiter(map(places.__getitem__, chain.from_iterable(texts)), np.int64, int(sizes.sum())), sizes


def sequence(flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all texts in a row with two START before each; where tokens stand in
    it; and the first token of each text."""
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    at = np.arange(len(flat)) + 2 * np.repeat(np.arange(1, len(sizes) + 1), sizes)
    out = np.zeros(len(flat) + 2 * len(sizes), np.int64)
    out[at] = flat
    return out, at, starts


def packed(ids: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Ids of each text as bytes, two an id."""
    ends = np.concatenate([[0], 2 * np.cumsum(sizes)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(ids.astype("<u2"))])


def unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    texts = column.to_pylist()
    return np.frombuffer(b"".join(texts), "<u2").astype(np.int64), np.array([len(t) // 2 for t in texts], np.int64)


def unigrams(counts: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """Share of each class, and of each id in its class."""
    seen = counts + 0.5
    seen[START] = 1e-9
    whole = np.add.reduceat(seen, np.arange(0, shape.ids, shape.size))
    return whole / whole.sum(), seen / whole[np.arange(shape.ids) // shape.size]


def fresh(counts: np.ndarray, shape: Shape, seed: int = 5) -> np.ndarray:
    """Parameters before training: unigram shares as biases, small vectors."""
    params = np.random.default_rng(seed).normal(0, 0.1, (shape.rows, WIDTH + 1)).astype(np.float32)
    context, ids, classes, moves = shape.parts(params)
    whole, inside = unigrams(counts, shape)
    ids[:, WIDTH], classes[:, WIDTH] = np.log(inside), np.log(whole)
    moves[:] = np.eye(WIDTH) * 0.7
    return params


def _summed(rows: np.ndarray, values: np.ndarray, count: int) -> np.ndarray:
    """For each of ``count`` rows the sum of the values that go to it."""
    order = np.argsort(rows.astype(np.uint16) if count <= 1 << 16 else rows, kind="stable")  # small ones are sorted faster
    rows = rows[order]
    starts = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    out = np.zeros((count, values.shape[1]), np.float32)
    out[rows[starts]] = np.add.reduceat(values[order], starts)
    return out


def _told_apart(score: np.ndarray) -> np.ndarray:
    """Logistic function, in place."""
    np.negative(score, out=score)
    with np.errstate(over="ignore"):
        np.exp(score, out=score)
    score += 1
    return np.reciprocal(score, out=score)


class Trainer:
    """Noise-contrastive estimation with Adagrad, from given parameters."""

    def __init__(self, params: np.ndarray, counts: np.ndarray, shape: Shape, rate: float, seed: int) -> None:
        self.shape, self.rate, self.rng = shape, rate, np.random.default_rng(seed)
        self.params, self.squares = params.astype(np.float32), np.full(params.shape, SQUARES, np.float32)
        self.weight = np.full(shape.rows, 0.01)
        whole, inside = unigrams(counts, shape)
        self.whole = whole
        self.class_noise, self.word_noise = np.log(whole * CLASS_NOISE).astype(np.float32), np.log(inside * NOISE).astype(np.float32)
        # Draws of each class, made once.
        self.draws = np.empty((shape.classes, 2048), np.int32)
        for c in range(shape.classes):
            low, high = c * shape.size, min((c + 1) * shape.size, shape.ids)
            steps = np.cumsum(inside[low:high])
            self.draws[c] = low + np.minimum(np.searchsorted(steps, self.rng.random(2048) * steps[-1]), high - low - 1)

    def step(self, before: np.ndarray, last: np.ndarray, word: np.ndarray) -> None:
        shape, n = self.shape, len(word)
        order = np.argsort(word.astype(np.uint16) if shape.ids <= 1 << 16 else word, kind="stable")
        before, last, word = before[order], last[order], word[order]
        context, ids, classes, moves = shape.parts(self.params)
        query = (context @ moves[0])[before] + (context @ moves[1])[last]
        grads = np.zeros_like(self.params)
        to_context, to_ids, to_classes, to_moves = shape.parts(grads)
        # Noise: classes for the whole batch, ids for its rows of one class.
        times = self.rng.multinomial(CLASS_NOISE, self.whole)
        some = np.flatnonzero(times)
        part = classes[some]
        pull = query @ part[:, :WIDTH].T
        pull += part[:, WIDTH] - self.class_noise[some]
        pull = _told_apart(pull)
        pull *= -times[some].astype(np.float32)
        to_query = pull @ part[:, :WIDTH]
        to_classes[some, :WIDTH], to_classes[some, WIDTH] = pull.T @ query, pull.sum(0)
        own = word // shape.size
        bounds = np.searchsorted(own, np.arange(shape.classes + 1))
        present = np.flatnonzero(np.diff(bounds))
        drawn = self.draws[present[:, None], self.rng.integers(0, self.draws.shape[1], (len(present), NOISE))]
        noise = ids[drawn]
        vectors = np.ascontiguousarray(noise[:, :, :WIDTH])
        bias = noise[:, :, WIDTH] - self.word_noise[drawn]
        cuts = [slice(bounds[c], bounds[c + 1]) for c in present]
        pull = np.empty((n, NOISE), np.float32)
        for k, cut in enumerate(cuts):
            np.matmul(query[cut], vectors[k].T, out=pull[cut])
            pull[cut] += bias[k]
        pull = _told_apart(pull)
        np.negative(pull, out=pull)
        to_noise = np.empty((len(present), NOISE, WIDTH + 1), np.float32)
        for k, cut in enumerate(cuts):
            to_query[cut] += pull[cut] @ vectors[k]
            np.matmul(pull[cut].T, query[cut], out=to_noise[k, :, :WIDTH])
            pull[cut].sum(0, out=to_noise[k, :, WIDTH])
        to_ids += _summed(drawn.reshape(-1), to_noise.reshape(-1, WIDTH + 1), shape.ids)
        # What came: its class and its id; rows of one id stand together.
        starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        for table, to_table, at, lo, level in ((classes, to_classes, own, bounds[present], self.class_noise), (ids, to_ids, word, starts, self.word_noise)):
            mine = table[at]
            up = np.einsum("bw,bw->b", query, mine[:, :WIDTH])
            up += mine[:, WIDTH] - level[at]
            up = 1 - _told_apart(up)
            to_query += up[:, None] * mine[:, :WIDTH]
            to_table[at[lo], :WIDTH] += np.add.reduceat(up[:, None] * query, lo)
            to_table[at[lo], WIDTH] += np.add.reduceat(up, lo)
        # Contexts and matrices: first summed by id.
        for move, to_move, rows in ((moves[0], to_moves[0], before), (moves[1], to_moves[1], last)):
            total = _summed(rows, to_query, shape.ids)
            to_context += total @ move.T
            to_move += context.T @ total
        self.squares += grads * grads
        grads /= np.sqrt(self.squares)
        grads *= self.rate
        self.params += grads
        self.weight[: shape.ids] += np.bincount(last, minlength=shape.ids) + np.bincount(before, minlength=shape.ids)
        self.weight[shape.ids : 2 * shape.ids] += np.bincount(word, minlength=shape.ids)
        self.weight[2 * shape.ids :] += n


def train_part(batches: Iterable[np.ndarray], trainer: Trainer) -> None:
    """Train on rows (before last, last, word), a batch at a time."""
    kept: list[np.ndarray] = []
    for grams in chain(batches, [None]):
        if grams is not None:
            kept.append(grams)
        if grams is None or sum(map(len, kept)) >= SHUFFLED * BATCH:
            rows = np.concatenate(kept) if kept else np.zeros((0, 3), np.int64)
            rows = rows[trainer.rng.permutation(len(rows))]
            size = min(BATCH, max(LEAST_BATCH, len(rows) // 16))
            for at in range(0, len(rows), size):
                trainer.step(*rows[at : at + size].T)
            kept = []


def _ids(model):
    """(text, turn) to (ids, turn)."""
    def ids(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = Places(*model.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([packed(*placed([tokens(t) for t in batch.column(0).to_pylist()], places)), batch.column(1)], names=["ids", "turn"])
            places.trim()

    return ids


def _train(model, shape: Shape, rate: float, turn: int):
    """Ids of texts to pieces of trained parameters: (piece, worker, payload), each row
    of a payload times its weight, and the weight."""
    def train(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        counts, params = model.value
        worker = TaskContext.get().partitionId()
        trainer = Trainer(params, counts, shape, rate, 1000 * worker + turn)

        def grams() -> Iterator[np.ndarray]:
            for batch in batches:
                if batch.num_rows:
                    ids, at, _ = sequence(*unpacked(batch.column(0)))
                    yield np.column_stack([ids[at - 2], ids[at - 1], ids[at]])

        train_part(grams(), trainer)
        if trainer.weight[-1] < 1:
            return  # no text came here
        out = np.column_stack([trainer.params * trainer.weight[:, None], trainer.weight]).astype(np.float32)
        for k in range(0, len(out), PIECE):
            yield pa.RecordBatch.from_arrays([pa.array([k // PIECE], pa.int64()), pa.array([worker], pa.int64()), pa.array([out[k : k + PIECE].tobytes()], pa.binary())], names=["piece", "worker", "payload"])

    return train


def _add(key: tuple, table: pa.Table) -> pa.Table:
    total = np.sum([np.frombuffer(b, np.float32) for b in table.column("payload").to_pylist()], 0, dtype=np.float64).astype(np.float32)
    return pa.Table.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([key[1].as_py()], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["piece", "worker", "payload"])


def trained(texts: DataFrame, words: list[bytes], counts: np.ndarray, shape: Shape, total: int, rounds: int = ROUNDS) -> np.ndarray:
    """Parameters after all rounds; ``texts`` has (text, turn), or (ids, turn)."""
    spark, params = texts.sparkSession, fresh(counts, shape)
    if "ids" not in texts.columns:
        texts = texts.select("text", "turn").mapInArrow(_ids(spark.sparkContext.broadcast((words, shape.own))), f"ids binary, turn {texts.schema['turn'].dataType.simpleString()}")
    workers = max(8, total // WORKER_TOKENS)
    for turn in range(rounds):
        model = spark.sparkContext.broadcast((counts, params))
        rate = RATE * (1 - turn / rounds)
        sums = texts.where(F.col("turn") == turn).select("ids").coalesce(workers).mapInArrow(_train(model, shape, rate, turn), "piece long, worker long, payload binary")
        left = workers
        while True:
            left = -(-left // FAN)
            sums = sums.groupBy("piece", F.floor(F.col("worker") / FAN).alias("to")).applyInArrow(_add, "piece long, worker long, payload binary")
            if left == 1:
                break
        got = sums.select("piece", "payload").toArrow().sort_by("piece")
        model.unpersist()
        if got.num_rows:
            added = np.frombuffer(b"".join(got.column("payload").to_pylist()), np.float32).reshape(-1, WIDTH + 2)
            params = added[:, :-1] / added[:, -1:]
    return params


def log_shares(params: np.ndarray, shape: Shape, before: np.ndarray, last: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Normalised log10 probability of each id after its two contexts."""
    context, ids, classes, moves = shape.parts(params)
    pairs = np.stack([context @ moves[0], context @ moves[1]])
    out = np.empty(len(word))
    table, bias = np.ascontiguousarray(ids[:, :WIDTH]), np.ascontiguousarray(ids[:, WIDTH])
    whole, whole_bias = np.ascontiguousarray(classes[:, :WIDTH].T), np.ascontiguousarray(classes[:, WIDTH])
    if shape.ids:
        bias[START] = -np.inf
    # One piece of memory for all products: fresh pages cost more than they do.
    room = np.empty(min(SLICE, len(word)) * max(shape.classes, shape.size), np.float32)
    for at in range(0, len(word), SLICE):
        cut = slice(at, at + SLICE)
        own = word[cut] // shape.size
        order = np.argsort(own.astype(np.uint16), kind="stable")
        own, target = own[order], word[cut][order]
        query = pairs[0][before[cut][order]] + pairs[1][last[cut][order]]
        part = _picked(query, whole, whole_bias, own, room)
        bounds = np.searchsorted(own, np.arange(shape.classes + 1))
        for c in np.flatnonzero(np.diff(bounds)):
            mine, low = slice(bounds[c], bounds[c + 1]), c * shape.size
            part[mine] += _picked(query[mine], table[low : low + shape.size].T, bias[low : low + shape.size], target[mine] - low, room)
        out[at + order] = part
    return out / np.log(10)


def _picked(query: np.ndarray, vectors: np.ndarray, bias: np.ndarray, column: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Normalised log probability of one column of each row's products."""
    scores = room[: len(query) * len(bias)].reshape(len(query), len(bias))
    np.matmul(query, vectors, out=scores)
    scores += bias
    if (top := scores.max()) > 60:  # rare; exp() would overflow
        scores -= scores.max(1, keepdims=True) if np.isfinite(top) else 0
    picked = scores[np.arange(len(column)), column].astype(np.float64)
    np.exp(scores, out=scores)
    return picked - np.log(scores.sum(1))


def count_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            counts.update(tokens(text))
            if len(counts) > 300_000:
                yield from _counted(counts)
                counts.clear()
    yield from _counted(counts)


def _counted(counts: Counter) -> Iterator[pa.RecordBatch]:
    if counts:
        yield from common.pieces({"word": pa.array(list(counts), pa.binary()), "tail": pa.array(map(tail, counts), pa.int32()), "n": pa.array(counts.values(), pa.int64())})


#: The scores, in order.
SCORES = {"n_tokens": "long", "n_known": "long", "train_tokens": "long", "base_score": "double", "score": "double"}


def scored(rows: DataFrame, learned: Column, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, ``keep``, columns of ``SCORES``) for every row; ``learned`` says which
    rows are learned from."""
    spark = rows.sparkSession
    text = F.col(text_col).cast("binary").alias("text")
    vocabulary = common.stored(rows.where(learned).select(text).mapInArrow(count_words, "word binary, tail int, n long").groupBy("word", "tail").agg(F.sum("n").alias("n")))
    total, distinct = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    least = kth_largest(vocabulary, "n", COUNTED)  # no sort of all words
    frequent = vocabulary.where((F.col("word") != F.lit(END_TOKEN)) & (F.col("n") > F.lit(least))).toArrow().to_pydict()
    ends = vocabulary.where(F.col("word") == F.lit(END_TOKEN)).first()
    ordered = sorted(zip(frequent["word"], frequent["n"]), key=lambda x: (-x[1], x[0]))
    words, n_of = [w for w, _ in ordered], np.array([n for _, n in ordered], np.float64)
    shape = Shape(min(own_words(total), len(words)))
    # Tails: what is counted in them, and how many words they hold.
    tails = vocabulary.groupBy("tail").agg(F.sum("n").alias("n"), F.count("*").alias("v")).toArrow().to_pydict()
    tail_n, tail_v = np.zeros(TAILS), np.zeros(TAILS)
    tail_n[tails["tail"]], tail_v[tails["tail"]] = tails["n"], tails["v"]
    for w, n in [*zip(words[: shape.own], n_of), *([(END_TOKEN, ends["n"])] if ends else [])]:
        tail_n[tail(w)] -= n
        tail_v[tail(w)] -= 1
    counts = np.concatenate([[0, ends["n"] if ends else 0], n_of[: shape.own], tail_n])
    # Words that are counted but have no vector come after the ids, in order; the
    # tails of unknown words last.
    base_of = lambda n: np.log10(n + 0.5) - np.log10(total + 0.5 * (distinct + 1))
    share_of = np.log10(tail_n + 0.5 * (tail_v + 1))
    model = spark.sparkContext.broadcast((words, n_of, shape, counts[END] > 0, base_of(counts[END]), base_of(n_of), share_of))
    own = [id_col, *keep]
    turn = F.when(learned, F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in dict.fromkeys((id_col, text_col)))), F.lit(ROUNDS))).alias("turn")
    asked = rows.select(text, turn, F.monotonically_increasing_id().alias("row"), *(F.col(f"`{c}`").alias(f"own_{i}") for i, c in enumerate(own)))
    kinds = lambda df: ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    placed_rows = common.stored(asked.mapInArrow(_place(model), f"{kinds(asked.drop('text'))}, n_tokens long, n_known long, base double, share double, ids binary, rare array<binary>"))
    params = trained(placed_rows.where("turn is not null").select("ids", "turn"), words[: shape.own], counts, shape, total)
    known = placed_rows.select("ids", "row", *(f"own_{i}" for i in range(len(own))), "n_tokens", "n_known", "base", "share")
    first = common.stored(known.mapInArrow(_score(spark.sparkContext.broadcast((params, shape))), f"{kinds(known.drop('ids', 'share'))}, bits double"))

    rare = placed_rows.where(F.size("rare") > 0).select("row", F.explode("rare").alias("word"))
    met = rare.join(vocabulary.select("word", "n"), "word", "left").select("row", F.coalesce("n", F.lit(0)).alias("n"))
    base = F.log10(F.col("n") + 0.5) - F.lit(float(np.log10(total + 0.5 * (distinct + 1))))
    sums = met.repartition("row").groupBy("row").agg(F.sum((F.col("n") > 0).cast("long")).alias("k"), F.sum(base).alias("b"), F.sum(F.log10(F.col("n") + 0.5)).alias("s"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return first.join(sums, "row", "left").select(
        *(F.col(f"own_{i}").alias(c) for i, c in enumerate(own)), "n_tokens", (F.col("n_known") + zero("k")).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") + zero("b")).alias("base_score"), (F.col("bits") + zero("s")).alias("score"),
    )


def _place(model):
    """(text, turn, row, ..) to (turn, row, .., sums over the words whose counts are at
    hand, ids, and the other words)."""
    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, n_of, shape, ends, end_base, bases, shares = model.value
        own, tails = shape.own, FIRST + shape.own
        # By place: the id, the base score, the share of a tail, known or not.
        known = np.array([tail(w) for w in words[own:]], np.int64)
        id_of = np.concatenate([np.arange(tails + TAILS), tails + known])
        base_of = np.concatenate([[0.0, end_base], bases[:own], np.zeros(TAILS), bases[own:]])
        share_of = np.concatenate([np.zeros(tails), -shares, np.log10(n_of[own:] + 0.5) - shares[known]])
        seen = np.concatenate([[False, ends], np.ones(own, bool), np.zeros(TAILS, bool), np.ones(len(known), bool)])
        places = Places(words[:own], own)
        places.table.update({w: tails + TAILS + i for i, w in enumerate(words[own:])})
        places.update(places.table)
        for batch in batches:
            texts = [tokens(t) for t in batch.column(0).to_pylist()]
            if not texts:
                continue
            now, counted = placed(texts, places)
            starts = np.concatenate([[0], np.cumsum(counted)[:-1]]).astype(np.int64)
            missing = (now >= tails) & (now < tails + TAILS)
            flat = list(chain.from_iterable(texts))
            rare = pa.array([flat[i] for i in np.flatnonzero(missing)], pa.binary())
            sizes = np.add.reduceat(missing.astype(np.int64), starts)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), rare)
            columns = [pa.array(counted, pa.int64()), pa.array(np.add.reduceat(seen[now].astype(np.int64), starts), pa.int64()), pa.array(np.add.reduceat(base_of[now], starts)), pa.array(np.add.reduceat(share_of[now], starts)), packed(id_of[now], counted), lists]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *columns], names=[*batch.schema.names[1:], "n_tokens", "n_known", "base", "share", "ids", "rare"])
            places.trim()

    return place


def _score(model):
    """(ids, .., share) to (.., the model's part of the score and the share)."""
    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        params, shape = model.value
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, at, starts = sequence(*unpacked(batch.column(0)))
            bits = np.add.reduceat(log_shares(params, shape, ids[at - 2], ids[at - 1], ids[at]), starts) + batch.column("share").to_numpy()
            yield pa.RecordBatch.from_arrays([*batch.columns[1:-1], pa.array(bits)], names=[*batch.schema.names[1:-1], "bits"])

    return score


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(remainder("doc_id", 5) == 1, F.lit(False)).alias("held_out"))
    return scored(docs, remainder("doc_id", 5) != 1, keep=("held_out",))
