"""Lexical retrieval packing of whole documents into training sequences.

Every document is tokenized whole and closed by one end id. Its full windows of
``LENGTH`` tokens are sequences of their own; what remains (under ``LENGTH``
tokens) goes to a shard. A shard holds an inverted index of its remainders,
scored by BM25. Remainders are taken in order as seeds; a seed's best unused
neighbours fill its window greedily, the last one is cut to fit, and its rest
goes back to the index as a document still to be placed. What stays unfilled at
the end of a shard is cut into sequences whose lengths are powers of two, which
need no padding.

Document frequencies, their number and the mean length are those of all passages
(full windows and remainders) of the table. A query is all terms of the seed that
weigh something; terms in more than half of all passages weigh nothing.

Remainders are dealt to shards by what they hold: their BM25 weights, projected at
random to ``WIDTH`` numbers, go down a tree whose nodes split a sample of them
(``SAMPLE``, or 16 a shard if these are more) along its main direction, in
proportion to the shards below. So texts on one subject and copies meet in a shard
at every size of the table; neighbours that a split parts are not found (the
README has figures). A leaf of more than twice ``SHARD_DOCS`` remainders, as many
copies of a text make, is dealt in turn over shards of its own, so a shard is a
few MB of token ids.

Remainders' ids (two bytes each) are stored twice and shuffled once; documents of
any length cost one row per full window besides. If the terms find too few
neighbours, the next unused remainders follow in order, so no window waits for one.

Defined results
* null or empty text: just the end id; null ids and repeated rows are packed
  each; empty table: no rows; sequence ids are unique over the table, and depend
  on how the table is dealt over its partitions;
* equal BM25 scores: the remainder that comes first in its shard, whose order is
  that of (id, tokens of the document, ids);
* texts of any length are packed whole: a full window of a long text fills its
  sequence alone, so there is nothing to retrieve for it;
* the result has the columns of ``PIECE`` alone, whatever else the input has.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LENGTH = 1024
SHARD_DOCS = 3000
K1, B = 1.2, 0.75
#: Neighbours that are sorted first; a window rarely takes more.
FEW = 16
#: Numbers that a remainder's weights are projected to, and how many are sampled.
WIDTH, SAMPLE = 64, 20_000
TERMS = 1 << 16
#: How byte-level vocabularies split a text (fixed value, from the format).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+$|\s+(?!\S)|\s"""
#: The same for texts without two white spaces in a row; no look-ahead, so faster.
PLAIN = PATTERN.replace(r"\s+$|\s+(?!\S)|", "")


class Encoder:
    """Ids of whole texts under a byte-level BPE vocabulary file.

    The vocabulary and special tokens come from the file. tiktoken applies them:
    it gives the ids that tokenizers gives (a test holds them against each
    other), four times as fast. Special strings in texts become their ids.
    """

    def __init__(self, file: str) -> None:
        import tiktoken

        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        before = spec["pre_tokenizer"]
        if spec["normalizer"] or before["type"] != "ByteLevel" or before["add_prefix_space"] or not before["use_regex"]:
            raise ValueError("only plain byte-level vocabularies are read")
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        letters = byte_of_letter()
        ranks = {bytes(map(letters.__getitem__, w)): i for w, i in spec["model"]["vocab"].items() if w not in special}
        if max([*ranks.values(), *special.values()]) >= 1 << 16:
            raise ValueError("ids must fit in two bytes")
        self.own, self.plain = (tiktoken.Encoding("own", pat_str=p, mergeable_ranks=ranks, special_tokens=special) for p in (PATTERN, PLAIN))

    def ids(self, text: str) -> np.ndarray:
        use = self.own if spaces_in_a_row(text) else self.plain
        return use.encode_to_numpy(text, allowed_special="all").astype("<u2")


def spaces_in_a_row(text: str) -> bool:
    """Whether two white spaces may follow each other; for sure if not."""
    if not text.isascii():
        return bool(_SPACES.search(text))
    low = np.frombuffer(text.encode(), np.uint8) <= 32
    return bool((low[1:] & low[:-1]).any())


#: Python's white space has all that Unicode's has, and more.
_SPACES = re.compile(r"\s\s")


def byte_of_letter() -> dict[str, int]:
    """Byte-level files write a printable Latin-1 byte as its character, and the
    others as the characters from 256 on, in order."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@cache
def encoder(file: str) -> Encoder:
    return Encoder(file)


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


#: A piece of a document: where it lies in the document and in its sequence.
PIECE = {"doc_id": "long", "start": "long", "length": "long", "ids_crc32": "long", "doc_tokens": "long", "sequence_id": "long", "offset": "long"}
_TYPES = [pa.int64()] * 7
#: Sequence ids: those of full windows are even, those of shards odd. A partition
#: has room for 2^36 windows (2^26 partitions), a shard for 2^16 sequences (2^46
#: shards): a shard has at most twice SHARD_DOCS remainders of under a window each,
#: and a few more sequences from its last one.
_WINDOWS, _SEQUENCES = 1 << 36, 1 << 16


def window_id(part: int, k: int) -> int:
    return 2 * (part * _WINDOWS + k)


def shard_sequence_id(shard: int, k: int) -> int:
    return 2 * (shard * _SEQUENCES + k) + 1


def _cut(file: str, length: int, end_id: int):
    """Rows of a piece: full windows, and remainders with their ids. Rows that start
    at -1 follow: a term in the place of the id, its passages in that of the length."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        enc, sequence, df = encoder(file), 0, np.zeros(TERMS, np.int64)
        for batch in batches:
            rows, rest = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.append(enc.ids(text or ""), np.uint16(end_id))
                n = len(ids)
                for at in range(0, n - n % length, length):
                    rows.append((doc, at, length, crc(ids[at : at + length]), n, window_id(part, sequence), 0))
                    rest.append(None)
                    df[_terms(ids[at : at + length])] += 1
                    sequence += 1
                if n % length:
                    at = n - n % length
                    rows.append((doc, at, n - at, None, n, None, None))
                    rest.append(ids[at:].astype("<u2").tobytes())
                    df[_terms(ids[at:])] += 1
            columns = [pa.array(c, pa.int64()) for c in zip(*rows)]
            if rows:
                yield pa.RecordBatch.from_arrays([*columns, pa.array(rest, pa.binary())], names=[*PIECE, "ids"])
        terms = np.flatnonzero(df)
        none = pa.nulls(len(terms), pa.int64())
        yield from common.pieces(dict(zip([*PIECE, "ids"], [pa.array(terms, pa.int64()), pa.array(np.full(len(terms), -1), pa.int64()), pa.array(df[terms], pa.int64()), none, none, none, none, pa.nulls(len(terms), pa.binary())])))

    return cut


def _terms(ids: np.ndarray) -> np.ndarray:
    """Distinct ids; with counts numpy sorts them, which is faster than its hashing."""
    return np.unique(ids, return_counts=True)[0]


class Statistics:
    """Weights of terms, from all passages that a term may stand in."""

    def __init__(self, df: np.ndarray, n: int, mean: float) -> None:
        self.idf = np.log((n - df + 0.5) / (df + 0.5)).astype(np.float32)
        self.mean = max(1.0, mean)

    @classmethod
    def of(cls, docs: list[np.ndarray]) -> Statistics:
        df = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=TERMS)
        return cls(df, len(docs), sum(map(len, docs)) / len(docs))

    def weights(self, terms: np.ndarray, counts: np.ndarray, sizes: np.ndarray | int) -> np.ndarray:
        return self.idf[terms] * counts * (K1 + 1) / (counts + K1 * (1 - B + B * sizes / self.mean))


@cache
def _signs() -> np.ndarray:
    return np.random.default_rng(8).integers(0, 2, (TERMS, WIDTH), np.int8) * np.int8(2) - np.int8(1)


def sketch(ids: np.ndarray, stats: Statistics) -> np.ndarray:
    """The direction of a remainder's weights, projected."""
    terms, counts = np.unique(ids, return_counts=True)
    weights = np.maximum(stats.weights(terms, counts.astype(np.float32), len(ids)), 0).astype(np.float32)
    out = weights @ _signs()[terms].astype(np.float32)
    return out / max(1e-9, float(np.sqrt(out @ out)))


class Tree:
    """Leaves for sketches: each node splits along its sample's main direction."""

    def __init__(self, sample: np.ndarray, shards: int) -> None:
        self.direction, self.least, self.below = [], [], []
        stack = [(np.arange(len(sample)), shards, None)]
        while stack:
            own, count, parent = stack.pop()
            node = len(self.least)
            if parent is not None:
                self.below[parent[0]][parent[1]] = node
            self.direction.append(np.zeros(WIDTH, np.float32))
            self.least.append(np.inf)
            self.below.append([node, node])  # a leaf stays where it is
            if count < 2 or len(own) < 2:
                continue
            x = sample[own] - sample[own].mean(0)
            along = np.linalg.eigh(x.T @ x)[1][:, -1].astype(np.float32)
            place = np.round(np.einsum("nw,w->n", sample[own], along), 5)
            at = len(own) * (count // 2) // count
            least = np.partition(place, at)[at]
            if least == place.min():  # many copies: all of them to the lower side
                least = place[place > least].min(initial=np.inf)
            up = place >= least
            if not up.any():
                continue
            lower = min(count - 1, max(1, round(count * float((~up).mean()))))
            # Between two rounded values, so that copies stay together.
            self.direction[node], self.least[node] = along, float(least) - 5e-6
            stack += [(own[~up], lower, (node, 0)), (own[up], count - lower, (node, 1))]
        self.direction, self.least, self.below = np.array(self.direction), np.array(self.least), np.array(self.below)

    def leaves(self, sketches: np.ndarray) -> np.ndarray:
        at = np.zeros(len(sketches), np.int64)
        while True:
            up = np.einsum("nw,nw->n", sketches, self.direction[at]) >= self.least[at]
            then = self.below[at, up.astype(np.int64)]
            if (then == at).all():
                return at
            at = then


def _sketches(stats: Statistics):
    def sketches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sketch(np.frombuffer(b, "<u2"), stats).tobytes() for b in batch.column(0).to_pylist()], pa.binary())], names=["sketch"])

    return sketches


def _route(stats: Statistics, tree: Tree):
    """Rows (.., ids) with the leaf of each."""
    def route(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [sketch(np.frombuffer(b, "<u2"), stats) for b in batch.column(batch.num_columns - 1).to_pylist()]
            leaves = tree.leaves(np.array(own, np.float32).reshape(-1, WIDTH))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaves, pa.int64())], names=[*batch.schema.names, "leaf"])

    return route


class Index:
    """BM25 postings of the remainders in a shard; placed ones are skipped."""

    def __init__(self, docs: list[np.ndarray], stats: Statistics) -> None:
        self.used = np.zeros(len(docs), bool)
        n = self.live = len(docs)
        found = [np.unique(d, return_counts=True) for d in docs]
        terms = np.concatenate([t for t, _ in found]).astype(np.int64)
        counts = np.concatenate([c for _, c in found]).astype(np.float32)
        owner = np.repeat(np.arange(n), [len(t) for t, _ in found])
        weight = stats.weights(terms, counts, np.array([len(d) for d in docs], np.float32)[owner])
        # A term of one remainder finds no other.
        keep = (np.bincount(terms, minlength=TERMS)[terms] > 1) & (weight > 0)
        order = np.flatnonzero(keep)
        order = order[np.argsort(terms[order], kind="stable")]
        self.owner, self.weight = owner[order], weight[order].astype(np.float64)
        self.bounds = np.searchsorted(terms[order], np.arange(TERMS + 1))
        self.query = np.split(terms[keep], np.cumsum(np.bincount(owner[keep], minlength=n))[:-1])

    def _drop_used(self) -> None:
        """Take placed remainders out of the postings once they are a fifth of them;
        the order of the others, so their scores, stay."""
        live = len(self.used) - int(np.count_nonzero(self.used))
        if live > 0.8 * self.live:
            return
        keep = ~self.used[self.owner]
        self.bounds = np.concatenate([[0], np.cumsum(keep)])[self.bounds]
        self.owner, self.weight, self.live = self.owner[keep], self.weight[keep], live

    def neighbours(self, seed: int) -> Iterator[int]:
        """Unused documents that share a query term, best first, smaller numbers
        first among equals. The few best are sorted before the others."""
        self._drop_used()
        own = self.query[seed]
        spans = [slice(lo, hi) for lo, hi in zip(self.bounds[own].tolist(), self.bounds[own + 1].tolist()) if lo < hi]
        if not spans:
            return
        scores = np.bincount(np.concatenate([self.owner[s] for s in spans]), np.concatenate([self.weight[s] for s in spans]), len(self.used))
        scores[self.used] = 0
        docs = np.flatnonzero(scores)
        scores = scores[docs]
        least = np.partition(scores, len(scores) - FEW)[len(scores) - FEW] if len(scores) > FEW else 0.0
        for some in (scores >= least, scores < least):
            own = docs[some]
            yield from own[np.argsort(-scores[some], kind="stable")].tolist()


def pack_shard(docs: list[np.ndarray], length: int = LENGTH, stats: Statistics | None = None) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, size) pieces. All but a shard's last are
    full; that one is cut into powers of two."""
    index, out = Index(docs, stats or Statistics.of(docs)), []
    begin = np.zeros(len(docs), np.int64)
    sizes = np.array([len(d) for d in docs])
    after = 0
    window: list[tuple[int, int, int]] = []
    for seed in range(len(docs)):
        while not index.used[seed]:
            window, room, queue = [], length, chain([seed], index.neighbours(seed))
            while room:
                doc = next(queue, None)
                if doc is None:  # none shares a term: the next in order
                    while after < len(docs) and index.used[after]:
                        after += 1
                    if after == len(docs):
                        break
                    doc = after
                if index.used[doc]:
                    continue
                size = int(min(room, sizes[doc] - begin[doc]))
                window.append((doc, int(begin[doc]), size))
                begin[doc] += size
                room -= size
                index.used[doc] = begin[doc] == sizes[doc]
            if room == 0:
                out.append(window)
                window = []
    return out + in_powers(window)


def in_powers(window: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """The same pieces in order, cut into sequences of power-of-two lengths."""
    total, out = sum(s for _, _, s in window), []
    pieces = list(window)[::-1]
    while total:
        room = 1 << (total.bit_length() - 1)
        total, own = total - room, []
        while room:
            doc, start, size = pieces.pop()
            own.append((doc, start, min(size, room)))
            if size > room:
                pieces.append((doc, start + room, size - room))
            room -= own[-1][2]
        out.append(own)
    return out


def _pack(stats: Statistics, length: int):
    def pack(left: pa.Table) -> pa.Table:
        shard = left.column("shard")[0].as_py()
        left = left.sort_by([("doc_id", "ascending"), ("doc_tokens", "ascending"), ("ids", "ascending")])
        docs = [np.frombuffer(b, "<u2") for b in left.column("ids").to_pylist()]
        names, base, tokens = (left.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens"))
        rows = []
        for k, window in enumerate(pack_shard(docs, length, stats)):
            offset = 0
            for doc, start, size in window:
                rows.append((names[doc], base[doc] + start, size, crc(docs[doc][start : start + size]), tokens[doc], shard_sequence_id(shard, k), offset))
                offset += size
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=list(PIECE))

    return pack


def packed(rows: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, shard_docs: int = SHARD_DOCS, end_id: int = 0) -> DataFrame:
    """The pieces of all documents, with the columns of ``PIECE``."""
    spark = rows.sparkSession
    kinds = ", ".join(f"{k} {v}" for k, v in PIECE.items())
    path = common.shared_dir(spark)
    cut = common.stored(rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_cut(tokenizer_file, length, end_id), f"{kinds}, ids binary"), path)
    counted = cut.where("start < 0").groupBy("doc_id").agg(F.sum("length").alias("n")).toArrow()
    df = np.zeros(TERMS, np.int64)
    df[counted.column("doc_id").to_numpy()] = counted.column("n").to_numpy()
    passages, tokens, remainders = cut.where("start >= 0").agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0)), F.count("ids")).first()
    stats = Statistics(df, passages, tokens / max(1, passages))
    full, left = cut.where("start >= 0 and ids is null").select(*PIECE), cut.where("ids is not null")
    shards = max(1, -(-remainders // shard_docs))
    chosen = left.where(F.rand(8) < max(SAMPLE, 16 * shards) / max(1, remainders)).select("ids")
    sample = chosen.mapInArrow(_sketches(stats), "sketch binary").toArrow().column(0).to_pylist() if shards > 1 else []
    tree = Tree(np.frombuffer(b"".join(sample), np.float32).reshape(-1, WIDTH), shards)
    routed = common.stored(left.mapInArrow(_route(stats, tree), f"{kinds}, ids binary, leaf long"))
    # Shards of a leaf follow each other; only oversized leaves have several.
    leaves = routed.groupBy("leaf").agg(F.ceil(F.count("*") / (2 * shard_docs)).cast("long").alias("parts")).orderBy("leaf").toArrow().to_pydict()
    first = np.cumsum([0, *leaves["parts"]]).tolist()
    places = spark.createDataFrame([*zip(leaves["leaf"], leaves["parts"], first)], "leaf long, parts long, first long")
    shard = F.col("first") + F.col("turn") % F.col("parts")
    dealt = routed.withColumn("turn", F.monotonically_increasing_id()).join(F.broadcast(places), "leaf").select(*PIECE, "ids", shard.alias("shard"))
    return full.union(dealt.groupBy("shard").applyInArrow(_pack(stats, length), kinds))


def op8_packing(spark: SparkSession, sf_dir: str, tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    from .tokens import tokenizer_file

    return packed(common.table(spark, sf_dir, "documents"), tokenizer_file(tokenizer))
