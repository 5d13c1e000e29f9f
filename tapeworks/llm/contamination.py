"""Benchmark decontamination by Wu-Manber search over words.

Test strings are the windows of ``WINDOW`` consecutive item words (a shorter item
is one window). Windows of one length form a set that is searched at once: a
shift table over blocks of ``BLOCK`` words tells how far the search may jump when
the block before the cursor is not near the end of any window, and for blocks
that end a window the window's other words are looked up in the bucket of its
suffix and compared directly. Jumps are at most a window long, so texts without
benchmark words cost about one table look-up per ``WINDOW - BLOCK + 1`` words.

The items are the searched-for set, the documents the table of any size: the
items travel in blocks of at most ``BLOCK_BYTES`` of text each, and every block
searches all documents in one pass without a shuffle. With one block, rows are
final as they are; with more, each block returns the hit intervals and the items
of the documents that it found something in, and these are added up per document
(a sum over the blocks of one document, so no group grows with the corpus).

Defined results
* null or wordless text: 0 words, no hits, not contaminated; null or wordless
  items have no window; items with equal text both count, rows with equal item_id are
  one item; a null item_id is the empty string;
* repeated rows and null document ids are judged each; empty tables: no rows,
  or no hits; texts of any length are searched whole; input columns with the
  names of the results give way to them, other extra columns pass as they are,
  whatever their names and however many blocks there are.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW = 13
BLOCK = 2
#: Bytes of item text in a block; a task holds the tables of one block.
BLOCK_BYTES = 16 << 20
#: Word bytes stay, A-Z in lower case; the other ASCII bytes separate words.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


class Patterns:
    """Wu-Manber tables for windows of one length."""

    def __init__(self, size: int) -> None:
        self.size, self.block = size, min(BLOCK, size)
        self.most = size - self.block + 1
        self.shift: dict[tuple, int] = {}
        self.buckets: dict[tuple, dict[tuple, set[int]]] = defaultdict(dict)

    def add(self, window: tuple, item: int) -> None:
        b = self.block
        for end in range(b, self.size + 1):
            key, jump = window[end - b : end], self.size - end
            if jump < self.shift.get(key, self.most):
                self.shift[key] = jump
        self.buckets[window[-b:]].setdefault(window, set()).add(item)

    def search(self, text: list[bytes]) -> Iterator[tuple[int, set[int]]]:
        """Start and items of every occurrence."""
        b, m, n, most = self.block, self.size, len(text), self.most
        shift, get = self.shift, self.shift.get
        at = m
        while at <= n:
            block = (text[at - 2], text[at - 1]) if b == 2 else (text[at - 1],)
            jump = get(block, most)
            if jump:
                at += jump
                continue
            found = self.buckets[block].get(tuple(text[at - m : at]))
            if found:
                yield at - m, found
            at += 1


class Matcher:
    def __init__(self, items: Iterable[tuple[int, str | None]], window: int = WINDOW) -> None:
        self.sets: dict[int, Patterns] = {}
        for item, text in items:
            w = words(text)
            size = min(window, len(w))
            if size:
                patterns = self.sets.setdefault(size, Patterns(size))
                for i in range(len(w) - size + 1):
                    patterns.add(tuple(w[i : i + size]), item)

    def hits(self, text: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Merged intervals of hit words, and the items with an occurrence."""
        spans, items = [], set()
        for size, patterns in self.sets.items():
            for start, found in patterns.search(text):
                spans.append((start, start + size))
                items |= found
        return merged(spans), items


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


#: The judged columns, in order.
JUDGED = {"n_words": "long", "n_hit": "long", "n_items": "long", "items_sha256": "string", "contaminated": "boolean"}


def _verdict(n_words: int, n_hit: int, ids: list[str]) -> tuple:
    ids = list(set(ids))
    return n_words, n_hit, len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), n_hit > 0 and 20 * n_hit >= n_words


def _columns(rows: list[tuple]) -> list[pa.Array]:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
    return [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]


def _blocks(items: DataFrame, block_bytes: int) -> Iterator[list[tuple[str, str | None]]]:
    block, size = [], 0
    for r in items.toLocalIterator():
        block.append(("" if r[0] is None else str(r[0]), r[1]))
        size += len(r[1] or "") + 64
        if size >= block_bytes:
            yield block
            block, size = [], 0
    if block:
        yield block


def judged(rows: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``rows`` with the columns of ``JUDGED`` appended."""
    spark = rows.sparkSession
    rows, schema = common.with_columns(rows, JUDGED)
    place = rows.columns.index(text_col)
    blocks = _blocks(items.select(item_id, item_text), block_bytes)
    first, second = next(blocks, []), next(blocks, None)

    if second is None:
        shared, name = spark.sparkContext.broadcast(first), uuid.uuid4().hex

        def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, matcher = _matcher(name, shared, window)
            for batch in batches:
                out = []
                for text in batch.column(place).to_pylist():
                    w = words(text)
                    spans, found = matcher.hits(w)
                    out.append(_verdict(len(w), sum(e - s for s, e in spans), [ids[i] for i in found]))
                yield pa.RecordBatch.from_arrays([*batch.columns, *_columns(out)], names=[*batch.schema.names, *JUDGED])

        return rows.mapInArrow(judge, schema)

    # Many blocks: rows get a number once, so that blocks can be added up by row;
    # the input's own columns stay in a struct, out of the way of its name.
    columns = [F.col(f"`{c}`") for c in rows.columns]
    numbered = common.stored(rows.select(F.monotonically_increasing_id().alias("row"), F.struct(*columns).alias("own")))
    texts, parts = numbered.select("row", F.col(f"own.`{text_col}`").alias("text")), None
    for block in (b for bs in ([first, second], blocks) for b in bs):
        part = common.stored(texts.mapInArrow(_partial(spark.sparkContext.broadcast(block), window), "row long, n_words long, spans array<struct<s:long,e:long>>, items array<string>"))
        parts = part if parts is None else parts.unionByName(part)
    added = parts.groupBy("row").agg(F.max("n_words").alias("n"), F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, n, spans, ids = (c.to_pylist() for c in batch.columns)
            out = [_verdict(n[i], sum(e - s for s, e in merged((x["s"], x["e"]) for x in spans[i])), ids[i]) for i in range(len(row))]
            yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), *_columns(out)], names=["row", *JUDGED])

    kinds = ", ".join(f"{k} {v}" for k, v in {"row": "long", **JUDGED}.items())
    joined = numbered.join(added.mapInArrow(add, kinds), "row")
    return joined.select(*(F.col(f"own.`{c}`").alias(c) for c in rows.columns), *JUDGED)


_MATCHERS: dict[str, tuple[list[str], Matcher]] = {}


def _matcher(name: str, shared, window: int) -> tuple[list[str], Matcher]:
    """Ids and tables of the block of that name, built once by a worker; it holds
    one block's."""
    if name not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[name] = [i for i, _ in shared.value], Matcher(enumerate(t for _, t in shared.value), window)
    return _MATCHERS[name]


def _partial(shared, window: int):
    name = uuid.uuid4().hex

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matcher = _matcher(name, shared, window)
        for batch in batches:
            sizes, spans, items = [], [], []
            for text in batch.column(1).to_pylist():
                w = words(text)
                s, found = matcher.hits(w)
                sizes.append(len(w))
                spans.append([{"s": a, "e": b} for a, b in s])
                items.append([ids[i] for i in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(spans, pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))), pa.array(items, pa.list_(pa.string()))], names=["row", "n_words", "spans", "items"])

    return search


def op10_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return judged(docs, common.table(spark, sf_dir, "benchmark")).drop("text")
