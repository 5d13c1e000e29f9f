"""N-gram Jaccard join: classes of texts whose word shingles overlap.

Two texts link when the Jaccard similarity of their sets of word shingles is at
least ``PERCENT`` / 100; the result names each text's connected component.

1. Texts with equal sets are one node, so groups of copies take part once; each
   task passes a set on once. A node's key is a hash of 64 bits; a second hash is
   held against it, and sets that share the first but not the second get new keys.
2. Candidates. If two sets link, at most 3/37 of their summed sizes (for 85 %) is
   in one but not in the other. A set's hashes are cut into more ranges than that
   by value, and each range that is not empty gives a signature of all its
   hashes; so linked sets share signatures, at least as many as one of them has
   beyond that bound. The number of ranges depends on the size class; a set near the
   lower end of its class also gives the ranges of the class below. A set whose
   hashes fill no more ranges than the bound also gives its first hashes in the
   global order, as many as it must share one of with every other such set. As many
   signatures are shared, each set may leave out one less, and leaves out those
   that most sets have (one order for all sets): they come from passages that many
   texts hold. Sets sharing a signature that is left are joined to candidate groups.
   Signatures that very many sets have are found in a sample and counted on the map
   side first; the others are counted in a window, where none is large.
3. Prefix-tree join. The sets of a group, in the global order of shingles (that of
   their hashes), form a prefix tree; all sets walk down together, carrying their
   overlaps with the path so far, so sets with a common beginning share that work,
   and leave a subtree once overlap so far plus what can still come falls short of
   the size needed for the shortest set below. At the leaves overlaps are whole and
   exact. Pairs already in one component are not compared again.
4. Groups of more than ``CHUNK_SETS`` sets are cut into chunks. Each component of
   a chunk names a pivot and how far its members are from it. Pivots are compared
   with each other if they are at most ``CHUNK_SETS``; if more, with those alone
   whose members share a signature that is left (blocks by signature, each equal
   block once), so a group with few links is not compared all with all. By the
   triangle inequality of the set difference only those chunk components are
   compared in full that could still hold a link.

Tasks hold a chunk or two, whatever the group; nothing is dropped or capped.
Sets are compared as 64-bit hashes of shingles. Rows of hot keys (copies of one text,
members of one large class) get their component by ``common.looked_up``. What is
stored between the steps goes when the last one is stored.

Defined results
* null text, or no word: 0 shingles, its own component; fewer words than a
  shingle has: the whole sequence is one shingle; texts of any length are one set;
* equal texts, repeated rows: one component; a component's id is its smallest
  non-null id, null if all are null; empty table: no rows;
* the result has the id, n_shingles and component_id alone, whatever other columns
  the input has and whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .components import components

SIZE = 4
PERCENT = 85
CHUNK_SETS = 512
CHUNK_SHINGLES = 400_000
#: Size classes of sets: up to SMALL, then each GROWTH times as large.
SMALL, GROWTH, SMALL_RANGES = 36, 1.4, 64
#: One of so many signatures is sampled for hot ones; at most 1 / HOT_SIGNS are.
SAMPLED, HOT_SIGNS, LEAST_SEEN = 64, 1e-5, 24
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        self[word] = out = xxhash.xxh3_64_intdigest(word)
        return out


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingle_set(text: bytes | None, hashes: dict[bytes, int], size: int = SIZE) -> np.ndarray:
    """Sorted hashes of the distinct shingles of a whole text."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    span = min(size, len(h))
    n = len(h) - span + 1
    out = np.full(n, span, np.uint64)
    for i in range(span):
        out = mixed(out * _ODD[i % 4] + h[i : i + n])
    return np.unique(out)


def most_apart(a, b, percent: int = PERCENT):
    """Most shingles that linked sets of sizes a and b don't share."""
    return (a + b) * (100 - percent) // (100 + percent)


def size_class(n: int) -> int:
    c, top = 0, float(SMALL)
    while n > top:
        c, top = c + 1, top * GROWTH
    return c


def ranges_of(c: int, percent: int = PERCENT) -> int:
    """Ranges of a class: more than the most shingles that a set of it and a
    linked one of this class or the next don't share, and some to spare."""
    top = int(SMALL * GROWTH**c)
    return max(SMALL_RANGES if c == 0 else 0, int(1.25 * most_apart(top, top * 100 // percent, percent)) + 6)


def signatures(hashes: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, list[int]]:
    """A number for each non-empty range of the set, by class, then for the first
    hashes if the ranges may not do; for each of these parts how many there are and
    how many of them a linked set shares at least."""
    n = len(hashes)
    own = size_class(n)
    out, cuts, short = [], [], False
    for c in {own, size_class(-(-n * percent // 100))}:
        place = ((hashes >> np.uint64(32)) * np.uint64(ranges_of(c, percent))) >> np.uint64(32)
        starts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        total = np.add.reduceat(hashes, starts)
        out.append(mixed(total + (place[starts] + np.uint64(c << 40)) * _ODD[0]))
        partner = n * 100 // percent if c == own else int(SMALL * GROWTH**c)
        shared = len(starts) - most_apart(n, partner, percent)
        short |= shared < 1
        cuts += [len(starts), max(1, shared)]
    if short:
        first = hashes[: n + 1 - -(-n * percent // 100)]
        out.append(mixed(first ^ _ODD[1]))
        cuts += [len(first), 1]
    return np.concatenate(out).view(np.int64), cuts


def _hashed(hashes: np.ndarray, seed: int) -> int:
    return int(np.array([xxhash.xxh3_64_intdigest(hashes.tobytes(), seed)], np.uint64).view(np.int64)[0])


def set_key(hashes: np.ndarray) -> int:
    return _hashed(hashes, 0)


def set_check(hashes: np.ndarray) -> int:
    return _hashed(hashes, 1)


_SIGNED = "id long, row_key long, n long, set_key long, check long, signs array<long>, cuts array<int>"


def _describe(size: int, percent: int):
    """(id, key, text) to the columns of ``_SIGNED``; the signatures of a set are
    given once by a task."""
    def describe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = WordHashes(), set()
        for batch in batches:
            sizes, keys, checks, signs, cuts = [], [], [], [], []
            for text in batch.column(2).to_pylist():
                s = shingle_set(text, hashes, size)
                sizes.append(len(s))
                keys.append(set_key(s) if len(s) else None)
                checks.append(set_check(s) if len(s) else None)
                new = signatures(s, percent) if len(s) and (keys[-1], checks[-1]) not in seen else (None, None)
                signs.append(new[0])
                cuts.append(new[1])
                seen.add((keys[-1], checks[-1]))
            if len(seen) > 500_000:
                seen.clear()
            columns = [batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in (sizes, keys, checks)), pa.array(signs, pa.list_(pa.int64())), pa.array(cuts, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "row_key", "n", "set_key", "check", "signs", "cuts"])

    return describe


def told_apart(signed: DataFrame, path: str) -> DataFrame:
    """The same with new keys for sets that share a key but not its check."""
    for turn in range(10):
        twice = signed.where("set_key is not null").groupBy("set_key").agg(F.min("check").alias("lo"), F.max("check").alias("hi")).where("lo <> hi").select("set_key", F.lit(True).alias("twice"))
        if twice.isEmpty():
            return signed
        key = F.when(F.col("twice"), F.xxhash64("set_key", "check", F.lit(turn))).otherwise(F.col("set_key"))
        signed = common.stored(signed.join(twice, "set_key", "left").withColumn("set_key", key).select(*signed.columns), f"{path}/signed{turn}")
    raise ValueError("different sets keep equal keys")


def _sets(size: int):
    """(set_key, grp, part, pieces, bin, check, text) to the first five with the
    set's hashes; rows whose text does not have the set, and repeats, are left out."""
    def sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = WordHashes(), set()
        for batch in batches:
            keep, blobs = [], []
            for i, (key, part, check, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 2, 5, 6)))):
                s = shingle_set(text, hashes, size)
                if (key, part) not in seen and len(s) and set_check(s) == check:
                    seen.add((key, part))
                    keep.append(i)
                    blobs.append(s.tobytes())
            if len(seen) > 500_000:
                seen.clear()
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(keep, pa.int64())) for c in range(5)), pa.array(blobs, pa.binary())], names=["set_key", "grp", "part", "pieces", "bin", "hashes"])

    return sets


class Group:
    """Sets joined by their prefix tree."""

    def __init__(self, sets: list[np.ndarray], percent: int = PERCENT) -> None:
        self.percent, self.count = percent, len(sets)
        self.sizes = np.array([len(s) for s in sets], np.int64)
        # Numbers of shingles follow the global order, that of their hashes.
        _, token, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        # Shingles of one set overlap with none, so paths hold the others.
        shared = df > 1
        rank = np.cumsum(shared) - 1
        bounds = np.concatenate([[0], np.cumsum(self.sizes)])
        paths = [rank[own[shared[own]]] for own in (token[bounds[i] : bounds[i + 1]] for i in range(self.count))]
        # Sets in the order of their paths, so that a subtree is a run of sets.
        self.order = np.array(sorted(range(self.count), key=lambda i: paths[i].tolist()), np.int64)
        self.paths = [paths[i] for i in self.order]
        self.sizes = self.sizes[self.order]
        self.lengths = np.array([len(p) for p in self.paths], np.int64)
        self.has = np.zeros((max(1, int(shared.sum())), self.count), np.uint8)
        for i, p in enumerate(self.paths):
            self.has[p, i] = 1
        self.root = np.arange(self.count)

    def _shared_depth(self, i: int, j: int, depth: int) -> int:
        """How far the paths of sets i..j run together, from ``depth`` on."""
        a, b = self.paths[i], self.paths[j]
        n = min(len(a), len(b))
        differ = np.flatnonzero(a[depth:n] != b[depth:n])
        return depth + int(differ[0]) if len(differ) else n

    def _unite(self, at: int, others: np.ndarray) -> None:
        roots = np.unique(np.append(self.root[others], self.root[at]))
        self.root[np.isin(self.root, roots)] = roots[0]

    def join(self) -> np.ndarray:
        """Component of each set, as the number of one of its sets."""
        everyone = np.arange(self.count)
        stack = [(0, self.count, 0, everyone, np.zeros(self.count, np.int64))]
        while stack:
            lo, hi, depth, walkers, overlap = stack.pop()
            first = self.root[lo]
            if (self.root[lo:hi] == first).all():
                stay = self.root[walkers] != first
                walkers, overlap = walkers[stay], overlap[stay]
            if not len(walkers):
                continue
            end = self._shared_depth(lo, hi - 1, depth)
            if end > depth:
                run = self.paths[lo][depth:end]
                overlap = overlap + self.has[run][:, walkers].sum(0, dtype=np.int64)
            still = int(self.lengths[lo:hi].max()) - end
            total = self.sizes[lo:hi].min() + self.sizes[walkers]
            needed = -(-total * self.percent // (100 + self.percent))
            can = overlap + np.minimum(still, self.lengths[walkers] - overlap) >= needed
            walkers, overlap = walkers[can], overlap[can]
            if not len(walkers):
                continue
            done = lo  # sets whose path ends here come first in the order
            while done < hi and self.lengths[done] == end:
                union = self.sizes[done] + self.sizes[walkers] - overlap
                hit = walkers[(100 * overlap >= self.percent * union) & (walkers != done)]
                if len(hit):
                    self._unite(done, hit)
                done += 1
            at = done
            while at < hi:
                step = self.paths[at][end]
                nxt = at + 1
                while nxt < hi and self.paths[nxt][end] == step:
                    nxt += 1
                stack.append((at, nxt, end, walkers, overlap))
                at = nxt
        out = np.empty(self.count, np.int64)
        out[self.order] = self.order[self.root]
        return out


def apart(sets: list[np.ndarray], at: int) -> np.ndarray:
    """Size of the difference of one set from every set."""
    flat, sizes = np.concatenate(sets), np.array([len(s) for s in sets], np.int64)
    own = sets[at]
    place = np.minimum(np.searchsorted(own, flat), len(own) - 1)
    common_n = np.add.reduceat((own[place] == flat).astype(np.int64), np.concatenate([[0], np.cumsum(sizes)[:-1]]))
    return sizes + len(own) - 2 * common_n


_LOCAL = "set_key long, grp long, root long, radius long, longest long, hashes binary"


def _join_parts(percent: int):
    """Sets of many parts (group, chunk) to their component in the part. Those of
    cut groups keep their hashes; their roots carry radius and longest member."""
    def join(table: pa.Table) -> pa.Table:
        rows = table.sort_by([("part", "ascending"), ("set_key", "ascending")]).to_pydict()
        out: list[tuple] = []
        parts = np.array(rows["part"], np.int64)
        bounds = [0, *(np.flatnonzero(parts[1:] != parts[:-1]) + 1).tolist(), len(parts)]
        for lo, hi in zip(bounds, bounds[1:]):
            picked = [i for i in range(lo, hi) if i == lo or rows["set_key"][i] != rows["set_key"][i - 1]]
            keys = [rows["set_key"][i] for i in picked]
            sets = [np.frombuffer(rows["hashes"][i], np.uint64) for i in picked]
            roots = Group(sets, percent).join()
            cut = rows["pieces"][lo] > 1
            for r in np.unique(roots):
                own = np.flatnonzero(roots == r)
                pivot = int(own[0])
                radius = int(apart([sets[i] for i in own], 0).max()) if cut else None
                longest = max(len(sets[i]) for i in own) if cut else None
                for i in own:
                    lead = cut and i == pivot
                    out.append((keys[i], rows["grp"][lo], keys[pivot], radius if lead else None, longest if lead else None, sets[i].tobytes() if cut else None))
        names = ["set_key", "grp", "root", "radius", "longest", "hashes"]
        kinds = [pa.int64()] * 5 + [pa.binary()]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    return join


def _compare_pivots(percent: int):
    """Of one or two blocks of pivots: links (open = false), by the prefix tree,
    and pairs whose components may still hold one (open = true)."""
    def compare(table: pa.Table) -> pa.Table:
        rows = table.to_pydict()
        sets = [np.frombuffer(b, np.uint64) for b in rows["hashes"]]
        keys, radius, longest = (np.array(rows[c], np.int64) for c in ("root", "radius", "longest"))
        roots = Group(sets, percent).join()
        found = [(int(keys[i]), int(keys[r]), False) for i, r in enumerate(roots) if i != r]
        for at in np.flatnonzero(radius > 0):
            reach = apart(sets, int(at)) - radius - radius[at]
            maybe = (roots != roots[at]) & (reach <= most_apart(longest, longest[at], percent))
            found += [(int(keys[at]), int(keys[k]), True) for k in np.flatnonzero(maybe)]
        a, b, o = zip(*found) if found else ((), (), ())
        return pa.Table.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(o, pa.bool_())], names=["a", "b", "open"])

    return compare


def linked(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """(id, n_shingles, component_id) for every row."""
    base = rows.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(id_col).cast("long"), F.xxhash64(text_col)).alias("row_key"), F.col(text_col).cast("binary").alias("text"))
    spark = base.sparkSession
    work = common.shared_dir(spark)
    signed = told_apart(common.stored(base.mapInArrow(_describe(size, percent), _SIGNED), f"{work}/signed"), work)
    known = common.stored(signed.select("id", "row_key", "n", "set_key", "check"), f"{work}/known")
    shared = common.stored(_candidates(signed, work), f"{work}/shared")
    labels = common.stored(_labels(base, known, shared, size, percent, work), f"{work}/labels")
    found = common.looked_up(known.select("id", "n", "set_key"), labels.withColumnRenamed("root", "label"), "set_key")
    docs = common.stored(found.select("id", "n", F.coalesce("label", "set_key").alias("label")))
    least = common.stored(docs.where("label is not null").groupBy("label").agg(F.min("id").alias("component_id")))
    common.discard(spark, work)
    out = common.looked_up(docs, least, "label")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("label").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def _candidates(signed: DataFrame, work: str) -> DataFrame:
    """(set_key, sign, first): signatures that a set keeps and shares, and the first
    of the sets that have them."""
    signed = signed.where("signs is not null")
    rows = signed.select("set_key", "cuts", F.posexplode("signs").alias("at", "sign"))
    second = F.col("cuts")[0] + F.coalesce(F.get("cuts", F.lit(2)), F.lit(0))
    part = F.when(F.col("at") < F.col("cuts")[0], 0).when(F.col("at") < second, 1).otherwise(2)
    rows = rows.select("set_key", "sign", part.alias("part"), (F.get("cuts", 2 * part + 1) - 1).alias("spare"))

    sampled = F.pmod(F.xxhash64("set_key", "sign"), F.lit(SAMPLED)) == 0
    total = signed.agg(F.coalesce(F.sum(F.aggregate(F.slice("cuts", 1, 1), F.lit(0), lambda a, x: a + x)), F.lit(0))).first()[0]
    least = max(LEAST_SEEN, total / SAMPLED * HOT_SIGNS)
    hot = common.stored(rows.where(sampled).groupBy("sign").agg(F.count("*").alias("n")).where(F.col("n") > least).select("sign"), f"{work}/hot_signs")
    warm = rows.join(F.broadcast(hot), "sign", "left_semi").distinct()
    met = warm.groupBy("sign").agg(F.count("*").alias("n"), F.min("set_key").alias("first"))
    met = common.stored(met, f"{work}/hot_counts")
    alike = Window.partitionBy("sign")
    # A set of many tasks comes from each of them; distinct() and the window need no
    # shuffle of their own.
    cold = rows.join(F.broadcast(hot), "sign", "left_anti").repartition("sign").distinct().withColumns({"n": F.count("*").over(alike), "first": F.min("set_key").over(alike)})
    rows = cold.unionByName(warm.join(F.broadcast(met), "sign")).where("n > 1")
    frequent = Window.partitionBy("set_key", "part").orderBy(F.desc("n"), F.desc("sign"))
    return rows.withColumn("rank", F.row_number().over(frequent)).where("rank > spare").select("set_key", "sign", "first")


def _labels(base: DataFrame, known: DataFrame, shared: DataFrame, size: int, percent: int, work: str) -> DataFrame:
    """(set_key, root) of the sets that link with another."""
    keep = lambda df, name: common.stored(df, f"{work}/{name}")
    joined = lambda edges: components(edges, f"{work}/{uuid.uuid4().hex}")
    groups = joined(shared.where("set_key != first").select(F.col("set_key").alias("a"), F.col("first").alias("b")))
    nodes = (known.where("set_key is not null").groupBy("set_key").agg(F.min(F.struct("row_key", "check", "n")).alias("x"))
        .join(groups.select(F.col("node").alias("set_key"), F.col("root").alias("grp")).hint("merge"), "set_key").select("set_key", "x.*", "grp"))
    nodes = keep(nodes, "nodes")
    pieces = F.greatest(F.ceil(F.count("*") / CHUNK_SETS), F.ceil(F.sum("n") / CHUNK_SHINGLES)).cast("long").alias("pieces")
    part = F.xxhash64("grp", F.pmod(F.xxhash64("set_key"), F.col("pieces")))
    cut = common.looked_up(nodes, keep(nodes.groupBy("grp").agg(pieces), "pieces"), "grp").select("row_key", "check", "set_key", "n", "grp", "pieces", part.alias("part"))
    local = keep(_with_sets(cut, base, size).groupBy("bin").applyInArrow(_join_parts(percent), _LOCAL), "local")
    own = local.select("set_key", "root")
    if local.where("hashes is not null").isEmpty():
        return own

    # Components of cut groups, from those of their chunks.
    pivots = local.where("hashes is not null and set_key = root").select("grp", "root", "radius", "longest", "hashes")
    sizes = keep(pivots.groupBy("grp").agg(F.count("*").alias("m")), "sizes")
    few = pivots.join(sizes.where(F.col("m").between(2, CHUNK_SETS)), "grp").select(F.col("grp").alias("block"), F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"), *pivots.columns[1:])
    large = sizes.where(F.col("m") > CHUNK_SETS).select("grp")
    blocks = few if large.isEmpty() else few.unionByName(_by_signature(pivots, local, shared, large, keep))
    found = keep(blocks.groupBy("block", "i", "j").applyInArrow(_compare_pivots(percent), "a long, b long, open boolean"), "found")
    edges = own.select(F.col("set_key").alias("a"), F.col("root").alias("b")).union(found.where("not open").select("a", "b"))
    linked_now = joined(edges)
    side = lambda c: linked_now.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
    still = keep(found.where("open").join(side("a"), "a", "left").join(side("b"), "b", "left")
        .where(F.coalesce("a_root", "a") != F.coalesce("b_root", "b")).select("a", "b").distinct(), "still")
    if still.isEmpty():
        return linked_now.select(F.col("node").alias("set_key"), "root")
    # The larger component of an open pair meets all its partners, in blocks.
    members = own.groupBy("root").agg(F.count("*").alias("m"))
    side = lambda c: members.select(F.col("root").alias(c), F.col("m").alias(f"{c}_m"))
    larger = F.struct(F.col("a_m").alias("m"), F.col("a").alias("k")) >= F.struct(F.col("b_m").alias("m"), F.col("b").alias("k"))
    still = still.join(side("a"), "a").join(side("b"), "b").select(F.when(larger, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(larger, F.col("b")).otherwise(F.col("a")).alias("root"))
    partners = keep(still.join(own, "root").select("x", "set_key"), "partners")
    parts = partners.groupBy("x").agg(F.ceil(F.count("*") / CHUNK_SETS).cast("long").alias("blocks"))
    place = lambda block: F.xxhash64("x", block).alias("part")
    theirs = partners.join(parts, "x").select("set_key", place(F.pmod(F.xxhash64("set_key"), F.col("blocks"))))
    ours = parts.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).join(own.withColumnRenamed("root", "x"), "x").select("set_key", place(F.col("block")))
    kept = local.where("hashes is not null").select("set_key", "grp", "hashes")
    whole = theirs.union(ours).join(kept, "set_key").select("set_key", "grp", "part", F.lit(1).cast("long").alias("pieces"), _bin(partners.count(), 0), "hashes")
    more = keep(whole.groupBy("bin").applyInArrow(_join_parts(percent), _LOCAL), "more")
    return joined(edges.union(more.select("set_key", "root"))).select(F.col("node").alias("set_key"), "root")


def _by_signature(pivots: DataFrame, local: DataFrame, shared: DataFrame, large: DataFrame, keep) -> DataFrame:
    """Blocks of pivots of large groups: those whose members share a signature. The
    pivots of a signature that more than a block's share meet in pairs of blocks."""
    own = local.join(F.broadcast(large) if large.count() < 10_000 else large, "grp", "left_semi").select("set_key", "root")
    touched = keep(shared.select("set_key", "sign").join(own, "set_key").select("sign", "root").distinct(), "touched")
    sizes = keep(touched.groupBy("sign").agg(F.count("*").alias("m")).where("m > 1"), "sign_sizes")
    touched = keep(common.looked_up(touched, sizes, "sign").where("m is not null"), "touched_sizes")
    roots = touched.where(F.col("m") <= CHUNK_SETS).groupBy("sign").agg(F.sort_array(F.collect_list("root")).alias("roots")).select("roots").distinct()
    zero = F.lit(0).cast("long")
    one = roots.select(F.xxhash64("roots").alias("block"), F.explode("roots").alias("root"), zero.alias("i"), zero.alias("j"))
    blocks = F.ceil(F.col("m") / CHUNK_SETS).cast("long")
    many = touched.where(F.col("m") > CHUNK_SETS).select("sign", "root", blocks.alias("blocks"), F.pmod(F.xxhash64("root"), blocks).alias("own"))
    many = many.withColumn("other", F.explode(F.sequence(zero, F.col("blocks") - 1)))
    many = many.select(F.col("sign").alias("block"), "root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    return one.unionByName(many).join(pivots.drop("grp"), "root").select("block", "i", "j", "root", "radius", "longest", "hashes")


def _bin(sets: int, shingles: int) -> Column:
    return F.pmod(F.xxhash64("part"), F.lit(max(1, -(-sets // 400), -(-shingles // 300_000)))).alias("bin")


def _with_sets(nodes: DataFrame, base: DataFrame, size: int) -> DataFrame:
    """Nodes (row_key, check, set_key, n, grp, pieces, part) with their sets, and a
    bin that holds whole parts of some thousand shingles together."""
    count, total = nodes.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    nodes = nodes.select("row_key", "check", "set_key", "grp", "part", "pieces", _bin(count, total))
    texts = nodes.join(base.select("row_key", "text").hint("merge"), "row_key").select("set_key", "grp", "part", "pieces", "bin", "check", "text")
    return texts.mapInArrow(_sets(size), "set_key long, grp long, part long, pieces long, bin long, hashes binary")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
