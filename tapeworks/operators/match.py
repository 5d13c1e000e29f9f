"""Row patterns: MATCH_RECOGNIZE over ordered partitions.

Each row gets one character that says which variables its DEFINE conditions
allow; PREV(x) is ``lag`` in the partition's order, and a variable without a
condition fits every row. A partition's rows in order then make a string, and
the pattern is a regular expression over character classes, one group for each
variable, so overlapping conditions and greedy quantifiers with backtracking
come from the regular-expression engine. Group spans give back row positions.
Matches do not overlap (AFTER MATCH SKIP PAST LAST ROW).

A task reads its partitions in order, a batch at a time. For a pattern with a bound
it keeps the rows that a match could still begin in, the ``longest`` match and a
batch at most: what begins earlier has seen all rows that it may hold. A pattern
without a bound is matched when its partition has ended. Only the label and the
measured columns travel.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

_TERM = re.compile(r"\s*([A-Za-z_]\w*)\s*(\{\s*\d+\s*(?:,\s*\d*\s*)?\}|[?*+])?(\??)\s*")
_MEASURE = re.compile(r"\s*(FIRST|LAST)\s*\(\s*(\w+)\.(\w+)\s*\)\s+AS\s+(\w+)\s*", re.IGNORECASE)
_PREV = re.compile(r"\bPREV\s*\(\s*(\w+)\s*(?:,\s*(\d+)\s*)?\)", re.IGNORECASE)
#: First character code of the labels; far from anything special to a regex.
_BASE = 0x4E00


@dataclass(frozen=True)
class Pattern:
    terms: tuple[tuple[str, str], ...]  # (variable, quantifier)
    define: dict[str, str]

    @staticmethod
    def parse(pattern: str, define: dict[str, str]) -> Pattern:
        terms, at, text = [], 0, pattern.strip()
        while at < len(text):
            m = _TERM.match(text, at)
            if not m:
                raise ValueError(f"not a row pattern: {pattern!r}")
            terms.append((m[1], re.sub(r"\s", "", m[2] or "") + m[3]))
            at = m.end()
        if not terms or len({v for v, _ in terms}) > 12:
            raise ValueError("a row pattern has 1 to 12 variables")
        return Pattern(tuple(terms), define)

    @property
    def variables(self) -> list[str]:
        return sorted({v for v, _ in self.terms})

    def regex(self) -> str:
        """Groups 1, 2, ... are the terms."""
        return "".join(f"({self._class(v)}{q})" for v, q in self.terms)

    def longest(self) -> int:
        """Rows of the longest possible match; 0 if there is no bound."""
        total = 0
        for _, q in self.terms:
            q = q.rstrip("?") if len(q) > 1 else q
            if q in ("*", "+") or q.endswith(",}"):
                return 0
            total += int(q[1:-1].split(",")[-1]) if q.startswith("{") else 1
        return total

    def _class(self, variable: str) -> str:
        bit = 1 << self.variables.index(variable)
        fits = [m for m in range(1 << len(self.variables)) if m & bit]
        runs, start = [], fits[0]
        for a, b in zip(fits, [*fits[1:], None]):
            if b != a + 1:
                runs.append((start, a))
                start = b
        return "[" + "".join(f"{chr(_BASE + a)}-{chr(_BASE + b)}" for a, b in runs) + "]"


def labelled(df: DataFrame, partition: list[str], order: str, pattern: Pattern, name: str = "__label") -> DataFrame:
    """``df`` with each row's character."""
    w = Window.partitionBy(*partition).orderBy(order)
    mask: Column = F.lit(0)
    for i, v in enumerate(pattern.variables):
        fits: Column = F.lit(True)
        if v in pattern.define:
            condition = pattern.define[v]
            for m in _PREV.finditer(condition):
                lag = f"__prev_{m[1]}_{m[2] or 1}"
                if lag not in df.columns:
                    df = df.withColumn(lag, F.lag(m[1], int(m[2] or 1)).over(w))
            fits = F.coalesce(F.expr(_PREV.sub(lambda m: f"__prev_{m[1]}_{m[2] or 1}", condition)), F.lit(False))
        mask = mask + F.when(fits, 1 << i).otherwise(0)
    # Characters beyond Latin-1 come from their UTF-16 code.
    code = F.lpad(F.conv(F.lit(_BASE) + mask, 10, 16), 4, "0")
    return df.withColumn(name, F.decode(F.unhex(code), "UTF-16BE"))


def measures_of(text: str) -> list[tuple[str, str, str, str]]:
    """``FIRST(d.ts) AS a, LAST(u.px) AS b`` as (FIRST|LAST, variable, column, name)."""
    out = []
    for part in text.split(","):
        m = _MEASURE.fullmatch(part)
        if not m:
            raise ValueError(f"not a measure: {part.strip()!r}")
        out.append((m[1].upper(), m[2], m[3], m[4]))
    return out


def match_recognize(df: DataFrame, partition: list[str], order: str, measures: list[tuple[str, str, str, str]], pattern: str, define: dict[str, str]) -> DataFrame:
    """One row per match: the partition's columns, then the measures. A measure
    of a variable that matched no row is null."""
    p = Pattern.parse(pattern, define)
    needed = sorted({c for _, _, c, _ in measures})
    keys = [f"k{i}" for i in range(len(partition))]
    rows = labelled(df, partition, order, p)
    rows = rows.select(*(F.col(c).alias(k) for c, k in zip(partition, keys)), F.col(order).alias("o"), F.col("__label").alias("label"), *(F.col(c).alias(f"m_{c}") for c in needed))
    rows = rows.repartition(*keys).sortWithinPartitions(*keys, "o").drop("o")
    kinds = {**{k: rows.schema[k].dataType for k in keys}, **{f"r{i}": rows.schema[f"m_{c}"].dataType for i, (_, _, c, _) in enumerate(measures)}}
    schema = T.StructType([T.StructField(k, v) for k, v in kinds.items()])
    arrow = to_arrow_schema(schema)

    def places(spans: list[tuple[int, int]]) -> list[int | None]:
        """Row of each measure in a match."""
        out = []
        for kind, variable, _, _ in measures:
            own = [s for s, (v, _) in zip(spans, p.terms) if v == variable and s[0] < s[1]]
            out.append(None if not own else own[0][0] if kind == "FIRST" else own[-1][1] - 1)
        return out

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        key = None

        def done(ended: bool) -> Iterator[pa.RecordBatch]:
            part = pa.concat_tables(held)
            found, after = matched(part.column("label").to_pylist(), p, ended)
            held[:] = [part.slice(after)]
            if found:
                picked = [places(m) for m in found]
                columns = [part.column(c).take(pa.array([m[0][0] for m in found], pa.int64())) for c in keys]
                columns += [part.column(f"m_{c}").take(pa.array([r[i] for r in picked], pa.int64())) for i, (_, _, c, _) in enumerate(measures)]
                yield from pa.Table.from_arrays(columns, names=arrow.names).cast(arrow).combine_chunks().to_batches()

        for batch in batches:
            now = pa.Table.from_batches([batch])
            for low, high in _runs(now, keys):
                own = [now.column(c)[low].as_py() for c in keys]
                if held and own != key:
                    yield from done(True)
                    held.clear()
                held.append(now.slice(low, high - low))
                key = own
            if held and p.longest():
                yield from done(False)
        if held:
            yield from done(True)

    out = rows.mapInArrow(search, schema)
    return out.select(*(F.col(k).alias(c) for c, k in zip(partition, keys)), *(F.col(f"r{i}").alias(name) for i, (_, _, _, name) in enumerate(measures)))


def _runs(rows: pa.Table, keys: list[str]) -> list[tuple[int, int]]:
    """Spans of rows with equal keys, which are sorted."""
    n, differ = rows.num_rows, np.zeros(max(0, rows.num_rows - 1), bool)
    for k in keys:
        codes = rows.column(k).combine_chunks().dictionary_encode(null_encoding="encode")
        codes = np.asarray((codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes).indices)
        differ |= codes[1:] != codes[:-1]
    cuts = [0, *(np.flatnonzero(differ) + 1).tolist(), n]
    return list(zip(cuts, cuts[1:])) if n else []


def matched(labels: list[str], pattern: Pattern, ended: bool) -> tuple[list[list[tuple[int, int]]], int]:
    """Matches (the span of each term) that no later row can change, and the row from
    which on rows are still needed. ``ended``: no row follows; else the pattern has a
    bound."""
    text, most, out = "".join(labels), pattern.longest(), []
    still = len(text) if ended else max(0, len(text) - most + 1)
    for m in re.finditer(pattern.regex(), text):
        if m.start() >= still:
            break
        out.append([m.span(i) for i in range(1, len(pattern.terms) + 1)])
        still = max(still, m.end())
    return out, still


def match_rows(labels: str, pattern: Pattern) -> list[list[tuple[int, int]]]:
    """Per match, the (start, end) of each term: the same matcher in Python, for
    streams."""
    return [[m.span(i) for i in range(1, len(pattern.terms) + 1)] for m in re.finditer(pattern.regex(), labels)]
