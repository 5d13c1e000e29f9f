"""Flat JSON records: decoding that drops bad lines, and rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def decode(lines: DataFrame, schema: T.StructType, column: str = "value", required: list[str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """Rows of ``schema`` from lines of JSON. Field order is free and unknown
    fields are ignored; numbers may be quoted. A line that is no JSON object, or
    in which a required field (by default each) is missing or no number where one
    is declared, has no row. ``keep``: columns beside the line that stay."""
    asked = T.StructType([T.StructField(f.name, T.StringType() if isinstance(f.dataType, T.NumericType) else f.dataType) for f in schema])
    parsed = lines.select(F.from_json(column, asked).alias("r"), *(keep or []))
    values = [F.expr(f"try_cast(r.`{f.name}` AS {f.dataType.simpleString()})").alias(f.name) for f in schema]
    needed = schema.names if required is None else required
    out = parsed.select(*values, *(keep or []))
    return out.dropna(subset=needed) if needed else out


def render(*columns: str) -> Column:
    """One JSON object; nulls are left out."""
    return F.to_json(F.struct(*columns))


def render_fixed(doubles: list[str], others: list[str], order: list[str]) -> Column:
    """One JSON object with doubles written to six places."""
    def part(c: str) -> Column:
        value = F.format_string("%.6f", F.col(c)) if c in doubles else F.to_json(F.struct(F.col(c).alias("v")))
        value = value if c in doubles else F.regexp_extract(value, r'^\{"v":(.*)\}$', 1)
        return F.concat(F.lit(f'"{c}":'), value)

    assert set(order) == {*doubles, *others}
    return F.concat(F.lit("{"), F.concat_ws(",", *(part(c) for c in order)), F.lit("}"))
