"""A seeded synthetic trading hour: trades and quotes that arrive out of order.

A plan over ``spark.range``: one row for each symbol and minute says how many trades
there are and from where to where the price goes, and becomes so many rows. All
chance comes from hashes of (seed, what is drawn, the row's place), so a tape is the
same however Spark deals it, and any row can be made alone.

Three incidents: one wrong print far off the price, a fall and recovery with wide
spreads, and a burst of trades. Ordinary rows arrive within ``MAX_DISORDER_MS``;
``stragglers`` arrive long after their minute closed. They come from minutes before
the last, as nothing later than the last minute could close it.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What the incidents and the checks on them rest on (fixed values).
BASE_MS = 1_767_603_600_000  # 2026-01-05T09:00Z
TRADES_PER_MINUTE = (260, 150, 70)
SPREAD_BPS = (5.0, 12.0, 24.0)
MINUTE_VOLATILITY = (0.0009, 0.0014, 0.0022)
MAX_DISORDER_MS = 2_800
WRONG_PRINT = {"symbol": 2, "minute": 17, "offset_ms": 30_000, "multiple": 8.0}
FALL = {"symbol": 5, "from": 28, "turn": 33, "to": 38, "down": 0.988, "up": 1.011, "spread": 3.0}
BURST = {"symbol": 8, "from": 42, "to": 45, "rate": 15.0}

#: Chosen here: activity by symbol, so that each tier has several and the incidents'
#: symbols are of all three; activity and prices that vary enough to tell symbols
#: apart; sizes of some tens to hundreds.
TIERS = (0, 0, 1, 1, 0, 2, 1, 1, 2, 2, 1, 2)
SECTORS = ("metals", "shipping", "software", "retail")
JITTER, LOW, HIGH, MEDIAN_SIZE = 0.25, 25.0, 350.0, 90.0
MINUTE = 60_000
FIRST_ID = 100_001


@dataclass(frozen=True)
class Tape:
    trades: DataFrame
    quotes: DataFrame
    symbols: DataFrame
    manifest: dict

    def write(self, folder: str) -> None:
        """Folders of NDJSON in order of arrival, and the manifest."""
        self.trades.orderBy("arrival_ms", "trade_id").drop("arrival_ms").write.mode("overwrite").json(f"{folder}/trades.ndjson")
        self.quotes.orderBy("arrival_ms", "ts", "symbol").drop("arrival_ms").write.mode("overwrite").json(f"{folder}/quotes.ndjson")
        self.symbols.coalesce(1).write.mode("overwrite").json(f"{folder}/symbols.ndjson")
        spark = self.trades.sparkSession
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/manifest.json")
        out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
        out.write(bytearray(json.dumps(self.manifest, indent=2, sort_keys=True).encode()))
        out.close()


class Chance:
    """Draws that depend on the seed, a name and columns alone."""

    def __init__(self, seed: int) -> None:
        self.seed = seed

    def even(self, what: str, *place: str) -> Column:
        """Between 0 and 1, both left out."""
        bits = F.pmod(F.xxhash64(F.lit(self.seed), F.lit(what), *place), F.lit(1 << 40))
        return (bits + 0.5) / float(1 << 40)

    def normal(self, what: str, *place: str) -> Column:
        return F.sqrt(-2 * F.log(self.even(f"{what}/r", *place))) * F.cos(2 * math.pi * self.even(f"{what}/a", *place))


def _of(values: tuple, index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), index.cast("int") + 1)


def _name(i: Column) -> Column:
    """TKAZ, TKBY, TKCX and so on."""
    return F.concat(F.lit("TK"), F.char(F.lit(65) + i), F.char(F.lit(90) - i))


def _cells(spark: SparkSession, chance: Chance, symbols: int, minutes: int, scale: float) -> DataFrame:
    """(symbol_no, symbol, minute, start, n, first, opens, closes, falls): each
    symbol's minutes, with trades, the number of the first and prices."""
    cells = spark.range(symbols * minutes).select(F.floor(F.col("id") / minutes).alias("symbol_no"), (F.col("id") % minutes).alias("minute"))
    tier = _of(TIERS, F.col("symbol_no"))
    falls = (F.col("symbol_no") == FALL["symbol"]) & F.col("minute").between(FALL["from"], FALL["to"] - 1)
    bursts = (F.col("symbol_no") == BURST["symbol"]) & F.col("minute").between(BURST["from"], BURST["to"] - 1)
    rate = _of(TRADES_PER_MINUTE, tier) * scale * F.when(bursts, BURST["rate"]).otherwise(1.0)
    n = F.greatest(F.lit(1), F.round(rate * (1 + JITTER * (2 * chance.even("rate", "symbol_no", "minute") - 1)))).cast("long")
    wander = _of(MINUTE_VOLATILITY, tier) * chance.normal("move", "symbol_no", "minute")
    move = F.when(falls & (F.col("minute") < FALL["turn"]), math.log(FALL["down"])).when(falls, math.log(FALL["up"])).otherwise(wander)
    cells = cells.select("*", tier.alias("tier"), falls.alias("falls"), n.alias("n"), move.alias("move"), (F.log(F.lit(LOW)) + chance.even("opening", "symbol_no") * math.log(HIGH / LOW)).alias("opening"))
    # The window over all cells has one row a symbol and minute.
    path, every = Window.partitionBy("symbol_no").orderBy("minute"), Window.orderBy("symbol_no", "minute").rowsBetween(Window.unboundedPreceding, -1)
    closes = F.col("opening") + F.sum("move").over(path)
    cells = cells.select("*", closes.alias("log_close"), F.coalesce(F.sum("n").over(every), F.lit(0)).alias("first"))
    return cells.select("symbol_no", _name(F.col("symbol_no").cast("int")).alias("symbol"), "tier", "minute", (F.lit(BASE_MS) + F.col("minute") * MINUTE).alias("start"), "n", "first", "falls", "move", "log_close")


def _arrival(chance: Chance, what: str, *place: str) -> Column:
    """An exponential delay of 400 ms in the mean."""
    return F.col("ts") + F.least(F.floor(-400 * F.log(chance.even(what, *place))), F.lit(MAX_DISORDER_MS)).cast("long")


def _size(chance: Chance, what: str, *place: str) -> Column:
    return (F.floor(MEDIAN_SIZE * F.exp(0.8 * chance.normal(what, *place))) + 1).cast("long")


def _trades(cells: DataFrame, chance: Chance, wrong: bool) -> DataFrame:
    rows = cells.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    rows = rows.withColumn("trade_id", F.col("first") + F.col("k") + (FIRST_ID - 1))
    # Each trade has a part of its minute; its price lies on the way to the close.
    at = F.floor((F.col("k") - chance.even("time", "trade_id")) / F.col("n") * MINUTE)
    noise = F.when(F.col("falls"), 0.0).otherwise(0.1 * _of(MINUTE_VOLATILITY, F.col("tier")) * chance.normal("price", "trade_id"))
    price = F.exp(F.col("log_close") - F.col("move") * (1 - F.col("k") / F.col("n")) + noise)
    side = F.when(chance.even("side", "trade_id") < 0.5, "B").otherwise("S")
    rows = rows.select((F.col("start") + at).cast("long").alias("ts"), "symbol", F.round(price, 4).alias("px"), _size(chance, "size", "trade_id").alias("qty"), side.alias("side"), F.lit("SIM").alias("venue"), "trade_id")
    if wrong:
        cell = cells.where((F.col("symbol_no") == WRONG_PRINT["symbol"]) & (F.col("minute") == WRONG_PRINT["minute"]))
        last = cells.agg((F.sum("n") + FIRST_ID).alias("trade_id"))
        one = cell.join(F.broadcast(last)).select((F.col("start") + WRONG_PRINT["offset_ms"]).alias("ts"), "symbol", F.round(F.exp("log_close") * WRONG_PRINT["multiple"], 4).alias("px"), F.lit(25).cast("long").alias("qty"), F.lit("B").alias("side"), F.lit("SIM").alias("venue"), "trade_id")
        rows = rows.unionByName(one)
    return rows


def _quotes(cells: DataFrame, chance: Chance) -> DataFrame:
    rows = cells.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), 2 * F.col("n"))))
    place = ("symbol_no", "minute", "k")
    middle = F.exp(F.col("log_close") + 0.0002 * chance.normal("middle", *place))
    half = middle * _of(SPREAD_BPS, F.col("tier")) * F.when(F.col("falls"), FALL["spread"]).otherwise(1.0) / 20_000
    rows = rows.select(
        (F.col("start") + F.floor(chance.even("quoted", *place) * MINUTE)).cast("long").alias("ts"), "symbol", F.round(middle - half, 4).alias("bid"), F.round(middle + half, 4).alias("ask"),
        _size(chance, "bid", *place).alias("bid_sz"), _size(chance, "ask", *place).alias("ask_sz"), *place)
    return rows.withColumn("arrival_ms", _arrival(chance, "quote delay", *place)).drop(*place)


def generate(spark: SparkSession, seed: int = 42, minutes: int = 60, symbols: int = 12, scale: float = 1.0, stragglers: int = 25) -> Tape:
    symbols, chance = min(symbols, len(TIERS)), Chance(seed)
    cells = _cells(spark, chance, symbols, minutes, scale)
    printed = symbols > WRONG_PRINT["symbol"] and minutes > WRONG_PRINT["minute"]
    trades = _trades(cells, chance, printed)
    made = cells.agg(F.sum("n")).first()[0]
    # The stragglers: the smallest hashes among trades of all minutes but the last.
    early = (F.col("ts") < BASE_MS + (minutes - 1) * MINUTE) & (F.col("trade_id") < FIRST_ID + made)
    late = sorted(r[0] for r in trades.where(early).orderBy(F.xxhash64(F.lit(seed), F.lit("late"), "trade_id")).limit(stragglers).select("trade_id").collect())
    closed = F.col("ts") - F.col("ts") % MINUTE + MINUTE
    after = closed + 30_000 + F.floor(chance.even("straggle", "trade_id") * 15_000)
    trades = trades.withColumn("arrival_ms", F.when(F.col("trade_id").isin(late), after.cast("long")).otherwise(_arrival(chance, "delay", "trade_id")))
    quotes = _quotes(cells, chance)

    at = lambda k: BASE_MS + k * MINUTE
    names = [r[0] for r in cells.where("minute = 0").orderBy("symbol_no").select("symbol").collect()]
    incidents: dict = {"wrong_print": None, "fall": None, "burst": None}
    if printed:
        incidents["wrong_print"] = trades.where(F.col("trade_id") == FIRST_ID + made).select("symbol", "trade_id", "ts", "px").first().asDict()
    if symbols > FALL["symbol"]:
        incidents["fall"] = {"symbol": names[FALL["symbol"]], "from_ts": at(FALL["from"]), "turn_ts": at(FALL["turn"]), "to_ts": at(FALL["to"]), "spread": FALL["spread"]}
    if symbols > BURST["symbol"]:
        incidents["burst"] = {"symbol": names[BURST["symbol"]], "from_ts": at(BURST["from"]), "to_ts": at(BURST["to"])}
    of_symbol = {r[0]: r[1] for r in trades.groupBy("symbol").count().collect()}
    counts = {"trades": sum(of_symbol.values()), "quotes": 2 * made, "symbols": symbols, "late_trades": len(late), "late_trade_ids": late, "per_symbol_trades": dict(sorted(of_symbol.items()))}
    about = cells.where("minute = 0").select("symbol", F.concat("symbol", F.lit(" Works")).alias("name"), _of(SECTORS, F.col("symbol_no") % len(SECTORS)).alias("sector"), "tier")
    return Tape(trades, quotes, about, {"seed": seed, "minutes": minutes, "scale": scale, "base_ts_ms": BASE_MS, "counts": counts, "incidents": incidents})


def end_markers(spark: SparkSession, minutes: int, count: int = 64) -> DataFrame:
    """Rows past every window's end, lag and lateness, on keys of their own; their
    windows never fire. They let a stream close the last real windows."""
    after = F.lit(BASE_MS + minutes * MINUTE + 2 * MINUTE).cast("long")
    return spark.range(count).select(after.alias("ts"), F.concat(F.lit("EOS"), F.col("id")).alias("symbol"), F.lit(1.0).alias("px"), F.lit(1).cast("long").alias("qty"), F.lit("S").alias("side"), F.lit("EOS").alias("venue"), (F.col("id") + 900_000_000).alias("trade_id"))
