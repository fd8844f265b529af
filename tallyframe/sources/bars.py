"""Candle bars: from event streams, from CSV files, cleaned, deduplicated, resampled and audited."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.windows import sdiv, true

#: Widths that a bar may have, in seconds.
WIDTHS = {"1m": 60, "3m": 180, "5m": 300, "15m": 900, "30m": 1800, "1H": 3600}
#: Columns that a file of bars must have, in whatever order; ``confirm`` may be there, everything else is ignored.
RAW = ("open_time", "open", "high", "low", "close", "volume")
#: Columns that a line of a file may have at most.
MOST_COLUMNS = 24
# Fixed values of the audit. A gap is a step of more than so many bars; a spike a larger relative change of the close.
GAP_BARS, SPIKE = 1.5, 0.25
# The most gaps, share of bars without volume, wrong bars and hours since the last bar, and the least spikes,
# of a flagged series; and the share and spikes of a candidate for the blacklist.
GAPS, ZERO_SHARE, WRONG, STALE_HOURS, SPIKES = 5, 0.02, 0, 48.0, 3
BLACKLIST_ZERO_SHARE, BLACKLIST_SPIKES = 0.05, 8
# Bases left out of mining: stable coins and fiat wrappers, metals, wrapped shares, thin shares and funds.
BLOCKED_BASES = (
    "USDC", "USDG", "USDT", "DAI", "FDUSD", "TUSD", "USDE", "USDS", "BUSD",
    "XAU", "XAG", "XAUT", "PAXG",
    "QQQX", "NVDAX", "TSLAX", "MSTRX", "CRCLX", "SPYX", "AAPLX", "SKHYNIX", "AAOI", "CBRS", "GLW", "MU", "RKLB", "SOXS", "MRVL", "EWY", "SPCX", "SNDK", "CL", "INTC",
    "EWZ", "CGNX", "DKNG", "BX", "CSCO", "CIEN", "GME", "CRWD", "COST", "ADBE", "GEV", "CRDO", "EWJ", "FLNC", "ALAB", "ASML", "BMNR", "APLD", "AMD", "AMAT", "AAPL", "AMZN",
)
# Bases named like shares, which are thin.
STOCK_LIKE = (
    "AAPL", "ADBE", "AMAT", "AMD", "AMZN", "ASML", "AVGO", "COIN", "CRCL", "GOOGL", "HOOD", "INTC", "META", "MSFT", "MSTR", "NVDA", "PLTR", "TSLA",
    "QQQ", "SPY", "ALAB", "APLD", "MU", "ORCL", "NFLX", "BABA",
)


def width_seconds(bar: str) -> int:
    if bar not in WIDTHS:
        raise ValueError(f"{bar!r} is no bar width; it is one of {', '.join(WIDTHS)}")
    return WIDTHS[bar]


def purge_seconds(horizon: int, bar: str) -> int:
    """How long after a signal its outcome may still be open."""
    if horizon < 0:
        raise ValueError("a horizon can't be negative")
    return (horizon + 1) * width_seconds(bar)


def event_bars(events: DataFrame, width: str = "1 hour", divisor: int = 20_000) -> DataFrame:
    """(symbol, open_time, open, high, low, close, volume, bar_i): bars of a walk that the events' values make.

    The price is 100 plus the running sum of the values' cents less 4963, over ``divisor``, by event type in the order
    of (ts, event_id). The sum is of integers and thus exact; it is made within each bar and from the bars' totals, so
    that no task holds a whole event type. Events without a type, time, id or value are left out.
    """
    usable = events.where("event_type is not null and ts is not null and event_id is not null and value is not null")
    ticks = usable.select(F.col("event_type").alias("symbol"), "ts", "event_id", (F.round(F.col("value") * 100).cast("long") - 4963).alias("cents"), F.window("ts", width)["start"].alias("open_time"))
    totals = ticks.groupBy("symbol", "open_time").agg(F.sum("cents").alias("total"))
    before = F.sum("total").over(Window.partitionBy("symbol").orderBy("open_time").rowsBetween(Window.unboundedPreceding, -1))
    totals = totals.select("symbol", "open_time", F.coalesce(before, F.lit(0)).alias("before"))
    inside = Window.partitionBy("symbol", "open_time").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    walk = ticks.withColumn("run", F.sum("cents").over(inside)).join(totals, ["symbol", "open_time"])
    walk = walk.withColumn("price", F.lit(100.0) + (F.col("run") + F.col("before")).cast("double") / F.lit(float(divisor)))
    order = F.struct("ts", "event_id")
    bars = walk.groupBy("symbol", "open_time").agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.count("*").cast("double").alias("volume")
    )
    return numbered(bars)


def numbered(bars: DataFrame, *keys: str) -> DataFrame:
    """``bars`` with bar_i, the place in its series from 0."""
    w = Window.partitionBy(*(keys or ("symbol",))).orderBy("open_time")
    return bars.withColumn("bar_i", (F.row_number().over(w) - 1).cast("long"))


def keep_last(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Of rows with equal keys, the one that is last in the order."""
    w = Window.partitionBy(*keys).orderBy(*[c.desc() for c in order])
    return rows.withColumn("_place", F.row_number().over(w)).where("_place = 1").drop("_place")


def _named_files(rows: DataFrame, path: Column) -> DataFrame:
    """``rows`` with the source, symbol and bar that the name of their file tells, without those of other names."""
    name = F.element_at(F.split(path, "/"), -1)
    pattern = rf"^(?:(gate|okx)_)?(.+?)_({'|'.join(WIDTHS)})_([0-9]+)(?:_latest)?\.csv$"
    part = lambda k: F.regexp_extract(name, pattern, k)
    return rows.where(name.rlike(pattern)).withColumns({"source": F.when(part(1) == "", "okx").otherwise(part(1)), "symbol": part(2), "bar": part(3), "file_rows": part(4).cast("long")})


def _unblocked(rows: DataFrame, blocked: DataFrame | Sequence[str] | None) -> DataFrame:
    base = F.substring_index("symbol", "_", 1)
    if blocked is None:
        return rows
    if isinstance(blocked, DataFrame):
        return rows.withColumn("base", base).join(blocked.select("base"), "base", "left_anti").drop("base")
    return rows.where(~base.isin(*blocked)) if blocked else rows


def list_series(spark: SparkSession, paths: str | list[str], bar: str | None = None, blocked: DataFrame | Sequence[str] | None = BLOCKED_BASES) -> DataFrame:
    """(source, symbol, bar, files, longest): the files of every series in order, and the one that by its name has most rows (of
    equal ones the last). Names are ``[source_]symbol_bar_rows[_latest].csv``; without a source it is okx; other files count
    as none. Contents aren't read."""
    if bar is not None:
        width_seconds(bar)
    files = _unblocked(_named_files(spark.read.format("binaryFile").load(paths).select("path"), F.col("path")), blocked)
    files = files if bar is None else files.where(F.col("bar") == bar)
    return files.groupBy("source", "symbol", "bar").agg(F.sort_array(F.collect_list("path")).alias("files"), F.max_by("path", F.struct("file_rows", "path")).alias("longest"))


def _csv_cells(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, at, head, cells) of every line below the head of its file, which is its line that names an ``open`` and a ``close``.

    ``at`` orders the lines of a file. Lines are read by place, so files of different layouts can be read at once: a file's
    head is a line like the others, met by its path."""
    schema = ", ".join(f"_c{k} string" for k in range(MOST_COLUMNS))
    raw = spark.read.schema(schema).option("mode", "PERMISSIVE").csv(paths)
    lines = raw.select(
        F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")).alias("at"),
        F.array(*(F.trim(f"_c{k}") for k in range(MOST_COLUMNS))).alias("cells"),
    )
    is_head = F.array_contains("cells", "open") & F.array_contains("cells", "close")
    heads = lines.where(is_head).groupBy("file").agg(F.min_by("cells", "at").alias("head"))
    return lines.where(~F.coalesce(is_head, F.lit(False))).join(heads, "file")


def _cell(name: str) -> Column:
    """The value of a named column; NULL where the file has none of that name."""
    at = F.array_position("head", name).cast("int")
    return F.when(at > 0, F.try_element_at("cells", at))


def read_series(spark: SparkSession, paths: str | list[str], blocked: DataFrame | Sequence[str] | None = BLOCKED_BASES) -> DataFrame:
    """Clean bars of CSV files named ``[source_]symbol_bar_rows[_latest].csv``; files of other names, or whose heads lack a column
    of ``RAW``, are left out. Layouts may differ from file to file.

    Unfinished bars (confirm = 0) and rows without a price or time are dropped; of bars with equal time the one of the
    last file by path stays, and in it the last row. Values that can't be read count as missing, a time
    that can't be read is taken from ``ts`` where the file has one. ``blocked`` are the base
    symbols to leave out, as names or as a table (column ``base``); None leaves none out.
    """
    rows = _unblocked(_named_files(_csv_cells(spark, paths), F.col("file")), blocked)
    whole = F.array_size(F.array_intersect("head", F.array(*map(F.lit, RAW)))) == len(RAW)
    unfinished = F.coalesce(_cell("confirm").try_cast("double") == 0, F.lit(False))
    time = F.coalesce(_cell("open_time").try_cast("timestamp"), F.timestamp_millis(_cell("ts").try_cast("long")))
    rows = rows.where(whole & ~unfinished).select("source", "symbol", "bar", "file", "at", time.alias("open_time"), *(_cell(c).try_cast("double").alias(c) for c in RAW[1:]))
    rows = rows.where(" and ".join(f"{c} is not null and not isnan({c})" for c in RAW[1:5]) + " and open_time is not null")
    keys = ["source", "symbol", "bar"]
    return numbered(keep_last(rows, [*keys, "open_time"], [F.col("file"), F.col("at")]).drop("file", "at"), *keys)


def read_candles(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, open_time, open, high, low, close, volume) of candle files whose ``ts`` is in milliseconds, rows without a price
    left out. Nothing is deduplicated."""
    rows = _csv_cells(spark, paths).select("file", F.timestamp_millis(_cell("ts").try_cast("long")).alias("open_time"), *(_cell(c).try_cast("double").alias(c) for c in RAW[1:]))
    return rows.where(" and ".join(f"{c} is not null and not isnan({c})" for c in RAW[1:5]))


def at_least(bars: DataFrame, least: int, *keys: str) -> DataFrame:
    """Bars of the series that have so many."""
    keys = keys or ("symbol",)
    long = bars.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select(*keys)
    return bars.join(long, list(keys), "left_semi")


def tail(bars: DataFrame, n: int, *keys: str) -> DataFrame:
    """The last n bars of each series."""
    w = Window.partitionBy(*(keys or ("symbol",))).orderBy(F.desc("open_time"))
    return bars.withColumn("_place", F.row_number().over(w)).where(F.col("_place") <= n).drop("_place")


def resampled(bars: DataFrame, width: str, *keys: str) -> DataFrame:
    """Bars of a larger width."""
    keys = keys or ("symbol",)
    wide = bars.withColumn("_start", F.window("open_time", width)["start"]).groupBy(*keys, F.col("_start").alias("open_time")).agg(
        F.min_by("open", "open_time").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "open_time").alias("close"), F.sum("volume").alias("volume")
    )
    return numbered(wide, *keys)


def upserted(held: DataFrame, fresh: DataFrame, *keys: str) -> DataFrame:
    """``held`` with the bars of ``fresh`` put in; of bars with equal time the fresh one counts."""
    keys = keys or ("symbol",)
    both = held.withColumn("_fresh", F.lit(0)).unionByName(fresh.withColumn("_fresh", F.lit(1)), allowMissingColumns=True).drop("bar_i")
    return numbered(keep_last(both, [*keys, "open_time"], [F.col("_fresh")]).drop("_fresh"), *keys)


def tip_merged(history: DataFrame, live: DataFrame, *keys: str) -> DataFrame:
    """History before the first live bar of each series, then the live bars."""
    keys = list(keys or ("symbol",))
    start = live.groupBy(*keys).agg(F.min("open_time").alias("_start"))
    old = history.join(start, keys, "left").where("_start is null or open_time < _start").drop("_start")
    return numbered(old.drop("bar_i").unionByName(live.drop("bar_i")).dropDuplicates([*keys, "open_time"]), *keys)


def audit(bars: DataFrame, seconds: int, *keys: str, now: Column | None = None) -> DataFrame:
    """One row a series: bars, gaps, the longest step in hours, the share of bars without volume, spikes, wrong bars (prices
    that contradict each other or aren't positive), the first and last bar, the hours from that to ``now``, the reasons to
    flag the series, joined by ``|``, whether it is flagged, and whether it may go on the blacklist. A series without gaps
    in time has 0 as its longest step."""
    keys = keys or ("symbol",)
    w = Window.partitionBy(*keys).orderBy("open_time")
    step = F.unix_seconds(F.col("open_time").cast("timestamp")) - F.unix_seconds(F.lag("open_time").over(w).cast("timestamp"))
    rows = bars.withColumn("_step", step).withColumn("_ret", sdiv("close", F.lag("close").over(w)) - 1)
    wrong = true((F.col("high") < F.greatest("open", "close")) | (F.col("low") > F.least("open", "close")) | (F.col("low") > F.col("high")) | (F.least("open", "high", "low", "close") <= 0))
    found = rows.groupBy(*keys).agg(
        F.count("*").alias("n_bars"),
        F.min("open_time").alias("first_time"),
        F.max("open_time").alias("last_time"),
        F.count_if(F.col("_step") > GAP_BARS * seconds).alias("n_gaps"),
        F.coalesce(F.round(F.max("_step") / 3600, 2), F.lit(0.0)).alias("max_gap_hours"),
        F.round(F.avg((F.coalesce("volume", F.lit(0.0)) <= 0).cast("double")), 4).alias("zero_vol_share"),
        F.count_if(F.abs("_ret") > SPIKE).alias("spike_bars"),
        F.count_if(wrong).alias("ohlc_bad"),
    )
    age = F.unix_seconds((F.current_timestamp() if now is None else now).cast("timestamp")) - F.unix_seconds(F.col("last_time").cast("timestamp"))
    found = found.withColumn("age_hours", F.round(age / 3600, 1))
    return found.withColumns({"reasons": flag_reasons(), "flagged": flag_reasons() != "", "blacklist_candidate": blacklist_candidate()})


def flag_reasons() -> Column:
    """Why a row of ``audit`` is flagged; an empty text where it isn't."""
    tests = [
        (F.col("n_gaps") > GAPS, f"gaps>{GAPS}"), (F.col("zero_vol_share") > ZERO_SHARE, f"zero_vol>{ZERO_SHARE}"), (F.col("spike_bars") >= SPIKES, f"spikes>={SPIKES}"),
        (F.col("ohlc_bad") > WRONG, "ohlc_bad"), (F.col("age_hours") > STALE_HOURS, f"stale>{STALE_HOURS}h"),
    ]
    return F.concat_ws("|", *(F.when(test, name) for test, name in tests))


def blacklist_candidate(symbol: str = "symbol") -> Column:
    """Whether a row of ``audit`` is worth a lasting exclusion; thin names like shares are so sooner."""
    thin = F.substring_index(F.col(symbol), "_", 1).isin(*STOCK_LIKE) & (F.col("zero_vol_share") > ZERO_SHARE)
    return true((F.col("ohlc_bad") > WRONG) | (F.col("n_gaps") > GAPS) | (F.col("zero_vol_share") > BLACKLIST_ZERO_SHARE) | (F.col("spike_bars") >= BLACKLIST_SPIKES) | thin)


def audit_summary(audited: DataFrame) -> DataFrame:
    """One row over the series of an audit: how many there are, are flagged, are flagged for more than being stale, and
    may go on the blacklist."""
    structural = F.col("reasons").rlike("gaps|zero_vol|spikes|ohlc_bad")
    return audited.agg(
        F.count("*").alias("series_total"), F.count_if("flagged").alias("flagged"), F.count_if(structural).alias("structural_flagged"), F.count_if("blacklist_candidate").alias("blacklist_candidate_n")
    )
