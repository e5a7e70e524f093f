"""Trade tapes: adapters, the monthly Parquet store with its metadata, and CSV sources.

The canonical tape is (symbol string, ts_ns long, seq long, price double,
amount double) and optionally side byte and is_buyer_maker boolean; a symbol's
rows are ordered by (ts_ns, seq).
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

NS = {"s": 1_000_000_000, "ms": 1_000_000, "us": 1000, "ns": 1}
MINUTE_NS = 60 * NS["s"]


def require_columns(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns are missing: {', '.join(missing)}")


def trades(df: DataFrame, ts: str = "timestamp", price: str = "price", amount: str = "amount", seq: str = "id", symbol: str | None = None, maker: str | None = None, side: str | None = None, unit: str = "ns") -> DataFrame:
    """A canonical tape from a trade table; ts counts units since the epoch, NaN becomes null."""
    require_columns(df, ts, price, amount, seq)
    number = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    out = [
        (F.col(symbol).cast("string") if symbol else F.lit("-")).alias("symbol"),
        (F.col(ts).cast("long") * NS[unit]).alias("ts_ns"),
        F.col(seq).cast("long").alias("seq"),
        number(price).alias("price"),
        number(amount).alias("amount"),
    ]
    if maker:
        out.append(F.col(maker).cast("boolean").alias("is_buyer_maker"))
    if side:
        out.append(F.col(side).cast("byte").alias("side"))
    return df.select(*out)


def events_tape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The driver's events as a tape: symbol event_type, price value, amount props.k + 1."""
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    return df.select(
        F.col("event_type").alias("symbol"),
        (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("ts_ns"),
        F.col("event_id").alias("seq"),
        F.col("value").alias("price"),
        (F.get_json_object("props", "$.k").cast("double") + 1).alias("amount"),
    )


def lineitem_tape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The driver's lineitem as a tie-heavy tape; seq numbers a symbol's rows in a total order."""
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    total = Window.partitionBy("l_returnflag").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return df.select(
        F.col("l_returnflag").alias("symbol"),
        (F.unix_micros(F.col("l_shipdate").cast("timestamp")) * 1000).alias("ts_ns"),
        F.row_number().over(total).cast("long").alias("seq"),
        F.try_divide("l_extendedprice", "l_quantity").alias("price"),
        F.col("l_quantity").alias("amount"),
    )


def month(ts_ns: str = "ts_ns") -> Column:
    """YYYY-MM of a nanosecond column, in UTC."""
    return F.date_format(F.timestamp_micros(F.floor(F.col(ts_ns) / 1000)), "yyyy-MM")


def save_months(df: DataFrame, path: str, ts_ns: str = "ts_ns") -> None:
    """Sink: a Parquet store by symbol and month; the months that df has are replaced, others stay."""
    df = df.withColumn("month", month(ts_ns))
    df.repartition("symbol", "month").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("symbol", "month").parquet(path)


def load_months(spark: SparkSession, path: str, start_ns: int | None = None, end_ns: int | None = None, only: str | None = None, ts_ns: str = "ts_ns") -> DataFrame:
    """Scan of a store: one month, or [start_ns, end_ns] both inclusive; other months are not read."""
    df = spark.read.parquet(path)
    name = lambda v: F.date_format(F.timestamp_micros(F.lit(v // 1000)), "yyyy-MM")
    if only:
        df = df.where(F.col("month") == only)
    if start_ns is not None:
        df = df.where((F.col("month") >= name(start_ns)) & (F.col(ts_ns) >= start_ns))
    if end_ns is not None:
        df = df.where((F.col("month") <= name(end_ns)) & (F.col(ts_ns) <= end_ns))
    return df


def view_range(df: DataFrame, start_ns: int, end_ns: int) -> DataFrame:
    if start_ns >= end_ns:
        raise ValueError("the range is empty")
    return df.where(F.col("ts_ns").between(start_ns, end_ns))


def months(df: DataFrame) -> DataFrame:
    """The months of a tape, in order."""
    return df.select(month().alias("month")).distinct().orderBy("month")


def month_statistics(df: DataFrame) -> DataFrame:
    """Per symbol and month: records, first and last time, extremes of price and amount."""
    return df.groupBy("symbol", month().alias("month")).agg(
        F.count("*").alias("records"), F.min("ts_ns").alias("first_ns"), F.max("ts_ns").alias("last_ns"),
        F.min("price").alias("min_price"), F.max("price").alias("max_price"), F.min("amount").alias("min_amount"), F.max("amount").alias("max_amount"),
    )


def gaps(df: DataFrame, longest_ns: int = MINUTE_NS) -> DataFrame:
    """Rows that follow the row before in their month after more than longest_ns."""
    w = Window.partitionBy("symbol", "month").orderBy("ts_ns", "seq")
    out = df.withColumn("month", month()).withColumn("gap_ns", F.col("ts_ns") - F.lag("ts_ns").over(w))
    return out.where(F.col("gap_ns") > longest_ns).select("symbol", "month", "ts_ns", "seq", "gap_ns")


def discontinuities(df: DataFrame, longest_ns: int = MINUTE_NS) -> DataFrame:
    """Jumps of the sequence number over more than longest_ns: (symbol, month, start_seq, end_seq, start_ns, end_ns, missing)."""
    w = Window.partitionBy("symbol").orderBy("seq")
    out = df.select("symbol", month().alias("month"), "seq", "ts_ns", F.lag("seq").over(w).alias("start_seq"), F.lag("ts_ns").over(w).alias("start_ns"))
    out = out.where((F.col("seq") - F.col("start_seq") > 1) & (F.col("ts_ns") - F.col("start_ns") > longest_ns))
    return out.select("symbol", "month", "start_seq", F.col("seq").alias("end_seq"), "start_ns", F.col("ts_ns").alias("end_ns"), (F.col("seq") - F.col("start_seq") - 1).alias("missing"))


def integrity(df: DataFrame) -> DataFrame:
    """Per symbol and month: records, missing numbers and their percentage, and whether none are missing over a minute's gap."""
    w = Window.partitionBy("symbol").orderBy("seq")
    jump = F.col("seq") - F.lag("seq").over(w) - 1
    wide = F.col("ts_ns") - F.lag("ts_ns").over(w) > MINUTE_NS
    out = df.select("symbol", month().alias("month"), F.greatest(F.coalesce(jump, F.lit(0)), F.lit(0)).alias("missing"), F.coalesce((jump > 0) & wide, F.lit(False)).alias("bad"))
    return out.groupBy("symbol", "month").agg(F.count("*").alias("records"), F.sum("missing").alias("missing"), (100 * F.sum("missing") / F.count("*")).alias("missing_pct"), (F.count_if("bad") == 0).alias("data_ok"))


def integrity_summary(df: DataFrame) -> DataFrame:
    """The months whose data are not whole."""
    return integrity(df).where(~F.col("data_ok"))


_TRADE_CSV = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("price", T.DoubleType()), T.StructField("amount", T.DoubleType()),
    T.StructField("quote", T.DoubleType()), T.StructField("timestamp", T.LongType()), T.StructField("is_buyer_maker", T.BooleanType()),
])


def csv_zip_trades(spark: SparkSession, path: str) -> DataFrame:
    """Source: zip archives of exchange trade CSVs (id, price, qty, quote qty, time, is_buyer_maker), with or without a header.

    Each archive is unpacked in its own task in chunks; cells that are no numbers become null.
    """

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.name for f in _TRADE_CSV]
        for frame in frames:
            for content in frame["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for member in z.namelist():
                        with z.open(member) as f:
                            for part in pd.read_csv(f, header=None, dtype=str, chunksize=200_000):
                                part = part.iloc[:, :6].set_axis(names[: min(6, part.shape[1])], axis=1).reindex(columns=names)
                                out = pd.DataFrame({c: pd.to_numeric(part[c], errors="coerce") for c in names[:5]})
                                out["is_buyer_maker"] = part["is_buyer_maker"].str.strip().str.lower().isin(["1", "true", "t", "yes"])
                                out = out[out["id"].notna()]
                                yield out.astype({"id": "int64", "timestamp": "Int64"})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(read, _TRADE_CSV)


def checksums(spark: SparkSession, path: str, expected: DataFrame | None = None) -> DataFrame:
    """(path, sha256, md5, ok): digests of files; ok where expected (name, digest) has none for the file or an equal one."""
    df = spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"), F.md5("content").alias("md5"))
    if expected is None:
        return df.withColumn("ok", F.lit(True))
    name = F.element_at(F.split("path", "/"), -1)
    found = df.withColumn("name", name).join(expected, "name", "left")
    return found.select("path", "sha256", "md5", F.coalesce((F.lower("digest") == F.col("sha256")) | (F.lower("digest") == F.col("md5")), F.lit(True)).alias("ok"))


def minute_csv(spark: SparkSession, path: str, symbol: str) -> DataFrame:
    """Source: one-minute OHLCV (and open_interest) CSV as bars."""
    schema = "datetime timestamp, open double, close double, high double, low double, volume double, open_interest double"
    df = spark.read.csv(path, header=True, schema=schema)
    ns = F.unix_micros("datetime") * 1000
    return df.select(F.lit(symbol).alias("symbol"), ns.alias("ts_ns"), ns.alias("seq"), "open", "high", "low", "close", "volume", "open_interest").dropDuplicates(["symbol", "ts_ns"])


def save_bars_csv(bars: DataFrame, path: str, by: str = "freq") -> None:
    bars.write.mode("overwrite").partitionBy(by).csv(path, header=True)


def daily_dollar_volume(tape: DataFrame) -> DataFrame:
    """(symbol, day, dollars): every calendar day from first to last; days without trades repeat the day before."""
    day = F.to_date(F.timestamp_micros(F.floor(F.col("ts_ns") / 1000)))
    sums = tape.groupBy("symbol", day.alias("day")).agg(F.sum(F.col("price") * F.col("amount")).alias("dollars"))
    span = sums.groupBy("symbol").agg(F.explode(F.sequence(F.min("day"), F.max("day"))).alias("day"))
    w = Window.partitionBy("symbol").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    filled = F.last(F.when(F.col("dollars") != 0, F.col("dollars")), ignorenulls=True).over(w)
    return span.join(sums, ["symbol", "day"], "left").select("symbol", "day", filled.alias("dollars"))
