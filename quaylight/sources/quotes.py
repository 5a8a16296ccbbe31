"""Price snapshots and a stream of quotes: a source of Spark's Python Data Source API over a log of price messages."""

from __future__ import annotations

import io
import json
from collections.abc import Iterator, Mapping
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "symbol string, at timestamp, price double, log string, line long"
#: Messages of a price log: a price of an instrument with bids and asks, best first; heartbeats and others are no quotes.
_LEVEL = "array<struct<price:string>>"
MESSAGE = f"struct<type:string,instrument:string,time:string,bids:{_LEVEL},asks:{_LEVEL}>"


def quote(line: str, symbols: Mapping[str, str] | None) -> tuple[str, datetime, float] | None:
    """(symbol, time, mid price) of a message; None for heartbeats, other instruments and messages without both prices."""
    try:
        m = json.loads(line)
        if m.get("type", "PRICE") != "PRICE":
            return None
        name = m["instrument"]
        symbol = name if symbols is None else symbols.get(name)
        mid = (float(m["bids"][0]["price"]) + float(m["asks"][0]["price"])) / 2
        head, _, fraction = m["time"].rstrip("Z").partition(".")
        at = datetime.fromisoformat(f"{head}.{(fraction + '000000')[:6]}").replace(tzinfo=timezone.utc)
    except (ValueError, KeyError, IndexError, TypeError, AttributeError):
        return None
    return None if symbol is None or mid != mid or abs(mid) == float("inf") else (symbol, at, mid)


def _name(path: str) -> str:
    return path.rsplit("/", 1)[-1]


class _Log(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Folder:
    """The logs of a folder.

    Names grow with time, and a log is complete when it has its name: writers rename it last.
    """

    def __init__(self, options: Mapping[str, str]):
        self.uri = options["path"]
        self.symbols = json.loads(options["symbols"]) if options.get("symbols") else None

    def logs(self) -> list[str]:
        from pyarrow import fs

        files, top = fs.FileSystem.from_uri(self.uri)
        found = files.get_file_info(fs.FileSelector(top))
        return sorted(f.path for f in found if f.is_file and not f.base_name.startswith(("_", ".")))

    def quotes(self, path: str) -> Iterator[tuple]:
        from pyarrow import fs

        files, _ = fs.FileSystem.from_uri(self.uri)
        # read by lines: a log of any size takes the memory of one
        with files.open_input_stream(path) as stream:
            for number, line in enumerate(io.TextIOWrapper(stream, encoding="utf-8", errors="replace")):
                found = quote(line, self.symbols)
                if found:
                    yield (*found, _name(path), number)


class _Batch(DataSourceReader):
    def __init__(self, options: Mapping[str, str]):
        self.folder = _Folder(options)

    def partitions(self) -> list[InputPartition]:
        return [_Log(p) for p in self.folder.logs()]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return self.folder.quotes(partition.path) if isinstance(partition, _Log) else iter(())


class _Stream(DataSourceStreamReader):
    """The offset is the name of the last log; a batch is the logs between two names, so it can be read again after a restart."""

    def __init__(self, options: Mapping[str, str]):
        self.folder = _Folder(options)

    def initialOffset(self) -> dict:
        return {"log": ""}

    def latestOffset(self) -> dict:
        return {"log": max((_name(p) for p in self.folder.logs()), default="")}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_Log(p) for p in self.folder.logs() if start["log"] < _name(p) <= end["log"]]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return self.folder.quotes(partition.path)


class PriceLog(DataSource):
    """``price_log``: quotes of a folder of logs, as a table or as a stream.

    Options: ``path``, a URI of a store that PyArrow opens too; ``symbols``, a JSON object of the instruments wanted and
    their symbols, without which all count under their own names.
    """

    @classmethod
    def name(cls) -> str:
        return "price_log"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> DataSourceReader:
        return _Batch(self.options)

    def streamReader(self, schema: object) -> DataSourceStreamReader:
        return _Stream(self.options)


def quotes(spark: SparkSession, path: str, symbols: Mapping[str, str] | None = None, stream: bool = True) -> DataFrame:
    """``symbol, at, price, log, line`` of a folder of price logs, as a stream or as it lies."""
    spark.dataSource.register(PriceLog)
    reader = (spark.readStream if stream else spark.read).format("price_log").option("path", path)
    return (reader if symbols is None else reader.option("symbols", json.dumps(dict(symbols)))).load()


def price_snapshots(payloads: DataFrame, symbols: Mapping[str, str], payload: str = "payload") -> DataFrame:
    """``symbol, timeframe, timestamp, open, high, low, close, volume, source`` of payloads that list prices: a bar of the mid price each.

    Instruments that aren't asked for, and prices without a time or one of both sides, are left out.
    """
    rows = payloads.select(F.explode(F.from_json(payload, f"struct<prices:array<{MESSAGE}>>")["prices"]).alias("p"))
    side = lambda name: F.col(f"p.{name}")[0]["price"].try_cast("double")
    symbol: Column = F.create_map(*[F.lit(x) for pair in symbols.items() for x in pair])[F.col("p.instrument")]
    mid = (side("bids") + side("asks")) / 2
    out = rows.select(symbol.alias("symbol"), F.lit("PRICE").alias("timeframe"), F.try_to_timestamp("p.time").alias("timestamp"), mid.alias("mid"))
    good = out.filter("symbol is not null and timestamp is not null and mid is not null and not isnan(mid) and abs(mid) < double('infinity')")
    return good.select("symbol", "timeframe", "timestamp", *[F.col("mid").alias(c) for c in ("open", "high", "low", "close")], F.lit(None).cast("double").alias("volume"), F.lit("quotes").alias("source"))
