"""Feeds: an interface for history and stream, registered sources, and Spark data sources that page through a transport.

A transport is a callable (symbol, interval, start_ms, end_ms, limit) -> rows of raw klines in order of time.  kline_source() makes a data source of
any function that opens one; Spark ships it to the executors with the source.  http_transport() asks a REST endpoint, file_transport() reads JSON-lines.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from urllib.error import HTTPError, URLError
from urllib.parse import urlencode
from urllib.request import urlopen

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from .klines import RAW, clean

Transport = Callable[[str, str, int, int, int], list[list]]
#: Opens a transport from a reader's options.
Connect = Callable[[dict], Transport]
RAW_DDL = ", ".join(f"{c} string" for c in [*RAW, "symbol"])


@dataclass(frozen=True)
class DataRequest:
    """One series: source, symbol and timeframe."""

    source: str
    symbol: str
    timeframe: str = "1h"


def file_transport(path: str) -> Transport:
    """Klines from a JSON-lines file of [symbol, open_time, ...] rows ordered by time.

    The place where a symbol's last page ended is kept, so the pages of one reader take one pass over the file.
    """
    ends: dict[str, tuple[int, int]] = {}

    def fetch(symbol: str, interval: str, start: int, end: int, limit: int) -> list[list]:
        out: list[list] = []
        last, at = ends.get(symbol, (-1, 0))
        with open(path, "rb") as lines:
            lines.seek(at if start > last else 0)
            while len(out) < limit and (line := lines.readline()):
                row = json.loads(line)
                if row[0] == symbol and start <= int(row[1]) <= end:
                    out.append(row[1:])
            if out:
                ends[symbol] = int(out[-1][0]), lines.tell()
        return out

    return fetch


def http_transport(url: str, timeout: float = 30.0, retries: int = 4, wait: float = 0.5) -> Transport:
    """Klines from a REST endpoint that takes symbol, interval, startTime, endTime and limit and answers with a JSON list of rows.

    Refusals for load (429, 5xx) and broken connections are tried again after waits that double; other errors are raised.
    """

    def fetch(symbol: str, interval: str, start: int, end: int, limit: int) -> list[list]:
        asked = f"{url}?{urlencode({'symbol': symbol, 'interval': interval, 'startTime': start, 'endTime': end, 'limit': limit})}"
        for attempt in range(retries + 1):
            try:
                with urlopen(asked, timeout=timeout) as answer:
                    return json.load(answer)
            except (URLError, ConnectionError, TimeoutError) as error:
                passing = not isinstance(error, HTTPError) or error.code == 429 or error.code >= 500
                if attempt == retries or not passing:
                    raise
                time.sleep(wait * 2**attempt)
        raise AssertionError

    return fetch


def pages(fetch: Transport, symbol: str, interval: str, start: int, end: int, limit: int = 1000) -> Iterator[tuple]:
    """Rows page by page: the cursor goes to the last close_time + 1 until a page is empty or short."""
    cursor = start
    while cursor <= end:
        page = fetch(symbol, interval, cursor, end, limit)
        for row in page:
            yield (*[str(v) for v in row], symbol)
        if len(page) < limit:
            return
        cursor = int(page[-1][RAW.index("close_time")]) + 1


class _Slice(InputPartition):
    def __init__(self, start: int, end: int) -> None:
        self.start, self.end = start, end


class _KlineReader(DataSourceReader):
    def __init__(self, options: dict, connect: Connect) -> None:
        self.o, self.connect = options, connect

    def partitions(self) -> list[InputPartition]:
        """Equal slices of time, so that executors page through them side by side."""
        start, end, n = int(self.o["start"]), int(self.o["end"]), int(self.o.get("slices", 8))
        step = max(1, -(-(end - start + 1) // n))
        return [_Slice(a, min(a + step - 1, end)) for a in range(start, end + 1, step)]

    def read(self, partition: _Slice) -> Iterator[tuple]:
        yield from pages(self.connect(self.o), self.o["symbol"], self.o.get("interval", "1h"), partition.start, partition.end, int(self.o.get("limit", 1000)))


class _KlineStream(SimpleDataSourceStreamReader):
    """Serves rows in batches of `limit`; the offset is the next time to ask for, so a restart asks for what was not kept."""

    def __init__(self, options: dict, connect: Connect) -> None:
        self.o, self.fetch = options, connect(options)

    def _rows(self, start: int, end: int, limit: int) -> list[list]:
        return self.fetch(self.o["symbol"], self.o.get("interval", "1h"), start, end, limit)

    def _tuples(self, rows: list[list]) -> Iterator[tuple]:
        return iter([(*[str(v) for v in r], self.o["symbol"]) for r in rows])

    def initialOffset(self) -> dict:  # noqa: N802
        return {"at": int(self.o.get("start", 0))}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows = self._rows(start["at"], 2**53, int(self.o.get("limit", 1000)))
        return self._tuples(rows), {"at": int(rows[-1][0]) + 1} if rows else start

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        """A batch anew after a failure: page by page, as an endpoint may give less than was served before."""
        at, limit = start["at"], int(self.o.get("limit", 1000))
        while at < end["at"] and (rows := self._rows(at, end["at"] - 1, limit)):
            yield from self._tuples(rows)
            at = int(rows[-1][0]) + 1


def kline_source(source: str, connect: Connect) -> type[DataSource]:
    """A data source for spark.read.format(source) and spark.readStream.format(source), after spark.dataSource.register().

    connect(options) opens a transport, in the task that reads; it travels with what it closes over, but modules it names must be there on the executors.
    """

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return source

        def schema(self) -> str:
            return RAW_DDL

        def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
            return _KlineReader(dict(self.options), connect)

        def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:  # noqa: ANN001, N802
            return _KlineStream(dict(self.options), connect)

    return Source


class Feed:
    """A source of bars; subclasses say where their raw klines come from."""

    def history(self, spark: SparkSession, request: DataRequest, start: int, end: int) -> DataFrame:
        raise NotImplementedError

    def stream(self, spark: SparkSession, requests: list[DataRequest]) -> DataFrame:
        raise NotImplementedError


class TransportFeed(Feed):
    """Klines of any transport: TransportFeed("venue", lambda options: http_transport(options["url"]), url=...)."""

    def __init__(self, source: str, connect: Connect, **options: object) -> None:
        self.source, self.connect, self.options = source, connect, options

    def _load(self, reader, request: DataRequest, **options: object):  # noqa: ANN001, ANN202
        for k, v in {**self.options, "symbol": request.symbol, "interval": request.timeframe, **options}.items():
            reader = reader.option(k, str(v))
        return reader.load()

    def _register(self, spark: SparkSession) -> None:
        spark.dataSource.register(kline_source(self.source, self.connect))

    def history(self, spark: SparkSession, request: DataRequest, start: int, end: int) -> DataFrame:
        self._register(spark)
        return clean(self._load(spark.read.format(self.source), request, start=start, end=end))

    def stream(self, spark: SparkSession, requests: list[DataRequest]) -> DataFrame:
        self._register(spark)
        # one source has one timeframe, that of its first request
        same = [DataRequest(r.source, r.symbol, requests[0].timeframe) for r in requests]
        parts = [clean(self._load(spark.readStream.format(self.source), r)).withColumn("source", F.lit(r.source)) for r in same]
        return reduce(DataFrame.unionByName, parts)


class FileFeed(TransportFeed):
    """Replays klines from a file."""

    def __init__(self, path: str) -> None:
        super().__init__("klines", lambda options: file_transport(options["path"]), path=path)
        self.path = path


class HttpFeed(TransportFeed):
    """Klines of a REST endpoint; its stream polls for what came since the last batch."""

    def __init__(self, url: str, **options: object) -> None:
        super().__init__("http_klines", lambda options: http_transport(options["url"]), url=url, **options)


class Loader:
    """Requests to any registered feeds, as one long table or one stream."""

    def __init__(self, feeds: dict[str, Feed]) -> None:
        self.feeds = feeds

    def _feed(self, source: str) -> Feed:
        if source not in self.feeds:
            raise ValueError(f"unknown source {source!r}")
        return self.feeds[source]

    def history(self, spark: SparkSession, requests: list[DataRequest], start: int, end: int) -> DataFrame:
        """All series in long form; operators.bars.panel() gives the wide view."""
        return reduce(DataFrame.unionByName, [self._feed(r.source).history(spark, r, start, end).withColumn("source", F.lit(r.source)) for r in requests])

    def stream(self, spark: SparkSession, requests: list[DataRequest]) -> DataFrame:
        by: dict[str, list[DataRequest]] = {}
        for r in requests:
            by.setdefault(r.source, []).append(r)
        return reduce(DataFrame.unionByName, [self._feed(s).stream(spark, rs) for s, rs in by.items()])


def cached(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A table kept as Parquet: made once (mode ignore), read afterwards."""
    try:
        return spark.read.parquet(path)
    except Exception as error:  # the path does not exist yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
    make().write.mode("ignore").parquet(path)
    return spark.read.parquet(path)
