import json
import threading
import time
import zipfile
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.error import HTTPError
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from tidemark.operators import signals as S, swings
from tidemark.operators.bars import resample
from tidemark.plans.views import bars, trades
from tidemark.sources import feeds, klines
from tidemark.streaming import jobs

SF = "/root/testdata/sf0.001"


def kline(t, price):
    return [t, price, price + 1, price - 1, price + 0.5, 10, t + 3_599_999, 1, 1, 1, 1, 0]


def test_archives(spark, tmp_path):
    for name, rows in (("BTCUSDT-1h-2024-01.zip", [kline(1_704_067_200_000 + k * 3_600_000, 100 + k) for k in range(30)]), ("BTCUSDT-1h-2025-01.zip", [kline(1_735_689_600_000_000 + k * 3_600_000_000, 200 + k) for k in range(5)])):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            z.writestr("first.csv", "\n".join([",".join(klines.RAW)] + [",".join(map(str, r)) for r in rows]))
            z.writestr("second.csv", "not,read")
    got = klines.read_archive(spark, str(tmp_path), "BTCUSDT")
    assert got.count() == 35 and got.where("close is null").count() == 0
    assert [str(r[0]) for r in got.select(F.date_format("ts", "yyyy-MM-dd")).distinct().orderBy(1).collect()] == ["2024-01-01", "2024-01-02", "2025-01-01"]
    assert klines.read_archive(spark, str(tmp_path), "BTCUSDT", "2024-01-01 03:00:00", "2024-01-01 05:00:00").count() == 3


def test_csv_round_trip(spark, tmp_path):
    (tmp_path / "x.csv").write_text("Open Time,Open,Low,High,Close\n2024-01-01 00:00:00,1,0.5,2,1.5\n1704070800000,2,1,3,bad\n")
    df = klines.read_csv(spark, str(tmp_path / "x.csv"), "X")
    assert [(r.open, r.high, r.close) for r in df.orderBy("ts").collect()] == [(1, 2, 1.5), (2, 3, None)]
    klines.write_csv(df, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 2


def test_names():
    assert klines.normal_interval("1M") == "1M" and klines.normal_interval("1H") == "1h"
    with pytest.raises(ValueError):
        klines.normal_symbol("bonds", F.lit("x"))


@pytest.fixture
def file_feed(tmp_path):
    with open(tmp_path / "k.jsonl", "w") as f:
        for k in range(250):
            for s in ("A", "B"):
                f.write(json.dumps([s, *kline(k * 3_600_000, 100 + k)]) + "\n")
    return feeds.FileFeed(str(tmp_path / "k.jsonl"))


def test_paged_history(spark, file_feed):
    fetch = feeds.file_transport(file_feed.path)
    assert len([*feeds.pages(fetch, "A", "1h", 0, 2**40, 100)]) == 250 and [*feeds.pages(fetch, "Z", "1h", 0, 2**40)] == []
    loader = feeds.Loader({"file": file_feed})
    df = loader.history(spark, [feeds.DataRequest("file", "A"), feeds.DataRequest("file", "B")], 0, 250 * 3_600_000)
    assert df.count() == 500 and df.distinct().count() == 500
    with pytest.raises(ValueError):
        loader.history(spark, [feeds.DataRequest("web", "A")], 0, 1)


@pytest.fixture
def endpoint():
    """A REST server of 250 klines a symbol whose first answer is a refusal."""
    asked = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            q = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
            asked.append(q)
            known = q["symbol"] in "AB"
            self.send_response(503 if len(asked) == 1 else 200 if known else 400)
            self.end_headers()
            rows = [kline(k * 3_600_000, 100 + k) for k in range(250) if int(q["startTime"]) <= k * 3_600_000 <= int(q["endTime"])]
            self.wfile.write(json.dumps(rows[: int(q["limit"])]).encode())

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/klines", asked
    server.shutdown()


def test_http_feed(spark, endpoint, tmp_path):
    url, asked = endpoint
    loader = feeds.Loader({"web": feeds.HttpFeed(url, limit=40)})
    df = loader.history(spark, [feeds.DataRequest("web", "A"), feeds.DataRequest("web", "B", "4h")], 0, 250 * 3_600_000)
    assert df.count() == 500 and df.select("symbol", "ts").distinct().count() == 500 and df.where("close is null").count() == 0
    assert {q["interval"] for q in asked} == {"1h", "4h"} and max(int(q["limit"]) for q in asked) == 40
    with pytest.raises(HTTPError):
        feeds.http_transport(url, retries=2, wait=0.01)("nothing", "1h", 0, 1, 1)
    seen = len(asked)
    with pytest.raises(HTTPError):
        feeds.http_transport(url, retries=2, wait=0.01)("nothing", "1h", 0, 1, 1)
    assert len(asked) == seen + 1  # other refusals are not tried again


def test_http_stream_and_own_transport(spark, endpoint, tmp_path):
    stream = feeds.HttpFeed(endpoint[0], limit=100).stream(spark, [feeds.DataRequest("web", "A")])
    q = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="0 seconds").start(str(tmp_path / "o"))
    deadline = time.time() + 60
    while sum(p["numInputRows"] for p in q.recentProgress) < 250 and time.time() < deadline:
        time.sleep(0.2)
    q.stop()
    assert spark.read.parquet(str(tmp_path / "o")).select("ts").distinct().count() == 250
    row = kline(0, 7)  # a transport of one's own travels with what it closes over
    own = feeds.TransportFeed("own", lambda options: lambda symbol, interval, start, end, limit: [row] if start < 10 else [])
    assert [r.open for r in own.history(spark, feeds.DataRequest("own", "A"), 0, 0).collect()] == [7.0]
    again = feeds.kline_source("x", lambda options: feeds.http_transport(endpoint[0]))({"symbol": "A", "limit": "30"}).simpleStreamReader(None)
    assert len([*again.readBetweenOffsets({"at": 0}, {"at": 200 * 3_600_000})]) == 200


def test_cached_table(spark, tmp_path):
    made = []
    for _ in range(2):
        df = feeds.cached(spark, str(tmp_path / "t"), lambda: made.append(1) or spark.range(3))
        assert df.count() == 3
    assert made == [1]


def run_all(query):
    query.query.processAllAvailable()
    assert query.stop(30)


def test_feed_stream(spark, file_feed, tmp_path):
    seen = []
    handle = jobs.start(feeds.Loader({"file": file_feed}).stream(spark, [feeds.DataRequest("file", "A"), feeds.DataRequest("file", "B")]), lambda df, i: seen.append(df.count()), str(tmp_path / "c"))
    end = time.time() + 60
    while sum(seen) < 500 and time.time() < end:
        time.sleep(0.5)
    assert handle.stop(30) and sum(seen) == 500


def test_stream_bars_equal_batch(spark):
    schema = spark.read.parquet(f"{SF}/events.parquet").schema
    ticks = jobs.event_stream(spark, SF, schema)
    run_all(jobs.to_memory(jobs.stream_bars(ticks, "4 hours"), "bars_mem", "complete"))
    batch = resample(trades(spark, SF).drop("price").join(spark.read.parquet(f"{SF}/events.parquet").select(F.col("event_id").alias("seq"), F.col("value").alias("price")), "seq"), "4 hours")
    cols = ["symbol", "ts", "open", "high", "low", "close"]
    assert sorted(map(tuple, spark.table("bars_mem").select(cols).collect())) == sorted(map(tuple, batch.select(cols).collect()))
    run_all(jobs.to_memory(jobs.stream_sessions(ticks, "30 minutes"), "sessions_mem", "complete"))
    assert spark.table("sessions_mem").agg(F.sum("n")).first()[0] == spark.read.parquet(f"{SF}/events.parquet").count()


def folder_stream(spark, df, path, order):
    """df in three files by order, read one per micro-batch."""
    cuts = df.approxQuantile(order, [1 / 3, 2 / 3], 0)
    for k, cond in enumerate((F.col(order) <= cuts[0], (F.col(order) > cuts[0]) & (F.col(order) <= cuts[1]), F.col(order) > cuts[1])):
        df.where(cond).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_stream_zigzag_equals_batch(spark, tmp_path):
    b = bars(spark, SF).select("symbol", "bar_idx", "high", "low")
    run_all(jobs.to_memory(jobs.stream_zigzag(folder_stream(spark, b, str(tmp_path / "z"), "bar_idx"), 0.01), "zig_mem"))
    want = sorted(map(tuple, swings.zigzag(b, 0.01).collect()))
    assert want and sorted(map(tuple, spark.table("zig_mem").collect())) == want


def test_stream_admission_equals_batch(spark, tmp_path):
    rows = [("a", i, 100 + (i * 37 % 11) / 10, 1 if i % 3 else -1) for i in range(120)]
    df = spark.createDataFrame(rows, "symbol string, bar_idx long, price double, direction int")
    run_all(jobs.to_memory(jobs.stream_admission(folder_stream(spark, df, str(tmp_path / "a"), "bar_idx")), "book_mem"))
    batch = S.admit(df.select("symbol", "bar_idx", F.col("price").alias("close"), F.col("direction").alias("signal")))
    assert sorted(map(tuple, spark.table("book_mem").collect())) == sorted(map(tuple, batch.collect()))


def test_latest_klines(spark, tmp_path):
    df = spark.createDataFrame([("a", 0, 1, 5.0), ("a", 0, 3, 7.0), ("a", 0, 2, 6.0), ("a", 60, 4, 8.0)], "symbol string, o long, e long, close double").select("symbol", F.timestamp_seconds("o").alias("open_time"), F.timestamp_seconds("e").alias("event_time"), "close", F.lit(1.0).alias("volume"))
    df.write.parquet(str(tmp_path / "k"))
    run_all(jobs.to_memory(jobs.latest_klines(spark.readStream.schema(df.schema).parquet(str(tmp_path / "k"))), "latest_mem", "complete"))
    assert sorted(r.close for r in spark.table("latest_mem").collect()) == [7.0, 8.0]
