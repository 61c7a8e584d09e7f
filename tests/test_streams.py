"""Streaming source of change pages across restarts, and offers with a time to live against the batch query."""

import json
import os
import threading
from collections import Counter
from datetime import datetime, timedelta
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from tessera.sources import changes
from tessera.streaming import captures, offers


class Peer:
    """A peer that serves its log in pages."""

    def __init__(self):
        self.log, self.asked, peer = [], [], self

        class Serve(BaseHTTPRequestHandler):
            def do_GET(self):
                q = parse_qs(urlparse(self.path).query)
                since, limit = int(q["since"][0]), int(q["limit"][0])
                peer.asked.append((since, limit))
                after = [r for r in peer.log if r["seq"] > since]
                page = after[:limit]
                body = json.dumps({"changes": page, "next": page[-1]["seq"] if page else since, "has_more": len(after) > limit}).encode()
                self.send_response(200)
                self.end_headers()
                self.wfile.write(body)

            def log_message(self, *_):
                pass

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Serve)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        self.url = f"http://127.0.0.1:{self.server.server_port}"

    def add(self, n):
        start = len(self.log)
        self.log += [{"seq": 10 * (start + i + 1), "tbl": "t", "pk": str(i % 3), "col": "c", "value": str(start + i), "hlc": f"{start + i:06}", "device": "d"} for i in range(n)]


@pytest.fixture
def peers():
    two = [Peer(), Peer()]
    yield two
    for p in two:
        p.server.shutdown()


def take(spark, peers, tmp_path, names=None):
    spark.dataSource.register(changes.PeerChanges)
    stream = spark.readStream.format("peer_changes").option("peers", ",".join(names or [p.url for p in peers])).option("limit", 7).load()
    run = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/checkpoint").start()
    try:
        run.processAllAvailable()
        return run.recentProgress
    finally:
        run.stop()


def held(spark, peers, tmp_path):
    got = Counter((r["peer"], r["seq"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    return got == Counter((p.url, r["seq"]) for p in peers for r in p.log)


def test_change_pages_resume_without_loss_or_repeat(spark, peers, tmp_path):
    peers[0].add(30)
    peers[1].add(3)
    progress = take(spark, peers, tmp_path)
    assert held(spark, peers, tmp_path) and max(p["numInputRows"] for p in progress) <= 14
    peers[0].add(9)
    for p in peers:
        p.asked.clear()
    take(spark, peers, tmp_path)
    assert held(spark, peers, tmp_path) and min(s for s, _ in peers[1].asked) >= 30
    assert {(r["peer"], r["cursor"]) for r in changes.cursors(spark, f"{tmp_path}/checkpoint").collect()} == {(peers[0].url, 390), (peers[1].url, 30)}
    take(spark, peers, tmp_path)
    assert held(spark, peers, tmp_path)


def test_an_unreachable_peer_keeps_its_cursor(spark, peers, tmp_path):
    peers[0].add(5)
    gone = "http://127.0.0.1:9"
    take(spark, peers, tmp_path, [peers[0].url, gone])
    assert held(spark, peers[:1], tmp_path)
    assert {r["peer"]: r["cursor"] for r in changes.cursors(spark, f"{tmp_path}/checkpoint").collect()} == {peers[0].url: 50, gone: 0}


def test_source_needs_peers():
    with pytest.raises(ValueError, match="peers"):
        changes.PeerReader({})


TTL = timedelta(minutes=10)


def at(minutes):
    return datetime(2024, 1, 1) + timedelta(minutes=minutes)


OFFERS = [
    ("in time", 1, True, at(0)), ("in time", 2, False, at(10)), ("in time", 3, False, at(10)),
    ("late", 4, True, at(0)), ("late", 5, False, at(10.5)),
    ("never", 6, False, at(3)),
    ("replaced", 7, True, at(0)), ("replaced", 8, True, at(9)), ("replaced", 9, False, at(18)), ("replaced", 10, True, at(18)),
    ("again", 11, True, at(0)), ("again", 12, True, at(30)), ("again", 13, False, at(31)),
    ("open", 14, True, at(55)),
]
COLUMNS = "key string, id long, offered boolean, at timestamp"


def test_offers_in_batch_and_in_a_stream_agree(spark, tmp_path):
    rows = spark.createDataFrame(OFFERS, COLUMNS)
    want = {
        ("in time", 2, 1, "taken"), ("in time", 3, None, "refused"), ("late", 5, None, "refused"), ("late", None, 4, "expired"), ("never", 6, None, "refused"),
        ("replaced", None, 7, "replaced"), ("replaced", 9, 8, "taken"), ("replaced", None, 10, "expired"), ("again", None, 11, "expired"), ("again", 13, 12, "taken"),
    }
    assert {tuple(r) for r in offers.outcomes(rows, TTL, at(60)).select("key", "id", "offer", "outcome").collect()} == want
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        (tmp_path / "in").mkdir()
        ordered = sorted(OFFERS, key=lambda r: (r[3], r[1]))
        for k in range(0, len(ordered), 4):
            lines = [json.dumps({"key": key, "id": i, "offered": o, "at": t.isoformat()}) for key, i, o, t in ordered[k : k + 4]]
            (tmp_path / "in" / f"{k:03}.json").write_text("\n".join(lines))
        (tmp_path / "in" / "999.json").write_text(json.dumps({"key": "clock", "id": 99, "offered": False, "at": at(60).isoformat()}))
        for k, f in enumerate(sorted((tmp_path / "in").iterdir())):
            os.utime(f, (1_700_000_000 + k, 1_700_000_000 + k))  # files are read in order of their times
        stream = spark.readStream.schema(COLUMNS).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        run = offers.outcomes_stream(stream, TTL, "0 seconds").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
        run.awaitTermination()
        got = {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").select("key", "id", "offer", "outcome").collect()}
        assert got == want | {("clock", 99, None, "refused")}
        state = spark.read.format("statestore").option("stateVarName", "offer").load(f"{tmp_path}/checkpoint")
        assert [r["k"] for r in state.select(F.col("key.key").alias("k")).collect()] == ["open"]  # what expired or was taken is gone
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_windows_over_events(spark, tmp_path):
    rows = [(1, "2024-01-01T00:01:00", 1), (1, "2024-01-01T00:01:00", 1), (2, "2024-01-01T00:04:00", 1), (3, "2024-01-01T00:11:00", 2), (4, "2024-01-01T02:00:00", 3)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(json.dumps({"event_id": i, "ts": t, "user_id": u, "event_type": "x", "value": 1.0, "props": "{}"}) for i, t, u in rows))

    def run(name, build):
        q = build(captures.idempotent(captures.read_events(spark, str(tmp_path / "in")), "10 minutes")).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name).collect()

    assert {(str(r["start"])[11:16], r["n"], r["total"]) for r in run("tumble", lambda e: captures.tumbling(e, "10 minutes"))} == {("00:00", 2, 2.0), ("00:10", 1, 1.0)}
    assert {(r["user_id"], r["n"]) for r in run("sess", lambda e: captures.sessions(e, "5 minutes"))} == {(1, 2), (2, 1)}
