"""Pages of a peer's change log as a streaming source whose offset is the cursor: S10, R13.

A peer serves ``GET {peer}/sync/changes?since=S&limit=L``: JSON with ``changes`` (rows after S in order of seq, L at most),
``next`` (the cursor after them) and ``has_more``.  The log is only appended to.

    spark.dataSource.register(PeerChanges)
    spark.readStream.format("peer_changes").option("peers", "http://a:8000,http://b:8000").load()
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlencode
from urllib.request import Request, urlopen

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

COLUMNS = ("seq", "tbl", "pk", "col", "value", "hlc", "device")
SCHEMA = "peer string, seq long, tbl string, pk string, col string, value string, hlc string, device string"


@dataclass
class Span(InputPartition):
    """The changes of a peer after one cursor up to another."""

    peer: str
    since: int
    until: int


class PeerChanges(DataSource):
    """Options: ``peers`` (addresses, comma-separated), ``limit`` (rows a page, 5000), ``pages`` (a peer and micro-batch, 1), ``since`` (the first cursor, 0), ``token`` (sent as bearer), ``timeout`` (seconds, 30)."""

    @classmethod
    def name(cls) -> str:
        return "peer_changes"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: StructType) -> PeerReader:
        return PeerReader(dict(self.options))


class PeerReader(DataSourceStreamReader):
    """Offsets are a cursor a peer.  The driver reads pages only to learn how far a micro-batch goes; tasks, one a peer, read the rows.

    After a restart Spark plans the last micro-batch of its log before it asks for more; there the cursors come from.  A
    peer that is added later starts at ``since``; one that cannot be reached keeps its cursor and is asked again.
    """

    def __init__(self, options: dict[str, str]):
        self.peers = [p.strip().rstrip("/") for p in options.get("peers", "").split(",") if p.strip()]
        if not self.peers:
            raise ValueError("option 'peers' names no peer")
        self.limit, self.pages, self.first = int(options.get("limit", 5000)), int(options.get("pages", 1)), int(options.get("since", 0))
        self.token, self.timeout = options.get("token"), float(options.get("timeout", 30))
        self.at: dict[str, int] | None = None

    def page(self, peer: str, since: int) -> dict:
        headers = {"Authorization": f"Bearer {self.token}"} if self.token else {}
        with urlopen(Request(f"{peer}/sync/changes?{urlencode({'since': since, 'limit': self.limit})}", headers=headers), timeout=self.timeout) as r:
            return json.load(r)

    def initialOffset(self) -> dict:
        return {p: self.first for p in self.peers}

    def latestOffset(self) -> dict:
        at = {**self.initialOffset(), **(self.at or {})}
        for peer in self.peers:
            for _ in range(self.pages):
                try:
                    page = self.page(peer, at[peer])
                except OSError:
                    break
                at[peer] = max(at[peer], int(page["next"]))
                if not page.get("has_more"):
                    break
        self.at = at
        return at

    def partitions(self, start: dict, end: dict) -> list[Span]:
        if self.at is None:
            self.at = dict(end)
        return [Span(p, start.get(p, self.first), until) for p, until in end.items() if until > start.get(p, self.first)]

    def read(self, partition: Span) -> Iterator[tuple]:
        since = partition.since
        while since < partition.until:
            page = self.page(partition.peer, since)
            for row in page["changes"]:
                if since < row["seq"] <= partition.until:
                    yield (partition.peer, *(row.get(c) for c in COLUMNS))
            if int(page["next"]) <= since:
                raise ValueError(f"{partition.peer} serves no changes after {since}, but its log went on to {partition.until}")
            since = int(page["next"])


def cursors(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Peer, cursor: how far each peer's log has been taken, by the last micro-batch that a stream has committed to its checkpoint."""
    number = F.regexp_extract("_metadata.file_path", r"/(\d+)$", 1).cast("long")
    done = spark.read.text(f"{checkpoint}/commits").agg(F.max(number)).first()[0]
    # the third line of an offset file is the offset of the only source
    lines = spark.read.text(f"{checkpoint}/offsets", wholetext=True).filter(number == F.lit(done)).select(F.split("value", "\n").alias("lines"))
    return lines.select(F.explode(F.from_json(F.get("lines", 2), "map<string, long>")).alias("peer", "cursor"))
