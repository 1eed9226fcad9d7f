"""Updates as a stream: a polled source with offsets, runs that end, and a registry that is read again for each batch."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming import StreamingQuery

UPDATES = "update_id long, payload string"


class Feed:
    """Where updates come from: those from an offset on, in order.  Asking from an offset confirms all before it."""

    def updates(self, offset: int) -> list[dict]:
        raise NotImplementedError


class FileFeed(Feed):
    """Updates in files of JSON lines in a folder that the driver reads."""

    def __init__(self, folder: str):
        self.folder = Path(folder)

    def updates(self, offset: int) -> list[dict]:
        rows = [json.loads(line) for f in sorted(self.folder.glob("*.json")) for line in f.read_text(encoding="utf-8").splitlines() if line.strip()]
        return sorted((r for r in rows if int(r.get("update_id", 0)) >= offset), key=lambda r: int(r.get("update_id", 0)))


class UpdateReader(SimpleDataSourceStreamReader):
    """Offset: the next update's id, which is one more than the last one's."""

    def __init__(self, feed: Feed):
        self.feed = feed

    def initialOffset(self) -> dict:
        return {"next": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows = [(int(u.get("update_id", 0)), json.dumps(u, ensure_ascii=False)) for u in self.feed.updates(start["next"])]
        return iter(rows), {"next": max([start["next"], *(r[0] + 1 for r in rows)])}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        rows, _ = self.read(start)
        return (r for r in rows if r[0] < end["next"])


class Updates(DataSource):
    """``spark.readStream.format("updates")``; subclasses give their own feed."""

    @classmethod
    def name(cls) -> str:
        return "updates"

    def schema(self) -> str:
        return UPDATES

    def feed(self) -> Feed:
        return FileFeed(self.options["folder"])

    def simpleStreamReader(self, schema) -> UpdateReader:
        return UpdateReader(self.feed())


def poll(spark: SparkSession, source: type[DataSource] = Updates, **options: str) -> DataFrame:
    """A stream of (update_id, payload); the checkpoint keeps the offset, so a restart goes on where it was."""
    spark.dataSource.register(source)
    return spark.readStream.format(source.name()).options(**options).load()


def serve(updates: DataFrame, registry: Callable[[], DataFrame], handle: Callable[[DataFrame, DataFrame, int], None], checkpoint: str, once: bool = False) -> StreamingQuery:
    """Hand each batch and the registry, read again for it, to ``handle``; with ``once`` until the updates that are there are done."""

    def run(batch: DataFrame, number: int) -> None:
        handle(batch, registry(), number)

    writer = updates.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
