"""Streams into the tables: each micro-batch is one snapshot, or one append to a change log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from saltmarsh.sources.catalog import Catalog
from saltmarsh.sources.ingest import Ingestor
from saltmarsh.sources.kv import KvTable


def to_table(stream: DataFrame, catalog: Catalog, name: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Appends a stream to a catalog table, each batch exactly once: its number is set in the table's properties by the same
    version that adds its snapshot, and a batch whose number is there already adds nothing."""
    mark = f"stream.{catalog.storage.qualified(checkpoint)}"

    def batch(df: DataFrame, number: int) -> None:
        if int(catalog.load_table(name).properties.get(mark, -1)) < number:
            Ingestor(catalog, name).append(df, once=(mark, number))

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def to_log(stream: DataFrame, table: KvTable, checkpoint: str, **trigger) -> StreamingQuery:
    """Appends a stream of changes (key, version, deleted, values). Changes that come twice are the same version twice, which
    no state can tell from once."""
    return stream.writeStream.foreachBatch(lambda df, _: table.append(df)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
