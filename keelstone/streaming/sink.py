"""The streaming sink: micro-batches become commits, each exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from keelstone.errors import ConflictError, SchemaError, UnsupportedError
from keelstone.lake import Table

MODES = ("append", "complete", "update")


class Sink:
    """Writes the batches of one streaming query to a table.

    The table's log records, in the same entry as the files, the last batch of each query; a batch that is delivered
    again after a restart is skipped.  ``append`` adds rows (upserts them into keyed tables), ``update`` upserts and
    needs a keyed table, ``complete`` overwrites and is refused by append-only tables.
    """

    def __init__(self, path: str, query_id: str, mode: str = "append", *, merge_schema: bool | None = None, **layout):
        if mode not in MODES:
            raise UnsupportedError(f"unknown output mode {mode}")
        self.path, self.query_id, self.mode, self.merge_schema, self.layout = path, query_id, mode, merge_schema, layout

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        if any(isinstance(f.dataType, T.NullType) for f in batch.schema.fields):
            raise SchemaError("a streaming batch has columns without a type")
        table = Table(batch.sparkSession, self.path)
        state = table.log.snapshot()
        if state.streams.get(self.query_id, -1) >= batch_id:
            return
        keyed = state.meta.keyed if state.meta else bool(self.layout.get("hash_partitions"))
        if self.mode == "update" and not keyed:
            raise UnsupportedError("update mode needs a table with hash columns")
        stream = {"query_id": self.query_id, "batch_id": batch_id}
        try:
            if self.mode == "complete":
                table.write(batch, "overwrite", merge_schema=self.merge_schema, stream=stream, **self.layout)
            elif keyed and state.meta:
                table.upsert(batch, merge_schema=self.merge_schema, stream=stream)
            else:
                table.write(batch, "append", merge_schema=self.merge_schema, stream=stream, **self.layout)
        except ConflictError:
            if table.log.snapshot().streams.get(self.query_id, -1) < batch_id:
                raise


def write_stream(
    data: DataFrame, path: str, query_id: str, checkpoint: str, mode: str = "append", trigger: dict | None = None, **options
) -> StreamingQuery:
    """Start a streaming query into the table at ``path``; ``query_id`` must stay the same over restarts."""
    sink = Sink(path, query_id, mode, **options)
    writer = data.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(sink)
    return (writer.trigger(**trigger) if trigger else writer).start()
