"""Compaction driven by the log: new segments, followed by Structured Streaming, are the trigger; each folds all changes so far into the bases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from larkspur.engine import Engine
from larkspur.errors import CompanionInMemory


def follow(engine: Engine) -> DataFrame:
    """Log records as a stream, one text row each, as segments are sealed."""
    if not engine.store.files:
        raise CompanionInMemory("only a store with a place has a log")
    return engine.spark.readStream.text(engine.store.files.at("log"))


def drain(engine: Engine, checkpoint: str | None = None, interval: str | None = None) -> StreamingQuery:
    """Starts a query that compacts once for each batch of sealed segments; without an interval it drains what there is and stops.

    The batch's rows are not read: the engine holds all that its log says, and the cursor is that of the state folded. A batch that fails is given again, and compaction of a state already folded changes nothing, so a restart is safe.
    """
    at = checkpoint or engine.store.files.at("drain-progress") if engine.store.files else checkpoint
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return follow(engine).writeStream.foreachBatch(lambda rows, _: engine.compact()).option("checkpointLocation", at).trigger(**trigger).start()
