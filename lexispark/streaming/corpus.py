"""Streaming aggregation: the texts of a growing folder are added to the stored statistics."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from lexispark.operators.statistics import ends_of, tokens_of
from lexispark.operators.store import temporary
from lexispark.plans.engine import Engine
from lexispark.schemas import PARTS, TOKENS
from lexispark.sources import tei

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class Seams(StatefulProcessor):
    """Pairs of words across the parts of one file, in whatever order and batches its parts come.

    Parts that follow each other are kept as one run: where it starts and ends,
    and its first and last word.  A part that comes is joined with the run before
    it and the one behind it, and each joint is a pair.  The state of a file is
    as many runs as it has gaps.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.starts = handle.getMapState("starts", "seq long", "ends long, first string, last string")
        self.ends = handle.getMapState("ends", "seq long", "starts long")

    def _taken(self, start: int) -> tuple[int, str | None, str | None]:
        end, first, last = self.starts.getValue((start,))
        self.starts.removeKey((start,))
        self.ends.removeKey((end,))
        return end, first, last

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        pairs = []
        for batch in rows:
            for seq, first, last in zip(batch["seq"], batch["first"], batch["last"], strict=True):
                start = end = int(seq)
                first, last = (None if pd.isna(x) else x for x in (first, last))
                if self.ends.containsKey((start - 1,)):
                    start = self.ends.getValue((start - 1,))[0]
                    _, head, tail = self._taken(start)
                    if tail is not None and first is not None:
                        pairs.append((tail, first))
                    first, last = (first if head is None else head), (tail if last is None else last)
                if self.starts.containsKey((end + 1,)):
                    end, head, tail = self._taken(end + 1)
                    if last is not None and head is not None:
                        pairs.append((last, head))
                    first, last = (head if first is None else first), (last if tail is None else tail)
                self.starts.updateValue((start,), (end, first, last))
                self.ends.updateValue((end,), (start,))
        names = ["document_id", "language_code", "pos", "token", "before"]
        yield pd.DataFrame([(key[0], key[1], None, token, before) for before, token in pairs], columns=names).astype({"pos": "Int64"})

    def close(self) -> None:
        pass


def follow(engine: Engine, folder: str, checkpoint: str, available_now: bool = True, files: int | None = None) -> StreamingQuery:
    """Follow a folder of Parquet files of PARTS rows; those without file and seq are texts of their own.

    The parts of a file may come in any batch: what stands across two of them is
    found by state (Seams), and its pairs go into the batch in which the later
    one came.  A micro-batch is added once its files have been read whole; the
    last batch of the stream (told by its checkpoint) is noted in the same switch
    of the store as its counts, so a restart doesn't count one twice, nor a part
    of one.  The numbers of a file's parts differ and have no gaps in the end.
    """
    spark = engine.spark
    reader = spark.readStream.schema(PARTS)
    parts = (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(folder)
    ends = ends_of(parts).where("seq is not null").groupBy("document_id", "language_code", "file")
    seams = ends.transformWithStateInPandas(Seams(), TOKENS, "Append", "None")
    words = tokens_of(parts.drop("file", "seq")).unionByName(seams)

    def add(batch: DataFrame, number: int) -> None:
        with temporary(engine.spark):
            engine.add_tokens(engine.relevant(batch), (checkpoint, number))  # read once, whether it is added or was before

    writer = words.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")  # keyed state needs it
    try:
        return (writer.trigger(availableNow=True) if available_now else writer).start()
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def follow_corpus(engine: Engine, folder: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Follow a folder of TEI files as Engine.aggregate reads one: each file counts once, in the run that finds it first."""
    texts = tei.corpus_of(tei.corpus_files(engine.spark.readStream.schema(tei.BINARY_FILES), folder))

    def add(batch: DataFrame, number: int) -> None:
        with temporary(engine.spark):
            engine.add_tokens(engine.relevant(batch), (checkpoint, number))  # read once, whether it is added or was before

    writer = tokens_of(texts.where("error is null")).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
