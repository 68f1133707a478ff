"""Streams: progress that never goes back, an index kept up to date, time studied from events, texts not seen before."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.operators.vectors import upsert
from leafmill.sources.tables import settle


def progress_stream(saves: DataFrame) -> DataFrame:
    """Running state of each section from a stream of saves, for update mode; as ``merged_progress`` on all of them."""
    x = saves.groupBy("user_id", "session_id", "section_number").agg(F.max("completed").alias("completed"), F.max_by(F.struct("quiz_score", "explanation_text"), "id").alias("l"))
    return x.select("user_id", "session_id", "section_number", "completed", "l.quiz_score", "l.explanation_text")


def index_upserts(read: Callable[[], DataFrame], write: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch that merges each batch into the store ``read`` gives and hands it to ``write``."""

    def merge(batch: DataFrame, _: int) -> None:
        write(settle(upsert(read(), batch)))

    return merge


def new_texts(texts: DataFrame, text: str, at: str, late: str = "1 day") -> DataFrame:
    """Texts whose content has not come before within the watermark."""
    return texts.withColumn("signature", F.sha2(F.encode(F.coalesce(text, F.lit("")), "UTF-8"), 256)).withWatermark(at, late).dropDuplicatesWithinWatermark(["signature"])


def study_time(events: DataFrame, start: str = "view", stop: tuple[str, ...] = ("click",)) -> DataFrame:
    """(user_id, seconds): time between start and stop events of each user, summed as they come, for update mode.

    A start while one runs is ignored, and so is a stop without one; each span counts whole seconds.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        began, total = state.get if state.exists else (None, 0)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        for ts, kind in zip(rows["ts"], rows["event_type"]):
            if kind == start and began is None:
                began = ts.timestamp()
            elif kind in stop and began is not None:
                total += int(max(0.0, ts.timestamp() - began))
                began = None
        state.update((began, total))
        yield pd.DataFrame({"user_id": [key[0]], "seconds": [total]})

    from pyspark.sql.streaming.state import GroupStateTimeout

    return events.where(F.col("event_type").isin([start, *stop])).groupBy("user_id").applyInPandasWithState(step, "user_id bigint, seconds bigint", "began double, total bigint", "update", GroupStateTimeout.NoTimeout)
