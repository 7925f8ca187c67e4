"""Structured Streaming forms of the windowing, session, deduplication and first-touch operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..storage import shared_dir


def parquet_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A stream over the files of a table, be that a file or a folder of part files; its schema is read once.

    File sources list folders, so a single file is named by its folder and a filter."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    folder, _, name = path.rstrip("/").rpartition("/")
    is_file = spark.read.format("binaryFile").option("pathGlobFilter", name).load(folder).select("path").limit(1).count() == 1
    if is_file:
        reader, path = reader.option("pathGlobFilter", name), folder
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def run_available(stream: DataFrame, name: str, mode: str = "append", each: Callable[[DataFrame, int], None] | None = None, path: str | None = None) -> str:
    """Process all that is available, then stop; returns the output's path.  With `each`, it gets every micro-batch."""
    base = f"{shared_dir(stream.sparkSession)}/stream-{name}-{pd.Timestamp.now().value}"
    out = path or f"{base}/out"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True)
    if each is not None:
        query = writer.foreachBatch(each).start()
    elif mode == "append":
        query = writer.format("parquet").option("path", out).start()
    else:
        query = writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).start()
    query.awaitTermination()
    return out


def tumbling_counts(events: DataFrame, time: str, length: str, late: str, by: Sequence[str], value: str) -> DataFrame:
    """Count and sum in tumbling windows; state older than the watermark is dropped."""
    w = events.withWatermark(time, late).groupBy(F.window(time, length).alias("w"), *by)
    return w.agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), *by, "n", "total")


def sessions(events: DataFrame, time: str, gap: str, late: str, key: str) -> DataFrame:
    """Sessions that end after a gap without events."""
    s = events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("s"), key).agg(F.count("*").alias("n"))
    return s.select(key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def distinct_events(events: DataFrame, time: str, late: str, keys: Sequence[str]) -> DataFrame:
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))


def count_windows(rows: DataFrame, key: str, order: Sequence[str], values: Sequence[str], length: int) -> DataFrame:
    """Sliding windows of `length` rows of a key, over any number of micro-batches: the state is the last length - 1
    rows.  Returns key, window_no, end_order (the first order column of the last row) and total of the values."""
    width = len(order) + len(values)

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        number, tail = state.get if state.exists else (0, [])
        kept = [tail[i : i + width] for i in range(0, len(tail), width)]
        new = pd.concat(list(batches)).sort_values(list(order))
        every = kept + new[[*order, *values]].astype(float).to_numpy().tolist()
        out = []
        for end in range(max(length, len(kept) + 1), len(every) + 1):
            part = every[end - length : end]
            out.append((group[0], number, part[-1][0], sum(sum(r[len(order) :]) for r in part)))
            number += 1
        rest = every[-(length - 1) :] if length > 1 else []
        state.update((number, [x for r in rest for x in r]))
        yield pd.DataFrame(out, columns=[key, "window_no", "end_order", "total"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, *order, *values).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, window_no bigint, end_order double, total double", "number bigint, tail array<double>", "append", GroupStateTimeout.NoTimeout)


def first_touch(spark: SparkSession, stream: DataFrame, key: str, time: str, name: str) -> DataFrame:
    """An append-only contact log, and the first time that each key is in it.  A batch that runs again overwrites
    its own part, so a contact is logged once."""
    log = f"{shared_dir(spark)}/contacts-{name}-{pd.Timestamp.now().value}"

    def append(df: DataFrame, batch: int) -> None:
        df.select(key, time).write.mode("overwrite").parquet(f"{log}/batch={batch}")

    run_available(stream, name, each=append)
    return spark.read.parquet(log).groupBy(key).agg(F.min(time).alias("first_time"), F.count("*").alias("n_contacts"))
