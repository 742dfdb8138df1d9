"""Incremental jobs: new files into a catalog, arriving items against it, frames with state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from twinsift.operators.catalog import append_ids
from twinsift.operators.similar import search
from twinsift.sources.features import FrameWindow

FILES = "path string, modificationTime timestamp, length long, content binary"


def watch_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Stream of new files under a folder."""
    return spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)


def ingest(files: DataFrame, catalog_path: str, checkpoint: str, features: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Adds each batch's new paths to a catalog table with ids that follow its largest.

    ``features`` turns a batch of files into catalog rows ``(path, ...)``. A batch that is run again after a
    failure finds its paths in the catalog and adds nothing twice.
    """

    def add(batch: DataFrame, number: int) -> None:
        rows = features(batch)
        try:
            known = batch.sparkSession.read.parquet(catalog_path)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            known = batch.sparkSession.createDataFrame([], "id long, path string")
        append_ids(known, rows).write.mode("append").parquet(catalog_path)

    return files.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def match_arrivals(arrivals: DataFrame, catalog: DataFrame, weeds: DataFrame, out_path: str, checkpoint: str, threshold: int = 5) -> StreamingQuery:
    """Holds each batch of ``arrivals(needle, hash, md5)`` against the catalog: weed flag and near items.

    Writes ``(needle, is_weed, media_id, score)``; items without a match have one row with nulls. Output folders
    are named by batch, so a batch that runs again replaces its own.
    """

    def run(batch: DataFrame, number: int) -> None:
        live = weeds.join(catalog.select(F.col("md5").alias("orig_md5")), "orig_md5", "left_semi").select(F.col("weed_md5").alias("md5"), F.lit(True).alias("w")).distinct()
        found = search(batch, catalog, threshold)
        rows = batch.join(live, "md5", "left").select("needle", F.coalesce("w", F.lit(False)).alias("is_weed")).join(found, "needle", "left")
        rows.write.mode("overwrite").parquet(f"{out_path}/batch={number}")

    return arrivals.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def compress_stream(frames: DataFrame, threshold: int = 8) -> DataFrame:
    """Stream of kept frames of ``frames(media_id, frame, hash, last)``; state is a video's window of hashes.

    A frame is emitted when it is kept; one marked ``last`` is emitted always and ends the video's state.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        window, started = ([int(x) for x in state.get[0]], True) if state.exists else ([], False)
        own = FrameWindow(threshold, window, started)
        rows = pd.concat(list(batches)).sort_values("frame")
        kept = [own.keep(int(h)) or bool(last) for h, last in zip(rows["hash"], rows["last"])]
        if rows["last"].any():
            if state.exists:
                state.remove()
        else:
            state.update(([str(x) for x in own.window],))
        yield rows.loc[kept, ["media_id", "frame", "hash"]]

    return frames.groupBy("media_id").applyInPandasWithState(
        step, "media_id long, frame int, hash long", "window array<string>", "append", GroupStateTimeout.NoTimeout
    )


class Videos(StatefulProcessor):
    """State of each video: the hashes since the last kept frame, and the latest frame with its end of silence."""

    def __init__(self, threshold: int, silence: int):
        self.threshold, self.silence = threshold, silence

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getListState("window", "hash long")
        self.latest = handle.getValueState("latest", "frame int, hash long, kept boolean, ends long")

    def _forget(self) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)

    def _out(self, key: tuple, rows: list[tuple[int, int]]) -> pd.DataFrame:
        return pd.DataFrame({"media_id": [key[0]] * len(rows), "frame": [r[0] for r in rows], "hash": [r[1] for r in rows]}).astype({"media_id": "int64", "frame": "int32", "hash": "int64"})

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues: TimerValues) -> None:
        row = initialState.sort_values("last_frame").iloc[-1]
        self.window.put([(int(row["last_hash"]),)])
        self.latest.update((int(row["last_frame"]), int(row["last_hash"]), True, 0))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values(["ts", "frame"])
        started = self.latest.exists()
        frame, value, known, ends = self.latest.get() if started else (-1, 0, True, 0)
        seen = [int(h) for (h,) in self.window.get()] if started else []
        own, kept = FrameWindow(self.threshold, seen, started), []
        for r in new.itertuples(index=False):
            at = int(r.ts.timestamp() * 1000)
            if started and 0 < ends < at:  # the video had ended, though its timer has not come yet
                if not known:
                    kept.append((frame, value))
                own, started = FrameWindow(self.threshold), False
            if started and r.frame <= frame:
                continue
            frame, value, started = int(r.frame), int(r.hash), True
            known = own.keep(value)
            if known:
                kept.append((frame, value))
            ends = max(ends, at + self.silence)
        if started:
            self.window.put([(h,) for h in own.window]) if own.window else self.window.clear()
            self.latest.update((frame, value, known, ends))
            self._forget()
            self.handle.registerTimer(ends)
        yield self._out(key, kept)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        frame, value, known, _ = self.latest.get()
        self.window.clear()
        self.latest.clear()
        yield self._out(key, [] if known else [(frame, value)])

    def close(self) -> None:
        pass


def follow_videos(frames: DataFrame, threshold: int = 8, silence: int = 60, stored: DataFrame | None = None) -> DataFrame:
    """Stream of kept frames of ``frames(media_id, frame, hash, ts)``, which needs a watermark on ``ts``.

    A video ends when the watermark, or a frame of its own, is ``silence`` seconds past its latest frame: that frame is then
    emitted if it was not kept before, and the state goes; what comes later is a new video. ``stored(media_id, last_frame, last_hash)`` is the first state, as in
    :func:`twinsift.sources.features.compress_frames`: frames up to the last stored one are passed over. Frames are
    taken in the order of their times within a batch; one with a lower number than a frame before it is passed over too. A task holds one video's frames of one batch;
    set ``maxFilesPerTrigger`` at the source. Rows without an id, number, hash or time are left out. State is kept in RocksDB:
    set ``spark.sql.streaming.stateStore.providerClass``.
    """
    rows = frames.select("media_id", "frame", "hash", "ts").dropna()
    first = None if stored is None else stored.select("media_id", "last_frame", "last_hash").dropna().groupBy("media_id")
    return rows.groupBy("media_id").transformWithStateInPandas(
        Videos(threshold, 1000 * silence), "media_id long, frame int, hash long", "append", "EventTime", first
    )
