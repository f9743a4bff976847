"""The same operators on streams: deduplication, windows, alerts and rule scans with bounded state."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.plan import scratch
from ..operators import rules
from ..operators.web import parse_access


@contextmanager
def using(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting for as long as a block runs."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def drain(stream: DataFrame, mode: str = "append", at: str | None = None) -> DataFrame:
    """Runs a stream over what is there and gives what it wrote, from the folder that spark.checkpoint.dir names, or from
    ``at``, where a stream that was stopped goes on."""
    spark = stream.sparkSession
    at = at or f"{scratch(spark)}/stream-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the given folder as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def stream_in_steps(rows: DataFrame, step: str, steps: int) -> DataFrame:
    """``rows`` as a stream of ``steps`` files, one for each value (0 .. steps - 1) of column ``step`` and in their order,
    each a batch of its own; rows of a file are in order of ``ts``."""
    spark = rows.sparkSession
    at = f"{scratch(spark)}/steps-{uuid.uuid4().hex}"
    for k in range(steps):
        rows.where(F.col(step) == k).repartition(1).sortWithinPartitions("ts").write.mode("append").parquet(at)  # one file a batch
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(at)


def dedupe(events: DataFrame, keys: list[str], time: str = "ts", within: str = "1 hour") -> DataFrame:
    """The first of events alike in ``keys`` that come within ``within`` of each other; state is bounded by that time."""
    return events.withWatermark(time, within).dropDuplicatesWithinWatermark(keys)


def web_windows(requests: DataFrame, late: str = "10 minutes", length: str = "1 hour", slide: str | None = None, fail_least: int = 20, fail_share: float = 0.10, missing_least: int = 50, missing_share: float = 0.25) -> DataFrame:
    """Of each source and window: requests, failures, missing pages, flags; needs ts, ip, status."""
    span = F.window("ts", length, slide) if slide else F.window("ts", length)
    fails = F.count_if(F.col("status").isin("401", "403"))
    got = requests.withWatermark("ts", late).groupBy(span.alias("w"), "ip").agg(F.count("*").alias("requests"), fails.alias("failed"), F.count_if(F.col("status") == "404").alias("missing"))
    flags = F.array_compact(
        F.array(
            F.when((F.col("failed") >= fail_least) & (F.col("failed") >= F.col("requests") * fail_share), F.lit("auth-fail")),
            F.when(((F.col("missing") >= missing_least) & (F.col("missing") >= F.col("requests") * missing_share)) | ((F.col("requests") >= 30) & (F.col("missing") > F.col("requests") * 0.5)), F.lit("scan")),
        )
    )
    return got.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "ip", "requests", "failed", "missing", flags.alias("flags"))


def web_sessions(requests: DataFrame, late: str = "10 minutes", gap: str = "30 minutes") -> DataFrame:
    """Requests of a source without a longer pause than ``gap``."""
    got = requests.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "ip").agg(F.count("*").alias("requests"))
    return got.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "ip", "requests")


def _counted(batches: Iterator) -> tuple:
    """The times of one key's rows in order, in microseconds, and how many failed and passed at each. Equal times count
    together, so many repeats stay small."""
    import numpy as np

    ats, bads, goods = [], [], []
    for batch in batches:
        at, of = np.unique(batch["ts"].to_numpy().astype("datetime64[us]").astype("int64"), return_inverse=True)
        ok = batch["ok"].to_numpy().astype(bool)
        ats.append(at)
        goods.append(np.bincount(of[ok], minlength=len(at)))
        bads.append(np.bincount(of[~ok], minlength=len(at)))
    if len(ats) == 1:
        return ats[0], bads[0], goods[0]
    at, of = np.unique(np.concatenate(ats), return_inverse=True)
    failed, passed = np.zeros(len(at), "int64"), np.zeros(len(at), "int64")
    np.add.at(failed, of, np.concatenate(bads))
    np.add.at(passed, of, np.concatenate(goods))
    return at, failed, passed


def brute_force_alerts(auth: DataFrame, least: int = 5, forget: str = "1 day") -> DataFrame:
    """An alert for each success of an account from a source with at least ``least`` failures before, those of the same
    time included; a pair is forgotten after ``forget`` without events. Needs ts, src, dst, user, ok."""
    ms = int(forget.split()[0]) * {"minute": 60_000, "hour": 3_600_000, "day": 86_400_000}[forget.split()[1].rstrip("s")]

    def follow(key: tuple, batches: Iterator, state: GroupState) -> Iterator:
        import numpy as np
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        fails = state.get[0] if state.exists else 0
        at, failed, passed = _counted(batches)
        so_far = fails + np.cumsum(failed)
        state.update((int(so_far[-1]),))
        state.setTimeoutTimestamp(max(int(at[-1]) // 1000, state.getCurrentWatermarkMs()) + ms)
        times = np.where(so_far >= least, passed, 0)
        if times.any():
            yield pd.DataFrame({"src": key[0], "dst": key[1], "user": key[2], "ts": np.repeat(at, times).astype("datetime64[us]"), "failures": np.repeat(so_far, times)})

    return auth.withWatermark("ts", "10 minutes").groupBy("src", "dst", "user").applyInPandasWithState(follow, "src string, dst string, user string, ts timestamp, failures long", "fails long", "append", GroupStateTimeout.EventTimeTimeout)


#: State of ``ordered_brute_force``, by time in microseconds: events that wait for the watermark, and what is known before them.
_WAITING, _KNOWN = "at long, failed long, passed long", "failed long, last long"


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no copy of this module


_ALERT = ["src", "dst", "user", "ts", "failures"]


def _alerts(frame: object) -> object:
    """Text as plain objects: columns that pandas keeps in pieces can't be written as members of one."""
    return frame.astype({"src": object, "dst": object, "user": object, "ts": "datetime64[us]", "failures": "int64"})


class _Guesses(StatefulProcessor):
    """Failures and successes of one account and source, taken in the order of their times once the watermark has passed
    them, whatever the order in which they came."""

    def __init__(self, least: int, forget_ms: int) -> None:
        self.least, self.forget = least, forget_ms * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _WAITING)
        self.known = handle.getValueState("known", _KNOWN)

    def _wake(self, at: int) -> None:
        self.handle.registerTimer(at // 1000 + 1)

    def handleInputRows(self, key: tuple, rows: Iterator, timerValues: object) -> Iterator:  # noqa: N802, N803
        # one call of the state store for all times of a key in a batch
        at, failed, passed = (x.tolist() for x in _counted(rows))
        self.waiting.appendList(list(zip(at, failed, passed, strict=True)))
        self._wake(at[0])
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator:  # noqa: N802, N803
        import pandas as pd

        now = timerValues.getCurrentWatermarkInMs() * 1000
        held = {}
        for at, bad, good in self.waiting.get():
            before = held.get(at, (0, 0))
            held[at] = (before[0] + bad, before[1] + good)
        due = sorted(at for at in held if at < now)
        failed, last = self.known.get() or (0, None)
        out = []
        for at in due:
            bad, good = held.pop(at)
            if last is not None and at - last > self.forget:
                failed = 0
            failed, last = failed + bad, at
            if failed >= self.least:
                out += [(*key, pd.Timestamp(at, unit="us"), failed)] * good
        if due:
            self.known.update((failed, last))
            if held:
                self.waiting.put([(at, *n) for at, n in held.items()])
            else:
                self.waiting.clear()
        if held:
            self._wake(min(held))
        elif last is not None and last + self.forget < now:
            self.known.clear()
        elif last is not None:
            self._wake(last + self.forget)
        return iter([_alerts(pd.DataFrame(out, columns=_ALERT))] if out else ())

    def close(self) -> None:
        pass


#: Setting and value that streams with ``ordered_brute_force`` need when they start.
ROCKSDB = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def ordered_brute_force(auth: DataFrame, least: int = 5, forget: str = "1 day", late: str = "10 minutes") -> DataFrame:
    """An alert for each success of an account from a source with at least ``least`` failures before, those of the same time
    included, since the pair was last silent for ``forget``. Needs ts, src, dst, user, ok.

    Events wait until the watermark has passed them and are then taken in order, so alerts are the same in whatever order
    events come within ``late``; later ones are left out. What is known of a silent pair is dropped by a timer. The state
    store has to be RocksDB (``ROCKSDB``); state and timers survive a restart from the checkpoint.
    """
    ms = int(forget.split()[0]) * {"minute": 60_000, "hour": 3_600_000, "day": 86_400_000}[forget.split()[1].rstrip("s")]
    return auth.withWatermark("ts", late).groupBy("src", "dst", "user").transformWithStateInPandas(_Guesses(least, ms), "src string, dst string, user string, ts timestamp, failures long", "append", "eventTime")


def pivot_alerts(arrivals: DataFrame, departures: DataFrame, window: str = "12 hours", late: str = "10 minutes") -> DataFrame:
    """Sessions onto a host followed by something leaving it elsewhere, by the same account: (user, x, b, y, t_in, t_out).
    Needs (x, b, user, t_in) and (b, y, user, t_out)."""
    a = arrivals.withWatermark("t_in", late).alias("a")
    d = departures.withWatermark("t_out", late).alias("d")
    near = F.expr(f"a.b = d.b AND a.user = d.user AND a.x <> d.y AND d.t_out >= a.t_in AND d.t_out <= a.t_in + INTERVAL {window}")
    return a.join(d, near).select("a.user", "a.x", "a.b", "d.y", "a.t_in", "d.t_out")


def rule_alerts(rows: DataFrame, wanted: list[rules.Rule]) -> DataFrame:
    """Rows that rules match, as they come; stateless."""
    return rules.scan(rows, wanted)


def reread_rule_alerts(rows: DataFrame, rules_path: str, out: str, checkpoint: str) -> DataStreamWriter:
    """A writer of what rules match in each batch of a stream, with the rules read anew for every batch from text files at
    ``rules_path`` (``rules.read_rules``), so that a rule added while the stream runs counts from the next batch on.

    A batch is written to a folder of its own in ``out``, which a batch that is run again overwrites, so it adds no rows
    twice; ``alerts`` reads them. Rules are tried as in ``rules.scan``; a batch without hits leaves an empty folder.
    """

    def write(batch: DataFrame, number: int) -> None:
        known = rules.read_rules(batch.sparkSession, rules_path)
        rules.scan(batch, known).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def alerts(spark: SparkSession, out: str) -> DataFrame:
    """All rows that ``reread_rule_alerts`` has written, with the number of their ``batch``."""
    return spark.read.parquet(out)


def access_stream(spark: SparkSession, folder: str, glob: str = "*access*") -> DataFrame:
    """Requests of access logs as their files appear."""
    lines = spark.readStream.option("pathGlobFilter", glob).text(folder)
    return parse_access(lines.select(F.lit("").alias("host"), F.col("_metadata.file_path").alias("path"), F.col("value").alias("line")))
