"""Structured Streaming jobs: conversation outcomes, windowed metrics, sessions, lockouts and a log-hit join."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from answerlens.functions import text as T
from answerlens.operators.conversations import FOLLOW_UPS, REPHRASED

OUTCOME = "id long, session_id long, follow_up_type string, was_rephrased boolean, changed_topic boolean"
LOCK = "user_id long, seq long, event string"
#: The setting that ordered state needs, and its value.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _terms(text: str | None, drop: frozenset) -> set[str]:
    import re

    return {t for t in re.findall("[a-z0-9]+", (text or "").lower()) if len(t) >= 2 and t not in drop}


def judge(asked: str | None, said: str | None, words: dict[str, str] | None = None) -> tuple[str, bool, bool]:
    """(follow-up type, rephrased, changed topic) of a user turn after an answer to ``asked``."""
    drop = frozenset([*T.STOPWORDS, *T.TWO_LETTER_NOISE])
    a, b = _terms(asked, drop), _terms(said, drop)
    kind = next((k for k, line in (words or FOLLOW_UPS).items() if b & set(line.split())), None)
    again = bool(a and b) and round(len(a & b) / len(a | b), 9) > REPHRASED
    return kind or ("rephrase" if again else "new_topic"), again, kind is None and not again


class _Ordered(StatefulProcessor):
    """Rows of a key in the order of their event time: they wait until the watermark has passed them, then go one by one.

    ``step`` takes a row and the key's own state and gives what comes out; ``end`` is asked once the watermark is ``idle``
    past the last row, and the key's state goes.
    """

    rows = own = ""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.rows)
        self.kept = handle.getValueState("kept", "last long, " + self.own)

    def handleInputRows(self, key, rows, timerValues):
        for frame in rows:
            values = [tuple(None if pd.isna(x) else x for x in r) for r in self.taken(frame).itertuples(index=False)]
            self.waiting.appendList(values)
            for at in {r[0] for r in values}:
                self.handle.registerTimer(at)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = timerValues.getCurrentWatermarkInMs()
        waiting = sorted(self.waiting.get(), key=lambda r: (r[0], r[1]))
        due, rest = [r for r in waiting if r[0] <= now], [r for r in waiting if r[0] > now]
        kept = tuple(self.kept.get()) if self.kept.exists() else (None, *self.first)
        out, last, own = [], kept[0], kept[1:]
        for r in due:
            own = self.step(key, r, own, out)
            last = r[0]
        if due:
            self.waiting.put(rest) if rest else self.waiting.clear()
            self.kept.update((last, *own))
            self.handle.registerTimer(last + self.idle_ms)
        elif not rest and last is not None and now >= last + self.idle_ms:
            self.end(key, own, out)
            self.kept.clear()
        if out:
            yield pd.DataFrame(out, columns=self.columns)

    def close(self) -> None:
        pass


def _ms(c: pd.Series) -> pd.Series:
    return c.astype("datetime64[ms]").astype("int64")


class _Outcomes(_Ordered):
    rows, own, first = "at long, seq long, id long, role string, said string", "asked string, pending long", (None, -1)
    columns = ["id", "session_id", "follow_up_type", "was_rephrased", "changed_topic"]

    def __init__(self, idle_ms: int, words: dict[str, str] | None):
        super().__init__(idle_ms)
        self.words = words

    def taken(self, frame):
        return pd.DataFrame({"at": _ms(frame["created_at"]), "seq": frame["seq"], "id": frame["id"], "role": frame["role"], "said": frame["content_text"]})

    def step(self, key, row, own, out):
        (_, _, id_, role, said), (asked, pending) = row, own
        if role == "user":
            if pending >= 0:
                out.append((pending, key[0], *judge(asked, said, self.words)))
            return said, -1
        return asked, id_ if role == "assistant" else -1

    def end(self, key, own, out):
        if own[1] >= 0:
            out.append((own[1], key[0], "none", False, False))


def stream_outcomes(messages: DataFrame, *, words: dict[str, str] | None = None, late: str = "1 hour", idle_minutes: int = 60) -> DataFrame:
    """Outcome of each answer when the next user turn of its session is due, or 'none' when the session has been idle.

    Turns wait in state until the watermark has passed them and then go by time and seq, so micro-batches may bring them in
    any order within ``late``; the session's state goes ``idle_minutes`` after its last turn. Needs the RocksDB state store
    (STATE_STORE); run_available sets it.
    """
    m = messages.select(F.col("created_at").cast("timestamp").alias("created_at"), "id", "session_id", "seq", "role", "content_text").withWatermark("created_at", late)
    return m.groupBy("session_id").transformWithStateInPandas(_Outcomes(idle_minutes * 60_000, words), OUTCOME, "Append", "EventTime")


def stream_windows(logs: DataFrame, size: str = "1 day", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts, mean confidence and low-confidence count by tumbling or sliding window."""
    x = logs.withColumn("created_at", F.col("created_at").cast("timestamp")).withWatermark("created_at", late)
    w = F.window("created_at", size, slide) if slide else F.window("created_at", size)
    out = x.groupBy(w).agg(F.count("*").alias("n"), F.sum("confidence").alias("confidence_sum"), F.count_if("is_low_confidence").alias("low"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", F.round(F.col("confidence_sum") / F.col("n"), 6).alias("avg_confidence"), "low")


def stream_sessions(logs: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    x = logs.withColumn("created_at", F.col("created_at").cast("timestamp")).withWatermark("created_at", late)
    return x.groupBy(F.session_window("created_at", gap).alias("w"), "session_id").agg(F.count("*").alias("n")).select("session_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def lock_step(at: float, ok: bool, failures: int, until: float, *, most: int, minutes: int) -> tuple[str | None, int, float]:
    """The event of an attempt (at in seconds), and the counters after it."""
    if at < until:
        return "blocked", failures, until
    if ok:
        return None, 0, until
    if failures + 1 >= most:
        return "locked", failures + 1, at + minutes * 60
    return None, failures + 1, until


def lock_events(rows: pd.DataFrame, *, most: int = 8, minutes: int = 15, idle_minutes: int = 7 * 24 * 60) -> list[tuple]:
    """(seq, event) of one user's attempts (seq, at in seconds, ok), in their order.

    ``most`` failures in a row lock for ``minutes``; attempts while locked are blocked and don't count; a success resets.
    The count stays when a lock ends, so one more failure locks again. A user who was away for ``idle_minutes`` starts anew.
    """
    out, failures, until, last = [], 0, 0.0, None
    for r in rows.sort_values(["at", "seq"]).itertuples():
        if last is not None and r.at - last > idle_minutes * 60:
            failures, until = 0, 0.0
        event, failures, until = lock_step(r.at, r.ok, failures, until, most=most, minutes=minutes)
        last = r.at
        if event:
            out.append((r.seq, event))
    return out


class _Locks(_Ordered):
    rows, own, first = "at long, seq long, ok boolean", "failures int, until double", (0, 0.0)
    columns = ["user_id", "seq", "event"]

    def __init__(self, idle_ms: int, most: int, minutes: int):
        super().__init__(idle_ms)
        self.most, self.minutes = most, minutes

    def taken(self, frame):
        return pd.DataFrame({"at": _ms(frame["at"]), "seq": frame["seq"], "ok": frame["ok"]})

    def step(self, key, row, own, out):
        event, failures, until = lock_step(row[0] / 1000, bool(row[2]), *own, most=self.most, minutes=self.minutes)
        if event:
            out.append((key[0], row[1], event))
        return int(failures), float(until)

    def end(self, key, own, out):
        pass


def stream_lockouts(attempts: DataFrame, *, most: int = 8, minutes: int = 15, late: str = "1 hour", idle_minutes: int = 7 * 24 * 60) -> DataFrame:
    """(user_id, seq, event) of attempts (user_id, seq, at in seconds, ok): 'locked' and 'blocked'.

    Attempts wait until the watermark has passed them and go by time and seq, whatever micro-batch brings them within
    ``late``; milliseconds count. A user's counters go ``idle_minutes`` after the last attempt, so state follows the
    users of that time. ``idle_minutes`` is at least ``minutes``. Needs STATE_STORE, as stream_outcomes.
    """
    x = attempts.select("user_id", "seq", F.timestamp_millis(F.round(F.col("at") * 1000).cast("long")).alias("at"), "ok").withWatermark("at", late)
    return x.groupBy("user_id").transformWithStateInPandas(_Locks(max(idle_minutes, minutes) * 60_000, most, minutes), LOCK, "Append", "EventTime")


def batch_lockouts(attempts: DataFrame, *, most: int = 8, minutes: int = 15, idle_minutes: int = 7 * 24 * 60) -> DataFrame:
    """The same over a whole table; a user's attempts are one group, since a lock changes which later ones count."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        out = lock_events(rows, most=most, minutes=minutes, idle_minutes=max(idle_minutes, minutes))
        return pd.DataFrame([(rows["user_id"].iloc[0], s, e) for s, e in out], columns=["user_id", "seq", "event"])

    return attempts.groupBy("user_id").applyInPandas(fold, LOCK)


def stream_log_hits(logs: DataFrame, hits: DataFrame, late: str = "1 hour") -> DataFrame:
    """Logs (once per message_id) with their hits that arrive within ``late`` of them."""
    x = logs.withColumn("created_at", F.col("created_at").cast("timestamp")).withWatermark("created_at", late).dropDuplicatesWithinWatermark(["message_id"])
    h = hits.select(F.col("retrieval_log_id"), "lecture_chunk_id", "rank", F.col("hit_at").cast("timestamp").alias("hit_at")).withWatermark("hit_at", late)
    on = (F.col("id") == F.col("retrieval_log_id")) & F.col("hit_at").between(F.col("created_at"), F.col("created_at") + F.expr(f"INTERVAL {late}"))
    return x.select("id", "message_id", "created_at").join(h, on)


def run_available(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there, into a table of files under the checkpoint folder, and returns that table."""
    spark = stream.sparkSession
    out, old = f"{checkpoint}/{name}/out", spark.conf.get(STATE_STORE[0], None)
    spark.conf.set(*STATE_STORE)
    try:
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{checkpoint}/{name}/state").outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.set(STATE_STORE[0], old) if old else spark.conf.unset(STATE_STORE[0])
    return spark.read.schema(stream.schema).parquet(out)
