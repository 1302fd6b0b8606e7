"""Sliding-window rate limits and sessions, in batch and as streams."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def decide(times: list[int], window: int, most: int, kept: deque | None = None) -> tuple[list[bool], deque]:
    """Whether each of ascending ``times`` is accepted: fewer than ``most`` accepted ones are younger than
    ``window``. Rejected times aren't kept. ``kept``: accepted times before."""
    kept = deque() if kept is None else kept
    out = []
    for t in times:
        while kept and not t - kept[0] < window:
            kept.popleft()
        if ok := len(kept) < most:
            kept.append(t)
        out.append(ok)
    return out, kept


def rate_limit(requests: DataFrame, window_us: int, most: int) -> DataFrame:
    """``requests`` (key, at in microseconds, id) with accepted; each key's in order of (at, id).

    Decisions depend on each other, so a key is folded in one task, in Arrow batches of its sorted rows; a
    key's state is its accepted times within the window, at most ``most``.
    """
    kinds = {f.name: f.dataType.simpleString() for f in requests.schema}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, kept = None, deque()
        for frame in frames:
            out = []
            for k, own in frame.groupby("key", sort=False, dropna=False):
                if k != key and not (pd.isna(k) and pd.isna(key)):
                    key, kept = k, deque()
                ok, kept = decide(own["at"].tolist(), window_us, most, kept)
                out.append(own.assign(accepted=ok))
            if out:
                yield pd.concat(out)

    ordered = requests.select("key", "at", "id").repartition("key").sortWithinPartitions("key", "at", "id")
    return ordered.mapInPandas(run, f"key {kinds['key']}, at bigint, id {kinds['id']}, accepted boolean")


def rate_limit_stream(requests: DataFrame, window_us: int, most: int) -> DataFrame:
    """The same over a stream: a key's accepted times are its state, dropped when no request can need them."""

    def fold(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values(["at", "id"])
        before = deque(state.get[0]) if state.exists else deque()
        ok, kept = decide(rows["at"].tolist(), window_us, most, before)
        state.update((list(kept),))
        state.setTimeoutDuration(max(1000, 2 * window_us // 1000))
        yield rows.assign(key=key[0], accepted=ok)[["key", "at", "id", "accepted"]]

    kind = requests.schema["key"].dataType.simpleString()
    return requests.groupBy("key").applyInPandasWithState(fold, f"key {kind}, at bigint, id bigint, accepted boolean", "kept array<bigint>", "append", "ProcessingTimeTimeout")


# Logins of one address and what may be asked of any one, in a window of so many seconds.
LOGIN_WINDOW_SECONDS, LOGIN_MOST = 60, 10


def login_limit(attempts: DataFrame) -> DataFrame:
    """``rate_limit`` for attempts to log in, whose buckets are their own."""
    return rate_limit(attempts, LOGIN_WINDOW_SECONDS * 1_000_000, LOGIN_MOST)


def new_sessions(logins: DataFrame, hours: int) -> DataFrame:
    """``logins`` (token, username, at in seconds) with expires_at."""
    return logins.withColumn("expires_at", F.col("at") + hours * 3600)


def valid_sessions(sessions: DataFrame, users: DataFrame, now: float) -> DataFrame:
    """(token, username) of sessions of known users that expire after ``now``."""
    return sessions.filter(F.col("expires_at") > now).join(users.select("username"), "username", "left_semi").select("token", "username")


def purge(sessions: DataFrame, now: float) -> DataFrame:
    return sessions.filter(~(F.col("expires_at") <= now))


def replace_user(users: DataFrame, sessions: DataFrame, username: str, password_hash: str, now: float) -> tuple[DataFrame, DataFrame]:
    """Users with the new hash (the first created_at stays), and sessions without the user's."""
    spark = users.sparkSession
    new = spark.createDataFrame([(username, password_hash, now)], "username string, password_hash string, now double")
    both = users.join(new.select("username", F.col("password_hash").alias("h"), "now"), "username", "full_outer")
    merged = both.select("username", F.coalesce("h", "password_hash").alias("password_hash"), F.coalesce("created_at", "now").alias("created_at"))
    return merged, sessions.filter(F.col("username") != username)


def list_users(users: DataFrame) -> DataFrame:
    """(username, created_at) by name."""
    return users.select("username", "created_at").orderBy("username")


def delete_user(users: DataFrame, sessions: DataFrame, username: str) -> tuple[DataFrame, DataFrame]:
    return users.filter(F.col("username") != username), sessions.filter(F.col("username") != username)
