"""T2 as a stream: which token mint a request's session comes from, once that is certain.

Mints and requests arrive as one stream of events in any order within ``delay``.  The state keeps each user's
latest mint behind the watermark, the mints ahead of it and the requests that still wait.  A request is answered
when the watermark has passed it, since no earlier mint can come any more; a timer at the oldest waiting request
wakes users without new events.  So a user's state is bounded by the events of the delay and one mint.

Users share states by a hash of the user, ``buckets`` in all: what a state function costs per call is paid per
bucket, and a bucket's events are sorted and answered as columns.  A state is one Arrow table.  The number of buckets
belongs to the checkpoint and must not change while one is in use.

* A mint at the very time of a request counts for it, and of tied mints it makes no difference which.
* Events behind the watermark are late: Spark drops them.  A late mint changes no answer given; a late request
  gets none, and :func:`unanswered` lists it.
* A request without a user waits alone under its own id and has no session; mints without a user are left out.
* A run over what is there ends with the watermark at the last event less the delay.  ``closing_event``, a row of
  no user with a later time, moves it past every request, so that all of them are answered.
"""

from __future__ import annotations

import datetime as dt
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from permgrid.functions.time import token_expiry
from permgrid.schemas import TOKEN_TTL_SECONDS

MINT, REQUEST, CLOSE = "mint", "request", "close"
BUCKETS = 1024
EVENTS = T.StructType([T.StructField("kind", T.StringType()), T.StructField("id", T.LongType()),
                       T.StructField("user_id", T.StringType()), T.StructField("ts", T.TimestampType())])
_STATE = "rows binary"
_ANSWER = "request_id long, user_id string, ts_us long, minted_us long"


def session_events(requests: DataFrame, mints: DataFrame) -> DataFrame:
    """Requests (request_id, user_id, ts) and mints (user_id, minted_at) as events."""
    ev = lambda df, kind, i, t: df.select(F.lit(kind).alias("kind"), F.col(i).cast("long").alias("id"), "user_id",
                                          F.col(t).cast("timestamp").alias("ts"))
    return ev(requests, REQUEST, "request_id", "ts").unionByName(
        ev(mints.withColumn("none", F.lit(None)), MINT, "none", "minted_at"))


def closing_event(spark: SparkSession, after: dt.datetime, delay: dt.timedelta) -> DataFrame:
    """One event that takes the watermark past ``after``."""
    return spark.createDataFrame([(CLOSE, None, None, after + delay + dt.timedelta(seconds=1))], EVENTS)


def _answers():
    """The state function; nested, so that Spark ships it by value."""

    def step(key, batches, state):
        import numpy as np
        import pandas as pd
        import pyarrow as pa
        schema = pa.schema([("asks", pa.bool_()), ("id", pa.int64()), ("user_id", pa.string()), ("us", pa.int64())])
        parts = [pa.ipc.open_stream(bytes(state.get[0])).read_all()] if state.exists else []
        if not state.hasTimedOut:
            for pdf in batches:
                pdf = pdf[pdf["kind"].isin(["mint", "request"])]
                rows = {"asks": pdf["kind"] == "request", "id": pdf["id"], "user_id": pdf["user_id"], "us": pdf["us"].astype("int64")}
                parts.append(pa.Table.from_pandas(pd.DataFrame(rows), schema, preserve_index=False))
        rows = pa.concat_tables([schema.empty_table(), *parts])
        asks, us = (rows[c].to_numpy() for c in ("asks", "us"))
        who = pd.factorize(rows["user_id"].to_pandas())[0]  # -1: no user
        order = np.lexsort((asks, us, who))  # a mint at the time of a request comes before it
        rows, asks, us, who = rows.take(order), asks[order], us[order], who[order]
        last = np.maximum.accumulate(np.where(asks, -1, np.arange(len(us))))  # the mint before, of this user or another
        has = (last >= 0) & (who >= 0) & (who[last] == who)
        passed = state.getCurrentWatermarkMs() * 1000  # events up to and with this are complete
        done, keep = asks & (us <= passed), us > passed
        behind = np.flatnonzero(~asks & ~keep)
        keep[behind[np.append(who[behind][1:] != who[behind][:-1], True)[:len(behind)]]] = True  # a user's latest mint
        if not keep.any():
            if state.exists:
                state.remove()
        else:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, schema) as w:
                w.write_table(rows.filter(pa.array(keep)))
            state.update((sink.getvalue().to_pybytes(),))
            waiting = us[asks & keep]
            if len(waiting):
                state.setTimeoutTimestamp(max(int(waiting.min()) // 1000, state.getCurrentWatermarkMs()) + 1)
        if done.any():
            out = rows.filter(pa.array(done))
            minted = pd.Series(us[last[done]], dtype="Int64").mask(~has[done])
            yield pd.DataFrame({"request_id": out["id"].to_pandas(), "user_id": out["user_id"].to_pandas().astype("object"),
                                "ts_us": out["us"].to_pandas(), "minted_us": minted})

    return step


def _ntz(us: str) -> Column:
    return F.timestamp_micros(us).cast("timestamp_ntz")


def answer_sessions(events: DataFrame, delay: str, ttl_seconds: int = TOKEN_TTL_SECONDS, buckets: int = BUCKETS) -> DataFrame:
    """Streaming ``events`` -> the columns of ``sessions.session_groups_asof``, each request once."""
    own = F.when(F.col("user_id").isNotNull(), F.concat(F.lit("u"), "user_id")).otherwise(F.concat_ws("", F.lit("n"), F.col("kind"), F.col("id").cast("string")))
    known = events.where(F.col("user_id").isNotNull() | (F.col("kind") != MINT))
    keyed = known.withWatermark("ts", delay).select(F.pmod(F.xxhash64(own), F.lit(buckets)).alias("key"), "kind", F.coalesce("id", F.lit(-1).cast("long")).alias("id"), "user_id",
                                                    "ts", F.unix_micros("ts").alias("us"))
    a = keyed.groupBy("key").applyInPandasWithState(_answers(), _ANSWER, _STATE, "append", "EventTimeTimeout")
    minted = _ntz("minted_us")
    a = a.select("request_id", "user_id", _ntz("ts_us").alias("ts"), minted.alias("minted_at"))
    expires = token_expiry("minted_at", ttl_seconds)
    return a.select("*", expires.alias("expires_at"), F.coalesce(F.col("ts") < expires, F.lit(False)).alias("session_valid"))


def run_available(spark: SparkSession, landing: str, out: str, delay: str, files_per_batch: int = 1000,
                  buckets: int = BUCKETS) -> DataFrame:
    """Works through the event files below ``landing`` that earlier runs have not seen; returns all answers so far.

    Answers are appended by Spark's file sink and the state lies in the checkpoint, both below ``out``; a run
    that is lost goes on where the last whole batch ended."""
    events = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).parquet(landing)
    answers = answer_sessions(events, delay, buckets=buckets)
    path = os.path.join(out, "answers")
    (answers.writeStream.format("parquet").outputMode("append").option("checkpointLocation", os.path.join(out, "_checkpoint"))
     .trigger(availableNow=True).start(path).awaitTermination())
    return spark.read.schema(answers.schema).parquet(path)


def unanswered(requests: DataFrame, answers: DataFrame) -> DataFrame:
    """Requests without an answer: still waiting, or too late to get one."""
    return requests.join(answers.select("request_id"), "request_id", "left_anti")
