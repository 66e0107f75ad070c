"""Responses that arrive late and out of order, put back into articles.

Requests (an article's sections) and responses (the texts for them) come as one
stream in any order. The state of an article, kept in the state store by its
key, is what has arrived of it. An article is emitted as soon as all its sections
have a response, or when the event-time watermark passes its deadline, then
with empty texts for what is missing; its state is dropped. What arrives later
for an emitted article would begin it anew, so responses should not come twice:
of equal (article, position) the first response in a state counts.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: a stream's rows: ``n`` is the article's number of sections (requests), ``text`` the response
EVENT = "page_id bigint, kind string, idx bigint, n bigint, section string, text string, at timestamp"
_STATE = "n bigint, request_at array<bigint>, sections array<string>, response_at array<bigint>, texts array<string>"
_OUT = "page_id bigint, sections array<string>, texts array<string>, missing bigint, timed_out boolean"


def _article(page_id: int, state: tuple, timed_out: bool) -> pd.DataFrame:
    n, request_at, sections, response_at, texts = state
    names, found = dict(zip(request_at, sections)), dict(zip(response_at, texts))
    places = sorted(names) if names else sorted(found)
    return pd.DataFrame({"page_id": [page_id], "sections": [[names.get(i) for i in places]], "texts": [[found.get(i) or "" for i in places]],
                         "missing": [sum(i not in found for i in places) + max(0, (n or 0) - len(places))], "timed_out": [timed_out]})


def _collect(wait_ms: int):
    def step(key, batches: Iterator[pd.DataFrame], state: GroupState):
        got = state.get if state.exists else (None, [], [], [], [])
        if state.hasTimedOut:
            state.remove()
            yield _article(key[0], got, True)
            return
        n, *lists = got
        request_at, sections, response_at, texts = map(list, lists)
        latest = 0
        for b in batches:
            for kind, idx, count, section, text, at in zip(b["kind"], b["idx"], b["n"], b["section"], b["text"], b["at"]):
                latest = max(latest, int(at.timestamp() * 1000))
                places, values, value = (request_at, sections, section) if kind == "request" else (response_at, texts, text)
                if kind == "request":
                    n = int(count)
                if idx not in places:
                    places.append(int(idx))
                    values.append(value)
        got = (n, request_at, sections, response_at, texts)
        if n is not None and len(request_at) >= n and set(request_at) <= set(response_at):
            if state.exists:
                state.remove()
            yield _article(key[0], got, False)
            return
        state.update(got)
        state.setTimeoutTimestamp(max(latest + wait_ms, state.getCurrentWatermarkMs() + 1))

    return step


def regroup_stream(events: DataFrame, wait: str = "1 hour", late: str = "0 seconds") -> DataFrame:
    """``page_id, sections, texts, missing, timed_out`` of every article of the stream
    ``events`` (columns ``EVENT``), in the sections' order. An article waits for ``wait``
    of event time after its last event; ``late`` delays the watermark."""
    ms = int(pd.Timedelta(wait) / datetime.timedelta(milliseconds=1))
    return (events.withWatermark("at", late).groupBy("page_id")
            .applyInPandasWithState(_collect(ms), _OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout))


def regroup_batch(events: DataFrame) -> DataFrame:
    """The same rows from a finished stream's events as a batch; every article that is
    not whole has timed out. (The group is one article.)"""
    asked = events.filter("kind = 'request'").select("page_id", "idx", "section", "n").dropDuplicates(["page_id", "idx"])
    answers = events.filter("kind = 'response'").groupBy("page_id", "idx").agg(F.min_by("text", "at").alias("text"))
    both = asked.join(answers.withColumn("answered", F.lit(1)), ["page_id", "idx"], "left")
    per = both.groupBy("page_id").agg(
        F.sort_array(F.collect_list(F.struct("idx", "section", F.coalesce("text", F.lit("")).alias("text")))).alias("s"),
        F.sum(F.when(F.col("answered").isNull(), 1).otherwise(0)).cast("bigint").alias("missing"))
    return per.select("page_id", F.transform("s", lambda x: x["section"]).alias("sections"),
                      F.transform("s", lambda x: x["text"]).alias("texts"), "missing", (F.col("missing") > 0).alias("timed_out"))
