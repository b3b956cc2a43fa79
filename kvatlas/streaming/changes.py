"""New, changed and removed pages, from observations of a crawl: title, at (a timestamp), digest of the content.

A page is new when it is seen for the first time, or again after it was removed; changed when its digest isn't that of the sight before;
and removed when it isn't seen for ``gone_after``, at the time when that is over. ``observed_changes`` says so for a table
and ``changes`` for a stream, where each title keeps its last sight as state, with a timer for its removal.

Late sights: on a stream, one that is older than the title's last is left out, whatever the watermark still lets in; a table is in
order of time. Sights of one title at one time count in order of digest. Rows without title or time are left out, and a
null digest is a value of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

CHANGE = "title string, change string, at timestamp"


def _sights(observations: DataFrame) -> DataFrame:
    return observations.where("title is not null and at is not null").select("title", "at", F.coalesce("digest", F.lit("null")).alias("digest"))


def observed_changes(observations: DataFrame, gone_after: timedelta, until) -> DataFrame:
    """title, change, at of a table of observations; ``until`` is the time up to which removals are known."""
    own = Window.partitionBy("title").orderBy("at", "digest")
    gone = F.make_dt_interval(secs=F.lit(gone_after.total_seconds()))
    rows = _sights(observations).select("title", "at", "digest", *[F.lag(c).over(own).alias(f"{c}_before") for c in ("at", "digest")], F.lead("at").over(own).alias("next"))
    apart = lambda a, b: F.col(a) + gone < F.col(b)
    change = F.when(F.col("at_before").isNull() | apart("at_before", "at"), "new").when(F.col("digest") != F.col("digest_before"), "changed")
    over = F.when(F.col("next").isNull(), F.col("at") + gone < F.lit(until)).otherwise(apart("at", "next"))
    seen = rows.select("title", change.alias("change"), "at").where("change is not null")
    return seen.unionByName(rows.where(over).select("title", F.lit("removed").alias("change"), (F.col("at") + gone).alias("at")))


def changes(observations: DataFrame, gone_after: timedelta, late: str = "10 minutes") -> DataFrame:
    """title, change, at of a stream of observations, in append mode. A removal comes once the watermark is past it."""
    wait = pd.Timedelta(gone_after)

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (title,) = key
        out: list[tuple] = []
        if state.hasTimedOut:
            last, _ = state.get
            out.append((title, "removed", pd.Timestamp(last, unit="us") + wait))
            state.remove()
        else:
            last, digest = state.get if state.exists else (None, None)
            last = None if last is None else pd.Timestamp(last, unit="us")
            rows = pd.concat(list(batches)).sort_values(["at", "digest"])
            for at, own in zip(rows["at"], rows["digest"], strict=True):
                if last is not None and at < last:
                    continue
                if last is not None and at - last > wait:
                    out.append((title, "removed", last + wait))
                    last = None
                if last is None or own != digest:
                    out.append((title, "new" if last is None else "changed", at))
                last, digest = at, own
            micros = int(last.as_unit("us").asm8.view("i8"))
            state.update((micros, digest))
            due = int(micros // 1000 + wait / pd.Timedelta("1ms"))
            state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["title", "change", "at"]).astype({"at": "datetime64[us]"})

    rows = _sights(observations.withWatermark("at", late))
    return rows.groupBy("title").applyInPandasWithState(follow, CHANGE, "at long, digest string", "append", GroupStateTimeout.EventTimeTimeout)
