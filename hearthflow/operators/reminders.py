"""When each chunk of a key cut into chunks last alerted, in logarithmically many rounds.

Within a stretch of one danger level an alert is due at the first row at least `wait` after the
last one, so each alert fixes the next. A chunk that such a stretch covers from end to end cannot tell
its alerts without the last alert before it, but it can tell, for every row that might be its
first alert (those of its first `wait`, and the next one), which alert would then be its last. These
answers are links from one alert to the first alert of a later chunk. Doubling the links (the link of
the link) reaches every alert that is on the chain of the first one in as many rounds as the
number of chunks has bits, however long a danger lasts.

Links are rows of Spark tables, worked on by joins on chunk and alert. What reaches the driver is one
short record per chunk, at most rows / max_rows of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged
from .series import CHUNK, Series

DANGER_LEVEL = 2
_LINKS = "no bigint, entry bigint, leave bigint"


def last_alerts(at: np.ndarray, wait: int) -> np.ndarray:
    """For each row of an unbroken danger: the last alert if it is one."""
    n = len(at)
    due = np.searchsorted(at, at + wait, side="left")
    jump = np.where(due < n, due, np.arange(n))
    while True:
        further = jump[jump]
        if np.array_equal(further, jump):
            return at[jump]
        jump = further


def _links(series: Series, numbers: dict, levels: list[int], wait: int) -> DataFrame:
    """One row per chunk that knows its last alert (entry is null, leave too without one), and a row
    per possible first alert of every other chunk."""
    key = list(series.key)

    def answers(no: int, at: list[np.ndarray], whole: bool, level: int) -> dict:
        if level < DANGER_LEVEL:
            return {"no": [no], "entry": [None], "leave": [None]}
        times = np.concatenate(at)
        if not whole:  # the stretch begins in this chunk, with an alert
            return {"no": [no], "entry": [None], "leave": last_alerts(times, wait)[:1]}
        entry, first = np.unique(times, return_index=True)
        some = int(np.searchsorted(entry, entry[0] + wait, side="left")) + 1
        leave = last_alerts(times, wait)[first[:some]]
        return {"no": [no] * len(leave), "entry": entry[:some], "leave": leave}

    def rows(out: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(out[c], pa.int64()) for c in ("no", "entry", "leave")], ["no", "entry", "leave"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at, whole, level = None, [], False, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            times = batch.column(len(key) + 1).to_numpy()
            states = batch.column(len(key) + 2).to_numpy()
            tags = list(zip(*(batch.column(i).to_pylist() for i in range(len(key) + 1))))
            cuts = [i for i in range(1, len(tags)) if tags[i] != tags[i - 1]]
            for lo, hi in zip([0, *cuts], [*cuts, len(tags)]):
                no = numbers[tags[lo][:-1], tags[lo][-1]]
                if no != now:
                    if now is not None:
                        yield rows(answers(now, at, whole, level))
                    now, at, whole, level = no, [], levels[no] >= DANGER_LEVEL, levels[no]
                mine = states[lo:hi]
                new = np.flatnonzero(np.diff(mine, prepend=level))
                if len(new):  # only the last stretch matters at the end of the chunk
                    at, whole = [], False
                    lo += int(new[-1])
                at.append(times[lo:hi])
                level = int(mine[-1])
        if now is not None:
            yield rows(answers(now, at, whole, level))

    return series.df.select(*key, CHUNK, "at_us", "alert_level").mapInArrow(run, _LINKS)


def _next(asked: DataFrame, links: DataFrame, wait: int) -> DataFrame:
    """`asked` (no, leave, ...) with the first alert after it: to_no and to_entry, null if the danger
    ends before. Chunks shorter than `wait` are passed over, one step each."""
    names = asked.columns
    entries = links.select(
        F.col("no").alias("_at"), F.col("entry").alias("_due"), F.col("entry").alias("_entry")
    )
    found = None
    open_ = asked.withColumns({"_at": F.col("no") + 1, "_due": F.col("leave") + wait})
    while True:
        in_order = Window.partitionBy("_at").orderBy("_due", F.col("_entry").isNotNull())
        ahead = in_order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
        both = open_.unionByName(entries, allowMissingColumns=True)
        both = both.withColumns(
            {
                "to_entry": F.first("_entry", ignorenulls=True).over(ahead),
                "_any": F.max("_entry").over(Window.partitionBy("_at")),
            }
        ).where("_entry is null")
        both = staged(both.drop("_entry"), "reminders")
        over = F.col("to_entry").isNotNull() | F.col("_any").isNull()
        to_no = F.when(F.col("to_entry").isNotNull(), F.col("_at")).alias("to_no")
        done = both.where(over).select(*names, to_no, "to_entry")
        found = done if found is None else found.unionByName(done)
        open_ = both.where(~over).select(*names, (F.col("_at") + 1).alias("_at"), "_due")
        if open_.isEmpty():
            return found


def alert_starts(series: Series, wait: int, rounds: list | None = None) -> dict:
    """(level, last alert) before every (key, chunk). `rounds`, if given, gets the number of links
    after every round of doubling."""
    order = F.struct(*series.order)
    ends = series.df.groupBy(*series.key, CHUNK).agg(
        F.max_by("alert_level", order).alias("last"), F.max("at_us").alias("until")
    )
    found = sorted(
        ((tuple(r[k] for k in series.key), r[CHUNK], r["last"]) for r in ends.collect()),
        key=lambda r: (str(r[0]), r[1]),
    )
    numbers, levels = {}, []
    for no, (group, chunk, _) in enumerate(found):
        numbers[group, chunk] = no
        goes_on = no and found[no - 1][0] == group
        levels.append(found[no - 1][2] if goes_on else 0)

    every = staged(_links(series, numbers, levels, wait), "reminders")
    links, known = every.where("entry is not null"), every.where("entry is null")
    leaves = known.select("no", "leave")
    if not links.isEmpty():
        begin = _next(leaves.where("leave is not null"), links, wait)
        reached = begin.where("to_no is not null").select("to_no", "to_entry").distinct()
        reached = staged(reached.toDF("no", "entry"), "reminders")
        jumps = _next(links, links, wait).drop("leave").where("to_no is not null")
        jumps = staged(jumps, "reminders")
        while not jumps.isEmpty():
            if rounds is not None:
                rounds.append(jumps.count())
            more = reached.join(jumps, ["no", "entry"]).select("to_no", "to_entry")
            reached = staged(reached.union(more).distinct(), "reminders")
            onward = jumps.select(
                F.col("no").alias("to_no"), F.col("entry").alias("to_entry"),
                F.col("to_no").alias("_no"), F.col("to_entry").alias("_entry"),
            )
            jumps = jumps.join(onward, ["to_no", "to_entry"]).select(
                "no", "entry", F.col("_no").alias("to_no"), F.col("_entry").alias("to_entry")
            )
            jumps = staged(jumps, "reminders")
        leaves = leaves.unionByName(reached.join(links, ["no", "entry"]).select("no", "leave"))
    left = {r["no"]: r["leave"] for r in leaves.collect()}

    starts, last = {}, 0
    for no, (group, chunk, _) in enumerate(found):
        if not no or found[no - 1][0] != group:
            last = 0
        starts[group, chunk] = (levels[no], last if levels[no] >= DANGER_LEVEL else 0)
        last = left.get(no, last) or 0  # a chunk without an alert passes the last one on
    return starts
