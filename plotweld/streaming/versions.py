"""Versions of parcels from review events, by the state machine: as a table and as a stream, with the same rows.

An event asks for a status. It is accepted if the machine allows the step from the parcel's present status and the asker may take
it (an AI service may neither approve nor publish); an accepted event makes the next version. Events have event_id, parcel_id,
ts, requested and role.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import TRANSITIONS

START = "OBSERVED"
RESERVED = ("APPROVED", "PUBLISHED")
ROWS = "parcel_id string, event_id bigint, requested string, status string, version bigint, accepted boolean"


def governed(events: DataFrame) -> DataFrame:
    """Every event with the parcel's status and version after it, events in the order of time and id; repeated ids count once.

    A parcel's history is folded in one pass of its sorted events; null requests are never allowed.
    """
    allowed = F.create_map(*chain(*((F.lit(a), F.array(*map(F.lit, b))) for a, b in TRANSITIONS.items())))
    once = events.groupBy("parcel_id", "event_id").agg(F.min(F.struct("ts", "requested", "role")).alias("e")).select("parcel_id", "event_id", "e.*")
    sorted_ = once.groupBy("parcel_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "requested", "role"))).alias("events"))
    kind = "array<struct<event_id: bigint, requested: string, status: string, version: bigint, accepted: boolean>>"

    def step(rows, e):
        last = F.try_element_at(rows, F.lit(-1))
        before = F.coalesce(last["status"], F.lit(START))
        steps = F.coalesce(F.try_element_at(allowed, before), F.array().cast("array<string>"))
        barred = F.coalesce((e["role"] == "AI_SERVICE") & e["requested"].isin(*RESERVED), F.lit(False))
        may = F.coalesce(F.array_contains(steps, e["requested"]), F.lit(False)) & ~barred
        version = F.coalesce(last["version"], F.lit(0).cast("bigint")) + may.cast("bigint")
        row = F.struct(e["event_id"].alias("event_id"), e["requested"].alias("requested"), F.when(may, e["requested"]).otherwise(before).alias("status"), version.alias("version"), may.alias("accepted"))
        return F.concat(rows, F.array(row)).cast(kind)

    rows = F.aggregate("events", F.array().cast(kind), step)
    return sorted_.select("parcel_id", F.explode(rows).alias("r")).select("parcel_id", "r.*")


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    status, version = state.get if state.exists else (START, 0)
    rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
    out = []
    for event, requested, role in zip(rows.event_id, rows.requested, rows.role, strict=True):
        may = requested in TRANSITIONS.get(status, ()) and not (role == "AI_SERVICE" and requested in RESERVED)
        if may:
            status, version = requested, version + 1
        out.append((key[0], event, requested, status, version, may))
    state.update((status, version))
    yield pd.DataFrame(out, columns=[c.split()[0] for c in ROWS.split(", ")])


def governed_stream(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """The same on a stream, in append mode: steps are checked and versions numbered as events arrive.

    Ids that repeat within the watermark count once; events behind the watermark are dropped. The state is a status and a number
    for each parcel, and the ids of the watermark's span.
    """
    known = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    return known.groupBy("parcel_id").applyInPandasWithState(_advance, ROWS, "status string, version bigint", "append", GroupStateTimeout.NoTimeout)
