"""Mate pairing over a stream of reads in order of place: the place plays the part of event time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from helixframe.operators.reads import PAIRED, has
from helixframe.streaming.depth import event_time


def stream_seconds(reads: DataFrame, slack: int = 1_000) -> DataFrame:
    """reads (ord, qname, flag, tid, pos, mtid, mpos, alen), a stream in order of place -> unpaired reads, and second reads whose first came before.

    A pair's two places and name are the key. Its state says whether a first read waits and that reads were seen; a second read
    consumes it, and once the stream is slack bases past the pair's later place a first read that still waits is
    evicted. A read at its mate's place is first if no read of the pair came before.
    """
    low, high = F.least("pos", "mpos").alias("_a"), F.greatest("pos", "mpos").alias("_b")
    names = ["ord", "qname", "flag", "tid", "pos", "mtid", "mpos", "alen"]
    kinds = {f.name: f.dataType.simpleString() for f in reads.schema.fields}
    schema = ", ".join(f"{n} {kinds[n]}" for n in names)
    single = reads.filter(~has(PAIRED)).select(*names)
    paired = reads.filter(has(PAIRED)).select(*names, low, high).withColumn("at", event_time("pos")).withWatermark("at", f"{slack} seconds")

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values("ord", ignore_index=True)
        seen, keep = state.exists, []
        waiting = bool(seen and state.get[0])
        for i, r in enumerate(rows.itertuples()):
            if r.pos < r.mpos or (r.pos == r.mpos and not seen):
                waiting = True
            else:
                if waiting:
                    keep.append(i)
                waiting = False
            seen = True
        state.update((waiting,))
        state.setTimeoutTimestamp(max((int(key[4]) + slack) * 1000, state.getCurrentWatermarkMs() + 1))
        yield rows.loc[keep, names]

    seconds = paired.groupBy("qname", "tid", "mtid", "_a", "_b").applyInPandasWithState(run, schema, "waiting boolean", "append", GroupStateTimeout.EventTimeTimeout)
    return single.unionByName(seconds)
