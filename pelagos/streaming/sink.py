"""An append-only sink of events: each event is written once, whatever is replayed.

A batch is written over its own folder, so that a batch that is replayed after a failure replaces what it had written. An
event that is sent again within `late` is known by its key and left out; the state holds that span of keys and no more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter


def append_once(events: DataFrame, path: str, checkpoint: str, key: str = "event_id", ts: str = "ts", late: str = "1 day", write=None) -> DataStreamWriter:
    """A writer of a stream to Parquet folders `batch=N` under path; `write` takes (batch, folder) and must be safe to repeat."""
    once = events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])
    put = write or (lambda batch, folder: batch.write.mode("overwrite").parquet(folder))
    return once.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(lambda batch, n: put(batch, f"{path}/batch={n}"))


#: Signs that stay as they are in a web address, by their codes.
PLAIN = {"+": "%20", "%21": "!", "%27": "'", "%28": "(", "%29": ")", "%7E": "~"}


def encoded(text: Column) -> Column:
    """A text as a part of a web address."""
    out = F.url_encode(text)
    for a, b in PLAIN.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def event_line(event: Column, page: Column, source: Column, team: Column, extra: dict[str, Column]) -> Column:
    """An event as one line of keys and values; extra ones that are null are left out."""
    pair = lambda k, v: F.concat(F.lit(f"{k}="), encoded(v))
    more = [F.when(v.isNotNull(), pair(k, v.cast("string"))) for k, v in extra.items()]
    return F.concat_ws("&", pair("e", event), pair("p", page), pair("s", source), F.when(team, F.lit("t=1")), *more)
