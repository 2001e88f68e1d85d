"""Mixed timestamp formats and time zones, brought to one UTC instant.

Every text yields an array of readings (functions/date_text.py).  A Viterbi
pass over each source's records, in fetch order, chooses one reading per
record; it pays for readings that are unlikely by themselves or that the
source's declared order speaks against, for changing the format between
neighbours and for stepping back in time, the more the further.

The chain of a source is never cut.  A record with one reading fixes the path,
so what lies between two of them is settled on its own: windows of fetch time
are decoded in parallel, and only the records before the first and after the
last such record of a window are chained across windows in a second pass.
"""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.date_text import RULE_BREAK, readings
from ..session import cut

SWITCH_COST = 1.0
BACKWARD_COST = 0.5
HOUR_US = 3_600_000_000
TRACE_EVERY = 256
DEFAULT_WINDOW_DAYS = 7


class ChainDecoder:
    """Streaming Viterbi: rows go in, chosen reading indexes come out.

    Survivor paths are traced back every TRACE_EVERY rows and after every row
    with a single reading; rows on which all survivors agree are released, so
    memory does not grow with the chain although the result is exact."""

    def __init__(self):
        self.nodes: list = []
        self.back: list[list[int]] = []
        self.cost: list[float] = []

    @staticmethod
    def _step(a, b) -> float:
        cost = SWITCH_COST if a[1] != b[1] else 0.0
        if b[0] < a[0]:
            cost += BACKWARD_COST * math.log1p((a[0] - b[0]) / HOUR_US)
        return cost

    def push(self, tag, options) -> list:
        """Add a row with at least one option; return released (tag, choice)."""
        if not self.nodes:
            self.back.append([0] * len(options))
            self.cost = [o[2] for o in options]
        else:
            prev = self.nodes[-1][1]
            pointers, costs = [], []
            for o in options:
                best, at = min((c + self._step(p, o), i) for i, (p, c) in enumerate(zip(prev, self.cost)))
                pointers.append(at)
                costs.append(best + o[2])
            self.back.append(pointers)
            low = min(costs)
            self.cost = [c - low for c in costs]
        self.nodes.append((tag, options))
        if len(options) == 1 or len(self.nodes) % TRACE_EVERY == 0:
            return self._release()
        return []

    def _release(self) -> list:
        states = set(range(len(self.nodes[-1][1])))
        t = len(self.nodes) - 1
        while len(states) > 1 and t > 0:
            states = {self.back[t][s] for s in states}
            t -= 1
        if len(states) > 1:
            return []
        out, s = [], states.pop()
        last = t
        while t >= 0:
            out.append((self.nodes[t][0], s))
            s = self.back[t][s]
            t -= 1
        # the agreed node stays as the one state that the next row builds on
        keep = out[0][1]
        tag, options = self.nodes[last]
        if last == len(self.nodes) - 1:
            self.nodes = [(None, [options[keep]])]
            self.back = [[0]]
            self.cost = [0.0]
        else:
            self.nodes = [(None, [options[keep]])] + self.nodes[last + 1:]
            self.back = [[0], [0] * len(self.back[last + 1])] + self.back[last + 2:]
        return [x for x in reversed(out) if x[0] is not None]

    def finish(self) -> list:
        """Release what is left, along the cheapest path."""
        if not self.nodes:
            return []
        s = min(range(len(self.cost)), key=lambda i: (self.cost[i], i))
        out = []
        for t in range(len(self.nodes) - 1, -1, -1):
            out.append((self.nodes[t][0], s))
            s = self.back[t][s]
        self.__init__()
        return [x for x in reversed(out) if x[0] is not None]


def _config(text) -> tuple[str | None, str | None]:
    """(declared day-month order or None, zone or None)."""
    try:
        c = json.loads(text) if text else {}
    except ValueError:
        c = {}
    if not isinstance(c, dict):
        c = {}
    order, tz = c.get("date_order"), c.get("tz")
    return (order if order in ("dmy", "mdy") else None, tz if isinstance(tz, str) else None)


SETTLED, OPEN, ANCHOR = 0, 1, 2
_OUT = ["key", "kept", "source_id", "win", "seq", "role", "instants_us", "formats", "costs", "choice"]


def _as_frame(rows):
    out = pd.DataFrame(rows, columns=_OUT)
    out["choice"] = out["choice"].astype("Int64")
    return out.astype({"win": "int64", "seq": "int64", "role": "int32"})


class _Window:
    """Decodes the records of one (source, window) as far as they are settled."""

    def __init__(self, source, win):
        self.at = (source, win)
        self.decoder: ChainDecoder | None = None  # starts at the first record with one reading
        self.waiting: dict = {}
        self.seq = 0
        self.last = None

    def row(self, key, kept, seq, role, options, choice):
        return (key, kept, *self.at, seq, role, [o[0] for o in options], [o[1] for o in options], [float(o[2]) for o in options], choice)

    def anchor(self, seq, option):
        return self.row(None, None, seq, ANCHOR, [option], 0)

    def push(self, key, kept, options):
        self.seq += 1
        if not options:
            yield self.row(key, kept, self.seq, SETTLED, [], None)
            return
        if self.decoder is None:
            if len(options) > 1:
                yield self.row(key, kept, self.seq, OPEN, options, None)
                return
            self.decoder = ChainDecoder()
            yield self.anchor(self.seq, options[0])
        self.waiting[self.seq] = (key, kept, options)
        for seq, choice in self.decoder.push(self.seq, options):
            key, kept, options = self.waiting.pop(seq)
            self.last = (seq, options[choice])
            yield self.row(key, kept, seq, SETTLED, options, choice)

    def close(self):
        if self.last is not None:
            yield self.anchor(*self.last)
        for seq, (key, kept, options) in self.waiting.items():
            yield self.row(key, kept, seq, OPEN, options, None)


def _decode(batches):
    """Rows arrive sorted by (source, window, fetch, key); see normalise_instants."""
    window, configs = None, {}
    for pdf in batches:
        done: list = []
        for src, win, fetched, key, text, config, kept in zip(
            pdf["source_id"], pdf["win"], pdf["fetched_us"], pdf["key"], pdf["text"], pdf["config"], pdf["kept"]
        ):
            if window is None or window.at != (src, win):
                if window is not None:
                    done.extend(window.close())
                window = _Window(src, win)
            if config not in configs:
                if len(configs) > 5000:
                    configs.clear()
                configs[config] = _config(config)
            done.extend(window.push(key, kept, readings(text, None if pd.isna(fetched) else int(fetched), *configs[config])))
        yield _as_frame(done)
    if window is not None:
        yield _as_frame(list(window.close()))


def _stitch(batches):
    """Open records and anchors, sorted by (source, window, sequence)."""
    decoder, current, waiting, serial = ChainDecoder(), None, {}, 0

    def rows(released):
        for tag, choice in released:
            row = waiting.pop(tag)
            yield (*row[:5], SETTLED, *row[6:9], choice)

    for pdf in batches:
        done: list = []
        for row in pdf[_OUT].itertuples(index=False, name=None):
            if row[2] != current:
                done.extend(rows(decoder.finish()))
                current = row[2]
            options = list(zip((int(x) for x in row[6]), row[7], row[8]))
            tag = None
            if row[5] == OPEN:
                serial += 1
                tag = serial
                waiting[tag] = row
            done.extend(rows(decoder.push(tag, options)))
        yield _as_frame(done)
    yield _as_frame(list(rows(decoder.finish())))


def normalise_instants(
    records: DataFrame,
    key: str = "raw_id",
    text: str = "published_at_raw",
    source: str = "source_id",
    fetched: str = "fetched_at",
    config: str = "config",
    keep: str | None = None,
    window_days: int = DEFAULT_WINDOW_DAYS,
) -> DataFrame:
    """One row per record: all readings and the chosen one.

    Result columns: `key`, `keep` (if named), instants array<timestamp>,
    formats array<string>, instant timestamp, format string, by_rule boolean
    (whether the chosen reading follows the source's declared order).

    A chain is all of a source's records, ordered by (fetched, key).  Windows of
    `window_days` of fetch time are decoded in parallel, so that a source with a
    third of all rows is spread; `window_days` does not change the result.

    Defined cases: null, empty and unreadable texts give empty arrays and a null
    instant, never a dropped row; without a declared order both orders are
    readings and the chain decides, day-month being the likelier; without a zone
    a time is UTC; of two paths of one cost the one through earlier readings in
    the arrays wins; a null source is a source of its own; a null fetch time
    disables relative texts and the upper bound; repeated keys give repeated
    rows; other columns, whatever their names, are ignored."""
    kept = F.col(keep) if keep else F.lit(None).cast("string")
    kept_type = records.schema[keep].dataType if keep else T.StringType()
    key_type = records.schema[key].dataType
    fetched_us = F.unix_micros(F.col(fetched).cast("timestamp"))
    rows = records.select(
        F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source_id"),
        F.coalesce(F.floor(fetched_us / (86_400_000_000 * window_days)), F.lit(-1)).alias("win"),
        fetched_us.alias("fetched_us"),
        F.col(key).cast("string").alias("key"),  # as text, for a null would turn whole batches of ids into floats
        F.col(key).alias("key_order"),
        F.col(text).cast("string").alias("text"),
        F.col(config).cast("string").alias("config"),
        kept.alias("kept"),
    )
    rows = rows.repartition("source_id", "win").sortWithinPartitions("source_id", "win", "fetched_us", "key_order").drop("key_order")
    schema = T.StructType(
        [
            T.StructField("key", T.StringType()),
            T.StructField("kept", kept_type),
            T.StructField("source_id", T.StringType()),
            T.StructField("win", T.LongType()),
            T.StructField("seq", T.LongType()),
            T.StructField("role", T.IntegerType()),
            T.StructField("instants_us", T.ArrayType(T.LongType())),
            T.StructField("formats", T.ArrayType(T.StringType())),
            T.StructField("costs", T.ArrayType(T.DoubleType())),
            T.StructField("choice", T.IntegerType()),
        ]
    )
    decoded = cut(rows.mapInPandas(_decode, schema))
    edges = decoded.filter(F.col("role") != SETTLED).repartition("source_id").sortWithinPartitions("source_id", "win", "seq")
    out = decoded.filter(F.col("role") == SETTLED).unionByName(edges.mapInPandas(_stitch, schema))
    chosen = lambda c: F.get(F.col(c), F.col("choice"))
    columns = [F.col("key").cast(key_type).alias(key)] + ([F.col("kept").alias(keep)] if keep else [])
    return out.select(
        *columns,
        F.transform("instants_us", lambda x: F.timestamp_micros(x)).alias("instants"),
        "formats",
        F.timestamp_micros(chosen("instants_us")).alias("instant"),
        chosen("formats").alias("format"),
        F.coalesce(chosen("costs") < RULE_BREAK, F.lit(False)).alias("by_rule"),
    )
