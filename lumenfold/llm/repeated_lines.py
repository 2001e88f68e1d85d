"""Lines repeated across one site's documents, found by content-defined chunks.

The visible text of a body (tags dropped, entities decoded, case and digits
folded) is one stream of code points, line breaks being characters like others.
A gear-style rolling hash over the last WINDOW code points decides where chunks
end.  A chunk that lies inside a line and begins WINDOW characters or more after
its start depends on the line alone, wherever the line stands.  Distinct
documents are counted per source and chunk, and chunks under the limits are
dropped.  Lines whose chunks are all repeated, and those too short to hold one,
are then counted themselves, since equal chunks need not come from equal lines.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, spread
from .grams import codes, mix

WINDOW = 8
CUT_MASK = np.uint64(0x1F)
MIN_ITEMS = 6
MIN_SHARE = 0.15

_TAG = re.compile(r"<!--.*?(?:-->|$)|</?[A-Za-z!?][^<>]*(?:>|$)", re.S)
_DIGITS = re.compile(r"[\d]+")
_BLANK = re.compile(r"\s+")
_P = np.uint64(0x9E3779B97F4A7C15)


def visible_line(line: str) -> str:
    """What a reader sees of one line: folded case, blanks and digits."""
    if "<" in line:
        line = _TAG.sub("", line)
    if "&" in line:
        line = html.unescape(line)
    line = _DIGITS.sub("0", _BLANK.sub(" ", line).strip().casefold())
    return line


def chunk_hashes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(line index, hash) of the chunks of the joined lines that lie inside a line
    and depend on it alone."""
    stream = codes("\n".join(lines) + "\n").astype(np.uint64)
    gear = mix(stream)
    pos = np.arange(len(stream))
    h = np.zeros(len(stream), dtype=np.uint64)
    for k in range(min(WINDOW, len(stream))):
        h[k:] += gear[: len(stream) - k] << np.uint64(k)
    at = np.flatnonzero((mix(h) & CUT_MASK) == 0)
    if len(at) < 2:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    starts, ends = at[:-1] + 1, at[1:]
    breaks = np.flatnonzero(stream == 10)
    line_of = np.searchsorted(breaks, starts)
    line_start = np.r_[0, breaks + 1][line_of]
    # the hash at the cut before the chunk looks back WINDOW characters
    keep = (starts >= line_start + WINDOW) & (ends < breaks[np.minimum(line_of, len(breaks) - 1)])
    # polynomial hash of each chunk by position inside it
    begin = np.zeros(len(stream), dtype=np.int64)
    begin[starts] = starts
    inside = (pos - np.maximum.accumulate(begin)).astype(np.uint64)
    value = mix(gear ^ mix(inside + np.uint64(1)) * _P)
    sums = np.add.reduceat(value, np.r_[starts, at[-1] + 1] if at[-1] + 1 < len(stream) else starts)[: len(starts)]
    return line_of[keep], mix(sums + (ends - starts + 1).astype(np.uint64))[keep]


def _chunked(batches):
    """Lines with their chunks, and how many of these, the first ones, the item did
    not have in a line before."""
    for pdf in batches:
        ids, nos, lines, chunk_lists, fresh = [], [], [], [], []
        for item, body in zip(pdf["item_id"], pdf["body"]):
            if not body:
                continue
            shown = [visible_line(x) for x in body.split("\n")]
            kept = [(i + 1, x) for i, x in enumerate(shown) if x]
            if not kept:
                continue
            line_of, hashes = chunk_hashes([x for _, x in kept])
            order = np.searchsorted(line_of, np.arange(len(kept) + 1))
            signed = hashes.view(np.int64)
            seen: set = set()
            for j, (no, text) in enumerate(kept):
                own = set(signed[order[j] : order[j + 1]].tolist())
                new = own - seen
                seen |= new
                ids.append(item)
                nos.append(no)
                lines.append(text)
                chunk_lists.append([*new, *(own - new)])
                fresh.append(len(new))
        yield pd.DataFrame({"item_id": ids, "line_no": np.asarray(nos, dtype=np.int32), "line": lines, "chunks": chunk_lists, "fresh": np.asarray(fresh, dtype=np.int32)})


def repeated_lines(
    items: DataFrame, links: DataFrame, id_col: str = "id", body_col: str = "content_html",
    min_items: int = MIN_ITEMS, min_share: float = MIN_SHARE,
) -> DataFrame:
    """(item_id, line_no) of lines that one of the item's sources repeats in at
    least min_items distinct items and min_share of all its linked items.

    Counts are distinct (source, item, chunk) rows pre-aggregated before the
    shuffle, so a source with a third of all rows is spread over its chunks.

    Defined cases: null or empty bodies have no lines but count towards their
    source's items; null ids or sources take no part; repeated links and
    repeated item rows count once; lines without visible text are never
    reported; very long lines and bodies are processed whole; empty tables give
    no rows; other columns are ignored."""
    pairs = links.select(F.col("item_id").cast("string").alias("item_id"), F.col("source_id").cast("string").alias("source_id"))
    pairs = pairs.filter("item_id is not null and source_id is not null").distinct()
    need = pairs.groupBy("source_id").agg(F.count(F.lit(1)).alias("n")).select(
        "source_id", F.greatest(F.lit(min_items), F.ceil(F.col("n") * min_share - 1e-9)).alias("need")
    )
    bodies = items.select(F.col(id_col).cast("string").alias("item_id"), F.col(body_col).alias("body")).filter("item_id is not null and body is not null")
    lines = spread(bodies).mapInPandas(_chunked, "item_id string, line_no int, line string, chunks array<long>, fresh int")
    # a line of a source is known by 128 bits of both, so that rows stay small
    keys = [F.xxhash64("source_id", "line").alias("k1"), F.xxhash64("line", "source_id").alias("k2")]
    of_source = F.transform("chunks", lambda c: F.xxhash64("source_id", c)).alias("chunks")
    placed = cut(lines.join(pairs.join(need, "source_id"), "item_id").select("item_id", "line_no", *keys, of_source, "fresh", "need"))

    per_chunk = (
        placed.select(F.explode(F.slice("chunks", F.lit(1), F.col("fresh"))).alias("chunk"), "need")
        .groupBy("chunk").agg(F.count(F.lit(1)).alias("items"), F.first("need").alias("need")).filter("items >= need").select("chunk")
    )
    # repeated chunks are few (at most 1 / min_share for each chunk of a source's average item), so this join
    # is broadcast where they are small; else it shuffles by chunk, which spreads a source
    columns = ["item_id", "line_no", "k1", "k2", "need"]
    covered = (
        placed.select(*columns, F.size("chunks").alias("size"), F.explode("chunks").alias("chunk")).join(per_chunk, "chunk", "left_semi")
        .groupBy(*columns, "size").agg(F.count(F.lit(1)).alias("hit")).filter("hit >= size")  # more where a row of items is repeated
    )
    candidates = covered.select(*columns).unionByName(placed.filter(F.size("chunks") == 0).select(*columns))
    exact = (
        candidates.groupBy("k1", "k2", F.xxhash64("item_id").alias("item")).agg(F.first("need").alias("need"))
        .groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("items"), F.first("need").alias("need")).filter("items >= need").select("k1", "k2")
    )
    return candidates.join(exact, ["k1", "k2"], "left_semi").select("item_id", "line_no").distinct()


def without_lines(items: DataFrame, repeated: DataFrame, id_col: str = "id", body_col: str = "content_html") -> DataFrame:
    """(item_id, content_html): each body without its repeated lines.

    A body that consists of repeated lines alone comes out empty; null bodies
    stay null; no item is dropped."""
    cuts = repeated.groupBy("item_id").agg(F.collect_set("line_no").alias("drop"))
    bodies = items.select(F.col(id_col).alias("item_id"), F.col(body_col).alias("body")).join(cuts, "item_id", "left")
    parts = F.split("body", "\n", -1)
    kept = F.filter(F.transform(parts, lambda x, i: F.struct(x.alias("x"), (i + 1).alias("n"))), lambda s: ~F.array_contains("drop", s["n"]))
    cleaned = F.when(F.col("drop").isNull(), F.col("body")).otherwise(F.array_join(F.transform(kept, lambda s: s["x"]), "\n"))
    return bodies.select("item_id", cleaned.alias("content_html"))
