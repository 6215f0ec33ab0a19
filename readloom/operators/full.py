"""Full mode: alignments and mutations of each interval, with heights for display."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.cs import density, describe, each_mutation, with_mutations
from .overlap import interval_hits
from .scratch import numbered

STYLES = ("by_coord", "by_mutations")
#: Bytes of the levels by mutations that are held at a time; a word of 64 levels.
LEVEL_BYTES, FULL = 128 << 20, np.uint64((1 << 64) - 1)


def stack_by_coord(starts: list[int], ends: list[int]) -> list[int]:
    """Lowest free level of each, in the order given (by start); a level is free once its last end is reached."""
    busy: list[tuple[int, int]] = []
    free: list[int] = []
    out, levels = [], 0
    for s, e in zip(starts, ends):
        while busy and busy[0][0] <= s:
            heapq.heappush(free, heapq.heappop(busy)[1])
        if free:
            level = heapq.heappop(free)
        else:
            level, levels = levels, levels + 1
        heapq.heappush(busy, (e, level))
        out.append(level)
    return out


def _path(k: int, size: int) -> list[int]:
    """Nodes of a tree of size leaves from leaf k up."""
    out, k = [], k + size
    while k:
        out.append(k)
        k >>= 1
    return out


def _nodes(a: int, z: int, size: int) -> list[int]:
    """The fewest nodes over the leaves a to z - 1."""
    out, a, z = [], a + size, z + size
    while a < z:
        if a & 1:
            out.append(a)
            a += 1
        if z & 1:
            z -= 1
            out.append(z)
        a >>= 1
        z >>= 1
    return out


def stack_by_mutations(starts: list[int], ends: list[int], memory: int = LEVEL_BYTES) -> list[int]:
    """Lowest level of each, in the order given, without a segment (s, e) with e >= start and s < end.

    Levels are bits. Two trees over the distinct starts hold the levels of the
    segments that reach a start from before it and of those that begin in a
    range; a segment looks at the nodes of its own start and range, 64 levels a
    word. A pair of start and end never fits below where it did before. Where
    the words of all levels would take over memory, what the levels of one band
    refuse goes on to the next band: first fit all the same.
    """
    s, e = np.asarray(starts, dtype=np.int64), np.asarray(ends, dtype=np.int64)
    points, out = np.unique(s), [0] * len(s)
    size = len(points)
    pairs, pair = np.unique(np.stack([s, e], axis=1), axis=0, return_inverse=True)
    at, inside, reach, pair = (x.tolist() for x in (np.searchsorted(points, s), np.searchsorted(points, e), np.searchsorted(points, e, "right"), pair.ravel()))
    words = min(max(memory // (32 * max(size, 1)), 1), 16)
    most = max(memory // (32 * max(size, 1) * words), 1)
    left, base = range(len(s)), 0
    while left:
        blocks, low, refused = [], [0] * len(pairs), []
        for i in left:
            look = np.array(_path(at[i], size) + [2 * size + k for k in _nodes(at[i], inside[i], size)])
            for b in range(low[pair[i]], most):
                if b == len(blocks):
                    blocks.append(np.zeros((4 * size, words), dtype=np.uint64))
                used = np.bitwise_or.reduce(blocks[b][look], axis=0)
                w = int((used != FULL).argmax())
                if used[w] != FULL:
                    break
            else:
                low[pair[i]] = most
                refused.append(i)
                continue
            low[pair[i]] = b
            bits = int(used[w])
            free = ~bits & (bits + 1)
            mark = _nodes(at[i] + 1, reach[i], size) + [2 * size + k for k in _path(at[i], size)]
            blocks[b][mark, w] |= np.uint64(free)
            out[i] = base + (b * words + w) * 64 + free.bit_length() - 1
        left, base = refused, base + most * words * 64
    return out


def with_heights(rows: DataFrame, style: str) -> DataFrame:
    """rows (alignment_index, line_no, interval_id, contig_id, contig_start, contig_end, mutation_count) with height.

    Equal starts, or densities, come in order of the line, then the interval.
    Levels of a contig are independent of others, and of stretches between
    which no alignment reaches, so each such island is stacked on its own.
    """
    if style not in STYLES:
        raise ValueError(f"height style must be one of {STYLES}: {style}")
    w = W.partitionBy("contig_id").orderBy("contig_start", "tie")
    reach = F.max("contig_end").over(w.rowsBetween(W.unboundedPreceding, -1))
    apart = F.col("contig_start") >= reach if style == "by_coord" else F.col("contig_start") > reach
    tie = F.row_number().over(W.partitionBy("contig_id").orderBy("line_no", "interval_id"))
    keys = rows.select("alignment_index", tie.alias("tie"), "contig_id", "contig_start", "contig_end", density(F.col("mutation_count"), F.col("contig_start"), F.col("contig_end")).alias("density"))
    keys = keys.withColumn("apart", F.when(apart, 1).otherwise(0)).withColumn("island", F.sum("apart").over(w)).drop("apart")

    def stack(pdf: pd.DataFrame) -> pd.DataFrame:
        by = ["contig_start" if style == "by_coord" else "density", "tie"]
        pdf = pdf.sort_values(by, ascending=[style == "by_coord", True], kind="stable")
        place = stack_by_coord if style == "by_coord" else stack_by_mutations
        return pd.DataFrame({"alignment_index": pdf["alignment_index"], "height": place(pdf["contig_start"].tolist(), pdf["contig_end"].tolist())})

    heights = keys.groupBy("contig_id", "island").applyInPandas(stack, "alignment_index long, height long")
    return rows.join(heights, "alignment_index")


def full_query(alignments: DataFrame, intervals: DataFrame, max_length: int, style: str | None = "by_coord", first_index: int = 0) -> DataFrame:
    """A row for each interval and alignment that it hits, numbered by interval, start and line, with its mutations and height; style None: no height."""
    hits = with_mutations(interval_hits(alignments, intervals, max_length)).withColumn("mutation_count", F.size("mutations").cast("long"))
    rows = numbered(hits, "alignment_index", "interval_id", "contig_start", "line_no", start=first_index)
    return with_heights(rows, style) if style else rows


def alignment_rows(full: DataFrame) -> DataFrame:
    height = ["height"] if "height" in full.columns else []
    return full.select("alignment_index", "read_id", "read_length", "contig_id", "read_start", "read_end", "contig_start", "contig_end", "is_reverse", F.col("cs").alias("cs_tag"), "mutation_count", *height)


def mutation_rows(full: DataFrame) -> DataFrame:
    """All mutations of the alignments, those outside their interval too."""
    height = ["height"] if "height" in full.columns else []
    m = each_mutation(full, "alignment_index", "read_id", "contig_id", *height)
    return m.select("alignment_index", "read_id", "contig_id", F.col("m.type").alias("mutation_type"), F.col("m.position").alias("mutation_position"), describe(F.col("m.type"), F.col("m.nts")).alias("mutation_desc"), *height)
