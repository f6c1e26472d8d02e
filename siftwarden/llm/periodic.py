"""Runs of words that repeat with a period, found by minimizers of many scales.

A run is a maximal stretch of words with smallest period q and at least ``exponent`` times
q words. Short periods are found by comparing the whole text with itself shifted. For the
others there is a scale w, a power of two, with w/2 < q <= w: stretches of w words are
hashed, and the least hash of every w/2 neighbours is kept. What is kept depends on nearby
words only, so inside a run it comes again q words on; and a stretch of w >= q words does
not come sooner, as q is the smallest period. Any run of four periods is long enough to
hold a kept stretch and the next equal one, q further on: that pair is a seed. Seeds of the
same distance that touch are one, what is left is compared word by word at both ends, and
of one stretch found with several periods the smallest is the run's.

All texts of a batch are worked on together, each with an end sign of its own. The work is
in proportion to the words and the number of scales. Nothing is shuffled.

Cases: null, empty and blank texts have no runs and collapse to the empty text; rows that
repeat get the same answer each; a null key is kept; an empty table gives no rows; other
columns are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwarden.llm import words
from siftwarden.llm.tables import BATCH_BYTES, bounded_batches

EXPONENT = 4
LEAST = 6
SHORT = 8  # periods up to here are looked for by comparing at that distance; a power of two
STRIDE = 32
ODD = np.uint64(0x9E3779B97F4A7C15)
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def _equal_stretches(x: np.ndarray, lag: int) -> tuple[np.ndarray, np.ndarray]:
    """First and one past last positions at which ``x`` equals itself ``lag`` further on."""
    same = np.zeros(max(len(x) - lag, 0) + 2, np.int8)
    same[1:-1] = x[: max(len(x) - lag, 0)] == x[lag:]
    turn = np.diff(same)
    return np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)


def _extend(x: np.ndarray, at: np.ndarray, lag: np.ndarray, step: int) -> np.ndarray:
    """How many positions from ``at`` on, in the direction of ``step``, equal those ``lag`` further on."""
    out, live = np.zeros(len(at), np.int64), np.arange(len(at))
    while len(live):
        here = (at[live] + step * out[live])[:, None] + step * np.arange(STRIDE)
        there = here + lag[live][:, None]
        inside = (here >= 0) & (there < len(x))
        same = inside & (x[np.where(inside, here, 0)] == x[np.where(inside, there, 0)])
        whole = same.all(1)
        out[live] += np.where(whole, STRIDE, same.argmin(1))
        live = live[whole]
    return out


def _kept_positions(h: np.ndarray, window: int) -> np.ndarray:
    """Positions of the leftmost least hash of each ``window`` neighbours, a power of two."""
    least, at, size = h, np.arange(len(h)), 1
    while size < window and len(least) > size:
        left = least[:-size] <= least[size:]
        least, at = np.where(left, least[:-size], least[size:]), np.where(left, at[:-size], at[size:])
        size *= 2
    chosen = np.zeros(len(h), bool)
    chosen[at] = True
    return np.flatnonzero(chosen)


def _seeds(h: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and lag of stretches that equal themselves further on, from equal minimizers of one scale."""
    kept = _kept_positions(h, w // 2)
    order = kept[np.argsort(h[kept], kind="stable")]
    a, lag = order[:-1], np.diff(order)
    near = (h[a] == h[order[1:]]) & (lag > w // 2) & (lag <= w)
    a, lag = a[near], lag[near]
    order = np.lexsort((a, lag))
    a, lag = a[order], lag[order]
    new = np.ones(len(a), bool)
    new[1:] = (lag[1:] != lag[:-1]) | (a[1:] > a[:-1] + w)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(a))[: len(first)] - 1
    return a[first], a[last] + w, lag[first]


def find_runs(codes: np.ndarray, offsets: np.ndarray, exponent: int = EXPONENT, least: int = LEAST, short: int = SHORT):
    """Row, start, length and period of every run of texts given as word numbers, in that order."""
    if exponent < 4:
        raise ValueError("seeds are sure for runs of four periods and more")
    counts, rows = np.diff(offsets), len(offsets) - 1
    ends = offsets[1:] + np.arange(rows)
    x = np.empty(len(codes) + rows, np.int64)
    ending = np.zeros(len(x), bool)
    ending[ends] = True
    x[~ending], x[ending] = codes, -1 - np.arange(rows)
    found = []
    for lag in range(1, short + 1):
        start, stop = _equal_stretches(x, lag)
        enough = stop - start + lag >= max(least, exponent * lag)
        found.append((start[enough], stop[enough] + lag, np.full(enough.sum(), lag)))
    place, owner, w = np.arange(len(x)), np.repeat(np.arange(rows), counts + 1), 1
    h = words.mixed(x.astype(np.uint64) * ODD)
    while len(x):
        if w >= 2 * short and w > 1:
            start, stop, lag = _seeds(h, w)
            start, stop = start - _extend(x, start - 1, lag, -1), stop + _extend(x, stop, lag, 1)
            enough = stop - start + lag >= np.maximum(least, exponent * lag)
            start, size, lag = start[enough], (stop - start + lag)[enough], lag[enough]
            found.append((place[start], place[start] + size, lag))
        # A stretch that goes past the end of its text holds that text's sign, and equals no other.
        h = words.mixed(h * ODD + np.roll(h, -w))
        w *= 2
        long = counts[owner] > 2 * w  # room for four periods of more than w / 2
        if w >= 2 * short and long.sum() <= len(x) // 2:
            x, h, place, owner = x[long], h[long], place[long], owner[long]
        elif not long.any():
            break
    start, stop, lag = (np.concatenate(p) for p in zip(*found))
    order = np.lexsort((lag, stop, start))
    start, stop, lag = start[order], stop[order], lag[order]
    once = np.ones(len(start), bool)
    once[1:] = (start[1:] != start[:-1]) | (stop[1:] != stop[:-1])
    start, stop, lag = start[once], stop[once], lag[once]
    row = np.searchsorted(ends, start)
    order = np.lexsort((lag, start, row))
    begin = offsets[:-1] + np.arange(rows)
    return row[order], (start - begin[row])[order], (stop - start)[order], lag[order]


def _collapsed(exponent: int, least: int):
    def run(batches):
        for batch in (part for whole in batches for part in words.slices(whole, "text", BATCH_BYTES)):
            codes, distinct, offsets = words.ascii_words(batch.column("text"))
            row, start, length, period = find_runs(codes, offsets, exponent, least)
            cover = np.zeros(len(codes) + 1, np.int64)
            np.add.at(cover, offsets[row] + start + period, 1)
            np.add.at(cover, offsets[row] + start + length, -1)
            keep = np.cumsum(cover[:-1]) == 0
            bounds = np.concatenate([[0], np.cumsum(keep)])[offsets]
            kept = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), distinct.take(pa.array(codes[keep])))
            runs = pa.StructArray.from_arrays([pa.array(c) for c in (start, length, period)], ["start", "length", "period"])
            ends = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_pydict(
                {
                    "key": batch.column("key"), "n_words": np.diff(offsets), "runs": pa.ListArray.from_arrays(pa.array(ends), runs),
                    "collapsed": pc.binary_join(kept, " "),
                }
            )

    return run


def collapse(
    docs: DataFrame, key: str = "doc_id", text: str = "text", exponent: int = EXPONENT, least: int = LEAST
) -> DataFrame:
    """Key, ``n_words``, ``runs`` by start and period, and the text without what runs repeat, words joined by a blank."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"))
    schema = f"key bigint, n_words bigint, runs {RUNS}, collapsed string"
    return rows.mapInArrow(_collapsed(exponent, least), schema).withColumnRenamed("key", key)


def summary(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Number of runs, the longest (ties: smallest start, then period), and digests of all runs and of the collapsed text."""
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    lines = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("n"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    return found.withColumn("longest", longest).select(
        key, F.size("runs").cast("bigint").alias("n_runs"), (-F.col("longest.s")).alias("start"), F.col("longest.n").alias("length"),
        (-F.col("longest.p")).alias("period"),
        F.expr("longest.n * 1000L div -longest.p").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
