"""Passages that repeat between documents, found by recompression and cut from all but the first.

A window is ``WINDOW`` words in a row; a word goes if a window that covers it also stands in
a document with a smaller key.

Recompression shortens every text in rounds. The first names runs of one word; each further
round splits all symbols into two halves by a hash of their name, and a symbol of the first
half with one of the second after it becomes one symbol. A name is a hash of what it names,
so every task gives the same name to the same run or pair, and equal passages are cut in the
same way but for their borders. How far the borders reach is known: beside every symbol
stands the stretch of words that its being there depends on. Every window is named by the
symbol of least hash that depends on nothing outside the window (leftmost on ties; a window
without one by its own words). Equal windows thus have equal names, whatever is around them.

Windows that follow each other under one symbol are one row, their *context*: about one row
for 21 words. Spark then groups these rows globally, in rounds that work on ever less:

1. names that stand in two documents or more (most do not);
2. of those, contexts: where all words of a context are equal, every document but the first
   is settled at once, without a look at single windows;
3. names with several contexts: the windows of one occurrence of each context, compared by
   their 128-bit hashes with their words read again; the answer is a set of bits per context.

Texts are needed three times, beside what has been found about them. They are written once,
in buckets by the number of the task that read them, and what is found is sent there: no text
is shuffled.

Cases: null, empty and short texts lose nothing; rows with a null key lose nothing and take
nothing from others; rows that share a key take nothing from each other; an empty table
gives no rows; other columns are left out. Equality of words, contexts and windows rests on
64-bit hashes of independent keys, two together for windows and for contexts with their name.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwarden.llm import words
from siftwarden.llm.tables import BATCH_BYTES, bounded_batches, scratch, written

WINDOW = 50
ROUNDS = 5
SPREAD = 16  # buckets that a task writes to
ODD = np.uint64(0x9E3779B97F4A7C15)
KEYS = ("substring lane 1", "substring lane 2")
OUTSIDE = np.int64(1 << 40)
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
PLACE = np.uint64(32)  # lower bits of a window's choice: the number of the symbol
CONTEXT = "id bigint, uid bigint, name bigint, ctx bigint, at bigint, n bigint"


def lane(distinct: pa.Array, key: str) -> np.ndarray:
    """A 64-bit hash of each word under one of the keys."""
    if not len(distinct):
        return np.zeros(0, np.uint64)
    return words.mixed(pd.util.hash_array(np.array(distinct.to_pylist(), object), hash_key=key, categorize=False))


class Stretches:
    """Hashes of stretches of words, of ``longest`` at most."""

    def __init__(self, h: np.ndarray, longest: int) -> None:
        self.doubled, size = [h], 1
        while 2 * size <= longest:
            h = words.mixed(h * ODD + np.roll(h, -size))
            self.doubled.append(h)
            size *= 2

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Of stretches inside one text: the two longest doubled ones that cover them."""
        out, size = np.zeros(len(start), np.uint64), stop - start
        depth = np.frexp(size)[1] - 1
        for k, h in enumerate(self.doubled):
            some = np.flatnonzero(depth == k)
            out[some] = words.mixed(h[start[some]] * ODD + h[stop[some] - (1 << k)] + words.mixed(size[some].astype(np.uint64)))
        return out


def recompressed(h: np.ndarray, offsets: np.ndarray, rounds: int) -> dict[str, np.ndarray]:
    """Symbols after all rounds: name, the words they stand for, and the words they depend on."""
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    n = len(h)
    beside = np.zeros(n, bool)  # the next symbol is of the same text
    beside[:-1] = row[1:] == row[:-1]
    first = np.ones(n, bool)
    first[1:] = ~beside[:-1] | (h[1:] != h[:-1])
    start = np.flatnonzero(first)
    stop = np.append(start[1:], n)[: len(start)]
    often = (stop - start).astype(np.uint64)
    name = np.where(often > 1, words.mixed(h[start] * ODD + often), h[start])
    row = row[start]
    # A run ends where another word is seen on either side; the end of a text is out of sight of every window.
    low = np.where(start > offsets[row], start - 1, -OUTSIDE)
    high = np.where(stop < offsets[row + 1], stop + 1, OUTSIDE)
    for r in range(rounds):
        m = len(name)
        opens = (words.mixed(name + np.uint64((r + 1) * int(ODD) % (1 << 64))) >> PLACE) & np.uint64(1) == 0
        to_next, to_last = np.zeros(m, bool), np.zeros(m, bool)
        to_next[:-1] = row[1:] == row[:-1]
        to_last[1:] = to_next[:-1]
        pair = to_next.copy()
        pair[:-1] &= opens[:-1] & ~opens[1:]
        # A symbol that opens looks at the next one, the others at the one before.
        other = np.clip(np.arange(m) + np.where(opens, 1, -1), 0, max(m - 1, 0))
        sees = np.where(opens, to_next, to_last)
        seen_low = np.where(sees, np.minimum(low, low[other]), np.where(opens, low, -OUTSIDE))
        seen_high = np.where(sees, np.maximum(high, high[other]), np.where(opens, OUTSIDE, high))
        stays = np.ones(m, bool)
        stays[1:] = ~pair[:-1]
        at, joined = np.flatnonzero(stays), pair[stays]
        end = at + joined
        name = np.where(joined, words.mixed(words.mixed(name[at] * ODD + np.uint64(r + 1)) + name[end]), name[at])
        start, stop, row, low, high = start[at], stop[end], row[at], seen_low[at], seen_high[at]
    return {"name": name, "start": start, "stop": stop, "row": row, "low": low, "high": high}


def chosen(symbols: dict[str, np.ndarray], offsets: np.ndarray, window: int) -> np.ndarray:
    """For each word, the symbol that names the window which begins there, with its hash above; NONE without one."""
    n = int(offsets[-1])
    low, high, row = symbols["low"], symbols["high"], symbols["row"]
    begin, end = np.maximum(high - window, offsets[row]), np.minimum(low, offsets[row + 1] - window)
    some = np.flatnonzero(begin <= end)
    key = (words.mixed(symbols["name"][some]) >> PLACE << PLACE) | some.astype(np.uint64)
    begin, end = begin[some], end[some]
    depth = np.frexp(end - begin + 1)[1] - 1
    best = np.full(n, NONE)
    for k in range(int(depth.max(initial=-1)), -1, -1):
        mine = depth == k
        for at in (begin[mine], end[mine] - (1 << k) + 1):
            np.minimum.at(best, at, key[mine])
        if k:  # what names 2^k windows in a row names both halves
            half = 1 << (k - 1)
            shifted = np.full(n, NONE)
            shifted[half:] = best[:-half]
            best = np.minimum(best, shifted)
    return best


def contexts(distinct: pa.Array, codes: np.ndarray, offsets: np.ndarray, window: int, rounds: int):
    """Text, first window, number of windows, name and hash of every context."""
    count = np.diff(offsets)
    start = np.arange(len(codes))
    stop = np.repeat(offsets[1:], count)
    whole = np.flatnonzero(start + window <= stop)
    one, two = (lane(distinct, key)[codes] for key in KEYS)
    symbols = recompressed(one, offsets, rounds)
    choice = chosen(symbols, offsets, window)[whole]
    first_lane, second_lane = Stretches(one, window), Stretches(two, window)
    bare = choice == NONE
    words_of = second_lane.of(whole, whole + window)
    row = np.repeat(np.arange(len(count)), count)[whole]
    new = np.ones(len(whole), bool)
    new[1:] = (row[1:] != row[:-1]) | (choice[1:] != choice[:-1]) | (bare[1:] & (words_of[1:] != words_of[:-1]))
    begin = np.flatnonzero(new)
    n = np.diff(np.append(begin, len(whole)))
    symbol = np.where(bare[begin], np.uint64(0), choice[begin] & (NONE >> PLACE)).astype(np.int64)
    at = whole[begin]
    low, high = at, at + window  # a window without a symbol is named by all of its words
    if len(symbols["name"]):
        low, high = np.where(bare[begin], low, symbols["low"][symbol]), np.where(bare[begin], high, symbols["high"][symbol])
    name = first_lane.of(low, high)
    times = np.where(bare[begin], 1, n).astype(np.uint64)
    ctx = words.mixed(words_of[begin] * ODD + words.mixed(words_of[begin + n - 1]) + times)
    return row[begin], at - offsets[row[begin]], n, name, ctx


def _contexts(window: int, rounds: int):
    def run(batches):
        for batch in (part for whole in batches for part in words.slices(whole, "text", BATCH_BYTES)):
            codes, distinct, offsets = words.ascii_words(batch.column("text"))
            row, at, n, name, ctx = contexts(distinct, codes, offsets, window, rounds)
            taken = batch.select(["id", "uid"]).take(pa.array(row))
            yield pa.RecordBatch.from_arrays(
                [*taken.columns, *(pa.array(c.view(np.int64)) for c in (name, ctx, at, n))], ["id", "uid", "name", "ctx", "at", "n"]
            )

    return run


def _told(texts: pa.Table, about: pa.Table):
    """The texts in parts, each with the rows about them: number of the text, and the columns of ``about``."""
    uid = about["uid"].to_numpy()
    columns = {c: about[c].to_numpy() for c in about.column_names}
    for batch in (part for whole in texts.to_batches() for part in words.slices(whole, "text", BATCH_BYTES)):
        mine = batch.column("uid").to_numpy()
        order = np.argsort(mine)
        near = order[np.minimum(np.searchsorted(mine[order], uid), len(mine) - 1)]
        known = np.flatnonzero(mine[near] == uid)
        yield batch, near[known], {c: v[known] for c, v in columns.items()}


def _each(n: np.ndarray) -> np.ndarray:
    """0, 1, ... for every one of ``n``."""
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)


def _windows(window: int, schema: pa.Schema):
    def run(texts: pa.Table, about: pa.Table) -> pa.Table:
        out = []
        for batch, row, asked in _told(texts, about):
            some, row = np.unique(row, return_inverse=True)
            batch = batch.take(pa.array(some))
            codes, distinct, offsets = words.ascii_words(batch.column("text"))
            n, off = asked["n"], _each(asked["n"])
            first = np.repeat(offsets[row] + asked["at"], n) + off
            hashes = [Stretches(lane(distinct, key)[codes], window).of(first, first + window).view(np.int64) for key in KEYS]
            ids = batch.column("id").take(pa.array(np.repeat(row, n)))
            out.append(pa.Table.from_arrays([ids, *map(pa.array, (np.repeat(asked["group"], n), off, *hashes))], schema=schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    return run


def _cut(window: int, schema: pa.Schema):
    def run(texts: pa.Table, about: pa.Table) -> pa.Table:
        out = []
        for batch, row, found in _told(texts, about):
            codes, distinct, offsets = words.ascii_words(batch.column("text"))
            n, off = found["n"], _each(found["n"])
            bits, first = np.repeat(found["bits"], n), np.repeat(offsets[row] + found["at"], n) + off
            first = first[(bits == -1) | (bits >> np.minimum(off, 62) & 1 == 1)]
            cover = np.zeros(len(codes) + 1, np.int64)
            np.add.at(cover, first, 1)
            np.add.at(cover, first + window, -1)
            gone = np.cumsum(cover[:-1]) > 0
            bounds = np.concatenate([[0], np.cumsum(~gone)])[offsets]
            kept = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), distinct.take(pa.array(codes[~gone])))
            total = np.diff(offsets)
            columns = [batch.column("id"), pa.array(total), pa.array(total - np.diff(bounds)), pc.binary_join(kept, " ")]
            out.append(pa.Table.from_arrays(columns, schema=schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    return run


def _part(uid: str = "uid"):
    """The bucket key: the task that numbered the row, in ``SPREAD`` parts."""
    return F.shiftright(F.col(uid), 33) * SPREAD + F.pmod(F.col(uid), F.lit(SPREAD))


class Texts:
    """The texts in buckets, and rows about them joined there without moving a text."""

    def __init__(self, docs: DataFrame, key: str, text: str) -> None:
        spark = docs.sparkSession
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = f"texts_{uuid.uuid4().hex}"
        rows = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("uid"))
        rows = rows.withColumn("part", _part())
        place = scratch(spark, "texts")
        rows.write.bucketBy(self.buckets, "part").option("path", place).option("compression", "zstd").saveAsTable(self.name)
        self.rows = spark.table(self.name)

    def told(self, about: DataFrame, work, schema: str) -> DataFrame:
        """``work`` on each part of the texts and the rows about them; a part is at most a share of what one task has read."""
        fields = [f.split() for f in schema.split(", ")]
        arrow = pa.schema([(name, {"bigint": pa.int64(), "string": pa.string()}[kind]) for name, kind in fields])
        placed = about.withColumn("part", _part())
        return self.rows.groupBy("part").cogroup(placed.groupBy("part")).applyInArrow(work(arrow), schema)

    def forget(self) -> None:
        """Take the table's name from the catalogue; its files stay for what still reads them."""
        self.rows.sparkSession.sql(f"DROP TABLE {self.name}")


def cut_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """Key, ``n_words``, ``n_removed`` and the words that stay, joined by a blank, of every row."""
    if not 2 <= window <= 62:
        raise ValueError("a context's windows are the bits of a long")
    bounded_batches(docs.sparkSession)
    texts = Texts(docs, key, text)
    rows = texts.rows.where("id is not null and text is not null").select("id", "uid", "text")
    every = written(rows.mapInArrow(_contexts(window, rounds), CONTEXT), "contexts")
    # Both sides of a join on what may be hot come from a table: what one key has too much of is then split.
    names = every.groupBy("name").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("name")
    shared = written(every.join(written(names, "names"), "name"), "shared")
    groups = shared.groupBy("name", "ctx").agg(F.min(F.struct("id", "uid", "at", "n")).alias("first"))
    groups = written(groups.withColumn("group", F.monotonically_increasing_id()), "groups")
    several = groups.groupBy("name").agg(F.count("*").alias("times")).where("times > 1").select("name")
    asked = groups.join(written(several, "several"), "name").select("group", "first.uid", "first.at", "first.n")
    schema = "id bigint, group bigint, off bigint, w1 bigint, w2 bigint"
    looked = written(texts.told(asked, lambda s: _windows(window, s), schema), "windows")
    earliest = looked.groupBy("w1", "w2").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high")
    again = looked.join(written(earliest, "earliest"), ["w1", "w2"]).where("id > low")
    bits = again.groupBy("group").agg(F.expr("bit_or(shiftleft(1L, cast(off as int)))").alias("bits"))
    settled = groups.join(bits, "group", "left").select("name", "ctx", F.col("first.id").alias("first"), "bits")
    found = shared.join(written(settled, "settled"), ["name", "ctx"])
    found = found.withColumn("bits", F.when(F.col("id") > F.col("first"), F.lit(-1).cast("bigint")).otherwise(F.coalesce("bits", F.lit(0))))
    found = written(found.where("bits <> 0").select("uid", "at", "n", "bits"), "found")
    out = texts.told(found, lambda s: _cut(window, s), "id bigint, n_words bigint, n_removed bigint, kept string")
    out = out.withColumnRenamed("id", key)
    texts.forget()
    return out
