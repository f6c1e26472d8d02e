"""Similarity join on word n-grams by MinHash banding.

A text is the set of its runs of ``WIDTH`` words (lower case, between blanks); a text of
fewer words is one run, all its words. Texts of equal words are joined once, through one
of them. Bands and rows follow from the wanted recall at the threshold. Texts meet by
shuffling on band hashes; every pair that meets is verified on its full n-gram sets.

No pair is a row. A bucket is a group of texts to be verified together; a large one is
cut into blocks and every two blocks meet in a task, which adds up links and keeps a
spanning forest of them. A pair counts in the first band it shares, buckets with the same
members are one, and so each link counts once. Classes are the connected components of
the links.

Cases: null, empty and blank texts have no n-grams, no links and a class of their own;
copies are links of each other; rows that repeat a key and text share an answer, and
those that repeat a key with another text have the answer of their own text; rows with a
null key have a null class and no links; an empty table gives no rows; other columns are
left out.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwarden.llm import words
from siftwarden.llm.tables import BATCH_BYTES, bounded_batches, written

WIDTH = 5
THRESHOLD = 0.8
RECALL = 0.999
MOST_HASHES = 128
BLOCK = 256
DENSE = 4096


def banding(threshold: float, recall: float, most: int = MOST_HASHES) -> tuple[int, int]:
    """Bands and rows: the most rows, hence the fewest false meetings, that reach the recall."""
    best = None
    for rows in range(1, most + 1):
        meet = threshold**rows
        bands = 1 if meet >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-meet))
        if bands * rows > most:
            break
        best = bands, rows
    if best is None:
        raise ValueError("more hashes are needed for that recall")
    return best


def shingles(texts: pa.Array, width: int = WIDTH):
    """N-gram hashes of each text with their offsets, and two sums that stand for its word sequence."""
    codes, distinct, offsets = words.split_words(pc.utf8_lower(pc.fill_null(texts, "")))
    h = words.word_hashes(distinct)[codes]
    n, count = len(h), np.diff(offsets)
    base = np.uint64(0x9E3779B97F4A7C15)
    rolled = np.zeros(n, np.uint64)
    for j in range(width):
        rolled[: max(0, n - j)] = rolled[: max(0, n - j)] * base + words.mixed(h[j:])
    grams = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    starts = np.concatenate([[0], np.cumsum(grams)])
    at = np.repeat(offsets[:-1] - starts[:-1], grams) + np.arange(starts[-1])
    out = words.mixed(rolled[at])
    for short in np.flatnonzero((count > 0) & (count < width)):
        x = np.array([count[short]], np.uint64)
        for w in h[offsets[short] : offsets[short + 1]]:
            x = words.mixed(x * base + w)
        out[starts[short]] = x[0]
    place = (np.arange(n) - np.repeat(offsets[:-1], count)).astype(np.uint64)
    same = []
    for salt in (1, 2):
        v = words.mixed(words.mixed(h + np.uint64(salt)) + words.mixed(place * np.uint64(2) + np.uint64(salt)))
        run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(v, dtype=np.uint64)])
        same.append(run[offsets[1:]] - run[offsets[:-1]])
    return out, starts, same


def signatures(grams: np.ndarray, starts: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band hashes of the texts that have n-grams, one row each."""
    some = starts[:-1][np.diff(starts) > 0]
    seeds = np.random.default_rng(7).integers(0, 1 << 63, (2, bands * rows), dtype=np.uint64)
    out = np.zeros((len(some), bands), np.uint64)
    if not len(some):
        return out
    scratch = np.empty_like(grams)
    for b in range(bands):
        x = np.full(len(some), b + 1, np.uint64)
        for k in range(b * rows, (b + 1) * rows):
            np.multiply(grams, seeds[0, k] * np.uint64(2) + np.uint64(1), out=scratch)
            np.add(scratch, seeds[1, k], out=scratch)
            x = words.mixed(x * np.uint64(31) + np.minimum.reduceat(scratch, some))
        out[:, b] = x
    return out


def _sketched(width: int, bands: int, rows: int):
    def run(batches):
        for batch in (part for whole in batches for part in words.slices(whole, "text", BATCH_BYTES)):
            grams, starts, same = shingles(batch.column("text"), width)
            has = np.diff(starts) > 0
            hashes = signatures(grams, starts, bands, rows).view(np.int64)
            ends = np.concatenate([[0], np.cumsum(has) * bands]).astype(np.int32)
            yield pa.RecordBatch.from_pydict(
                {
                    "id": batch.column("id"), "th": batch.column("th"), "c1": same[0].view(np.int64), "c2": same[1].view(np.int64),
                    "bands": pa.ListArray.from_arrays(pa.array(ends), pa.array(hashes.ravel())),
                }
            )

    return run


def _similar(rows: np.ndarray, grams: np.ndarray, n: int, left: np.ndarray, right: np.ndarray, threshold: float):
    """Which of ``left`` and ``right`` (row numbers) are similar; (row, gram) pairs are distinct."""
    sizes = np.bincount(rows, minlength=n)
    _, code, often = np.unique(grams, return_inverse=True, return_counts=True)
    shared = often[code] > 1
    rows, code = rows[shared], code[shared]
    order = np.argsort(code, kind="stable")
    rows, code = rows[order], code[order]
    new = np.r_[True, code[1:] != code[:-1]] if len(code) else np.zeros(0, bool)
    column = np.cumsum(new) - 1
    both = np.zeros((len(left), len(right)), np.float64)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, DENSE):
        some = slice(*np.searchsorted(column, [low, low + DENSE]))
        m = np.zeros((n, DENSE), np.float32)
        m[rows[some], column[some] - low] = 1
        both += m[left] @ m[right].T
    union = sizes[left][:, None] + sizes[right][None, :] - both
    return (both >= threshold * union - 1e-9) & (both > 0)


def _forest(p: np.ndarray, q: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The smallest id that each row is connected to."""
    root = ids.copy()
    while True:
        low = np.minimum(root[p], root[q])
        new = root.copy()
        np.minimum.at(new, p, low)
        np.minimum.at(new, q, low)
        if (new == root).all():
            return root
        root = new


def _verified(width: int, threshold: float):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids, copies, side = (table[c].to_numpy() for c in ("id", "copies", "block"))
        grams, starts, _ = shingles(pa.concat_arrays(table["text"].chunks), width)
        rows = np.repeat(np.arange(len(ids)), np.diff(starts))
        order = np.lexsort((grams, rows))
        rows, grams = rows[order], grams[order]
        once = np.r_[True, (rows[1:] != rows[:-1]) | (grams[1:] != grams[:-1])]
        within = table["a"][0].as_py() == table["b"][0].as_py()
        left = np.arange(len(ids)) if within else np.flatnonzero(side == side.min())
        right = left if within else np.flatnonzero(side != side.min())
        alike = _similar(rows[once], grams[once], len(ids), left, right, threshold)
        if within:
            alike = np.triu(alike, 1)
        p, q = np.nonzero(alike)
        p, q = left[p], right[q]
        lists = table["bands"].combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        bands = lists.flatten().to_numpy().reshape(len(ids), -1)
        root = _forest(p, q, ids)
        first = np.zeros(len(p), bool)
        for at in range(0, len(p), 1 << 16):
            some = slice(at, at + (1 << 16))
            first[some] = (bands[p[some]] == bands[q[some]]).argmax(1) == table["band"][0].as_py()
        linked = np.unique(np.concatenate([p, q])).astype(np.int64)
        p, q = p[first], q[first]
        texts = np.bincount(p, minlength=len(ids)) + np.bincount(q, minlength=len(ids))
        links = np.bincount(p, copies[q], len(ids)) + np.bincount(q, copies[p], len(ids))
        return pa.table(
            {"id": ids[linked], "root": root[linked], "links": links[linked].astype(np.int64), "texts": texts[linked].astype(np.int64)}
        )

    return run


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``node`` and ``label``, the smallest node it is connected to, of edges ``a``, ``b``.

    Every round takes the smallest label of the neighbours, then that label's own label.
    """
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), name)
    labels = written(
        both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("label")), name
    )
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        parents = labels.select(F.col("node").alias("label"), F.col("label").alias("above"))
        labels = written(lower.join(parents, "label").select("node", "old", F.least("label", "above").alias("label")), name)
        moved = labels.where("old <> label").isEmpty()
        labels = labels.drop("old")
        if moved:
            return labels


def join(
    docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, threshold: float = THRESHOLD,
    recall: float = RECALL, block: int = BLOCK,
) -> DataFrame:
    """``doc_id``, ``class_id``, ``links`` (documents), ``text_links`` (different texts) and ``copies``."""
    return _answers(docs, key, text, width, threshold, recall, block).drop("th", "class_th")


def _answers(docs: DataFrame, key: str, text: str, width: int, threshold: float, recall: float, block: int) -> DataFrame:
    """The same with ``th``, the hash of the row's text, and ``class_th``, that of the text that stands for the class."""
    bounded_batches(docs.sparkSession)
    bands, rows = banding(threshold, recall)
    docs = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("th"))
    known = docs.where("id is not null")
    sketches = known.mapInArrow(_sketched(width, bands, rows), "id bigint, th bigint, c1 bigint, c2 bigint, bands array<bigint>")
    sketches = written(sketches, "sketches")
    single = sketches.groupBy("id", "th").agg(F.first(F.struct("c1", "c2", "bands")).alias("s"), F.count("*").alias("n"))
    single = written(single.select("id", "th", "s.*", "n"), "documents")
    texts = single.where(F.size("bands") > 0).groupBy("c1", "c2").agg(
        F.min(F.struct("id", "th")).alias("k"), F.sum("n").alias("copies"), F.first("bands").alias("bands")
    )
    # A key may have several texts, so texts are numbered; the written numbers stay.
    texts = written(texts.select(F.monotonically_increasing_id().alias("node"), "k.*", "c1", "c2", "copies", "bands"), "texts")
    met = texts.select("node", F.posexplode("bands").alias("band", "h"))
    buckets = met.groupBy("band", "h").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.min("node").alias("low"))
    # Band hashes differ by band, and buckets with the same members are verified in the first of them.
    buckets = buckets.where("n > 1").groupBy("n", "x", "low").agg(F.min_by("h", "band").alias("h"), F.min("band").alias("band"))
    members = met.join(buckets.select("band", "h", "n"), ["band", "h"])
    blocks = F.ceil(F.col("n") / block).cast("int")
    members = members.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node", "h"), F.col("blocks")).cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "node", "band", "h", "block", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b")
    )
    content = known.dropDuplicates(["id", "th"])
    full = members.join(texts.select("node", "id", "th", "copies", "bands"), "node").join(content, ["id", "th"])
    full = full.drop("id").withColumnRenamed("node", "id")
    schema = "id bigint, root bigint, links bigint, texts bigint"
    found = full.groupBy("h", "a", "b").applyInArrow(_verified(width, threshold), schema)
    found = written(found, "links")
    labels = components(found.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")).distinct())
    links = found.groupBy("id").agg(F.sum("links").alias("links"), F.sum("texts").alias("texts")).withColumnRenamed("id", "node")
    classed = labels.join(texts.select("node", "id", "th"), "node")
    smallest = classed.groupBy("label").agg(F.min(F.struct("id", "th")).alias("least"))
    stands = classed.join(smallest, "label").select("node", "least")
    told = texts.join(links, "node", "left").join(stands, "node", "left")
    told = told.withColumn("least", F.coalesce("least", F.struct("id", "th"))).select(
        "c1", "c2", F.col("least.id").alias("class_id"), F.col("least.th").alias("class_th"), "links", "texts", "copies"
    )
    answer = ["id", "th", "class_id", "class_th", "links", "texts", "copies", "n"]
    worded = single.where(F.size("bands") > 0).join(told, ["c1", "c2"]).select(*answer)
    wordless = single.where(F.size("bands") == 0).select(
        "id", "th", F.col("id").alias("class_id"), F.col("th").alias("class_th"), F.lit(None).alias("links"), F.lit(None).alias("texts"),
        F.lit(1).cast("bigint").alias("copies"), "n",
    )
    each = worded.unionByName(wordless)
    # A key and text that repeat have their answer on each of their rows.
    each = each.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))))
    result = each.select(
        F.col("id").alias("doc_id"), "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"),
        F.coalesce("texts", F.lit(0)).cast("bigint").alias("text_links"), "copies", "th", "class_th",
    )
    void = docs.where("id is null").select(
        F.col("id").alias("doc_id"), F.col("id").alias("class_id"), F.lit(0).cast("bigint").alias("links"),
        F.lit(0).cast("bigint").alias("text_links"), F.lit(1).cast("bigint").alias("copies"), "th",
        F.col("th").alias("class_th"),
    )
    return result.unionByName(void)


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The document with the smallest key of each class, of texts under that key the one of the smallest hash.

    Rows without a key stay.
    """
    classes = _answers(docs, key, text, WIDTH, THRESHOLD, RECALL, BLOCK)
    others = classes.where("doc_id <> class_id or th <> class_th").select("doc_id", "th").distinct()
    same = (docs[key].cast("bigint") == others["doc_id"]) & (F.xxhash64(docs[text]) == others["th"])
    return docs.join(others, same, "left_anti")
