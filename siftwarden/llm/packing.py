"""Packing documents into token sequences by swap-based local search.

A document's ids (with the separator) are cut only where they are longer than a
sequence. Whole pieces fill sequences of their own. The others are dealt into groups
of bounded size; each group starts from best fit and then searches: between the
emptiest bin and the other underfull ones it moves a piece, exchanges one for one or two
for one, whenever that raises the sum of squared fills, until the bin is empty and is
dropped. Groups whose bins stay underfull hand them to the next, smaller round, so that
the room left over is bounded by a bin or so of the last round and not by one per group.

Cases: null and empty texts are one separator; a null key is kept; repeated rows are
packed once each; an empty table gives no pieces; other columns are left out.
"""

from __future__ import annotations

import itertools
import json
import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwarden.llm import words
from siftwarden.llm.tables import bounded_batches, worker_cache, written

CAPACITY = 2048
GROUP = 20_000
CACHE = 200_000  # parts of words a worker keeps, twice; about 150 bytes each
ENCODE_BYTES = 4 << 20
SEPARATOR = 0
WIDE = 8  # pieces of a bin that are looked at together with all other bins'
STRETCH = 4096  # bins looked at together
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


# How a tokenizer has to prepare texts for its words to be told apart here.
NORMALIZER = {"type": "Sequence", "normalizers": [
    {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# Chunks of plain Latin characters without an apostrophe; in them a border is beside every digit and run of signs.
PLAIN = r"^[\x21-\x26\x28-\x7e\x{a1}-\x{ff}]+$"
BORDER = r"(\p{N}|[^\p{L}\p{N}]+)"


WORD_END = "</w>"
LINE = 256  # words encoded at a time


def _plain(chunks: pa.Array) -> pa.Array:
    return pc.and_(pc.match_substring_regex(chunks, PLAIN), pc.invert(pc.match_substring(chunks, "<|")))


def _expanded(codes: np.ndarray, flat: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values that each code stands for, one after another, and where each code's end."""
    lengths = np.diff(ends, prepend=0)[codes]
    after = np.cumsum(lengths)
    total = int(after[-1]) if len(after) else 0
    return flat[np.repeat(ends[codes] - after, lengths) + np.arange(total)], after


class Encoder:
    """Ids by a public tokenizer; what recurs between blanks is encoded once per worker.

    A tokenizer that drops white space before it forms words, by the pattern above, gives a
    text the ids of its chunks between ASCII blanks. Chunks of plain Latin characters are
    told apart further where that pattern always does; apostrophes and special tokens are
    left alone. Arrow works on all distinct chunks of a batch at once. Any other tokenizer
    is given whole texts.
    """

    def __init__(self, path: str) -> None:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        kept = worker_cache("tokenizers")
        if path not in kept:
            tokenizer = Tokenizer.from_file(path)
            set_up = json.loads(tokenizer.to_str())
            steps = (set_up["pre_tokenizer"] or {}).get("pretokenizers", [{}])
            by_words = set_up["normalizer"] == NORMALIZER and steps[0].get("pattern") == {"Regex": WORDS} and steps[0]["invert"]
            ends = np.array([(tokenizer.id_to_token(i) or "").endswith(WORD_END) for i in range(tokenizer.get_vocab_size())])
            kept[path] = tokenizer, by_words and set_up["model"].get("end_of_word_suffix") == WORD_END, ends, {}, {}
        self.path, self.kept = path, kept

    def _learn(self, parts: list[str], single: bool) -> None:
        """Encode parts. Single words are given in lines of many, and told apart by the ids that end words."""
        tokenizer, _, ends, new, _ = self.kept[self.path]
        lines = [" ".join(parts[i : i + LINE]) for i in range(0, len(parts), LINE)] if single else parts
        found = [f.ids for f in tokenizer.encode_batch_fast(lines, add_special_tokens=False)]
        ids = np.fromiter(itertools.chain.from_iterable(found), "<u4")
        stops = np.flatnonzero(ends[ids]) + 1 if single else np.cumsum([len(f) for f in found])
        if len(stops) != len(parts):
            raise ValueError("the tokenizer forms other words than its file says")
        blob, start = ids.tobytes(), 0
        for part, stop in zip(parts, (4 * stops).tolist()):
            new[part] = blob[start:stop]
            start = stop

    def encoded(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all parts, one after another, and where each part's end."""
        single = _plain(parts).to_numpy(zero_copy_only=False).tolist()
        parts = parts.to_numpy(zero_copy_only=False).tolist()
        tokenizer, by_words, ends, new, old = self.kept[self.path]
        blobs = list(map(new.get, parts))
        missing = [i for i, b in enumerate(blobs) if b is None]
        again = [(parts[i], old.get(parts[i])) for i in missing]
        new.update((p, b) for p, b in again if b is not None)
        unseen = [i for i, (_, b) in zip(missing, again) if b is None]
        for kind in (True, False):
            self._learn([parts[i] for i in unseen if single[i] is kind], kind)
        for i in missing:
            blobs[i] = new[parts[i]]
        if len(new) > CACHE:
            self.kept[self.path] = tokenizer, by_words, ends, {}, new
        return np.frombuffer(b"".join(blobs), "<u4"), np.cumsum(np.fromiter(map(len, blobs), np.int64, len(blobs)) // 4)

    def chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same for distinct chunks."""
        apart = pc.ascii_trim_whitespace(pc.replace_substring_regex(pc.utf8_lower(chunks), BORDER, r" \1 "))
        lists = pc.ascii_split_whitespace(pc.if_else(_plain(chunks), apart, chunks))
        coded = lists.flatten().dictionary_encode()
        flat, ends = self.encoded(coded.dictionary)
        flat, after = _expanded(coded.indices.to_numpy(zero_copy_only=False), flat, ends)
        last = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
        return flat, np.concatenate([[0], after])[last]

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a batch, each text followed by the separator, and where texts begin."""
        if not self.kept[self.path][1]:
            found = self.kept[self.path][0].encode_batch_fast(pc.fill_null(texts, "").to_pylist(), add_special_tokens=False)
            ids = [np.array([*f.ids, SEPARATOR], np.uint32) for f in found]
            return np.concatenate([np.zeros(0, np.uint32), *ids]), np.cumsum([0, *map(len, ids)])
        lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.fill_null(texts, "")))
        offsets = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))])
        coded = lists.flatten().dictionary_encode()
        flat, ends = self.chunks(coded.dictionary)
        flat, ends = np.append(flat, np.uint32(SEPARATOR)), np.append(ends, len(flat) + 1)
        codes = np.insert(coded.indices.to_numpy(zero_copy_only=False), offsets[1:], len(ends) - 1)
        ids, after = _expanded(codes, flat, ends)
        return ids, np.concatenate([[0], after[offsets[1:] + np.arange(len(texts))]])


def _pieces(path: str, capacity: int, with_ids: bool):
    def run(batches):
        encoder = Encoder(path)
        for batch in (part for whole in batches for part in words.slices(whole, "text", ENCODE_BYTES)):
            ids, bounds = encoder.ids(batch.column("text"))
            sizes = np.diff(bounds)
            cuts = -(-sizes // capacity)
            row = np.repeat(np.arange(len(sizes)), cuts)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
            start = piece * capacity
            length = np.minimum(sizes[row] - start, capacity)
            at = bounds[row] + start
            view = memoryview(ids).cast("B")
            blobs = [view[4 * a : 4 * (a + n)] for a, n in zip(at.tolist(), length.tolist())]
            out = {
                "doc_id": batch.column("doc_id").take(pa.array(row)), "piece": piece.astype(np.int32), "start": start,
                "length": length, "ids_crc32": np.array([zlib.crc32(b) for b in blobs], np.int64),
            }
            if with_ids:
                out["ids"] = pa.array([bytes(b) for b in blobs], pa.binary())
            yield pa.RecordBatch.from_pydict(out)

    return run


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """The pieces of every document; ``with_ids`` adds their ids as little-endian bytes."""
    bounded_batches(docs.sparkSession, ENCODE_BYTES)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(_pieces(tokenizer, capacity, with_ids), PIECES + (", ids binary" if with_ids else ""))


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers: longest first, each into the fullest bin that takes it."""
    bins: list[list[int]] = []
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0  # bit r: some bin has room r
    for i in sorted(range(len(lengths)), key=lengths.__getitem__, reverse=True):
        n = lengths[i]
        fitting = mask >> n
        if fitting:
            r = n + (fitting & -fitting).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                mask ^= 1 << r
            bins[b].append(i)
        else:
            r, b = capacity, len(bins)
            bins.append([i])
        room[r - n].append(b)
        mask |= 1 << (r - n)
    return bins


def _exchange(target: list[int], source: list[int], lengths: list[int], gap: int):
    """What to give and take so that ``target`` gains most, by ``gap`` at most.

    The target is at least as full as the source, so every gain raises the sum of squares.
    """
    best, give, take = 0, (), ()
    for x, i in enumerate(source):
        n = lengths[i]
        if best < n <= gap:
            best, give, take = n, (i,), ()
        for t in target:
            if best < n - lengths[t] <= gap:
                best, give, take = n - lengths[t], (i,), (t,)
        for j in source[x + 1 :]:
            both = n + lengths[j]
            for t in target:
                if best < both - lengths[t] <= gap:
                    best, give, take = both - lengths[t], (i, j), (t,)
        if best == gap:
            break
    return give, take


def improve(bins: list[list[int]], lengths: list[int], capacity: int) -> list[list[int]]:
    """Local search over the underfull bins, as long as their room adds up to a bin.

    A source meets only bins that gain from it: which they are is worked out for all bins at
    once, from their gaps and pieces. Bins of more than ``WIDE`` pieces are always tried.
    """
    fill = np.array([sum(lengths[i] for i in b) for b in bins], np.int64)
    width = min(max(map(len, bins), default=1), WIDE)
    pieces = np.zeros((len(bins), width), np.int64)
    wide, low = np.zeros(len(bins), bool), np.zeros(len(bins), np.int64)

    def note(b: int) -> None:
        low[b] = min((lengths[i] for i in bins[b]), default=0)
        wide[b] = len(bins[b]) > width
        pieces[b] = 0
        pieces[b, : min(len(bins[b]), width)] = [lengths[i] for i in bins[b][:width]]

    def gains(own: list[int], found: np.ndarray) -> np.ndarray:
        sums = np.array(sorted({*own, *(a + b for a, b in itertools.combinations(own, 2))}))
        gap = (capacity - fill[found])[:, None]
        if gap.max() < min(own) and sums[-1] <= low[found].min():
            return np.zeros(len(found), bool)
        taken = pieces[found]
        able = (np.searchsorted(sums, taken + gap, "right") > np.searchsorted(sums, taken, "right")) & (taken > 0)
        return able.any(1) | (gap[:, 0] >= min(own)) | wide[found]

    order = lambda found: found[np.argsort(fill[found], kind="stable")]
    open_bins = order(np.flatnonzero(fill < capacity))
    room = int((capacity - fill[open_bins]).sum())
    if room >= capacity:
        for b in open_bins.tolist():
            note(b)
    tried = 0
    while room >= capacity and tried < len(open_bins):
        source, targets, at, moved = int(open_bins[tried]), open_bins[:tried:-1], 0, False
        while at < len(targets) and bins[source]:
            able = gains([lengths[i] for i in bins[source]], targets[at : at + STRETCH])
            if not able.any():
                at += len(able)
                continue
            at += int(able.argmax()) + 1
            target, before = int(targets[at - 1]), fill[source]
            while bins[source] and fill[target] < capacity and fill[target] >= fill[source]:
                give, take = _exchange(bins[target], bins[source], lengths, int(capacity - fill[target]))
                if not give:
                    break
                bins[target] = [t for t in bins[target] if t not in take] + list(give)
                bins[source] = [i for i in bins[source] if i not in give] + list(take)
                gain = sum(lengths[i] for i in give) - sum(lengths[t] for t in take)
                fill[target] += gain
                fill[source] -= gain
            if fill[source] != before:
                note(target)
                moved = True
        if bins[source]:
            note(source)
            tried += 1
        else:
            room -= capacity
            tried = 0
        if moved:
            open_bins = order(np.array([b for b in open_bins.tolist() if bins[b] and fill[b] < capacity], np.int64))
    return [b for b in bins if b]


def _packed(capacity: int):
    def run(batches):
        rows = pa.Table.from_batches(list(batches))
        if not rows.num_rows:
            return
        # The order of the rows decides nothing: they are put in order first.
        rows = rows.sort_by([("length", "descending"), ("item", "ascending")])
        lengths, group = rows["length"].to_pylist(), rows["group"][0].as_py()
        bins = improve(best_fit(lengths, capacity), lengths, capacity)
        order = np.array([i for b in bins for i in b])
        sizes = np.array([len(b) for b in bins])
        n = np.array(lengths)[order]
        before = np.cumsum(n) - n
        first = np.repeat(before[np.cumsum(sizes) - sizes], sizes)
        fill = np.add.reduceat(n, np.cumsum(sizes) - sizes)
        out = {
            "item": rows["item"].combine_chunks().take(pa.array(order)), "length": n, "group": np.full(len(n), group, np.int32),
            "bin": np.repeat(np.arange(len(bins), dtype=np.int32), sizes), "offset": before - first,
            "fill": np.repeat(fill, sizes),
        }
        yield from pa.Table.from_pydict(out).to_batches(max_chunksize=20_000)

    return run


def _round(items: DataFrame, n: int, capacity: int, group: int) -> tuple[DataFrame, int]:
    groups = max(1, math.ceil(n / group))
    dealt = items.withColumn("group", F.pmod(F.xxhash64(F.lit(n), "item"), F.lit(groups)).cast("int"))
    schema = "item bigint, length bigint, group int, bin int, offset bigint, fill bigint"
    packed = dealt.repartitionById(groups, F.col("group")).mapInArrow(_packed(capacity), schema)
    return written(packed, "packed"), groups


def pack(cut: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``. ``cut`` is computed once and written."""
    cut = written(cut.withColumn("item", F.monotonically_increasing_id()), "pieces")
    whole = cut.where(F.col("length") == capacity).select("item", (-1 - F.col("item")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    rest = cut.where(F.col("length") < capacity).select("item", "length")
    done, depth, n = [whole], 0, rest.count()
    while n:
        packed, groups = _round(rest, n, capacity, group)
        # A group has fewer than 2^20 bins and a round fewer than 2^31 groups.
        name = F.expr(f"shiftleft({depth + 1}L, 52) + shiftleft(cast(group as bigint), 20) + bin").alias("sequence_id")
        if groups == 1:
            done.append(packed.select("item", name, "offset"))
            break
        # Bins with more than 1/64 of room go to a round of all groups together.
        loose = F.col("fill") < capacity - capacity // 64
        left = packed.where(loose).count()
        if left > n - n // 10:  # what is left is too large to be combined, as a rule
            done.append(packed.select("item", name, "offset"))
            break
        done.append(packed.where(~loose).select("item", name, "offset"))
        rest, n, depth = packed.where(loose).select("item", "length"), left, depth + 1
    placed = done[0]
    for more in done[1:]:
        placed = placed.unionByName(more)
    return cut.join(placed, "item").drop("item")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Where every piece of every document goes."""
    return pack(pieces(docs, tokenizer, capacity), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """The ids of each sequence, from pieces that carry theirs; a sequence is bounded by its capacity."""
    parts = F.array_sort(F.collect_list(F.struct("offset", F.hex("ids").alias("hex"))))
    return packed.groupBy("sequence_id").agg(
        F.unhex(F.array_join(F.transform(parts, lambda x: x["hex"]), "")).alias("ids"), F.sum("length").alias("length")
    )
