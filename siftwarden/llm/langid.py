"""Language identification of mixed-language text.

Script ranges narrow the candidate languages of every word; hashed letter n-grams
score the word in each of them; Viterbi decoding with a switching penalty labels
spans of words. A text's language is the one with most letters in its spans.

Languages are whatever labels the training rows carry. The model is fitted on about
``SAMPLE`` rows per label, chosen by a hash of the row's key; it holds
``BUCKETS`` floats (256 KB) per label, however many labels there are.

A word is scored only in the languages that its script admits. Texts are decoded in groups
of at most ``CELLS`` words times labels; a longer one in runs of that size, twice: once
forwards for the state at the start of each run, once backwards from run to run for the
path. Its answer is that of one pass.

Cases: a null text and a text without letters are ``und`` with score 0 and no spans;
without any training row every text is ``und``; rows without a key or label do not
train; repeated rows get the same answer each; further columns are kept as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwarden.llm import words
from siftwarden.llm.tables import BATCH_BYTES, bounded_batches

BUCKETS = 1 << 16
SAMPLE = 2000
CELLS = 1 << 24
ORDERS = (2, 3, 4)
SWITCH = 8.0
UNDETERMINED = "und"

# First and last code points of the scripts that tell languages apart.
SCRIPTS = (
    ("latin", 0x0041, 0x024F), ("greek", 0x0370, 0x03FF), ("cyrillic", 0x0400, 0x052F), ("armenian", 0x0530, 0x058F),
    ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x077F), ("devanagari", 0x0900, 0x097F), ("bengali", 0x0980, 0x09FF),
    ("gurmukhi", 0x0A00, 0x0A7F), ("gujarati", 0x0A80, 0x0AFF), ("tamil", 0x0B80, 0x0BFF), ("telugu", 0x0C00, 0x0C7F),
    ("kannada", 0x0C80, 0x0CFF), ("malayalam", 0x0D00, 0x0D7F), ("sinhala", 0x0D80, 0x0DFF), ("thai", 0x0E00, 0x0E7F),
    ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF), ("latin", 0x1E00, 0x1EFF), ("greek", 0x1F00, 0x1FFF),
    ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7AF),
)
SCRIPT_NAMES = sorted({name for name, _, _ in SCRIPTS}) + ["other"]
SPANS = "array<struct<first_word: int, last_word: int, lang: string>>"
ANSWER = f"struct<lang_pred: string, score: double, spans: {SPANS}>"


def letter_words(texts: pa.Array):
    """The lower-cased runs of letters of each text, as ``words.split_words`` gives them."""
    plain = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), pattern=r"[^\p{L}]+", replacement=" ")
    return words.split_words(plain)


def features(distinct: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """N-gram buckets of distinct words, the word each bucket belongs to, and each word's script."""
    if not len(distinct):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    chars = np.frombuffer((" " + " ".join(distinct) + " ").encode("utf-32-le"), np.uint32)
    space = chars == 32
    owner = np.cumsum(space) - 1  # the word after the last blank
    found, owners = [], []
    for order in ORDERS:
        n = len(chars) - order + 1
        if n <= 0:
            continue
        h, whole = np.full(n, order, np.uint64), np.ones(n, bool)
        for j in range(order):
            h = h * np.uint64(0x9E3779B97F4A7C15) + chars[j : n + j]
            if 0 < j < order - 1:
                whole &= ~space[j : n + j]
        found.append((words.mixed(h[whole]) % np.uint64(BUCKETS)).astype(np.int64))
        owners.append(owner[1 : n + 1][whole] if order > 2 else owner[:n][whole])
    first = chars[np.flatnonzero(space)[:-1] + 1]
    script = np.full(len(first), len(SCRIPT_NAMES) - 1)
    for name, low, high in SCRIPTS:
        script[(first >= low) & (first <= high)] = SCRIPT_NAMES.index(name)
    return np.concatenate(found), np.concatenate(owners), script


def _counted(batches):
    """Feature counts of each label in each batch; scripts come after the buckets."""
    for batch in (part for whole in batches for part in words.slices(whole, "text", BATCH_BYTES)):
        codes, distinct, offsets = letter_words(batch.column("text"))
        bucket, owner, script = features(distinct)
        labels = batch.column("label").dictionary_encode()
        row = np.repeat(labels.indices.to_numpy(zero_copy_only=False), np.diff(offsets))
        for i, label in enumerate(labels.dictionary.to_pylist()):
            times = np.bincount(codes[row == i], minlength=len(distinct)).astype(float)
            n = np.bincount(bucket, times[owner], BUCKETS)
            n = np.concatenate([n, np.bincount(script, times, len(SCRIPT_NAMES))])
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"label": [label] * len(at), "bucket": at.astype(np.int32), "n": n[at].astype(np.int64)})


class Model:
    """Log-probabilities of buckets by language, and which languages each script admits."""

    def __init__(self, labels: list[str], counts: np.ndarray) -> None:
        self.labels = labels
        grams, scripts = counts[:BUCKETS], counts[BUCKETS:]
        self.scores = (np.log((grams + 0.5) / (grams.sum(0) + 0.5 * BUCKETS)) / len(ORDERS)).astype(np.float32)
        share = scripts / np.maximum(scripts.sum(0), 1)
        self.admits = share >= 0.01
        self.admits[~self.admits.any(1)] = True  # a script that no language is known to use excludes none


def fit(rows: DataFrame, label: str, text: str, key: str, sample: int = SAMPLE) -> Model:
    """A model from labelled rows; ``sample`` bounds the expected rows taken per label."""
    bounded_batches(rows.sparkSession)
    rows = rows.select(F.col(label).alias("label"), F.col(text).alias("text"), F.xxhash64(key).alias("h")).where(
        "label is not null and text is not null"
    )
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model([], np.zeros((BUCKETS + len(SCRIPT_NAMES), 0)))
    span = float(1 << 40)
    rates = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, sample / n) * span)])
    chosen = rows.where(F.pmod("h", F.lit(1 << 40)) < rates[F.col("label")])
    counts = (
        chosen.select("label", "text").mapInArrow(_counted, "label string, bucket int, n bigint")
        .groupBy("label", "bucket").agg(F.sum("n").alias("n")).toPandas()
    )
    labels = sorted(sizes)
    table = np.zeros((BUCKETS + len(SCRIPT_NAMES), len(labels)))
    table[counts["bucket"], np.searchsorted(labels, counts["label"])] = counts["n"]
    return Model(labels, table)


def word_scores(distinct: np.ndarray, model: Model) -> np.ndarray:
    """Score of each word in each language; one that its script bars stands 100 below the worst that it admits."""
    bucket, owner, script = features(distinct)
    table = np.full((len(distinct), len(model.labels)), np.inf, np.float32)
    for k in range(len(model.labels)):
        admits = model.admits[script, k]
        if admits.all():
            table[:, k] = np.bincount(owner, model.scores[bucket, k], len(distinct))
        elif admits.any():
            on = admits[owner]
            table[admits, k] = np.bincount(owner[on], model.scores[bucket[on], k], len(distinct))[admits]
    barred = np.isinf(table)
    if barred.any():
        worst = np.where(barred, np.inf, table).min(1, keepdims=True) - np.float32(100)
        table = np.where(barred, worst, table)
    return table


def viterbi(scores: np.ndarray, offsets: np.ndarray, penalty: float) -> np.ndarray:
    """The best label of each word when every change of label within a row costs ``penalty``.

    All rows of the batch advance together, longest first, one word a step.
    """
    n, lengths = len(scores), np.diff(offsets)
    if not n:
        return np.zeros(0, np.int32)
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = offsets[:-1][order], lengths[order]
    active = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), side="right")
    moved, source = np.zeros(scores.shape, bool), np.zeros(n, np.int32)
    best = scores[starts[: active[0]]].astype(np.float32)
    last = np.zeros(len(starts), np.int32)
    for t in range(1, len(active)):
        m = active[t]
        if m < len(best):
            last[m : len(best)] = best[m:].argmax(1)
            best = best[:m]
        at = starts[:m] + t
        source[at] = best.argmax(1)
        change = best.max(1, keepdims=True) - np.float32(penalty)
        moved[at] = change > best
        best = np.maximum(best, change) + scores[at]
    last[: len(best)] = best.argmax(1)
    path = np.zeros(n, np.int32)
    for t in range(len(active) - 1, -1, -1):
        m = active[t]
        at = starts[:m] + t
        path[at] = last[:m]
        if t:
            last[:m] = np.where(moved[at, last[:m]], source[at], last[:m])
    return path


def _forward(best: np.ndarray, scores: np.ndarray, penalty: float, moved=None, source=None) -> np.ndarray:
    """The best scores by last label after the words, from those before them; null ``best``: the text begins."""
    for t, own in enumerate(scores):
        if best is None:
            best = own.astype(np.float32)
            continue
        change = best.max() - np.float32(penalty)
        if moved is not None:
            source[t] = best.argmax()
            moved[t] = change > best
        best = np.maximum(best, change) + own
    return best


def in_runs(codes: np.ndarray, scored, penalty: float, run: int) -> np.ndarray:
    """What ``viterbi`` gives for one text, holding the scores of ``run`` words at a time; ``scored`` maps codes to scores."""
    starts, before, best = range(0, len(codes), run), [], None
    for at in starts:
        before.append(best)
        best = _forward(best, scored(codes[at : at + run]), penalty)
    path, label = np.zeros(len(codes), np.int32), int(best.argmax())
    for at, best in zip(reversed(starts), reversed(before)):
        scores = scored(codes[at : at + run])
        moved, source = np.zeros(scores.shape, bool), np.zeros(len(scores), np.int32)
        _forward(best, scores, penalty, moved, source)
        for t in range(len(scores) - 1, -1, -1):
            path[at + t] = label
            if moved[t, label]:
                label = source[t]
    return path


def decode(codes: np.ndarray, distinct: np.ndarray, offsets: np.ndarray, model: Model, penalty: float) -> np.ndarray:
    """The label of each word of each text, with at most about ``CELLS`` scores at a time."""
    run = max(1, CELLS // max(1, len(model.labels)))
    if len(codes) <= run:
        return viterbi(word_scores(distinct, model)[codes], offsets, penalty)

    def scored(part: np.ndarray) -> np.ndarray:
        own, at = np.unique(part, return_inverse=True)
        return word_scores(distinct[own], model)[at]

    paths, first = [], 0
    while first < len(offsets) - 1:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + run, side="right")) - 1)
        part = codes[offsets[first] : offsets[last]]
        whole = len(part) <= run
        paths.append(viterbi(scored(part), offsets[first : last + 1] - offsets[first], penalty) if whole else in_runs(part, scored, penalty, run))
        first = last
    return np.concatenate(paths)


def label_texts(texts: pa.Array, model: Model, penalty: float) -> pa.Array:
    """Language, share of letters in it, and spans of each text."""
    codes, distinct, offsets = letter_words(texts)
    if not model.labels:
        codes, offsets = codes[:0], np.zeros_like(offsets)
    path = decode(codes, distinct, offsets, model, penalty)
    letters = np.array([len(w) for w in distinct], np.float64)
    row = np.repeat(np.arange(len(texts)), np.diff(offsets))
    names = len(model.labels)
    held = np.bincount(row * max(names, 1) + path, letters[codes], len(texts) * max(names, 1)).reshape(len(texts), -1)
    total = held.sum(1)
    winner = held.argmax(1)
    named = np.array([*model.labels, UNDETERMINED], dtype=object)
    new = np.ones(len(path), bool)
    new[1:] = (path[1:] != path[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    ends = np.append(first[1:], len(path)) - 1
    spans = pa.StructArray.from_arrays(
        [
            pa.array((first - offsets[row[first]]).astype(np.int32)), pa.array((ends - offsets[row[first]]).astype(np.int32)),
            pa.array(named[path[first]], pa.string()),
        ],
        ["first_word", "last_word", "lang"],
    )
    bounds = np.searchsorted(row[first], np.arange(len(texts) + 1)).astype(np.int32)
    return pa.StructArray.from_arrays(
        [
            pa.array(named[np.where(total > 0, winner, names)], pa.string()),
            pa.array(np.where(total > 0, held.max(1) / np.maximum(total, 1), 0.0)),
            pa.ListArray.from_arrays(pa.array(bounds), spans),
        ],
        ["lang_pred", "score", "spans"],
    )


def identify(df: DataFrame, model: Model, text: str = "text", penalty: float = SWITCH) -> Column:
    """A struct column: ``lang_pred``, ``score`` and ``spans`` (of word numbers) of the text."""
    bounded_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(ANSWER)
    def answer(texts: pa.Array) -> pa.Array:
        return words.sliced(texts, BATCH_BYTES, lambda part: label_texts(part, shared.value, penalty))

    return answer(df[text])


def held_out(key: Column) -> Column:
    """The fifth of the rows that no model learns from."""
    return F.coalesce(F.crc32(key.cast("string")) % 5 == 0, F.lit(False))


def fit_documents(docs: DataFrame) -> Model:
    """The model of the documents table, from rows that are not held out."""
    return fit(docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))), "lang", "text", "doc_id")
