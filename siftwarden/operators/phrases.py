"""Topic phrases from a table: lists of any size, at the cost of one pass over each text.

``detect.topics`` tries every phrase on every text, which is right for the few phrases of
a policy. Here a text offers its runs of words instead, of as many words as some phrase
has, and the runs meet the phrases in an equi-join: time does not grow with the number of
phrases. A list of checked size is broadcast; a larger one is left to Spark's own choice.

A phrase is found as ``detect.topics`` finds it: without regard to case and diacritics,
bounded by word ends, its words apart by any white space. Per text and phrase the first
place is reported.

Cases: null texts and phrases are never found; a phrase that does not begin and end with
a letter, digit or underscore is not found, as no word ends there; repeated phrases of a
category count once; messages alike in all of txn_id, turn, plane and text are one; an
empty list or table finds nothing. The runs of a text are held while it is read, about a
hundred bytes for each of its words and each length of phrase; a run that a text repeats is
offered once.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwarden.functions import text as tx
from siftwarden.functions.hashing import salted_hash
from siftwarden.functions.regex import java_pattern
from siftwarden.operators.detect import VERSION

WORD = java_pattern(r"\w+")
GAP = java_pattern(r"\s+")
_WHOLE = java_pattern(r"^\w(?:[\s\S]*\w)?$")
BROADCAST_BYTES = 64 << 20
RUNS = 50_000  # runs given back at a time, and those of one text more
_WORDS, _GAPS, _ODD_GAP = re.compile(r"\w+"), re.compile(r"\s+"), re.compile(r"\s\s|[^\S ]")


def phrase_table(phrases: DataFrame) -> DataFrame:
    """(category, phrase) with the form that texts are compared in and its number of words."""
    form = F.regexp_replace(F.trim(tx.fold_diacritics(F.regexp_replace("phrase", GAP, " "))), GAP, " ")
    rows = phrases.select("category", "phrase", form.alias("form")).where(F.col("form").rlike(_WHOLE)).distinct()
    return rows.withColumn("words", F.regexp_count("form", F.lit(WORD)))


def _word_runs(lengths: list[int], keys: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each run of so many words of a text, at its first place there: as it is compared, as it stands if that differs, and where."""

    def table(kept: pa.RecordBatch, rows: list, forms: list, hits: list, starts: list, ends: list) -> pa.RecordBatch:
        which = pa.array(rows, pa.int64())
        found = [pa.array(forms, pa.string()), pa.array(hits, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())]
        return pa.RecordBatch.from_arrays([*(kept.column(k).take(which) for k in keys), *found], names=[*keys, "form", "hit", "start", "end"])

    for batch in batches:
        made = [], [], [], [], []
        for row, text in enumerate(batch.column("folded").to_pylist()):
            spans = [m.span() for m in _WORDS.finditer(text)]
            starts, ends = [a for a, _ in spans], [b for _, b in spans]
            # Nearly all texts have lone blanks only, and read as they are compared.
            odd = _ODD_GAP.search(text) is not None
            for k in lengths:
                runs = [text[a:b] for a, b in zip(starts, ends[k - 1 :])]
                forms = [_GAPS.sub(" ", r) for r in runs] if odd else runs
                first = dict(zip(reversed(forms), reversed(range(len(forms)))))
                at = list(first.values())
                made[0].extend([row] * len(at))
                made[1].extend(first)
                made[2].extend([runs[i] for i in at] if odd else [None] * len(at))
                made[3].extend([starts[i] for i in at])
                made[4].extend([ends[i + k - 1] for i in at])
            if len(made[0]) >= RUNS:
                yield table(batch, *made)
                made = [], [], [], [], []
        yield table(batch, *made)


def find_phrases(messages: DataFrame, phrases: DataFrame, salt: str, planes: tuple[str, ...] = ("input", "context")) -> DataFrame:
    """Findings of (category, phrase) rows in (txn_id, turn, plane, text): the first place of each phrase in each text.

    Runs one small job over the phrases, for their lengths and their size.
    """
    listed = phrase_table(phrases)
    about = listed.agg(
        F.array_sort(F.collect_set("words")).alias("lengths"),
        F.coalesce(F.sum(F.octet_length("form") + F.octet_length("phrase") + F.octet_length("category")), F.lit(0)).alias("bytes"),
    ).first()
    if about["bytes"] <= BROADCAST_BYTES:
        listed = F.broadcast(listed)
    texts = messages.where(F.col("plane").isin(*planes) & F.col("text").isNotNull())
    texts = texts.select("txn_id", "turn", "plane", tx.fold_diacritics(tx.normalize(F.col("text"))).alias("folded"))
    texts = texts.withColumn("text_hash", F.xxhash64("folded"))
    keys = ["txn_id", "turn", "plane", "text_hash"]
    fields = [*texts.select(*keys).schema.fields, *T.StructType.fromDDL("form string, hit string, start int, end int").fields]
    runs = texts.mapInArrow(functools.partial(_word_runs, about["lengths"] or [1], keys), T.StructType(fields))
    hits = runs.join(listed, "form")
    first = hits.groupBy("txn_id", "turn", "plane", "text_hash", "category", "phrase").agg(
        F.min(F.struct("start", "end", F.coalesce("hit", "form").alias("hit"))).alias("at")
    )
    return first.select(
        "txn_id", "turn", "plane", F.lit("topics").alias("detector_id"), F.lit(VERSION).alias("detector_version"), "category",
        F.lit(0.9).alias("score"), F.lit("MEDIUM").alias("confidence"), F.concat(F.lit("topic:"), "phrase").alias("pattern_id"),
        F.col("at.start").alias("start"), F.col("at.end").alias("end"), salted_hash(F.col("at.hit"), salt).alias("excerpt_hash"),
        F.lit(1).alias("match_count"), F.lit(0).alias("decoded_depth"), F.lit(None).cast("string").alias("pii_type"),
    )
