"""Leaks: protected texts and system prompts that show up in responses.

Finding thousands of protected texts in a large corpus is a substring join. It
is done without comparing every pair: both texts are normalised to tokens with
single blanks between them, so the inner tokens of a protected text (all but
its first and last, which may match only part of a token) appear in a leaking
text exactly as they are. One hashed run of inner tokens is the join key, and
the pairs that meet are checked in full. Runs are hashed in Arrow batches; up to
``MOST_KEYS`` keys lie in the tasks, so that only texts that offer one of them go on.
"""

from __future__ import annotations

import difflib
import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwarden import domains as d
from siftwarden.functions import text as tx
from siftwarden.functions.hashing import salted_hash_sql
from siftwarden.functions.regex import let
from siftwarden.operators.detect import ALL_TEXTS, finding_sql
from siftwarden.operators.variants import with_variants

GRAM = 3  # tokens per hashed run
WINDOW = 4  # runs per selection window
MOST_SHORT = 10_000  # protected texts of one or two tokens in one array; more are joined
CHARS = 8  # characters per hashed run where those are joined
MOST_KEYS = 100_000  # keys of protected texts that tasks hold; texts offer all of theirs where there are more
LONG = GRAM + WINDOW - 1  # inner tokens that guarantee a shared selected run


PART = 4 << 20  # bytes of text whose tokens are held at a time, or one longer text


def _grams(tokens: str, size: int) -> str:
    """SQL: hashes of all runs of ``size`` tokens, null where there are too few."""
    run = "xxhash64(" + ", ".join(f"{tokens}[i + {k}]" for k in range(size)) + ")"
    return f"CASE WHEN size({tokens}) >= {size} THEN transform(sequence(0, size({tokens}) - {size}), i -> {run}) END"


def _token_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each token of a column of texts, and how many each text has."""
    tokens = pc.split_pattern(texts, " ")
    coded = tokens.flatten().dictionary_encode()
    own = pd.util.hash_array(np.array(coded.dictionary.to_pylist(), object), categorize=False)
    return own[coded.indices.to_numpy()], pc.fill_null(pc.list_value_length(tokens), 0).to_numpy().astype(np.int64)


def _run_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """The hash of each run of ``size`` tokens, whatever texts they belong to."""
    n = max(len(hashes) - size + 1, 0)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out += hashes[k : k + n]
        out ^= out >> np.uint64(33)
        out *= np.uint64(0xFF51AFD7ED558CCD)
        out ^= out >> np.uint64(32)
    return out


def _parts(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``PART`` bytes each."""
    block = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64)) // PART
    edges = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(texts)]
    yield from ((a, b) for a, b in zip(edges, edges[1:]) if a < b)


def _offered(kinds: list[int], wanted: np.ndarray | None, keep: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The keys that texts offer for the kinds of protected texts at hand, each once a text; only ``wanted`` ones, if given.

    For a number of inner tokens these are all runs of so many tokens, for LONG the
    smallest hash of every window of ``WINDOW`` runs. Where a column ``held`` tells that
    the row is needed, it also comes with kind 0.
    """

    def rows(part: pa.RecordBatch, kind: int, own: np.ndarray, key: np.ndarray) -> pa.RecordBatch:
        which = pa.array(own)
        columns = [*(part.column(k).take(which) for k in keep), pa.array(np.full(len(own), kind, np.int32)), pa.array(key.view(np.int64))]
        return pa.RecordBatch.from_arrays(columns, names=[*keep, "kind", "key"])

    for batch in batches:
        for a, b in _parts(batch.column("text")):
            part = batch.slice(a, b - a)
            if "held" in keep:
                held = np.flatnonzero(pc.fill_null(pc.list_value_length(part.column("held")), 0).to_numpy())
                yield rows(part, 0, held, held)
            hashes, counts = _token_hashes(part.column("text"))
            row = np.repeat(np.arange(len(counts)), counts)
            left = np.repeat(np.cumsum(counts), counts) - np.arange(len(hashes))  # tokens up to the end of the text
            for kind in kinds:
                at = np.flatnonzero(left >= kind)
                runs = _run_hashes(hashes, min(kind, GRAM) if kind == LONG else kind)
                if kind == LONG and len(at):
                    runs = functools.reduce(np.minimum, [runs[k : len(runs) - WINDOW + 1 + k] for k in range(WINDOW)])
                if wanted is not None:
                    at = at[np.isin(runs[at], wanted)]
                own, key = row[at], runs[at]
                order = np.lexsort((key, own))
                own, key = own[order], key[order]
                new = np.ones(len(key), bool)
                new[1:] = (key[1:] != key[:-1]) | (own[1:] != own[:-1])
                yield rows(part, kind, own[new], key[new])


@functools.cache
def _inner_key():
    """The key of a protected text: the hash of its inner tokens, or the smallest of their runs where they are many."""

    def apply(texts: pa.Array) -> pa.Array:
        hashes, counts = _token_hashes(texts)
        keys, end = [], 0
        for n in counts.tolist():
            inner = hashes[end + 1 : end + n - 1]
            end += n
            if len(inner):
                keys.append(int(_run_hashes(inner, GRAM if len(inner) >= LONG else len(inner)).min().view(np.int64)))
            else:
                keys.append(None)
        return pa.array(keys, pa.int64())

    apply.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(apply, "bigint")


def protected_keys(protected: DataFrame) -> DataFrame:
    """(canary_id, canary, kind, key): the join key of each protected text.

    ``kind`` is 0 for texts without inner tokens (key: the text itself), the
    number of inner tokens where there are few, and LONG otherwise.
    """
    normal = protected.select("canary_id", tx.normalize(F.col("canary")).alias("canary")).where(
        F.col("canary") != ""
    )
    inner = F.greatest(F.size(F.split("canary", " ")) - 2, F.lit(0))
    keyed = normal.withColumn("kind", F.least(inner, F.lit(LONG))).withColumn(
        "key", F.coalesce(_inner_key()(F.col("canary")), F.xxhash64("canary"))
    )
    return keyed.select("canary_id", "canary", "kind", "key", F.length("canary").alias("width"))


def short_keys(short: DataFrame) -> DataFrame:
    """(canary_id, canary, kind, key) of texts looked for by their characters.

    The key is the run of ``CHARS`` characters that the fewest of the texts have, or the
    whole of a shorter text; ``kind`` is its length.
    """
    runs = " ".join(f"WHEN {k} THEN {_grams('_chars', k)}" for k in range(1, CHARS + 1))
    chars = short.select("canary_id", "canary", F.split("canary", "").alias("_chars"))
    each = chars.withColumn("kind", F.least(F.size("_chars"), F.lit(CHARS))).select(
        "canary_id", "canary", "kind", F.explode(F.array_distinct(F.expr(f"CASE kind {runs} END"))).alias("key")
    )
    often = each.groupBy("kind", "key").agg(F.count("*").alias("n"))
    return (
        each.join(often, ["kind", "key"])
        .groupBy("canary_id", "canary", "kind")
        .agg(F.min(F.struct("n", "key"))["key"].alias("key"))
    )


def numbered_texts(messages: DataFrame, decode: bool, keep: tuple[str, ...] = ()) -> DataFrame:
    """(txn_id, turn, vidx, decoded_depth, text): normalised texts and what they hide."""
    keys = ["txn_id", "turn", *keep]
    prepared = tx.normalized(messages).select(*keys, "norm")
    if not decode:
        return prepared.select(
            *keys, F.lit(0).alias("vidx"), F.lit(0).alias("decoded_depth"), F.col("norm").alias("text")
        )
    prepared = with_variants(prepared)
    return (
        prepared.select(*keys, F.posexplode_outer(F.expr(ALL_TEXTS)).alias("vidx", "v"))
        .where(F.col("v").isNotNull())
        .select(*keys, "vidx", F.col("v.depth").alias("decoded_depth"), F.col("v.text").alias("text"))
    )


def _with_short(texts: DataFrame, short: DataFrame) -> DataFrame:
    """Add ``held``: the protected texts of one or two tokens that a text holds, looked for in the row.

    Such texts are mostly a policy's own few; they are one array.
    """
    one = short.agg(F.collect_list(F.struct("canary_id", "canary")).alias("short")).withColumn("k", F.lit(1))
    held = F.filter("short", lambda c: F.col("text").contains(c["canary"]))
    return _placed(texts.withColumn("k", F.lit(1)).join(F.broadcast(one), "k"), held).drop("short", "k")


def _placed(texts: DataFrame, held: Column) -> DataFrame:
    """Add ``held``, each protected text with its first place in the text."""
    placed = lambda c: F.struct(c["canary_id"].alias("canary_id"), c["canary"].alias("canary"), (F.instr("text", c["canary"]) - 1).alias("start"))
    return texts.withColumn("held", F.transform(held, placed))


def _hits(texts: DataFrame) -> DataFrame:
    """One row for each protected text that a text holds."""
    rows = texts.select("txn_id", "turn", "vidx", "decoded_depth", F.explode("held").alias("c"))
    return rows.select("txn_id", "turn", "vidx", "decoded_depth", "c.canary_id", "c.canary", "c.start")


def _checked(messages: DataFrame, pairs: DataFrame, decode: bool) -> DataFrame:
    """Those of (txn_id, turn, vidx, canary_id, canary) whose text holds the protected text.

    Only messages with a candidate are normalised again, each once for all of them.
    """
    found = pairs.groupBy("txn_id", "turn").agg(F.collect_list(F.struct("vidx", "canary_id", "canary")).alias("_met"))
    texts = numbered_texts(messages.select("txn_id", "turn", "text").join(found, ["txn_id", "turn"]), decode, ("_met",))
    held = F.filter("_met", lambda c: (c["vidx"] == F.col("vidx")) & F.col("text").contains(c["canary"]))
    return _hits(_placed(texts, held))


def _many_short_hits(messages: DataFrame, short: DataFrame, decode: bool) -> DataFrame:
    """The same for any number of them: texts that share a run of characters, then looked for in full."""
    keys = short_keys(short)
    # At most CHARS kinds.
    kinds = sorted(r["kind"] for r in keys.select("kind").distinct().collect())
    chars = numbered_texts(messages, decode).withColumn("_chars", F.split("text", ""))
    parts = [f"coalesce(transform(array_distinct({_grams('_chars', k)}), k -> named_struct('kind', {k}, 'key', k)), array())" for k in kinds]
    offered = chars.select("txn_id", "turn", "vidx", F.explode(F.expr(f"concat({', '.join(parts)})")).alias("k")).select(
        "txn_id", "turn", "vidx", "k.kind", "k.key"
    )
    return _checked(messages, offered.join(keys, ["kind", "key"]), decode)


def _offers(texts: DataFrame, kinds: list[int], wanted: np.ndarray | None, keep: list[str]) -> DataFrame:
    fields = [*texts.select(*keep).schema.fields, *T.StructType.fromDDL("kind int, key bigint").fields]
    return texts.mapInArrow(functools.partial(_offered, kinds, wanted, keep), T.StructType(fields))


def _keyed_hits(messages: DataFrame, keys: DataFrame, kinds: list[int], decode: bool) -> DataFrame:
    """Texts that share a key with a protected text and hold it in full."""
    offered = _offers(numbered_texts(messages, decode), kinds, None, ["txn_id", "turn", "vidx"])
    # Spark broadcasts the protected side only if its size allows it; otherwise
    # the join is on the hashed key and adaptive execution splits hot keys.
    return _checked(messages, offered.join(keys, ["kind", "key"]), decode)


def _hits_at_once(messages: DataFrame, short: DataFrame | None, keys: DataFrame, kinds: list[int], decode: bool) -> DataFrame:
    """``_short_hits`` and ``_keyed_hits`` in one pass, which takes along the texts that offer a protected text's key."""
    wanted = np.array([r["key"] for r in keys.select("key").distinct().collect()], np.int64).view(np.uint64)
    texts = numbered_texts(messages, decode)
    keep = ["txn_id", "turn", "vidx", "decoded_depth", "text"]
    if short is not None:
        texts, keep = _with_short(texts, short), [*keep, "held"]
    met = _offers(texts, kinds, wanted, keep).join(keys, ["kind", "key"], "left")
    one = F.array(F.struct("canary_id", "canary", (F.instr("text", F.col("canary")) - 1).alias("start")))
    # Texts without a whole key hold none of the longer ones, as where they are joined again.
    found = F.when(F.contains("text", "canary") & F.col("txn_id").isNotNull() & F.col("turn").isNotNull(), one)
    return _hits(met.withColumn("held", found if short is None else F.when(F.col("kind") == 0, F.col("held")).otherwise(found)))


def canary_hits(messages: DataFrame, protected: DataFrame, decode: bool = True) -> DataFrame:
    """Which text holds which protected text, and where first.

    ``messages`` has (txn_id, turn, text), one row per key; ``protected`` has
    (canary_id, canary). One row per message and protected text: the first of
    the message's texts, decoded ones included, that holds it.
    """
    keys = protected_keys(protected)
    # At most LONG + 1 kinds.
    sizes = {r["kind"]: r["n"] for r in keys.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    kinds = sorted(sizes)
    short, longer, lengths = keys.where("kind = 0"), keys.where("kind > 0"), [k for k in kinds if k]
    few, found = 0 < sizes.get(0, 0) <= MOST_SHORT, []
    at_once = lengths and sum(sizes[k] for k in lengths) <= MOST_KEYS
    if at_once:
        found.append(_hits_at_once(messages, short if few else None, longer, lengths, decode))
    elif lengths or not kinds:
        found.append(_keyed_hits(messages, longer, lengths or [LONG], decode))
    if 0 in kinds and not few:
        found.append(_many_short_hits(messages, short, decode))
    elif 0 in kinds and not at_once:
        found.append(_hits(_with_short(numbered_texts(messages, decode), short)))
    held = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    return (
        held.where(F.col("start") >= 0)
        .groupBy("txn_id", "turn", "canary_id")
        .agg(F.min(F.struct("vidx", "decoded_depth", "start")).alias("first"), F.first("canary").alias("canary"))
        .select(
            "txn_id", "turn", "canary_id", "canary",
            F.col("first.decoded_depth").alias("decoded_depth"),
            F.col("first.start").alias("start"),
            (F.col("first.start") + F.length("canary")).alias("end"),
        )
    )


def canary_findings(hits: DataFrame, salt: str) -> DataFrame:
    found = finding_sql(
        "system_prompt_leak", "'CANARY_LEAK'", "1D", "'HIGH'", "'canary_token_v1'", "start", "end",
        salted_hash_sql("canary", salt), "NULL", "decoded_depth",
    )
    return _on_response(hits.select("txn_id", "turn", F.expr(found).alias("f")))


def _on_response(shaped: DataFrame) -> DataFrame:
    return shaped.select("txn_id", "turn", F.lit("response").alias("plane"), F.lit(0).alias("ord"), "f.*")


def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    out = []
    for x, y in zip(a, b, strict=True):
        out.append(difflib.SequenceMatcher(None, x, y).ratio())
    return pd.Series(out, dtype="float64")


def _may_resemble(a: Column, b: Column) -> Column:
    """Whether lengths and counts of each character allow a ratio at the floor; null where lengths do not."""

    def reaches(common: Column) -> Column:
        return 2 * common / (F.length(a) + F.length(b)) >= d.MIN_SIMILARITY

    def count(text: Column, ch: Column) -> Column:
        return F.length(text) - F.length(F.replace(text, ch, F.lit("")))

    shared = F.aggregate(
        F.array_distinct(F.split(a, "")), F.lit(0), lambda n, ch: n + F.least(count(a, ch), count(b, ch))
    )
    short = F.least(F.length(a), F.length(b))
    return F.when((short > 0) & reaches(short), reaches(shared))


def prompt_similarity(responses: DataFrame, prompts: DataFrame) -> DataFrame:
    """Responses that resemble their request's system prompt: (txn_id, ratio, n_chars).

    The exact ratio is costly, so only pairs whose lengths and whose counts of each
    character allow a ratio at the floor are measured.
    """
    measure = F.pandas_udf(_ratio, "double")
    pairs = responses.join(prompts, "txn_id").select(
        "txn_id", "turn",
        tx.normalize(F.col("text")).alias("a"), tx.normalize(F.col("system_prompt")).alias("b"),
    )
    # The optimizer writes out a and b wherever the condition names them; bound once,
    # a pair's texts are not normalised again for each character that is counted.
    both = F.struct("a", "b")
    return (
        pairs.where(let(both, lambda p: _may_resemble(p["a"], p["b"])))
        .withColumn("ratio", measure("a", "b"))
        .where(F.col("ratio") >= d.MIN_SIMILARITY)
        .select("txn_id", "turn", "ratio", F.length("a").alias("n_chars"), F.col("a").alias("norm"))
    )


def prompt_leak_findings(similar: DataFrame, salt: str) -> DataFrame:
    found = finding_sql(
        "system_prompt_leak", "'SYSTEM_PROMPT_LEAK'", "ratio",
        f"CASE WHEN ratio >= {d.HIGH_SIMILARITY} THEN 'HIGH' ELSE 'MEDIUM' END",
        "'system_prompt_similarity_v1'", "0", "n_chars", salted_hash_sql("norm", salt), "NULL",
    )
    return _on_response(similar.select("txn_id", "turn", F.expr(found).alias("f")))
