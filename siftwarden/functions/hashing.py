"""Hashes that stand in for values, and the canonical JSON they are taken over."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftwarden.functions.regex import literal


def sha256_tag(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text.cast("binary"), 256))


def salted_hash(text: Column, salt: str) -> Column:
    return sha256_tag(F.concat(F.lit(salt), text))


def salted_hash_sql(text: str, salt: str) -> str:
    return f"concat('sha256:', sha2(CAST(concat({literal(salt)}, {text}) AS BINARY), 256))"


def genesis_hash() -> Column:
    return sha256_tag(F.lit(""))


def key_id(identity: Column) -> Column:
    return F.concat(F.lit("key_"), F.left(F.sha2(identity.cast("binary"), 256), F.lit(16)))


def chained_hash(prev_hash: Column, payload: Column) -> Column:
    return sha256_tag(F.concat(prev_hash, payload))


_SHORT_ESCAPES = {
    '"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f",
}


def json_string(text: Column) -> Column:
    """A JSON string literal with everything outside printable ASCII escaped."""
    short = F.create_map(*[F.lit(x) for pair in _SHORT_ESCAPES.items() for x in pair])

    def escape(ch: Column) -> Column:
        units = F.lower(F.hex(F.encode(ch, "UTF-16BE")))
        numeric = F.regexp_replace(units, "(.{4})", r"\\u$1")
        return F.coalesce(
            F.element_at(short, ch), F.when(ch.rlike("[^ -~]"), numeric).otherwise(ch)
        )

    escaped = F.when(
        text.rlike(r'[^ -~]|["\\]'), F.array_join(F.transform(F.split(text, ""), escape), "")
    ).otherwise(text)
    return F.coalesce(F.concat(F.lit('"'), escaped, F.lit('"')), F.lit("null"))


def json_array(items: Column) -> Column:
    """A compact JSON array of already rendered JSON values."""
    return F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))
