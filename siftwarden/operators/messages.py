"""Requests as message tables: one row per message, with its inspection plane."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwarden import domains as d
from siftwarden.functions.hashing import json_string


def plane_of(role: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in d.ROLE_PLANE.items() for x in pair])
    return F.coalesce(F.element_at(table, role), F.lit(d.DEFAULT_PLANE))


def from_turns(turns: DataFrame) -> DataFrame:
    """A flat turn table (conv_id, turn, role, text) as messages."""
    return turns.select(
        F.col("conv_id").alias("txn_id"),
        "turn",
        "role",
        plane_of(F.col("role")).alias("plane"),
        F.coalesce("text", F.lit("")).alias("text"),
    )


def from_requests(requests: DataFrame) -> DataFrame:
    """Nested requests (txn_id, messages array of role and content) as messages.

    Content is a variant or a string. Null content counts as empty text; content
    of any other type is not text and its message is left out here (it is a
    finding of ``scan_message_schema``).
    """
    rows = requests.select("txn_id", F.posexplode("messages").alias("turn", "m"))
    rows = rows.select(
        "txn_id", F.col("turn").cast("bigint").alias("turn"),
        F.col("m.role").alias("role"), F.col("m.content").alias("content"),
    )
    if dict(rows.dtypes)["content"] == "variant":
        kind = F.schema_of_variant("content")
        rows = rows.where(F.col("content").isNull() | kind.isin("STRING", "VOID")).withColumn(
            "content", F.try_variant_get("content", "$", "string")
        )
    return rows.select(
        "txn_id",
        "turn",
        "role",
        plane_of(F.col("role")).alias("plane"),
        F.coalesce("content", F.lit("")).alias("text"),
    )


def system_prompts(messages: DataFrame) -> DataFrame:
    """The first system message of each request."""
    return (
        messages.where(F.col("role") == "system")
        .groupBy("txn_id")
        .agg(F.min_by("text", "turn").alias("system_prompt"))
    )


def responses(messages: DataFrame) -> DataFrame:
    """The last assistant message of each request, read as its response."""
    return (
        messages.where(F.col("role") == "assistant")
        .groupBy("txn_id")
        .agg(F.max_by("text", "turn").alias("text"), F.max("turn").alias("turn"))
        .withColumn("plane", F.lit("response"))
    )


def _utf8_json_string(text: Column) -> Column:
    # The size counts UTF-8 bytes, so only quotes, backslashes and control
    # characters grow; everything else stays as it is.
    widened = F.regexp_replace(text, r'["\\\n\r\t\x08\x0c]', "zz")
    return F.regexp_replace(widened, r"[\x00-\x1f]", "zzzzzz")


def payload_bytes(messages: DataFrame) -> DataFrame:
    """UTF-8 size of the JSON document ``{"messages": [{"role": .., "content": ..}, ..]}``."""
    per_message = (
        F.octet_length(F.lit('{"role": "", "content": ""}'))
        + F.octet_length(_utf8_json_string(F.col("role")))
        + F.octet_length(_utf8_json_string(F.col("text")))
    )
    frame = len('{"messages": []}')
    return messages.groupBy("txn_id").agg(
        (F.sum(per_message) + 2 * (F.count("*") - 1) + frame).alias("payload_bytes")
    )


def material_text(messages: DataFrame, tools: Column | None = None) -> DataFrame:
    """Canonical JSON of each request's (role, content) list and tools.

    One request is one document by definition, so its messages are collected;
    the size of a request is bounded by the payload limit upstream.
    """
    item = F.concat(
        F.lit('{"content":'), json_string(F.col("text")),
        F.lit(',"role":'), json_string(F.col("role")), F.lit("}"),
    )
    ordered = F.array_sort(F.collect_list(F.struct("turn", item.alias("item"))))
    body = F.array_join(F.transform(ordered, lambda x: x["item"]), ",")
    tool_text = F.coalesce(tools if tools is not None else F.lit(None), F.lit("[]"))
    return messages.groupBy("txn_id").agg(
        F.concat(F.lit('{"messages":['), body, F.lit('],"tools":'), F.max(tool_text), F.lit("}")).alias(
            "material"
        )
    )
