"""Redaction and the other content transformations.

Spans are found on the original text, merged where they overlap and replaced by
typed placeholders, all inside the row that holds the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwarden import domains as d
from siftwarden.functions.regex import let, running_max
from siftwarden.operators.detect import REDACTED_KINDS

_SPAN = "struct<start:int,end:int,label:string>"
_BLOCK = 4096
_FEW_SPANS = 32


def label_rank(label: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in d.LABEL_RANK.items() for x in pair])
    return F.coalesce(F.element_at(table, label), F.lit(0))


def raw_spans(text: str) -> Column:
    """All spans to redact, in scan order, overlaps included."""

    parts = [
        f"transform({kind.spans_sql(text)}, z -> named_struct('start', z.start, 'end', z.end, 'label', '{kind.label}'))"
        for kind in REDACTED_KINDS
    ]
    return F.expr(f"concat({', '.join(parts)})")


def merge_overlaps(spans: Column) -> Column:
    """Merge spans that overlap; touching spans stay apart.

    The label of the most sensitive span wins and the earlier one keeps it on a
    tie. A span opens an island where it begins at or after all ends before it, so
    the work grows with the number of spans, not with its square.
    """
    ordered = F.array_sort(
        F.transform(
            spans,
            lambda s, i: F.struct(
                s["start"].alias("start"), i.alias("pos"), s["end"].alias("end"), s["label"].alias("label"),
                label_rank(s["label"]).alias("rank"),
            ),
        )
    )

    def islands(o: Column, opens: Column) -> Column:
        def island(at: Column, k: Column) -> Column:
            stop = F.coalesce(F.get(opens, k + 1), F.size(o))
            own = F.slice(o, at + 1, stop - at)
            lead = F.array_max(F.transform(own, lambda z, i: F.struct(z["rank"], -i, z["label"].alias("label"))))["label"]
            return F.struct(
                F.get(o, at)["start"].alias("start"), F.array_max(F.transform(own, lambda z: z["end"])).alias("end"), lead.alias("label")
            ).cast(_SPAN)

        return F.transform(opens, island)

    def merged(o: Column) -> Column:
        ends = F.transform(o, lambda z: z["end"])
        return let(
            running_max(ends),
            lambda before: let(
                F.filter(F.sequence(F.lit(0), F.size(o) - 1), lambda i: F.get(o, i)["start"] >= F.get(before, i)),
                lambda opens: islands(o, opens),
            ),
        )

    return F.when(F.size(spans) <= 1, spans.cast(f"array<{_SPAN}>")).otherwise(let(ordered, merged))


def redaction_spans(text: str) -> Column:
    return let(raw_spans(text), merge_overlaps)


def replace_spans(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its typed placeholder.

    Positions count characters, which a UTF-8 string has to be walked for. A text with
    many spans is cut into blocks once, so that no piece is looked for from its beginning.
    """

    def rebuilt(part: Callable[[Column, Column], Column]) -> Column:
        def piece(span: Column, i: Column) -> Column:
            before = F.when(i == 0, F.lit(0)).otherwise(F.get(spans, i - 1)["end"])
            return F.concat(part(before, span["start"]), F.lit("[REDACTED:"), span["label"], F.lit("]"))

        tail = part(F.get(spans, F.size(spans) - 1)["end"], F.length(text))
        return F.concat(F.array_join(F.transform(spans, piece), ""), tail)

    def by_block(blocks: Column) -> Column:
        def part(a: Column, b: Column) -> Column:
            first = F.floor(a / _BLOCK).cast("int")
            last = F.floor((b - 1) / _BLOCK).cast("int")
            near = F.array_join(F.slice(blocks, first + 1, last - first + 1), "")
            return F.when(b > a, F.substring(near, (a - first * _BLOCK + 1).cast("int"), b - a)).otherwise("")

        return rebuilt(part)

    plain = rebuilt(lambda a, b: F.substring(text, a + 1, b - a))
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_BLOCK}}}"), F.lit(0))
    return (
        F.when(F.size(spans) == 0, text).when(F.size(spans) <= _FEW_SPANS, plain).otherwise(let(blocks, by_block))
    )


def record(spans: Column) -> Column:
    """What was replaced, without the values."""
    return F.struct(
        F.when(F.size(spans) > 0, "REDACT").otherwise("NONE").alias("transformation"),
        F.size(spans).alias("span_count"),
        F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))).alias("labels"),
        F.transform(
            spans,
            lambda s: F.struct(s["start"].alias("offset"), (s["end"] - s["start"]).alias("length")),
        ).alias("spans"),
    )


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``redacted`` and ``record`` to a table of texts."""
    spanned = df.withColumn("_spans", redaction_spans(text))
    return (
        spanned.withColumn("redacted", replace_spans(F.col(text), F.col("_spans")))
        .withColumn("record", record(F.col("_spans")))
        .drop("_spans")
    )


def redact_requests(messages: DataFrame, decisions: DataFrame) -> DataFrame:
    """Redact every message of the requests whose decision asks for it."""
    asked = decisions.select("txn_id", "transformation")
    joined = messages.join(asked, "txn_id", "left")
    # The span search sees null for the requests that stay as they are.
    wanted = F.when(F.col("transformation") == "REDACT", F.col("text"))
    out = joined.withColumn("_text", wanted)
    out = redact(out, "_text")
    return out.select(
        "txn_id", "turn", "role", F.coalesce("redacted", "text").alias("text"),
        F.coalesce("record.span_count", F.lit(0)).alias("span_count"),
    )


def merge_span_rows(spans: DataFrame, key: str) -> DataFrame:
    """Merge a table of spans (key, pos, start, end, label) by gaps and islands."""
    order = Window.partitionBy(key).orderBy("start", "pos")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = spans.withColumn(
        "opens", F.when(F.col("start") < reach, 0).otherwise(1)
    ).withColumn("island", F.sum("opens").over(order))
    strongest = F.struct(label_rank(F.col("label")), -F.col("start"), -F.col("pos"))
    return (
        islands.groupBy(key, "island")
        .agg(
            F.min("start").alias("start"),
            F.max("end").alias("end"),
            F.max_by("label", strongest).alias("label"),
        )
        .drop("island")
    )


# --- the other transformations ---------------------------------------------------------

CONTROL_CHARS = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
DELIMITERS = r"(?i)###\s*system\s*###|</?\s*(?:system|user|assistant)\s*>"


def truncate(text: Column, limit: int, marker: str = "[TRUNCATED]") -> Column:
    """Cut a text to a number of characters and say so."""
    return F.when(
        F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(marker))
    ).otherwise(text)


def sanitize(text: Column) -> Column:
    """Strip instruction delimiters and control characters."""
    return F.regexp_replace(F.regexp_replace(text, DELIMITERS, ""), CONTROL_CHARS, "")


def rewrite(text: Column, flagged: Column, replacement: str) -> Column:
    return F.when(flagged, F.lit(replacement)).otherwise(text)


def mask_value(value: Column, head: int = 4, tail: int = 4) -> Column:
    """Keep the ends of a value, hide letters and digits between them."""
    middle = F.length(value) - head - tail
    hidden = F.regexp_replace(F.substring(value, F.lit(head + 1), middle), r"[\p{L}\p{N}]", "*")
    return F.when(
        middle > 0, F.concat(F.left(value, F.lit(head)), hidden, F.right(value, F.lit(tail)))
    ).otherwise(F.regexp_replace(value, r"[\p{L}\p{N}]", "*"))


def mask(column: str) -> Column:
    """Mask every sensitive span of a text column in place."""
    text = F.col(column)

    def body(spans: Column) -> Column:
        def piece(span: Column, i: Column) -> Column:
            before = F.when(i == 0, F.lit(0)).otherwise(F.get(spans, i - 1)["end"])
            value = F.substring(text, span["start"] + 1, span["end"] - span["start"])
            return F.concat(F.substring(text, before + 1, span["start"] - before), mask_value(value))

        tail = F.substring(text, F.get(spans, F.size(spans) - 1)["end"] + 1, F.length(text))
        return F.when(F.size(spans) == 0, text).otherwise(
            F.concat(F.array_join(F.transform(spans, piece), ""), tail)
        )

    return let(redaction_spans(column), body)


def transform_all(
    df: DataFrame,
    kinds: set[str],
    text: str = "text",
    limit: int = 262144,
    flagged: Column | None = None,
    replacement: str = "[REMOVED BY POLICY]",
) -> DataFrame:
    """Apply the requested transformations in their fixed order to ``text``."""
    steps = {
        "TRUNCATE": lambda c: truncate(F.col(c), limit),
        "SANITIZE": lambda c: sanitize(F.col(c)),
        "REWRITE": lambda c: rewrite(
            F.col(c), flagged if flagged is not None else F.lit(False), replacement
        ),
        "REDACT": lambda c: let(redaction_spans(c), lambda s: replace_spans(F.col(c), s)),
        "MASK": mask,
    }
    for kind in d.TRANSFORMATION_ORDER:
        if kind in kinds:
            df = df.withColumn(text, steps[kind](text))
    return df
