"""Pattern matching as Column expressions: match lists with offsets.

Offsets are code-point positions, as everywhere in this package, and come from
splitting the text at its matches: the lengths of the pieces and of the matches
add up to the positions. All of it runs inside the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# What \w, \d and \s stand for in the pattern notation of ``domains``.
_WORD = r"\p{L}\p{N}_"
_CLASSES = {
    "w": (_WORD, f"[{_WORD}]"),
    "d": (r"\p{Nd}", r"\p{Nd}"),
    "s": (r"\p{IsWhite_Space}\x1c-\x1f", r"[\p{IsWhite_Space}\x1c-\x1f]"),
    "S": (r"", r"[^\p{IsWhite_Space}\x1c-\x1f]"),
    "b": ("", f"(?:(?<=[{_WORD}])(?![{_WORD}])|(?<![{_WORD}])(?=[{_WORD}]))"),
}
_BLOCK = 64


def java_pattern(pattern: str, ignore_case: bool = False) -> str:
    """Render a pattern of ``domains`` so Java's engine finds the same matches."""
    if pattern.replace(r"[\s\S]", "") != pattern:
        pattern = pattern.replace(r"[\s\S]", r"(?s:.)")
    out, in_class, i = [], False, 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\":
            nxt = pattern[i + 1]
            inside, outside = _CLASSES.get(nxt, (ch + nxt, ch + nxt))
            out.append(inside if in_class else outside)
            i += 2
            continue
        if ch == "[":
            in_class = True
        elif ch == "]":
            in_class = False
        out.append(ch)
        i += 1
    return ("(?iu)" if ignore_case else "") + "".join(out)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def literal(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


# Exclusive running sums of the array ``x``. Sums go block by block, so the cost
# stays near-linear in the array length even for a text with very many matches.
_RUNNING_SUMS = f"""
element_at(transform(array(
    transform(sequence(0, (size(x) - 1) DIV {_BLOCK}),
              k -> aggregate(slice(x, CAST(k * {_BLOCK} + 1 AS INT), {_BLOCK}), 0, (a, v) -> a + v))),
  s -> element_at(transform(array(
      transform(s, (q, k) -> aggregate(slice(s, 1, k), 0, (a, v) -> a + v))),
    t -> transform(x, (q, j) ->
      t[j DIV {_BLOCK}]
      + aggregate(slice(x, CAST((j DIV {_BLOCK}) * {_BLOCK} + 1 AS INT), j % {_BLOCK}), 0, (a, v) -> a + v))
  ), 1)
), 1)"""


def running_max(values: Column) -> Column:
    """For each of an array of numbers from 0 on, the largest before it (-1 for the first), block by block."""

    def within(tops: Column) -> Column:
        def at(heads: Column, j: Column) -> Column:
            block = F.floor(j / _BLOCK).cast("int")
            own = F.array_max(F.slice(values, block * _BLOCK + 1, j % _BLOCK))
            return F.greatest(F.get(heads, block), F.coalesce(own, F.lit(-1)))

        heads = F.transform(tops, lambda _, k: F.coalesce(F.array_max(F.slice(tops, F.lit(1), k)), F.lit(-1)))
        return let(heads, lambda h: F.transform(values, lambda _, j: at(h, j)))

    tops = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(values) - 1) / _BLOCK).cast("int")),
        lambda k: F.array_max(F.slice(values, k * _BLOCK + 1, F.lit(_BLOCK))),
    )
    return let(tops, within)


# ``m`` are the matches, ``w`` the widths of the pieces between them, ``b`` the
# widths of everything before each piece.
_SPANS = """
element_at(transform(array(regexp_extract_all({text}, {pattern}, 0)), m ->
  CASE WHEN size(m) > 0 THEN
    element_at(transform(array(transform(split({text}, {pattern}, -1), p -> length(p))), w ->
      element_at(transform(array(
        element_at(transform(array(
          zip_with(slice(w, 1, size(m)), m, (g, h) -> g + length(h))), x -> {sums}), 1)), b ->
        transform(m, (h, i) -> named_struct(
          'start', b[i] + w[i], 'end', b[i] + w[i] + length(h), 'text', h))
      ), 1)
    ), 1)
  END), 1)"""

SPAN_TYPE = "array<struct<start:int,end:int,text:string>>"


def spans_sql(text: str, pattern: str, guard: str | None = None) -> str:
    """SQL: every match of a Java pattern in a column, as ``SPAN_TYPE``.

    ``guard`` is a cheap necessary condition: where it is false the pattern is
    not run. Deep expressions such as this one are spelled in SQL, because
    building them call by call would cost more than running them on a small
    table.
    """
    body = _SPANS.format(text=text, pattern=literal(pattern), sums=_RUNNING_SUMS)
    if guard is not None:
        body = f"CASE WHEN {guard} THEN {body} END"
    return f"coalesce(CAST({body} AS {SPAN_TYPE}), CAST(array() AS {SPAN_TYPE}))"


def spans(text: str, pattern: str, guard: str | None = None) -> Column:
    return F.expr(spans_sql(text, pattern, guard))


def first_span_sql(text: str, pattern: str) -> str:
    """SQL: the first match as a struct of at, hit and n (the number of matches)."""
    p = literal(pattern)
    return (
        f"named_struct('at', length(split({text}, {p}, 2)[0]), "
        f"'hit', regexp_extract({text}, {p}, 0), 'n', regexp_count({text}, {p}))"
    )
