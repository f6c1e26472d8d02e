"""Text normalisation, decoding and folding over whole columns."""

from __future__ import annotations

import binascii
import functools
import re
import unicodedata
from urllib.parse import unquote_to_bytes

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwarden import domains as d
from siftwarden.functions.regex import java_pattern, literal

_SPACES = r"\t-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# White-space runs other than a lone blank: those are right as they are.
_SPACE_RUN = f" [ {_SPACES}]+|[{_SPACES}][ {_SPACES}]*"
_EDGE_SPACE = r"^ | $"
_STRIPPED = d.ZERO_WIDTH + d.BIDI_CONTROLS + d.VARIATION_SELECTORS
# translate() drops the characters that have no counterpart.
_TRANSLATE_FROM = d.HOMOGLYPHS_FROM + _STRIPPED
_TRANSLATE_TO = d.HOMOGLYPHS_TO

# Scripts in wide use whose characters are, with few exceptions, already in
# compatibility-composed form.
_QUICK_WINDOWS = ((0x00, 0x17F), (0x400, 0x52F), (0x3041, 0x3096), (0x4E00, 0x9FFF))


@functools.cache
def _unsettled_class() -> str:
    """A character class: texts without any such character are NFKC already."""
    runs: list[list[int]] = []
    for low, high in _QUICK_WINDOWS:
        for code in range(low, high + 1):
            ch = chr(code)
            if unicodedata.combining(ch) or not unicodedata.is_normalized("NFKC", ch):
                continue
            if runs and runs[-1][1] == code - 1:
                runs[-1][1] = code
            else:
                runs.append([code, code])
    settled = "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in runs if b > 0x7F)
    # ASCII is ruled out first, so it never walks through the ranges.
    return rf"[\x{{80}}-\x{{10ffff}}&&[^{settled}]]"


@functools.cache
def _combining_class() -> str:
    """A character class of all characters with a combining class."""
    runs: list[list[int]] = []
    for code in range(0x300, 0x1F000):
        if unicodedata.combining(chr(code)):
            if runs and runs[-1][1] == code - 1:
                runs[-1][1] = code
            else:
                runs.append([code, code])
    marks = "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in runs)
    return rf"[\x{{300}}-\x{{1f000}}&&[{marks}]]"


@functools.cache
def _decimal_digits() -> tuple[str, str]:
    """All decimal digits outside ASCII and their ASCII values."""
    pairs = [
        (chr(c), str(unicodedata.decimal(chr(c))))
        for c in range(0x80, 0x1FC00)
        if unicodedata.decimal(chr(c), None) is not None
    ]
    return "".join(p[0] for p in pairs), "".join(p[1] for p in pairs)


# Spark has no Unicode normal forms. The wrappers are made once per process,
# because a UDF needs a running session.
@functools.cache
def _form_udf(form: str):
    def apply(values: pa.Array) -> pa.Array:
        texts = values.to_pylist()
        return pa.array(
            [None if t is None else unicodedata.normalize(form, t) for t in texts], pa.string()
        )

    apply.__annotations__ = {"values": pa.Array, "return": pa.Array}
    return F.arrow_udf(apply, "string")


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def nfkc(text: Column) -> Column:
    """Compatibility composition. Only texts that need it travel to Python."""
    unsettled = F.when(~is_ascii(text) & text.rlike(_unsettled_class()), text)
    return F.coalesce(_form_udf("NFKC")(unsettled), text)


def fold_and_squeeze(text: Column) -> Column:
    """Drop invisible characters, fold look-alikes, squeeze white space."""
    folded = F.when(is_ascii(text), text).otherwise(
        F.translate(text, _TRANSLATE_FROM, _TRANSLATE_TO)
    )
    return F.regexp_replace(F.regexp_replace(folded, _SPACE_RUN, " "), _EDGE_SPACE, "")


def normalize(text: Column) -> Column:
    """The detection-time form of a text; applying it twice changes nothing."""
    return fold_and_squeeze(nfkc(text))


def normalized(df: DataFrame, name: str = "norm", text: str = "text") -> DataFrame:
    """Add the normalised text as a column of its own, made once a row.

    Exploded from an array of one, as the optimizer writes a plain expression out wherever
    it is read, before Python steps too.
    """
    return df.withColumn(name, F.explode(F.array(normalize(F.col(text)))))


def fold_blanks(text: Column) -> Column:
    """The form that the SQL of the queries can state: look-alikes folded, ASCII blanks squeezed, no compatibility forms."""
    squeezed = F.regexp_replace(F.translate(text, _TRANSLATE_FROM, _TRANSLATE_TO), r"[\t\n\f\r ]+", " ")
    return F.regexp_replace(squeezed, r"^\p{Zs}+|\p{Zs}+$", "")


def fold_diacritics(text: Column) -> Column:
    """Lower-cased text without diacritics (compatibility decomposition)."""
    unsettled = F.when(~is_ascii(text), text)
    plain = F.regexp_replace(_form_udf("NFKD")(unsettled), _combining_class(), "")
    return F.lower(F.coalesce(plain, text))


def fold_digits_sql(text: str) -> str:
    """SQL: decimal digits of any script as ASCII digits."""
    source, target = _decimal_digits()
    return f"translate({text}, '{source}', '{target}')"


def printable_ratio(text: Column) -> Column:
    """Share of printable characters; line breaks and tabs count as printable."""
    hidden = F.regexp_count(text, F.lit(r"[\p{C}\p{Z}&&[^ \n\r\t]]"))
    return (F.length(text) - hidden) / F.length(text)


def _possessive(pattern: str) -> str:
    # Nothing follows the run, so giving nothing back changes no match; it keeps
    # Java from recursing once per repetition on long runs.
    return java_pattern(pattern) + "+"


# A text without such a run hides nothing: a hex run is of the first kind too, and a
# percent run needs escapes to be decoded. (It may still have percent candidates.)
ANY_RUN = r"[A-Za-z0-9+/]{16}|%[0-9A-Fa-f]{2}"

RUNS = {
    "base64": java_pattern(d.BASE64_RUN),
    "hex": _possessive(d.HEX_RUN),
    "percent": _possessive(d.PERCENT_RUN),
}
VARIANT_TYPE = "array<struct<text:string,depth:int,encoding:string>>"
_VARIANT_ARROW = pa.struct([("text", pa.string()), ("depth", pa.int32()), ("encoding", pa.string())])


def _percent_bytes(run: str) -> bytes:
    if len(re.findall(d.PERCENT_ESCAPE, run)) < d.MIN_PERCENT_ESCAPES:
        raise ValueError("too few escapes")
    return unquote_to_bytes(run)


# Encoding, shape of its runs, and the bytes of a run (an error where it has none).
_ENCODINGS = (
    ("base64", d.BASE64_RUN, lambda run: binascii.a2b_base64(run + "=" * (-len(run) % 4), strict_mode=True)),
    ("hex", d.HEX_RUN, bytes.fromhex),
    ("percent", d.PERCENT_RUN, _percent_bytes),
)
_HIDDEN_CHARS = regex.compile(r"[\p{C}\p{Z}--[ \n\r\t]]", regex.V1)


# What SQL engines with RE2 take for hidden: code points that nobody has assigned are not.
_HIDDEN_ASSIGNED = regex.compile(r"[\p{Cc}\p{Cf}\p{Co}\p{Cs}\p{Z}--[ \n\r\t]]", regex.V1)


def _said(bytes_of, hidden_chars, run: str) -> str | None:
    """What a run says, None unless it is UTF-8 that can be read."""
    try:
        text = bytes_of(run).decode()
    except ValueError:
        return None
    hidden = len(hidden_chars.findall(text))
    return text if text not in ("", run) and len(text) - hidden >= d.MIN_PRINTABLE_RATIO * len(text) else None


def _peeled(texts: pd.Series, hidden_chars) -> pd.DataFrame:
    """One layer off a column of texts: (row, inner, encoding) in the order of rows, texts and encodings."""
    tables = []
    for rank, (encoding, shape, bytes_of) in enumerate(_ENCODINGS):
        runs = texts.reset_index(drop=True).str.findall(shape).explode().dropna()
        said = runs.map(functools.partial(_said, bytes_of, hidden_chars)).dropna()
        tables.append(pd.DataFrame({"at": said.index, "inner": said.array, "rank": rank, "encoding": encoding}))
    table = pd.concat(tables).sort_values(["at", "rank"], kind="stable")
    return table.assign(row=texts.index.to_numpy()[table["at"].to_numpy(int)])[["row", "inner", "encoding"]]


_FOLD = str.maketrans({**dict.fromkeys(_STRIPPED), **dict(zip(d.HOMOGLYPHS_FROM, d.HOMOGLYPHS_TO, strict=True))})


def _settled(texts: pd.Series) -> pd.Series:
    """``normalize`` of a column of texts."""
    return texts.str.normalize("NFKC").str.translate(_FOLD).str.replace(r"\s+", " ", regex=True).str.strip()


_BLANKS = " \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"  # \p{Zs}


def _settled_blanks(texts: pd.Series) -> pd.Series:
    """``fold_blanks`` of a column of texts."""
    return texts.str.translate(_FOLD).str.replace(r"[\t\n\f\r ]+", " ", regex=True).str.strip(_BLANKS)


# How decoded texts are judged and settled: as detectors read texts, or as the SQL of a query says it.
FORMS = {"detect": (_HIDDEN_CHARS, _settled), "sql": (_HIDDEN_ASSIGNED, _settled_blanks)}


def _variants(texts: pd.Series, depth: int, form: str = "detect") -> pd.DataFrame:
    """(row, text, depth, encoding): all layers of a column, as tables. A row's inner text counts once."""
    hidden_chars, settled = FORMS[form]
    met, layers = pd.DataFrame({"row": texts.index, "inner": texts.array, "encoding": None}), []
    for level in range(1, depth + 1):
        known = len(met)
        met = pd.concat([met, _peeled(texts, hidden_chars)]).drop_duplicates(["row", "inner"])
        fresh = met.iloc[known:]
        texts = settled(fresh.set_index("row")["inner"].astype(object))
        layers.append(fresh.assign(text=texts.array, depth=level))
    return pd.concat(layers).sort_values("row", kind="stable")


@functools.cache
def _hidden_udf(depth: int, form: str = "detect"):
    def apply(values: pa.Array) -> pa.Array:
        texts = values.to_pandas().dropna()
        found = _variants(texts, depth, form) if len(texts) else pd.DataFrame(columns=["row", "text", "depth", "encoding"])
        ends = np.searchsorted(found["row"].to_numpy(int), np.arange(len(values) + 1)).astype(np.int32)
        columns = [pa.array(found[f.name].to_list(), f.type) for f in _VARIANT_ARROW]
        return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(columns, fields=list(_VARIANT_ARROW)))

    apply.__annotations__ = {"values": pa.Array, "return": pa.Array}
    return F.arrow_udf(apply, VARIANT_TYPE)


def hidden_texts(text: Column, depth: int = d.MAX_DECODE_DEPTH, form: str = "detect") -> Column:
    """The texts hidden in a normalised text, up to ``depth`` layers down.

    Spark composes no Unicode forms, so layers cannot be peeled by its expressions alone:
    texts that hold a run, and only those, go through Python, a whole Arrow batch as one
    table per layer.
    """
    live = F.when(text.rlike(ANY_RUN), text)
    return F.coalesce(_hidden_udf(depth, form)(live), F.array().cast(VARIANT_TYPE))


# --- the same as SQL, for functions made in SQL ---------------------------------------

FORM_NAME = "siftwarden_form_{}"
HIDDEN_NAME = "siftwarden_hidden_texts"


def register_forms(spark) -> None:
    """Make the functions that the SQL below calls known to a session."""
    for form in ("NFKC", "NFKD"):
        spark.udf.register(FORM_NAME.format(form.lower()), _form_udf(form))
    spark.udf.register(HIDDEN_NAME, _hidden_udf(d.MAX_DECODE_DEPTH))


def normalize_sql(text: str) -> str:
    """``normalize`` of an SQL expression."""
    plain = f"octet_length({text}) = length({text})"
    unsettled = f"CASE WHEN NOT {plain} AND {text} RLIKE {literal(_unsettled_class())} THEN {text} END"
    composed = f"coalesce({FORM_NAME.format('nfkc')}({unsettled}), {text})"
    folded = f"CASE WHEN {plain} THEN {text} ELSE translate({composed}, {literal(_TRANSLATE_FROM)}, {literal(_TRANSLATE_TO)}) END"
    return f"regexp_replace(regexp_replace({folded}, {literal(_SPACE_RUN)}, ' '), {literal(_EDGE_SPACE)}, '')"


def fold_diacritics_sql(text: str) -> str:
    """``fold_diacritics`` of an SQL expression."""
    unsettled = f"CASE WHEN octet_length({text}) <> length({text}) THEN {text} END"
    plain = f"regexp_replace({FORM_NAME.format('nfkd')}({unsettled}), {literal(_combining_class())}, '')"
    return f"lower(coalesce({plain}, {text}))"


def hidden_texts_sql(text: str) -> str:
    """``hidden_texts`` of an SQL expression, of the usual depth."""
    return f"coalesce({HIDDEN_NAME}(CASE WHEN {text} RLIKE {literal(ANY_RUN)} THEN {text} END), CAST(array() AS {VARIANT_TYPE}))"
