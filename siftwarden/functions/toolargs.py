"""Looking into tool arguments: JSON paths, SQL statements, shell commands.

The policy checks forgive comments and doubled blanks; the detectors look at
the text as it stands. Both forms are offered.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftwarden import domains as d

_SPACES = r"[\p{IsWhite_Space}\x1c-\x1f]+"


def parsed(args: Column) -> Column:
    """Arguments as a variant; null where the JSON is broken."""
    return F.try_parse_json(args)


def path_number(variant: Column, path: str) -> Column:
    """The number at a path, null for anything that is not a JSON number."""
    kind = F.schema_of_variant(F.variant_get(variant, path, "variant"))
    number = F.try_variant_get(variant, path, "double")
    return F.when(kind.rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT|INT)"), number)


def path_flag(variant: Column, path: str) -> Column:
    """The boolean at a path, null for anything that is not a JSON boolean."""
    kind = F.schema_of_variant(F.variant_get(variant, path, "variant"))
    return F.when(kind == "BOOLEAN", F.try_variant_get(variant, path, "boolean"))


def path_text(variant: Column, path: str) -> Column:
    """The string at a path, null for anything that is not a JSON string."""
    kind = F.schema_of_variant(F.variant_get(variant, path, "variant"))
    return F.when(kind == "STRING", F.try_variant_get(variant, path, "string"))


def strip_sql_comments(sql: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(sql, r"--[^\n]*", " "), r"(?s)/\*.*?\*/", " ")


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{_SPACES}|{_SPACES}$", "")


def first_word(sql: Column) -> Column:
    return F.upper(F.get(F.split(_trimmed(sql), _SPACES, 2), F.lit(0)))


def unbounded_mutation(sql: Column) -> Column:
    upper = F.upper(sql)
    mutates = F.lit(False)
    for verb in d.MUTATING_VERBS:
        mutates = mutates | _trimmed(upper).startswith(verb)
    return mutates & ~upper.contains("WHERE")


def squeeze(command: Column) -> Column:
    return F.regexp_replace(F.lower(command), _SPACES, " ")


def has_shell_pattern(command: Column, names: Iterable[str]) -> Column:
    """Whether a lower-cased command contains a needle of one of the families."""
    found = F.lit(False)
    for name in names:
        for needle in d.SHELL_PATTERNS.get(name, ()):
            found = found | command.contains(needle)
    return found
