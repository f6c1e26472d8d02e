"""Detectors: message tables in, findings tables out.

A detector is a column expression that yields an array of findings for one
text. All detectors of a run are laid side by side over the same row and the
arrays are exploded once, so a text is read once whatever the number of
detectors, and nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwarden import domains as d
from siftwarden.functions import net
from siftwarden.functions import text as tx
from siftwarden.functions.hashing import salted_hash_sql
from siftwarden.functions.regex import first_span_sql, java_pattern, literal, spans_sql
from siftwarden.operators.variants import with_variants

FINDING_TYPE = (
    "struct<detector_id:string,detector_version:string,category:string,score:double,"
    "confidence:string,pattern_id:string,start:int,end:int,excerpt_hash:string,"
    "match_count:int,decoded_depth:int,pii_type:string>"
)
VERSION = "1.0.0"


NO_FINDINGS = f"CAST(array() AS array<{FINDING_TYPE}>)"


def quote(value: str | None) -> str:
    return "NULL" if value is None else literal(value)


def finding_sql(
    detector: str,
    category: str,
    score: str,
    confidence: str,
    pattern_id: str = "NULL",
    start: str = "NULL",
    end: str = "NULL",
    excerpt_hash: str = "NULL",
    match_count: str = "1",
    depth: str = "0",
    pii_type: str = "NULL",
) -> str:
    """SQL: one finding. All arguments but the detector's name are SQL."""
    return (
        f"CAST(named_struct('detector_id', {quote(detector)}, 'detector_version', '{VERSION}', "
        f"'category', {category}, 'score', {score}, 'confidence', {confidence}, "
        f"'pattern_id', {pattern_id}, 'start', {start}, 'end', {end}, "
        f"'excerpt_hash', {excerpt_hash}, 'match_count', {match_count}, "
        f"'decoded_depth', {depth}, 'pii_type', {pii_type}) AS {FINDING_TYPE})"
    )


@dataclass(frozen=True)
class DetectorSpec:
    """A detector: the planes it reads and its expression over a prepared row.

    The expression sees the columns ``plane``, ``norm`` (normalised text),
    ``folded`` (without diacritics), ``variants`` (decoded texts) and
    ``internal_urls``.
    """

    id: str
    planes: frozenset[str]
    findings: Callable[[str], str]  # salt -> SQL of an array of findings
    version: str = VERSION


# --- personal data -----------------------------------------------------------


def _has(pattern: str) -> str:
    return "{t} RLIKE " + literal(pattern).replace("{t}", "{{t}}")


@dataclass(frozen=True)
class ValueKind:
    """A kind of value found by shape: pattern, cheap guard, exact check."""

    name: str
    label: str | None
    pattern_id: str
    pattern: str
    guard: str  # necessary condition in SQL over {t}
    accept: str | None = None  # exact check in SQL over {v}
    score: float = 0.9
    confidence: str = "HIGH"

    def spans_sql(self, text: str) -> str:
        found = spans_sql(text, self.pattern, self.guard.replace("{t}", text))
        if self.accept is None:
            return found
        return f"filter({found}, c -> {self.accept.replace('{v}', 'c.text')})"

    def spans(self, text: str) -> Column:
        return F.expr(self.spans_sql(text))


LUHN = "luhn_check(" + tx.fold_digits_sql("regexp_replace({v}, '[ -]', '')") + ")"
OCTETS = f"forall(split({tx.fold_digits_sql('{v}')}, '[.]'), o -> CAST(o AS INT) <= 255)"

EMAIL = ValueKind(
    "email", "EMAIL", "email_v1", java_pattern(d.EMAIL), "contains({t}, '@')"
)
PHONE = ValueKind(
    "phone", "PHONE", "phone_e164_v1", java_pattern(d.PHONE), "contains({t}, '+')",
    f"regexp_count({{v}}, '\\\\p{{Nd}}') >= {d.MIN_PHONE_DIGITS}",
)
SSN = ValueKind(
    "ssn", "SSN", "ssn_v1", java_pattern(d.SSN),
    _has(r"\p{Nd}[- .]\p{Nd}{2}[- .]\p{Nd}"),
)
CARD = ValueKind(
    "credit_card", "CREDIT_CARD", "credit_card_luhn_v1", java_pattern(d.CARD),
    _has(r"(?:\p{Nd}[ -]?){13}"), LUHN,
)
IBAN = ValueKind(
    "iban", "IBAN", "iban_v1", java_pattern(d.IBAN, ignore_case=True),
    _has(r"(?iu)[A-Z]{2}\p{Nd}{2}[ ]?[A-Z0-9]"), None, 0.8, "MEDIUM",
)
IP = ValueKind(
    "ip_address", None, "ip_address_v1", java_pattern(d.IP),
    _has(r"\p{Nd}\.\p{Nd}"),
    OCTETS, 0.6, "LOW",
)
PII_KINDS = {k.name: k for k in (EMAIL, PHONE, SSN, CARD, IBAN, IP)}


def _value_findings(
    detector: str, kinds: Iterable[ValueKind], inbound: str, outbound: str, salt: str, typed: bool
) -> str:
    category = f"CASE WHEN plane = 'response' THEN '{outbound}' ELSE '{inbound}' END"

    def of_kind(kind: ValueKind) -> str:
        found = finding_sql(
            detector, category, f"{kind.score}D", quote(kind.confidence), quote(kind.pattern_id),
            "z.start", "z.end", salted_hash_sql("z.text", salt),
            pii_type=quote(kind.name if typed else None),
        )
        return f"transform({kind.spans_sql('norm')}, z -> {found})"

    return f"concat({', '.join(of_kind(kind) for kind in kinds)})"


def pii(kinds: Iterable[str] = tuple(PII_KINDS)) -> DetectorSpec:
    chosen = [PII_KINDS[k] for k in kinds]
    return DetectorSpec(
        "pii",
        frozenset({"input", "context", "response"}),
        lambda salt: _value_findings("pii", chosen, "PII_DETECTED", "OUTPUT_PII", salt, True),
    )


# --- secrets -----------------------------------------------------------------


# Shannon entropy of the characters of a text, in bits per character.
_SHARE = "((length({v}) - length(replace({v}, ch, ''))) / length({v}))"
ENTROPY = (
    "aggregate(array_distinct(split({v}, '')), CAST(0 AS DOUBLE), "
    f"(acc, ch) -> acc - {_SHARE} * log2({_SHARE}))"
)


AWS_KEY = ValueKind(
    "aws_access_key", "AWS_ACCESS_KEY", "aws_access_key_v1", java_pattern(d.AWS_ACCESS_KEY),
    _has(r"A[KS]IA[A-Z0-9]"),
)
PROVIDER_KEY = ValueKind(
    "provider_key", "PROVIDER_API_KEY", "provider_key_v1", java_pattern(d.PROVIDER_KEY),
    _has(r"sk-|gsk_|ghp_"),
)
PEM = ValueKind(
    "pem_block", "PEM_PRIVATE_KEY", "pem_private_key_v1", java_pattern(d.PEM_BLOCK),
    "contains({t}, 'PRIVATE KEY-----')",
)
JWT = ValueKind(
    "jwt", "JWT", "jwt_v1", java_pattern(d.JWT), "contains({t}, 'eyJ')"
)
HIGH_ENTROPY = ValueKind(
    "high_entropy", None, "high_entropy_v1", java_pattern(d.ENTROPY_RUN),
    _has(r"[A-Za-z0-9+/_=-]{32}"),
    f"{{v}} RLIKE '[0-9]' AND {{v}} RLIKE '[A-Za-z]' AND round({ENTROPY}, 6) >= {d.MIN_ENTROPY_BITS}",
    0.7, "MEDIUM",
)
SECRET_KINDS = {k.name: k for k in (AWS_KEY, PROVIDER_KEY, PEM, JWT, HIGH_ENTROPY)}

# What redaction replaces, in scan order; IP addresses and bare high-entropy
# strings are findings only.
REDACTED_KINDS = (EMAIL, PHONE, SSN, CARD, IBAN, AWS_KEY, PROVIDER_KEY, PEM, JWT)


def secrets(kinds: Iterable[str] = tuple(SECRET_KINDS)) -> DetectorSpec:
    chosen = [SECRET_KINDS[k] for k in kinds]
    return DetectorSpec(
        "secrets",
        frozenset({"input", "context", "response"}),
        lambda salt: _value_findings(
            "secrets", chosen, "SECRET_DETECTED", "OUTPUT_SECRET", salt, False
        ),
    )


# --- injection and jailbreak ---------------------------------------------------


# "dan" is part of too many words to be looked for inside them.
WHOLE_WORDS = {"dan": java_pattern(r"\bdan\b")}


def _holds_word(text: str, words: Iterable[str]) -> str:
    """SQL: whether a text may match a family: its words are looked for in lower case, before any pattern is tried.

    The characters replaced are those that patterns take for an ASCII letter whatever their case.
    """
    low = f"replace(replace(lower(replace({text}, '\u0130', 'i')), '\u0131', 'i'), '\u017f', 's')"
    held = " OR ".join(f"contains(x, {literal(w)})" + (f" AND {text} RLIKE {literal('(?iu)' + WHOLE_WORDS[w])}" if w in WHOLE_WORDS else "") for w in words)
    return f"exists(array({low}), x -> {held})"


def first_pattern(family, words: Iterable[str], category: str, salt: str, detector: str) -> str:
    """SQL over ``v``: the finding of the first pattern, in priority order, that matches."""
    arms = []
    for pattern_id, pattern, score, confidence in family:
        java = java_pattern(pattern, ignore_case=True)
        found = finding_sql(
            detector, quote(category), f"{score}D", quote(confidence), quote(pattern_id),
            "e.at", "e.at + length(e.hit)", salted_hash_sql("e.hit", salt), "e.n", "v.depth",
        )
        evidence = first_span_sql("v.text", java)
        arms.append(
            f"WHEN v.text RLIKE {literal(java)} THEN element_at(transform(array({evidence}), e -> {found}), 1)"
        )
    return f"CASE WHEN {_holds_word('v.text', words)} THEN CASE {' '.join(arms)} END END"


ALL_TEXTS = "concat(array(named_struct('text', norm, 'depth', 0, 'encoding', 'plain')), variants)"


def _both_families(first: str, second: str, salt: str, detector: str) -> str:
    """SQL: findings of both families over a text and all it hides."""
    injection = first_pattern(d.INJECTION_PATTERNS, d.INJECTION_WORDS, first, salt, detector)
    jailbreak = first_pattern(d.JAILBREAK_PATTERNS, d.JAILBREAK_WORDS, second, salt, detector)
    return (
        f"concat(filter(transform({ALL_TEXTS}, v -> {injection}), f -> f IS NOT NULL), "
        f"filter(transform({ALL_TEXTS}, v -> {jailbreak}), f -> f IS NOT NULL))"
    )


def _input_injection(salt: str) -> str:
    both = _both_families("PROMPT_INJECTION", "JAILBREAK", salt, "prompt_injection")
    extra = finding_sql(
        "prompt_injection", "'ENCODED_PAYLOAD'", f"{d.ENCODED_PAYLOAD_SCORE}D", "'HIGH'",
        "x.pattern_id", "x.start", "x.end", "x.excerpt_hash", "NULL", "x.decoded_depth",
    )
    # The first of the deepest findings lends its evidence.
    deepest = "array_max(transform(found, g -> g.decoded_depth))"
    lead = f"filter(found, f -> f.decoded_depth = {deepest})[0]"
    return f"""element_at(transform(array({both}), found ->
      CASE WHEN {deepest} > 0
      THEN concat(found, transform(array({lead}), x -> {extra})) ELSE found END), 1)"""


def _context_injection(salt: str) -> str:
    both = _both_families("INDIRECT_INJECTION", "INDIRECT_INJECTION", salt, "indirect_injection")
    raised = finding_sql(
        "indirect_injection", "g.category", f"greatest(g.score, {d.INDIRECT_SCORE_FLOOR}D)", "'HIGH'",
        "g.pattern_id", "g.start", "g.end", "g.excerpt_hash", "g.match_count", "g.decoded_depth",
    )
    return f"""element_at(transform(array({both}), found ->
      transform(
        filter(found, (f, i) -> array_position(transform(found, h -> h.pattern_id), f.pattern_id) = i + 1),
        g -> {raised})), 1)"""


def prompt_injection() -> DetectorSpec:
    return DetectorSpec("prompt_injection", frozenset({"input"}), _input_injection)


def indirect_injection() -> DetectorSpec:
    return DetectorSpec("indirect_injection", frozenset({"context"}), _context_injection)


# --- topics and urls -----------------------------------------------------------


def fold_phrase(phrase: str) -> str:
    import unicodedata

    plain = unicodedata.normalize("NFKD", phrase)
    return "".join(c for c in plain if not unicodedata.combining(c)).lower()


def phrase_pattern(phrase: str) -> str:
    """A phrase as a word-bounded pattern with flexible inner white space."""
    words = [re.escape(w) for w in fold_phrase(phrase).split(" ")]
    return java_pattern(r"\b" + r"\s+".join(words) + r"\b")


def topics(blocked: Iterable[str], sensitive: Iterable[str]) -> DetectorSpec:
    phrases = [("BLOCKED_TOPIC", p) for p in blocked] + [("SENSITIVE_TOPIC", p) for p in sensitive]

    def hit(category: str, phrase: str, salt: str) -> str:
        java = phrase_pattern(phrase)
        longest = literal(max(fold_phrase(phrase).split(" "), key=len))
        found = finding_sql(
            "topics", quote(category), "0.9D", "'MEDIUM'", quote(f"topic:{phrase}"),
            "e.at", "e.at + length(e.hit)", salted_hash_sql("e.hit", salt),
        )
        evidence = first_span_sql("folded", java)
        return (
            f"CASE WHEN contains(folded, {longest}) AND folded RLIKE {literal(java)} "
            f"THEN element_at(transform(array({evidence}), e -> {found}), 1) END"
        )

    def findings(salt: str) -> str:
        if not phrases:
            return NO_FINDINGS
        return f"array_compact(array({', '.join(hit(c, p, salt) for c, p in phrases)}))"

    return DetectorSpec("topics", frozenset({"input", "context"}), findings)


def urls() -> DetectorSpec:
    def findings(salt: str) -> str:
        found = finding_sql(
            "urls", "'SCHEMA_VIOLATION'", "0.7D", "'MEDIUM'", "'private_or_metadata_url_v1'",
            "z.start", "z.end", salted_hash_sql("z.text", salt),
        )
        return f"transform(internal_urls, z -> {found})"

    return DetectorSpec("urls", frozenset({"input", "context"}), findings)


# --- running detectors -----------------------------------------------------------


def text_detectors(policy) -> list[DetectorSpec]:
    """The detectors that read message text, set up from a policy."""
    return [
        prompt_injection(),
        indirect_injection(),
        pii(),
        secrets(),
        topics(policy.blocked_topics, policy.sensitive_topics),
        urls(),
    ]


def prepare_texts(messages: DataFrame, detectors: Iterable[DetectorSpec]) -> DataFrame:
    """Add the derived texts the given detectors read."""
    ids = {s.id for s in detectors}
    df = tx.normalized(messages)
    if "topics" in ids:
        df = df.withColumn("folded", tx.fold_diacritics(F.col("norm")))
    if ids & {"prompt_injection", "indirect_injection"}:
        df = with_variants(df)
    if "urls" in ids:
        internal = F.filter(
            net.url_spans("norm"), lambda s: net.is_internal(net.url_host(s["text"]))
        )
        df = df.withColumn("internal_urls", internal)
    return df


def failure_sql(detector: str) -> str:
    return finding_sql(detector, quote(d.OPERATIONAL_CATEGORY), "0D", "'LOW'")


def scan(
    messages: DataFrame, detectors: Iterable[DetectorSpec], salt: str, keep: Iterable[str] = ()
) -> DataFrame:
    """Run detectors over (txn_id, turn, plane, text): one row per finding.

    ``keep`` names further columns of ``messages`` to carry along.
    """
    detectors = list(detectors)
    prepared = prepare_texts(messages, detectors)
    # A detector fails for itself alone: null is its mark, not the row's end.
    arrays = ", ".join(
        f"CASE WHEN plane IN ({', '.join(map(quote, sorted(s.planes)))}) AND norm IS NOT NULL "
        f"THEN coalesce({s.findings(salt)}, array({failure_sql(s.id)})) ELSE {NO_FINDINGS} END"
        for s in detectors
    )
    keys = ["txn_id", "turn", "plane", *keep]
    # The outer form keeps the optimizer from computing the arrays a second time
    # for a filter on their size.
    found = prepared.select(*keys, F.posexplode_outer(F.expr(f"concat({arrays})")).alias("ord", "f"))
    return found.where(F.col("f").isNotNull()).select(*keys, "ord", "f.*")


# JSON types by the names a violation reports them under.
_TYPE_NAMES = {
    "integer": "int", "bigint": "int", "number": "float", "double": "float",
    "array": "list", "object": "dict", "boolean": "bool",
}


def scan_message_schema(messages: DataFrame, salt: str) -> DataFrame:
    """Messages with an unknown role or with content that is not text.

    ``content_type`` is optional: the JSON type of the content where the source
    keeps it ("string", "null", "integer", ...).
    """
    detail = [
        "CASE WHEN NOT coalesce(role IN (" + ", ".join(map(quote, d.ROLES)) + "), false) THEN named_struct("
        "'pattern_id', 'invalid_role_v1', "
        "'detail', concat('invalid role: ', coalesce(concat(\"'\", role, \"'\"), 'None'))) END"
    ]
    if "content_type" in messages.columns:
        names = ", ".join(f"{quote(k)}, {quote(v)}" for k, v in _TYPE_NAMES.items())
        kind = f"coalesce(element_at(map({names}), lower(content_type)), lower(content_type))"
        detail.append(
            "CASE WHEN lower(content_type) NOT IN ('string', 'null', 'void') THEN named_struct("
            "'pattern_id', 'invalid_content_type_v1', "
            f"'detail', concat('content must be a string or null, got ', {kind})) END"
        )
    found = finding_sql(
        "schema", "'SCHEMA_VIOLATION'", "0.5D", "'LOW'", "x.pattern_id", "0", "0",
        salted_hash_sql("x.detail", salt),
    )
    rows = messages.select(
        "txn_id", "turn",
        F.explode_outer(F.expr(f"transform(array_compact(array({', '.join(detail)})), x -> {found})")).alias("f"),
    )
    return rows.where(F.col("f").isNotNull()).select("txn_id", "turn", "f.*")


def quarantine(
    messages: DataFrame, detectors: Iterable[DetectorSpec], salt: str
) -> tuple[DataFrame, DataFrame]:
    """All findings, and per message the detectors that failed on it.

    A detector whose expression gives null for a text has failed there: it leaves one
    operational finding, the other detectors go on, and the transaction is reported as
    degraded. Texts are scanned whole, however long.
    """
    found = scan(messages, detectors, salt)
    failed = found.where(F.col("category") == d.OPERATIONAL_CATEGORY)
    return found, failed.groupBy("txn_id", "turn", "plane").agg(F.array_sort(F.collect_set("detector_id")).alias("failed"))
