"""Policies: rules as data, conditions compiled to Column expressions."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwarden import domains as d
from siftwarden.functions import toolargs as ta
from siftwarden.functions.regex import literal


@dataclass(frozen=True)
class Policy:
    """A policy document. ``rules`` keeps the document's own nested form."""

    rules: tuple[dict, ...]
    detectors: dict = field(default_factory=dict)
    version: str = ""

    @staticmethod
    def from_document(document: dict) -> Policy:
        """Take a parsed policy document; its version is the hash of its content."""
        for rule in document["rules"]:
            unknown = set(rule) - RULE_KEYS
            if unknown:
                raise ValueError(f"rule {rule.get('id')}: unknown keys {sorted(unknown)}")
            missing = {"id", "plane", "verdict", "reason_code"} - set(rule)
            if missing:
                raise ValueError(f"rule {rule.get('id')}: missing {sorted(missing)}")
            if rule["verdict"] not in d.VERDICT_RANK:
                raise ValueError(f"rule {rule['id']}: unknown verdict {rule['verdict']}")
            unknown = set(rule["plane"]) - set(d.PLANES)
            if unknown or rule.get("transformation", "NONE") not in ("NONE", *d.TRANSFORMATION_ORDER):
                raise ValueError(f"rule {rule['id']}: unknown plane or transformation")
            if rule.get("when") is not None:
                check_condition(rule["when"], rule["id"])
        canonical = json.dumps(document, sort_keys=True, separators=(",", ":"))
        version = "sha256:" + hashlib.sha256(canonical.encode()).hexdigest()
        return Policy(tuple(document["rules"]), dict(document.get("detectors", {})), version)

    @staticmethod
    def default() -> Policy:
        return Policy.from_document(DEFAULT_DOCUMENT)

    def rule(self, rule_id: str) -> dict | None:
        return next((r for r in self.rules if r["id"] == rule_id), None)

    def leaf(self, rule_id: str, key: str):
        """The first leaf of a rule that has ``key``, as its value; None if absent."""
        rule = self.rule(rule_id)
        leaves = _leaves(rule.get("when", {})) if rule else iter(())
        return next((leaf[key] for leaf in leaves if key in leaf), None)

    @property
    def blocked_topics(self) -> list[str]:
        return list(self.detectors.get("topics", {}).get("blocked", []))

    @property
    def sensitive_topics(self) -> list[str]:
        return list(self.detectors.get("topics", {}).get("sensitive", []))

    @property
    def canaries(self) -> list[str]:
        return [c for c in self.detectors.get("system_prompt_leak", {}).get("canaries", []) if c]

    @property
    def tool_allowlist(self) -> list[str] | None:
        return self.leaf("agent_tool_allowlist", "tool_not_in")

    @property
    def rate_limit(self) -> tuple[int, int]:
        for rule in self.rules:
            if "rate_limit" in rule:
                return rule["rate_limit"]["requests"], rule["rate_limit"]["window_seconds"]
        return d.RATE_LIMIT_REQUESTS, d.RATE_LIMIT_WINDOW_SECONDS


RULE_KEYS = {
    "id", "plane", "when", "rate_limit", "verdict", "hard_deny", "mandatory_approval",
    "transformation", "reason_code",
}


# The keys of each kind of condition: that which names the kind, and what may stand beside it.
CONDITION_KEYS = {
    "all": set(), "any": set(), "category": {"score_gte", "score_lt"}, "bytes_gt": set(), "tool_name_in": set(), "tool_not_in": set(),
    "argument_path": {"numeric_gte", "numeric_lt", "sql_verb_in", "sql_unbounded_mutation", "shell_pattern_in"},
}


def check_condition(condition: dict, rule_id: str) -> None:
    """Refuse a condition that says nothing, two things at once, or something unknown."""
    kinds = set(condition) & set(CONDITION_KEYS)
    if len(kinds) != 1:
        raise ValueError(f"rule {rule_id}: a condition is one of {sorted(CONDITION_KEYS)}, got {sorted(condition)}")
    kind = kinds.pop()
    beside = set(condition) - {kind}
    if beside - CONDITION_KEYS[kind] or (kind == "argument_path" and len(beside) != 1):
        raise ValueError(f"rule {rule_id}: unknown keys beside {kind}: {sorted(beside)}")
    if kind in ("all", "any"):
        if not condition[kind]:
            raise ValueError(f"rule {rule_id}: empty {kind}")
        for part in condition[kind]:
            check_condition(part, rule_id)


def _leaves(condition: dict) -> Iterator[dict]:
    children = [*condition.get("all", []), *condition.get("any", [])]
    if children:
        for child in children:
            yield from _leaves(child)
    else:
        yield condition


def rule_categories(rule: dict) -> list[str]:
    found = {leaf["category"] for leaf in _leaves(rule.get("when") or {}) if "category" in leaf}
    return sorted(found)


# --- conditions as columns ---------------------------------------------------


@dataclass
class Facts:
    """What conditions may refer to. Names and scores are SQL over one row.

    Looking into tool arguments takes several steps, so each such check is a
    column of its own in ``checks``, to be added to the row first.
    """

    score: Callable[[str, str], str]  # (plane, category) -> max score or null
    byte_count: str
    tool: str
    args: Column  # variant
    checks: dict[str, Column] = field(default_factory=dict)

    def check(self, condition: Column) -> str:
        name = f"_check{len(self.checks)}"
        self.checks[name] = condition
        return name


def _argument_check(leaf: dict, args: Column) -> Column | None:
    path = leaf["argument_path"]
    # A boolean counts as the number 1 or 0 here, unlike in the detectors.
    number = F.coalesce(ta.path_number(args, path), ta.path_flag(args, path).cast("double"))
    text = ta.path_text(args, path)
    if "numeric_gte" in leaf:
        return number >= float(leaf["numeric_gte"])
    if "numeric_lt" in leaf:
        return number < float(leaf["numeric_lt"])
    if "sql_verb_in" in leaf:
        verbs = [v.upper() for v in leaf["sql_verb_in"]]
        return ta.first_word(ta.strip_sql_comments(text)).isin(*verbs)
    if "sql_unbounded_mutation" in leaf:
        return ta.unbounded_mutation(ta.strip_sql_comments(text))
    if "shell_pattern_in" in leaf:
        return ta.has_shell_pattern(ta.squeeze(text), leaf["shell_pattern_in"])
    return None


def _listed(values: list[str]) -> str:
    return ", ".join(literal(v) for v in values)


def _leaf_sql(leaf: dict, plane: str, facts: Facts) -> str:
    if "category" in leaf:
        score = facts.score(plane, leaf["category"])
        parts = [f"{score} IS NOT NULL"]
        if "score_gte" in leaf:
            parts.append(f"{score} >= {float(leaf['score_gte'])!r}D")
        if "score_lt" in leaf:
            parts.append(f"{score} < {float(leaf['score_lt'])!r}D")
        return " AND ".join(parts)
    if "bytes_gt" in leaf:
        return f"{facts.byte_count} > {int(leaf['bytes_gt'])}"
    if "tool_name_in" in leaf:
        return f"{facts.tool} IN ({_listed(leaf['tool_name_in'])})"
    if "tool_not_in" in leaf:
        return f"{facts.tool} NOT IN ({_listed(leaf['tool_not_in'])})"
    if "argument_path" in leaf:
        condition = _argument_check(leaf, facts.args)
        return "false" if condition is None else facts.check(condition)
    return "false"


def compile_condition(condition: dict, plane: str, facts: Facts) -> str:
    """A condition tree as one boolean SQL expression that is never null."""
    for key, word in (("all", " AND "), ("any", " OR ")):
        if key in condition:
            return "(" + word.join(compile_condition(c, plane, facts) for c in condition[key]) + ")"
    return f"coalesce({_leaf_sql(condition, plane, facts)}, false)"


def hits_sql(policy: Policy, facts: Facts) -> str:
    """SQL: every matching rule of the policy, in rule order, as an array of structs."""
    hits = []
    for position, rule in enumerate(policy.rules):
        if rule.get("when") is None or "rate_limit" in rule:
            continue
        matched, categories = [], []
        for plane in rule["plane"]:
            here = compile_condition(rule["when"], plane, facts)
            matched.append(here)
            categories += [
                f"CASE WHEN {here} AND {facts.score(plane, c)} IS NOT NULL THEN {literal(c)} END"
                for c in rule_categories(rule)
            ]
        seen = (
            f"array_sort(array_distinct(array_compact(array({', '.join(categories)}))))"
            if categories
            else "CAST(array() AS array<string>)"
        )
        hits.append(
            f"CASE WHEN {' OR '.join(matched)} THEN named_struct('position', {position}, "
            f"'rule_id', {literal(rule['id'])}, 'verdict', {literal(rule['verdict'])}, "
            f"'transformation', {literal(rule.get('transformation', 'NONE'))}, "
            f"'reason_code', {literal(rule['reason_code'])}, 'matched_categories', {seen}) END"
        )
    if not hits:
        return "array()"
    return f"array_compact(array({', '.join(hits)}))"


# --- rules as a dimension ------------------------------------------------------

LEAF_SCHEMA = T.StructType(
    [
        T.StructField("position", T.IntegerType()),
        T.StructField("rule_id", T.StringType()),
        T.StructField("plane", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("score_gte", T.DoubleType()),
        T.StructField("score_lt", T.DoubleType()),
        T.StructField("verdict", T.StringType()),
        T.StructField("transformation", T.StringType()),
        T.StructField("reason_code", T.StringType()),
    ]
)


def leaf_rows(policy: Policy) -> list[tuple]:
    """One row per (rule, plane) for the rules whose whole condition is a category."""
    rows = []
    for position, rule in enumerate(policy.rules):
        when = rule.get("when") or {}
        if "category" not in when:
            continue
        for plane in rule["plane"]:
            rows.append(
                (
                    position, rule["id"], plane, when["category"],
                    float(when.get("score_gte", 0.0)), float(when.get("score_lt", 2.0)),
                    rule["verdict"], rule.get("transformation", "NONE"), rule["reason_code"],
                )
            )
    return rows


def governed_categories(spark: SparkSession, policy: Policy) -> DataFrame:
    """Every category that some rule mentions, however deep in its condition."""
    names = sorted({c for rule in policy.rules for c in rule_categories(rule)})
    return spark.createDataFrame([(c,) for c in names], "category string")


def rules_table(spark: SparkSession, policy: Policy) -> DataFrame:
    """The category rules as a table: a few dozen rows, one policy document's worth."""
    return spark.createDataFrame(leaf_rows(policy), LEAF_SCHEMA)


# --- the default policy -----------------------------------------------------------
# Rules, thresholds and word lists of the default policy.

_IN = ["input", "context"]
DEFAULT_DOCUMENT = {
    "schema_version": "1.0",
    "metadata": {"name": "default"},
    "detectors": {
        "topics": {
            "blocked": [
                "synthesize a chemical weapon",
                "build an explosive device",
                "child sexual abuse material",
                "bypass content moderation filters to generate",
            ],
            "sensitive": [
                "specific medical diagnosis",
                "prescription dosage recommendation",
                "specific legal advice for my case",
                "personalized investment recommendation",
            ],
        },
        "system_prompt_leak": {"canaries": ["RG-CANARY-7F3A9C"]},
    },
    "rules": [
        {"id": "deny_prompt_injection", "plane": _IN, "verdict": "DENY", "hard_deny": True,
         "when": {"category": "PROMPT_INJECTION", "score_gte": 0.85},
         "reason_code": "PROMPT_INJECTION"},
        {"id": "deny_jailbreak", "plane": _IN, "verdict": "DENY", "hard_deny": True,
         "when": {"category": "JAILBREAK", "score_gte": 0.85}, "reason_code": "JAILBREAK"},
        {"id": "review_probable_injection", "plane": _IN, "verdict": "NEED_APPROVAL",
         "when": {"category": "PROMPT_INJECTION", "score_gte": 0.50, "score_lt": 0.85},
         "reason_code": "PROMPT_INJECTION"},
        {"id": "review_probable_jailbreak", "plane": _IN, "verdict": "NEED_APPROVAL",
         "when": {"category": "JAILBREAK", "score_gte": 0.50, "score_lt": 0.85},
         "reason_code": "JAILBREAK"},
        {"id": "deny_indirect_injection", "plane": ["context"], "verdict": "DENY",
         "hard_deny": True, "when": {"category": "INDIRECT_INJECTION", "score_gte": 0.50},
         "reason_code": "INDIRECT_INJECTION"},
        {"id": "deny_encoded_payload", "plane": _IN, "verdict": "DENY", "hard_deny": True,
         "when": {"category": "ENCODED_PAYLOAD"}, "reason_code": "ENCODED_PAYLOAD"},
        {"id": "deny_blocked_topic", "plane": _IN, "verdict": "DENY", "hard_deny": True,
         "when": {"category": "BLOCKED_TOPIC"}, "reason_code": "BLOCKED_TOPIC"},
        {"id": "review_sensitive_topic", "plane": _IN, "verdict": "NEED_APPROVAL",
         "when": {"category": "SENSITIVE_TOPIC"}, "transformation": "REDACT",
         "reason_code": "SENSITIVE_TOPIC"},
        {"id": "redact_pii_inbound", "plane": _IN, "verdict": "ALLOW",
         "when": {"category": "PII_DETECTED"}, "transformation": "REDACT",
         "reason_code": "PII_DETECTED"},
        {"id": "redact_secrets_inbound", "plane": _IN, "verdict": "ALLOW",
         "when": {"category": "SECRET_DETECTED"}, "transformation": "REDACT",
         "reason_code": "SECRET_DETECTED"},
        {"id": "approve_external_pii_transfer", "plane": ["input"], "verdict": "NEED_APPROVAL",
         "mandatory_approval": True, "transformation": "REDACT",
         "when": {"all": [{"category": "PII_DETECTED"},
                          {"tool_name_in": ["send_email", "post_webhook", "upload_file"]}]},
         "reason_code": "SENSITIVE_ACTION"},
        {"id": "high_value_transfer", "plane": ["action"], "verdict": "NEED_APPROVAL",
         "mandatory_approval": True, "transformation": "REDACT",
         "when": {"all": [{"tool_name_in": ["wire_transfer", "create_payment", "initiate_transfer"]},
                          {"argument_path": "$.amount", "numeric_gte": 1000}]},
         "reason_code": "SENSITIVE_ACTION"},
        {"id": "deny_destructive_sql", "plane": ["action"], "verdict": "DENY", "hard_deny": True,
         "when": {"any": [{"argument_path": "$.query", "sql_verb_in": ["DROP", "TRUNCATE", "ALTER"]},
                          {"argument_path": "$.query", "sql_unbounded_mutation": True}]},
         "reason_code": "DESTRUCTIVE_ACTION"},
        {"id": "deny_shell_deletion", "plane": ["action"], "verdict": "DENY", "hard_deny": True,
         "when": {"argument_path": "$.command",
                  "shell_pattern_in": ["recursive_force_remove", "device_write", "fork_bomb"]},
         "reason_code": "DESTRUCTIVE_ACTION"},
        {"id": "agent_tool_allowlist", "plane": ["action"], "verdict": "DENY",
         "when": {"tool_not_in": ["search_docs", "get_weather", "lookup_order", "wire_transfer",
                                  "run_sql", "send_email"]},
         "reason_code": "TOOL_NOT_ALLOWLISTED"},
        {"id": "payload_limit", "plane": ["input"], "verdict": "DENY",
         "when": {"bytes_gt": 262144}, "reason_code": "PAYLOAD_TOO_LARGE"},
        {"id": "rate_limit_default", "plane": ["input"], "verdict": "DENY",
         "rate_limit": {"requests": 60, "window_seconds": 60, "scope": "identity"},
         "reason_code": "RATE_LIMITED"},
        {"id": "deny_output_secret_leak", "plane": ["response"], "verdict": "DENY",
         "hard_deny": True, "when": {"category": "OUTPUT_SECRET"}, "reason_code": "OUTPUT_SECRET"},
        {"id": "redact_output_pii", "plane": ["response"], "verdict": "ALLOW",
         "when": {"category": "OUTPUT_PII"}, "transformation": "REDACT",
         "reason_code": "OUTPUT_PII"},
        {"id": "deny_canary_leak", "plane": ["response"], "verdict": "DENY", "hard_deny": True,
         "when": {"category": "CANARY_LEAK"}, "reason_code": "CANARY_LEAK"},
        {"id": "deny_system_prompt_leak", "plane": ["response"], "verdict": "DENY",
         "hard_deny": True, "when": {"category": "SYSTEM_PROMPT_LEAK", "score_gte": 0.8},
         "reason_code": "SYSTEM_PROMPT_LEAK"},
    ],
}
