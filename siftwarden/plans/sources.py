"""Source and sink queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from siftwarden.operators import decide
from siftwarden.operators import messages as ms
from siftwarden.operators.policy import rules_table
from siftwarden.plans import inputs as src
from siftwarden.plans.registry import query
from siftwarden.session import checkpoint_root
from siftwarden.sources import readers, sinks


def scratch(spark, name: str) -> str:
    """A new folder in the shared checkpoint area."""
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


@query("scan_messages", f"WITH {src.MESSAGES_SQL} SELECT txn_id, turn, role, plane, text FROM messages")
def scan_messages(spark, sf):
    turns = readers.table(spark, sf, "conversations")
    nested = turns.groupBy(F.col("conv_id").alias("txn_id")).agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m")
    )
    requests = nested.select(
        "txn_id", F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))).alias("messages")
    )
    return ms.from_requests(requests)


@query(
    "scan_corpus_jsonl",
    """SELECT CASE WHEN conv_id % 10 <> 0 THEN 'CASE-' || conv_id END AS case_id,
      CASE WHEN conv_id % 10 <> 0 THEN count(*)::INT END AS n_messages, CASE WHEN conv_id % 10 <> 0 THEN 'ALLOW' END AS expected_verdict,
      conv_id % 10 = 0 AS broken FROM conversations GROUP BY conv_id""",
)
def scan_corpus_jsonl(spark, sf):
    """Conversations written as corpus lines and read back, with one broken line per tenth case."""
    turns = readers.table(spark, sf, "conversations")
    # A case is one conversation.
    cases = turns.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m")
    )
    case = F.struct(
        F.concat(F.lit("CASE-"), F.col("conv_id").cast("string")).alias("case_id"), F.lit("BENIGN").alias("category"),
        F.struct(F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages")).alias("payload"),
        F.lit("ALLOW").alias("expected_verdict"),
    )
    line = F.when(F.col("conv_id") % 10 == 0, F.lit('{"case_id": broken')).otherwise(F.to_json(case))
    path = scratch(spark, "corpus")
    cases.select(line.alias("value")).write.text(path)
    read = readers.read_corpus(spark, path)
    return read.select(
        "case_id", F.when(F.col("payload").isNotNull(), F.size("payload.messages")).alias("n_messages"), "expected_verdict",
        F.col("_corrupt_record").isNotNull().alias("broken"),
    )


@query(
    "sink_decisions",
    f"""WITH {src.DECISIONS_SQL} SELECT kind, label, n FROM (
      SELECT 'decision' AS kind, verdict AS label, count(*) AS n FROM decisions GROUP BY verdict
      UNION ALL SELECT 'finding', plane, count(*) FROM findings GROUP BY plane
      UNION ALL SELECT 'hit', rule_id, count(*) FROM leaf_hits GROUP BY rule_id)""",
)
def sink_decisions(spark, sf):
    """Findings, hits and decisions as tables; writing a batch twice leaves one copy."""
    path = scratch(spark, "decisions")
    found = src.findings(spark, sf)
    for name, df in (
        ("findings", found),
        ("hits", decide.rule_hits(found, rules_table(spark, src.POLICY))),
        ("decisions", src.decisions(spark, sf)),
    ):
        sinks.write_batch(df, f"{path}/{name}", 0)
    sinks.write_batch(found, f"{path}/findings", 0)
    parts = [("decision", "decisions", "verdict"), ("finding", "findings", "plane"), ("hit", "hits", "rule_id")]
    out = [
        spark.read.parquet(f"{path}/{folder}").groupBy(F.col(label).alias("label"))
        .agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "label", "n")
        for kind, folder, label in parts
    ]
    return out[0].unionByName(out[1]).unionByName(out[2])
