"""The operators of this subpackage over their whole tables, with SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwarden.llm import centroids, covertree, exact, importance, langid, mixing, near, packing, periodic, sharding, substrings, urls, warc
from siftwarden.llm.tables import scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("op1_language_id")
def op1_language_id(spark, sf):
    docs = table(spark, sf, "documents")
    model = langid.fit_documents(docs)
    found = langid.identify(docs, model)
    return docs.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), found.alias("found")).select(
        "doc_id", "held_out", "found.lang_pred", "found.score", F.size("found.spans").alias("n_spans")
    )


EXACT_SQL = """
WITH norm AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS content FROM documents),
grouped AS (SELECT content, min(doc_id) AS keep_id, count(*) AS group_size FROM norm GROUP BY content)
SELECT doc_id, keep_id, group_size, coalesce(doc_id = keep_id, false) AS kept, sha256(content) AS text_sha256
FROM norm JOIN grouped USING (content)"""


@query("op3_exact_dedup", EXACT_SQL)
def op3_exact_dedup(spark, sf):
    return exact.duplicates(table(spark, sf, "documents"))


@query("op2_sharding")
def op2_sharding(spark, sf):
    placed = sharding.external_shuffle(table(spark, sf, "documents"), shards=8, seed=20240)
    text = F.col("row.text")
    return placed.select(
        "row.doc_id", sharding.text_bytes(text).alias("size"), F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
large AS (SELECT body, max(page_id) AS first FROM p WHERE n >= 1000 GROUP BY body)
SELECT page_id, n AS payload_bytes, sha1(p.body) AS payload_digest,
  CASE WHEN page_id < first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < first THEN first END AS refers_to
FROM p LEFT JOIN large ON p.body = large.body"""


@query("op9_warc", WARC_SQL)
def op9_warc(spark, sf):
    path = scratch(spark, "warc")
    warc.write(warc.revisits(table(spark, sf, "pages"), "page_id", "html", least=1000), path)
    number = lambda c: F.regexp_extract(c, "urn:page:(-?[0-9]+)", 1).try_cast("bigint")
    fields = ["record_type", "record_id", "refers_to", "payload_digest", "payload_bytes"]
    whole = warc.read(spark, path, [*fields, "payload"]).where("record_type = 'response'")
    again = warc.read(spark, path, fields).where("record_type = 'revisit'")
    found = whole.withColumns({"payload_bytes": F.octet_length("payload").cast("bigint"), "payload_digest": F.sha1("payload")})
    return found.drop("payload").unionByName(again).select(
        number("record_id").alias("page_id"), "payload_bytes", F.regexp_replace("payload_digest", "^sha1:", "").alias("payload_digest"),
        "record_type", number("refers_to").alias("refers_to"),
    )


@query("op10_best_fit_packing")
def op10_best_fit_packing(spark, sf):
    import public_tokenizers

    return packing.pack_documents(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op7_jaccard_join")
def op7_jaccard_join(spark, sf):
    return near.join(table(spark, sf, "documents"))


TOP_K_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.v::DOUBLE[], c.v::DOUBLE[]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20"""


@query("op4_top_k_search", TOP_K_SQL)
def op4_top_k_search(spark, sf):
    return covertree.top_k(table(spark, sf, "embeddings"), F.coalesce(F.col("vec_id") % 20 == 0, F.lit(False)), k=20)


@query("op5_quality_classifier")
def op5_quality_classifier(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    good = F.coalesce((F.col("quality") == 1) & (F.col("toxic") == 0), F.lit(False))
    n = labels.agg(F.count("*").alias("all"), F.count_if(good).alias("good")).first()
    ratios = importance.fit(docs, labels.where(good), n["good"])
    # As many documents as the labels say are good.
    return importance.resample(docs, ratios, share=n["good"] / max(n["all"], 1))


# The rules the query is given: verdict, host, path.
URL_RULES = (
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def _url_sql() -> str:
    values = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in URL_RULES)
    steps = "\n".join(
        f"""r{i + 1} AS MATERIALIZED (SELECT kind, node, sum(rank) AS rank FROM (
          SELECT kind, node, mass * {1 - urls.DAMPING} AS rank FROM seeds UNION ALL
          SELECT kind, dst, rank * share * {urls.DAMPING} FROM r{i} JOIN flow USING (kind, node)) GROUP BY ALL),"""
        for i in range(urls.ROUNDS)
    )
    return rf"""
WITH rules(v, h, p) AS (VALUES {values}),
page AS MATERIALIZED (SELECT page_id, html, translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1),
    '{urls.ASCII_UPPER}', '{urls.ASCII_LOWER}') AS host,
  regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path FROM pages),
fits AS (SELECT host, path, max(struct_pack(n := length(h) + length(p), k := length(h), rule := h || p, v := v)) AS best
  FROM (SELECT DISTINCT host, path FROM page) JOIN rules
  ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY host, path),
ruled AS MATERIALIZED (SELECT page_id, page.host, page.path, best.rule AS rule, best.v AS verdict
  FROM page LEFT JOIN fits ON page.host = fits.host AND page.path = fits.path),
seeds AS MATERIALIZED (SELECT verdict AS kind, host AS node, count(*) / sum(count(*)) OVER (PARTITION BY verdict) AS mass
  FROM ruled WHERE verdict IS NOT NULL GROUP BY verdict, host),
links AS MATERIALIZED (SELECT host AS src, translate(dst, '{urls.ASCII_UPPER}', '{urls.ASCII_LOWER}') AS dst, count(*) AS n FROM (
  SELECT host, unnest(regexp_extract_all(coalesce(html, ''), '{urls.LINK.replace("'", "''")}', 1)) AS dst FROM page)
  WHERE host <> '' AND host <> translate(dst, '{urls.ASCII_UPPER}', '{urls.ASCII_LOWER}') GROUP BY ALL),
flow AS MATERIALIZED (SELECT 'allow' AS kind, src AS node, dst, n / sum(n) OVER (PARTITION BY src) AS share FROM links
  UNION ALL SELECT 'block', dst, src, n / sum(n) OVER (PARTITION BY dst) FROM links),
r0 AS (SELECT kind, node, mass AS rank FROM seeds),
{steps}
hosts AS (SELECT node AS host, round(coalesce(sum(rank) FILTER (kind = 'allow'), 0) / sum(rank), 9) AS trust
  FROM r{urls.ROUNDS} GROUP BY node)
SELECT page_id, ruled.host AS host, path, rule,
  coalesce(verdict, CASE WHEN trust < {urls.LEAST} THEN 'block' ELSE 'allow' END) AS verdict, trust
FROM ruled LEFT JOIN hosts ON ruled.host = hosts.host"""


@query("op8_url_filters", _url_sql())
def op8_url_filters(spark, sf):
    rules = spark.createDataFrame(URL_RULES, "verdict string, host string, path string")
    return urls.judge(table(spark, sf, "pages"), rules)


@query("op6_mixing")
def op6_mixing(spark, sf):
    narrow = mixing.mix_documents(table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "labels"))
    domains = sorted(mixing.WEIGHTS)
    return narrow.select(
        "row.doc_id", "tokens", *[F.col("p")[i].alias("p_" + d.replace("-", "_")) for i, d in enumerate(domains)], "rate"
    )


def _cluster_sql(k: int = centroids.K, dims: int = centroids.DIMS, rounds: int = centroids.ROUNDS) -> str:
    def assigned(name: str, after: str) -> str:
        apart = "list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
        return f"""{name} AS MATERIALIZED (SELECT row, min(struct_pack(d := CAST({apart} AS BIGINT), i := i)) AS best
          FROM kept CROSS JOIN {after} GROUP BY row)"""

    steps = "".join(
        f""",
{assigned(f"a{r}", f"c{r}")},
sums{r} AS (SELECT i, j, sum(v[j]) AS s, count(*) AS n FROM (
  SELECT best.i AS i, v, unnest(range(1, {dims + 1})) AS j FROM a{r} JOIN kept USING (row)) GROUP BY i, j),
means{r} AS (SELECT i, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS c FROM sums{r} GROUP BY i),
c{r + 1} AS MATERIALIZED (SELECT i, coalesce(m.c, o.c) AS c FROM c{r} o LEFT JOIN means{r} m USING (i))"""
        for r in range(rounds)
    )
    return f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id,
  list_transform(embedding, lambda x: CAST(floor({centroids.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('{centroids.SEED}:' || vec_id) NULLS LAST, vec_id, v) - 1 AS INTEGER) AS i,
  v AS c FROM kept QUALIFY i < {k}){steps},
{assigned("last", f"c{rounds}")},
found AS MATERIALIZED (SELECT row, best.i AS cluster, best.d AS distance FROM last)
SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM found JOIN kept USING (row) JOIN c{rounds} ON cluster = i"""


@query("op11_centroid_clustering", _cluster_sql())
def op11_centroid_clustering(spark, sf):
    found, middles = centroids.cluster(table(spark, sf, "embeddings"))
    return centroids.with_inertia(found, middles).select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def planted(docs: DataFrame) -> DataFrame:
    """Key and text; that of a tenth of the documents goes on from word a by repeating its p words from there."""
    h = F.crc32(F.col("doc_id").cast("string"))
    parts = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda x: x != "")
    rows = docs.select("doc_id", "text", (h / 10).cast("bigint").alias("g"), F.when(h % 10 == 0, parts).alias("w"))
    rows = rows.select("doc_id", "text", "w", "g", F.expr("g % nullif(size(w), 0)").alias("a"))
    rows = rows.select("doc_id", "text", "w", "a", F.expr("1 + (size(w) - a) div (3 + g % 8)").alias("p"))
    again = F.expr("array_join(transform(sequence(0, size(w) - 1), i -> w[cast(if(i >= a, a + (i - a) % p, i) as int)]), ' ')")
    return rows.select("doc_id", F.when(F.col("a").isNull(), F.col("text")).otherwise(again).alias("text"))


@query("op12_periodic_runs")
def op12_periodic_runs(spark, sf):
    return periodic.summary(periodic.collapse(planted(table(spark, sf, "documents"))))


SUBSTRING_SQL = f"""
WITH words AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
starts AS MATERIALIZED (SELECT doc_id, i, array_to_string(w[i:i + {substrings.WINDOW - 1}], ' ') AS s FROM (
  SELECT doc_id, w, unnest(range(1, len(w) - {substrings.WINDOW - 2})) AS i FROM words WHERE len(w) >= {substrings.WINDOW})),
again AS MATERIALIZED (SELECT doc_id, list(i) AS found FROM (
  SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS first FROM starts) WHERE doc_id > first GROUP BY doc_id),
gone AS (SELECT doc_id, list_distinct(flatten(list_transform(found, lambda i: range(i, i + {substrings.WINDOW})))) AS g FROM again),
cut AS (SELECT doc_id, w, coalesce(len(g), 0) AS n_removed, CASE WHEN g IS NULL THEN w ELSE k END AS kept
  FROM words LEFT JOIN gone USING (doc_id) LEFT JOIN (
    SELECT doc_id, list(w[i] ORDER BY i) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM words)
      ANTI JOIN (SELECT doc_id, unnest(g) AS i FROM gone) USING (doc_id, i) GROUP BY doc_id) USING (doc_id))
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM cut"""


@query("op13_substring_dedup", SUBSTRING_SQL)
def op13_substring_dedup(spark, sf):
    found = substrings.cut_repeats(table(spark, sf, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("pipeline")
def pipeline(spark, sf):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf)
