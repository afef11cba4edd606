"""Registered governance and metrics queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import governance as G
from quire.operators import literals as L
from quire.plans import oracle as O
from quire.plans.registry import register, round_doubles
from quire.plans.fixtures import tickets
from quire.sources.tables import read_table

ALLOWLIST = ("src0", "src1")


def findings(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    pages = read_table(spark, sf_dir, "pages")
    d = G.scan_secrets(docs, "doc_id", "text", "documents", F.col("source"))
    p = G.scan_secrets(pages, "page_id", "html", "pages", F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1))
    env = G.env_file_findings(pages, "page_id", "url", "pages")
    return d.unionByName(p).unionByName(env)


_LINES = f"""lines AS (
  SELECT 'documents' AS source, doc_id AS row_id, source AS origin, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents
  UNION ALL
  SELECT 'pages', page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1), unnest(string_split(html, chr(10))),
         generate_subscripts(string_split(html, chr(10)), 1) FROM pages),
hits AS ({' UNION ALL '.join(f"SELECT source, row_id, origin, line_no, '{name}' AS rule, regexp_matches(line, {O.q(G.PLACEHOLDER)}) AS placeholder FROM lines WHERE regexp_matches(line, {O.q(p)})" for name, p in G.SECRET_RULES)}
  UNION ALL SELECT 'pages', page_id, NULL, 0, 'tracked_env_file', FALSE FROM pages
  WHERE regexp_matches(url, {O.q(G.ENV_FILE)}) AND NOT regexp_matches(url, {O.q(G.ENV_TEMPLATE)}))"""


@register("scan_secrets", f"WITH {_LINES}\nSELECT source, row_id, line_no, rule, placeholder FROM hits")
def scan_secrets(spark, sf_dir):
    return findings(spark, sf_dir).select("source", "row_id", "line_no", "rule", "placeholder")


@register(
    "scan_allowlist",
    f"""WITH {_LINES}
SELECT source, row_id, line_no, rule FROM hits
WHERE NOT placeholder AND (origin IS NULL OR origin NOT IN ({', '.join(O.q(a) for a in ALLOWLIST)}))""",
)
def scan_allowlist(spark, sf_dir):
    allow = spark.createDataFrame([(a,) for a in ALLOWLIST], "origin string")
    return G.scan_allowlist(findings(spark, sf_dir), allow, ["origin"]).select("source", "row_id", "line_no", "rule")


TOKEN = 'token = "([0-9a-f]+)"'
PASSAGE = (11, 40)  # of benchmark texts: start and length of a value with blanks and punctuation


@register(
    "scan_literals",
    f"""WITH lit AS (SELECT DISTINCT value FROM (
           SELECT regexp_extract(text, '{TOKEN}', 1) AS value FROM documents
           UNION ALL SELECT substr(text, {PASSAGE[0]}, {PASSAGE[1]}) FROM benchmark
           UNION ALL SELECT substr(text, 2, 5) FROM benchmark) WHERE value <> '')
SELECT DISTINCT doc_id AS row_id, sha256(value) AS literal_hash FROM documents JOIN lit ON contains(text, value)""",
)
def scan_literals(spark, sf_dir):
    """Values standing anywhere in whole texts: tokens, passages of several words, and short stretches across words."""
    docs, bench = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")
    tokens = docs.select(F.regexp_extract("text", TOKEN, 1).alias("value"))
    passages = bench.select(F.explode(F.array(F.substring("text", *PASSAGE), F.substring("text", 2, 5))).alias("value"))
    return L.scan_literals(docs, "doc_id", "text", tokens.unionByName(passages))


@register(
    "support_kpis",
    f"""WITH t AS (SELECT x.*, e.value FROM ({O.tickets()}) x JOIN events e ON e.event_id = x.id)
SELECT category, count(*) AS n_tickets,
       round(avg(CASE WHEN status = 'Closed' AND priority <> 'High' THEN 1.0 ELSE 0.0 END), 6) AS containment_rate,
       round(avg(value), 6) AS mean_handling_minutes,
       round(count(*) FILTER (WHERE priority = 'High' AND status <> 'Closed')
             / nullif(count(*) FILTER (WHERE priority = 'High'), 0), 6) AS escalation_precision
FROM t GROUP BY category""",
)
def support_kpis(spark, sf_dir):
    return round_doubles(G.support_kpis(tickets(spark, sf_dir, with_value=True)))


_PRICES = ", ".join(f"({O.q(m)}, {i}, {o})" for m, i, o in G.MODEL_PRICES)


@register(
    "model_cost",
    f"""WITH c AS (SELECT conv_id, sum(CASE WHEN role <> 'assistant' THEN ceil(length(text) / 4.0) ELSE 0 END) AS tin,
                      sum(CASE WHEN role = 'assistant' THEN ceil(length(text) / 4.0) ELSE 0 END) AS tout
               FROM conversations GROUP BY conv_id),
u AS (SELECT count(*) AS n, sum(tin) AS tin, sum(tout) AS tout FROM c),
p AS (SELECT * FROM (VALUES {_PRICES}) v(model, pin, pout))
SELECT model, CAST(pin AS DECIMAL(10,2)) AS input_price, CAST(pout AS DECIMAL(10,2)) AS output_price, n AS n_inquiries,
       round((tin * pin + tout * pout) / 1000000.0 / n, 8) AS cost_per_inquiry
FROM u, p""",
)
def model_cost(spark, sf_dir):
    return G.model_cost(read_table(spark, sf_dir, "conversations"))
