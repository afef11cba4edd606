"""Governance and metrics (G1, G2, K1, K2; G3 is in ``literals``).

Secret scanning reports locations only, never the matched value. Each rule is
a column predicate over exploded lines (no join with a rule table), so a scan
is one narrow pass plus the explode.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# Fixed values ---------------------------------------------------------------
SECRET_RULES = [
    ("google_api_key", r"AIza[0-9A-Za-z_-]{35}"),
    ("google_aq_key", r"AQ\.[0-9A-Za-z_-]{40,}"),
    ("openai_key", r"sk-(proj-)?[A-Za-z0-9_-]{20,}"),
    ("postgres_url_password", r"postgres(ql)?://[^:/\s@]+:[^@/\s]+@"),
    ("generic_assignment", r"(?i)(api[_-]?key|secret|token|password)[\"']?\s*[:=]\s*[\"'][^\"'\s]{8,}[\"']"),
    ("private_key", r"-----BEGIN ([A-Z]+ )?PRIVATE KEY-----"),
    ("app_password", r"(?i)app[_-]?password[\"']?\s*[:=]\s*[\"']?[a-z]{4} ?[a-z]{4} ?[a-z]{4} ?[a-z]{4}"),
]
ENV_FILE = r"(^|/)\.env(\.[A-Za-z0-9_-]+)?$"  # .env, .env.local ... (a template such as .env.example is allowed)
ENV_TEMPLATE = r"\.env\.(example|sample|template)$"
PLACEHOLDER = r"(?i)(your[_-]|example[_-]?key|placeholder|xxxx|changeme|dummy|<[a-z_ -]+>)"
# Price per 1M tokens (input, output) from the model comparison slide.
MODEL_PRICES = [
    ("GPT-5.6 Sol", Decimal("5.00"), Decimal("30.00")),
    ("GPT-5.6 Terra", Decimal("2.00"), Decimal("12.00")),
    ("GPT-5.6 Luna", Decimal("0.20"), Decimal("1.20")),
    ("GPT-5.4 Mini", Decimal("0.75"), Decimal("4.50")),
]
CHARS_PER_TOKEN = 4


def rule_hits(line: Column) -> Column:
    return F.array_compact(F.array(*[F.when(line.rlike(p), F.lit(name)) for name, p in SECRET_RULES]))


# G1
def scan_secrets(df: DataFrame, id_col: str, text_col: str, source: str, origin: Column | None = None) -> DataFrame:
    """``(source, row_id, origin, line_no, rule, placeholder)`` per rule hit,
    1-based lines. ``origin`` (for allow-listing) rides along, no join back."""
    org = origin if origin is not None else F.lit(None).cast("string")
    lines = df.select(
        F.col(id_col).alias("row_id"), org.alias("origin"),
        F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("pos", "line"),
    )
    hits = lines.select("row_id", "origin", (F.col("pos") + 1).alias("line_no"), "line", rule_hits(F.col("line")).alias("rules"))
    return hits.where(F.size("rules") > 0).select(
        F.lit(source).alias("source"), "row_id", "origin", "line_no", F.explode("rules").alias("rule"),
        F.col("line").rlike(PLACEHOLDER).alias("placeholder"),
    )


# G2
def scan_allowlist(findings: DataFrame, allowlist: DataFrame, key: list[str]) -> DataFrame:
    """Drop findings from allow-listed locations (an anti-join; Spark
    broadcasts the list when its measured size allows) and documentation
    placeholders."""
    return findings.join(allowlist, key, "left_anti").where(~F.col("placeholder"))


def env_file_findings(paths: DataFrame, id_col: str, path_col: str, source: str) -> DataFrame:
    """Tracked environment files are findings by their path alone."""
    p = F.col(path_col)
    hit = p.rlike(ENV_FILE) & ~p.rlike(ENV_TEMPLATE)
    return paths.where(hit).select(
        F.lit(source).alias("source"), F.col(id_col).alias("row_id"), F.lit(None).cast("string").alias("origin"),
        F.lit(0).alias("line_no"), F.lit("tracked_env_file").alias("rule"), F.lit(False).alias("placeholder"),
    )


# K1
def support_kpis(tickets: DataFrame) -> DataFrame:
    """Per category: containment (closed without escalation), mean handling
    time (``value`` stands for minutes) and escalation precision (escalated =
    stored priority High; justified = still open, i.e. urgency not lowered)."""
    escalated = F.col("priority") == "High"
    return tickets.groupBy("category").agg(
        F.count(F.lit(1)).alias("n_tickets"),
        F.avg(((F.col("status") == "Closed") & ~escalated).cast("double")).alias("containment_rate"),
        F.avg("value").alias("mean_handling_minutes"),
        F.try_divide(F.count_if(escalated & (F.col("status") != "Closed")), F.count_if(escalated)).alias(
            "escalation_precision"
        ),
    )


# K2
def model_cost(conversations: DataFrame) -> DataFrame:
    """Cost per inquiry per model: token usage per conversation (characters /
    4, rounded up; assistant turns are output), averaged, times the fixed
    price table - one aggregate row exploded over the four models, no join."""
    toks = F.ceil(F.length("text") / F.lit(CHARS_PER_TOKEN)).cast("long")
    per_conv = conversations.groupBy("conv_id").agg(
        F.sum(F.when(F.col("role") != "assistant", toks).otherwise(0)).alias("tin"),
        F.sum(F.when(F.col("role") == "assistant", toks).otherwise(0)).alias("tout"),
    )
    usage = per_conv.agg(
        F.count(F.lit(1)).alias("n_inquiries"),
        F.sum("tin").cast("decimal(20,0)").alias("tin"),
        F.sum("tout").cast("decimal(20,0)").alias("tout"),
    )
    prices = F.array(
        *[F.struct(F.lit(m).alias("model"), F.lit(i).cast("decimal(10,2)").alias("pin"), F.lit(o).cast("decimal(10,2)").alias("pout"))
          for m, i, o in MODEL_PRICES]
    )
    rows = usage.select("n_inquiries", "tin", "tout", F.explode(prices).alias("p"))
    cost = (F.col("tin") * F.col("p.pin") + F.col("tout") * F.col("p.pout")) / F.lit(1000000) / F.col("n_inquiries")
    return rows.select(
        F.col("p.model").alias("model"), F.col("p.pin").alias("input_price"), F.col("p.pout").alias("output_price"),
        "n_inquiries", F.round(cost.cast("decimal(38,10)"), 8).cast("double").alias("cost_per_inquiry"),
    )
