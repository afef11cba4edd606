"""The support-message flow as one plan: subject carry (R3) -> intent (R2) ->
routing (R1) -> ticket lookup and urgency (A3, A4) for the messages routed to
the SQL tool -> gate and validation (R4, R5) of the e-mail for the messages
routed to Gmail (recipient: an address in the message, else the single
customer the lookup matched). Each step is a column, a join or a keyed
aggregation; the language model of the reference is replaced by the rule
baseline or the given intent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators import routing as G
from quire.operators import support as U

def support_flow(messages: DataFrame, tickets: DataFrame, mail_configured: bool = True) -> DataFrame:
    """Routes on the given ``intent`` when the messages carry one (the
    decision of the reference's model), otherwise on the rule baseline; the
    baseline's ``predicted`` intent is always reported beside it. A message is known by
    (session_id, turn). ``mail_configured``: whether the sending account is set up (its
    credentials are the sender's matter and never enter the plan)."""
    m = G.carry_subject(messages)
    m = m.withColumn("predicted", G.classify_intent("message", "session_subject"))
    m = m.withColumn("route_intent", F.col("intent") if "intent" in messages.columns else F.col("predicted"))
    routed = G.route_intents(m, intent="route_intent", text="message")
    requests = routed.where(F.col("runs_sql")).select(
        "session_id", "turn", F.coalesce(F.col("session_subject"), F.lit("")).alias("term"),
    )
    lookups = U.ticket_lookup(requests, tickets).select(
        "session_id", "turn", F.col("found").alias("lookup_found"), F.col("match_kind").alias("lookup_match"),
        F.col("urgency").alias("lookup_urgency"), F.col("classification").alias("__class"), F.col("email").alias("__email"),
    )
    out = routed.join(lookups, ["session_id", "turn"], "left")
    in_msg = F.regexp_extract("message", G.EMAIL_FIND, 0)
    mail = out.select(
        "*",
        F.coalesce(F.when(in_msg != "", in_msg), F.col("__email")).alias("to_email"),
        F.when(F.col("__class").isNotNull(), F.concat(F.lit("Update on your "), F.col("__class"), F.lit(" request"))).alias(
            "mail_subject"
        ),
        F.col("message").alias("body"),
        # the orchestrator adds the gate line to every action it hands over
        F.concat(F.col("message"), F.lit("\nSEND_EMAIL: yes")).alias("instructions"),
    )
    v = G.validate_email(subject="mail_subject", configured=F.lit(mail_configured))
    sent = G.email_gate("instructions") & v["success"]
    return mail.select(
        "session_id", "turn", "session_subject", "route_intent", "predicted", "needs_lookup", "runs_analysis", "runs_sql",
        "runs_response", "runs_gmail", "lookup_found", "lookup_match", "lookup_urgency",
        F.when(F.col("runs_gmail"), sent).alias("email_sent"),
        F.when(F.col("runs_gmail"), v["message"]).alias("email_result"),
    )
