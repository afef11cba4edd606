"""Routing, sessions and e-mail contracts.

The rules the reference states to its language-model agents, made
deterministic: a broadcast join with the 6-row routing dimension, a keyword
intent baseline, session windows for subject carry-over, the e-mail gate and
validation chain, and one-e-mail-per-request as a grouped ``min_by``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions.text import WS, strip_text

# Fixed values ---------------------------------------------------------------
INTENTS = ("SMALL_TALK", "DATA_LOOKUP", "ACTION_REQUEST", "GENERAL_KNOWLEDGE", "UNCLEAR")
# intent, needs_lookup, analysis, sql, response, gmail
ROUTES = [
    ("SMALL_TALK", False, False, False, False, False),
    ("DATA_LOOKUP", True, True, True, False, False),
    ("ACTION_REQUEST", True, True, True, True, True),
    ("ACTION_REQUEST", False, False, False, True, True),
    ("GENERAL_KNOWLEDGE", False, False, False, False, False),
    ("UNCLEAR", False, False, False, False, False),
]
GATE = r"(?md)^SEND_EMAIL: yes$"
_WS_IN = WS[1:-1]
EMAIL_PATTERN = r"^[^@" + _WS_IN + r"]+@[^@" + _WS_IN + r"]+\.[A-Za-z]{2,}\z"
EMAIL_FIND = r"[^@" + _WS_IN + r"]+@[^@" + _WS_IN + r"]+\.[A-Za-z]{2,}"
BODY_WORD_LIMIT = 120
MSG_NO_RECIPIENT = "No recipient address was provided. The email was not sent."
MSG_BAD_ADDRESS_TAIL = "' is not a valid email address. The email was not sent. A customer name is not an address -- look up the address first."
MSG_NO_SUBJECT = "No subject was provided. The email was not sent."
MSG_NO_BODY = "No body was provided. The email was not sent."
MSG_NO_CREDENTIALS = (
    "Gmail credentials are not configured on this component. Set the sender address and app password Global Variables."
)
# Keyword baseline for the intent classifier (not claimed equal to a model).
_B = r"(?<![\p{L}\p{N}_])"
_E = r"(?![\p{L}\p{N}_])"
ACTION_WORDS = r"(?iu)" + _B + r"(send|email|e-mail|notify|escalate|follow up|remind)" + _E
LOOKUP_WORDS = r"(?iu)" + _B + r"(ticket|tickets|request|requests|status|open|customer|customers|priority|category|how many|count)" + _E
SMALL_TALK_WORDS = r"(?iu)^(hi|hello|hey|thanks|thank you|bye|goodbye|good morning|good afternoon|good evening|how are you)" + _E
QUESTION_WORDS = r"(?iu)^(what|who|why|how|when|where|explain|define)" + _E
PERSON_NAME = r"\p{Lu}\p{Ll}+ \p{Lu}\p{Ll}+"


def routes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        ROUTES, "intent string, needs_lookup boolean, runs_analysis boolean, runs_sql boolean, runs_response boolean, runs_gmail boolean"
    )


def has_email(col) -> Column:
    return F.coalesce((F.col(col) if isinstance(col, str) else col).rlike(EMAIL_FIND), F.lit(False))


# R1
def route_intents(messages: DataFrame, intent: str = "intent", text: str = "message") -> DataFrame:
    """Which agents and tools run, via a broadcast join with the fixed 6-row
    routing table. An action needs a lookup unless it names an address."""
    needs = F.when(F.col(intent) == "DATA_LOOKUP", True).when(
        F.col(intent) == "ACTION_REQUEST", ~has_email(text)
    ).otherwise(False)
    m = messages.withColumn("needs_lookup", needs)
    table = routes(messages.sparkSession).withColumnRenamed("intent", intent)
    return m.join(F.broadcast(table), [intent, "needs_lookup"], "left")


def tools_of(prefix: str = "") -> Column:
    names = [("runs_analysis", "Analysis"), ("runs_sql", "SQL"), ("runs_response", "Response"), ("runs_gmail", "Gmail")]
    return F.array_compact(F.array(*[F.when(F.col(prefix + c), F.lit(n)) for c, n in names]))


# R2
def classify_intent(text: str = "message", subject: str | None = "subject") -> Column:
    t = strip_text(F.coalesce(F.col(text), F.lit("")))
    has_target = has_email(t) | t.rlike(PERSON_NAME)
    if subject:
        has_target = has_target | F.col(subject).isNotNull()
    return (
        F.when(t.rlike(ACTION_WORDS), F.when(has_target, "ACTION_REQUEST").otherwise("UNCLEAR"))
        .when(t.rlike(LOOKUP_WORDS), "DATA_LOOKUP")
        .when(t.rlike(SMALL_TALK_WORDS), "SMALL_TALK")
        .when(t.rlike(QUESTION_WORDS) | t.endswith("?"), "GENERAL_KNOWLEDGE")
        .otherwise("UNCLEAR")
    )


# R3
CARRY_BLOCK = 1024


def carry_subject(messages: DataFrame, session: str = "session_id", order: str = "turn", subject: str = "subject",
                  block: int = CARRY_BLOCK) -> DataFrame:
    """Latest named subject so far in the session, as a two-level prefix scan.

    A plain window over the session puts a whole session in one task. Here
    turns are cut into blocks of ``block`` consecutive turn numbers: (1) the
    last subject inside each block is an aggregation keyed by (session,
    block); (2) the subject carried into each block is a window over those
    per-block rows (one row per block); (3) inside a block a window over at
    most ``block`` turns, falling back to the carried value. No window
    partition ever holds more than ``block`` rows or one row per block.
    """
    blk = F.floor(F.col(order) / block)
    m = messages.withColumn("__blk", blk)
    # last subject inside every block (null when the block names none), in one aggregation
    per_block = m.groupBy(session, "__blk").agg(
        F.max_by(subject, F.when(F.col(subject).isNotNull(), F.col(order))).alias("__last")
    )
    wb = Window.partitionBy(session).orderBy("__blk").rowsBetween(Window.unboundedPreceding, -1)
    into = per_block.withColumn("__in", F.last("__last", ignorenulls=True).over(wb)).select(session, "__blk", "__in")
    wi = Window.partitionBy(session, "__blk").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inner = m.withColumn("__own", F.last(subject, ignorenulls=True).over(wi))
    out = inner.join(into, [session, "__blk"], "left").withColumn(
        "session_subject", F.coalesce(F.col("__own"), F.col("__in"))
    )
    return out.drop("__blk", "__own", "__in")


# R4
def email_gate(col) -> Column:
    return F.coalesce((F.col(col) if isinstance(col, str) else col).rlike(GATE), F.lit(False))


# R5
def validate_email(to_email="to_email", subject="subject", body="body", sender="sender", password="password", configured: Column | None = None) -> Column:
    """``struct(success, message)`` in the fixed order of checks. ``configured`` (whether
    the sending account is set up) stands for ``sender`` and ``password``, so that no
    password need be in a plan."""
    clean = lambda c: strip_text(F.coalesce(F.col(c), F.lit("")))
    to, sub, bod = map(clean, (to_email, subject, body))
    ready = configured if configured is not None else (clean(sender) != "") & (clean(password) != "")
    message = (
        F.when(to == "", F.lit(MSG_NO_RECIPIENT))
        .when(~to.rlike(EMAIL_PATTERN), F.concat(F.lit("'"), to, F.lit(MSG_BAD_ADDRESS_TAIL)))
        .when(sub == "", F.lit(MSG_NO_SUBJECT))
        .when(bod == "", F.lit(MSG_NO_BODY))
        .when(~ready, F.lit(MSG_NO_CREDENTIALS))
        .otherwise(F.concat(F.lit("Email sent successfully to "), to, F.lit(".")))
    )
    ok = (to != "") & to.rlike(EMAIL_PATTERN) & (sub != "") & (bod != "") & ready
    return F.struct(ok.alias("success"), message.alias("message"), to.alias("recipient"), sub.alias("subject"))


# R6
def one_email_per_request(attempts: DataFrame, request: str = "request_id", order: str = "attempt") -> DataFrame:
    """Keep the first attempt per request: a grouped ``min_by`` (partial
    aggregation map-side, so a request with very many attempts is no hot spot)."""
    others = [c for c in attempts.columns if c != request]
    first = attempts.groupBy(request).agg(F.min_by(F.struct(*others), F.col(order)).alias("__first"))
    return first.select(request, "__first.*")


# R7
def word_count(col) -> Column:
    t = strip_text(F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit("")))
    return F.when(t == "", 0).otherwise(F.size(F.split(t, WS + "+")))


def email_body_limit(col) -> Column:
    return word_count(col) < BODY_WORD_LIMIT


# R8
def activation_audit(observed: DataFrame, intent: str = "intent") -> DataFrame:
    """Rates of over-activation (tools observed but not expected) per intent.
    ``observed`` carries ``expected_tools`` and ``observed_tools`` arrays."""
    over = F.array_except("observed_tools", "expected_tools")
    under = F.array_except("expected_tools", "observed_tools")
    return observed.groupBy(intent).agg(
        F.count(F.lit(1)).alias("n_messages"),
        F.count_if(F.size(over) > 0).alias("n_over_activated"),
        F.count_if(F.size(under) > 0).alias("n_under_activated"),
        F.avg((F.size(over) > 0).cast("double")).alias("over_activation_rate"),
    )


# S12
def email_outbox(requests: DataFrame, request: str = "request_id", order: str = "attempt") -> DataFrame:
    """Accepted e-mails: gate open, validation passed, first attempt only."""
    v = requests.withColumn("__r", validate_email()).where(email_gate("instructions") & F.col("__r.success"))
    firsts = one_email_per_request(v.select(request, order, "__r.recipient", "__r.subject", "body"), request, order)
    return firsts
