"""Registered routing, session and e-mail contract queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions.text import WS
from quire.operators import routing as G
from quire.plans import oracle as O
from quire.plans.registry import register, round_doubles
from quire.plans.fixtures import INTENTS, messages

_WS_IN = WS[1:-1]
_EMAIL_FIND_RE2 = f"[^@{_WS_IN}]+@[^@{_WS_IN}]+\\.[A-Za-z]{{2,}}"
_EMAIL_FULL_RE2 = f"^[^@{_WS_IN}]+@[^@{_WS_IN}]+\\.[A-Za-z]{{2,}}$"
_B2 = "(^|[^\\pL\\pN_])"
_E2 = "([^\\pL\\pN_]|$)"


def _re2(p: str) -> str:
    return p.replace("(?iu)", "(?i)").replace(G._B, _B2).replace(G._E, _E2)


_MSG = f"""SELECT conv_id AS session_id, turn, text AS message,
  ([{', '.join(O.q(i) for i in INTENTS)}])[(conv_id + turn) % 5 + 1] AS intent,
  CASE WHEN turn % 3 = 0 THEN 'Customer ' || (conv_id % 150) END AS subject
FROM conversations WHERE role = 'user'"""
_ROUTES = "SELECT * FROM (VALUES " + ", ".join(
    "(" + ", ".join(O.q(v) if isinstance(v, str) else ("TRUE" if v else "FALSE") for v in r) + ")" for r in G.ROUTES
) + ") r(intent, needs_lookup, runs_analysis, runs_sql, runs_response, runs_gmail)"
_ROUTED = f"""WITH m AS ({_MSG}),
ml AS (SELECT *, CASE WHEN intent = 'DATA_LOOKUP' THEN TRUE
                      WHEN intent = 'ACTION_REQUEST' THEN NOT coalesce(regexp_matches(message, {O.q(_EMAIL_FIND_RE2)}), FALSE)
                      ELSE FALSE END AS needs_lookup FROM m),
rt AS ({_ROUTES}),
routed AS (SELECT ml.*, rt.runs_analysis, rt.runs_sql, rt.runs_response, rt.runs_gmail
           FROM ml LEFT JOIN rt ON ml.intent = rt.intent AND ml.needs_lookup = rt.needs_lookup)"""


@register(
    "route_intents",
    f"""{_ROUTED}
SELECT session_id, turn, intent, needs_lookup, runs_analysis, runs_sql, runs_response, runs_gmail FROM routed""",
)
def route_intents(spark, sf_dir):
    return G.route_intents(messages(spark, sf_dir)).select(
        "session_id", "turn", "intent", "needs_lookup", "runs_analysis", "runs_sql", "runs_response", "runs_gmail"
    )


def _classify_sql(t: str, subject: str) -> str:
    st = O.strip(f"coalesce({t}, '')")
    target = f"(regexp_matches({st}, {O.q(_EMAIL_FIND_RE2)}) OR regexp_matches({st}, {O.q(G.PERSON_NAME)}) OR {subject} IS NOT NULL)"
    return f"""CASE WHEN regexp_matches({st}, {O.q(_re2(G.ACTION_WORDS))}) THEN CASE WHEN {target} THEN 'ACTION_REQUEST' ELSE 'UNCLEAR' END
     WHEN regexp_matches({st}, {O.q(_re2(G.LOOKUP_WORDS))}) THEN 'DATA_LOOKUP'
     WHEN regexp_matches({st}, {O.q(_re2(G.SMALL_TALK_WORDS))}) THEN 'SMALL_TALK'
     WHEN regexp_matches({st}, {O.q(_re2(G.QUESTION_WORDS))}) OR suffix({st}, '?') THEN 'GENERAL_KNOWLEDGE'
     ELSE 'UNCLEAR' END"""


@register(
    "classify_intent",
    f"WITH m AS ({_MSG}) SELECT session_id, turn, {_classify_sql('message', 'subject')} AS predicted FROM m",
)
def classify_intent(spark, sf_dir):
    return messages(spark, sf_dir).select("session_id", "turn", G.classify_intent("message", "subject").alias("predicted"))


@register(
    "carry_subject",
    f"""WITH m AS ({_MSG})
SELECT session_id, turn, subject,
       last_value(subject IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY turn
                                              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session_subject
FROM m""",
)
def carry_subject(spark, sf_dir):
    return G.carry_subject(messages(spark, sf_dir)).select("session_id", "turn", "subject", "session_subject")


_INSTR = """message || CASE turn % 4 WHEN 0 THEN chr(10) || 'SEND_EMAIL: yes' WHEN 1 THEN chr(10) || 'SEND_EMAIL: no'
                          WHEN 2 THEN ' SEND_EMAIL: yes' ELSE '' END"""


def _instructions():
    t = F.col("turn") % 4
    tail = (
        F.when(t == 0, F.lit("\nSEND_EMAIL: yes")).when(t == 1, F.lit("\nSEND_EMAIL: no"))
        .when(t == 2, F.lit(" SEND_EMAIL: yes")).otherwise(F.lit(""))
    )
    return F.concat(F.col("message"), tail)


@register(
    "email_gate",
    f"WITH m AS ({_MSG}) SELECT session_id, turn, regexp_matches({_INSTR}, '(?m)^SEND_EMAIL: yes$') AS send FROM m",
)
def email_gate(spark, sf_dir):
    return messages(spark, sf_dir).select("session_id", "turn", G.email_gate(_instructions()).alias("send"))


_EREQ = f"""SELECT session_id || ':' || turn AS request_id, session_id, turn, message AS body, {_INSTR} AS instructions,
  CASE turn % 5 WHEN 0 THEN 'user' || session_id || '@example.com' WHEN 1 THEN 'Customer ' || session_id
       WHEN 2 THEN '' WHEN 3 THEN 'user' || session_id || '@example.com' ELSE '  USER@Example.org  ' END AS to_email,
  CASE WHEN turn % 3 = 0 THEN NULL ELSE 'Update on your request (ticket #' || session_id || ')' END AS subject,
  CASE WHEN session_id % 10 = 0 THEN '' ELSE 'support@example.com' END AS sender,
  'app-password' AS password
FROM ({_MSG})"""


def email_requests(spark, sf_dir):
    m = messages(spark, sf_dir)
    t5 = F.col("turn") % 5
    sid = F.col("session_id").cast("string")
    to = (
        F.when(t5 == 0, F.concat(F.lit("user"), sid, F.lit("@example.com")))
        .when(t5 == 1, F.concat(F.lit("Customer "), sid))
        .when(t5 == 2, F.lit(""))
        .when(t5 == 3, F.concat(F.lit("user"), sid, F.lit("@example.com")))
        .otherwise(F.lit("  USER@Example.org  "))
    )
    return m.select(
        F.concat_ws(":", "session_id", "turn").alias("request_id"), "session_id", "turn",
        F.col("message").alias("body"), _instructions().alias("instructions"), to.alias("to_email"),
        F.when(F.col("turn") % 3 == 0, F.lit(None).cast("string")).otherwise(
            F.concat(F.lit("Update on your request (ticket #"), sid, F.lit(")"))
        ).alias("subject"),
        F.when(F.col("session_id") % 10 == 0, F.lit("")).otherwise(F.lit("support@example.com")).alias("sender"),
        F.lit("app-password").alias("password"),
    )


def _validate_sql(subject: str = "subject") -> str:
    to = O.strip("coalesce(to_email, '')")
    sub = O.strip(f"coalesce({subject}, '')")
    bod = O.strip("coalesce(body, '')")
    snd = O.strip("coalesce(sender, '')")
    pwd = O.strip("coalesce(password, '')")
    ok = f"regexp_matches({to}, {O.q(_EMAIL_FULL_RE2)})"
    msg = f"""CASE WHEN {to} = '' THEN {O.q(G.MSG_NO_RECIPIENT)}
     WHEN NOT {ok} THEN '''' || {to} || {O.q(G.MSG_BAD_ADDRESS_TAIL)}
     WHEN {sub} = '' THEN {O.q(G.MSG_NO_SUBJECT)} WHEN {bod} = '' THEN {O.q(G.MSG_NO_BODY)}
     WHEN {snd} = '' OR {pwd} = '' THEN {O.q(G.MSG_NO_CREDENTIALS)}
     ELSE 'Email sent successfully to ' || {to} || '.' END"""
    success = f"({to} <> '' AND {ok} AND {sub} <> '' AND {bod} <> '' AND {snd} <> '' AND {pwd} <> '')"
    return f"{success} AS success, {msg} AS message, {to} AS recipient, {sub} AS subj"


@register(
    "validate_email",
    f"WITH r AS ({_EREQ}) SELECT request_id, success, message FROM (SELECT request_id, {_validate_sql()} FROM r)",
)
def validate_email(spark, sf_dir):
    r = email_requests(spark, sf_dir).withColumn("v", G.validate_email())
    return r.select("request_id", "v.success", "v.message")


def _attempts(spark, sf_dir):
    r = email_requests(spark, sf_dir)
    return r.withColumn("attempt", F.explode(F.sequence(F.lit(1), (F.col("turn") % 3 + 1).cast("int"))))


_ATT = f"SELECT r.*, a.attempt FROM ({_EREQ}) r, LATERAL (SELECT unnest(range(1, CAST(r.turn % 3 + 2 AS BIGINT))) AS attempt) a"


@register(
    "one_email_per_request",
    f"""WITH a AS ({_ATT}), v AS (SELECT request_id, attempt, {_validate_sql()} FROM a)
SELECT request_id, attempt, success, recipient FROM (
  SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY attempt) AS rn FROM v) WHERE rn = 1""",
)
def one_email_per_request(spark, sf_dir):
    a = _attempts(spark, sf_dir).withColumn("v", G.validate_email())
    return G.one_email_per_request(a.select("request_id", "attempt", "v.success", "v.recipient"))


@register(
    "email_body_limit",
    f"""WITH m AS ({_MSG}), s AS (SELECT session_id, turn, {O.strip("coalesce(message, '')")} AS b FROM m),
w AS (SELECT session_id, turn, CASE WHEN b = '' THEN 0 ELSE len(string_split_regex(b, {O.q(WS + '+')})) END AS n_words FROM s)
SELECT session_id, turn, n_words, n_words < {G.BODY_WORD_LIMIT} AS within_limit FROM w""",
)
def email_body_limit(spark, sf_dir):
    m = messages(spark, sf_dir)
    return m.select("session_id", "turn", G.word_count("message").alias("n_words"), G.email_body_limit("message").alias("within_limit"))


@register(
    "activation_audit",
    f"""{_ROUTED},
ex AS (SELECT *, list_filter(['Analysis', 'SQL', 'Response', 'Gmail'],
          lambda t: (t = 'Analysis' AND runs_analysis) OR (t = 'SQL' AND runs_sql) OR (t = 'Response' AND runs_response)
                    OR (t = 'Gmail' AND runs_gmail)) AS expected_tools FROM routed),
ob AS (SELECT *, CASE WHEN turn % 4 = 0 THEN list_distinct(list_concat(expected_tools, ['SQL']))
                      WHEN turn % 5 = 0 THEN list_filter(expected_tools, lambda t: t <> 'Gmail')
                      ELSE expected_tools END AS observed_tools FROM ex),
f AS (SELECT intent, len(list_filter(observed_tools, lambda t: NOT list_contains(expected_tools, t))) > 0 AS over,
             len(list_filter(expected_tools, lambda t: NOT list_contains(observed_tools, t))) > 0 AS under FROM ob)
SELECT intent, count(*) AS n_messages, count(*) FILTER (WHERE over) AS n_over_activated,
       count(*) FILTER (WHERE under) AS n_under_activated, round(avg(CASE WHEN over THEN 1.0 ELSE 0.0 END), 6) AS over_activation_rate
FROM f GROUP BY intent""",
)
def activation_audit(spark, sf_dir):
    r = G.route_intents(messages(spark, sf_dir)).withColumn("expected_tools", G.tools_of())
    observed = (
        F.when(F.col("turn") % 4 == 0, F.array_union("expected_tools", F.array(F.lit("SQL"))))
        .when(F.col("turn") % 5 == 0, F.array_remove("expected_tools", "Gmail"))
        .otherwise(F.col("expected_tools"))
    )
    return round_doubles(G.activation_audit(r.withColumn("observed_tools", observed)))


@register(
    "email_outbox",
    f"""WITH a AS ({_ATT}), v AS (SELECT request_id, attempt, body, instructions, {_validate_sql()} FROM a),
ok AS (SELECT * FROM v WHERE regexp_matches(instructions, '(?m)^SEND_EMAIL: yes$') AND success)
SELECT request_id, attempt, recipient, subject, body FROM (
  SELECT request_id, attempt, recipient, subj AS subject, body,
         row_number() OVER (PARTITION BY request_id ORDER BY attempt) AS rn FROM ok) WHERE rn = 1""",
)
def email_outbox(spark, sf_dir):
    return G.email_outbox(_attempts(spark, sf_dir))
