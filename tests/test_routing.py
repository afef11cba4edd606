"""Routing rules on the published example messages and e-mail contracts."""

from pyspark.sql import functions as F

from quire.operators import routing as G

EXAMPLES = [
    ("Hi there", "SMALL_TALK"),
    ("Hello there", "SMALL_TALK"),
    ("What does SLA stand for?", "GENERAL_KNOWLEDGE"),
    ("What is a service level agreement?", "GENERAL_KNOWLEDGE"),
    ("Which support requests are still open?", "DATA_LOOKUP"),
    ("How many support requests are open?", "DATA_LOOKUP"),
    ("Status of Sarah Cohen's ticket?", "DATA_LOOKUP"),
    ("Tickets from alice@example.com?", "DATA_LOOKUP"),
    ("Send the email", "UNCLEAR"),
    ("Email John Smith about his login issue", "ACTION_REQUEST"),
    ("Send an email to john@example.com saying hello", "ACTION_REQUEST"),
]


def test_keyword_baseline_on_examples(spark):
    df = spark.createDataFrame([(m, None) for m, _ in EXAMPLES], "message string, subject string")
    got = [r["p"] for r in df.select(G.classify_intent("message", "subject").alias("p")).collect()]
    assert got == [i for _, i in EXAMPLES]


def test_routes_activate_selectively(spark):
    msgs = spark.createDataFrame(
        [(1, "Hi", "SMALL_TALK"), (2, "open tickets?", "DATA_LOOKUP"), (3, "email john@example.com", "ACTION_REQUEST"),
         (4, "email John about it", "ACTION_REQUEST")], "id int, message string, intent string")
    r = {x["id"]: x for x in G.route_intents(msgs).select("id", G.tools_of().alias("tools")).collect()}
    assert r[1]["tools"] == [] and r[2]["tools"] == ["Analysis", "SQL"]
    assert r[3]["tools"] == ["Response", "Gmail"] and r[4]["tools"] == ["Analysis", "SQL", "Response", "Gmail"]


def test_email_refusals_in_order(spark):
    rows = [
        ("", "s", "b", "me@x.com", "pw", G.MSG_NO_RECIPIENT),
        ("John Smith", "s", "b", "me@x.com", "pw", "'John Smith'" + G.MSG_BAD_ADDRESS_TAIL[1:]),
        ("john@example.com", " ", "b", "me@x.com", "pw", G.MSG_NO_SUBJECT),
        ("john@example.com", "s", "", "me@x.com", "pw", G.MSG_NO_BODY),
        ("john@example.com", "s", "b", "", "pw", G.MSG_NO_CREDENTIALS),
        (" john@example.com ", "s", "b", "me@x.com", "pw", "Email sent successfully to john@example.com."),
    ]
    df = spark.createDataFrame(rows, "to_email string, subject string, body string, sender string, password string, want string")
    out = df.select("want", G.validate_email().alias("v")).collect()
    for r in out:
        assert r["v"]["message"] == r["want"]
    assert [r["v"]["success"] for r in out] == [False] * 5 + [True]


def test_gate_and_word_limit(spark):
    df = spark.createDataFrame([("x\nSEND_EMAIL: yes",), ("SEND_EMAIL: no",), ("x SEND_EMAIL: yes",), (None,)], "t string")
    assert [r["g"] for r in df.select(G.email_gate("t").alias("g")).collect()] == [True, False, False, False]
    w = spark.createDataFrame([(" ".join(["w"] * 119),), (" ".join(["w"] * 120),), ("",)], "b string")
    assert [r["ok"] for r in w.select(G.email_body_limit("b").alias("ok")).collect()] == [True, False, True]


def test_subject_carry_and_one_email(spark):
    m = spark.createDataFrame([(1, 0, "John Smith"), (1, 1, None), (1, 2, "Emma"), (1, 3, None)], "session_id int, turn int, subject string")
    got = [r["session_subject"] for r in G.carry_subject(m).orderBy("turn").collect()]
    assert got == ["John Smith", "John Smith", "Emma", "Emma"]
    a = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (2, 5, "c")], "request_id int, attempt int, x string")
    assert sorted((r["request_id"], r["x"]) for r in G.one_email_per_request(a).collect()) == [(1, "a"), (2, "c")]


def test_carry_subject_two_level_equals_plain_window(spark):
    from pyspark.sql import Window

    rows = [(s, t, (f"subj{s}-{t}" if (s * 7 + t) % 5 == 0 else None)) for s in range(3) for t in range(23)]
    m = spark.createDataFrame(rows, "session_id int, turn int, subject string")
    w = Window.partitionBy("session_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    want = {(r["session_id"], r["turn"]): r["v"] for r in m.select("session_id", "turn", F.last("subject", True).over(w).alias("v")).collect()}
    got = {(r["session_id"], r["turn"]): r["session_subject"] for r in G.carry_subject(m, block=4).collect()}
    assert got == want


def test_support_flow_golden(spark):
    from quire.operators import support as U
    from quire.plans.support_flow import support_flow

    msgs = spark.createDataFrame(
        [(1, 0, "Hi there", None), (1, 1, "What is the status of her ticket?", "Sarah Cohen"),
         (2, 0, "Tickets from alice@example.com?", "alice@example.com"), (3, 0, "Send the email", None),
         (4, 0, "Email John Smith about his login issue", "John Smith")],
        "session_id int, turn int, message string, subject string")
    got = {(r["session_id"], r["turn"]): r for r in support_flow(msgs, U.load_support_requests(spark)).collect()}
    assert got[(1, 0)]["predicted"] == got[(1, 0)]["route_intent"] == "SMALL_TALK" and not got[(1, 0)]["runs_sql"]
    assert got[(1, 1)]["predicted"] == "DATA_LOOKUP" and got[(1, 1)]["lookup_found"]
    assert got[(1, 1)]["lookup_urgency"] == "Medium"
    assert got[(2, 0)]["runs_sql"] and got[(2, 0)]["lookup_found"] is False
    assert got[(3, 0)]["predicted"] == "UNCLEAR" and not got[(3, 0)]["runs_gmail"]
    act = got[(4, 0)]
    assert act["predicted"] == "ACTION_REQUEST" and act["runs_sql"] and act["runs_gmail"]
    assert act["email_sent"] and act["email_result"] == "Email sent successfully to john@example.com."
    assert got[(1, 0)]["email_sent"] is None


def test_validate_email_column_equals_plain_python(spark):
    import re

    from conftest import SF_SMALL
    from quire.plans.q_routing import email_requests

    pattern = re.compile(r"^[^@\s]+@[^@\s]+\.[A-Za-z]{2,}$")

    def check(to, sub, body, snd, pwd):
        to, sub, body, snd, pwd = ((x or "").strip() for x in (to, sub, body, snd, pwd))
        if not to:
            return False, G.MSG_NO_RECIPIENT
        if not pattern.match(to):
            return False, f"'{to}" + G.MSG_BAD_ADDRESS_TAIL
        if not sub:
            return False, G.MSG_NO_SUBJECT
        if not body:
            return False, G.MSG_NO_BODY
        if not snd or not pwd:
            return False, G.MSG_NO_CREDENTIALS
        return True, f"Email sent successfully to {to}."

    rows = email_requests(spark, SF_SMALL).withColumn("v", G.validate_email()).collect()
    assert rows
    for r in rows:
        assert (r["v"]["success"], r["v"]["message"]) == check(r["to_email"], r["subject"], r["body"], r["sender"], r["password"])
