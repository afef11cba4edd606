"""Streams with state: any split into batches gives the batch result; late rows are kept and marked."""

import random

import pytest
from pyspark.sql import functions as F

from quire.operators import routing as G
from quire.session import shared_dir
from quire.streaming import sessions as Z

TURNS = "session_id long, turn long, subject string, at timestamp"
TRIES = "request_id string, attempt long, note string, late string, at timestamp"


@pytest.fixture(scope="module")
def run(spark):
    """Feed parts one after another, each by a query that starts anew from the checkpoint."""

    def feed(parts, schema, made):
        source, target, checkpoint = (shared_dir(spark, x) for x in ("s", "t", "c"))
        own = Z.state_session(spark)
        own.conf.set("spark.sql.shuffle.partitions", "2")
        for part in parts:
            rows = part if not isinstance(part, list) else spark.createDataFrame(part, schema).withColumn("at", F.col("at"))
            rows.coalesce(1).write.mode("append").parquet(source)
            Z.write_stream(made(own.readStream.schema(schema).parquet(source)), target, checkpoint).awaitTermination()
        return spark.read.parquet(target)

    return feed


def stamp(s):
    import datetime

    return datetime.datetime(2026, 1, 1, tzinfo=datetime.UTC).replace(tzinfo=None) + datetime.timedelta(seconds=s)


def rows_of(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


def test_subjects_equal_the_batch_result_for_any_split(spark, run):
    rng = random.Random(5)
    rows = [(s, t, f"S{rng.randrange(9)}" if rng.random() < 0.3 else None, stamp(t)) for s in (1, 2, None) for t in range(12)]
    batch = spark.createDataFrame(rows, TURNS).withColumn("s", F.coalesce("session_id", F.lit(-1)))
    want = rows_of(G.carry_subject(batch, session="s"), "session_id", "turn", "subject", "session_subject")
    rng.shuffle(rows)
    for cut in (7, 30):
        parts = [rows[:cut], rows[cut:], Z.closing(spark.createDataFrame(rows, TURNS))]
        out = run(parts, TURNS, lambda s: Z.session_subjects(s, delay="60 seconds", block=4))
        assert rows_of(Z.with_session_subject(out), "session_id", "turn", "subject", "session_subject") == want
        assert out.where("late").count() == 0


def test_a_row_behind_the_watermark_is_kept_and_marked(spark, run):
    early = [(1, 0, "A", stamp(0)), (1, 5, None, stamp(5)), (1, 90, "B", stamp(90))]
    late = [(1, 3, None, stamp(3)), (1, None, "C", None)]
    out = run([early, [(1, 91, None, stamp(91))], late], TURNS, lambda s: Z.session_subjects(s, delay="10 seconds", block=1000))
    assert rows_of(out.where("late"), "turn", "subject", "run_subject") == [(3, None, "A"), (None, "C", "C")]
    settled = rows_of(out.where("not late"), "turn", "run_subject")
    assert settled == [(0, "A"), (5, "A")]  # 90 and 91 still wait


def test_first_attempt_once_per_request(spark, run):
    rows = [(q, a, f"{q}{a}", "own", stamp(a)) for q in ("x", "y", None) for a in range(1, 6)] + [("x", 1, "x1", "own", stamp(1))]
    rows += [("z", a, f"z{a}", "own", stamp(a)) for a in range(4000, 1, -1)]  # very many attempts of one request
    random.Random(3).shuffle(rows)
    made = lambda s: Z.first_attempts(s, delay="9000 seconds")
    out = run([rows[:900], rows[900:], Z.closing(spark.createDataFrame(rows, TRIES))], TRIES, made)
    assert rows_of(out, "request_id", "attempt", "note", "late") == sorted(
        [("x", 1, "x1", False), ("y", 1, "y1", False), (None, 1, "None1", False), ("z", 2, "z2", False)], key=str)


def test_later_attempts_after_the_first_went_out_are_refused(spark, run):
    parts = [[("x", 1, "a", "", stamp(1)), ("y", 1, "b", "", stamp(500))], [("x", 2, "c", "", stamp(501)), ("w", 1, "d", "", stamp(2)), ("v", None, "e", "", stamp(600))]]
    out = run(parts, TRIES, lambda s: Z.first_attempts(s, delay="10 seconds"))
    assert rows_of(out, "request_id", "note", "late") == [("v", "e", True), ("w", "d", True), ("x", "a", False), ("y", "b", False)]
