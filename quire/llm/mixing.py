"""Mixing sources to target weights by entropy balancing, in DataFrame functions.

Every document gets a rate: the least change (in relative entropy) from its prior
under which each source's expected tokens meet the source's target and no rate
passes the cap. The dual has one multiplier for each source; the optimum is
``rate = min(cap, prior * exp(lambda))``. Newton iterations for all multipliers run
distributed, a source's documents being summed up into at most 64 * cap cells of
equal prior first. Rates are then rounded into whole copies: a document takes
``floor(rate)`` copies, and one more if a number that its doc_id fixes, less the
fraction, lies under the source's threshold. Two histogram passes of 4,096 bins set
the threshold where the source's taken tokens come nearest its target, so reruns
agree, and no source is sorted, collected or put in one task.

Defined results: null or empty text has size 0 and takes 0 tokens; null is a source of
its own, last in order; an empty table gives an empty result; rows that repeat a
doc_id are rounded alike; a null doc_id counts as the empty string there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import col, need, own, staged

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
CAP = 2
BINS = 4096
PRIOR_STEPS = 64
ITERATIONS = 60
BRACKET = 40.0  # multipliers lie within +- this


def size_of(text: str) -> Column:
    return F.coalesce(F.regexp_count(col(text).cast("string"), F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def weighted_targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """(source, source_size, target) from (source, source_size): sources in code point
    order, null last, weigh ``weights``, repeating, and share ``share`` times all
    sizes; a target stops at ``cap`` times its source's size and the excess is shared
    anew by weight. That is target = min(cap * size, weight * level): with sources in
    the order in which a rising level caps them, the level is the one reached when the
    first source is left uncapped; capping more would lower it. The windows hold one row for each source, never documents."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))
    most = F.col("source_size") * float(cap)
    rows = sources.withColumn("weight", w).withColumn("most", most).withColumn("turn", F.col("most") / F.col("weight"))
    order = Window.orderBy("turn", F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("asked", share * F.sum("source_size").over(every))
    rows = rows.withColumn("left", F.col("asked") - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
    rows = rows.withColumn("rest", F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    rows = rows.withColumn("level", F.col("left") / F.col("rest"))
    rows = rows.withColumn("level", F.coalesce(F.max(F.when(F.col("level") <= F.col("turn"), F.col("level"))).over(every), F.max("turn").over(every)))
    return rows.select("source", "source_size", F.least("most", F.col("weight") * F.col("level")).alias("target"))


def multipliers(cells: DataFrame, targets: DataFrame, cap: int = CAP, iterations: int = ITERATIONS) -> DataFrame:
    """(source, source_size, target, lam): Newton on each source's dual
    sum(tokens * min(cap, prior * exp(lam))) = target, from (source, prior, tokens)."""
    rows = cells.groupBy("source").agg(F.collect_list(F.struct("prior", F.col("tokens").cast("double").alias("tokens"))).alias("cells"))
    rows = targets.join(rows, targets["source"].eqNullSafe(rows["source"]), "left").select(targets["source"], "source_size", "target", "cells")

    def step(at: Column, _: Column) -> Column:
        lam = at["lam"]
        rate = lambda x: x["prior"] * F.exp(lam)
        sums = F.aggregate("cells", F.struct(F.lit(0.0).alias("taken"), F.lit(0.0).alias("slope")), lambda s, x: F.struct((s["taken"] + x["tokens"] * F.least(rate(x), F.lit(float(cap)))).alias("taken"), (s["slope"] + F.when(rate(x) < cap, x["tokens"] * rate(x)).otherwise(0.0)).alias("slope")))
        # a step that leaves the bracket (all documents at the cap, say) halves it instead
        over = sums["taken"] >= F.col("target")
        lo, hi = F.when(over, at["lo"]).otherwise(lam), F.when(over, lam).otherwise(at["hi"])
        move = lam - (sums["taken"] - F.col("target")) / sums["slope"]
        return F.struct(lo.alias("lo"), hi.alias("hi"), F.when((sums["slope"] > 0) & (move >= lo) & (move <= hi), move).otherwise((lo + hi) / 2).alias("lam"))

    start = F.struct(F.lit(-BRACKET).alias("lo"), F.lit(BRACKET).alias("hi"), F.lit(0.0).alias("lam"))
    lam = F.aggregate(F.sequence(F.lit(1), F.lit(iterations)), start, step)["lam"]
    full = F.col("target") >= F.col("source_size") * (cap * (1 - 1e-12))
    return rows.select("source", "source_size", "target", F.when(full, 700.0).when(F.col("target") <= 0, -700.0).otherwise(lam).alias("lam"))


def rates(cells: DataFrame, duals: DataFrame, cap: int) -> DataFrame:
    """(source, prior, source_size, target, rate, base, frac) of each cell: base copies
    for all its documents, and the share of them that gets one more."""
    d = duals.select(F.col("source").alias("s"), "source_size", "target", "lam")
    rows = cells.join(d, cells["source"].eqNullSafe(d["s"])).drop("s", "tokens")
    rate = F.least(F.lit(float(cap)), F.col("prior") * F.exp(F.col("lam")))
    rows = rows.withColumn("rate", rate).withColumn("near", F.round("rate"))
    rows = rows.withColumn("rate", F.when(F.abs(F.col("rate") - F.col("near")) < 1e-9, F.col("near")).otherwise(F.col("rate")))
    return rows.select("source", "prior", "source_size", "target", "rate", F.floor("rate").cast("int").alias("base"), (F.col("rate") - F.floor("rate")).alias("frac"))


def placed(rows: DataFrame, params: DataFrame) -> DataFrame:
    """``rows`` (with the struct column ``m``: key, source, prior) joined to their cell's
    parameters ``p``, and ``place``, in [-1, 1): one more copy for those under delta."""
    p = params.select(F.struct(*params.columns).alias("p"))
    out = rows.join(p, F.col("m.source").eqNullSafe(F.col("p.source")) & (F.col("m.prior") == F.col("p.prior")))
    hexed = F.substring(F.md5(F.coalesce(F.col("m.key").cast("string"), F.lit(""))), 1, 12)
    return out.withColumn("place", F.conv(hexed, 16, 10).cast("double") / F.lit(float(1 << 48)) - F.col("p.frac"))


def _crossing(hist: DataFrame, below: str) -> DataFrame:
    """The bin of each source in which base + gains reach the target."""
    w = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = hist.withColumn("upto", F.col(below) + F.sum("gain").over(w))
    rows = rows.where(F.col("upto") >= F.col("target"))
    return rows.groupBy("source").agg(F.min(F.struct("bin", (F.col("upto") - F.col("gain")).alias("under"), "gain", "target")).alias("x")).select("source", "x.*")


def thresholds(sized: DataFrame, params: DataFrame) -> DataFrame:
    """``params`` with delta: a document with a fraction takes one more copy if its
    place is under it."""
    out = placed(sized, params).select(F.col("p.source").alias("source"), F.col("p.target").alias("target"), F.col("m.size").alias("size"), "p.base", "p.frac", "place")
    bin1 = F.floor((F.col("place") + 1.0) * (BINS / 2))
    base = out.groupBy("source").agg(F.sum(F.col("size") * F.col("base")).alias("base"))
    more = out.where((F.col("frac") > 0) & (F.col("size") > 0))
    hist = more.groupBy("source", "target", bin1.alias("bin")).agg(F.sum("size").alias("gain"))
    nul = lambda a, b: a["source"].eqNullSafe(b["source"])
    hist = hist.join(base, nul(hist, base)).select(hist["*"], base["base"])
    first = staged(_crossing(hist, "base"), "bins")
    held = first.select(F.struct("source", "bin", "under").alias("f"))
    fine = more.join(held, F.col("source").eqNullSafe(F.col("f.source")) & (bin1 == F.col("f.bin")))
    inner = F.floor(((F.col("place") + 1.0) * (BINS / 2) - F.col("f.bin")) * BINS)
    fine = fine.groupBy("source", "target", F.col("f.bin").alias("outer"), F.col("f.under").alias("base"), inner.alias("bin")).agg(F.sum("size").alias("gain"))
    outer = fine.groupBy("source").agg(F.first("outer").alias("outer"))
    last = _crossing(fine, "base")
    last = last.join(outer, nul(last, outer)).select(last["*"], "outer")
    over = (F.col("under") + F.col("gain") - F.col("target")) <= (F.col("target") - F.col("under"))
    delta = (F.col("outer") + (F.col("bin") + over.cast("int")) / F.lit(float(BINS))) / (BINS / 2) - 1.0
    last = last.select(F.col("source").alias("s"), delta.alias("delta"))
    return params.join(last, params["source"].eqNullSafe(last["s"]), "left").select(*params.columns, F.coalesce("delta", F.lit(1.0)).alias("delta"))


def _keyed(docs: DataFrame, doc_id: str, source: str, size: Column | None, prior: Column | None) -> Column:
    level = F.lit(1.0) if prior is None else F.greatest(F.lit(1.0), F.round(F.coalesce(prior.cast("double"), F.lit(1.0)) * PRIOR_STEPS)) / PRIOR_STEPS
    measured = [] if size is None else [size.alias("size")]
    return F.struct(col(doc_id).alias("key"), col(source).alias("source"), level.alias("prior"), *measured)


def parameters(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP, prior: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(sized rows, parameters of each source); texts are measured once."""
    need(docs, doc_id, source, text)
    sized = staged(docs.select(_keyed(docs, doc_id, source, size_of(text), prior).alias("m")), "sizes", few=True)
    sources = sized.groupBy(F.col("m.source").alias("source"), F.col("m.prior").alias("prior")).agg(F.sum("m.size").alias("tokens"))
    sources = staged(sources, "cells")
    targets = weighted_targets(sources.groupBy("source").agg(F.sum("tokens").alias("source_size")), weights, share, cap)
    params = staged(rates(sources, multipliers(sources, targets, cap), cap), "rates")
    return sized, staged(thresholds(sized, params), "thresholds")


def _copies() -> Column:
    return F.col("p.base") + ((F.col("p.frac") > 0) & (F.col("place") < F.col("p.delta"))).cast("int")


def mix_report(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", cap: int = CAP, **options) -> DataFrame:
    """One row for each document: doc_id, size, source_size, target, taken, rate, copies."""
    sized, params = parameters(docs, doc_id, source, text, cap=cap, **options)
    out = placed(sized, params).withColumn("copies", _copies())
    return out.select(F.col("m.key").alias("doc_id"), F.col("m.size").alias("size"), F.col("p.source_size").alias("source_size"), F.col("p.target").alias("target"), (F.col("m.size") * F.col("copies")).alias("taken"), F.col("p.rate").alias("rate"), "copies")


def mixed(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", cap: int = CAP, prior: Column | None = None, **options) -> DataFrame:
    """The mix itself: every row of ``docs`` repeated as often as it is taken, with the
    columns of ``docs``. Texts are measured once, for the parameters, and never shuffled."""
    _, params = parameters(docs, doc_id, source, text, cap=cap, prior=prior, **options)
    n, row = own("n"), own("row")
    packed = docs.select(F.struct(*map(col, docs.columns)).alias(row), _keyed(docs, doc_id, source, None, prior).alias("m"))
    out = placed(packed, params).select(row, F.explode(F.array_repeat(F.lit(1), _copies())).alias(n))
    return out.select(*[F.col(row)[c].alias(c) for c in docs.columns])


#: DuckDB: the same targets and the same two histogram passes, as windows.
MIX_SQL = """
with sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as size,
    cast(('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 12)) as bigint) / 281474976710656.0 as u from documents),
src as (select source, cast(sum(size) as bigint) source_size from sized group by 1),
weighed as (select *, [5.0, 2.0, 1.0][(row_number() over (order by source nulls last) - 1) % 3 + 1] w, 2.0 * source_size most, 1.5 * sum(source_size) over () asked from src),
levels as (select *, most / w turn, (asked - coalesce(sum(most) over (order by most / w, source nulls last rows between unbounded preceding and 1 preceding), 0))
  / sum(w) over (order by most / w, source nulls last rows between current row and unbounded following) as level from weighed),
targets as (select source, source_size, least(most, w * (select coalesce(max(level) filter (level <= turn), max(turn)) from levels)) target from levels),
rate0 as (select doc_id, size, s.source, source_size, target, u, case when target >= 2.0 * source_size * (1 - 1e-12) then 2.0 else target / source_size end q from sized s join targets t on s.source is not distinct from t.source),
rate as (select *, case when abs(q - round(q)) < 1e-9 then round(q) else q end r from rate0),
placed as (select *, floor(r) base, case when r < 2 and r > floor(r) then size else 0 end gain, u - (r - floor(r)) as place from rate),
binned as (select *, floor((place + 1.0) * 2048) b1, floor(((place + 1.0) * 2048 - floor((place + 1.0) * 2048)) * 4096) b2 from placed),
bases as (select source, sum(size * base) base from placed group by 1),
bins as (select source, target, b1, b2, sum(gain) gain from binned where gain > 0 group by all),
run as (select b.*, s.base + sum(gain) over (partition by b.source order by b1, b2) upto from bins b join bases s on b.source is not distinct from s.source),
crossed as (select source, min_by(struct_pack(b1, b2, upto, gain, target), b1 * 4096 + b2) x from run where upto >= target group by 1),
cuts as (select source, (x.b1 + (x.b2 + case when x.upto - x.target <= x.target - (x.upto - x.gain) then 1 else 0 end) / 4096.0) / 2048 - 1.0 delta from crossed)
select doc_id, size, source_size, cast(target as double) target,
  cast(size * least(2, base + case when gain > 0 and place < coalesce(delta, 1.0) then 1 else 0 end) as bigint) taken
from binned b left join cuts c on b.source is not distinct from c.source
"""
