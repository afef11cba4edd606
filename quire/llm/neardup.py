"""MinHash near-dedup: improved consistent weighted sampling over TF-IDF
shingles, banded, every candidate verified by weighted Jaccard similarity.

* A shingle is five consecutive words (a shorter text is one shingle); its weight
  is ``tf * idf`` with ``idf = 1 + ln(N / df) / (8 ln N)`` in 16 steps from 1 to 1.125:
  damped, or the document frequency of a large group of near copies would push
  what they share under what they differ in, and split the group.
  ``df`` comes from a two-row count-min sketch over all documents: its size is a
  parameter, so what is broadcast does not grow with the corpus.
* Consistent weighted sampling draws (r, c, beta) of each shingle and sample from
  one table of 65,536 gamma/uniform triples, so a sample is a lookup and a minimum.
* 18 bands of 4 samples: a pair of similarity 0.8 is missed with probability 8e-5.
  Total weights bound the similarity, so pairs whose weights differ more than
  ``similarity`` allows are never candidates.
* A bucket of up to ``SMALL`` members gives all pairs. In a larger one every member is
  compared with the least member only. Who fails, and who the triangle inequality
  (1 - weighted Jaccard is a metric) cannot excuse from a comparison with those, is
  left over; the left-over of a bucket is split by total weight and compared in blocks
  of at most about BLOCK members: first by the number of equal samples of 72 (fewer than
  EQUAL has probability 4.5e-4 at similarity 0.8), then exactly, skipping pairs that are
  connected already. So a group of near copies costs as many comparisons as it has
  members, whatever its size, and pairs that are not links never become rows.

Defined results: null text links with nothing; texts without words are copies only
of equal texts; documents with the same word sequence are exact copies. Rows that
repeat a doc_id count as one document; rows without a doc_id are kept as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import col, components, lean, need, staged
from quire.llm.words import U, Words, mix, portions, signed

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 18, 4
SMALL = 8
BLOCK = 512
EQUAL = 46
MAX_BROADCAST_IDS = 4_000_000  # 32 MB of ids, about 100 MB as a hash table
SKETCH_BITS = 21  # buckets of each of the sketch's two rows, as a power of two
CHUNK = 1 << 14
STEPS = 15
DAMP = 8.0 * STEPS
TRIPLES = 1 << 16
SALT_ROWS = 256  # members that one shipped copy of a leader serves


def shingles(w: Words, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, 44-bit shingle, count), sorted by row and shingle, of a portion."""
    rows, n = w.rows(), len(w.hashes)
    x = w.windows(k)
    whole = rows[: len(x)] == rows[k - 1 :] if len(x) else np.zeros(0, bool)
    short = np.flatnonzero((w.counts > 0) & (w.counts < k))
    key = np.concatenate((x[whole], w.row_hashes()[0][short] if n else np.zeros(0, U))) >> U(20)
    row = np.concatenate((rows[: len(x)][whole], short)).astype(U)
    both = np.sort((row << U(44)) | key)
    new = np.flatnonzero(np.concatenate(([True], both[1:] != both[:-1]))) if len(both) else np.zeros(0, np.int64)
    one = both[new]
    return (one >> U(44)).astype(np.int64), one & U((1 << 44) - 1), np.diff(np.append(new, len(both)))


def places(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A shingle's bucket in each row of the sketch."""
    mask = U((1 << bits) - 1)
    return (key & mask).astype(np.int64), ((key >> U(44 - bits)) & mask).astype(np.int64)


def narrow(counts: np.ndarray) -> bytes:
    kind = np.min_scalar_type(int(counts.max(initial=0)))
    return bytes([kind.itemsize]) + counts.astype(kind).tobytes()


def widen(b: bytes) -> np.ndarray:
    return np.frombuffer(b, dtype=f"u{b[0]}", offset=1).astype(np.int64)


def idf_codes(docs: DataFrame, text: str, bits: int = SKETCH_BITS) -> np.ndarray:
    """The idf step (0 to 15) of every bucket of the count-min sketch of document
    frequencies over all rows: uint8, two rows of 2^bits. Partial sketches are
    summed by chunk in two levels, so no task holds more than one chunk of many."""
    import pandas as pd

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n, held = np.zeros((2, 1 << bits), np.uint32), 0, [np.zeros(0, U)]

        def flush() -> None:
            for line, at in zip(total, places(np.concatenate(held), bits), strict=True):
                line += np.bincount(at, minlength=1 << bits).astype(np.uint32)
            held[:] = [np.zeros(0, U)]

        for batch in batches:
            for part in portions(batch, "text"):
                w = Words(part.column(0))
                n += int((w.counts > 0).sum())
                held.append(shingles(w)[1])
                if sum(map(len, held)) > 1 << 20:
                    flush()
        flush()
        flat = total.reshape(-1, min(CHUNK, 1 << bits))
        if n:
            lane = int(np.random.default_rng(int(total[0].argmax()) + n).integers(64))
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([-1, *range(len(flat))], pa.int32()), "lane": pa.array([lane] * (len(flat) + 1), pa.int32()), "counts": pa.array([narrow(np.array([n])), *map(narrow, flat)], pa.binary())})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"chunk": [pdf["chunk"].iloc[0]], "lane": [0], "counts": [narrow(sum(map(widen, pdf["counts"])))]})

    schema = "chunk int, lane int, counts binary"
    sums = docs.select(col(text).cast("string").alias("text")).mapInArrow(count, schema)
    sums = sums.groupBy("chunk", "lane").applyInPandas(add, schema).groupBy("chunk").applyInPandas(add, schema)
    got = {r["chunk"]: widen(bytes(r["counts"])) for r in sums.select("chunk", "counts").toLocalIterator()}
    n = int(got.pop(-1, np.array([1]))[0])
    df = np.concatenate([got[k] for k in sorted(got)]) if got else np.zeros(2 << bits, np.int64)
    rarity = np.log(max(n, 1) / np.maximum(np.minimum(df, n), 1)) / np.log(max(n, 2))
    return np.rint(STEPS * rarity).astype(np.uint8).reshape(2, -1)


class Sampler:
    """Weights and consistent weighted samples; the same everywhere for a seed."""

    def __init__(self, codes: np.ndarray, seed: int = 20_240):
        self.codes = codes
        self.bits = int(codes.shape[1]).bit_length() - 1
        g = np.random.Generator(np.random.PCG64(seed))
        self.r, self.c = g.gamma(2.0, 1.0, TRIPLES), np.log(g.gamma(2.0, 1.0, TRIPLES))
        self.beta = g.random(TRIPLES)
        self.turns = g.integers(1, 1 << 62, BANDS * ROWS, dtype=np.int64).astype(U) * U(2) + U(1)
        every = np.arange(TRIPLES)
        self.once = np.concatenate([self.score(every, np.full(TRIPLES, 1 + q / DAMP)) for q in range(STEPS + 1)])

    def score(self, j: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """ln a of the sampling scheme as an integer of the same order, in the top 32 bits."""
        r = self.r[j]
        t = np.floor(np.log(weight) / r + self.beta[j])
        a = (self.c[j] - r * (t - self.beta[j]) - r).astype(np.float32).view(np.uint32)
        return np.where(a >> 31, ~a, a | np.uint32(1 << 31)).astype(U) << U(32)

    def idf(self, key: np.ndarray) -> np.ndarray:
        a, b = places(key, self.bits)
        return np.maximum(self.codes[0][a], self.codes[1][b])  # less frequent of two: higher idf

    def weights(self, key: np.ndarray, tf: np.ndarray) -> np.ndarray:
        return tf * (1 + self.idf(key) / DAMP)

    def bands(self, row: np.ndarray, key: np.ndarray, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Rows that have shingles, their band keys (rows x BANDS), 16 bits of every
        sample and the total weights."""
        first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1]))) if len(row) else np.zeros(0, np.int64)
        q = self.idf(key).astype(np.int64)
        shift, low, many = q * TRIPLES, key & U(0xFFFFFFFF), np.flatnonzero(tf > 1)
        heavy = tf[many] * (1 + q[many] / DAMP)
        out, short = np.zeros((len(first), BANDS), U), np.zeros((len(first), BANDS * ROWS), np.uint16)
        for s in range(BANDS * ROWS if len(first) else 0):
            j = ((key * self.turns[s]) >> U(48)).astype(np.int64)
            a = self.once[shift + j]
            if len(many):
                a[many] = self.score(j[many], heavy)
            got = np.minimum.reduceat(a | low, first)
            out[:, s // ROWS] = mix(out[:, s // ROWS] + got + U(s + 1))
            short[:, s] = mix(got) >> U(48)
        total = np.add.reduceat(tf * (1 + q / DAMP), first) if len(first) else np.zeros(0)
        return row[first], out, short, total


@lru_cache(maxsize=1)
def _sampler(shared) -> Sampler:
    """A worker's sampler for a broadcast idf table."""
    return Sampler(shared.value)


def signatures(docs: DataFrame, doc_id: str, text: str, codes: np.ndarray) -> DataFrame:
    """(id, h1, h2, bands, samples, weight): the word sequence's hash, the band keys, 16
    bits of every sample, and the total weight; the last three are null without words,
    h1 and h2 for null text."""
    shared = docs.sparkSession.sparkContext.broadcast(codes)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = _sampler(shared)
        for batch in batches:
            for part in portions(batch, "text"):
                texts = part.column(1)
                w = Words(texts)
                h1, h2 = (signed(h).copy() for h in w.row_hashes())
                none = texts.is_null().to_numpy(zero_copy_only=False)
                for i in np.flatnonzero((w.counts == 0) & ~none):
                    raw = hashlib.blake2b(texts[int(i)].as_py().encode(), digest_size=16).digest()
                    h1[i], h2[i] = np.frombuffer(raw, np.int64)
                rows, bands, short, total = sampler.bands(*shingles(w))
                at = np.zeros(part.num_rows + 1, np.int32)
                at[rows + 1] = BANDS
                empty = np.ones(part.num_rows, bool)
                empty[rows] = False
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum(at, dtype=np.int32), mask=np.append(empty, False)), pa.array(signed(bands).ravel()))
                samples, weight = np.full(part.num_rows, None, object), np.zeros(part.num_rows)
                samples[rows], weight[rows] = [x.tobytes() for x in short], total
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(h1, mask=none), pa.array(h2, mask=none), lists, pa.array(samples, pa.binary()), pa.array(weight, mask=empty)], names=["id", "h1", "h2", "bands", "samples", "weight"])

    return docs.select(col(doc_id).cast("long").alias("id"), col(text).cast("string").alias("text")).mapInArrow(sign, "id long, h1 long, h2 long, bands array<long>, samples binary, weight double")


def verified(pairs: DataFrame, texts: DataFrame, codes: np.ndarray) -> DataFrame:
    """(a, b, sim) of all pairs (a, b). A leader's text is shipped once for up to
    SALT_ROWS members, ahead of them in one sorted stream; a task holds one leader."""
    spark = pairs.sparkSession
    shared = spark.sparkContext.broadcast(codes)
    fan = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / SALT_ROWS).alias("fan"))
    salted = pairs.join(fan, "a").withColumn("salt", F.pmod(F.xxhash64("b"), "fan"))
    lead = salted.select("a", "salt").distinct().join(texts, F.col("a") == F.col("id")).select("a", "salt", F.lit(None).cast("long").alias("b"), "text")
    rest = salted.join(texts, F.col("b") == F.col("id")).select("a", "salt", "b", "text")
    rows = lead.unionByName(rest).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = _sampler(shared)
        held, keys, weights, total = None, None, None, 0.0
        for batch in batches:
            for part in portions(batch, "text"):
                row, key, tf = shingles(Words(part.column(3)))
                w = sampler.weights(key, tf)
                cut = np.searchsorted(row, np.arange(part.num_rows + 1))
                out = []
                for i, (a, salt, b) in enumerate(zip(*(part.column(k).to_pylist() for k in range(3)), strict=True)):
                    mine, own = key[cut[i] : cut[i + 1]], w[cut[i] : cut[i + 1]]
                    if b is None:
                        held, keys, weights, total = (a, salt), mine, own, own.sum()
                    elif held == (a, salt):
                        out.append((a, b, jaccard(keys, weights, total, mine, own, float(own.sum()))))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["a", "b", "sim"])

    return rows.mapInArrow(compare, "a long, b long, sim double")


def alike(samples: list[bytes]) -> np.ndarray:
    """Which pairs of rows have EQUAL equal samples or more."""
    x = np.frombuffer(b"".join(samples), np.uint16).reshape(len(samples), -1).T.copy()
    n = np.zeros((x.shape[1], x.shape[1]), np.uint8)
    for sample in x:
        n += sample[:, None] == sample[None, :]
    out = n >= EQUAL
    np.fill_diagonal(out, False)
    return out


def groups_of(table: pa.Table) -> pa.Table:
    """Of one pair of blocks (or one block, against itself), the members that may link, by connected component of
    ``alike``: (group, rep), group being a hash of its members, so that what several
    buckets hold alike is compared once."""
    members = dict(m for block in table["members"].to_pylist() for m in ((x["rep"], x["samples"]) for x in block))
    reps = np.array(sorted(members), np.int64)
    found = alike([members[r] for r in reps.tolist()])
    label = np.arange(len(reps))
    while True:
        new = np.minimum(label, np.where(found, label[None, :], len(reps)).min(1, initial=len(reps)))
        if (new == label).all():
            break
        label = new
    out: list[tuple[int, int]] = []
    for x in np.unique(label[found.any(1)]):
        group = reps[label == x]
        name = int.from_bytes(hashlib.blake2b(group.tobytes(), digest_size=8).digest(), "little", signed=True)
        out += [(name, int(r)) for r in group]
    return pa.table({"group": pa.array([g for g, _ in out], pa.int64()), "rep": pa.array([r for _, r in out], pa.int64())})


def compared(texts: pa.Table, sampler: Sampler, similarity: float) -> pa.Table:
    """Verified links of one group (rep, samples, text) that connect all its links:
    pairs that are connected already are not compared."""
    rows = texts.combine_chunks().sort_by("rep")
    reps, found = rows["rep"].to_numpy(), alike(rows["samples"].to_pylist())
    sets = []
    for batch in rows.select(["text"]).to_batches():
        for part in portions(batch, "text"):
            row, key, tf = shingles(Words(part.column(0)))
            w = sampler.weights(key, tf)
            cut = np.searchsorted(row, np.arange(part.num_rows + 1))
            sets += [(key[x:y], w[x:y], float(w[x:y].sum())) for x, y in zip(cut, cut[1:])]
    label, out = np.arange(len(reps)), []
    for i in range(len(reps)):
        for j in np.flatnonzero(found[i, :i]):
            if label[i] != label[j] and jaccard(*sets[i], *sets[j]) >= similarity:
                out.append((int(reps[j]), int(reps[i])))
                label[label == label[i]] = label[j]
    return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})


def jaccard(a: np.ndarray, wa: np.ndarray, ta: float, b: np.ndarray, wb: np.ndarray, tb: float) -> float:
    """Weighted Jaccard similarity of two sorted sets with weights and their totals."""
    if not len(a) or not len(b):
        return 0.0
    at = np.minimum(np.searchsorted(a, b), len(a) - 1)
    hit = a[at] == b
    common = np.minimum(wa[at[hit]], wb[hit]).sum()
    return float(common / (ta + tb - common))


def only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose id is in ``ids`` (distinct). Counted ids up to
    MAX_BROADCAST_IDS are broadcast, so that no other text moves; more are joined by
    shuffling both sides."""
    return docs.join(F.broadcast(ids) if ids.count() <= MAX_BROADCAST_IDS else ids, "id", "left_semi")


def links(reps: DataFrame, docs: DataFrame, codes: np.ndarray, similarity: float) -> DataFrame:
    """(a, b): verified pairs among class representatives (rep, bands, samples, weight)
    that connect all links."""
    spark = reps.sparkSession
    active = reps.select("rep", "weight", F.posexplode("bands").alias("pos", "key")).select("rep", "weight", F.xxhash64("pos", "key").alias("bucket"))
    sizes = active.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("rep", "weight")).alias("lead")).where("n > 1")
    full = staged(active.join(sizes, "bucket"), "buckets")
    ratio = lambda x, y: F.least(x, y) / F.greatest(x, y)  # noqa: E731  an upper bound of the similarity
    few = full.where(F.col("n") <= SMALL).select("bucket", "rep", "weight")
    two = few.select("bucket", F.col("rep").alias("a"), F.col("weight").alias("wa")).join(few.select("bucket", F.col("rep").alias("b"), F.col("weight").alias("wb")), "bucket")
    two = two.where((F.col("a") < F.col("b")) & (ratio(F.col("wa"), F.col("wb")) >= similarity)).select("a", "b")
    star = full.where((F.col("n") > SMALL) & (F.col("rep") != F.col("lead.rep"))).select("bucket", "rep", "weight", F.col("lead.rep").alias("lead"), ratio(F.col("weight"), F.col("lead.weight")).alias("most"))
    one = star.where(F.col("most") >= similarity).select(F.col("lead").alias("a"), F.col("rep").alias("b"))
    pairs = staged(two.unionByName(one).distinct(), "pairs")
    # every text that is compared below, read once
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).unionByName(star.select(F.col("rep").alias("id")))
    texts = staged(only(docs, staged(wanted.distinct(), "wanted")), "texts", few=True)
    sims = staged(verified(pairs, texts, codes), "sims")

    # the left-over of large buckets: sim is exact or, where not compared, its bound
    judged = star.join(sims, (F.col("lead") == F.col("a")) & (F.col("rep") == F.col("b")), "left").select("bucket", "rep", "weight", F.coalesce("sim", "most").alias("sim"))
    worst = judged.where(F.col("sim") < similarity).groupBy("bucket").agg(F.max("sim").alias("missed"))
    rest = judged.join(worst, "bucket").where((F.col("sim") < similarity) | ((F.col("missed") >= 2 * similarity - 1) & (F.col("sim") <= F.col("missed") + (1 - similarity))))
    # weights within the similarity's ratio meet in the class of either or the next
    size = F.floor(F.log("weight") / F.lit(-np.log(similarity) * (1 + 1e-9))).cast("int")
    rest = staged(rest.select("bucket", "rep", F.explode(F.array(size, size + 1)).alias("size")), "left-over")
    known = sims.where(F.col("sim") >= similarity).select("a", "b")
    if rest.isEmpty():
        return known
    keys = ["bucket", "size"]
    counts = rest.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"), F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = rest.join(counts, keys).withColumn("block", F.pmod(F.xxhash64("rep"), "blocks").cast("int")).join(reps.select("rep", "samples"), "rep")
    # a block is one row of about BLOCK members; blocks are repeated for one another, their members are not
    packed = staged(rows.groupBy(*keys, "blocks", "block").agg(F.collect_list(F.struct("rep", "samples")).alias("members")), "blocks")
    packed = packed.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    packed = packed.select(*keys, F.least("block", "with").alias("p"), F.greatest("block", "with").alias("q"), "members")
    found = staged(packed.groupBy(*keys, "p", "q").applyInArrow(groups_of, "group long, rep long").distinct(), "groups")
    shared = spark.sparkContext.broadcast(codes)
    work = found.join(reps.select("rep", "samples"), "rep").join(texts.dropDuplicates(["id"]), F.col("rep") == F.col("id")).select("group", "rep", "samples", "text")
    more = work.groupBy("group").applyInArrow(lambda t: compared(t, _sampler(shared), similarity), "a long, b long")
    return known.unionByName(staged(more, "more-links"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, sketch_bits: int = SKETCH_BITS) -> DataFrame:
    """One row for each distinct doc_id: doc_id, copy_of (smallest doc_id with the
    same word sequence), component_id (smallest doc_id reachable by links of at
    least ``similarity``), kept (doc_id = component_id). Rows without a doc_id give
    one row each, of nulls and kept = true."""
    need(docs, doc_id, text)
    lean(docs.sparkSession)
    codes = idf_codes(docs, text, sketch_bits)
    sig = staged(signatures(docs.where(col(doc_id).isNotNull()), doc_id, text, codes), "signatures")
    classes = sig.where("h1 is not null").groupBy("h1", "h2").agg(F.min("id").alias("rep"))
    cls = staged(sig.join(classes, ["h1", "h2"], "left").select("id", F.coalesce("rep", "id").alias("rep"), "bands", "samples", "weight"), "classes")
    reps = cls.where("id = rep and bands is not null").select("rep", "bands", "samples", "weight").dropDuplicates(["rep"])
    whole = docs.where(col(doc_id).isNotNull()).select(col(doc_id).cast("long").alias("id"), col(text).cast("string").alias("text"))
    joined = components(links(reps, whole, codes, similarity))
    out = cls.groupBy("id").agg(F.min("rep").alias("rep")).join(joined, F.col("rep") == F.col("node"), "left").select(F.col("id").alias("doc_id"), F.col("rep").alias("copy_of"), F.coalesce("component", "rep").alias("component_id"))
    out = out.withColumn("kept", F.col("doc_id") == F.col("component_id"))
    none = F.lit(None).cast("long")
    return out.unionByName(docs.where(col(doc_id).isNull()).select(none.alias("doc_id"), none.alias("copy_of"), none.alias("component_id"), F.lit(True).alias("kept")))


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that stay: one for each component, with all columns."""
    found = near_duplicates(docs, doc_id, text, similarity)
    stay = found.where("kept and doc_id is not null").select(F.col("doc_id").alias("_near_dup_id"))
    rows = docs.where(col(doc_id).isNotNull()).join(stay, col(doc_id).cast("long") == F.col("_near_dup_id"), "left_semi").dropDuplicates([doc_id])
    return rows.unionByName(docs.where(col(doc_id).isNull()))
