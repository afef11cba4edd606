"""Registered chunking queries (C1-C14) over prepared documents.

Prepared text = reflow(clean(documents.text)): the PDF path of the indexing
flow, so the paragraph strategy sees rebuilt paragraphs.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import text as X
from quire.operators import chunking as C
from quire.plans import oracle as O
from quire.plans.registry import register
from quire.sources.tables import read_table

SIZE, OVERLAP = C.DEFAULT_CHUNK_SIZE, C.DEFAULT_OVERLAP
SMALL_SIZE, SMALL_OVERLAP = 300, 60

_PREP = f"""WITH RECURSIVE c AS (SELECT doc_id, {O.clean('text')} AS t FROM documents),{O.reflow_ctes('c')},
prep AS (SELECT doc_id, {O.strip('t')} AS t FROM reflowed)"""
_CLEAN_ONLY = f"""WITH RECURSIVE prep AS (SELECT doc_id, {O.clean('text')} AS t FROM documents)"""


def prepared(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", X.clean_text(F.col("text")).alias("text"))
    return X.reflow_paragraphs(docs, "text")


def clean_only(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").select("doc_id", X.clean_text(F.col("text")).alias("text"))


def _chunk_sql(strategy, size=SIZE, overlap=OVERLAP, prep=_PREP):
    return f"""{prep},{O.chunk_ctes('prep', ['doc_id'], strategy, size, overlap, 'ch')}
SELECT doc_id, chunk_index, chunk_text FROM ch"""


def _chunk_query(strategy, size=SIZE, overlap=OVERLAP):
    def build(spark, sf_dir):
        return C.chunk_text(prepared(spark, sf_dir), "text", strategy, size, overlap, keep=["doc_id"]).select(
            "doc_id", "chunk_index", "chunk_text"
        )

    return build


register("chunk_fixed", _chunk_sql("fixed"))(_chunk_query("fixed"))
register("chunk_sentence", _chunk_sql("sentence"))(_chunk_query("sentence"))
register("chunk_paragraph", _chunk_sql("paragraph"))(_chunk_query("paragraph"))
register("pack_units", _chunk_sql("sentence", SMALL_SIZE, SMALL_OVERLAP))(
    _chunk_query("sentence", SMALL_SIZE, SMALL_OVERLAP)
)


@register(
    "split_paragraphs",
    f"""{_PREP}, u AS (SELECT doc_id, {O.paragraphs_list('t')} AS units FROM prep)
SELECT doc_id, CAST(generate_subscripts(units, 1) - 1 AS INTEGER) AS unit_index, unnest(units) AS unit FROM u""",
)
def split_paragraphs(spark, sf_dir):
    return prepared(spark, sf_dir).select(
        "doc_id", F.posexplode(C.split_paragraphs(X.strip_text(F.col("text")))).alias("unit_index", "unit")
    ).withColumn("unit_index", F.col("unit_index").cast("int"))


@register(
    "split_sentences",
    f"""{_PREP}, u AS (SELECT doc_id, {O.sentences_list('t')} AS units FROM prep)
SELECT doc_id, CAST(generate_subscripts(units, 1) - 1 AS INTEGER) AS unit_index, unnest(units) AS unit FROM u""",
)
def split_sentences(spark, sf_dir):
    return prepared(spark, sf_dir).select(
        "doc_id", F.posexplode(C.split_sentences(X.strip_text(F.col("text")))).alias("unit_index", "unit")
    ).withColumn("unit_index", F.col("unit_index").cast("int"))


def _strategy_of(doc_id_col):
    return F.element_at(F.array(*[F.lit(s) for s in C.STRATEGIES]), (doc_id_col % 3 + 1).cast("int"))


@register(
    "chunk_text",
    f"""{_PREP},
pf AS (SELECT doc_id, t FROM prep WHERE doc_id % 3 = 0),
ps AS (SELECT doc_id, t FROM prep WHERE doc_id % 3 = 1),
pp AS (SELECT doc_id, t FROM prep WHERE doc_id % 3 = 2),
{O.chunk_ctes('pf', ['doc_id'], 'fixed', SIZE, OVERLAP, 'cf')},
{O.chunk_ctes('ps', ['doc_id'], 'sentence', SIZE, OVERLAP, 'cs')},
{O.chunk_ctes('pp', ['doc_id'], 'paragraph', SIZE, OVERLAP, 'cp')}
SELECT doc_id, 'fixed' AS split_strategy, chunk_index, chunk_text FROM cf
UNION ALL SELECT doc_id, 'sentence', chunk_index, chunk_text FROM cs
UNION ALL SELECT doc_id, 'paragraph', chunk_index, chunk_text FROM cp""",
)
def chunk_text(spark, sf_dir):
    """Strategy given per document as a column (dispatch inside one plan)."""
    docs = prepared(spark, sf_dir)
    return C.chunk_text(docs, "text", _strategy_of(F.col("doc_id")), SIZE, OVERLAP, keep=["doc_id"])


_ALL_SQL = f"""{_PREP},
{O.chunk_ctes('prep', ['doc_id'], 'fixed', SIZE, OVERLAP, 'cf')},
{O.chunk_ctes('prep', ['doc_id'], 'sentence', SIZE, OVERLAP, 'cs')},
{O.chunk_ctes('prep', ['doc_id'], 'paragraph', SIZE, OVERLAP, 'cp')},
allc AS (SELECT doc_id, 'fixed' AS split_strategy, chunk_index, chunk_text FROM cf
  UNION ALL SELECT doc_id, 'sentence', chunk_index, chunk_text FROM cs
  UNION ALL SELECT doc_id, 'paragraph', chunk_index, chunk_text FROM cp)"""


def all_chunks(spark, sf_dir, places=False):
    return C.chunk_all_strategies(prepared(spark, sf_dir), "text", SIZE, OVERLAP, keep=["doc_id"], places=places).withColumn(
        "filename", F.concat(F.lit("doc"), F.col("doc_id").cast("string"))
    )


@register("chunk_all_strategies", f"{_ALL_SQL}\nSELECT doc_id, split_strategy, chunk_index, chunk_text FROM allc")
def chunk_all_strategies(spark, sf_dir):
    return all_chunks(spark, sf_dir).select("doc_id", "split_strategy", "chunk_index", "chunk_text")


@register(
    "explode_chunks",
    f"""{_PREP},{O.chunk_ctes('prep', ['doc_id'], 'paragraph', SIZE, OVERLAP, 'cp')}
SELECT 'doc' || doc_id AS filename, 'paragraph' AS split_strategy, chunk_index, chunk_text FROM cp""",
)
def explode_chunks(spark, sf_dir):
    ch = C.chunk_text(prepared(spark, sf_dir), "text", "paragraph", SIZE, OVERLAP, keep=["doc_id"])
    return ch.select(
        F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("filename"), "split_strategy", "chunk_index",
        "chunk_text",
    )


@register(
    "validate_chunk_params",
    """SELECT doc_id,
  (['fixed', 'sentence', 'paragraph', 'semantic'])[doc_id % 4 + 1] AS strategy,
  CAST((doc_id % 7) * 100 - 100 AS BIGINT) AS chunk_size, CAST((doc_id % 5) * 60 - 60 AS BIGINT) AS overlap,
  CASE WHEN doc_id % 4 = 3 THEN 'Unknown strategy ''semantic''. Choose one of: fixed, sentence, paragraph.'
       WHEN (doc_id % 7) * 100 - 100 <= 0 THEN 'chunk_size must be greater than 0.'
       WHEN (doc_id % 5) * 60 - 60 < 0 THEN 'overlap must be 0 or greater.'
       WHEN (doc_id % 5) * 60 - 60 >= (doc_id % 7) * 100 - 100 THEN 'overlap must be smaller than chunk_size.'
  END AS error
FROM documents""",
)
def validate_chunk_params(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    params = docs.select(
        "doc_id",
        F.element_at(F.array(*[F.lit(s) for s in (*C.STRATEGIES, "semantic")]), (F.col("doc_id") % 4 + 1).cast("int")).alias(
            "strategy"
        ),
        ((F.col("doc_id") % 7) * 100 - 100).alias("chunk_size"),
        ((F.col("doc_id") % 5) * 60 - 60).alias("overlap"),
    )
    return params.withColumn("error", C.chunk_param_errors("strategy", "chunk_size", "overlap"))


@register(
    "chunk_stats",
    f"""{_ALL_SQL}
SELECT 'doc' || doc_id AS filename, split_strategy, count(*) AS n_chunks,
       CAST(sum(length(chunk_text)) // count(*) AS BIGINT) AS avg_chars
FROM allc GROUP BY doc_id, split_strategy""",
)
def chunk_stats(spark, sf_dir):
    return C.chunk_stats(all_chunks(spark, sf_dir))


def _nonspace(x: str) -> str:
    return f"length(regexp_replace({x}, {O.q(X.WS)}, '', 'g'))"


def _gap_ctes(overlap: int, texts: str = "") -> str:
    """Units of each strategy (``fixed`` has one, the text), their windows, and the gaps between these; a unit's
    place in the text follows from how many non-blank characters stand before it, as units leave out blanks alone."""
    return f"""{O.units_ctes('prep', ['doc_id'], 'sentence', 'us')},{O.units_ctes('prep', ['doc_id'], 'paragraph', 'up')},
units AS (SELECT doc_id, 'fixed' AS split_strategy, 1 AS i, t AS unit FROM prep
          UNION ALL SELECT doc_id, 'sentence', i, unit FROM us UNION ALL SELECT doc_id, 'paragraph', i, unit FROM up),
placed AS (SELECT *, coalesce(sum({_nonspace('unit')}) OVER (PARTITION BY doc_id, split_strategy ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM units),
big AS (SELECT doc_id, split_strategy, i, unit AS t FROM placed WHERE length(unit) > {SIZE}),{O.fixed_ctes('big', ['doc_id', 'split_strategy', 'i'], SIZE, overlap, 'fx')},
span AS (SELECT doc_id, split_strategy, i, start, start + length(chunk_text) AS e FROM fx WHERE chunk_text <> ''
         UNION ALL SELECT doc_id, split_strategy, i, length(t), length(t) FROM big),
swept AS (SELECT *, coalesce(max(e) OVER (PARTITION BY doc_id, split_strategy, i ORDER BY start, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reach FROM span),
raw AS (SELECT s.doc_id, s.split_strategy, s.i, reach, substr(t, reach + 1, start - reach) AS part
        FROM swept s JOIN big USING (doc_id, split_strategy, i) WHERE start > reach),
gap AS (SELECT doc_id, split_strategy, i, reach + length(regexp_extract(part, {O.q('^' + X.WS + '*')})) AS lo, length({O.strip('part')}) AS n
        FROM raw WHERE {O.strip('part')} <> ''),
chars AS (SELECT doc_id, unnest(string_split(t, '')) AS ch, generate_subscripts(string_split(t, ''), 1) AS pos
          FROM prep{texts}),
nth AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM chars WHERE NOT regexp_matches(ch, {O.q('^' + X.WS + '$')}))"""


_GAP_ROWS = """SELECT g.doc_id, g.split_strategy, CAST(nth.pos - 1 + g.lo AS INTEGER) AS start, CAST(nth.pos - 1 + g.lo + g.n AS INTEGER) AS "end"
FROM gap g JOIN placed p USING (doc_id, split_strategy, i) JOIN nth ON nth.doc_id = g.doc_id AND nth.k = p.before + 1"""
_GAPS_SQL = f"""{_PREP},{_gap_ctes(0, " WHERE doc_id IN (SELECT doc_id FROM gap)")}
{_GAP_ROWS}"""

# A chunk's place in the text: its first unit's (a window's start beyond it); mid-word if no blank stands there or before.
_AUDIT_SQL = f"""{_ALL_SQL},{_gap_ctes(OVERLAP)},
firsts AS (SELECT doc_id, 'fixed' AS split_strategy, 1 AS i, start FROM cf_fx WHERE chunk_text <> ''
           UNION ALL SELECT doc_id, 'sentence', min(i), 0 FROM cs_grp WHERE NOT big GROUP BY doc_id, grp
           UNION ALL SELECT doc_id, 'paragraph', min(i), 0 FROM cp_grp WHERE NOT big GROUP BY doc_id, grp
           UNION ALL SELECT doc_id, 'sentence', i, start FROM cs_bigfx JOIN cs_grp USING (doc_id, grp) WHERE chunk_text <> ''
           UNION ALL SELECT doc_id, 'paragraph', i, start FROM cp_bigfx JOIN cp_grp USING (doc_id, grp) WHERE chunk_text <> ''),
begun AS (SELECT f.doc_id, f.split_strategy, prep.t, nth.pos - 1 + f.start AS place
          FROM firsts f JOIN placed p USING (doc_id, split_strategy, i) JOIN nth ON nth.doc_id = f.doc_id AND nth.k = p.before + 1 JOIN prep ON prep.doc_id = f.doc_id),
cut AS (SELECT doc_id, split_strategy, count(*) FILTER (WHERE place > 0 AND NOT regexp_matches(substr(t, place, 1), {O.q('^' + X.WS + '$')})
                                                        AND NOT regexp_matches(substr(t, place + 1, 1), {O.q('^' + X.WS + '$')})) AS n_midword_starts
        FROM begun GROUP BY doc_id, split_strategy),
lost AS (SELECT doc_id, split_strategy, string_agg(start || '-' || "end", ',' ORDER BY start, "end") AS uncovered FROM ({_GAP_ROWS}) GROUP BY doc_id, split_strategy),
audit AS (SELECT doc_id, split_strategy, count(*) AS n_chunks, max(length(chunk_text)) AS max_chars,
                 count(*) FILTER (WHERE length(chunk_text) > {SIZE}) AS n_oversized,
                 count(*) FILTER (WHERE length(chunk_text) = 0) AS n_empty,
                 count(*) FILTER (WHERE {O.strip('chunk_text')} <> chunk_text) AS n_unstripped,
                 (min(chunk_index) = 0 AND max(chunk_index) = count(*) - 1 AND count(DISTINCT chunk_index) = count(*)) AS contiguous
          FROM allc GROUP BY doc_id, split_strategy)
SELECT 'doc' || doc_id AS filename, split_strategy, n_chunks, max_chars, n_oversized, n_empty, n_unstripped, n_midword_starts, contiguous,
       coalesce(uncovered, '') AS uncovered
FROM audit JOIN cut USING (doc_id, split_strategy) LEFT JOIN lost USING (doc_id, split_strategy)"""


@register("audit_chunks", _AUDIT_SQL)
def audit_chunks(spark, sf_dir):
    """The invariants of every chunk, its start in the source among them, and what no chunk holds."""
    return C.audit_chunks(all_chunks(spark, sf_dir, places=True), SIZE)


_COVER_SQL = f"""{_PREP},{O.fixed_ctes('prep', ['doc_id'], SIZE, 0, 'fx')},
w AS (SELECT f.doc_id, f.w, f.start, f.start + length(f.chunk_text) AS e, p.t, length(p.t) AS n
      FROM fx f JOIN prep p USING (doc_id) WHERE f.chunk_text <> ''),
r AS (SELECT *, coalesce(max(e) OVER (PARTITION BY doc_id ORDER BY w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prev_e FROM w),
seg AS (SELECT doc_id, count(*) AS n_windows,
               count(*) FILTER (WHERE start > 0 AND NOT regexp_matches(substr(t, start + 1, 1), {O.q('^' + X.WS + '$')})
                                 AND NOT regexp_matches(substr(t, start, 1), {O.q('^' + X.WS + '$')})) AS n_midword_starts,
               count(*) FILTER (WHERE e > 0 AND e < n AND NOT regexp_matches(substr(t, e + 1, 1), {O.q('^' + X.WS + '$')})
                                 AND NOT regexp_matches(substr(t, e, 1), {O.q('^' + X.WS + '$')})) AS n_midword_ends,
               sum(CASE WHEN e > greatest(start, prev_e) THEN {_nonspace('substr(t, greatest(start, prev_e) + 1, e - greatest(start, prev_e))')} ELSE 0 END) AS covered
        FROM r GROUP BY doc_id)
SELECT p.doc_id, CAST(coalesce(s.n_windows, 0) AS INTEGER) AS n_windows,
       CAST(coalesce(s.n_midword_starts, 0) AS INTEGER) AS n_midword_starts,
       CAST(coalesce(s.n_midword_ends, 0) AS INTEGER) AS n_midword_ends,
       CAST({_nonspace('p.t')} - coalesce(s.covered, 0) AS INTEGER) AS lost_chars
FROM prep p LEFT JOIN seg s USING (doc_id)"""


@register("audit_fixed_coverage", _COVER_SQL)
def audit_fixed_coverage(spark, sf_dir):
    """Window loss per document at overlap 0: windows, windows ending
    mid-word, non-space characters in no window."""
    return C.audit_fixed_coverage(prepared(spark, sf_dir), "text", SIZE, 0)


def _ll(k: str, n: str, p: str) -> str:
    """The SQL of a binomial log-likelihood."""
    return f"(CASE WHEN {k} > 0 THEN {k} * ln({p}) ELSE 0 END + CASE WHEN {n} - {k} > 0 THEN ({n} - {k}) * ln(1 - {p}) ELSE 0 END)"


@register(
    "abbreviation_scores",
    f"""WITH tok AS (SELECT unnest(regexp_extract_all(text, {O.q(C.WORD_PERIOD)})) AS t FROM documents),
w AS (SELECT CASE WHEN suffix(t, '.') THEN left(t, -1) ELSE t END AS word, suffix(t, '.') AS ends FROM tok),
c AS (SELECT word, count(*) FILTER (WHERE ends) AS n_with, count(*) AS n_words FROM w GROUP BY word),
a AS (SELECT sum(n_with)::DOUBLE AS ak, sum(n_words)::DOUBLE AS an FROM c),
x AS (SELECT word, n_with, n_words, n_with::DOUBLE AS k, n_words::DOUBLE AS n, ak - n_with AS rk, an - n_words AS rn, ak / an AS p,
             n_with / n_words AS p1, CASE WHEN an > n_words THEN (ak - n_with) / (an - n_words) ELSE 0 END AS p2
      FROM c, a WHERE n_with >= {C.MIN_WITH}),
s AS (SELECT *, 2 * ({_ll('k', 'n', 'p1')} + {_ll('rk', 'rn', 'p2')} - {_ll('k', 'n', 'p')} - {_ll('rk', 'rn', 'p')}) AS r FROM x)
SELECT word, n_with, n_words, round(CASE WHEN p1 > p2 THEN r ELSE -r END, 4) AS score FROM s""",
)
def abbreviation_scores(spark, sf_dir):
    """Which words of all texts end with a period more often than words do."""
    out = C.abbreviation_scores(read_table(spark, sf_dir, "documents"), "text")
    return out.withColumn("score", F.round("score", 4))


@register("uncovered_ranges", _GAPS_SQL)
def uncovered_ranges(spark, sf_dir):
    """What no chunk holds at overlap 0, for each document and strategy."""
    return C.uncovered_ranges(prepared(spark, sf_dir), "text", SIZE, 0)


@register(
    "strategy_collisions",
    f"""{_CLEAN_ONLY},
{O.chunk_ctes('prep', ['doc_id'], 'fixed', SIZE, OVERLAP, 'cf')},
{O.chunk_ctes('prep', ['doc_id'], 'paragraph', SIZE, OVERLAP, 'cp')}
SELECT doc_id, count(*) AS n_positions, bool_and(a IS NOT DISTINCT FROM b) AS identical
FROM (SELECT coalesce(f.doc_id, p.doc_id) AS doc_id, f.chunk_text AS a, p.chunk_text AS b
      FROM cf f FULL OUTER JOIN cp p ON f.doc_id = p.doc_id AND f.chunk_index = p.chunk_index)
GROUP BY doc_id""",
)
def strategy_collisions(spark, sf_dir):
    """Without reflow, documents with no blank line chunk identically under
    `paragraph` and `fixed` - the defect reflow exists to prevent."""
    both = C.chunk_text(clean_only(spark, sf_dir), "text", ("fixed", "paragraph"), SIZE, OVERLAP, keep=["doc_id"])
    return C.strategy_collisions(both)


@register(
    "neighbor_chunks",
    f"""{_PREP},{O.chunk_ctes('prep', ['doc_id'], 'paragraph', SIZE, OVERLAP, 'cp')}
SELECT 'doc' || doc_id AS filename, 'paragraph' AS split_strategy, chunk_index, chunk_text,
       lag(chunk_text) OVER w AS prev_text, lead(chunk_text) OVER w AS next_text
FROM cp WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_index)""",
)
def neighbor_chunks(spark, sf_dir):
    ch = explode_chunks(spark, sf_dir)
    return C.neighbor_chunks(ch)


@register(
    "document_order",
    f"""{_PREP},{O.chunk_ctes('prep', ['doc_id'], 'paragraph', SIZE, OVERLAP, 'cp')}
SELECT 'doc' || doc_id AS filename, 'paragraph' AS split_strategy,
       string_agg(chunk_text, chr(10) ORDER BY chunk_index) AS text, count(*) AS n_chunks
FROM cp GROUP BY doc_id""",
)
def document_order(spark, sf_dir):
    return C.document_order(explode_chunks(spark, sf_dir))
