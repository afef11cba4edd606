"""DuckDB SQL builders for the independent oracle of each registered query.

The oracle restates each operator's rule in plain SQL over the same Parquet
views (RE2 regular expressions, recursive CTEs, window functions). It shares
only the fixed values (patterns, thresholds) with the Spark side.
"""

from __future__ import annotations

from quire.functions.text import BODY_MIN_LEN, CONTROL, HEADING_MAX_LEN, NUMBERED_HEADING, WIDTH_FACTOR, WORD, WS
from quire.plans.fixtures import CATEGORY_BY_EVENT, FIXTURE_TIME, HIGH_VALUE, MEDIUM_VALUE, STATUS_BY_MOD3

NL = "chr(10)"


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, {q(rf'\A{WS}+|{WS}+\z')}, '', 'g')"


def soil(x: str) -> str:
    x = f"replace({x}, '. ', '.' || chr(13) || chr(10) || chr(13) || chr(10) || chr(10))"
    x = f"replace({x}, 'tion', 'ti-' || chr(10) || 'on')"
    x = f"replace({x}, ', ', ',' || chr(9) || '  ')"
    return f"(chr(7) || '  ' || {x} || '  ' || chr(10))"


def t1(x):
    return f"coalesce({x}, '')"


def t2(x):
    return f"regexp_replace({x}, {q(chr(13) + chr(10) + '?')}, {NL}, 'g')"


def t3(x):
    return f"regexp_replace({x}, {q(f'({WORD})-' + chr(10) + f'({WORD})')}, '\\1\\2', 'g')"


def t4(x):
    return f"regexp_replace({x}, {q(CONTROL)}, '', 'g')"


def t5(x):
    return f"regexp_replace({x}, {q('[ ' + chr(9) + ']+')}, ' ', 'g')"


def t6(x):
    return f"regexp_replace({x}, {q(' *' + chr(10) + ' *')}, {NL}, 'g')"


def t7(x):
    return f"regexp_replace({x}, {q(chr(10) + '{3,}')}, {NL} || {NL}, 'g')"


def clean(x: str) -> str:
    return strip(t7(t6(t5(t4(t3(t2(t1(x))))))))


def is_heading(line: str) -> str:
    punct = "('.', ',', ';', ':', '!', '?')"
    return (
        f"(regexp_matches({line}, {q(NUMBERED_HEADING)}) OR "
        f"(length({line}) < {HEADING_MAX_LEN} AND right({line}, 1) NOT IN {punct}))"
    )


def reflow_ctes(src: str, key: str = "doc_id", text: str = "t", out: str = "reflowed") -> str:
    """CTEs turning ``src(key, text)`` into ``out(key, t)`` by the line walk rules,
    expressed as gaps-and-islands over exploded lines."""
    return f"""
{out}_lines AS (
  SELECT {key}, pos, {strip('line')} AS line FROM (
    SELECT {key}, unnest(string_split({text}, {NL})) AS line,
           generate_subscripts(string_split({text}, {NL}), 1) AS pos
    FROM {src})
),
{out}_thr AS (
  SELECT {key}, median(length(line)) FILTER (WHERE length(line) > {BODY_MIN_LEN}) * {WIDTH_FACTOR} AS thr,
         min(pos) FILTER (WHERE line <> '') AS first_pos
  FROM {out}_lines GROUP BY {key}
),
{out}_flag AS (
  SELECT l.{key}, l.pos, l.line, t.thr, t.first_pos,
         lag(l.line) OVER (PARTITION BY l.{key} ORDER BY l.pos) AS prev
  FROM {out}_lines l JOIN {out}_thr t USING ({key})
),
{out}_joined AS (
  SELECT {key},
         string_agg(CASE WHEN pos = first_pos THEN ''
                         WHEN prev <> '' AND NOT {is_heading('prev')} AND length(prev) >= thr
                              AND NOT {is_heading('line')} THEN ' '
                         ELSE {NL} || {NL} END || line, '' ORDER BY pos) AS t
  FROM {out}_flag WHERE line <> '' GROUP BY {key}
),
{out} AS (
  SELECT s.{key}, CASE WHEN t.thr IS NULL THEN s.{text} ELSE coalesce(j.t, '') END AS t
  FROM {src} s LEFT JOIN {out}_thr t USING ({key}) LEFT JOIN {out}_joined j USING ({key})
)"""


def chunk_store() -> str:
    return f"""SELECT vec_id AS id, 'vector ' || vec_id || ' label ' || label AS chunk_text, embedding,
       'file' || label AS filename,
       (['fixed', 'sentence', 'paragraph'])[vec_id % 3 + 1] AS split_strategy,
       CAST(floor(vec_id / 30) AS INTEGER) AS chunk_index,
       TIMESTAMP '{FIXTURE_TIME}' AS created_at
FROM embeddings"""


def cosine(a: str, b: str) -> str:
    return (
        f"(list_dot_product({a}::DOUBLE[], {b}::DOUBLE[]) / "
        f"nullif(sqrt(list_dot_product({a}::DOUBLE[], {a}::DOUBLE[])) * sqrt(list_dot_product({b}::DOUBLE[], {b}::DOUBLE[])), 0))"
    )


def tickets() -> str:
    cases = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in CATEGORY_BY_EVENT.items())
    statuses = ", ".join(q(s) for s in STATUS_BY_MOD3)
    return f"""SELECT event_id AS id, 'Customer ' || user_id AS customer_name,
       'user' || user_id || '@example.com' AS email,
       CASE event_type {cases} END AS category,
       CASE WHEN value >= {HIGH_VALUE} THEN 'High' WHEN value >= {MEDIUM_VALUE} THEN 'Medium' ELSE 'Low' END AS priority,
       ([{statuses}])[event_id % 3 + 1] AS status,
       ts AS created_at
FROM events"""


# -- chunking ----------------------------------------------------------------


def fixed_ctes(src: str, keys: list[str], size: int, overlap: int, out: str) -> str:
    """CTEs: ``src(keys, t)`` -> ``out(keys, w, start, chunk_text)``; a recursive
    walk over aligned window starts (the statement must use WITH RECURSIVE)."""
    from quire.functions.text import NON_WS

    k = ", ".join(keys)
    fk = ", ".join(f"f.{c}" for c in keys)
    on = " AND ".join(f"f.{c} = s.{c}" for c in keys)
    step = size - overlap
    align = q(f"^{NON_WS}*{WS}+")
    return f"""
{out}_src AS (SELECT {k}, t, length(t) AS n FROM {src} WHERE length(t) > 0),
{out}_starts AS (
  SELECT {k}, 0 AS w, 0 AS s FROM {out}_src
  UNION ALL
  SELECT {k}, w + 1, s + {step} + length(m) FROM (
    SELECT {fk}, f.w, f.s, s.n, regexp_extract(substr(s.t, f.s + {step} + 1), {align}) AS m
    FROM {out}_starts f JOIN {out}_src s ON {on}
    WHERE f.s + {size} < s.n) x
  WHERE m <> '' AND s + {step} + length(m) < n
),
{out}_win AS (
  SELECT {k}, w, s, t, n, least(s + {size}, n) AS e0,
         greatest(s + 1, least(s + {size}, n) - {size // 5}) AS lo
  FROM {out}_starts JOIN {out}_src USING ({k})
),
{out}_cut AS (
  SELECT {k}, w, s, t,
         CASE WHEN e0 < n AND contains(substr(t, lo + 1, e0 - lo), ' ')
              THEN lo + length(regexp_extract(substr(t, lo + 1, e0 - lo), '(?s)^(.*) ', 1))
              ELSE e0 END AS e
  FROM {out}_win
),
{out} AS (SELECT {k}, w, s AS start, {strip('substr(t, s + 1, e - s)')} AS chunk_text FROM {out}_cut)"""


def paragraphs_list(t: str) -> str:
    brk = q(chr(10) + WS + "*" + chr(10))
    return f"list_filter(list_transform(string_split_regex({t}, {brk}), lambda p: {strip('p')}), lambda p: p <> '')"


def sentences_list(t: str) -> str:
    per = f"list_transform({paragraphs_list(t)}, lambda p: string_split(regexp_replace(p, {q('([.!?])' + WS + '+')}, '\\1' || chr(1), 'g'), chr(1)))"
    return f"list_filter(list_transform(flatten({per}), lambda s: {strip('s')}), lambda s: s <> '')"


def units_ctes(src: str, keys: list[str], strategy: str, out: str) -> str:
    """``src(keys, t)`` -> ``out(keys, i, unit, L)``, i = 1..n per key."""
    k = ", ".join(keys)
    lst = sentences_list("t") if strategy == "sentence" else paragraphs_list("t")
    return f"""
{out}_list AS (SELECT {k}, {lst} AS units FROM {src}),
{out}_raw AS (SELECT {k}, unnest(units) AS unit, generate_subscripts(units, 1) AS i FROM {out}_list),
{out} AS (SELECT {k}, i, unit, length(unit) AS L FROM {out}_raw)"""


def pack_ctes(units: str, keys: list[str], size: int, overlap: int, out: str) -> str:
    """Greedy packing of ``units(keys, i, unit, L)`` -> ``out(keys, chunk_index, chunk_text)``."""
    k = ", ".join(keys)
    pk = ", ".join(f"p.{c}" for c in keys)
    on = " AND ".join(f"u.{c} = p.{c}" for c in keys)
    return f"""
{out}_pk AS (
  SELECT {k}, i, 1 AS grp, CASE WHEN L > {size} THEN 0 ELSE L END AS used, L > {size} AS big
  FROM {units} WHERE i = 1
  UNION ALL
  SELECT {pk}, p.i + 1,
         CASE WHEN u.L > {size} OR p.big OR p.used + 1 + u.L > {size} THEN p.grp + 1 ELSE p.grp END,
         CASE WHEN u.L > {size} THEN 0 WHEN p.big OR p.used + 1 + u.L > {size} THEN u.L
              ELSE p.used + 1 + u.L END,
         u.L > {size}
  FROM {out}_pk p JOIN {units} u ON {on} AND u.i = p.i + 1
),
{out}_grp AS (SELECT u.{k.replace(', ', ', u.')}, u.i, u.unit, p.grp, p.big
              FROM {units} u JOIN {out}_pk p ON {on} AND u.i = p.i),
{out}_small AS (SELECT {k}, grp, 0 AS w, string_agg(unit, ' ' ORDER BY i) AS chunk_text
                FROM {out}_grp WHERE NOT big GROUP BY {k}, grp),
{out}_bigsrc AS (SELECT {k}, grp, unit AS t FROM {out}_grp WHERE big),{fixed_ctes(f'{out}_bigsrc', keys + ['grp'], size, overlap, f'{out}_bigfx')},
{out} AS (
  SELECT {k}, CAST(row_number() OVER (PARTITION BY {k} ORDER BY grp, w) - 1 AS INTEGER) AS chunk_index, chunk_text
  FROM (SELECT {k}, grp, w, chunk_text FROM {out}_small
        UNION ALL SELECT {k}, grp, w, chunk_text FROM {out}_bigfx WHERE chunk_text <> ''))"""


def chunk_ctes(src: str, keys: list[str], strategy: str, size: int, overlap: int, out: str) -> str:
    """``src(keys, t)`` -> ``out(keys, chunk_index, chunk_text)`` for one strategy."""
    k = ", ".join(keys)
    if strategy == "fixed":
        return f"""{fixed_ctes(src, keys, size, overlap, out + '_fx')},
{out} AS (SELECT {k}, CAST(row_number() OVER (PARTITION BY {k} ORDER BY w) - 1 AS INTEGER) AS chunk_index, chunk_text
          FROM {out}_fx WHERE chunk_text <> '')"""
    return f"""{units_ctes(src, keys, strategy, out + '_u')},{pack_ctes(out + '_u', keys, size, overlap, out)}"""
