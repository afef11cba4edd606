"""SQL surface (U1, U2): a chunking table function and SQL-bodied functions.

``register_sql_functions`` creates temporary SQL functions whose bodies are
native expressions (no Python), so ``SELECT clean_text(text) FROM documents``
plans exactly like the DataFrame form. ``register_chunk_udtf`` registers an
Arrow-batched Python UDTF for ``LATERAL chunk_text(text, strategy, size, overlap)``.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from quire.functions.text import CONTROL_CHARS, HEADING_MAX_LEN, HEADING_PUNCT, NUMBERED_HEADING, WORD, WS, WS_CHARS


def _raw(pattern: str) -> str:
    """Spark SQL raw string literal (no escape processing)."""
    assert "'" not in pattern
    return "r'" + pattern + "'"


def _chars(text: str) -> str:
    """Spark SQL string literal of any characters, as escapes."""
    return "'" + "".join(f"\\u{ord(c):04x}" for c in text) + "'"


def _stripped(x: str) -> str:
    return f"btrim({x}, {_chars(WS_CHARS)})"


def clean_text_sql(x: str = "t") -> str:
    nl = "char(10)"
    s = f"coalesce({x}, '')"
    s = f"replace(replace({s}, {_chars(chr(13) + chr(10))}, {nl}), {_chars(chr(13))}, {nl})"
    s = f"regexp_replace({s}, {_raw('(' + WORD + ')-' + chr(10) + '(' + WORD + ')')}, '$1$2')"
    s = f"translate({s}, {_chars(CONTROL_CHARS)}, '')"
    s = f"regexp_replace({s}, {_raw('[ ' + chr(9) + ']+')}, ' ')"
    s = f"regexp_replace({s}, {_raw(' *' + chr(10) + ' *')}, {nl})"
    s = f"regexp_replace({s}, {_raw(chr(10) + '{3,}')}, concat({nl}, {nl}))"
    return _stripped(s)


_EMPTY = "''"
PARAGRAPH_BREAK = chr(10) + WS + "*" + chr(10)
SENTENCE_BREAK = "(?<=[.!?])" + WS + "+"


def _paragraphs(x: str) -> str:
    return f"filter(transform(split({x}, {_raw(PARAGRAPH_BREAK)}), p -> {_stripped('p')}), p -> p <> '')"


FUNCTIONS = {
    "clean_text": ("t STRING", "STRING", clean_text_sql("t")),
    "strip_text": ("t STRING", "STRING", _stripped("t")),
    "cosine_similarity": (
        "a ARRAY<FLOAT>, b ARRAY<FLOAT>",
        "DOUBLE",
        "aggregate(zip_with(a, b, (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE)), 0D, (s, v) -> s + v) / "
        "nullif(sqrt(aggregate(a, 0D, (s, v) -> s + CAST(v AS DOUBLE) * CAST(v AS DOUBLE))) * "
        "sqrt(aggregate(b, 0D, (s, v) -> s + CAST(v AS DOUBLE) * CAST(v AS DOUBLE))), 0D)",
    ),
    "redact_error": (
        "message STRING, class_name STRING",
        "STRING",
        "CASE WHEN instr(coalesce(message, ''), '://') > 0 THEN concat(class_name, ' (details withheld: may contain credentials)') "
        f"WHEN {_stripped('coalesce(message, ' + _EMPTY + ')')} = '' THEN class_name "
        f"ELSE left({_stripped('message')}, 300) END",
    ),
    "is_heading": (
        "line STRING",
        "BOOLEAN",
        f"rlike(line, {_raw(NUMBERED_HEADING)}) OR (length(line) < {HEADING_MAX_LEN} AND "
        f"right(line, 1) NOT IN ({', '.join(repr(c) for c in HEADING_PUNCT)}))",
    ),
    "split_paragraphs": ("t STRING", "ARRAY<STRING>", _paragraphs("t")),
    "split_sentences": (
        "t STRING",
        "ARRAY<STRING>",
        f"filter(transform(flatten(transform({_paragraphs('t')}, p -> split(p, {_raw(SENTENCE_BREAK)}))), s -> {_stripped('s')}), s -> s <> '')",
    ),
}


def register_sql_functions(spark: SparkSession) -> list[str]:
    for name, (args, ret, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {ret} RETURN {body}")
    return list(FUNCTIONS)


def register_chunk_udtf(spark: SparkSession, name: str = "chunk_text") -> None:
    from pyspark.sql.functions import udtf

    from quire.operators import chunking as C

    @udtf(returnType="chunk_index: int, chunk_text: string", useArrow=True)
    class ChunkText:
        def eval(self, text: str, strategy: str, size: int, overlap: int):
            msg = C.chunk_param_error(strategy, size, overlap)
            if msg:
                raise ValueError(msg)
            for i, piece in enumerate(C.chunk_python(text or "", strategy, size, overlap)):
                yield i, piece

    spark.udtf.register(name, ChunkText)


def register_chunk_table(spark: SparkSession, name: str = "chunk_table") -> None:
    """A polymorphic table function: ``SELECT * FROM chunk_table(TABLE(docs) PARTITION BY (k), 'text', 1000, 200)``
    chunks the named text column of any table under all strategies (or a comma-separated list as the last
    argument) and keeps the caller's other columns, whatever they are. Names that clash are refused when the
    statement is analysed, as are bad parameters."""
    from pyspark.sql import types as T
    from pyspark.sql.functions import udtf
    from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

    from quire.operators import chunking as C

    @udtf
    class ChunkTable:
        @staticmethod
        def analyze(rows: AnalyzeArgument, text_column: AnalyzeArgument, size: AnalyzeArgument, overlap: AnalyzeArgument, strategies: AnalyzeArgument | None = None) -> AnalyzeResult:
            if not rows.isTable:
                raise ValueError("the first argument must be a table")
            given = [text_column, size, overlap, *([strategies] if strategies else [])]
            if not all(a.isConstantExpression and a.value is not None for a in given):
                raise ValueError("the text column, sizes and strategies must be constants")
            if text_column.value not in rows.dataType.names:
                raise ValueError(f"no column {text_column.value!r} in the table")
            for s in strategies.value.split(",") if strategies else C.STRATEGIES:
                C.validate_chunk_params(s.strip(), size.value, overlap.value)
            kept = [f for f in rows.dataType.fields if f.name != text_column.value]
            made = [T.StructField("split_strategy", T.StringType()), T.StructField("chunk_index", T.IntegerType()), T.StructField("chunk_text", T.StringType())]
            clash = {f.name for f in kept} & {f.name for f in made}
            if clash:
                raise ValueError(f"the table already has {sorted(clash)}")
            return AnalyzeResult(T.StructType([*kept, *made]))

        def eval(self, row, text_column, size, overlap, strategies=None):
            kept = tuple(row[c] for c in row.__fields__ if c != text_column)
            for s in strategies.split(",") if strategies else C.STRATEGIES:
                for i, piece in enumerate(C.chunk_python(row[text_column] or "", s.strip(), size, overlap)):
                    yield (*kept, s.strip(), i, piece)

    spark.udtf.register(name, ChunkTable)
