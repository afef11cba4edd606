"""Document assembly (S3, S4): ordered pages or blocks -> one text per document.

``ordered_concat`` joins a document's parts in two levels: first runs of at
most ``block`` consecutive parts (grouped by document *and* block number, so
a document with millions of parts is spread over many tasks), then the
already-joined runs. Level one bounds what is sorted and joined at once; level two
gathers a document's runs into one row, as its result - one string for each
document - requires. A document must therefore fit one row (2 GB).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.sources.files import strip_cells

PAGE_SEP = "\n\n"
BLOCK = 1024


def ordered_concat(df: DataFrame, keys: list[str], order: list[str], part, sep: str, out: str = "text",
                   block: int = BLOCK) -> DataFrame:
    """Join ``part`` (null = skip) per ``keys`` in ``order`` with ``sep``."""
    blk = F.floor(F.col(order[-1]) / block).alias("__blk")
    lead = [F.col(c) for c in order[:-1]]
    item = F.when(part.isNotNull(), F.struct(*[F.col(c) for c in order], part.alias("__t")))
    level1 = df.groupBy(*keys, *lead, blk).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda s_: s_["__t"]), sep).alias("__part"),
        F.count(item).alias("__n"),
    )
    run = F.when(F.col("__n") > 0, F.struct(*[F.col(c) for c in order[:-1]], F.col("__blk"), F.col("__part")))
    return level1.groupBy(*keys).agg(
        F.coalesce(F.array_join(F.transform(F.array_sort(F.collect_list(run)), lambda s_: s_["__part"]), sep),
                   F.lit("")).alias(out),
        F.sum("__n").alias("n_parts"),
    )


# S3
def assemble_pages(pages: DataFrame, doc: str = "doc_id", page_no: str = "page_no", text: str = "text",
                   broken: str = "is_broken") -> DataFrame:
    """Join page texts in page order with a blank line. A broken page is
    skipped; a page without text contributes an empty string."""
    ok = ~F.coalesce(F.col(broken), F.lit(False))
    joined = ordered_concat(pages, [doc], [page_no], F.when(ok, F.coalesce(F.col(text), F.lit(""))), PAGE_SEP)
    return joined.withColumnRenamed("n_parts", "n_pages")


# S4
def blocks_to_text(blocks: DataFrame, doc: str = "doc_id", block_no: str = "block_no") -> DataFrame:
    """All paragraphs (in order, empty ones included), then all table rows
    that keep at least one non-empty cell, joined with a blank line."""
    row_text = strip_cells("cells")
    part = (
        F.when(F.col("kind") == "paragraph", F.coalesce(F.col("text"), F.lit("")))
        .when(F.col("kind") == "table_row", row_text)
    )
    staged = blocks.withColumn("__g", F.when(F.col("kind") == "paragraph", 0).otherwise(1))
    return ordered_concat(staged, [doc], ["__g", block_no], part, PAGE_SEP).drop("n_parts")
