"""Chunk store (replace twice = once, shrinking documents leave no stale
rows, ids unique), sources (validation messages, DOCX reader, page assembly),
streaming restart, governance, and the driver entry points."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from quire.operators import embedding as E
from quire.operators import governance as GV
from quire.operators import structure as ST
from quire.plans import indexing as I
from quire.plans.q_index import FAILS, FailingProvider
from quire.session import shared_dir
from quire.sources import files as FS
from quire.sources import store as S


def _rows(spark, pairs, provider=None):
    df = spark.createDataFrame(pairs, "doc_id long, text string")
    return I.index_documents(df, "fixed", 40, 10, provider=provider, waits=())


LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho"


def _texts(spark, root, name):
    return [r["chunk_text"] for r in S.read_chunks(spark, root, 64).where(F.col("filename") == name).orderBy("chunk_index").collect()]


def test_replace_twice_equals_once_and_shrink(spark):
    root = shared_dir(spark, "test-store")
    big = _rows(spark, [(1, LONG), (2, "one two three four five six seven eight nine ten eleven twelve")])
    S.upsert_chunks(spark, root, big, 64)
    once = sorted(r["id"] for r in S.read_chunks(spark, root, 64).collect())
    S.upsert_chunks(spark, root, big, 64)
    assert sorted(r["id"] for r in S.read_chunks(spark, root, 64).collect()) == once
    S.upsert_chunks(spark, root, _rows(spark, [(1, "alpha beta")]), 64)
    assert _texts(spark, root, "doc1") == ["alpha beta"]
    assert len(_texts(spark, root, "doc2")) > 1
    # plain Parquet: what lies in the folder is the table, old rows are gone
    raw = spark.read.parquet(f"{root}/data")
    assert raw.count() == S.read_chunks(spark, root, 64).count() == raw.select("id").distinct().count()


def test_untouched_partitions_keep_their_files(spark):
    root = shared_dir(spark, "test-partitions")
    S.upsert_chunks(spark, root, _rows(spark, [(i, f"text number {i}") for i in range(60)]), 64, buckets=8)
    files = lambda: {r[0] for r in spark.read.parquet(f"{root}/data").select(F.input_file_name()).distinct().collect()}
    before = files()
    assert S.upsert_chunks(spark, root, _rows(spark, [(1, "new")]), 64) == 1
    after = files()
    assert len(before - after) == len(after - before) == 1


def test_two_writers_of_different_partitions(spark):
    """At the same time, into one table: neither loses or brings back a row of the other."""
    from concurrent.futures import ThreadPoolExecutor

    root = shared_dir(spark, "test-writers")
    docs = spark.createDataFrame([(i, f"{LONG} {i}") for i in range(20)], "doc_id long, text string")
    of = lambda strategy, df: I.index_documents(df, strategy, 40, 10, waits=())
    S.upsert_chunks(spark, root, of("fixed", docs).unionByName(of("paragraph", docs)), 64, buckets=4)
    short = docs.withColumn("text", F.concat(F.lit("short "), F.col("doc_id").cast("string")))
    with ThreadPoolExecutor(2) as pool:
        for f in [pool.submit(S.upsert_chunks, spark, root, of(s, short), 64) for s in ("fixed", "paragraph")]:
            assert f.result() == 4
    rows = S.read_chunks(spark, root, 64).collect()
    assert sorted((r["filename"], r["split_strategy"], r["chunk_text"]) for r in rows) == sorted((f"doc{i}", s, f"short {i}") for i in range(20) for s in ("fixed", "paragraph"))


def test_bucket_count_is_the_tables_own(spark):
    root = shared_dir(spark, "test-buckets")
    S.upsert_chunks(spark, root, _rows(spark, [(i, f"text number {i}") for i in range(200)]), 64, buckets=4)
    with pytest.raises(ValueError, match="4 buckets, not 8"):
        S.upsert_chunks(spark, root, _rows(spark, [(1, "new")]), 64, buckets=8)
    S.upsert_chunks(spark, root, _rows(spark, [(1, "new")]), 64)
    assert S.read_chunks(spark, root, 64).count() == 200 and _texts(spark, root, "doc1") == ["new"]


def test_failed_document_is_quarantined_whole(spark):
    root = shared_dir(spark, "test-quarantine")
    S.upsert_chunks(spark, root, _rows(spark, [(1, LONG), (2, "fine")]), 64)
    before = _texts(spark, root, "doc1")
    changed = LONG + f" {FAILS} and some more words to fill another chunk of it"
    S.upsert_chunks(spark, root, _rows(spark, [(1, changed), (2, "better"), (3, "")], FailingProvider(64)), 64)
    assert _texts(spark, root, "doc1") == before and _texts(spark, root, "doc2") == ["better"]
    refused = S.read_quarantine(spark, root).collect()
    assert [r["filename"] for r in refused] == ["doc1"] and "refused" in refused[0]["reason"]
    S.upsert_chunks(spark, root, _rows(spark, [(4, f"{FAILS} more")], FailingProvider(64)), 64)
    assert {r["filename"] for r in S.read_quarantine(spark, root).collect()} == {"doc1", "doc4"}
    S.upsert_chunks(spark, root, _rows(spark, [(1, "accepted now"), (4, "this too")]), 64)
    assert _texts(spark, root, "doc1") == ["accepted now"] and S.read_quarantine(spark, root).count() == 0


def test_each_chunk_is_embedded_once_an_upsert(spark):
    counted = spark.sparkContext.accumulator(0)

    class Counting(E.HashingProvider):
        def embed(self, texts, task_type):
            counted.add(len(texts))
            return super().embed(texts, task_type)

    root = shared_dir(spark, "test-once")
    S.upsert_chunks(spark, root, _rows(spark, [(i, LONG) for i in range(10)]), 64)
    new = _rows(spark, [(i, LONG + " sigma") for i in range(5)], Counting(64))
    S.upsert_chunks(spark, root, new, 64)
    assert counted.value == sum(len(_texts(spark, root, f"doc{i}")) for i in range(5)) > 5


def test_old_vectors_are_not_staged(spark, monkeypatch):
    """Old rows that stay are read from the table itself; beside it only names are staged."""
    staged, aside = [], S._aside
    monkeypatch.setattr(S, "_aside", lambda spark, df: staged.append(df.columns) or aside(spark, df))
    root = shared_dir(spark, "test-stay")
    S.upsert_chunks(spark, root, _rows(spark, [(i, f"{LONG} {i}") for i in range(30)]), 64, buckets=2)
    before = {i: _texts(spark, root, f"doc{i}") for i in range(30)}
    S.upsert_chunks(spark, root, _rows(spark, [(1, "new"), (2, f"{LONG} {FAILS}")], FailingProvider(64)), 64)
    assert {i: _texts(spark, root, f"doc{i}") for i in range(30)} == before | {1: ["new"]}
    assert staged and all("embedding" not in columns for columns in staged)


def test_document_is_embedded_whole_across_arrow_batches(spark):
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = _rows(spark, [(i, LONG + (f" {FAILS}" if i == 3 else "")) for i in range(6)], FailingProvider(64)).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert {r["doc_id"] for r in rows if r["embed_error"]} == {3} and all(r["embed_error"] for r in rows if r["doc_id"] == 3)
    assert len(rows) == len({r["id"] for r in rows})


def test_ids_that_do_not_fit_stop_the_job(spark):
    ok = spark.createDataFrame([((1 << 39) - 1, "paragraph", (1 << 22) - 1)], "doc_id long, split_strategy string, chunk_index int")
    assert S.assign_ids(ok).first()["id"] > 0
    for row in ((1, "fixed", 1 << 22), (1 << 39, "fixed", 0)):
        with pytest.raises(Exception, match="no id for document"):
            S.assign_ids(spark.createDataFrame([row], ok.schema)).collect()


def test_ids_unique(spark):
    from quire.plans.q_chunking import all_chunks

    ch = S.assign_ids(all_chunks(spark, SF_SMALL), "doc_id")
    assert ch.select("id").distinct().count() == ch.count()


def test_validate_sources_messages(spark):
    df = spark.createDataFrame(
        [("/a/x.txt", True, "t"), ("/a/y", True, "t"), ("/a/z.PDF", False, "t"), ("/a/w.docx", True, "  \x07 ")],
        "path string, exists boolean, text string")
    got = [r["error_message"] for r in FS.validate_sources(df).collect()]
    assert got[0] == "Unsupported file type '.txt'. Supported types: .docx, .pdf."
    assert got[1] == "Unsupported file type '(none)'. Supported types: .docx, .pdf."
    assert got[2] == "File not found: /a/z.PDF"
    assert got[3].startswith("No extractable text found in w.docx.")


def _docx(paragraphs, rows):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    ps = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    trs = "".join("<w:tr>" + "".join(f"<w:tc><w:p><w:r><w:t>{c}</w:t></w:r></w:p></w:tc>" for c in r) + "</w:tr>" for r in rows)
    xml = f'<?xml version="1.0"?><w:document {w}><w:body>{ps}<w:tbl>{trs}</w:tbl></w:body></w:document>'
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("word/document.xml", xml)
    return buf.getvalue()


def test_docx_reader_and_table_rows(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(_docx(["Title", "Body text."], [[" Name ", "", "Value "], ["", " "]]))
    (tmp_path / "b.docx").write_bytes(b"not a zip")
    blocks = FS.read_docx(spark.read.format("binaryFile").load(str(tmp_path)))
    errs = blocks.where("kind = 'error'").collect()
    assert len(errs) == 1 and "Could not parse DOCX b.docx" in errs[0]["error"]
    good = blocks.where("kind <> 'error'").withColumn("doc_id", F.lit(1))
    text = ST.blocks_to_text(good).first()["text"]
    assert text == "Title\n\nBody text.\n\nName | Value"


def test_assemble_pages(spark):
    pages = spark.createDataFrame([(1, 2, "b", False), (1, 1, "a", False), (1, 3, "x", True), (1, 4, None, False)],
                                  "doc_id int, page_no int, text string, is_broken boolean")
    assert ST.assemble_pages(pages).first()["text"] == "a\n\nb\n\n"


def test_secret_scan_reports_location_only(spark):
    df = spark.createDataFrame([(1, 'ok\napi_key = "abcdefgh12345"\nx'), (2, "AIza" + "A" * 35)], "id int, t string")
    got = sorted((r["row_id"], r["line_no"], r["rule"]) for r in GV.scan_secrets(df, "id", "t", "test").collect())
    assert got == [(1, 2, "generic_assignment"), (2, 1, "google_api_key")]
    assert "line" not in GV.scan_secrets(df, "id", "t", "test").columns


def test_streaming_restart_is_idempotent(spark):
    from quire.streaming.incremental import incremental_index

    root = shared_dir(spark, "test-stream")
    ckpt = shared_dir(spark, "test-stream-ckpt")
    incremental_index(spark, f"{SF_SMALL}/documents*.parquet", root, ckpt).awaitTermination()
    n = S.read_chunks(spark, root, 64).count()
    incremental_index(spark, f"{SF_SMALL}/documents*.parquet", root, ckpt).awaitTermination()
    assert S.read_chunks(spark, root, 64).count() == n > 0


def test_changed_file_is_indexed_again(spark, tmp_path, monkeypatch):
    from quire.streaming import incremental as N

    monkeypatch.setattr(N, "FILES_A_GROUP", 1)
    from quire.streaming.incremental import incremental_index, reindex_changed

    def put(name, rows):
        import pandas as pd

        pd.DataFrame([(i, t, "en", "s", len(t)) for i, t in rows], columns=["doc_id", "text", "lang", "source", "n_chars"]).to_parquet(tmp_path / name)

    root, ckpt = shared_dir(spark, "test-changed"), shared_dir(spark, "test-changed-ckpt")
    put("a.parquet", [(1, "first text"), (2, "other text")])
    put("b.parquet", [(3, "third text")])
    incremental_index(spark, str(tmp_path), root, ckpt).awaitTermination()
    assert reindex_changed(spark, str(tmp_path), root) == 0
    put("a.parquet", [(1, "second and rather longer text"), (2, "other text")])
    incremental_index(spark, str(tmp_path), root, ckpt).awaitTermination()  # the stream knows the path
    assert _texts(spark, root, "doc1") == ["first text"]
    assert reindex_changed(spark, str(tmp_path), root) == 1
    assert _texts(spark, root, "doc1") == ["second and rather longer text"] and _texts(spark, root, "doc3") == ["third text"]
    assert reindex_changed(spark, str(tmp_path), root) == 0


def test_entry_contract(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 5 and df.columns[-1] == "similarity"
    assert set(E.oracle_sql()) <= set(E.queries())


def test_env_files_flagged(spark):
    paths = spark.createDataFrame([(1, "app/.env"), (2, ".env.local"), (3, "conf/.env.example"), (4, "env.py")],
                                  "id int, path string")
    got = sorted(r["row_id"] for r in GV.env_file_findings(paths, "id", "path", "files").collect())
    assert got == [1, 2]
