"""Language identification against a plain loop over the same dictionaries, and held-out accuracy."""

import zlib

import pytest
import zstandard

from quire.llm import language as L
from quire.llm.queries import QUERIES, table

WORDS = {"en": "the house is near to the river and they were walking slowly", "de": "das haus steht nahe am fluss und wir gehen langsam dorthin", "fr": "la maison est près de la rivière et nous marchons lentement", "el": "το σπίτι είναι κοντά στο ποτάμι και περπατάμε αργά"}


def rows(n=60):
    out = []
    for k, (lang, words) in enumerate(WORDS.items()):
        w = words.split()
        out += [(1000 * k + i, " ".join(w[(i + j * (1 + i % 3)) % len(w)] for j in range(12)) + f". {i}", lang) for i in range(n)]
    return out


def frame(spark, data):
    return spark.createDataFrame([(*r, 1, "y", 0.5) for r in data], "doc_id long, text string, lang string, margin int, `a.b c` string, score double")


def test_learns_from_rows_that_are_not_held_out(spark):
    data = [(i, t, lang if zlib.crc32(str(i).encode()) % 5 else "en") for i, t, lang in rows()]  # held-out labels are wrong
    out = {r["doc_id"]: r for r in L.language_report(frame(spark, data)).collect()}
    truth = {i: lang for i, _, lang in rows()}
    assert all(out[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in out)
    assert sum(out[i]["lang_pred"] == truth[i] for i in out) / len(out) > 0.98
    assert all(0 <= r["score"] <= 1 and r["margin"] >= 0 for r in out.values())


def test_defined_results(spark):
    extra = [(9001, None, None), (9002, "", None), (9003, "12 34 !!", None), (9004, "x", None), (None, "the river", None), (9005, "the river", None), (9005, "the river", None), (9006, "das haus steht nahe am fluss " * 60_000, None), (9007, None, "de"), (9008, "́́", None)]
    got = [(r["doc_id"], r["lang_pred"], r["score"], r["rejected"]) for r in L.language_report(frame(spark, rows() + extra)).collect()]
    assert len(got) == len(rows()) + len(extra)
    by = {i: x for i, *x in got}
    for i in (9001, 9002, 9003, 9007, 9008):
        assert by[i] == ["und", 0.0, False]
    assert by[9006][0] == "de" and by[9006][1] > 0.99 and by[9005][0] == by[None][0] == "en"
    assert L.language_report(frame(spark, [])).collect() == []
    none = L.language_report(frame(spark, [(1, "some words", None), (2, None, "en")])).collect()
    assert {(r["lang_pred"], r["score"]) for r in none} == {("und", 0.0)}
    i = next(i for i in range(9) if zlib.crc32(str(i).encode()) % 5)
    one = L.language_report(frame(spark, [(i, "some words", "en"), (99, "другие слова", None)])).collect()
    assert {(r["lang_pred"], r["score"], r["margin"]) for r in one} == {("en", 1.0, 1.0)}


def test_equals_a_plain_loop(spark):
    """Sizes by zstandard over the pieces of whole texts, one text at a time."""
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    model = L.learnt(docs.where(~L.held_out(docs["doc_id"])))
    tools = model.compressors()
    got = {r["doc_id"]: (r["lang_pred"], r["lang_score"]) for r in L.identified(docs, model).collect()}
    for r in docs.collect():
        words = " ".join(L.regex.findall(r"[\p{L}\p{M}]+", r["text"].lower()))
        code = f" {words} ".encode()
        while len(code) < L.REPEAT:
            code += f" {words} ".encode()
        total = [sum(len(c.compress(code[a : a + L.PIECE])) for a in range(0, len(code), L.PIECE)) for c in tools]
        best = min(range(len(total)), key=lambda k: (total[k], k))
        assert got[r["doc_id"]][0] == model.names[best]
        assert got[r["doc_id"]][1] == pytest.approx(1 / sum(2.0 ** -min(t - total[best], 1000) for t in total))


def test_held_out_accuracy(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    out = QUERIES["op13_language_id"][0](spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    right = sum(r["lang"] == r["lang_pred"] for r in out)
    assert right / len(out) > 0.98 and len(out) > 150


def test_narrow_margins_are_rejected(spark):
    model = L.learnt(frame(spark, rows()))
    texts = frame(spark, [(1, "zzz qqq", "en"), (2, WORDS["fr"], "en")])
    out = {r["doc_id"]: r["lang_pred"] for r in L.confident(texts, model).collect()}
    assert out == {1: "und", 2: "fr"}
    assert L.confident(texts.withColumn("lang_pred", texts["lang"]), model).columns.count("lang_pred") == 1


def test_raw_dictionary_shortens_its_own_language():
    a, b = (L.reduced(WORDS[x] * 40) for x in ("en", "de"))
    tools = L.Languages(["en", "de"], [a, b]).compressors()
    s = L.sizes(L.reduced(WORDS["de"]), tools)
    assert s[1] < s[0] and isinstance(tools[0], zstandard.ZstdCompressor)
