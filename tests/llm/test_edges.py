"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns for every operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from foliomill.llm import decontam, langid, license_scan, line_rules, mixing, quality, sharding, shingles, simhash, url_filter, warc

CLASHES = ["fingerprint", "component_id", "score", "shard", "slot", "kept", "labels", "lang_pred", "_row", "_text", "fp", "copies", "before", "_copies", "unit", "order", "stays", "label"]
LONG = "palabra uno dos tres " * 20_000
DOCS = [
    (1, "Hello world this is a plain text about nothing in particular.", "en", "src1"),
    (2, None, "en", None),
    (3, "", None, "src2"),
    (None, "A row without any id but with words.", "fr", "src1"),
    (None, None, None, None),
    (5, "   \n\t ", "de", "src12"),
    (6, "1234 5678 !!!", "de", "src12"),
    (7, LONG, "es", "src3"),
    (8, LONG + "fin", "es", "src3"),
    (9, "Same row twice.", "en", "src1"),
    (9, "Same row twice.", "en", "src1"),
    (10, "a\x00b \ud7ff \U0001f600 ʼn", "fr", "src9"),
    (11, "palabra" * 40_000, "es", "src3"),
]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame([(i, t, l, s, len(t) if t else None) for i, t, l, s in DOCS], "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *[F.lit("clash").alias(c) for c in CLASHES])


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "palabra uno dos tres palabra uno dos"), (2, None), (None, "x y z"), (3, ""), (4, "two words")], "item_id long, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1), (7, 0), (None, 1), (9, None), (9, 1), (8, 0)], "doc_id long, quality int")


def ids(df):
    return sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in df.select("doc_id").collect())


EVERY = sorted((d[0] is None, d[0] or 0) for d in DOCS)


def test_simhash(docs):
    got = simhash.near_duplicates(docs)
    assert ids(got) == EVERY
    by = {r["doc_id"]: r for r in got.collect()}
    assert by[2]["fingerprint"] == by[3]["fingerprint"] == by[5]["fingerprint"] == "0" * 16
    assert by[2]["component_id"] == by[5]["component_id"] == 2
    assert [r["component_id"] for r in got.where("doc_id = 9").collect()] == [9, 9]


def test_one_of_alike_rows_stays(docs):
    for keep in (simhash.keep_one, shingles.keep_one):
        kept = keep(docs)
        assert kept.columns == docs.columns and keep(docs.where("false")).count() == 0
        assert ids(kept).count((False, 9)) == 1 and (True, 0) in ids(kept)


def test_langid(docs):
    got = langid.identify(docs)
    assert ids(got) == EVERY
    by = {r["doc_id"]: r for r in got.collect()}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (2, 3, 5, 6))
    assert all(by[i]["lang_pred"] in ("en", "fr", "de", "es") for i in (1, 7, 8, 9, 10, 11))
    kept = langid.keep_identified(docs, least=0.0)
    assert kept.columns == docs.columns and 2 not in [r["doc_id"] for r in kept.select("doc_id").collect()]


def test_langid_without_labels(docs):
    got = langid.identify(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in got.collect()} == {"und"}


def test_quality(docs, labels):
    got = quality.classify(docs, labels)
    assert ids(got) == EVERY
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got.collect())
    assert {round(r["score"], 6) for r in quality.classify(docs, labels.where("false")).collect()} == {0.5}


def test_quality_of_nothing(docs, labels):
    assert quality.classify(docs.where("false"), labels).count() == 0
    assert quality.classify(docs, labels.where("false").select("doc_id", F.col("quality").cast("long"))).count() == len(DOCS)


def test_decontamination(docs, items):
    got = decontam.find_leaks(docs, items)
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == {(7, 1), (8, 1)}
    kept = decontam.drop_leaks(docs, items)
    assert kept.columns == docs.columns and ids(kept) == [x for x in EVERY if x[1] not in (7, 8)]
    assert decontam.find_leaks(docs, items.where("false")).count() == 0
    assert decontam.drop_leaks(docs, items.where("false")).count() == len(DOCS)


def test_license_scan(docs):
    got = license_scan.scan(docs)
    assert ids(got) == EVERY
    assert {(r["labels"], r["score"], r["first_word"]) for r in got.collect()} == {("", 0.0, None)}


def test_line_rules(docs):
    got = line_rules.judge(docs, with_text=True)
    assert ids(got) == EVERY
    assert all(not r["kept"] and r["base_failed"] and r["n_words"] == 0 for r in got.where("doc_id in (2, 3, 5)").collect())


def test_mixing(docs):
    got = mixing.select(docs, share=1.0)
    assert not {2, 3, 5} & {r["doc_id"] for r in got.collect()}
    kept = mixing.keep_selected(docs, share=1.0, epochs=1)
    assert kept.columns == docs.columns
    assert ids(kept) == sorted((i is None, i or 0) for i, t, *_ in DOCS if (t or "").strip())


def test_sharding(docs):
    got = sharding.assign(docs)
    assert ids(got) == EVERY
    assert {r["n"] for r in got.groupBy("shard").agg(F.count("*").alias("n")).collect()} == {1}


def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/x?y#z", "http://example.com", "x://a.net/es/", "ftp://h://b/c", "http://m.com/" + "a" * 50_000]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)] + [(0, None, "x")], "page_id long, url string, verdict string")
    by = {r["page_id"]: r for r in url_filter.judge(pages).collect()}
    assert (by[0]["host"], by[0]["path"], by[2]["host"]) == ("", "", "")
    assert (by[4]["host"], by[4]["path"], by[4]["rule"], by[4]["verdict"]) == ("www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert (by[5]["host"], by[5]["path"], by[5]["rule"]) == ("example.com", "", None)
    assert (by[6]["rule"], by[6]["verdict"]) == ("net/es/", "block")
    assert by[7]["host"] == "h:"
    assert url_filter.judge(pages).count() == len(urls) + 1
    assert url_filter.judge(pages.where("false")).count() == 0
    assert {r["verdict"] for r in url_filter.judge(pages.where("page_id < 4")).collect()} == {"allow"}


def test_warc(spark):
    rows = [(1, "http://a/", "x"), (2, None, None), (3, "http://b/\r\nEvil: 1", ""), (4, "u", "x"), (4, "u", "x"), (None, "u", "x"), (0, "é", "ü" * 300_000), (None, None, "solo")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string")
    got = warc.read(warc.write(pages), strict=True).collect()
    assert len(got) == len(rows) and not any(r["error"] for r in got)
    by = {r["page_id"]: (r["record_type"], r["refers_to"], r["payload_bytes"]) for r in got if r["page_id"] is not None}
    assert by == {1: ("response", None, 1), 2: ("response", None, 0), 3: ("revisit", 2, 0), 4: ("revisit", 1, 1), 0: ("response", None, 600_000)}
    assert sorted((r["record_type"], r["refers_to"]) for r in got if r["page_id"] is None) == [("response", None), ("revisit", 1)]
    assert warc.read(warc.write(pages.where("false"))).count() == 0


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages(spark, docs, items, tmp_path, name, stage):
    items.write.parquet(str(tmp_path / "benchmark.parquet"))
    out = stage(spark, docs, str(tmp_path))
    assert out.count() <= len(DOCS)
    if name != corpus_pipeline.STAGES[-1][0]:
        assert out.columns == docs.columns
    empty = stage(spark, docs.where("false"), str(tmp_path))
    assert empty.count() == 0


@pytest.mark.parametrize("operator", [simhash.near_duplicates, langid.identify, license_scan.scan, line_rules.judge, mixing.select, sharding.assign])
def test_empty_tables(docs, operator):
    assert operator(docs.where("false")).count() == 0
