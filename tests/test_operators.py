"""Relational operators on small frames."""

import random
from collections import Counter
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from foliomill.functions import text
from foliomill.operators import aggregates, alignment, augment, labels, matching, similarity, store, windows
from foliomill.plans.pipeline import ANONYMIZE, EXTRACTORS, Pipeline


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_bio_round_trip(spark):
    data = [(1, 0, "a", None), (1, 1, "b", "P"), (1, 2, "c", "P"), (1, 3, "d", "L"), (2, 0, "x", None)]
    df = labels.bio_encode(spark.createDataFrame(data, "d int, i int, token string, label string"), "label", ["d"], ["i"])
    assert [r["tag"] for r in df.orderBy("d", "i").collect()] == ["O", "B-P", "I-P", "B-L", None]
    found = labels.bio_entities(df.where("d = 1"), "tag", "token", ["d"], "i")
    assert rows(found.select("label", "first_pos", "last_pos", "text"), "first_pos") == [("P", 1, 2, "b c"), ("L", 3, 3, "d")]


def test_label_mapping_and_codes(spark):
    df = spark.createDataFrame([("NUM_DNI",), ("PER",)], "l string")
    assert [r[0] for r in df.select(labels.canonical(F.col("l"))).collect()] == ["DNI", "PER"]
    assert labels.label_codes(["B", "A"]) == {"O": 0, "B-A": 1, "I-A": 2, "B-B": 3, "I-B": 4}


def test_match_paragraphs_falls_back_to_the_closest(spark):
    p = spark.createDataFrame([(1, 0, "hola mundo"), (1, 1, "texto nuevo"), (2, 0, "solo")], "doc_id int, para_idx int, text string")
    q = spark.createDataFrame([(1, 0, "hola mundo"), (1, 1, "texto nuev"), (1, 2, "otra cosa larga")], "doc_id int, pred_idx int, text string")
    got = {(r["doc_id"], r["para_idx"]): r["pred_idx"] for r in matching.match_paragraphs(p, q).collect()}
    assert got == {(1, 0): 0, (1, 1): 1, (2, 0): None}


def test_store_merge_keeps_old_values_for_null(spark):
    table = spark.createDataFrame([("a", "1", None), ("b", "2", "v")], "id string, prediction string, validation string")
    updates = spark.createDataFrame([("a", "x", None, 0), ("a", None, "y", 1), ("c", "z", None, 2)], "id string, prediction string, validation string, ord int")
    merged = store.merge(table, updates, "id", ["prediction", "validation"], "ord")
    assert rows(merged, "id") == [("a", "x", "y"), ("b", "2", "v"), ("c", "z", None)]
    again = store.merge(merged, updates, "id", ["prediction", "validation"], "ord")
    assert rows(again, "id") == rows(merged, "id")


def test_store_strict_errors(spark):
    table = spark.createDataFrame([("a", "1")], "id string, prediction string")
    with pytest.raises(ValueError):
        store.delete(table, spark.createDataFrame([("z",)], "id string"), "id", strict=True)
    with pytest.raises(ValueError):
        store.update(table, spark.createDataFrame([("z", "9")], "id string, prediction string"), "id", ["prediction"], strict=True)


def test_predict_cached_runs_unknown_keys_once(spark):
    cache = spark.createDataFrame([("a", "old"), ("b", None)], "id string, prediction string")
    requests = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("c", 4)], "id string, n int")
    got = store.predict_cached(requests, cache, "id", lambda df: df.withColumn("prediction", F.concat(F.lit("new-"), "id")))
    assert rows(got.select("n", "prediction"), "n") == [(1, "old"), (2, "new-b"), (3, "new-c"), (4, "new-c")]
    assert rows(store.predict_cached(requests, cache, "id", lambda df: df.withColumn("prediction", F.lit("p")), legacy=True).select("n", "prediction"), "n")[1] == (2, None)


def test_align_tokens():
    assert alignment.align_tokens("a b c d".split(), "a <P> d".split()) == [("a", "a"), ("b", "<P>"), ("c", "<P>"), ("d", "d")]
    assert alignment.align_tokens(["a", "b"], ["a"]) == [("a", "a"), ("b", "")]


def test_alignment_score(spark):
    df = spark.createDataFrame([(1, "a b\nc d", "a x\nc d"), (2, None, "q")], "pair_id long, source_text string, target_text string")
    assert rows(alignment.alignment_score(alignment.align(df)), "pair_id") == [(1, 0.75, 4)]
    assert rows(alignment.alignment_score(alignment.align(df, by_document=True)), "pair_id") == [(1, 0.75, 4)]


def test_augment_is_seeded_and_keeps_tags_aligned(spark):
    df = spark.createDataFrame([("h", ["Juan", "Perez", "vive"], ["B-PER", "I-PER", "O"])], "hash string, tokens array<string>, tags array<string>")
    a, b = (augment.augment(df, 3).orderBy("copy_no").collect() for _ in range(2))
    assert a == b and all(len(r["tokens"]) == len(r["tags"]) and r["tags"][0] == "B-PER" and r["tags"][-1] == "O" for r in a)


def test_generators_make_text():
    import random

    assert len(augment.GENERATORS) == 25
    assert all(g(random.Random(i)).strip() for g in augment.GENERATORS.values() for i in range(20))


def test_windows(spark):
    df = spark.createDataFrame([(1, 0, "a"), (1, 1, "a"), (1, 2, None), (1, 3, None), (1, 4, "a")], "d int, i int, v string")
    assert [r["island"] for r in windows.with_island(df, "v", ["d"], ["i"]).orderBy("i").collect()] == [1, 1, 2, 2, 3]
    assert windows.drop_null_columns(df.withColumn("n", F.lit(None).cast("int"))).columns == ["d", "i", "v"]


def test_weighted_resample_follows_weights(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 3.0), (3, 0.0)], "id int, w double")
    counts = {r["id"]: r["count"] for r in matching.weighted_resample(df, "w", "id", 2000).groupBy("id").count().collect()}
    assert sum(counts.values()) == 2000 and 3 not in counts and 2.4 < counts[2] / counts[1] < 3.7


@pytest.mark.parametrize("block", [1 << 20, 16])
def test_retrieve_in_blocks(spark, block):
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0])], "query_id int, embedding array<double>")
    o = spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 0.0]), (3, [1.0, 0.0])], "option_id int, embedding array<double>")
    got = {(r["query_id"], r["rank"]): (r["option_id"], r["score"]) for r in similarity.retrieve(q, o, 2, block_bytes=block).collect()}
    assert got == {(1, 1): (2, 1.0), (1, 2): (3, 1.0), (2, 1): (1, 2.0), (2, 2): (2, 0.0)}
    assert similarity.retrieve(q, o.where("false"), 2).count() == 0


def test_distance_is_levenshtein():
    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    r = random.Random(3)
    for _ in range(2000):
        a, b = ("".join(r.choice("abc") for _ in range(r.randint(0, 12))) for _ in range(2))
        most, d = r.randint(0, 12), plain(a, b)
        assert matching.distance(a, b) == d and matching.distance(a, b, most) == (d if d <= most else None)


def test_closest_paragraphs_against_all_pairs(spark):
    r = random.Random(4)
    texts = ["".join(r.choice("abcd ") for _ in range(r.randint(0, 20))) for _ in range(60)]
    p = spark.createDataFrame([(i % 3, i, t) for i, t in enumerate(texts[:30])] + [(9, 99, "alone")], "doc_id int, para_idx int, text string")
    q = spark.createDataFrame([(i % 3, i, t) for i, t in enumerate(texts[30:])], "doc_id int, pred_idx int, text string")
    for size in (64, 2):
        got = {(x["doc_id"], x["para_idx"]): (x["pred_idx"], x["cer"]) for x in matching.match_paragraphs(p, q, part_size=size).collect()}
        assert got.pop((9, 99)) == (None, None) and len(got) == 30
        for (doc, para), (pred, cer) in got.items():
            every = [(matching.distance(texts[para], t) / max(1, len(texts[para])), i) for i, t in enumerate(texts[30:]) if i % 3 == doc]
            assert (pytest.approx(cer), pred) == min(every)


def test_resampling_follows_the_weights(spark):
    df = spark.createDataFrame([(i, 3.0 if i < 10 else 1.0) for i in range(40)] + [(99, 0.0)], "k int, w double")
    got = matching.weighted_resample(df, "w", "k", 6000).collect()
    counts = Counter(r["k"] for r in got)
    assert len(got) == 6000 and len({r["draw"] for r in got}) == 6000 and 99 not in counts
    assert 0.4 < sum(counts[i] for i in range(10)) / 6000 < 0.6
    assert matching.weighted_resample(df.where("w = 0"), "w", "k", 10).count() == 0


def test_adjacent_groups_are_stitched(spark):
    r = random.Random(5)
    for values in ([r.choice("ab") for _ in range(500)], ["a"] * 300, [r.choice(["a", None]) for _ in range(200)], []):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
        got = [(x["v"], x["n"]) for x in sorted(aggregates.adjacent_groups(df, "v", ["i"]).collect(), key=lambda x: x["island"])]
        assert got == [(k, len(list(g))) for k, g in groupby(values)]


def test_binned_percentiles_are_exact(spark):
    r = random.Random(6)
    df = spark.createDataFrame([(k, r.choice([r.gauss(0, 50), 7.0])) for k in ("x", "y", None) for _ in range(r.randint(1, 300))] + [("z", None)], "k string, v double")
    a = {x["k"]: x for x in aggregates.describe(df, "v", ["k"]).collect()}
    for bins in (4096, 3):
        b = {x["k"]: x for x in aggregates.describe_binned(df, "v", ["k"], bins=bins).collect()}
        for k in ("x", "y"):
            assert {c: pytest.approx(a[k][c]) for c in df.sparkSession.createDataFrame([a[k]]).columns if c != "k"} == {c: b[k][c] for c in b[k].asDict() if c != "k"}
        assert b["z"]["count"] == 0 and b["z"]["p50"] is None


def test_fuzzy_keyword_against_all_windows(spark):
    r = random.Random(7)
    texts = ["".join(r.choice("abcviolen ") for _ in range(r.randint(0, 30))) for _ in range(150)] + ["la bioencia", "violenci", "", "viol", "xviolenciax", "vioolenccia"]
    got = [x["f"] for x in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(text.fuzzy_contains(F.col("t"), "violencia").alias("f")).collect()]
    for t, found in zip(texts, got):
        assert found == any(matching.distance(t[i : i + n], "violencia") <= 2 for n in range(7, 12) for i in range(len(t) - n + 1)), t


def test_store_keeps_columns_and_reduces_repeats(spark):
    table = spark.createDataFrame([(1, "a", "n1"), (2, "b", "n2"), (None, "c", "n3")], "id int, prediction string, note string")
    updates = spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (1, 3, None), (3, 1, "z"), (3, 2, "w")], "id int, ord int, prediction string")
    merged = sorted((tuple(r) for r in store.merge(table, updates, "id", ["prediction"], "ord").collect()), key=str)
    assert merged == sorted([(1, "y", "n1"), (2, "b", "n2"), (3, "w", None), (None, "c", "n3")], key=str)
    assert store.update(table, updates, "id", ["prediction"], ordinal="ord").count() == 3
    made = store.create(table, updates, "id", ordinal="ord")
    assert sorted(str(r["id"]) for r in made.collect()) == ["1", "2", "3", "None"] and made.where("id = 3").first()["prediction"] == "w"
    requests = spark.createDataFrame([(1,), (None,), (None,), (7,)], "id int")
    got = store.predict_cached(requests, table, "id", lambda df: df.withColumn("prediction", F.lit("new"))).collect()
    assert sorted((str(r["id"]), r["prediction"]) for r in got) == [("1", "a"), ("7", "new"), ("None", "new"), ("None", "new")]


def test_targets_of_tokens():
    tokens = "Juan Pérez vive en Calle 5 de Lima".split()
    assert alignment.targets_of(tokens, "<PER> vive en <DIRECCION> de Lima") == ["<PER>", "<PER>", "vive", "en", "<DIRECCION>", "<DIRECCION>", "de", "Lima"]
    assert alignment.targets_of([], "x") == []


def test_code_table_is_that_of_the_labels(spark):
    names = ["PER", "LOC", "NUM", "DNI", "LO"]
    df = spark.createDataFrame([(n,) for n in [*names, "PER", None]], "label string")
    assert {r["tag"]: r["code"] for r in labels.code_table(df).collect()} == labels.label_codes(names)


def test_report_of_perfect_and_missing(spark):
    df = spark.createDataFrame([("a", "a"), ("b", "a")], "t string, p string")
    got = {r["label"]: (r["precision"], r["recall"], r["support"]) for r in aggregates.classification_report(df, "t", "p").collect()}
    assert got == {"a": (0.5, 1.0, 1), "b": (0.0, 0.0, 1)}


def test_pipeline_from_json(spark):
    again = Pipeline.from_json(ANONYMIZE.to_json())
    df = spark.createDataFrame([(1, "Escriba a ana@x.com.\n\nNada")], "doc_id long, text string")
    assert [r["redacted"] for r in again(df).orderBy("para_idx").collect()] == ["Escriba a <CORREO_ELECTRONICO>.", "Nada"]
    with pytest.raises(ValueError):
        Pipeline.from_json('{"models": [["os.system", {}]]}')


def test_model_extractor(spark):
    class Shouter:
        def predict(self, texts):
            return [[{"label": "X", "text": t[:1], "start_char": 0, "end_char": 1}] if t else [] for t in texts]

    EXTRACTORS["shouter"] = Shouter
    try:
        df = spark.createDataFrame([(1, "abc"), (2, "abc"), (3, None)], "doc_id long, text string")
        out = Pipeline.from_json('{"models": [["extractor", {"name": "shouter"}]], "postprocess": [["filter_entities", {"enable": ["X"]}]]}')(df)
        assert [len(r["entities"]) for r in out.orderBy("doc_id").collect()] == [1, 1, 0]
    finally:
        del EXTRACTORS["shouter"]


def test_alignment_keeps_source_and_target(spark):
    r = random.Random(11)
    words = "a b c d e f g".split()
    pairs = [(i, " ".join(r.choice(words) for _ in range(r.randint(0, 12))), " ".join(r.choice(words) for _ in range(r.randint(0, 12)))) for i in range(60)] + [(99, "x\ny z", "x\ny z")]
    df = spark.createDataFrame(pairs, "pair_id long, source_text string, target_text string")
    for by_document in (False, True):
        got = {}
        for x in alignment.align(df, by_document).orderBy("pair_id", "pos").collect():
            got.setdefault(x["pair_id"], []).append((x["source"], x["target"]))
        for i, source, target in pairs:
            own = got.get(i, [])
            assert [s for s, _ in own] == source.split()
            # Equal tokens come in the target's order, and no more of them than a longest common subsequence.
            same = [s for s, t in own if s == t]
            rest = iter(target.split())
            assert all(any(t == s for t in rest) for s in same)
        assert all(s == t for s, t in got[99])


def test_augmentation_replaces_labels_only():
    r = random.Random(12)
    for _ in range(200):
        tags, tokens = [], []
        for _ in range(r.randint(1, 6)):
            label, n = r.choice(["O", "PER", "DNI", "UNKNOWN"]), r.randint(1, 3)
            tags += ["O"] * n if label == "O" else [f"B-{label}"] + [f"I-{label}"] * (n - 1)
            tokens += [f"t{r.randrange(99)}" for _ in range(n)]
        new, new_tags = augment.replace_entities(tokens, tags, random.Random(1))
        plain = lambda t: t.removeprefix("B-").removeprefix("I-")
        assert len(new) == len(new_tags)
        assert [k for k, _ in groupby(map(plain, tags))] == [k for k, _ in groupby(map(plain, new_tags))]
        kept = [w.lower() for w, t in zip(tokens, tags) if plain(t) in ("O", "UNKNOWN")]
        assert [w.lower() for w, t in zip(new, new_tags) if plain(t) in ("O", "UNKNOWN")] == kept
