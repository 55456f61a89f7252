"""Similarity and matching queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates, matching, similarity
from ..operators.store import TableCache
from .registry import query

_TERMS = r"SELECT {k}, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}')) AS term FROM {t}"
TFIDF = f"""
dt AS (SELECT doc_id, term, count(*) AS tf FROM ({_TERMS.format(k='doc_id', t='documents')}) GROUP BY ALL),
idf AS (SELECT term, ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + count(*))) + 1.0 AS idf FROM dt GROUP BY term),
dw AS (SELECT doc_id, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY doc_id)) AS w FROM dt JOIN idf USING (term)),
bt AS (SELECT item_id, term, count(*) AS tf FROM ({_TERMS.format(k='item_id', t='benchmark')}) GROUP BY ALL),
bw AS (SELECT item_id, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY item_id)) AS w FROM bt JOIN idf USING (term)),
pairs AS (SELECT item_id, doc_id, round(sum(bw.w * dw.w), 9) AS score FROM bw JOIN dw USING (term) GROUP BY ALL)
"""


@query(f"WITH {TFIDF} SELECT item_id, arg_max(doc_id, (score, -doc_id)) AS doc_id, round(max(score), 6) AS score FROM pairs GROUP BY item_id")
def tfidf_cosine_best_match(t):
    from .files import work_folder

    # Counts and weights are read several times, so they are written once.
    kept = TableCache(t.spark, work_folder(t.spark))
    counts = kept.save("counts", similarity.term_counts(t.documents, "doc_id"))
    idf = kept.save("idf", similarity.tfidf_fit(t.documents, "doc_id", counts=counts)[0])
    items = similarity.tfidf_transform(t.benchmark, "item_id", idf)
    return similarity.best_document(items, t.documents, "item_id", "doc_id", idf, counts=counts).select("item_id", "doc_id", F.round("score", 6).alias("score"))


@query("WITH e AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT label, i, round(avg(x), 6) AS x FROM e GROUP BY label, i), o AS (SELECT label AS option_id, list(x ORDER BY i) AS v FROM c GROUP BY label), s AS (SELECT vec_id AS query_id, option_id, round(list_sum(list_transform(range(1, 65), lambda i: embedding[i]::DOUBLE * v[i])), 9) AS score FROM embeddings, o), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, option_id)::INT AS rank FROM s) SELECT query_id, rank, option_id, round(score, 6) AS score FROM r WHERE rank <= 3")
def vector_topk(t):
    return _nearest(t, 3).withColumn("score", F.round("score", 6))


def _nearest(t, k):
    parts = t.embeddings.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("x"))
    options = parts.groupBy(F.col("label").alias("option_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("embedding"))
    return similarity.retrieve(t.embeddings.select(F.col("vec_id").alias("query_id"), "embedding"), options, k)


@query("WITH e AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT label, i, round(avg(x), 6) AS x FROM e GROUP BY label, i), o AS (SELECT label AS option_id, list(x ORDER BY i) AS v FROM c GROUP BY label), s AS (SELECT vec_id, label, option_id, round(list_sum(list_transform(range(1, 65), lambda i: embedding[i]::DOUBLE * v[i])), 9) AS score FROM embeddings, o), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, option_id) AS rank FROM s), b AS (SELECT vec_id, min(rank) FILTER (label = option_id) AS r FROM r GROUP BY vec_id) SELECT round(avg((r <= 1)::INT), 9) AS top1, round(avg((r <= 2)::INT), 9) AS top2, round(avg((r <= 3)::INT), 9) AS top3, round(avg((r <= 5)::INT), 9) AS top5 FROM b")
def topk_hit_rate(t):
    ranked = _nearest(t, 5).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "option_id"))), lambda x: x["option_id"]).alias("ranked"))
    rows = ranked.join(t.embeddings.select(F.col("vec_id").alias("query_id"), "label"), "query_id")
    out = aggregates.top_k_rates(rows, "label", "ranked")
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns])


_PLAIN = "regexp_replace(text, '[^ -~]', '', 'g')"
_CER = f"""
WITH p AS (SELECT conv_id AS doc_id, turn AS para_idx, {_PLAIN} AS text FROM conversations),
q AS (SELECT conv_id AS doc_id, turn AS pred_idx, CASE WHEN turn % 2 = 0 THEN {_PLAIN} ELSE {_PLAIN} || ' fin' END AS text FROM conversations),
exact AS (SELECT p.doc_id, p.para_idx, min(q.pred_idx) AS pred_idx, 0.0::DOUBLE AS cer FROM p JOIN q ON p.doc_id = q.doc_id AND trim(p.text) = trim(q.text) GROUP BY ALL),
rp AS (SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM q WHERE q.doc_id = p.doc_id AND trim(q.text) = trim(p.text))),
rq AS (SELECT * FROM q WHERE NOT EXISTS (SELECT 1 FROM p WHERE q.doc_id = p.doc_id AND trim(q.text) = trim(p.text))),
pairs AS (SELECT rp.doc_id, rp.para_idx, rq.pred_idx, levenshtein(rp.text, rq.text) / greatest(length(rp.text), 1) AS cer FROM rp JOIN rq ON rp.doc_id = rq.doc_id),
near AS (SELECT doc_id, para_idx, arg_min(pred_idx, (cer, pred_idx)) AS pred_idx, min(cer) AS cer FROM pairs GROUP BY ALL)
SELECT doc_id, para_idx, pred_idx, round(cer, 9) AS cer FROM exact UNION ALL SELECT rp.doc_id, rp.para_idx, n.pred_idx, round(n.cer, 9) FROM rp LEFT JOIN near n USING (doc_id, para_idx)
"""


@query(_CER)
def cer_best_match(t):
    plain = F.regexp_replace("text", "[^ -~]", "")
    p = t.conversations.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("para_idx"), plain.alias("text"))
    q = t.conversations.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("pred_idx"), F.when(F.col("turn") % 2 == 0, plain).otherwise(F.concat(plain, F.lit(" fin"))).alias("text"))
    return matching.match_paragraphs(p, q).withColumn("cer", F.round("cer", 9))


@query("SELECT vec_id, round(list_max(list_transform(s, lambda x: exp(x - list_max(s)))) / list_sum(list_transform(s, lambda x: exp(x - list_max(s)))), 6) AS best FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS s FROM embeddings)")
def softmax_peak(t):
    p = aggregates.softmax(F.transform("embedding", lambda x: x.cast("double")))
    return t.embeddings.select("vec_id", F.round(F.array_max(p), 6).alias("best"))


@query("SELECT vec_id, list_max(embedding[1:3])::DOUBLE AS first_word, embedding[4]::DOUBLE AS second_word FROM embeddings")
def subword_scores(t):
    ids = F.array(*[F.lit(x) for x in (0, 0, 0, 1, 1, None)]).cast("array<int>")
    scores = F.transform(F.slice("embedding", 1, 6), lambda x: x.cast("double"))
    best, first = aggregates.subword_scores(scores, ids), aggregates.subword_scores(scores, ids, "first")
    return t.embeddings.select("vec_id", F.get(best, 0).alias("first_word"), F.get(first, 1).alias("second_word"))
