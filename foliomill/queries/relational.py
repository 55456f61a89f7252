"""Joins, aggregates, windows and set operations over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import structs
from ..operators import aggregates, labels, matching, store, windows
from .registry import query, sql_list


@query("SELECT o_orderkey, o_custkey, c_name, c_mktsegment FROM orders LEFT JOIN (SELECT * FROM customer QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY c_name) = 1) ON o_custkey = c_custkey")
def left_join_dedup(t):
    c = t.customer.withColumnRenamed("c_custkey", "o_custkey")
    return matching.left_with_metadata(t.orders, c, ["o_custkey"], [F.col("c_name")]).select("o_orderkey", "o_custkey", "c_name", "c_mktsegment")


@query("SELECT l_orderkey, l_linenumber, o_orderdate::DATE AS day FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def inner_join(t):
    return t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", F.to_date("o_orderdate").alias("day"))


@query("SELECT page_id, url FROM pages WHERE EXISTS (SELECT 1 FROM documents WHERE doc_id = page_id AND lang = 'en')")
def semi_join(t):
    return matching.present_in(t.pages, t.documents.where("lang = 'en'").select(F.col("doc_id").alias("page_id")), ["page_id"]).select("page_id", "url")


@query("SELECT d.doc_id FROM documents d WHERE EXISTS (SELECT 1 FROM documents e WHERE e.text = d.text AND e.source = 'src1')")
def semi_leakage(t):
    key = t.documents.withColumn("hash", F.sha2("text", 256))
    return matching.present_in(key, key.where("source = 'src1'"), ["hash"]).select("doc_id")


SPLIT = "CASE WHEN ('0x' || substr(md5({k}::VARCHAR), 1, 8))::BIGINT % 100 < 80 THEN 'train' WHEN ('0x' || substr(md5({k}::VARCHAR), 1, 8))::BIGINT % 100 < 90 THEN 'dev' ELSE 'test' END"


def _split(df, key):
    return df.withColumn("split", aggregates.hash_split(key))


@query(f"WITH s AS (SELECT doc_id, sha256(text) AS hash, {SPLIT.replace('{k}', 'doc_id')} AS split FROM documents) SELECT doc_id, split FROM s WHERE split = 'train' OR (split = 'dev' AND hash NOT IN (SELECT hash FROM s WHERE split = 'train')) OR (split = 'test' AND hash NOT IN (SELECT hash FROM s WHERE split <> 'test'))")
def anti_leakage(t):
    rows = _split(t.documents.select("doc_id", F.sha2("text", 256).alias("hash")), "doc_id")
    train, dev, test = (rows.where(F.col("split") == x) for x in ("train", "dev", "test"))
    clean = train.union(matching.absent_from(dev, train, keys=["hash"]).select(rows.columns)).union(matching.absent_from(test, train, dev, keys=["hash"]).select(rows.columns))
    return clean.select("doc_id", "split")


@query(f"SELECT doc_id, {SPLIT.replace('{k}', 'doc_id')} AS split FROM documents")
def hash_split(t):
    return _split(t.documents, "doc_id").select("doc_id", "split")


@query(f"WITH s AS (SELECT doc_id, {SPLIT.replace('{k}', 'doc_id')} AS split FROM documents) SELECT doc_id, split FROM s WHERE split <> 'train' OR ('0x' || substr(md5('7:' || doc_id::VARCHAR), 1, 8))::BIGINT % 100 < 10")
def downsample_train(t):
    rows = _split(t.documents, "doc_id")
    low = F.conv(F.substring(windows.seeded_order("doc_id", 7), 1, 8), 16, 10).cast("long") % 100 < 10
    return rows.where((F.col("split") != "train") | low).select("doc_id", "split")


@query("SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id::VARCHAR))::INT AS place FROM documents")
def seeded_shuffle(t):
    rows = t.documents.select("doc_id", windows.seeded_order("doc_id", 42).alias("key"))
    return windows.ordered_rank(rows, [F.substring("key", 1, 2)], [F.col("key")], "place").select("doc_id", "place")


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def set_difference(t):
    return t.customer.select(F.col("c_custkey").alias("k")).subtract(t.orders.select("o_custkey"))


@query("SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders")
def set_intersection(t):
    return t.customer.select(F.col("c_custkey").alias("k")).intersect(t.orders.select("o_custkey"))


@query("(SELECT s_nationkey AS k FROM supplier EXCEPT SELECT c_nationkey FROM customer) UNION (SELECT p_size FROM part EXCEPT SELECT s_nationkey FROM supplier)")
def set_symmetric_difference(t):
    a = t.supplier.select(F.col("s_nationkey").alias("k")).distinct()
    return a.subtract(t.customer.select("c_nationkey")).union(t.part.select("p_size").distinct().subtract(a)).distinct()


@query("SELECT s_suppkey AS k, s_name AS name FROM supplier UNION ALL SELECT c_custkey, c_name FROM customer")
def union_all(t):
    return t.supplier.select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name")).unionByName(t.customer.select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name")))


@query("SELECT o_orderpriority AS v, n, n / sum(n) OVER () AS share FROM (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1)")
def value_counts(t):
    return aggregates.value_counts(t.orders.select(F.col("o_orderpriority").alias("v")), "v")


@query("SELECT o_orderstatus, o_orderpriority, n, n / sum(n) OVER (PARTITION BY o_orderstatus) AS share FROM (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2)")
def value_counts_by_key(t):
    return aggregates.value_counts(t.orders, "o_orderpriority", ["o_orderstatus"])


@query("SELECT l_suppkey, count(DISTINCT l_partkey) AS n_parts, sum(l_quantity) AS quantity FROM lineitem GROUP BY l_suppkey")
def nunique_and_sum(t):
    return t.lineitem.groupBy("l_suppkey").agg(F.countDistinct("l_partkey").alias("n_parts"), F.sum("l_quantity").alias("quantity"))


@query("SELECT count(DISTINCT o_orderstatus) AS o_orderstatus, count(DISTINCT o_orderpriority) AS o_orderpriority, count(DISTINCT o_custkey) AS o_custkey FROM orders")
def nunique_columns(t):
    return t.orders.agg(*[F.countDistinct(c).alias(c) for c in ("o_orderstatus", "o_orderpriority", "o_custkey")])


@query("SELECT user_id, date_diff('day', min(ts)::DATE, max(ts)::DATE)::INT AS span_days, count(*) AS n FROM events GROUP BY user_id")
def case_date_span(t):
    return aggregates.case_spans(t.events, "user_id", "ts")


@query("WITH g AS (SELECT user_id, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts))) / 1e6 AS gap FROM events) SELECT user_id, round(avg(gap), 6) AS mean_gap FROM g GROUP BY user_id")
def case_mean_gap(t):
    return aggregates.case_gaps(t.events, "user_id", "ts").withColumn("mean_gap", F.round("mean_gap", 6))


@query("SELECT user_id, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS event_type FROM events GROUP BY user_id")
def collect_distinct_values(t):
    return aggregates.distinct_values(t.events, ["user_id"], ["event_type"]).withColumn("event_type", F.array_join("event_type", ","))


@query("SELECT n_nationkey, CASE WHEN count(DISTINCT n_name) <= 1 THEN min(n_name) END AS n_name FROM nation GROUP BY n_nationkey")
def collapse_single(t):
    return aggregates.collapse_single(aggregates.distinct_values(t.nation, ["n_nationkey"], ["n_name"]), ["n_name"])


@query("SELECT l_returnflag, count(l_extendedprice) AS count, round(avg(l_extendedprice), 6) AS mean, round(stddev_samp(l_extendedprice), 6) AS std, min(l_extendedprice) AS min, " + ", ".join(f"round(quantile_cont(l_extendedprice, {p}), 6) AS p{round(100 * p)}" for p in aggregates.PERCENTILES) + ", max(l_extendedprice) AS max FROM lineitem GROUP BY l_returnflag")
def describe_percentiles(t):
    out = aggregates.describe_binned(t.lineitem, "l_extendedprice", ["l_returnflag"])
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c.startswith("p") or c in ("mean", "std")})


@query("SELECT 100.0 * (count(*) FILTER (o_totalprice < 100000) + count(*) FILTER (o_totalprice <= 100000)) / (2.0 * count(*)) AS percentile FROM orders")
def percentile_of_score(t):
    return aggregates.percentile_of_score(t.orders, "o_totalprice", 100000.0)


@query("SELECT median(l_quantity) AS m FROM lineitem")
def median(t):
    return t.lineitem.agg(F.median("l_quantity").alias("m"))


@query("SELECT floor(n_chars / 500.0) * 500.0 AS bin, count(*) AS n FROM documents GROUP BY 1")
def histogram_bins(t):
    return aggregates.histogram(t.documents, "n_chars", 500.0)


@query("SELECT sum(quality)::BIGINT AS quality, sum(toxic)::BIGINT AS toxic FROM labels")
def flag_sums(t):
    return aggregates.flag_sums(t.labels, ["quality", "toxic"])


@query("SELECT doc_id, quality + toxic AS n FROM labels")
def flag_row_sum(t):
    return t.labels.select("doc_id", aggregates.row_sum("quality", "toxic").alias("n"))


@query("WITH c AS (SELECT event_type AS label, count(*) AS n FROM events WHERE event_type <> 'click' GROUP BY 1) SELECT label, n, (sum(n) OVER () / n) / min(x) OVER () AS weight FROM (SELECT *, sum(n) OVER () / n AS x FROM c)")
def label_weights(t):
    return aggregates.label_weights(t.events.select(F.col("event_type").alias("label")), ignore=["click"])


@query("WITH c AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1) SELECT event_type, n, sum(n) OVER () / (count(*) OVER () * n) AS weight FROM c")
def balanced_weights(t):
    return aggregates.balanced_weights(t.events, "event_type")


@query("SELECT year(o_orderdate)::INT AS y, count(o_orderkey) AS n FROM orders GROUP BY 1")
def year_counts(t):
    return t.orders.groupBy(F.year("o_orderdate").alias("y")).agg(F.count("o_orderkey").alias("n"))


@query("WITH f AS (SELECT conv_id, turn, role, CASE WHEN role = lag(role) OVER w THEN 0 ELSE 1 END AS fresh FROM conversations WINDOW w AS (ORDER BY conv_id, turn)), g AS (SELECT *, sum(fresh) OVER (ORDER BY conv_id, turn) AS island FROM f) SELECT island::BIGINT AS island, any_value(role) AS role, count(*) AS n FROM g GROUP BY island")
def adjacent_groups(t):
    return aggregates.adjacent_groups(t.conversations, "role", ["conv_id", "turn"])


@query("SELECT DISTINCT json_extract_string(props, '$.k') AS k FROM events")
def unique_objects(t):
    return t.events.select(F.get_json_object("props", "$.k").alias("k")).distinct()


@query("SELECT event_id, coalesce(json_extract_string(props, '$.k'), 'none') AS k, coalesce(json_extract_string(props, '$.missing'), 'none') AS missing FROM events")
def json_path_get(t):
    return t.events.select("event_id", structs.json_path(F.col("props"), ["k"], "none").alias("k"), structs.json_path(F.col("props"), ["missing"], "none").alias("missing"))


@query("SELECT n_regionkey, count(*) AS n_rows, bool_or(n_nationkey > 20) AS late, array_to_string(list_sort(list(n_name)), ',') AS n_name FROM nation GROUP BY n_regionkey")
def group_items(t):
    out = aggregates.to_items(t.nation.withColumn("late", F.col("n_nationkey") > 20), ["n_regionkey"], ["late"], ["n_name"])
    return out.withColumn("n_name", F.array_join("n_name", ","))


@query("SELECT conv_id, string_agg(turn || ':' || role, '|' ORDER BY turn, role) AS records FROM conversations GROUP BY conv_id")
def group_records(t):
    out = aggregates.to_records(t.conversations.select("conv_id", "turn", "role"), ["conv_id"], "turn")
    return out.select("conv_id", F.array_join(F.transform("records", lambda r: F.concat_ws(":", r["turn"], r["role"])), "|").alias("records"))


@query("SELECT text, min(doc_id) AS doc_id FROM documents GROUP BY text")
def drop_duplicates_first(t):
    return windows.keep_first(t.documents.select("doc_id", "text"), ["text"], [F.col("doc_id")])


@query("SELECT event_type, min(event_id) AS first_id FROM events GROUP BY event_type")
def unique_everseen(t):
    return t.events.groupBy("event_type").agg(F.min("event_id").alias("first_id"))


@query("SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey)::INT AS place FROM orders")
def sort_values(t):
    rows = t.orders.select("o_orderkey", "o_totalprice")
    return windows.ordered_rank(rows, [-F.floor(F.col("o_totalprice") / 1000)], [F.desc("o_totalprice"), F.col("o_orderkey")], "place")


@query("SELECT o_custkey, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS best FROM orders GROUP BY o_custkey")
def argmax(t):
    return t.orders.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_totalprice", -F.col("o_orderkey"))).alias("best"))


@query("SELECT l_suppkey, l_orderkey, l_linenumber, rank FROM (SELECT l_suppkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber)::INT AS rank FROM lineitem) WHERE rank <= 3")
def top_k(t):
    return windows.top_k(t.lineitem.select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice"), ["l_suppkey"], [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")], 3).drop("l_extendedprice")


@query("SELECT user_id, event_id, sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS total FROM (SELECT user_id, event_id, ts, round(value)::BIGINT AS value FROM events)".replace("sum(value)", "sum(value)::BIGINT").replace("sum(value)::BIGINT OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)", "(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))::BIGINT"))
def running_sum(t):
    rows = t.events.select("user_id", "event_id", "ts", F.round("value").cast("long").alias("value"))
    return rows.select("user_id", "event_id", windows.running_sum(F.col("value"), ["user_id"], ["ts", "event_id"]).alias("total"))


@query("SELECT user_id, min(event_id) AS first_id, count(*) AS n FROM (SELECT *, event_id - row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM events) GROUP BY user_id, run")
def consecutive_runs(t):
    rows = windows.consecutive_groups(t.events.select("user_id", "event_id"), "event_id", ["user_id"])
    return rows.groupBy("user_id", "run").agg(F.min("event_id").alias("first_id"), F.count("*").alias("n")).drop("run")


@query("SELECT o_custkey, o_orderkey, o_totalprice - lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS diff FROM orders")
def row_difference(t):
    return t.orders.select("o_custkey", "o_orderkey", windows.row_difference("o_totalprice", ["o_custkey"], ["o_orderkey"]).alias("diff"))


@query("SELECT d.doc_id, coalesce(quality, -1)::INT AS quality FROM documents d LEFT JOIN labels USING (doc_id) WHERE n_chars > 100")
def fill_missing(t):
    return t.documents.where("n_chars > 100").select("doc_id").join(t.labels.select("doc_id", "quality"), "doc_id", "left").na.fill({"quality": -1})


@query("SELECT d.doc_id, quality FROM documents d LEFT JOIN labels USING (doc_id) WHERE quality IS NOT NULL")
def drop_missing(t):
    joined = t.documents.select("doc_id").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    return joined.withColumn("empty", F.lit(None).cast("string")).transform(windows.drop_null_columns).na.drop(subset=["quality"])


@query("SELECT DISTINCT p_brand, p_brand IN (SELECT p_brand FROM part WHERE p_size < 5) AS in_a, p_brand IN (SELECT upper(p_brand) FROM part WHERE p_size > 45) AS in_b, NOT (p_brand IN (SELECT upper(p_brand) FROM part WHERE p_size > 45)) AND lower(p_brand) IN (SELECT lower(p_brand) FROM part WHERE p_size > 45) AS needs_normalizing FROM part")
def membership_audit(t):
    b = t.part.where("p_size > 45").select(F.upper("p_brand").alias("p_brand"))
    return matching.membership(t.part, t.part.where("p_size < 5"), b, "p_brand", F.lower)


@query("SELECT p_partkey, i::INT AS copy_no FROM part, range(1, 4) r(i)")
def n_copies(t):
    return matching.copies(t.part.select("p_partkey"), 3)


_RULES = ["ECONOMY", "BRASS", "STEEL$", "^STANDARD", "TIN"]


@query(f"SELECT p_partkey, (SELECT arg_min(r.p, r.o) FROM (SELECT unnest({sql_list(_RULES)}) AS p, generate_subscripts({sql_list(_RULES)}, 1) AS o) r WHERE regexp_matches(upper(p_type), r.p)) AS rule FROM part")
def first_rule(t):
    rules = t.spark.createDataFrame(list(enumerate(_RULES)), "ord int, pattern string").withColumn("name", F.col("pattern"))
    return matching.first_rule(t.part, F.upper("p_type"), rules, "p_partkey").select("p_partkey", "rule")


@query("SELECT a.conv_id, a.turn, count(*) AS n FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND contains(b.text, regexp_extract(a.text, '^[^ ]+', 0)) GROUP BY a.conv_id, a.turn")
def containment_join(t):
    a = t.conversations.select("conv_id", "turn", F.regexp_extract("text", "^[^ ]+", 0).alias("w"))
    b = t.conversations.select("conv_id", "text")
    return a.join(b, "conv_id").where(F.col("text").contains(F.col("w"))).groupBy("conv_id", "turn").agg(F.count("*").alias("n"))


@query("WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS r FROM documents), b AS (SELECT page_id, row_number() OVER (ORDER BY page_id) AS r FROM pages) SELECT doc_id, page_id FROM a JOIN b USING (r)")
def positional_zip(t):
    place = lambda df, key: windows.ordered_rank(df.select(key), [F.floor(F.col(key) / 1000)], [F.col(key)], "r")
    return place(t.documents, "doc_id").join(place(t.pages, "page_id"), "r").select("doc_id", "page_id")


_CELLS = "SELECT doc_id AS id, quality::VARCHAR AS prediction, toxic::VARCHAR AS validation FROM labels"
_UPDATES = "SELECT doc_id % 700 AS id, doc_id AS ord, CASE WHEN n_chars % 3 > 0 THEN lang END AS prediction, CASE WHEN n_chars % 2 = 0 THEN source END AS validation FROM documents"


def _cells(t):
    return t.labels.select(F.col("doc_id").alias("id"), F.col("quality").cast("string").alias("prediction"), F.col("toxic").cast("string").alias("validation"))


def _updates(t):
    return t.documents.select((F.col("doc_id") % 700).alias("id"), F.col("doc_id").alias("ord"), F.when(F.col("n_chars") % 3 > 0, F.col("lang")).alias("prediction"), F.when(F.col("n_chars") % 2 == 0, F.col("source")).alias("validation"))


@query(f"WITH c AS ({_CELLS}), u AS ({_UPDATES}), l AS (SELECT id, arg_max(prediction, ord) FILTER (prediction IS NOT NULL) AS p, arg_max(validation, ord) FILTER (validation IS NOT NULL) AS v FROM u GROUP BY id) SELECT coalesce(c.id, l.id) AS id, coalesce(p, prediction) AS prediction, coalesce(v, validation) AS validation FROM c FULL JOIN l ON c.id = l.id")
def store_merge(t):
    return store.merge(_cells(t), _updates(t), "id", ["prediction", "validation"], "ord")


@query(f"WITH c AS ({_CELLS}), u AS (SELECT id, arg_max(lang, ord) AS prediction FROM (SELECT doc_id % 700 AS id, doc_id AS ord, lang FROM documents) GROUP BY id) SELECT * FROM c UNION ALL SELECT id, prediction, NULL FROM u WHERE id NOT IN (SELECT id FROM c)")
def store_anti_insert(t):
    new = store.last_of_batch(t.documents.select((F.col("doc_id") % 700).alias("id"), F.col("doc_id").alias("ord"), F.col("lang").alias("prediction")), "id", "ord")
    return store.create(_cells(t), new.withColumn("validation", F.lit(None).cast("string")), "id")


@query(f"WITH c AS ({_CELLS}), n AS (SELECT doc_id AS id, lang AS prediction, source AS validation FROM documents) SELECT * FROM c WHERE id NOT IN (SELECT id FROM n) UNION ALL SELECT * FROM n")
def store_override(t):
    new = t.documents.select(F.col("doc_id").alias("id"), F.col("lang").alias("prediction"), F.col("source").alias("validation"))
    return store.create(_cells(t), new, "id", override=True)


@query(f"WITH c AS ({_CELLS}) SELECT id, coalesce(CASE WHEN d.n_chars % 2 = 0 THEN d.lang END, c.prediction) AS prediction, c.validation FROM c LEFT JOIN documents d ON d.doc_id = c.id")
def store_update(t):
    new = t.documents.select(F.col("doc_id").alias("id"), F.when(F.col("n_chars") % 2 == 0, F.col("lang")).alias("prediction"))
    return store.update(_cells(t), new, "id", ["prediction"])


@query(f"WITH c AS ({_CELLS}) SELECT * FROM c WHERE id NOT IN (SELECT page_id FROM pages)")
def store_delete(t):
    return store.delete(_cells(t), t.pages.select(F.col("page_id").alias("id")), "id")


@query("SELECT d.doc_id AS id, coalesce(l.quality::VARCHAR, d.lang) AS prediction FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def predict_cached(t):
    requests = t.documents.select(F.col("doc_id").alias("id"), "lang")
    return store.predict_cached(requests, _cells(t), "id", lambda df: df.withColumn("prediction", F.col("lang"))).select("id", "prediction")


@query(f"WITH c AS ({_CELLS}) SELECT d.doc_id AS id, c.validation FROM documents d LEFT JOIN c ON c.id = d.doc_id")
def validation_read(t):
    return store.read_validation(_cells(t), t.documents.select(F.col("doc_id").alias("id")), "id")


@query("SELECT d.conv_id AS document_id, (d.place - 1)::INT AS \"order\", d.role AS paragraph_id FROM (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS place FROM conversations) d")
def document_links(t):
    ids = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"])
    new = t.conversations.groupBy(F.col("conv_id").alias("id")).agg(F.min("role").alias("name"), ids.alias("paragraph_ids"))
    empty = t.spark.createDataFrame([], "id long, name string")
    links = t.spark.createDataFrame([], "document_id long, paragraph_id string, `order` int")
    return store.create_documents(empty, links, new)[1]


@query("WITH x AS (SELECT quality AS truth, (CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END)::INT AS pred FROM labels JOIN documents USING (doc_id)), c AS (SELECT DISTINCT unnest([truth, pred]) AS label FROM x), s AS (SELECT label, count(*) FILTER (truth = label) AS support, count(*) FILTER (pred = label) AS claimed, count(*) FILTER (truth = label AND pred = label) AS hits FROM c, x GROUP BY label), r AS (SELECT label, support::BIGINT AS support, CASE WHEN claimed > 0 THEN hits / claimed ELSE 0.0 END AS precision, CASE WHEN support > 0 THEN hits / support ELSE 0.0 END AS recall FROM s) SELECT label, support, round(precision, 9) AS precision, round(recall, 9) AS recall, round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END, 9) AS f1 FROM r")
def classification_report(t):
    out = aggregates.classification_report(_scored(t), "truth", "pred")
    return out.select("label", "support", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


def _scored(t):
    return t.labels.join(t.documents, "doc_id").select("doc_id", F.col("quality").alias("truth"), F.when(F.col("n_chars") > 1000, 1).otherwise(0).alias("pred"), F.least(F.col("n_chars") / 8192.0, F.lit(1.0)).alias("score"))


@query("WITH x AS (SELECT quality AS truth, (CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END)::INT AS predicted FROM labels JOIN documents USING (doc_id)) SELECT truth, predicted, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY truth) AS share FROM x GROUP BY truth, predicted")
def confusion_matrix(t):
    return aggregates.confusion(_scored(t), "truth", "pred", normalize=True)


@query("WITH x AS (SELECT quality AS truth, least(n_chars / 8192.0, 1.0) AS score FROM labels JOIN documents USING (doc_id)), g AS (SELECT i / 128.0 AS threshold FROM range(0, 129) r(i)), s AS (SELECT threshold, count(*) FILTER (score >= threshold) AS claimed, count(*) FILTER (score >= threshold AND truth = 1) AS hits, count(*) FILTER (truth = 1) AS truths FROM g, x GROUP BY threshold), r AS (SELECT threshold, CASE WHEN claimed > 0 THEN hits / claimed ELSE 0.0 END AS p, CASE WHEN truths > 0 THEN hits / truths ELSE 0.0 END AS r FROM s), w AS (SELECT threshold, round(p, 9) AS precision, round(r, 9) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 9) AS f1 FROM r) SELECT threshold::DOUBLE AS threshold, metric, value FROM (UNPIVOT w ON precision, recall, f1 INTO NAME metric VALUE value)")
def threshold_sweep(t):
    out = aggregates.threshold_sweep(_scored(t), "truth", "score", 128)
    return aggregates.melt(out.select("threshold", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")]), ["threshold"], ["precision", "recall", "f1"])


@query("SELECT role, avg((lower(w) = w)::INT) AS exact, avg(1) AS normalized, count(*) AS n FROM (SELECT role, regexp_extract(text, '^[A-Za-z]*', 0) AS w FROM conversations) GROUP BY role")
def match_rates(t):
    rows = t.conversations.select("role", F.regexp_extract("text", "^[A-Za-z]*", 0).alias("truth")).withColumn("pred", F.lower("truth"))
    return aggregates.match_rates(rows, "truth", "pred", ["role"])


@query("WITH x AS (SELECT doc_id, CASE WHEN quality = 1 AND toxic = 0 THEN 'clean' WHEN quality = 1 THEN 'toxic' WHEN toxic = 1 THEN 'both' ELSE 'poor' END AS kind FROM labels) SELECT kind, count(*) AS n FROM x GROUP BY kind")
def recategorize(t):
    kind = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "clean").when(F.col("quality") == 1, "toxic").when(F.col("toxic") == 1, "both").otherwise("poor")
    return t.labels.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT label, 1.0 / n AS weight FROM (SELECT quality AS label, count(*) AS n FROM labels GROUP BY 1)")
def sampling_weights(t):
    return t.labels.groupBy(F.col("quality").alias("label")).agg((1.0 / F.count("*")).alias("weight"))


_DRAWS = """
WITH n AS (SELECT quality, 1.0 / count(*) AS weight FROM labels GROUP BY quality),
w AS (SELECT doc_id, quality, weight::DOUBLE AS weight, md5(doc_id::VARCHAR) AS h FROM labels JOIN n USING (quality)),
b AS (SELECT *, ('0x' || substr(h, 1, 8))::BIGINT % 1024 AS bucket FROM w),
l AS (SELECT *, sum(weight) OVER (ORDER BY bucket, h, doc_id) AS high FROM b),
t AS (SELECT sum(weight) AS total FROM b),
d AS (SELECT i AS draw, ('0x' || substr(md5('7:' || i::VARCHAR), 1, 12))::BIGINT::DOUBLE / 281474976710656.0 * total AS place FROM range(0, 1000) r(i), t)
SELECT draw, doc_id, quality FROM d ASOF JOIN (SELECT *, high - weight AS low FROM l) x ON d.place >= x.low
"""


@query(_DRAWS)
def weighted_resample(t):
    weights = t.labels.join(sampling_weights(t).withColumnRenamed("label", "quality"), "quality")
    return matching.weighted_resample(weights, "weight", "doc_id", 1000).select("draw", "doc_id", "quality")


def _truth(t):
    from .labels import KEYS, tagged

    return labels.bio_entities(tagged(t), "tag", "token", KEYS, "tok_idx").select(F.concat_ws(":", *KEYS).alias("doc_id"), "first_pos", "last_pos", "label")


def _entity_sql() -> str:
    from .labels import ENTITIES

    return f"WITH {ENTITIES}, p AS (SELECT conv_id, turn, first_pos, last_pos, CASE WHEN last_pos % 5 = 0 THEN 'LOC' ELSE label END AS label FROM found), s AS (SELECT label, sum(t) AS support, sum(p) AS claimed, sum(t * p) AS hits FROM (SELECT coalesce(f.label, p.label) AS label, (f.label IS NOT NULL)::INT AS t, (p.label IS NOT NULL)::INT AS p FROM found f FULL JOIN p ON f.conv_id = p.conv_id AND f.turn = p.turn AND f.first_pos = p.first_pos AND f.last_pos = p.last_pos AND f.label = p.label) GROUP BY label), r AS (SELECT label, support::BIGINT AS support, CASE WHEN claimed > 0 THEN hits / claimed ELSE 0.0 END AS p, CASE WHEN support > 0 THEN hits / support ELSE 0.0 END AS r FROM s) SELECT label, support, round(p, 9) AS precision, round(r, 9) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 9) AS f1 FROM r"


@query(_entity_sql())
def entity_scores(t):
    truth = _truth(t)
    guess = truth.withColumn("label", F.when(F.col("last_pos") % 5 == 0, "LOC").otherwise(F.col("label")))
    out = aggregates.entity_scores(truth, guess)
    return out.select("label", "support", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query("SELECT c.conv_id, c.turn, c.role, r.n FROM conversations c LEFT JOIN (SELECT conv_id, turn, max(length(text)) AS n FROM conversations WHERE turn % 2 = 0 GROUP BY ALL) r ON r.conv_id = c.conv_id AND r.turn = c.turn")
def left_join_two_keys(t):
    right = t.conversations.where("turn % 2 = 0").select("conv_id", "turn", F.length("text").cast("long").alias("n"))
    return matching.left_with_metadata(t.conversations.select("conv_id", "turn", "role"), right, ["conv_id", "turn"], [F.desc("n")])


@query("SELECT l_orderkey, l_linenumber, l_suppkey, o_custkey FROM lineitem JOIN (SELECT o_orderkey, o_custkey, (1 + o_custkey % 3)::INT AS line FROM orders) ON l_orderkey = o_orderkey AND l_linenumber = line")
def inner_join_two_keys(t):
    line = (F.col("o_custkey") % 3 + 1).cast(t.lineitem.schema["l_linenumber"].dataType)
    right = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), line.alias("l_linenumber"), "o_custkey")
    return matching.inner_with_metadata(t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey"), right, ["l_orderkey", "l_linenumber"])


@query("SELECT a.doc_id AS copy_id, b.doc_id AS original_id FROM (SELECT doc_id, sha256(text || 'x') AS hash, sha256(text) AS original_hash FROM documents WHERE doc_id % 2 = 0) a JOIN (SELECT doc_id, sha256(text) AS hash FROM documents) b ON a.original_hash = b.hash")
def sample_lineage(t):
    """Augmented samples and the samples that they were made of."""
    originals = t.documents.select(F.col("doc_id").alias("original_id"), F.sha2("text", 256).alias("hash"))
    copies = t.documents.where("doc_id % 2 = 0").select(F.col("doc_id").alias("copy_id"), F.sha2(F.concat("text", F.lit("x")), 256).alias("hash"), F.sha2("text", 256).alias("original_hash"))
    return matching.lineage(copies, originals).select("copy_id", "original_id")


@query("SELECT 'head' AS part, o_orderkey FROM (SELECT o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 20) UNION ALL SELECT 'tail', o_orderkey FROM (SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 20) UNION ALL SELECT 'sample', o_orderkey FROM (SELECT o_orderkey FROM orders ORDER BY md5('42:' || o_orderkey::VARCHAR), o_orderkey LIMIT 50)")
def head_tail_sample(t):
    rows = t.orders.select("o_orderkey", "o_totalprice")
    parts = {"head": windows.first_rows(rows, [F.col("o_totalprice"), F.col("o_orderkey")], 20), "tail": windows.last_rows(rows, ["o_totalprice", "o_orderkey"], 20), "sample": windows.sample_rows(rows, "o_orderkey", 50)}
    head, tail, sample = (df.select(F.lit(name).alias("part"), "o_orderkey") for name, df in parts.items())
    return head.union(tail).union(sample)


@query(f"WITH c AS ({_CELLS}) SELECT * FROM c WHERE prediction = '1'")
def store_get(t):
    return store.get(_cells(t), "prediction", "1")


_DOCS = "SELECT DISTINCT conv_id AS id, 'conversation ' || conv_id AS name FROM conversations"


def _documents(t):
    ids = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"])
    new = t.conversations.groupBy(F.col("conv_id").alias("id")).agg(F.concat(F.lit("conversation "), F.first("conv_id").cast("string")).alias("name"), ids.alias("paragraph_ids"))
    kind = t.conversations.schema["conv_id"].dataType.simpleString()
    empty, links = t.spark.createDataFrame([], f"id {kind}, name string"), t.spark.createDataFrame([], f"document_id {kind}, paragraph_id string, `order` int")
    return store.create_documents(empty, links, new)


@query(f"SELECT id, CASE WHEN id % 3 = 0 THEN 'renamed' ELSE name END AS name, CASE WHEN id % 5 = 0 THEN 1 ELSE (SELECT count(*) FROM conversations WHERE conv_id = id) END AS n_links FROM ({_DOCS})")
def document_update(t):
    """Documents renamed, and some given a new list of paragraphs."""
    docs, links = _documents(t)
    changes = docs.select("id", F.when(F.col("id") % 3 == 0, "renamed").alias("name"), F.when(F.col("id") % 5 == 0, F.array(F.lit("only"))).alias("paragraph_ids")).where("name is not null or paragraph_ids is not null")
    docs, links = store.update_documents(docs, links, changes)
    return docs.join(links.groupBy(F.col("document_id").alias("id")).agg(F.count("*").alias("n_links")), "id").select("id", "name", "n_links")


@query("SELECT conv_id AS document_id, 'conversation ' || conv_id AS name, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) - 1)::INT AS \"order\", role AS paragraph_id, 'said by ' || role AS text FROM conversations")
def document_paragraphs(t):
    """Documents and paragraphs, many to many, read through the table of links."""
    docs, links = _documents(t)
    paragraphs = t.conversations.select(F.col("role").alias("id"), F.concat(F.lit("said by "), "role").alias("text")).distinct()
    return store.document_paragraphs(docs, links, paragraphs)


@query(f"WITH c AS (SELECT *, 'kept ' || id AS note FROM ({_CELLS})), u AS (SELECT id, arg_max(prediction, ord) FILTER (prediction IS NOT NULL) AS p FROM ({_UPDATES}) GROUP BY id) SELECT coalesce(c.id, u.id) AS id, coalesce(u.p, c.prediction) AS prediction, c.validation, c.note FROM c FULL JOIN u ON c.id = u.id")
def store_merge_columns(t):
    """Columns that an update doesn't name stay; a key that is updated several times stays one row."""
    table = _cells(t).withColumn("note", F.concat(F.lit("kept "), F.col("id").cast("string")))
    return store.merge(table, _updates(t), "id", ["prediction"], "ord")


@query(f"WITH c AS ({_CELLS}), u AS (SELECT id, arg_max(prediction, ord) FILTER (prediction IS NOT NULL) AS p FROM ({_UPDATES}) GROUP BY id) SELECT c.id, coalesce(u.p, c.prediction) AS prediction, c.validation FROM c LEFT JOIN u ON c.id = u.id")
def store_update_repeats(t):
    """Several updates of one key, the last non-null value counts."""
    return store.update(_cells(t), _updates(t), "id", ["prediction"], ordinal="ord")


@query(f"WITH c AS ({_CELLS}), u AS (SELECT id, arg_max(coalesce(prediction, 'none'), ord) AS p FROM ({_UPDATES}) GROUP BY id) SELECT * FROM c UNION ALL SELECT id, p, NULL FROM u WHERE id NOT IN (SELECT id FROM c)")
def store_create_repeats(t):
    """Several new rows of one key, the last one counts."""
    return store.create(_cells(t), _updates(t).select("id", "ord", F.coalesce("prediction", F.lit("none")).alias("prediction")), "id", ordinal="ord")


@query("WITH x AS (SELECT quality AS truth, (CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END)::INT AS pred FROM labels JOIN documents USING (doc_id)), c AS (SELECT DISTINCT unnest([truth, pred]) AS label FROM x), s AS (SELECT label, count(*) FILTER (truth = label) AS support, count(*) FILTER (pred = label) AS claimed, count(*) FILTER (truth = label AND pred = label) AS hits FROM c, x GROUP BY label), r AS (SELECT support, CASE WHEN claimed > 0 THEN hits / claimed ELSE 0.0 END AS p, CASE WHEN support > 0 THEN hits / support ELSE 0.0 END AS r FROM s) SELECT round(avg(p), 9) AS precision, round(avg(r), 9) AS recall, round(avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END), 9) AS f1, sum(support)::BIGINT AS support FROM r")
def macro_average(t):
    out = aggregates.macro_average(aggregates.classification_report(_scored(t), "truth", "pred"))
    return out.select(*[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")], "support")


@query("WITH x AS (SELECT quality AS truth, least(floor(n_chars / 8192.0 * 100), 100) AS step FROM labels JOIN documents USING (doc_id)), g AS (SELECT i AS k FROM range(0, 101) r(i)) SELECT k::INT AS step, round(coalesce(count(*) FILTER (truth = 1) / nullif(count(truth), 0), 0.0), 9) AS precision, round(count(*) FILTER (truth = 1) / (SELECT count(*) FROM x WHERE truth = 1), 9) AS recall FROM g LEFT JOIN x ON step >= k GROUP BY k")
def threshold_sweep_percent(t):
    """The sweep over hundredths."""
    out = aggregates.threshold_sweep(_scored(t), "truth", "score", 100)
    return out.select(F.round(F.col("threshold") * 100).cast("int").alias("step"), *[F.round(c, 9).alias(c) for c in ("precision", "recall")])


@query("WITH e AS (SELECT vec_id, unnest(range(0, 8)) AS i, embedding FROM embeddings), s AS (SELECT (vec_id + i) % 8 AS truth, embedding[8 * i + 1:8 * i + 8] AS v FROM e WHERE i % 3 > 0) SELECT round(avg((list_position(v, list_max(v)) - 1 = truth)::INT), 9) AS accuracy, count(*) AS n_tokens FROM s")
def token_accuracy(t):
    """Positions with tag -100 don't count; a prediction is the class of the largest score."""
    at = F.sequence(F.lit(0), F.lit(7))
    scores = F.transform(at, lambda i: F.slice("embedding", 8 * i + 1, 8))
    truth = F.transform(at, lambda i: F.when(i % 3 == 0, -100).otherwise((F.col("vec_id") + i) % 8).cast("int"))
    out = aggregates.token_accuracy(t.embeddings.select(scores.alias("scores"), truth.alias("truth")), "scores", "truth")
    return out.select(F.round("accuracy", 9).alias("accuracy"), "n_tokens")
