"""Sources, alignment, augmentation, identifiers and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import spans, structs
from ..functions.normalize import enforce_fields, normalize_headers
from ..functions.udf import content_uuid
from ..operators import alignment, augment, labels, matching
from ..operators.windows import running_sum
from ..plans.pipeline import infer_distinct
from ..sources import annotations, pdf, tables
from ..streaming.paragraphs import event_counts
from .registry import query
from .text import LINES, PARAGRAPHS

#: Lines of documents set on pages of forty, with uneven gaps.
BLOCKS = f"""
blocks AS (SELECT doc_id, ((i - 1) // 40)::INT AS page, (i - 1)::INT AS block_no, 20.0 * ((i - 1) % 40) + (i * i) % 7 AS y0, 20.0 * ((i - 1) % 40) + (i * i) % 7 + 12 + i % 5 AS y1, x AS text FROM ({LINES})),
gaps AS (SELECT doc_id, y0 - lag(y1) OVER (PARTITION BY doc_id, page ORDER BY y0, block_no) AS gap FROM blocks),
margins AS (SELECT doc_id, coalesce(median(CASE WHEN gap > 0 THEN gap END), 0.0)::DOUBLE AS margin FROM gaps GROUP BY doc_id)
"""
MERGED = f"""{BLOCKS},
f AS (SELECT b.*, CASE WHEN lag(y1) OVER w IS NULL OR lag(page) OVER w <> page OR y0 - lag(y1) OVER w > ceil(margin) THEN 1 ELSE 0 END AS fresh FROM blocks b JOIN margins USING (doc_id) WINDOW w AS (PARTITION BY doc_id ORDER BY page, y0, block_no)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY page, y0, block_no) - 1 AS para_idx FROM f),
merged AS (SELECT doc_id, para_idx::BIGINT AS para_idx, string_agg(text, ' ' ORDER BY page, y0, block_no) AS text FROM g GROUP BY doc_id, para_idx)
"""


def blocks(t):
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "text")).withColumn("i", F.col("k") + 1)
    y0 = 20.0 * (F.col("k") % 40) + (F.col("i") * F.col("i")) % 7
    return lines.select("doc_id", F.floor(F.col("k") / 40).cast("int").alias("page"), F.col("k").alias("block_no"), y0.alias("y0"), (y0 + 12 + F.col("i") % 5).alias("y1"), "text")


@query(f"WITH {BLOCKS} SELECT * FROM margins")
def pdf_margin_median(t):
    return pdf.margins(blocks(t))


@query(f"WITH {MERGED} SELECT * FROM merged")
def pdf_paragraph_merge(t):
    return pdf.paragraphs(blocks(t))


@query(f"WITH {MERGED} SELECT doc_id, sha256(string_agg(text, chr(10) || chr(10) ORDER BY para_idx)) AS digest FROM merged GROUP BY doc_id")
def pdf_text(t):
    return pdf.to_text(blocks(t)).select("doc_id", F.sha2("text", 256).alias("digest"))


@query(r"WITH p AS (SELECT page_id, '/data/' || (2000 + page_id % 24) || '/fallos/A' || page_id || '_' || (page_id * 7) || ' ' || 'TOMO' || page_id % 40 || '_x.docx' AS path FROM pages), f AS (SELECT page_id, path, regexp_extract(path, '([^/]*)$', 1) AS base FROM p), n AS (SELECT *, regexp_replace(base, '\.[^.]*$', '') AS doc_name FROM f) SELECT page_id, doc_name, regexp_extract(base, '(\.[^.]*)$', 1) AS doc_extension, regexp_extract(path, '/([0-9]{4})/', 1) AS year, (page_id * 7)::VARCHAR AS nro_registro, (page_id % 40)::VARCHAR AS tomo FROM n")
def file_metadata(t):
    path = F.concat(F.lit("/data/"), 2000 + F.col("page_id") % 24, F.lit("/fallos/A"), "page_id", F.lit("_"), F.col("page_id") * 7, F.lit(" TOMO"), F.col("page_id") % 40, F.lit("_x.docx"))
    return tables.with_file_metadata(t.pages.select("page_id", path.alias("path"))).drop("path")


@query("SELECT array_to_string(list_sort(list(DISTINCT lang)), ',') AS lang, array_to_string(list_sort(list(DISTINCT source)), ',') AS source FROM documents")
def validation_fields(t):
    made = tables.validation_fields(t.documents.select("lang", "source", F.lit(None).cast("string").alias("empty")))
    return made.select(*[F.array_join(c, ",").alias(c) for c in made.columns])


@query("SELECT o_orderkey, o_orderkey::VARCHAR AS nro_registro, (o_orderkey % 9)::INT AS tomo, CASE o_orderkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS v_fisica, CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE 'penal' END AS materia FROM orders")
def enforce_types(t):
    flag = F.get(F.array(F.lit("si"), F.lit("no"), F.lit("s/d")), F.col("o_orderkey") % 3)
    raw = t.orders.select("o_orderkey", F.col("o_orderkey").cast("string").alias(" NRO_Registro "), (F.col("o_orderkey") % 9).cast("string").alias("Tomo"), flag.alias("V_Fisica"), F.when(F.col("o_orderkey") % 2 == 0, "no_corresponde").otherwise("penal").alias("materia"))
    return enforce_fields(normalize_headers(raw), {"o_orderkey": "long", "nro_registro": "string", "tomo": "int", "v_fisica": "boolean", "materia": "string"})


@query("SELECT doc_id, '{\"text\":' || to_json(text) || ',\"meta_info\":{\"path\":\"' || source || '\"}}' AS task FROM documents")
def export_tasks(t):
    return t.documents.select("doc_id", annotations.export_task(F.col("text"), F.col("source")).alias("task"))


@query(f"WITH {PARAGRAPHS}, w AS (SELECT doc_id, para_idx, len(regexp_extract_all(text, '\\S+')) AS n FROM paragraphs) SELECT doc_id, para_idx, coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY para_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first_token, n AS n_tokens FROM w")
def paragraph_token_ranges(t):
    """Where the tokens of each paragraph lie among its document's."""
    from ..functions.text import explode_paragraphs, whitespace_tokens

    rows = explode_paragraphs(t.documents).withColumn("n_tokens", F.size(whitespace_tokens(F.col("text"))).cast("long"))
    return rows.select("doc_id", "para_idx", running_sum(F.col("n_tokens"), ["doc_id"], ["para_idx"], inclusive=False).alias("first_token"), "n_tokens")


@query(f"WITH {PARAGRAPHS} SELECT doc_id, sum(len(regexp_extract_all(text, '\\S+')))::BIGINT AS n_placed FROM paragraphs GROUP BY doc_id HAVING n_placed > 0")
def token_placement(t):
    from ..functions.text import explode_paragraphs, whitespace_tokens

    rows = explode_paragraphs(t.documents)
    lines = rows.select("doc_id", F.col("para_idx").alias("line_idx"), F.size(whitespace_tokens(F.col("text"))).alias("n_tokens"))
    tokens = rows.select("doc_id", "para_idx", F.posexplode(whitespace_tokens(F.col("text"))).alias("k", "token"))
    tokens = tokens.withColumn("tok_idx", running_sum(F.lit(1), ["doc_id"], ["para_idx", "k"]) - 1).drop("para_idx")
    return alignment.place_tokens(tokens, lines).groupBy("doc_id").agg(F.count("*").alias("n_placed"))


@query()
def content_ids(t):
    """Identifiers of texts, each distinct text hashed once."""
    ids = infer_distinct(t.documents.select("doc_id", "text"), "text", lambda df: df.withColumn("paragraph_id", content_uuid("text")))
    return ids.select("doc_id", "paragraph_id")


@query("SELECT doc_id, sha256('v1' || chr(1) || '{\"lang\":' || to_json(lang) || ',\"text\":' || to_json(text) || '}') AS cache_key FROM documents")
def cache_keys(t):
    return t.documents.select("doc_id", structs.cache_key("v1", "lang", "text").alias("cache_key"))


@query()
def align_redacted(t):
    """Share of tokens that redaction leaves alone, by alignment."""
    pairs = t.conversations.select(F.xxhash64("conv_id", "turn").alias("pair_id"), F.col("text").alias("source_text"), spans.redact(F.col("text"), spans.extract_spans(F.col("text")), escape=False).alias("target_text"))
    return alignment.alignment_score(alignment.align(pairs))


@query()
def align_documents(t):
    pairs = t.documents.select(F.col("doc_id").alias("pair_id"), F.col("text").alias("source_text"), F.regexp_replace("text", "[0-9]+", "#").alias("target_text"))
    return alignment.alignment_score(alignment.align(pairs, by_document=True))


@query()
def augment_samples(t):
    from .labels import KEYS, tagged

    rows = tagged(t).where("tag is not null").groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("tok_idx", "token", "tag"))).alias("x"))
    rows = rows.select(F.transform("x", lambda x: x["token"]).alias("tokens"), F.transform("x", lambda x: x["tag"]).alias("tags"))
    return augment.augment(rows.withColumn("hash", F.sha2(F.array_join("tokens", " "), 256)), 2).select("original_hash", "copy_no", "n_labels", "hash")


@query("WITH x AS (SELECT conv_id, turn, regexp_extract_all(text, '\\S+') AS w FROM conversations), f AS (SELECT conv_id, turn, (i - 1) // 3 AS fragment_index, i, w[i] AS target FROM (SELECT conv_id, turn, w, unnest(range(1, len(w) + 1)) AS i FROM x)) SELECT conv_id::VARCHAR AS xml_file, turn AS paragraph_index, fragment_index, string_agg(target, ' ' ORDER BY i) AS target, min(i) - 1 AS start, max(i) - 1 AS \"end\" FROM f GROUP BY ALL")
def aggregate_fragments(t):
    k = t.conversations.select(F.col("conv_id").cast("string").alias("xml_file"), F.col("turn").alias("paragraph_index"), F.posexplode(F.filter(F.split("text", r"\s+"), lambda x: x != "")).alias("p", "target"))
    p = F.col("p").cast("long")
    rows = k.select("xml_file", "paragraph_index", F.floor(p / 3).alias("fragment_index"), p.alias("tok_idx"), "target", p.alias("start"), p.alias("end"))
    return matching.aggregate_fragments(rows)


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_windows(t):
    """The streaming aggregate, run over the whole table as a batch."""
    return event_counts(t.events).select(F.col("window.start").alias("day"), "event_type", "n")


@query("SELECT 'O' AS tag, 0::INT AS code UNION ALL SELECT p || l, (2 * i - CASE p WHEN 'B-' THEN 1 ELSE 0 END)::INT FROM (SELECT event_type AS l, row_number() OVER (ORDER BY event_type) AS i FROM (SELECT DISTINCT event_type FROM events)), (VALUES ('B-'), ('I-')) v(p)")
def label_codes(t):
    return labels.code_table(t.events.select(F.col("event_type").alias("label")))


@query("SELECT o_orderkey, '\"' || o_orderkey || '\"|' || o_custkey || '|\"' || o_orderkey || 'x\"' AS found FROM orders")
def nested_values(t):
    """All values of a field, at any depth of a JSON text."""
    raw = F.to_json(F.struct(F.col("o_orderkey").cast("string").alias("k"), F.array(F.struct(F.lit(1).alias("a"), F.struct(F.col("o_custkey").alias("k")).alias("b")), F.struct(F.lit(2).alias("a"), F.lit(None).alias("b"))).alias("list"), F.struct(F.concat(F.col("o_orderkey").cast("string"), F.lit("x")).alias("k")).alias("last")))
    return t.orders.select("o_orderkey", F.array_join(structs.values_of(raw, "k"), "|").alias("found"))


@query("SELECT o_orderkey, o_custkey AS a_b_c, o_totalprice::DOUBLE AS a_d, 'key:' || o_custkey || ',' || o_totalprice::DOUBLE::VARCHAR AS leaves FROM (SELECT o_orderkey, o_custkey, floor(o_totalprice)::BIGINT + 0.5 AS o_totalprice FROM orders)")
def flat_values(t):
    """Nested fields as columns, and as dotted paths of a JSON text."""
    price = (F.floor("o_totalprice") + 0.5).cast("double")
    df = t.orders.select("o_orderkey", F.struct(F.struct(F.col("o_custkey").alias("c")).alias("b"), price.alias("d")).alias("a"))
    leaves = structs.flatten_json(F.to_json("a"))
    flat = structs.flatten_structs(df).join(df.select("o_orderkey", F.concat(F.lit("key:"), leaves["b.c"], F.lit(","), leaves["d"]).alias("leaves")), "o_orderkey")
    return flat.select("o_orderkey", "a_b_c", "a_d", "leaves")


@query("SELECT o_orderkey, '{\"__type__\": \"datetime.date\", \"args\": [' || year(o_orderdate) || ', ' || month(o_orderdate) || ', ' || day(o_orderdate) || ']}' AS encoded, o_orderdate::DATE AS decoded FROM orders")
def typed_json(t):
    """Dates in JSON that carry their type, and back."""

    @F.pandas_udf("string")
    def encoded(days):
        return days.map(lambda d: None if d is None else structs.encode(d))

    @F.pandas_udf("date")
    def decoded(raw):
        return raw.map(lambda x: None if x is None else structs.decode(x))

    made = t.orders.select("o_orderkey", encoded(F.to_date("o_orderdate")).alias("encoded"))
    return made.select("o_orderkey", "encoded", decoded("encoded").alias("decoded"))


@query("SELECT doc_id, len(string_split(text, chr(10)))::INT + 2 AS n, (length(text) - len(string_split(text, chr(10))) + 1 + 2)::BIGINT AS chars FROM documents")
def collapsed_lists(t):
    """Lists of lists of lists as one list."""
    nested = F.array(F.array(F.split("text", "\n"), F.lit(None).cast("array<string>")), F.array(F.array(F.lit("x"), F.lit("y"))))
    one = structs.collapse_lists(nested, 2)
    return t.documents.select("doc_id", one.alias("one")).select("doc_id", F.size("one").alias("n"), F.aggregate("one", F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("chars"))
