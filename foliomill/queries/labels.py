"""Token labels over conversations, turned into token tables by rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import explode_paragraphs, whitespace_tokens
from ..operators import alignment, labels, matching
from ..operators.windows import with_island
from ..sources.annotations import conll_text, pair_text
from .registry import query, sql_list, sql_map
from .text import PARAGRAPHS

_RULE = "CASE WHEN regexp_matches(token, '[0-9]') THEN 'NUM' WHEN regexp_matches(token, '^[A-Z]') THEN 'PER' WHEN regexp_matches(token, '^(of|in|the)$') THEN 'LOC' END"
TOKENS = f"""
tokens AS (SELECT conv_id, turn, token, tok_idx, {_RULE} AS label FROM (SELECT conv_id, turn, unnest(regexp_extract_all(text, '\\S+')) AS token, (generate_subscripts(regexp_extract_all(text, '\\S+'), 1) - 1)::INT AS tok_idx FROM conversations))
"""
BIO = f"""{TOKENS},
tags AS (SELECT *, CASE WHEN NOT bool_or(label IS NOT NULL) OVER (PARTITION BY conv_id, turn) THEN NULL WHEN label IS NULL THEN 'O' WHEN label = lag(label) OVER w THEN 'I-' || label ELSE 'B-' || label END AS tag FROM tokens WINDOW w AS (PARTITION BY conv_id, turn ORDER BY tok_idx))
"""
ENTITIES = f"""{BIO},
ids AS (SELECT *, sum((tag LIKE 'B-%')::INT) OVER (PARTITION BY conv_id, turn ORDER BY tok_idx) AS entity_id FROM tags),
found AS (SELECT conv_id, turn, entity_id::BIGINT AS entity_id, arg_min(regexp_replace(tag, '^[BI]-', ''), tok_idx) AS label, min(tok_idx) AS first_pos, max(tok_idx) AS last_pos, string_agg(token, ' ' ORDER BY tok_idx) AS text FROM ids WHERE tag <> 'O' GROUP BY conv_id, turn, entity_id)
"""
KEYS = ["conv_id", "turn"]


def token_table(t):
    k = t.conversations.select(*KEYS, F.posexplode(F.filter(F.split("text", r"\s+"), lambda x: x != "")).alias("tok_idx", "token"))
    label = F.when(F.col("token").rlike("[0-9]"), "NUM").when(F.col("token").rlike("^[A-Z]"), "PER").when(F.col("token").rlike("^(of|in|the)$"), "LOC")
    return k.withColumn("label", label)


def tagged(t):
    return labels.bio_encode(token_table(t), "label", KEYS, ["tok_idx"])


@query(f"WITH {BIO} SELECT conv_id, turn, tok_idx, tag FROM tags")
def bio_encode(t):
    return tagged(t).select(*KEYS, "tok_idx", "tag")


@query(f"WITH {BIO} SELECT regexp_replace(tag, '^[BI]-', '') AS label, count(*) AS n FROM tags GROUP BY 1")
def bio_decode(t):
    return tagged(t).groupBy(labels.bio_strip(F.col("tag")).alias("label")).agg(F.count("*").alias("n"))


@query(f"WITH {ENTITIES} SELECT * FROM found")
def bio_spans(t):
    return labels.bio_entities(tagged(t), "tag", "token", KEYS, "tok_idx")


_RAW = ["B-NUM_", "I-NUM_", "NUM_", "B-DOMINIO_PATENTE", "B-HECHO", "NUM_DOMINIO", "O"]
_AROUND = ["<NUM_EXPEDIENTE>", "<DNI>", "CUIJ", "x", "CAUSA"]


@query(f"""WITH e AS (SELECT o_orderkey, {sql_list(_RAW)}[1 + (o_orderkey % 7)] AS l, {sql_list(_AROUND)}[1 + (o_orderkey % 5)] AS a FROM orders),
m AS (SELECT o_orderkey, CASE WHEN regexp_matches(l, 'NUM_$') THEN regexp_replace(l, 'NUM_$', '') || CASE WHEN regexp_matches(a, 'EXPEDIENTE|CAUSA') THEN 'NUM_EXPEDIENTE' WHEN contains(a, 'DNI') THEN 'DNI' WHEN contains(a, 'CUIJ') THEN 'CUIJ' ELSE 'NUM' END ELSE l END AS l FROM e)
SELECT o_orderkey, regexp_replace(replace(replace(l, 'DOMINIO_PATENTE', 'PATENTE_DOMINIO'), 'NUM_DOMINIO', 'PATENTE_DOMINIO'), '[BI]-HECHO', 'FECHA') AS label FROM m""")
def number_labels(t):
    pick = lambda v: F.get(F.array(*map(F.lit, v)), F.col("o_orderkey") % len(v))
    return t.orders.select("o_orderkey", labels.number_labels(pick(_RAW), pick(_AROUND)).alias("label"))


_NAMES = [*labels.CANONICAL, "PER", "OTRO"]


@query(f"WITH e AS (SELECT o_orderkey, {sql_list(_NAMES)}[1 + (o_orderkey % {len(_NAMES)})] AS l FROM orders) SELECT o_orderkey, coalesce(map_extract({sql_map(labels.CANONICAL)}, l)[1], l) AS label, map_extract({sql_map(labels.CANONICAL)}, l)[1] AS joined FROM e")
def label_mapping(t):
    raw = t.orders.select("o_orderkey", F.get(F.array(*map(F.lit, _NAMES)), F.col("o_orderkey") % len(_NAMES)).alias("label"))
    table = t.spark.createDataFrame(sorted(labels.CANONICAL.items()), "raw string, canonical string")
    joined = labels.map_labels(raw.withColumn("plain", F.col("label")), table)
    return joined.select("o_orderkey", labels.canonical(F.col("plain")).alias("label"), F.col("label").alias("joined"))


@query("WITH e AS (SELECT p_partkey, list_distinct(regexp_extract_all(regexp_replace(p_name || ' <PER>' || p_type || p_brand, '[^0-9A-Za-z_]', '', 'g'), 'PER|STEEL|BRASS|ECONOMY')) AS f FROM part) SELECT p_partkey, CASE WHEN len(f) = 1 THEN f[1] END AS label FROM e")
def single_label(t):
    c = F.concat("p_name", F.lit(" <PER>"), "p_type", "p_brand")
    return t.part.select("p_partkey", labels.single_label(c, ["PER", "STEEL", "BRASS", "ECONOMY"]).alias("label"))


@query(f"WITH {TOKENS} SELECT conv_id, turn, tok_idx FROM tokens WHERE (conv_id, turn) NOT IN (SELECT (conv_id, turn) FROM tokens WHERE token LIKE '%@%')")
def drop_bad_paragraphs(t):
    return labels.drop_bad_paragraphs(token_table(t), F.col("token").contains("@"), KEYS).select(*KEYS, "tok_idx")


_CODES = labels.label_codes(["PER", "NUM", "LOC"])
_SQL_CODES = "MAP {" + ", ".join(f"'{k}': {v}" for k, v in _CODES.items()) + "}"
SAMPLES = f"""{BIO}, samples AS (SELECT conv_id, turn, list(token ORDER BY tok_idx) AS tokens, list(map_extract({_SQL_CODES}, tag)[1] ORDER BY tok_idx) AS tags FROM tags GROUP BY conv_id, turn HAVING bool_and(tag IS NOT NULL))"""


@query(f"WITH {SAMPLES} SELECT conv_id, turn, len(list_filter(tags, lambda x: x > 0))::INT AS n_labels, array_to_string(tags, ' ') AS codes, sha256(array_to_string(tokens, ' ')) AS hash FROM samples")
def samples(t):
    s = labels.to_samples(tagged(t), _CODES, KEYS)
    return s.select(*KEYS, "n_labels", F.array_join(F.transform("tags", lambda x: x.cast("string")), " ").alias("codes"), "hash")


@query(f"WITH {BIO} SELECT conv_id, turn, tok_idx, token, tag FROM tags WHERE tag IS NOT NULL")
def sample_round_trip(t):
    return labels.from_samples(labels.to_samples(tagged(t), _CODES, KEYS), _CODES, KEYS)


@query(f"WITH {SAMPLES}, e AS (SELECT unnest(tags) AS code FROM samples) SELECT code, count(*) AS n FROM e WHERE code > 0 GROUP BY code")
def tag_counts(t):
    return labels.to_samples(tagged(t), _CODES, KEYS).select(F.explode("tags").alias("code")).where("code > 0").groupBy("code").agg(F.count("*").alias("n"))


@query(f"WITH {TOKENS}, r AS (SELECT *, coalesce(label, 'O') AS l FROM tokens), f AS (SELECT *, CASE WHEN l = lag(l) OVER w THEN 0 ELSE 1 END AS fresh FROM r WINDOW w AS (PARTITION BY conv_id, turn ORDER BY tok_idx)), g AS (SELECT *, sum(fresh) OVER (PARTITION BY conv_id, turn ORDER BY tok_idx) AS island FROM f) SELECT conv_id, turn, island::BIGINT AS island, any_value(l) AS label, count(*) AS n FROM g GROUP BY conv_id, turn, island")
def label_runs(t):
    rows = with_island(token_table(t).withColumn("label", F.coalesce("label", F.lit("O"))), "label", KEYS, ["tok_idx"])
    return rows.groupBy(*KEYS, "island").agg(F.first("label").alias("label"), F.count("*").alias("n"))


@query(f"WITH {BIO} SELECT conv_id, turn, '-DOCSTART- -X- O' || chr(10) || string_agg(token || ' -X- _ ' || coalesce(tag, 'O'), chr(10) ORDER BY tok_idx) || chr(10) AS raw FROM tags GROUP BY conv_id, turn")
def conll_render(t):
    rows = tagged(t).select(*KEYS, "tok_idx", "token", F.coalesce("tag", F.lit("O")).alias("label"))
    return conll_text(rows, KEYS)


@query(f"WITH {BIO} SELECT conv_id, turn, string_agg(token || ' ' || coalesce(tag, 'O'), chr(10) ORDER BY tok_idx) AS raw FROM tags GROUP BY conv_id, turn")
def pair_render(t):
    return pair_text(tagged(t).select(*KEYS, "tok_idx", "token", F.coalesce("tag", F.lit("O")).alias("label")), KEYS)


@query("SELECT c.conv_id, c.turn, coalesce(bool_or(contains(d.text, c.sentence)), false) AS decision, coalesce(arg_min(CASE WHEN contains(d.text, c.sentence) THEN d.role END, CASE WHEN contains(d.text, c.sentence) THEN d.turn END) = 'user', false) AS hace_lugar FROM (SELECT conv_id, turn, regexp_extract(text, '^[^.]*', 0) AS sentence FROM conversations) c LEFT JOIN conversations d ON d.conv_id = c.conv_id GROUP BY c.conv_id, c.turn, c.sentence")
def sentence_decisions(t):
    sentences = t.conversations.select(*KEYS, F.regexp_extract("text", "^[^.]*", 0).alias("sentence"))
    decisions = t.conversations.select("conv_id", "text", F.col("turn").alias("ord"), F.when(F.col("role") == "user", "hace_lugar").otherwise("otra").alias("subclass"))
    return labels.sentence_decisions(sentences, decisions, "conv_id").drop("sentence")


_FLAGS = ["True", "true", "1", "False", "0", "si"]


@query(f"SELECT o_orderkey, CASE WHEN {sql_list(_FLAGS)}[1 + (o_orderkey % 6)] IN ('True', 'true', '1') THEN 1 ELSE 0 END::INT AS category FROM orders")
def decision_category(t):
    return t.orders.select("o_orderkey", labels.decision_category(F.get(F.array(*map(F.lit, _FLAGS)), F.col("o_orderkey") % 6)).alias("category"))


@query(f"WITH {ENTITIES} SELECT label, count(DISTINCT lower(text)) AS n_texts FROM found GROUP BY label")
def option_audit(t):
    found = labels.bio_entities(tagged(t), "tag", "token", KEYS, "tok_idx")
    return matching.option_audit(found, "label", F.lower("text")).select("label", "n_texts")


_PARA_TOKENS = f"{PARAGRAPHS}, pt AS (SELECT doc_id, para_idx, unnest(regexp_extract_all(text, '\\S+')) AS token, (generate_subscripts(regexp_extract_all(text, '\\S+'), 1) - 1)::INT AS tok_idx FROM paragraphs)"
_LINES_OF = f"""{_PARA_TOKENS},
r AS (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY para_idx, tok_idx) + dense_rank() OVER (PARTITION BY doc_id ORDER BY para_idx) - 2)::INT AS line FROM pt),
lines AS (SELECT doc_id, line, token FROM r UNION ALL SELECT doc_id, line - 1, '' FROM r WHERE tok_idx = 0 AND line > 0)"""


def paragraph_tokens(t):
    rows = explode_paragraphs(t.documents)
    return rows.select("doc_id", "para_idx", F.posexplode(whitespace_tokens(F.col("text"))).alias("tok_idx", "token")).withColumn("label", F.lit("O"))


@query(f"WITH {_LINES_OF} SELECT * FROM lines")
def separator_rows(t):
    """Token tables with an empty row between paragraphs."""
    return alignment.with_separators(paragraph_tokens(t), ["doc_id"], "para_idx").select("doc_id", "line", "token")


@query(f"WITH {_PARA_TOKENS} SELECT doc_id, (dense_rank() OVER (PARTITION BY doc_id ORDER BY para_idx) - 1)::INT AS para_idx, tok_idx, token FROM pt")
def separator_round_trip(t):
    """Paragraphs found again from the empty rows."""
    rows = alignment.with_separators(paragraph_tokens(t), ["doc_id"], "para_idx")
    return alignment.from_separators(rows, ["doc_id"]).select("doc_id", "para_idx", "tok_idx", "token")


@query(f"WITH {_PARA_TOKENS}, bad AS (SELECT doc_id, para_idx, bool_or(contains(token, 'q')) AS b FROM pt GROUP BY ALL) SELECT doc_id, count(*) AS n FROM pt JOIN bad USING (doc_id, para_idx) WHERE NOT b GROUP BY doc_id")
def drop_ambiguous_rows(t):
    """Without the paragraphs, between empty rows, that hold a bad token."""
    rows = alignment.with_separators(paragraph_tokens(t), ["doc_id"], "para_idx")
    kept = alignment.drop_ambiguous(rows, F.col("token").contains("q"), ["doc_id"]).where("token <> ''")
    return kept.groupBy("doc_id").agg(F.count("*").alias("n"))
