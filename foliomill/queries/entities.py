"""Entity extraction, rules and redaction over the driver's tables."""

from __future__ import annotations

import json
import re

import numpy as np
from pyspark.sql import functions as F

from ..functions import dates, rules, spans, text
from ..operators import alignment, models
from ..plans.pipeline import ANONYMIZE, EXTRACTORS, Training, annotations_to_predictions, extractor, line_extractor
from .registry import query, sql_list
from .text import LINES, PARAGRAPHS, fold_sql

_EVERY = "|".join(f"(?:{p})" for p in spans.SHAPES.values()).replace("'", "''")
_NAME = "CASE " + " ".join(f"WHEN regexp_full_match(hit, '{p.replace(chr(39), chr(39) * 2)}') THEN '{label}'" for label, p in spans.SHAPES.items()) + " END"
#: Spans of a source of (keys, text).
SPANS = f"""
cut AS (SELECT {{keys}}, text, regexp_extract_all(text, '{_EVERY}') AS hits, string_split_regex(text, '{_EVERY}') AS gaps FROM {{source}}),
each AS (SELECT {{keys}}, text, unnest(hits) AS hit, unnest(gaps[1:len(hits)]) AS gap, generate_subscripts(hits, 1) AS i FROM cut WHERE len(hits) > 0),
placed AS (SELECT {{keys}}, text, hit, i, (sum(length(gap) + length(hit)) OVER (PARTITION BY {{keys}} ORDER BY i))::INT AS end_char FROM each),
spans AS (SELECT {{keys}}, text, i, hit, (end_char - length(hit))::INT AS start_char, end_char, {_NAME} AS label FROM placed)
"""
#: Redacted text of spans: islands of equal labels at most one character apart.
REDACT = """
flag AS (SELECT *, CASE WHEN label = lag(label) OVER w AND start_char - lag(end_char) OVER w <= 1 THEN 0 ELSE 1 END AS fresh FROM spans WINDOW w AS (PARTITION BY {keys} ORDER BY i)),
isle AS (SELECT *, sum(fresh) OVER (PARTITION BY {keys} ORDER BY i) AS g FROM flag),
unified AS (SELECT {keys}, any_value(text) AS text, g, min(start_char) AS a, arg_max(end_char, i) AS b, any_value(label) AS label FROM isle GROUP BY {keys}, g),
pieces AS (SELECT *, substr(text, coalesce(lag(b) OVER w, 0) + 1, a - coalesce(lag(b) OVER w, 0)) || ' {left}' || label || '{right}' AS piece FROM unified WINDOW w AS (PARTITION BY {keys} ORDER BY g)),
joined AS (SELECT {keys}, string_agg(piece, '' ORDER BY g) || substr(any_value(text), max(b) + 1) AS raw FROM pieces GROUP BY {keys})
"""


def _sql(template: str, keys: str, source: str = "documents") -> str:
    return template.replace("{keys}", keys).replace("{source}", source)


@query(f"WITH {_sql(SPANS, 'doc_id')} SELECT doc_id, label, count(*) AS n FROM spans GROUP BY doc_id, label")
def pii_extract_counts(t):
    return t.documents.select("doc_id", F.explode(spans.extract_spans(F.col("text"))).alias("s")).groupBy("doc_id", F.col("s.label").alias("label")).agg(F.count("*").alias("n"))


@query(f"WITH {_sql(SPANS, 'doc_id')} SELECT doc_id, start_char, end_char, label, hit AS text FROM spans")
def entity_spans(t):
    each = t.documents.select("doc_id", "text", F.explode(spans.extract_spans(F.col("text"))).alias("s"))
    return each.select("doc_id", F.col("s.start").alias("start_char"), F.col("s.end").alias("end_char"), F.col("s.label").alias("label"), spans.span_text(F.col("text"), F.col("s")).alias("text"))


@query(f"WITH {_sql(SPANS, 'doc_id')}, {_sql(REDACT, 'doc_id').replace('{left}', '&lt;').replace('{right}', '&gt;')} SELECT doc_id, sha256(regexp_replace(regexp_replace(coalesce(raw, d.text), ' +', ' ', 'g'), '^\\s+|\\s+$', '', 'g')) AS digest FROM documents d LEFT JOIN joined USING (doc_id)")
def redact_text(t):
    return t.documents.select("doc_id", F.sha2(spans.redact(F.col("text"), spans.extract_spans(F.col("text"))), 256).alias("digest"))


@query(f"WITH {_sql(SPANS, 'doc_id')}, {_sql(REDACT, 'doc_id')} SELECT doc_id, a AS start_char, b AS end_char, label FROM unified")
def unify_labels(t):
    each = t.documents.select("doc_id", F.explode(spans.unify_spans(spans.extract_spans(F.col("text")))).alias("s"))
    return each.select("doc_id", F.col("s.start").alias("start_char"), F.col("s.end").alias("end_char"), F.col("s.label").alias("label"))


_PIPELINE_SQL = f"""
WITH {PARAGRAPHS}, tidy AS (SELECT doc_id, para_idx, regexp_replace(text, '[ \\t]+', ' ', 'g') AS text FROM paragraphs),
{_sql(SPANS, 'doc_id, para_idx', 'tidy').replace('spans AS (', 'found AS (')},
spans AS (SELECT doc_id, para_idx, text, i, start_char + length(regexp_extract(hit, '^[^\\p{{L}}\\p{{N}}_]+', 0)) AS start_char, end_char - length(regexp_extract(hit, '[^\\p{{L}}\\p{{N}}_]+$', 0)) AS end_char, label FROM found),
{_sql(REDACT, 'doc_id, para_idx').replace('{left}', '<').replace('{right}', '>')},
done AS (SELECT doc_id, p.para_idx, regexp_replace(regexp_replace(coalesce(raw, p.text), ' +', ' ', 'g'), '^\\s+|\\s+$', '', 'g') AS r, coalesce(n, 0) AS n FROM tidy p LEFT JOIN joined j USING (doc_id, para_idx) LEFT JOIN (SELECT doc_id, para_idx, count(*) AS n FROM spans GROUP BY ALL) c USING (doc_id, para_idx))
SELECT doc_id, string_agg(r, chr(10) ORDER BY para_idx) AS redacted, count(*) AS n_paragraphs, sum(n)::BIGINT AS n_entities FROM done GROUP BY doc_id
"""


@query(_PIPELINE_SQL)
def anonymize_documents(t):
    """The flagship: paragraphs, extraction, cleaning and redaction of every document."""
    rows = ANONYMIZE(t.documents.select("doc_id", "text"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("para_idx", "redacted"))), lambda x: x["redacted"]), "\n")
    return rows.groupBy("doc_id").agg(text.alias("redacted"), F.count("*").alias("n_paragraphs"), F.sum(F.size("entities").cast("long")).alias("n_entities"))


@query(r"WITH k AS (SELECT conv_id, turn, unnest(regexp_extract_all(text, '\S+')) AS w, generate_subscripts(regexp_extract_all(text, '\S+'), 1) AS i FROM conversations) SELECT conv_id, turn, i::INT AS pos, regexp_replace(w, '^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$', '', 'g') AS alt_text, (i + length(regexp_extract(w, '^[^\p{L}\p{N}_]+', 0)))::INT AS alt_start_char FROM k")
def entity_clean(t):
    k = t.conversations.select("conv_id", "turn", F.posexplode(F.filter(F.split("text", r"\s+"), lambda x: x != "")).alias("p", "w"))
    alt = spans.clean_entity(F.col("w"), F.col("p") + 1)
    return k.select("conv_id", "turn", (F.col("p") + 1).alias("pos"), alt["alt_text"].alias("alt_text"), alt["alt_start_char"].alias("alt_start_char"))


@query(f"WITH {_sql(SPANS, 'doc_id')} SELECT doc_id, count(*) AS n FROM spans WHERE label IN ('IP', 'TELEFONO') GROUP BY doc_id")
def entity_filter(t):
    kept = text.filter_entities(spans.extract_spans(F.col("text")), enable=["IP", "TELEFONO"])
    return t.documents.select("doc_id", F.size(kept).cast("long").alias("n")).where("n > 0")


@query(f"WITH {_sql(SPANS, 'doc_id')} SELECT doc_id, start_char, substr(text, greatest(start_char - 10, 0) + 1, start_char - greatest(start_char - 10, 0)) AS pre, substr(text, end_char + 1, 10) AS post FROM spans")
def entity_context(t):
    each = t.documents.select("doc_id", "text", F.explode(spans.extract_spans(F.col("text"))).alias("s"))
    c = spans.char_context(F.col("text"), F.col("s.start"), F.col("s.end"))
    return each.select("doc_id", F.col("s.start").alias("start_char"), c["pre"].alias("pre"), c["post"].alias("post"))


@query(f"WITH {_sql(SPANS, 'doc_id')} SELECT doc_id FROM spans GROUP BY doc_id HAVING bool_or(label = 'CORREO_ELECTRONICO')")
def has_label(t):
    return t.documents.where(text.has_label(spans.extract_spans(F.col("text")), "CORREO_ELECTRONICO")).select("doc_id")


_RULINGS = ["No hacer lugar al pedido", "hacer lugar a la excepcion", "RECHAZAR el planteo", "se rechaza lo pedido", "declarar inadmisible el recurso", "no admitir la prueba", "fijar audiencia"]
_PICK = "{}[1 + (o_orderkey % {})]"


def _pick(values):
    return F.get(F.array(*map(F.lit, values)), F.col("o_orderkey") % len(values))


@query(f"SELECT o_orderkey, CASE WHEN regexp_matches({sql_list(_RULINGS)}[1 + (o_orderkey % 7)], '{rules.REFUSAL}') THEN 'no_hace_lugar' ELSE 'hace_lugar' END AS subclass FROM orders")
def decision_subcategory(t):
    return t.orders.select("o_orderkey", rules.decision_subclass(_pick(_RULINGS)).alias("subclass"))


@query(f"WITH d AS (SELECT o_orderkey, {sql_list(_RULINGS)}[1 + (o_orderkey % 7)] AS x, (o_orderkey % 100) / 100.0 AS p FROM orders) SELECT o_orderkey, CASE WHEN p > 0.88 THEN 1 ELSE 0 END::INT AS n, CASE WHEN p > 0.88 THEN length(x)::INT END AS end_char FROM d")
def decision_gate(t):
    made = rules.decide(F.array().cast(rules_entities()), _pick(_RULINGS), (F.col("o_orderkey") % 100) / 100.0)
    return t.orders.select("o_orderkey", F.size(made).alias("n"), F.get(made, 0)["end_char"].alias("end_char"))


def rules_entities() -> str:
    from ..schema import ENTITIES

    return ENTITIES


_ENTITIES = [
    ("VIOLENCIA_DE_GENERO", "violencia física y psicológica"), ("GENERO", "Mujer cis"), ("GENERO", "no-binaria"), ("TIPO_DE_RESOLUCION", "Interlocutoria"),
    ("VIOLENCIA_DE_GENERO", "económica, social"), ("PERSONA_ACUSADA_NO_DETERMINADA", "usuario de Facebook y gmail"), ("NOMBRE", "Lic. Pérez"), ("OTRO", "mujer cis"),
    ("PERSONA_ACUSADA_NO_DETERMINADA", "la firma sociedad anonima demandada"),
]
_FREE = ("VIOLENCIA_DE_GENERO", "GENERO", "TIPO_DE_RESOLUCION", "PERSONA_ACUSADA_NO_DETERMINADA", "NOMBRE")


def _subcategory_sql() -> str:
    normal = rf"regexp_replace({fold_sql('lower({})')}, '[_\-,.;:]+', '', 'g')"
    whens = []
    for name in _FREE:
        x = "around" if name in rules.WITH_CONTEXT else "plain"
        found = ", ".join(f"CASE WHEN regexp_matches({x}, '{p}') THEN '{k}' END" for k, p in rules.CATEGORIES[name].items())
        whens.append(f"WHEN '{name}' THEN array_to_string(list_sort(list_filter([{found}], lambda v: v IS NOT NULL)), ',')")
    return f"""WITH e AS (SELECT o_orderkey, {sql_list([x[0] for x in _ENTITIES])}[1 + (o_orderkey % 9)] AS label, {sql_list([x[1] for x in _ENTITIES])}[1 + (o_orderkey % 9)] AS text FROM orders),
n AS (SELECT o_orderkey, label, {normal.replace('{}', 'text')} AS plain, {normal.replace('{}', "'la jueza ' || text || ' dijo'")} AS around FROM e)
SELECT o_orderkey, label, coalesce(CASE label {' '.join(whens)} END, '') AS subclass FROM n"""


@query(_subcategory_sql())
def regex_subcategory(t):
    label, text = _pick([x[0] for x in _ENTITIES]), _pick([x[1] for x in _ENTITIES])
    made = rules.regex_subcategory(label, text, F.array().cast("array<string>"), F.lit("la jueza"), F.lit("dijo"))
    return t.orders.select("o_orderkey", label.alias("label"), F.array_join(made, ",").alias("subclass"))


_RELATIONS = [("RELACION_Y_TIPO_ENTRE_ACUSADO/A_Y_DENUNCIANTE", x) for x in ("ex pareja", "pareja de la madre", "es su vecino", "hijo", "exnuera", "compañero de trabajo")] + [("NIVEL_INSTRUCCION", x) for x in ("estudios secundarios completos", "primario incompleto", "cursa el universitario", "sin estudios")] + [("MODALIDAD_DE_LA_VIOLENCIA", x) for x in ("doméstica", "laboral y mediática", "pública")]


@query()
def relation_subcategory(t):
    """The categories whose patterns look around, which the SQL engine can't."""
    label, text = _pick([x[0] for x in _RELATIONS]), _pick([x[1] for x in _RELATIONS])
    return t.orders.select("o_orderkey", label.alias("label"), F.array_join(rules.regex_subcategory(label, text, F.lit(None).cast("array<string>")), ",").alias("subclass"))


_TEXTS = [a.replace(" inc ", " inc. ").replace(" parr ", " parrafo ") for a, _ in rules.ARTICLES] + [*rules.BY_CONDUCT, "art. 7", "9 bis"]


def _direct_sql() -> str:
    n = len(_TEXTS)
    normal = rf"regexp_replace({fold_sql('lower(x)')}, '[_\-,.;:]+', '', 'g')"
    whens = " ".join(f"WHEN regexp_matches(a, '{rules.article_pattern(a)}') THEN '{law}'" for a, law in rules.ARTICLES)
    return f"WITH e AS (SELECT o_orderkey, {sql_list(_TEXTS)}[1 + (o_orderkey % {n})] AS x FROM orders), n AS (SELECT o_orderkey, {normal} AS a FROM e) SELECT o_orderkey, CASE {whens} END AS law FROM n"


@query(_direct_sql())
def article_direct_map(t):
    return t.orders.select("o_orderkey", rules.direct_law(_pick(_TEXTS)).alias("law"))


_CONDUCTS = sorted({c for laws in rules.BY_CONDUCT.values() for c in laws})


def _indirect_sql() -> str:
    whens = " ".join(f"WHEN regexp_matches(a, '{a}\\b') AND list_contains(c, '{c}') THEN '{law}'" for a, laws in rules.BY_CONDUCT.items() for c, law in laws.items())
    return f"WITH n AS (SELECT o_orderkey, {sql_list(rules.BY_CONDUCT)}[1 + (o_orderkey % {len(rules.BY_CONDUCT)})] AS a, [{sql_list(_CONDUCTS)}[1 + (o_orderkey // 3 % {len(_CONDUCTS)})], 'lesiones'] AS c FROM orders) SELECT o_orderkey, CASE {whens} END AS law FROM n"


@query(_indirect_sql())
def article_indirect_map(t):
    conducts = F.array(F.get(F.array(*map(F.lit, _CONDUCTS)), F.floor(F.col("o_orderkey") / 3) % len(_CONDUCTS)), F.lit("lesiones"))
    return t.orders.select("o_orderkey", rules.indirect_law(_pick(list(rules.BY_CONDUCT)), conducts).alias("law"))


_LAWS = [*rules.SUBJECTS, "ley_0"]


@query("SELECT o_orderkey, CASE WHEN l IN ('codigo_contravencional') THEN 'contravencional' WHEN l = 'ley_1217' THEN 'ejecucion_de_multa' WHEN l = 'ley_23098' THEN 'habeas_corpus' WHEN l = 'ley_451' THEN 'faltas' WHEN l <> 'ley_0' THEN 'penal' END AS subject FROM (SELECT o_orderkey, " + sql_list(_LAWS) + f"[1 + (o_orderkey % {len(_LAWS)})] AS l FROM orders)")
def subject_map(t):
    return t.orders.select("o_orderkey", rules.subject(_pick(_LAWS)).alias("subject"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN CASE WHEN day(o_orderdate) > 9 AND month(o_orderdate) > 9 THEN d || ',' || d ELSE d END WHEN 3 THEN '' ELSE d END AS dates FROM (SELECT *, strftime(o_orderdate, '%d/%m/%Y') AS d FROM orders)""")
def date_suggestions(t):
    day, month, year = F.dayofmonth("o_orderdate"), F.month("o_orderdate"), F.year("o_orderdate")
    name = F.get(F.array(*map(F.lit, dates.MONTHS)), month - 1)
    texts = F.array(F.concat(F.lit("el "), F.concat_ws("/", day, month, year)), F.format_string("dia %d de %s de %d", day, name, year), F.format_string("%d de %s del %d.", day, F.upper(name), year), F.lit("sin fecha"))
    return t.orders.select("o_orderkey", F.array_join(dates.date_suggestions(F.get(texts, F.col("o_orderkey") % 4)), ",").alias("dates"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN h || ':' || m || ',' || h || ':' || m WHEN 1 THEN h || ':' || m || ',' || h || ':' || m ELSE '' END AS times FROM (SELECT event_id, strftime(ts, '%H') AS h, strftime(ts, '%M') AS m FROM events)")
def time_suggestions(t):
    h, m = F.date_format("ts", "HH"), F.date_format("ts", "mm")
    texts = F.array(F.concat(h, F.lit(":"), m, F.lit(" horas")), F.concat(h, F.lit("."), m, F.lit(" hs.")), F.lit("sin hora"))
    return t.events.select("event_id", F.array_join(dates.time_suggestions(F.get(texts, F.col("event_id") % 3)), ",").alias("times"))


@query("SELECT doc_id, 'a,b' AS keys, length(text)::INT AS n FROM documents")
def spans_map(t):
    one = F.array(F.struct(F.lit(0).alias("start"), F.length("text").alias("end")))
    kept = F.create_map(F.lit("a"), one, F.lit("b"), F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"))))
    made = spans.set_spans(kept, "b", one)
    return t.documents.select("doc_id", F.array_join(F.array_sort(F.map_keys(made)), ",").alias("keys"), F.get(made["b"], 0)["end"].alias("n"))


def _article_sql() -> str:
    direct = _direct_sql().split("SELECT o_orderkey, CASE ", 1)[1].rsplit(" AS law", 1)[0]
    whens = " ".join(f"WHEN regexp_matches(a, '{a}\\b') AND list_contains(c, '{c}') THEN '{law}'" for a, laws in rules.BY_CONDUCT.items() for c, law in laws.items())
    return _direct_sql().split("SELECT o_orderkey, CASE ", 1)[0] + f", k AS (SELECT *, ['homicidio', 'lesiones', 'cuida_coche'] AS c FROM n) SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN coalesce(CASE {direct}, CASE {whens} END) END AS law FROM k"


@query(_article_sql())
def article_subcategory(t):
    """The law of an article entity; other labels get none."""
    conducts = F.array(F.lit("homicidio"), F.lit("lesiones"), F.lit("cuida_coche"))
    label = F.when(F.col("o_orderkey") % 2 == 0, "ART_INFRINGIDO").otherwise("OTRO")
    made = rules.article_subclass(label, _pick(_TEXTS), F.lit(None).cast("array<string>"), conducts)
    return t.orders.select("o_orderkey", F.get(made, 0).alias("law"))


@query(f"WITH {_sql(SPANS, 'doc_id')}, {_sql(REDACT, 'doc_id').replace('{left}', '<').replace('{right}', '>')} SELECT doc_id, sha256(regexp_replace(regexp_replace(coalesce(raw, d.text), ' +', ' ', 'g'), '^\\s+|\\s+$', '', 'g')) AS digest FROM documents d LEFT JOIN joined USING (doc_id)")
def unescape_redacted(t):
    """Labels as text files have them, from the escaped form."""
    redacted = spans.redact(F.col("text"), spans.extract_spans(F.col("text")))
    return t.documents.select("doc_id", F.sha2(spans.unescape_labels(redacted), 256).alias("digest"))


_ENTITY_OF = "struct<label:string,text:string>"


@query(r"SELECT conv_id, turn, len(list_filter(regexp_extract_all(text, '\S+'), lambda w: NOT regexp_matches(w, '^[!-/:-@\[-`{-~]*$')))::INT AS kept, len(regexp_extract_all(text, '\S+'))::INT AS every FROM (SELECT conv_id, turn, text || ' -- . (x) !?' AS text FROM conversations)")
def punctuation_filter(t):
    words = text.whitespace_tokens(F.concat("text", F.lit(" -- . (x) !?")))
    made = F.transform(words, lambda w: F.struct(F.lit("X").alias("label"), w.alias("text")).cast(_ENTITY_OF))
    return t.conversations.select("conv_id", "turn", F.size(text.drop_punctuation(made)).alias("kept"), F.size(text.drop_punctuation(made, legacy=True)).alias("every"))


class NumberTagger:
    """An extractor of whole-number tokens, as a model that reads one line would be."""

    def predict(self, texts: list[str]) -> list[list[dict]]:
        out = []
        for line in texts:
            words = list(re.finditer(r"\S+", line))
            out.append([{"start": i, "end": i + 1, "label": "NUM", "text": m.group(), "start_char": m.start(), "end_char": m.end(), "subclass": [], "method": "tagger", "score": 1.0} for i, m in enumerate(words) if m.group().isascii() and m.group().isdigit()])
        return out


EXTRACTORS.setdefault("numbers", NumberTagger)

_WORDS_SQL = rf"""
w AS (SELECT doc_id, i, x, base, regexp_extract_all(x, '\S+') AS ws, string_split_regex(x, '\S+') AS gaps FROM (SELECT doc_id, i, x, coalesce(sum(length(x) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM ({LINES}))),
k AS (SELECT doc_id, i, base, ws, unnest(ws) AS word, unnest(gaps[1:len(ws)]) AS gap, generate_subscripts(ws, 1) AS p FROM w WHERE len(ws) > 0),
placed AS (SELECT *, sum(length(gap) + length(word)) OVER (PARTITION BY doc_id, i ORDER BY p) AS stop FROM k)
SELECT doc_id, (p - 1)::INT AS "start", (base + stop - length(word))::INT AS start_char, (base + stop)::INT AS end_char, word AS text, array_to_string(ws[greatest(p - 10, 1):p - 1], ' ') AS context_pre, array_to_string(ws[p + 1:p + 10], ' ') AS context_post FROM placed WHERE regexp_full_match(word, '[0-9]+')
"""


def _entities(df):
    return df.select("doc_id", F.explode("entities").alias("e")).select("doc_id", "e.start", "e.start_char", "e.end_char", "e.text", "e.context_pre", "e.context_post")


@query(f"WITH {_WORDS_SQL}")
def extractor_lines(t):
    """A line model over documents: offsets in the whole text, ten tokens of the line around."""
    return _entities(line_extractor(t.documents.select("doc_id", "text"), "numbers"))


@query("SELECT doc_id, len(list_filter(regexp_extract_all(text, '\\S+'), lambda w: regexp_full_match(w, '[0-9]+')))::INT AS n FROM documents")
def extractor_batch(t):
    """A model over whole texts, each distinct one predicted once; annotations then stand in for predictions."""
    found = extractor(t.documents.select("doc_id", "text"), "numbers")
    told = annotations_to_predictions(found.withColumnRenamed("entities", "annotations"))
    return told.select("doc_id", F.size("entities").alias("n"))


def _conv() -> models.ConvClassifier:
    one = lambda *shape: np.ones(shape)
    embedding = np.array([[((7 * i) % 13 - 6) / 6.0] for i in range(11)])
    return models.ConvClassifier(embedding, (one(1, 1, 3), np.zeros(1)), (one(1, 1, 1), np.zeros(1)), (np.array([[0.0], [1.0]]), np.zeros(2)))


@query("WITH x AS (SELECT conv_id, turn, list_concat(list_transform(regexp_extract_all(text, '\\S+')[1:128], lambda w: length(w) % 11), list_transform(range(greatest(0, 128 - len(regexp_extract_all(text, '\\S+')))), lambda i: 0)) AS ids FROM conversations), e AS (SELECT conv_id, turn, list_concat(list_concat([0.0], list_transform(ids, lambda i: ((7 * i) % 13 - 6) / 6.0)), [0.0]) AS v FROM x) SELECT conv_id, turn, round(1 / (1 + exp(-greatest(0, list_max(list_transform(range(2, 130), lambda i: v[i - 1] + v[i] + v[i + 1]))))), 6) AS probability FROM e")
def conv_scores(t):
    """The forward pass of a small convolutional classifier over token ids."""
    ids = F.transform(F.slice(text.whitespace_tokens(F.col("text")), 1, 128), lambda w: F.length(w) % 11)
    padded = F.concat(ids, F.array_repeat(F.lit(0), 128 - F.size(ids)))
    made = models.score(t.conversations.select("conv_id", "turn", padded.alias("ids")), _conv())
    return made.select("conv_id", "turn", F.round("probability", 6).alias("probability"))


def _encoder():
    return lambda texts: np.array([[float(len(x)), float(x.count("e")), float(x.count(" "))] for x in texts])


@query("SELECT p_partkey AS option_id, length(p_name)::DOUBLE AS chars, (length(p_name) - length(replace(p_name, 'e', '')))::DOUBLE AS es, (length(x) - length(replace(x, ' ', '')))::DOUBLE AS blanks FROM (SELECT p_partkey, p_name, replace(p_name, '_', ' ') AS x FROM part)")
def option_vectors(t):
    """Options encoded by name, each distinct text once."""
    made = models.build_options(t.part.select(F.col("p_partkey").alias("option_id"), F.col("p_name").alias("name")), _encoder)
    return made.select("option_id", *[F.get("embedding", i).alias(n) for i, n in enumerate(("chars", "es", "blanks"))])


class MeanLength:
    """A model of one number, fitted on Spark."""

    def __init__(self, mean: float = 0.0):
        self.mean = mean

    def fit(self, df) -> None:
        self.mean = df.agg(F.avg(F.length("text"))).first()[0] or 0.0

    def dumps(self) -> bytes:
        return json.dumps(self.mean).encode()

    @classmethod
    def loads(cls, content: bytes):
        return cls(json.loads(content))


@query("SELECT 'documents' AS name, round(avg(length(text)), 6) AS mean FROM documents")
def model_round_trip(t):
    """A model fitted, saved and loaded again."""
    from .files import work_folder

    folder = work_folder(t.spark)
    Training({"documents": MeanLength()}).fit(t.documents).save(t.spark, folder)
    loaded = Training.load(t.spark, folder, {"documents": MeanLength}).models
    return t.spark.createDataFrame([(n, round(m.mean, 6)) for n, m in loaded.items()], "name string, mean double")


@query()
def token_targets(t):
    """What stands for each token in the redacted text."""
    rows = t.conversations.select(F.xxhash64("conv_id", "turn", "text").alias("k"), "text").dropDuplicates(["k"])
    tokens = rows.select("k", F.posexplode(text.whitespace_tokens(F.col("text"))).alias("tok_idx", "token"))
    redacted = rows.select("k", spans.redact(F.col("text"), spans.extract_spans(F.col("text")), escape=False).alias("text"))
    return alignment.place_targets(tokens, redacted, ["k"])
