"""Normalisation, paragraphs, tokens and predicates over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, normalize, text
from ..operators.windows import blank_repeats
from .registry import query, sql_list, sql_map

_FOLD = "t"
for _sign, _out in normalize.FOLD_LONG.items():
    _FOLD = f"replace({_FOLD}, '{_sign}', '{_out}')"
_FOLD = f"translate({_FOLD}, '{''.join(k for k in normalize.FOLD_MARKS)}', '{''.join(v.replace(chr(39), chr(39) * 2) for v in normalize.FOLD_MARKS.values())}')"


def fold_sql(expr: str) -> str:
    """ASCII folding for DuckDB."""
    return f"regexp_replace(strip_accents({_FOLD.replace('(t,', f'({expr},', 1)}), '[^\\x00-\\x7F]', '', 'g')"


LINES = "SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents"
PARAGRAPHS = rf"""
l AS ({LINES}),
c AS (SELECT doc_id, i, regexp_replace(regexp_replace(x, '^\s+|\s+$', '', 'g'), '\s{{2,}}', ' ', 'g') AS t FROM l),
n AS (SELECT *, lag(t) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM c WHERE t <> ''),
paragraphs AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS para_idx, t AS text FROM n WHERE p IS NULL OR p <> t)
"""


@query(f"WITH {PARAGRAPHS} SELECT * FROM paragraphs")
def paragraph_split(t):
    return text.explode_paragraphs(t.documents)


@query(f"WITH l AS ({LINES}), n AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS c FROM l) SELECT doc_id, count(*)::INT AS n_lines, sum(length(x))::BIGINT AS n_chars FROM n WHERE NOT (i = c AND x = '') GROUP BY doc_id")
def split_lines(t):
    lines = text.split_lines(F.col("text"))
    return t.documents.select("doc_id", lines.alias("lines")).select("doc_id", F.size("lines").alias("n_lines"), F.aggregate("lines", F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("n_chars")).where("n_lines > 0")


@query(f"WITH l AS ({LINES}), n AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS c FROM l) SELECT doc_id, (i - 1)::INT AS line_idx, coalesce(sum(length(x) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS start_char FROM n WHERE NOT (i = c AND x = '')")
def line_offsets(t):
    lines = t.documents.select("doc_id", text.split_lines(F.col("text")).alias("lines"))
    return lines.select("doc_id", F.posexplode(text.line_offsets(F.col("lines"))).alias("line_idx", "start_char"))


@query("SELECT conv_id, turn, CASE WHEN role IS NOT DISTINCT FROM lag(role) OVER w AND row_number() OVER w > 1 THEN '' ELSE role END AS role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, text)")
def justseen_dedup(t):
    return t.conversations.select("conv_id", "turn", blank_repeats("role", ["conv_id"], ["turn", "text"]).alias("role"))


def _hashed(df, key, c):
    return df.select(key, F.sha2(c, 256).alias("digest"))


_STEPS = "text"
for _p, _o in ((" {2,}", " "), (r"\n([a-z0-9;:,\.])", r" \1"), (r'([\p{L}\p{N}_,"-])\n', r"\1 "), (r"\n{2,}", "\n"), ("-{2,}", "-"), (r"\.-", ".")):
    _o = "chr(10)" if _o == "\n" else f"'{_o}'"
    _STEPS = f"regexp_replace({_STEPS}, '{_p}', {_o}, 'g')"


@query(rf"SELECT doc_id, sha256(replace(regexp_replace({_STEPS}, '[“”]', chr(34), 'g'), '\/', '/')) AS digest FROM documents")
def normalize_document(t):
    return _hashed(t.documents, "doc_id", normalize.document_normalize(F.col("text")))


@query(r"SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(text, '[\t\x{00A0}]+', ' ', 'g'), '[ \t\x0b\f]+', ' ', 'g'), '\n+', chr(10), 'g')) AS digest FROM documents")
def normalize_whitespace(t):
    return _hashed(t.documents, "doc_id", normalize.whitespace_normalize(F.col("text")))


@query(f"SELECT doc_id, sha256({fold_sql('text')}) AS digest FROM documents")
def accent_fold(t):
    return _hashed(t.documents, "doc_id", normalize.fold_accents(F.col("text")))


@query(rf"SELECT doc_id, sha256(regexp_replace({fold_sql('lower(text)')}, '[_\-,.;:]+', '', 'g')) AS digest FROM documents")
def subcategory_normalize(t):
    return _hashed(t.documents, "doc_id", normalize.subcategory_normalize(F.col("text")))


@query(f"SELECT doc_id, sha256(regexp_replace({fold_sql('text')}, '[^0-9A-Za-z_]', '', 'g')) AS digest FROM documents")
def label_normalize(t):
    return _hashed(t.documents, "doc_id", normalize.label_normalize(F.col("text")))


@query(rf"SELECT doc_id, sha256(regexp_replace({fold_sql('lower(text)')}, '[^0-9a-z\s]', '', 'g')) AS digest FROM documents")
def retrieval_normalize(t):
    return _hashed(t.documents, "doc_id", normalize.retrieval_normalize(F.col("text")))


@query(r"SELECT conv_id, turn, lower(replace(trim(regexp_replace(translate(text, 'áéíóúàèìòùÁÉÍÓÚÀÈÌÒÙ', 'aeiouaeiouAEIOUAEIOU'), '[_\s]+', ' ', 'g')), ' ', '_')) AS value FROM conversations")
def value_normalize(t):
    return t.conversations.select("conv_id", "turn", normalize.value_normalize(F.col("text")).alias("value"))


@query(r"SELECT page_id, sha256(regexp_replace(html, '(<[\p{L}\p{N}_]+>)([^\s])', '\1 \2', 'g')) AS digest FROM pages")
def split_glued_labels(t):
    return _hashed(t.pages, "page_id", normalize.split_glued_labels(F.col("html")))


@query(r"SELECT page_id, replace(replace(url, '/', '\/'), '\/', '/') AS url FROM pages")
def unescape_slashes(t):
    return t.pages.select("page_id", normalize.unescape_slashes(F.replace("url", F.lit("/"), F.lit("\\/"))).alias("url"))


@query("SELECT c_custkey, lower(c_name) AS low, upper(c_name) AS up, upper(substr(c_name, 1, 1)) || lower(substr(c_name, 2)) AS capital, c_name AS same, list_reduce(list_transform(string_split(c_mktsegment || ' of ' || c_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), lambda a, b: a || ' ' || b) AS title FROM customer")
def case_formats(t):
    f = lambda n: normalize.case_format(F.col("c_name"), n)
    return t.customer.select("c_custkey", f("lower").alias("low"), f("upper").alias("up"), f("capitalize").alias("capital"), f("identity").alias("same"), normalize.case_format(F.concat_ws(" of ", "c_mktsegment", "c_name"), "title").alias("title"))


@query("SELECT page_id, replace(replace(url, 'http://', 'https://'), '.example.', '.invalid.') AS url FROM pages")
def path_rewrite(t):
    return t.pages.select("page_id", normalize.path_rewrite(F.col("url"), [("http://", "https://"), (".example.", ".invalid.")]).alias("url"))


_CELLS = ["si", "no", "s/d", "no_corresponde", "no corresponde", "sin frases", "penal"]


@query(f"WITH c AS (SELECT o_orderkey, {sql_list(_CELLS)}[1 + (o_orderkey % {len(_CELLS)})] AS v FROM orders) SELECT o_orderkey, CASE WHEN v IN ('no_corresponde', 'no corresponde', 's/d', 'sin frases') THEN NULL ELSE v END AS value, CASE v WHEN 'si' THEN true WHEN 'no' THEN false END AS flag FROM c")
def null_bool_recode(t):
    v = F.get(F.array(*map(F.lit, _CELLS)), F.col("o_orderkey") % len(_CELLS))
    return t.orders.select("o_orderkey", normalize.null_recode(v).alias("value"), normalize.bool_recode(v).alias("flag"))


@query("WITH d AS (SELECT o_orderkey, day(o_orderdate) + CASE WHEN o_orderkey % 7 = 0 THEN 20 ELSE 0 END AS d, month(o_orderdate) AS m, year(o_orderdate) AS y FROM orders) SELECT o_orderkey, CASE WHEN d <= 31 THEN strftime(try_cast(printf('%04d-%02d-%02d', y, m, d) AS DATE), '%Y/%m/%d') END AS parsed FROM d")
def date_parse_dmy(t):
    day = F.dayofmonth("o_orderdate") + F.when(F.col("o_orderkey") % 7 == 0, 20).otherwise(0)
    year = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yy")).otherwise(F.date_format("o_orderdate", "yyyy"))
    value = F.concat_ws("_", day, F.month("o_orderdate"), year)
    return t.orders.select("o_orderkey", dates.format_dmy(value).alias("parsed"))


@query(r"SELECT doc_id, len(regexp_extract_all(text, '\S+'))::INT AS n_tokens FROM documents")
def whitespace_tokens(t):
    return t.documents.select("doc_id", F.size(text.whitespace_tokens(F.col("text"))).alias("n_tokens"))


_PIECES = {k: "\x01".join(v) for k, v in text.exception_pieces().items()}
TOKENS_SQL = rf"flatten(list_transform(regexp_extract_all({{}}, '\S+'), lambda w: CASE WHEN map_contains({sql_map(_PIECES)}, w) THEN string_split(map_extract({sql_map(_PIECES)}, w)[1], chr(1)) ELSE regexp_extract_all(w, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s]') END))"
_TOKENS = TOKENS_SQL.replace("{}", "text").replace("{{", "{").replace("}}", "}")


@query(f"SELECT doc_id, len(k)::INT AS n_tokens, sha256(array_to_string(k, chr(1))) AS digest FROM (SELECT doc_id, {_TOKENS} AS k FROM documents)")
def spanish_tokens(t):
    k = t.documents.select("doc_id", text.spanish_tokens(F.col("text")).alias("k"))
    return k.select("doc_id", F.size("k").alias("n_tokens"), F.sha2(F.array_join("k", "\x01"), 256).alias("digest"))


_VOCAB = {w: i + 2 for i, w in enumerate("the of and in . , de la le der die".split())}


@query(f"SELECT doc_id, array_to_string(list_transform(range(1, 129), lambda i: CASE WHEN i > len(k) THEN 0 WHEN map_contains({'MAP {' + ', '.join(f'{chr(39)}{k}{chr(39)}: {v}' for k, v in _VOCAB.items()) + '}'}, k[i]) THEN map_extract({'MAP {' + ', '.join(f'{chr(39)}{k}{chr(39)}: {v}' for k, v in _VOCAB.items()) + '}'}, k[i])[1] ELSE 1 END), ' ') AS ids FROM (SELECT doc_id, {TOKENS_SQL.replace('{}', fold_sql('lower(text)')).replace('{{', '{').replace('}}', '}')} AS k FROM documents)")
def decision_ids(t):
    return t.documents.select("doc_id", F.array_join(F.transform(text.decision_ids(F.col("text"), _VOCAB, unknown=1), lambda x: x.cast("string")), " ").alias("ids"))


@query(rf"""SELECT doc_id, len(list_filter(regexp_extract_all(text, '\S+'), lambda w: regexp_matches(regexp_replace(regexp_replace(w, '^[+\-±~]', ''), '[,.]', '', 'g'), '^\p{{Nd}}+$') OR regexp_matches(regexp_replace(w, '^[+\-±~]', ''), '^\p{{Nd}}+/\p{{Nd}}+$') OR list_contains({sql_list(text.NUMBER_WORDS)}, lower(regexp_replace(w, '^[+\-±~]', '')))))::INT AS n_numbers FROM documents""")
def like_num(t):
    return t.documents.select("doc_id", F.size(F.filter(text.whitespace_tokens(F.col("text")), text.like_num)).alias("n_numbers"))


_STOP = "the of and in to a is that it on de la le les des der die das und el los en".split()


@query(rf"SELECT doc_id, len(list_filter(regexp_extract_all(text, '\S+'), lambda w: NOT list_contains({sql_list(_STOP)}, lower(w))))::INT AS n_tokens FROM documents")
def stop_words(t):
    return t.documents.select("doc_id", F.size(text.without_stop_words(text.whitespace_tokens(F.col("text")), _STOP)).alias("n_tokens"))


@query(r"WITH k AS (SELECT unnest(regexp_extract_all(text, '\S+')) AS token FROM conversations), c AS (SELECT token, count(*) AS n FROM k GROUP BY token) SELECT token, n, row_number() OVER (ORDER BY n DESC, token)::INT AS token_id FROM c")
def vocabulary(t):
    return text.vocabulary(t.conversations.select(F.explode(text.whitespace_tokens(F.col("text"))).alias("token")))


@query(r"WITH k AS (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM conversations) SELECT conv_id, turn, count(*) AS n_near FROM k WHERE levenshtein(w, 'ontion') <= 2 GROUP BY conv_id, turn")
def fuzzy_tokens(t):
    k = t.conversations.select("conv_id", "turn", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("w"))
    return k.where(F.levenshtein("w", F.lit("ontion")) <= 2).groupBy("conv_id", "turn").agg(F.count("*").alias("n_near"))


@query()
def fuzzy_keyword(t):
    return t.conversations.where(text.fuzzy_contains(F.col("text"), "oneation")).select("conv_id", "turn")


@query(r"SELECT page_id, regexp_matches(url, '(http(s)?:\/\/.)(www\.)?[-a-zA-Z0-9@:%._\+~#=]{2,256}\.[a-z]{2,6}\b([-a-zA-Z0-9@:%_\+.~#?&//=]*)') AS is_url FROM pages")
def url_predicate(t):
    return t.pages.select("page_id", text.is_url(F.col("url")).alias("is_url"))


_GLUED = ["<PER>|<LOC>", "<PER>", "nada", "<A>|B>|", "x<DNI>|y"]


@query(rf"SELECT o_orderkey, regexp_matches({sql_list(_GLUED)}[1 + (o_orderkey % 5)], '(?:<[\p{{L}}\p{{N}}_]+>\|<?[\p{{L}}\p{{N}}_]+>?\|?)+') AND o_orderkey % 2 = 0 AS ambiguous FROM orders")
def ambiguous_labels(t):
    token = F.get(F.array(*map(F.lit, _GLUED)), F.col("o_orderkey") % 5)
    return t.orders.select("o_orderkey", text.ambiguous_label(token, F.when(F.col("o_orderkey") % 2 == 0, "O").otherwise("B-PER")).alias("ambiguous"))


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND year(o_orderdate) BETWEEN 1995 AND 1996 AND o_orderpriority NOT IN ('5-LOW')")
def quality_predicates(t):
    return t.orders.where((F.col("o_orderdate") >= F.lit("1995-01-01").cast("timestamp")) & F.year("o_orderdate").between(1995, 1996) & ~F.col("o_orderpriority").isin("5-LOW")).select("o_orderkey", "o_orderstatus")


@query(r"SELECT conv_id, turn, array_to_string(list_transform(range(1, len(w) + 1), lambda i: CASE WHEN i = 1 OR w[i][1] <> w[i - 1][1] THEN length(w[i]) ELSE -100 END), ' ') AS tags FROM (SELECT conv_id, turn, regexp_extract_all(text, '\S+') AS w FROM conversations)")
def subword_labels(t):
    words = text.whitespace_tokens(F.col("text"))
    # Neighbours that begin alike play the subwords of one word; a word's tag is its first one's length.
    fresh = F.transform(words, lambda w, i: F.when((i == 0) | (F.substring(w, 1, 1) != F.substring(F.get(words, i - 1), 1, 1)), 1).otherwise(0))
    rows = t.conversations.select("conv_id", "turn", words.alias("w"), fresh.alias("f"))
    ids = F.transform("f", lambda _, i: F.aggregate(F.slice("f", 1, i + 1), F.lit(0), lambda a, x: a + x) - 1)
    tags = F.transform(F.filter(F.arrays_zip("w", "f"), lambda x: x["f"] == 1), lambda x: F.length(x["w"]))
    return rows.select("conv_id", "turn", ids.alias("ids"), tags.alias("t")).select("conv_id", "turn", F.array_join(F.transform(text.subword_labels(F.col("ids"), F.col("t")), lambda x: x.cast("string")), " ").alias("tags"))


@query("SELECT doc_id, n_chars FROM documents WHERE n_chars > 400 AND lang IN ('de', 'en') AND source NOT IN ('src1', 'src2')")
def textual_filter(t):
    """Rows by a predicate in words, with values bound by name."""
    return text.query_filter(t.documents, "n_chars > @least AND lang IN @langs AND source NOT IN @sources", least=400, langs=["en", "de"], sources=["src1", "src2"]).select("doc_id", "n_chars")
