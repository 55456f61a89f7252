"""Quality rules that judge lines first and then the document by what is left.

Each line with a word is tried against the rules below and removed if one holds; a document
that keeps fewer than half of its words is rejected. Base statistics of the whole document
are counted beside it. Everything is row-local: no shuffle, and memory follows the batch.

Line rules, n being the line's words:

* navigation: two or more menu separators, or at most eight words of which more than half
  are words of ``MENU`` (marks at their ends aside);
* symbols: more than one symbol of ``#*$%&<>`` for four words;
* shouting: more than one exclamation mark for two words;
* boilerplate: at most 25 words, with one of the phrases of ``BOILERPLATE``;
* punctuation: fewer than four words and no closing punctuation at the end;
* repetition: the same as an earlier line of the document.

Defined results: null and empty texts have no words, fail the base rules and are not kept;
rows are independent, so repeated rows give the same result each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import LOWER, SPACED, bounded_batches, encode, gram_hashes, mix, slices, tokenize, word_hashes

SYMBOLS = b"#*$%&|<>"
SEPARATORS = ("|", "•", "›", "»")
CLOSING = (".", "!", "?", "…", '"', "”", "»", ")", "]", ":", ";")
#: Phrases of pages rather than of texts, in the corpus's languages. Accented letters are lower case only.
BOILERPLATE = (
    "all rights reserved",
    "cookie policy",
    "enable javascript",
    "lorem ipsum",
    "privacy policy",
    "skip to content",
    "subscribe to our newsletter",
    "terms of service",
    "terms of use",
    "we use cookies",
    "alle rechte vorbehalten",
    "cookie-einstellungen",
    "datenschutzerkl",
    "javascript aktivieren",
    "newsletter abonnieren",
    "wir verwenden cookies",
    "zum inhalt springen",
    "aller au contenu",
    "conditions d'utilisation",
    "nous utilisons des cookies",
    "politique de confidentialit",
    "tous droits réservés",
    "aviso legal",
    "derechos reservados",
    "habilite javascript",
    "ir al contenido",
    "política de privacidad",
    "utilizamos cookies",
)
#: Words that are links when a line has hardly any others, in the same languages.
MENU = (
    "about", "contact", "home", "login", "menu", "next", "previous", "register", "search", "share", "sitemap",
    "anmelden", "impressum", "kontakt", "startseite", "suche", "teilen", "weiter",
    "accueil", "connexion", "partager", "recherche", "suivant",
    "buscar", "compartir", "contacto", "inicio", "siguiente",
)

_BOILER = re.compile(b"|".join(re.escape(x.encode()) for x in BOILERPLATE))
_SEPARATORS = re.compile("|".join(map(re.escape, SEPARATORS)).encode())
_MENU = frozenset(x.encode() for x in MENU)
_EDGES = b".,:;!?\"'()[]"
_CLOSING = tuple(x.encode() for x in CLOSING)
_MARKS = np.zeros(256, dtype=np.int64)
_MARKS[list(SYMBOLS)] = 1


def failing_rule(line: bytes, n: int) -> str | None:
    """The first rule that removes a line of ``n`` words, repetition aside."""
    if len(_SEPARATORS.findall(line)) >= 2:
        return "navigation"
    if n <= 8 and 2 * sum(w.strip(_EDGES) in _MENU for w in line.translate(LOWER).split()) > n:
        return "navigation"
    if 4 * (len(line) - len(line.translate(None, b"#*$%&<>"))) > n:
        return "symbols"
    if 2 * line.count(b"!") > n:
        return "shouting"
    if n <= 25 and _BOILER.search(line.translate(LOWER)):
        return "boilerplate"
    if n < 4 and not line.rstrip().endswith(_CLOSING):
        return "punctuation"
    return None


def clean_lines(text: bytes) -> tuple[list[bytes], int, int, int]:
    """Lines that stay, their words, lines with a word that equal an earlier line, lines removed."""
    seen, kept, words, repeats, removed = set(), [], 0, 0, 0
    for line in text.split(b"\n"):
        n = len(line.split())
        if not n:
            continue
        if line in seen:
            repeats += 1
            removed += 1
        elif failing_rule(line, n):
            removed += 1
        else:
            kept.append(line)
            words += n
        seen.add(line)
    return kept, words, repeats, removed


def base_counts(texts: list[bytes]) -> dict[str, np.ndarray]:
    """``n_words, word_chars, n_symbols, n_repeat_words`` of each text."""
    out = {k: np.zeros(len(texts), dtype=np.int64) for k in ("n_words", "word_chars", "n_symbols", "n_repeat_words")}
    for at, part in slices(texts):
        to = at + len(part)
        words = tokenize(part, SPACED)
        out["n_words"][at:to] = np.diff(words.first)
        points = np.zeros(len(words.buf) + 1, dtype=np.int64)
        np.cumsum((words.buf & 0xC0) != 0x80, out=points[1:])
        out["word_chars"][at:to] = np.bincount(words.doc, weights=points[words.end] - points[words.start], minlength=len(part))
        begin = np.cumsum([0] + [len(x) + 1 for x in part])[:-1]
        out["n_symbols"][at:to] = np.add.reduceat(_MARKS[words.buf], begin)
        grams, first = gram_hashes(word_hashes(words), words.doc, 3)
        if not len(grams):
            continue
        key = mix(grams ^ (words.doc[first].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        again = np.zeros(len(key), dtype=bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        covered = np.zeros(len(words.start), dtype=bool)
        for j in range(3):
            covered[first[again] + j] = True
        out["n_repeat_words"][at:to] = np.bincount(words.doc, weights=covered, minlength=len(part))
    return out


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_kept_words", "n_removed_lines")


def judge(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """``doc_id``, the counts, ``base_failed`` and ``kept`` of each row, and the cleaned text if wanted."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [encode(x.as_py()) for x in batch.column(1)]
            out = base_counts(texts)
            lines = [clean_lines(x) for x in texts]
            for name, i in (("n_kept_words", 1), ("n_dup_lines", 2), ("n_removed_lines", 3)):
                out[name] = np.array([x[i] for x in lines], dtype=np.int64)
            columns = [batch.column(0), *(pa.array(out[k]) for k in _COUNTS)]
            if with_text:
                columns.append(pa.array([b"\n".join(x[0]).decode("utf-8", "replace") for x in lines], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *_COUNTS, *["clean_text"] * with_text])

    made = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ", ".join(["doc_id long", *(f"{k} long" for k in _COUNTS), *["clean_text string"] * with_text]))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return made.withColumn("base_failed", failed).withColumn("kept", ~failed & (2 * F.col("n_kept_words") >= F.col("n_words")))


def _sql_list(values: tuple[str, ...]) -> str:
    return ", ".join("'" + x.replace("'", "''") + "'" for x in values)


#: The same rules for DuckDB.
ORACLE = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents
), words AS (
  SELECT rid, unnest(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS w, generate_subscripts(regexp_extract_all(t, '[^\x20\x09-\x0D]+'), 1) AS i FROM d
), grams AS (
  SELECT rid, i, w, lead(w, 1) OVER p AS w1, lead(w, 2) OVER p AS w2 FROM words WINDOW p AS (PARTITION BY rid ORDER BY i)
), again AS (
  SELECT rid, i, w, w2 IS NOT NULL AND count(*) OVER (PARTITION BY rid, w, w1, w2) > 1 AS r FROM grams
), covered AS (
  SELECT rid, w, r OR coalesce(lag(r, 1) OVER p, false) OR coalesce(lag(r, 2) OVER p, false) AS c FROM again WINDOW p AS (PARTITION BY rid ORDER BY i)
), by_words AS (
  SELECT rid, count(*) AS n_words, sum(length(w)) AS word_chars, sum(c::INT) AS n_repeat_words FROM covered GROUP BY rid
), lines AS (
  SELECT rid, unnest(string_split(t, chr(10))) AS l, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM d
), told AS (
  SELECT rid, l, len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS n, row_number() OVER (PARTITION BY rid, l ORDER BY i) > 1 AS dup FROM lines
), judged AS (
  SELECT *, dup
    OR len(regexp_extract_all(l, '[{"".join(SEPARATORS)}]')) >= 2
    OR (n <= 8 AND 2 * len(list_filter(regexp_extract_all(translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), lambda w: list_contains([{_sql_list(MENU)}], trim(w, '.,:;!?"''()[]')))) > n)
    OR 4 * len(regexp_extract_all(l, '[#*$%&<>]')) > n
    OR 2 * len(regexp_extract_all(l, '!')) > n
    OR (n <= 25 AND list_bool_or(list_transform([{_sql_list(BOILERPLATE)}], lambda p: contains(translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), p))))
    OR (n < 4 AND NOT list_bool_or(list_transform([{_sql_list(CLOSING)}], lambda p: ends_with(regexp_replace(l, '[\x20\x09-\x0D]+$', ''), p)))) AS removed
  FROM told WHERE n > 0
), by_lines AS (
  SELECT rid, sum(dup::INT) AS n_dup_lines, sum(CASE WHEN removed THEN 0 ELSE n END) AS n_kept_words, sum(removed::INT) AS n_removed_lines FROM judged GROUP BY rid
), counts AS (
  SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_kept_words, 0)::BIGINT AS n_kept_words, coalesce(n_removed_lines, 0)::BIGINT AS n_removed_lines
  FROM d LEFT JOIN by_words USING (rid) LEFT JOIN by_lines USING (rid)
)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 2 * n_kept_words >= n_words AS kept
FROM counts
"""
