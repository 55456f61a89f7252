"""Paragraphs, tokens and predicates as Column expressions (TOK-*, PRED-*)."""

from __future__ import annotations

import re
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .normalize import fold_accents, once

WORD_OR_MARK = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"

#: Words that stay whole. Fixed values.
WHOLE_WORDS = [
    "n°", "°C", "aprox.", "dna.", "dpto.", "ej.", "esq.", "pág.", "p.ej.", "Ud.", "Vd.", "Uds.", "Vds.", "vol.", "a.C.", "a.J.C.", "d.C.", "d.J.C.",
    "apdo.", "Av.", "Avda.", "Cía.", "Dr.", "Dra.", "EE.UU.", "Ee.Uu.", "etc.", "fig.", "Gob.", "Gral.", "Ing.", "J.C.", "km/h", "Lic.", "m.n.",
    "núm.", "P.D.", "Prof.", "Profa.", "q.e.p.d.", "Q.E.P.D.", "S.A.", "S.L.", "S.R.L.", "s.s.s.", "Sr.", "Sra.", "Srta.",
]
#: Number words and ordinals. Fixed values.
NUMBER_WORDS = [
    "cero", "uno", "dos", "tres", "cuatro", "cinco", "seis", "siete", "ocho", "nueve", "diez", "once", "doce", "trece", "catorce", "quince",
    "dieciséis", "diecisiete", "dieciocho", "diecinueve", "veinte", "veintiuno", "veintidós", "veintitrés", "veinticuatro", "veinticinco",
    "veintiséis", "veintisiete", "veintiocho", "veintinueve", "treinta", "cuarenta", "cincuenta", "sesenta", "setenta", "ochenta", "noventa", "cien",
    "mil", "millón", "billón", "trillón", "primero", "segundo", "tercero", "cuarto", "quinto", "sexto", "séptimo", "octavo", "noveno", "décimo",
    "undécimo", "duodécimo", "decimotercero", "decimocuarto", "decimoquinto", "decimosexto", "decimoséptimo", "decimoctavo", "decimonoveno",
    "vigésimo", "trigésimo", "cuadragésimo", "quincuagésimo", "sexagésimo", "septuagésimo", "octogésima", "nonagésima", "centésima", "milésima",
    "millonésima", "billonésima",
]


def exception_pieces() -> dict[str, list[str]]:
    """Words with their own split: whole ones, ``pal``, ``12m.`` and hours before a.m. or p.m."""
    out = {w: [w] for w in WHOLE_WORDS} | {"pal": ["pa", "l"], "12m.": ["12", "m."]}
    out |= {f"{h}{p}": [str(h), p] for h in range(1, 13) for p in ("a.m.", "am", "p.m.", "pm")}
    return out


def paragraphs(text: Column) -> Column:
    """Trimmed lines with single blanks, without empty and consecutive equal ones."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(F.regexp_replace(x, r"^\s+|\s+$", ""), r"\s{2,}", " "))
    lines = F.filter(lines, lambda x: x != "")
    return once(lines, lambda own: F.filter(own, lambda x, i: (i == 0) | (x != F.get(own, i - 1))))


def explode_paragraphs(docs: DataFrame) -> DataFrame:
    """``doc_id, para_idx, text``; consecutive duplicates are dropped before numbering."""
    return docs.select("doc_id", F.posexplode(paragraphs(F.col("text"))).alias("para_idx", "text"))


def split_lines(text: Column) -> Column:
    """Lines at any Unicode break, without an empty one at the end."""
    parts = F.split(text, LINE_BREAK)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def line_offsets(lines: Column, unit=F.length) -> Column:
    """Where each line starts if one separator stands between lines."""
    return F.transform(lines, lambda _, i: F.aggregate(F.slice(lines, 1, i), F.lit(0), lambda acc, x: acc + unit(x) + 1))


def whitespace_tokens(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda x: x != "")


def spanish_tokens(text: Column) -> Column:
    """Words and single marks; the exceptions keep their own pieces."""
    pieces = F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for x in chain.from_iterable(exception_pieces().items())])
    return F.flatten(F.transform(whitespace_tokens(text), lambda w: F.coalesce(F.try_element_at(pieces, w), F.regexp_extract_all(w, F.lit(WORD_OR_MARK), F.lit(0)))))


def decision_ids(text: Column, vocabulary: dict[str, int], length: int = 128, unknown: int = 0) -> Column:
    """Vocabulary ids of the first ``length`` tokens of the folded lower-case text, padded with 0."""
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(vocabulary.items())]) if vocabulary else F.create_map(F.lit(""), F.lit(unknown))
    ids = F.transform(F.slice(spanish_tokens(fold_accents(F.lower(text))), 1, length), lambda t: F.coalesce(F.try_element_at(table, t), F.lit(unknown)))
    return F.concat(ids, F.array_repeat(F.lit(0), F.lit(length) - F.size(ids)))


def like_num(token: Column) -> Column:
    body = F.regexp_replace(token, r"^[+\-±~]", "")
    return F.regexp_replace(body, "[,.]", "").rlike(r"^\p{Nd}+$") | body.rlike(r"^\p{Nd}+/\p{Nd}+$") | F.lower(body).isin(*NUMBER_WORDS)


def without_stop_words(tokens: Column, words: list[str]) -> Column:
    """Tokens whose lower-case form isn't in the list; the list is the user's (:func:`read_words`)."""
    known = F.create_map(*[F.lit(x) for w in sorted(set(words)) for x in (w, True)]) if words else None
    return F.filter(tokens, lambda t: F.try_element_at(known, F.lower(t)).isNull()) if known is not None else tokens


def read_words(spark, path: str) -> list[str]:
    """A word list of any length from a text file: words part at white space, what follows ``#`` is a remark."""
    lines = spark.read.text(path).select(F.regexp_replace("value", "#.*", "").alias("value"))
    words = lines.select(F.explode(whitespace_tokens(F.col("value"))).alias("w")).select(F.lower("w").alias("w")).distinct()
    return sorted(r["w"] for r in words.collect())


def vocabulary(tokens: DataFrame, least: int = 1) -> DataFrame:
    """``token, n, token_id``: ids from 1 by falling count, then by token."""
    from ..operators.windows import ordered_rank

    counts = tokens.groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return ordered_rank(counts, [-F.col("n"), F.substring("token", 1, 2)], [F.col("token")], "token_id")


def subword_labels(word_ids: Column, tags: Column, ignore: int = -100) -> Column:
    """The tag of the word at its first subword, ``ignore`` at others and at special tokens."""
    first = lambda w, i: w.isNotNull() & ((i == 0) | ~w.eqNullSafe(F.get(word_ids, i - 1)))
    return F.transform(word_ids, lambda w, i: F.when(first(w, i), F.get(tags, w)).otherwise(ignore))


#: What counts as a link inside a text. Fixed value.
URL = r"(http(s)?:\/\/.)(www\.)?[-a-zA-Z0-9@:%._\+~#=]{2,256}\.[a-z]{2,6}\b([-a-zA-Z0-9@:%_\+.~#?&//=]*)"


def is_url(c: Column) -> Column:
    return F.coalesce(c.rlike(URL), F.lit(False))


PUNCTUATION_ONLY = r"^[!-/:-@\[-`{-~]*$"
AMBIGUOUS = r"(?:<[\p{L}\p{N}_]+>\|<?[\p{L}\p{N}_]+>?\|?)+"


def ambiguous_label(token: Column, label: Column) -> Column:
    """Several labels in one token although none was assigned."""
    return token.rlike(AMBIGUOUS) & (label == "O")


def fuzzy_contains(text: Column, keyword: str, edits: int = 2) -> Column:
    """Whether a word-sized window of the lower-case text is within ``edits`` of the keyword.

    Of ``edits + 1`` pieces of the keyword one is unedited in such a window, so only windows
    around an exact occurrence of a piece are compared; most texts hold none at all.
    """
    low, n = F.lower(text), len(keyword)
    cuts = [n * i // (edits + 1) for i in range(edits + 2)]
    pieces = [(cuts[i], keyword[cuts[i] : cuts[i + 1]]) for i in range(edits + 1)]
    if any(not p for _, p in pieces):
        raise ValueError("the keyword is too short for so many edits")

    def near(whole: Column) -> Column:
        window = lambda i: F.exists(F.array(*[F.lit(n + d) for d in range(-edits, edits + 1)]), lambda m: (i + m - 1 <= F.length(whole)) & (F.levenshtein(F.substr(whole, i, m), F.lit(keyword), edits) >= 0))
        out = F.lit(False)
        for at, piece in pieces:
            gaps = F.split(whole, f"(?={re.escape(piece)})")  # parts begin where the piece does, overlaps included
            sums = F.aggregate(F.slice(gaps, 1, F.size(gaps) - 1), F.array(F.lit(0)), lambda acc, g: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(g))))
            found = F.filter(sums, lambda e: F.substr(whole, e + 1, F.lit(len(piece))) == piece)
            starts = F.flatten(F.transform(found, lambda e: F.sequence(e - at - edits + 1, e - at + edits + 1)))
            out = out | (whole.contains(piece) & F.exists(starts, lambda i: (i >= 1) & window(i)))
        return out

    return once(low, near)


def query_filter(df: DataFrame, condition: str, **values) -> DataFrame:
    """Rows that a textual predicate holds for; ``@name`` stands for a given value or list.

    Values are bound as literals and never become part of the text.
    """
    names = re.findall(r"@(\w+)", condition)
    if missing := [n for n in names if n not in values]:
        raise ValueError(f"no value for {', '.join(missing)}")
    flat = {f"{n}_{i}": v for n in set(names) if isinstance(values[n], (list, tuple, set)) for i, v in enumerate(sorted(values[n], key=str))}
    bound = flat | {n: values[n] for n in set(names) if not isinstance(values[n], (list, tuple, set))}
    text = re.sub(r"@(\w+)", lambda m: "(" + (", ".join(f":{k}" for k in flat if k.rsplit("_", 1)[0] == m[1]) or "NULL") + ")" if isinstance(values[m[1]], (list, tuple, set)) else f":{m[1]}", condition)
    return df.sparkSession.sql(f"SELECT * FROM {{rows}} WHERE {text}", args=bound, rows=df)


def has_label(entities: Column, label: str) -> Column:
    return F.exists(entities, lambda e: e["label"] == label)


def filter_entities(entities: Column, enable: list[str] | None = None, disable: list[str] | None = None) -> Column:
    if (enable is None) == (disable is None):
        raise ValueError("give either the labels to keep or the ones to drop")
    return F.filter(entities, lambda e: e["label"].isin(*enable) if enable is not None else ~e["label"].isin(*disable))


def drop_punctuation(entities: Column, legacy: bool = False) -> Column:
    """Entities that are more than punctuation; ``legacy`` keeps them all."""
    return entities if legacy else F.filter(entities, lambda e: ~e["text"].rlike(PUNCTUATION_ONLY))
