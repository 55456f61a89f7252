"""Text normalisation as Column expressions (NRM-*)."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .udf import nfkc

#: ``\w`` of Unicode in a form that every regex engine reads alike.
W = r"[\p{L}\p{N}_]"

#: Recoded cell values. Fixed values.
NULL_VALUES = ("no_corresponde", "no corresponde", "s/d", "sin frases")
FALSE_VALUE, TRUE_VALUE = "no", "si"


def once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, and outside of generated code of any length."""
    return F.get(F.transform(F.array(value), use), 0)


def _fold_table() -> tuple[str, str]:
    """Latin letters that decompose to one ASCII letter, and these letters."""
    pairs = [(c, base) for c in map(chr, range(0xC0, 0x250)) if len(base := unicodedata.normalize("NFD", c)[0]) == 1 and base.isascii() and base.isalpha() and c != base]
    return "".join(p[0] for p in pairs), "".join(p[1] for p in pairs)


FOLD_FROM, FOLD_TO = _fold_table()

#: Characters whose ASCII form is longer or no letter.
FOLD_LONG = {"ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "þ": "th", "Þ": "Th", "°": "deg", "…": "...", "—": "--", "€": "EUR", "«": "<<", "»": ">>"}
FOLD_MARKS = {"ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ð": "d", "Ð": "D", "ł": "l", "Ł": "L", "º": "o", "ª": "a", "“": '"', "”": '"', "‘": "'", "’": "'", "–": "-", "¿": "?", "¡": "!", "\u00a0": " "}

#: Greek and Cyrillic small letters by sound. Fixed values.
FOLD_GREEK = {
    "α": "a", "β": "b", "γ": "g", "δ": "d", "ε": "e", "ζ": "z", "η": "e", "θ": "th", "ι": "i", "κ": "k", "λ": "l", "μ": "m", "ν": "n", "ξ": "x",
    "ο": "o", "π": "p", "ρ": "r", "σ": "s", "ς": "s", "τ": "t", "υ": "u", "φ": "ph", "χ": "kh", "ψ": "ps", "ω": "o",
}
FOLD_CYRILLIC = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ж": "zh", "з": "z", "и": "i", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p",
    "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "", "ы": "y", "ь": "'", "э": "e", "ю": "iu", "я": "ia",
}


def _fold_other(c: Column) -> Column:
    """Greek and Cyrillic letters, without their marks, as Latin ones; capitals keep their first letter's."""
    table = FOLD_GREEK | FOLD_CYRILLIC
    table |= {k.upper(): v.capitalize() for k, v in table.items() if k.upper() not in table}
    marked = [(x, y) for x in map(chr, range(0x370, 0x530)) if (y := unicodedata.normalize("NFD", x)[0]) != x and y in table]
    c = F.translate(c, "".join(x for x, _ in marked), "".join(y for _, y in marked))
    for letter, out in table.items():
        if len(out) > 1:
            c = F.replace(c, F.lit(letter), F.lit(out))
    single = {k: v for k, v in table.items() if len(v) <= 1}
    plain = sorted(single, key=lambda k: not single[k])  # letters without a sound come last, so they are dropped
    return F.translate(c, "".join(plain), "".join(single[k] for k in plain))


def fold_accents(c: Column) -> Column:
    """ASCII form: letters lose their marks, Greek and Cyrillic go by sound, some signs become words, the rest is dropped."""
    c = F.when(c.rlike(r"[\x{370}-\x{52F}]"), _fold_other(c)).otherwise(c)
    for sign, out in FOLD_LONG.items():
        c = F.replace(c, F.lit(sign), F.lit(out))
    c = F.translate(c, FOLD_FROM + "".join(FOLD_MARKS), FOLD_TO + "".join(FOLD_MARKS.values()))
    return F.regexp_replace(c, r"[^\x00-\x7F]", "")


def document_normalize(c: Column, compat: bool = True) -> Column:
    """Join broken lines and tidy spaces, dashes, quotes and escaped slashes."""
    c = nfkc(c) if compat else c
    for pattern, out in ((" {2,}", " "), (r"\n([a-z0-9;:,\.])", " $1"), (rf'([\p{{L}}\p{{N}}_,"-])\n', "$1 "), (r"\n{2,}", "\n"), ("-{2,}", "-"), (r"\.-", ".")):
        c = F.regexp_replace(c, pattern, out)
    return F.replace(F.regexp_replace(c, "[“”]", '"'), F.lit("\\/"), F.lit("/"))


def whitespace_normalize(c: Column) -> Column:
    """Tabs, hard spaces and runs of blanks to one space, runs of newlines to one."""
    c = F.regexp_replace(c, r"[\t\u00a0]+", " ")
    c = F.regexp_replace(c, r"(?U)[^\S\r\n]+", " ")
    return F.regexp_replace(c, "\\n+", "\n")


def subcategory_normalize(c: Column) -> Column:
    return F.regexp_replace(fold_accents(F.lower(c)), r"[_\-,.;:]+", "")


def label_normalize(c: Column) -> Column:
    """ASCII letters, digits and underscores only."""
    return F.regexp_replace(fold_accents(c), r"[^0-9A-Za-z_]", "")


def retrieval_normalize(c: Column) -> Column:
    """Lower case without marks, letters, digits and blanks only."""
    return F.regexp_replace(fold_accents(F.lower(c)), r"[^0-9a-z\s]", "")


def value_normalize(c: Column) -> Column:
    """Acute and grave accents off (ñ and ü stay), one underscore for blanks, lower case."""
    c = F.translate(c, "áéíóúàèìòùÁÉÍÓÚÀÈÌÒÙ", "aeiouaeiouAEIOUAEIOU")
    return F.lower(F.replace(F.trim(F.regexp_replace(c, r"[_\s]+", " ")), F.lit(" "), F.lit("_")))


def split_glued_labels(c: Column) -> Column:
    """A blank between ``<LABEL>`` and what follows."""
    return F.regexp_replace(c, r"(<[\p{L}\p{N}_]+>)(\S)", "$1 $2")


def unescape_slashes(c: Column) -> Column:
    return F.replace(c, F.lit("\\/"), F.lit("/"))


CASE_FORMATS = ("identity", "lower", "upper", "title", "capitalize")


def case_format(c: Column, name: str) -> Column:
    if name not in CASE_FORMATS:
        raise ValueError(f"unknown case format {name!r}")
    return {"identity": c, "lower": F.lower(c), "upper": F.upper(c), "title": F.initcap(c), "capitalize": F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substr(c, F.lit(2))))}[name]


def path_rewrite(c: Column, pairs: list[tuple[str, str]]) -> Column:
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def normalize_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower().strip() for c in df.columns])


def null_recode(c: Column) -> Column:
    return F.when(~c.isin(*NULL_VALUES), c)


def bool_recode(c: Column) -> Column:
    """True, false, or null for anything else (a null stays a null)."""
    return F.when(c == TRUE_VALUE, True).when(c == FALSE_VALUE, False)


def enforce_fields(df: DataFrame, fields: dict[str, str]) -> DataFrame:
    """The columns of ``fields`` with their types; values that don't fit become null."""
    out = []
    for name, kind in fields.items():
        c = F.col(f"`{name}`") if name in df.columns else F.lit(None).cast("string")
        c = null_recode(c.cast("string"))
        out.append((bool_recode(c) if kind == "boolean" else c.try_cast(kind)).alias(name))
    return df.select(*out)
