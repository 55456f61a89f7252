"""Span algebra inside a row: extraction, cleaning, merging and redaction (ENT-03, 07..10, ANON-01..03)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .normalize import once

SPAN = "struct<start:int,end:int,label:string>"

_MONTHS = "enero|febrero|marzo|abril|mayo|junio|julio|agosto|septiembre|octubre|noviembre|diciembre"
#: Shapes of personal data and case numbers; of shapes that start together the first wins.
SHAPES: dict[str, str] = {
    "CORREO_ELECTRONICO": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "LINK": r"https?://[^\s\"'<>]+",
    "IP": r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}",
    "TELEFONO": r"\+[0-9]{1,3} \([0-9]{3}\) [0-9]{3}-[0-9]{4}",
    "CUIJ": r"(?:IPP|CAU|DEB|INC) J-[0-9]{2}-[0-9]{8}-[0-9]/[0-9]{4}-[0-9]",
    "NUM_EXPEDIENTE": r"(?:IPP|CAU|DEB|INC) [0-9]{3,7}/[0-9]{4}-[0-9]",
    "CUIT_CUIL": r"(?:2[034567]|30)-[0-9]{8}-[0-9]",
    "CBU": r"[0-9]{22}",
    "FECHA": rf"[0-9]{{1,2}}[/-][0-9]{{1,2}}[/-](?:[0-9]{{4}}|[0-9]{{2}})|[0-9]{{1,2}} de (?:{_MONTHS}) del? [0-9]{{4}}",
    "DNI": r"[0-9]{1,2}\.[0-9]{3}\.[0-9]{3}",
    "SECRETO": r"[0-9a-f]{40}",
    "NUM": r"[0-9]{7,19}",
}


_WORD = "[A-Za-z0-9._%+-]"


def _search(shapes: dict[str, str]) -> str:
    """All shapes as one regex.

    The usual shapes are written so that most characters are passed by after one look: an
    address can only begin where its run of characters does (or where a match ended), and the
    shapes that begin with a digit, a sign or one of five letters are tried nowhere else.
    """
    if shapes != SHAPES:
        return "|".join(f"(?:{p})" for p in shapes.values())
    address = SHAPES["CORREO_ELECTRONICO"].replace(f"{_WORD}+@", f"(?:\\G|(?<!{_WORD})){_WORD}++@")
    marked = "|".join(f"(?:{p})" for label, p in SHAPES.items() if label not in ("CORREO_ELECTRONICO", "SECRETO", "NUM"))
    return f"(?:{address})|(?=[0-9+hICD])(?:{marked})|(?:{SHAPES['SECRETO']})|(?:{SHAPES['NUM']})"


def extract_spans(text: Column, shapes: dict[str, str] | None = None) -> Column:
    """Spans of all shapes, left to right, without overlap.

    The text between matches comes from a split by the same regex, so offsets are sums of
    lengths and stay code points; a text without a match is searched once only.
    """
    shapes = SHAPES if shapes is None else shapes
    every = _search(shapes)
    name = lambda m: F.coalesce(*[F.when(m.rlike(f"^(?:{p})$"), F.lit(label)) for label, p in shapes.items()])
    none = F.array().cast(f"array<{SPAN}>")
    first = F.struct(F.lit(0).alias("pos"), none.alias("out"))

    def add(acc: Column, x: Column) -> Column:
        start = acc["pos"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        span = F.struct(start.alias("start"), end.alias("end"), name(x["hit"]).alias("label")).cast(SPAN)
        return F.struct(end.alias("pos"), F.concat(acc["out"], F.array(span)).alias("out"))

    def place(found: Column) -> Column:
        pairs = F.arrays_zip(found.alias("hit"), F.slice(F.split(text, every), 1, F.size(found)).alias("gap"))
        return F.when(F.size(found) == 0, none).otherwise(F.aggregate(pairs, first, add, lambda acc: acc["out"]))

    return once(F.regexp_extract_all(text, F.lit(every), F.lit(0)), place)


def span_text(text: Column, span: Column) -> Column:
    return F.substr(text, span["start"] + 1, span["end"] - span["start"])


def clean_entity(text: Column, start: Column) -> Column:
    """``alt_text, alt_start_char, alt_end_char`` without marks at either end."""
    lead = F.length(F.regexp_extract(text, r"^[^\p{L}\p{N}_]+", 0))
    inner = F.regexp_replace(text, r"^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$", "")
    return F.struct(inner.alias("alt_text"), (start + lead).cast("int").alias("alt_start_char"), (start + lead + F.length(inner)).cast("int").alias("alt_end_char"))


def clean_entities(entities: Column) -> Column:
    """Every entity with its alt fields set."""

    def one(e: Column) -> Column:
        alt = clean_entity(e["text"], e["start_char"])
        return e.withField("alt_text", alt["alt_text"]).withField("alt_start_char", alt["alt_start_char"]).withField("alt_end_char", alt["alt_end_char"])

    return F.transform(entities, one)


def entity_spans(entities: Column) -> Column:
    """Spans of entities by their alt offsets; a missing or zero one falls back to the plain offset."""
    alt = lambda e, k: F.coalesce(F.nullif(e[f"alt_{k}_char"], F.lit(0)), e[f"{k}_char"])
    return F.transform(entities, lambda e: F.struct(alt(e, "start").alias("start"), alt(e, "end").alias("end"), e["label"].alias("label")))


def unify_spans(spans: Column, strict: bool = False) -> Column:
    """Merge a span into the one before it of the same label if at most one character is between.

    The merged end is the last span's, so it may shrink; ``strict`` takes the furthest one.
    Spans are taken by start, equal starts in the given order.
    """
    ordered = F.transform(F.array_sort(F.transform(spans, lambda s, i: F.struct(s["start"].alias("start"), i.alias("i"), s["end"].alias("end"), s["label"].alias("label")))), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["label"].alias("label")).cast(SPAN))

    def add(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        end = F.greatest(last["end"], s["end"]) if strict else s["end"]
        merged = F.struct(last["start"].alias("start"), end.alias("end"), last["label"].alias("label")).cast(SPAN)
        joins = (F.size(acc) > 0) & (F.get(acc, F.size(acc) - 1)["label"] == s["label"]) & (s["start"] - F.get(acc, F.size(acc) - 1)["end"] <= 1)
        return F.when(joins, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(merged))).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(ordered, F.array().cast(f"array<{SPAN}>"), add)


def redact(text: Column, spans: Column, escape: bool = True, strict: bool = False) -> Column:
    """The text with each unified span replaced by `` <LABEL>``, blanks collapsed and trimmed.

    A span that begins inside the one before it starts at that one's end.
    """
    left, right = ("&lt;", "&gt;") if escape else ("<", ">")
    begin = F.struct(F.lit("").alias("out"), F.lit(0).alias("pos"))

    def add(acc: Column, s: Column) -> Column:
        start = F.greatest(acc["pos"], s["start"])
        end = F.greatest(start, s["end"])
        label = F.concat(F.lit(f" {left}"), s["label"], F.lit(right))
        return F.struct(F.concat(acc["out"], F.substr(text, acc["pos"] + 1, start - acc["pos"]), label).alias("out"), end.alias("pos"))

    whole = F.aggregate(unify_spans(spans, strict), begin, add, lambda acc: F.concat(acc["out"], F.substr(text, acc["pos"] + 1)))
    return F.regexp_replace(F.regexp_replace(whole, " +", " "), r"^\s+|\s+$", "")


def unescape_labels(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">"))


def token_context(tokens: Column, start: Column, end: Column, width: int = 10) -> Column:
    """``pre`` and ``post``: the tokens around a token span, joined by blanks."""
    low = F.greatest(start - width, F.lit(0))
    pre = F.array_join(F.slice(tokens, low + 1, start - low), " ")
    return F.struct(pre.alias("pre"), F.array_join(F.slice(tokens, end + 1, F.lit(width)), " ").alias("post"))


def char_context(text: Column, start: Column, end: Column, width: int = 10) -> Column:
    low = F.greatest(start - width, F.lit(0))
    return F.struct(F.substr(text, low + 1, start - low).alias("pre"), F.substr(text, end + 1, F.lit(width)).alias("post"))


def set_spans(spans: Column, key: str, entities: Column) -> Column:
    """The map of span lists with one key set and the others kept."""
    rest = F.map_filter(spans, lambda k, _: k != key)
    return F.when(spans.isNull(), F.create_map(F.lit(key), entities)).otherwise(F.map_concat(rest, F.create_map(F.lit(key), entities)))
