"""Column functions against hand-written values."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from foliomill.functions import dates, normalize, rules, spans, text
from foliomill.functions.udf import content_uuid, text_to_uuid

SPANS = "array<struct<start:int,end:int,label:string>>"


def value(spark, column, source="x"):
    return spark.createDataFrame([(source,)], "t string").select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("a  b\ncontinua", "a b continua"),
        ("fin.\nNuevo", "fin.\nNuevo"),
        ("uno,\nDos", "uno, Dos"),
        ("a -- b .- c", "a - b . c"),
        ("“x” y\\/z", '"x" y/z'),
        ("ﬁn\n\n\n¿Qué?", "fin \n¿Qué?"),
        ("𝒳 😀", "X 😀"),
    ],
)
def test_document_normalize(spark, raw, expected):
    assert value(spark, normalize.document_normalize(F.col("t")), raw) == expected


def test_whitespace_normalize(spark):
    assert value(spark, normalize.whitespace_normalize(F.col("t")), "a\t\tb  c d\n\n\ne") == "a b c d\ne"


def test_fold_accents(spark):
    assert value(spark, normalize.fold_accents(F.col("t")), "Ñandú straße 5° œuvre ¿sí?") == "Nandu strasse 5deg oeuvre ?si?"


def test_value_normalize_keeps_tilde(spark):
    assert value(spark, normalize.value_normalize(F.col("t")), " Año__Próximo  güero ") == "año_proximo_güero"


def test_case_format_unknown():
    with pytest.raises(ValueError):
        normalize.case_format(F.lit("x"), "random")


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("El Sr. Juez", ["El", "Sr.", "Juez"]),
        ("EE.UU. n° 3pm", ["EE.UU.", "n°", "3", "pm"]),
        ("12m. 12-3/4", ["12", "m.", "12", "-", "3", "/", "4"]),
        ("¡hola!", ["¡", "hola", "!"]),
        ("", []),
    ],
)
def test_spanish_tokens(spark, raw, expected):
    assert value(spark, text.spanish_tokens(F.col("t")), raw) == expected


def test_paragraphs_drop_consecutive_duplicates(spark):
    assert value(spark, text.paragraphs(F.col("t")), " a  b \n\na b\nc\na b\n") == ["a b", "c", "a b"]


def test_split_lines_and_offsets(spark):
    raw = "ab\r\ncd e\n"
    assert value(spark, text.split_lines(F.col("t")), raw) == ["ab", "cd", "e"]
    assert value(spark, text.line_offsets(text.split_lines(F.col("t"))), raw) == [0, 3, 6]


@pytest.mark.parametrize("token, expected", [("12", True), ("-3,5", True), ("1/2", True), ("Dos", True), ("x1", False), ("1/2/3", False), ("primero", True)])
def test_like_num(spark, token, expected):
    assert value(spark, text.like_num(F.col("t")), token) is expected


def test_fuzzy_contains(spark):
    assert value(spark, text.fuzzy_contains(F.col("t"), "admisibilidad"), "sobre la ADMISIVILDAD del pedido")
    assert not value(spark, text.fuzzy_contains(F.col("t"), "admisibilidad"), "otra cosa")


def test_filter_entities_needs_one_list():
    with pytest.raises(ValueError):
        text.filter_entities(F.lit(None), enable=["A"], disable=["B"])


@pytest.mark.parametrize("raw, expected", [("7_9_20", datetime.date(2020, 9, 7)), ("07_09_2020", datetime.date(2020, 9, 7)), ("32_1_20", None), ("1_13_20", None), ("30_2_20", None), ("x", None)])
def test_parse_dmy(spark, raw, expected):
    assert value(spark, dates.parse_dmy(F.col("t")), raw) == expected


@pytest.mark.parametrize(
    "raw, expected", [("7/9/2020", ["07/09/2020"]), ("7 de septiembre de 2020", ["07/09/2020"]), ("7 de Septiembre del 2020", ["07/09/2020"]), ("nada", []), ("31/02/2020", [])]
)
def test_date_suggestions(spark, raw, expected):
    assert value(spark, dates.date_suggestions(F.col("t")), raw) == expected


@pytest.mark.parametrize("raw, expected", [("10:15 horas", ["10:15", "10:15"]), ("9.15 hs.", ["09:15"]), ("sin", [])])
def test_time_suggestions(spark, raw, expected):
    assert value(spark, dates.time_suggestions(F.col("t")), raw) == expected


def test_article_table():
    assert len(rules.ARTICLES) == 214 and rules.ARTICLES[0] == ("0", "codigo_penal_de_la_nacion")
    assert len(rules.BY_CONDUCT) == 19 and len(rules.SUBJECTS) == 14


@pytest.mark.parametrize(
    "article, legacy, strict",
    [
        ("100", "codigo_penal_de_la_nacion", "codigo_contravencional"),
        ("53", "ley_23592", "codigo_contravencional"),
        ("66", "ley_26735", "codigo_contravencional"),
        ("149 bis", "codigo_penal_de_la_nacion", "codigo_penal_de_la_nacion"),
        ("5 C", None, "ley_23737"),
        ("69 inciso 2", "codigo_contravencional", "codigo_contravencional"),
    ],
)
def test_direct_law(spark, article, legacy, strict):
    assert value(spark, rules.direct_law(F.col("t")), article) == legacy
    assert value(spark, rules.direct_law(F.col("t"), strict=True), article) == strict


def test_indirect_law_takes_the_conduct(spark):
    assert value(spark, rules.article_law(F.col("t"), F.array(F.lit("abuso_de_armas"))), "104") == "codigo_penal_de_la_nacion"
    assert value(spark, rules.article_law(F.col("t"), F.lit(None).cast("array<string>")), "104") is None


@pytest.mark.parametrize(
    "label, raw, legacy, strict",
    [
        ("MODALIDAD_DE_LA_VIOLENCIA", "espacio público", ["publica_politica"], ["en_espacio_publico", "publica_politica"]),
        ("RELACION_Y_TIPO_ENTRE_ACUSADO/A_Y_DENUNCIANTE", "ex pareja", ["ex_pareja"], ["ex_pareja"]),
        ("NOMBRE", "López", ["firma"], ["firma"]),
        ("NIVEL_INSTRUCCION", "estudios secundarios completos", ["secundario_completo"], ["secundario_completo"]),
        ("OTRO", "mujer cis", [], []),
    ],
)
def test_regex_subcategory(spark, label, raw, legacy, strict):
    for mode, expected in ((False, legacy), (True, strict)):
        c = rules.regex_subcategory(F.lit(label), F.col("t"), F.array().cast("array<string>"), F.lit("la jueza"), F.lit("dijo"), mode)
        assert value(spark, c, raw) == expected


def test_given_subclass_stays(spark):
    assert value(spark, rules.regex_subcategory(F.lit("GENERO"), F.col("t"), F.array(F.lit("x"))), "mujer cis") == ["x"]


def test_decision(spark):
    from foliomill.schema import ENTITIES

    none = F.array().cast(ENTITIES)
    assert value(spark, F.size(rules.decide(none, F.col("t"), F.lit(0.88)))) == 0
    made = value(spark, rules.decide(none, F.col("t"), F.lit(0.9)), "No hacer lugar")[0]
    assert (made["label"], made["subclass"], made["start_char"], made["end_char"]) == ("DECISION", ["no_hace_lugar"], 0, 14)
    assert value(spark, F.size(rules.decide(none, F.col("t"), F.lit(0.9), needs_detail=True))) == 0


def test_extract_spans_gives_code_points(spark):
    raw = "😀 escribe a ana@x.com o 20-12345678-9, IP 10.0.0.1"
    found = value(spark, spans.extract_spans(F.col("t")), raw)
    assert [(raw[s["start"] : s["end"]], s["label"]) for s in found] == [("ana@x.com", "CORREO_ELECTRONICO"), ("20-12345678-9", "CUIT_CUIL"), ("10.0.0.1", "IP")]


def lit_spans(*items):
    return F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(c).alias("label")) for a, b, c in items]).cast(SPANS)


@pytest.mark.parametrize(
    "given, legacy, strict",
    [
        ([(0, 3, "P"), (4, 6, "P")], [(0, 6, "P")], [(0, 6, "P")]),
        ([(0, 3, "P"), (5, 6, "P")], [(0, 3, "P"), (5, 6, "P")], [(0, 3, "P"), (5, 6, "P")]),
        ([(0, 9, "P"), (2, 4, "P")], [(0, 4, "P")], [(0, 9, "P")]),
        ([(4, 6, "L"), (0, 3, "P")], [(0, 3, "P"), (4, 6, "L")], [(0, 3, "P"), (4, 6, "L")]),
    ],
)
def test_unify(spark, given, legacy, strict):
    for mode, expected in ((False, legacy), (True, strict)):
        got = [tuple(x) for x in value(spark, spans.unify_spans(lit_spans(*given), mode))]
        assert got == expected
        assert [tuple(x) for x in value(spark, spans.unify_spans(lit_spans(*got), mode))] == got


def test_redact(spark):
    raw = "Juan Perez vive en Salta 10"
    assert value(spark, spans.redact(F.col("t"), lit_spans((0, 4, "PER"), (5, 10, "PER"), (19, 27, "DIR")), escape=False), raw) == "<PER> vive en <DIR>"
    assert value(spark, spans.redact(F.col("t"), lit_spans()), " a  b ") == "a b"
    assert value(spark, spans.redact(F.col("t"), lit_spans((0, 6, "A"), (3, 8, "B")), escape=False), "abcdefghij") == "<A> <B>ij"


def test_clean_entity(spark):
    got = value(spark, spans.clean_entity(F.col("t"), F.lit(10)), '("Ana").')
    assert tuple(got) == ("Ana", 12, 15)


def test_content_uuid(spark):
    assert value(spark, content_uuid("t"), "hola") == text_to_uuid("hola")
    assert value(spark, content_uuid("t"), None) is None


def test_greek_and_cyrillic_go_by_sound(spark):
    texts = ["Ελλάδα ψυχή", "Москва Щука объезд", "Ñandú ß"]
    got = [r["x"] for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(normalize.fold_accents(F.col("t")).alias("x")).collect()]
    assert got == ["Ellada psukhe", "Moskva Shchuka obezd", "Nandu ss"]


def test_bound_filters(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a' OR 1=1")], "n int, s string")
    assert [r["n"] for r in text.query_filter(df, "n > @low AND s IN @names", low=0, names=["a"]).collect()] == [1]
    assert [r["n"] for r in text.query_filter(df, "s = @x", x="a' OR 1=1").collect()] == [3]
    assert text.query_filter(df, "s IN @none", none=[]).count() == 0
    with pytest.raises(ValueError):
        text.query_filter(df, "n > @low")


def test_word_lists(spark, tmp_path):
    (tmp_path / "stop.txt").write_text("de la # articles\nEl\n\nde\n")
    words = text.read_words(spark, str(tmp_path / "stop.txt"))
    assert words == ["de", "el", "la"]
    assert spark.range(1).select(text.without_stop_words(F.array(F.lit("El"), F.lit("sol"), F.lit("de")), words).alias("x")).first()["x"] == ["sol"]


def test_shapes_are_found_as_by_the_plain_search(spark):
    import re

    r = random.Random(2)
    bits = ["ana@x.com", "a.b-c@d.org", "10.0.0.1", "+54 (011) 444-5555", "x", " ", "http://a.b/c?d=1", "12345678", "20-12345678-9", "1/2/2020", "3 de mayo de 2021", "12.345.678", "ab" * 20, "IPP 1234/2020-1", "'", "<", "@", ".com", "I", "9" * 25, "-", "é"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 12))) for _ in range(300)]
    plain = re.compile("|".join(f"(?:{p})" for p in spans.SHAPES.values()))
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(spans.extract_spans(F.col("t")).alias("s"))
    for t, row in zip(texts, df.collect()):
        assert [(x["start"], x["end"]) for x in row["s"]] == [m.span() for m in plain.finditer(t)], t


def test_rules_that_look_around_against_plain_regex(spark):
    import re
    import unicodedata

    fold = lambda t: re.sub(r"[_\-,.;:]+", "", "".join(c for c in unicodedata.normalize("NFD", t.lower()) if not unicodedata.combining(c)))
    texts = ["ex pareja", "expareja", "pareja de la madre", "es su vecino", "hijo", "exnuera", "compañero de trabajo", "la ex compañera", "se separaron", "estudios secundarios completos", "no terminó los estudios primarios", "primario incompleto", "cursa el universitario", "posgrado", "sin estudios", "continúa con el terciario", "cursa sus estudios primarios", "doméstica", "laboral y mediática", "mediante", "pública", "en la vía pública", ""]
    for label in ("RELACION_Y_TIPO_ENTRE_ACUSADO/A_Y_DENUNCIANTE", "NIVEL_INSTRUCCION", "MODALIDAD_DE_LA_VIOLENCIA", "VIOLENCIA_DE_GENERO"):
        df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i")
        got = [r["x"] for r in df.select(rules.regex_subcategory(F.lit(label), F.col("t"), F.lit(None).cast("array<string>")).alias("x")).collect()]
        for t, found in zip(texts, got):
            assert found == sorted(k for k, p in rules.CATEGORIES[label].items() if re.search(p, fold(t))), (label, t)


def test_content_ids_against_the_plain_function(spark):
    texts = ["a", "", "ñandú \U0001f600", "x" * 10_000]
    got = [r["x"] for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(content_uuid("t").alias("x")).collect()]
    assert got == [text_to_uuid(t) for t in texts] and len(set(got)) == 4
