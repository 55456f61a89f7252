"""Sources and sinks on files made here."""

import io
import pickle
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from foliomill.sources import annotations, documents, pdf, pdf_file, sinks, tables
from foliomill.streaming.paragraphs import anonymize_stream, event_counts

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def docx(paragraphs, notes=()):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        z.writestr("word/document.xml", f"<w:document {W}><w:body>" + "".join(f"<w:p>{''.join(f'<w:r><w:t>{t}</w:t></w:r>' for t in p)}</w:p>" for p in paragraphs) + "</w:body></w:document>")
        if notes:
            z.writestr("word/footnotes.xml", f"<w:footnotes {W}>" + "".join(f"<w:footnote><w:p><w:r><w:t>{n}</w:t></w:r></w:p></w:footnote>" for n in notes) + "</w:footnotes>")
    return out.getvalue()


def odt():
    out = io.BytesIO()
    ns = 'xmlns:text="urn:oasis:names:tc:opendocument:xmlns:text:1.0" xmlns:style="urn:oasis:names:tc:opendocument:xmlns:style:1.0"'
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("mimetype", "application/vnd.oasis.opendocument.text")
        z.writestr("content.xml", f"<o {ns}><text:p>Uno <text:span>dos</text:span></text:p></o>")
        z.writestr("styles.xml", f"<o {ns}><style:header><text:p>Cabecera</text:p></style:header></o>")
    return out.getvalue()


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.docx").write_bytes(docx([["Hola ", "mundo"], ["ﬁn"]], ["nota", " "]))
    (tmp_path / "y.odt").write_bytes(odt())
    (tmp_path / "z.pdf").write_bytes(b"%PDF-1.4 nothing")
    (tmp_path / "bad.docx").write_bytes(b"PK\x03\x04word/ broken")
    return tmp_path


def test_extract(spark, folder):
    got = {r["path"].rsplit("/", 1)[1]: r for r in documents.extract(documents.read_files(spark, str(folder))).collect()}
    assert got["x.docx"]["text"] == "Hola mundo\nfin\n\nnota"
    assert got["y.odt"]["text"] == "Cabecera\n\nUno dos"
    assert got["z.pdf"]["extension"] == "pdf" and got["z.pdf"]["text"] is None and "without pages" in got["z.pdf"]["error"]
    assert got["bad.docx"]["text"] is None and got["bad.docx"]["error"]
    with pytest.raises(ValueError):
        documents.extract(documents.read_files(spark, str(folder)), "maybe")


def test_fragments_and_rebuild(spark, folder):
    files = documents.read_files(spark, str(folder), "x.docx")
    index = documents.paragraph_index(files).orderBy("xml_file", "paragraph_index", "fragment_index").collect()
    assert [(r["start"], r["end"], r["text"]) for r in index if r["xml_file"].endswith("document.xml")] == [(0, 5, "Hola "), (5, 10, "mundo"), (0, 3, "fin")]
    edits = files.select("path", F.lit("word/document.xml").alias("xml_file"), F.lit(0).alias("paragraph_index"), F.lit("<PER> mundo").alias("text"))
    made = documents.rebuild(files, edits).first()["content"]
    assert documents.docx_text(bytes(made)).startswith("<PER> mundo\n")


def test_conversion_table():
    documents.check_conversion("a.PDF".lower(), "pdf", "odt")
    with pytest.raises(ValueError):
        documents.check_conversion("a.txt", "pdf", "odt")


def test_rebuilt_runs_keep_what_is_unchanged():
    assert documents.spread(["Juan ", "Pérez vive ", "aquí"], "<PER> vive aquí") == ["<PER> ", "vive ", "aquí"]
    assert documents.spread(["a", "b"], "") == ["", ""]
    assert documents.spread(["solo"], "otro") == ["otro"]


def test_runs_are_normalised():
    link = "<w:hyperlink><w:r><w:t> el  sitio </w:t></w:r></w:hyperlink>"
    body = f"<w:p><w:r><w:t>  Ver </w:t></w:r>{link}<w:r><w:t>   </w:t></w:r><w:r><w:br/></w:r><w:r><w:t></w:t></w:r></w:p>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
        z.writestr("other.bin", b"kept")
    made = documents.normalize_docx(out.getvalue())
    assert documents.docx_text(made) == "Ver el sitio"
    with zipfile.ZipFile(io.BytesIO(made)) as z:
        xml = z.read("word/document.xml")
        assert z.read("other.bin") == b"kept" and b"hyperlink" not in xml and xml.count(b"<ns0:r>") == 3 and b"br" in xml


def test_documents_are_anonymised(spark, folder):
    files = spark.createDataFrame([("a.docx", docx([["Escribir a ana@", "x.com hoy"], ["Pedro Gómez firmó"], ["nada"]], []))], "path string, content binary")
    assert documents.docx_text(bytes(documents.anonymize(files).first()["content"])) == "Escribir a <CORREO_ELECTRONICO> hoy\nPedro Gómez firmó\nnada"
    seen = [("a.docx", 0, "Pedro Gómez firmo", [{"start_char": 0, "end_char": 11, "label": "PER", "text": "Pedro Gómez"}]), ("a.docx", 1, "nada", [])]
    from foliomill.schema import ENTITIES

    predictions = spark.createDataFrame(seen, f"path string, pred_idx int, text string, entities {ENTITIES}")
    assert documents.docx_text(bytes(documents.anonymize(files, predictions).first()["content"])) == "Escribir a ana@x.com hoy\n<PER> firmó\nnada"
    with pytest.raises(Exception, match="only docx"):
        documents.anonymize(documents.read_files(spark, str(folder), "y.odt")).collect()


@pytest.mark.parametrize("packed", [True, False])
def test_pdf_files(packed):
    text = "Hola (mundo) \\ niño\nsegunda línea\n\ntercera" + "\nx" * 100
    made = pdf_file.pdf_of(text, packed)
    assert [b[4] for b in pdf_file.text_blocks(made)] == [x for x in text.split("\n") if x]
    assert pdf_file.text_blocks(made)[-1][0] == 1 and pdf_file.text_of(made).startswith("Hola (mundo) \\ niño segunda línea\n\ntercera x")
    with pytest.raises(ValueError):
        pdf_file.text_blocks(b"%PDF-1.4 1 0 obj << /Encrypt 3 0 R >> endobj")


def test_pdf_with_composite_font_and_object_stream():
    chars = b"2 beginbfchar\n<0001> <0041>\n<0002> <00F1>\nendbfchar\n1 beginbfrange\n<0003> <0005> <0061>\nendbfrange"
    stream = lambda n, data, more="": f"{n} 0 obj\n<< /Length {len(data)} {more}>>\nstream\n".encode() + data + b"\nendstream\nendobj\n"
    inner = b"2 0 3 48 <</Type /Pages /Count 1 /Kids [4 0 R] >>         <</Type /Font /Subtype /Type0 /ToUnicode 6 0 R>>"
    first = inner.index(b"<<")
    head = b"2 0 3 " + str(inner.index(b"<</Type /Font") - first).encode() + b" "
    packed = head + inner[first:]
    content = b"%PDF-1.5\n1 0 obj\n<< /Type /Catalog /Pages 2 0 R >>\nendobj\n"
    content += stream(9, zlib.compress(packed), f"/Type /ObjStm /N 2 /First {len(head)} /Filter /FlateDecode ")
    content += b"4 0 obj\n<< /Type /Page /MediaBox [0 0 100 200] /Resources << /Font << /F 3 0 R >> >> /Contents [5 0 R] >>\nendobj\n"
    content += stream(5, b"BT /F 12 Tf 1 0 0 1 10 150 Tm [<0001> -300 <00020003>] TJ 0 -20 Td <0005> Tj ET") + stream(6, chars)
    assert [(b[2], b[4]) for b in pdf_file.text_blocks(content)] == [(38.0, "A ña"), (58.0, "c")]


def test_conversions_carry_the_text(spark):
    files = spark.createDataFrame([("a.docx", documents.docx_of("uno & <dos>\n\ntres"))], "path string, content binary")
    odt_files = documents.convert(files, "docx", "odt")
    assert documents.odt_text(bytes(odt_files.first()["content"])) == "uno & <dos>\n\ntres" and odt_files.first()["path"] == "a.odt"
    with pytest.raises(Exception, match="can't convert"):
        documents.convert(files, "odt", "docx").collect()


def test_plain_pickles_only(spark):
    good, bad = pickle.dumps({"a": [1, None, "x"]}), pickle.dumps(io.BytesIO)
    df = spark.createDataFrame([("g", good)], "path string, content binary")
    assert tables.read_pickles(df).first()["value"] == '{"a": [1, null, "x"]}'
    with pytest.raises(Exception, match="plain data"):
        tables.read_pickles(spark.createDataFrame([("b", bad)], "path string, content binary")).collect()


def test_links_of_shared_drives():
    assert tables.direct_link("https://drive.google.com/file/d/AbC_1-2/view?usp=x") == "https://drive.google.com/uc?export=download&id=AbC_1-2"
    assert tables.direct_link("https://a.com/x") == "https://a.com/x"


def test_pdf_paragraphs(spark):
    data = [(1, 0, 0, 0.0, 10.0, "a"), (1, 0, 1, 12.0, 20.0, "b"), (1, 0, 2, 40.0, 50.0, "c"), (1, 1, 0, 0.0, 10.0, "d"), (2, 0, 0, 0.0, 9.0, "solo")]
    blocks = spark.createDataFrame(data, "doc_id int, page int, block_no int, y0 double, y1 double, text string")
    assert {r["doc_id"]: r["margin"] for r in pdf.margins(blocks).collect()} == {1: 11.0, 2: 0.0}
    assert {r["doc_id"]: r["text"] for r in pdf.to_text(blocks, F.lit(5.0)).collect()} == {1: "a b\n\nc\n\nd", 2: "solo"}


def test_csv_rows(spark, tmp_path):
    (tmp_path / "p.csv").write_text("NRO_Registro , Tomo,fecha_resolucion,V_Fisica,materia,link\n12,3,7_9_20,si,s/d,http://x\n13,x,1_1_2020,no,penal,\n")
    got = tables.public_rows(tables.read_csv(spark, str(tmp_path / "p.csv"))).collect()
    assert [(r["nro_registro"], r["tomo"], r["date"], r["v_fisica"], r["materia"]) for r in got] == [("12", 3, "2020/09/07", True, None)]
    assert len(got[0]) == 45


def test_conll(spark, tmp_path):
    (tmp_path / "a.conll").write_text("-DOCSTART- -X- O\n\nHola -X- _ O\nJuan -X- _ B-PER\n\nOtro -X- _ O\n")
    got = annotations.read_conll(spark, str(tmp_path / "a.conll")).orderBy("doc_ord", "tok_idx").collect()
    assert [(r["doc_ord"], r["token"], r["label"]) for r in got] == [(0, "Hola", "O"), (0, "Juan", "B-PER"), (1, "Otro", "O")]


def test_export_entities(spark, tmp_path):
    (tmp_path / "e.json").write_text(
        '[{"id": 1, "data": {"text": "Ana vive aqui"}, "annotations": [{"result": ['
        '{"type": "labels", "from_name": "label", "value": {"start": 0, "end": 3, "text": "Ana", "labels": ["PER"]}},'
        '{"type": "choices", "from_name": "sub", "value": {"start": 0, "end": 3, "text": "Ana", "choices": ["x"]}},'
        '{"type": "textarea", "from_name": "nota", "value": {"text": "hola"}}]}]}]'
    )
    tasks = annotations.read_export(spark, str(tmp_path / "e.json"))
    (e,) = annotations.export_entities(tasks).collect()
    assert (e["label"], e["subclass"], e["context_pre"], e["context_post"]) == ("PER", ["x"], "", " vive aqui")
    assert annotations.export_metadata(tasks).first()["text"] == "hola"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "train"), (2, "b", "dev")], "id int, raw string, split string")
    sinks.export(df, str(tmp_path / "csv"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "csv")).count() == 2
    sinks.write_rendered(df, str(tmp_path / "txt"))
    sinks.write_splits(df, str(tmp_path / "ds"), {"O": 0})
    assert spark.read.parquet(str(tmp_path / "ds" / "samples")).where("split = 'dev'").count() == 1
    with pytest.raises(ValueError):
        sinks.export(df, str(tmp_path / "x"), "xml")


def test_streams(spark, tmp_path):
    spark.createDataFrame([(1, "a@b.com x\ny")], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    stream = anonymize_stream(spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in")))
    q = stream.select("doc_id", "redacted").writeStream.format("memory").queryName("redacted").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r["redacted"] for r in spark.table("redacted").collect()) == ["<CORREO_ELECTRONICO> x", "y"]
    events = spark.sql("select timestamp'2024-01-01 10:00:00' as ts, 'click' as event_type, 1.0D as value")
    assert event_counts(events).first()["n"] == 1
