"""Office files from Spark's ``binaryFile`` source (SRC-01..04, 08, ANON-04, 10, 11, SNK-05, 06).

Formats come from magic bytes, not from names. docx, odt and pdf are read and written with
the standard library; legacy doc needs an external program, so it comes back with ``error`` set.
"""

from __future__ import annotations

import io
import re
import unicodedata
import zipfile
import zlib
from collections.abc import Iterator
from difflib import SequenceMatcher
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import pdf_file

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
STYLE = "{urn:oasis:names:tc:opendocument:xmlns:style:1.0}"
TEXT = "{urn:oasis:names:tc:opendocument:xmlns:text:1.0}"
#: Bytes that a member of an archive may unpack to.
MOST_BYTES = 256 << 20
_PARTS = re.compile(r"word/(document|header\d*|footer\d*|footnotes)\.xml")


def read_files(spark: SparkSession, folder: str, pattern: str = "*.*") -> DataFrame:
    """``path, length, content`` of every file below a folder, in no order."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder).select("path", "length", "content")


def list_files(spark: SparkSession, folder: str, pattern: str = "*.*") -> DataFrame:
    """``path, length`` of every file below a folder, sorted by path; contents aren't read."""
    return read_files(spark, folder, pattern).select("path", "length").orderBy("path")


def sniff(content: Column) -> Column:
    """``pdf, doc, docx, odt`` by content, or ``unknown``."""
    head = F.hex(F.substring(content, 1, 8))
    start = F.decode(F.substring(content, 1, 4096), "ISO-8859-1")
    zipped = head.startswith("504B0304")
    return (
        F.when(head.startswith("25504446"), "pdf").when(head == "D0CF11E0A1B11AE1", "doc")
        .when(zipped & start.contains("application/vnd.oasis.opendocument.text"), "odt")
        .when(zipped & (start.contains("word/") | start.contains("[Content_Types].xml")), "docx").otherwise("unknown")
    )


def _member(archive: zipfile.ZipFile, name: str) -> bytes:
    if archive.getinfo(name).file_size > MOST_BYTES:
        raise ValueError(f"{name} unpacks to more than {MOST_BYTES} bytes")
    return archive.read(name)


def docx_text(content: bytes) -> str:
    """Paragraphs of the body, then footnotes with any text."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        body = ET.fromstring(_member(archive, "word/document.xml"))
        paragraphs = ["".join(t.text or "" for t in p.iter(f"{W}t")) for p in body.iter(f"{W}p")]
        out = "\n".join(paragraphs)
        if "word/footnotes.xml" in archive.namelist():
            notes = ["".join(t.text or "" for t in n.iter(f"{W}t")) for n in ET.fromstring(_member(archive, "word/footnotes.xml")).iter(f"{W}footnote")]
            notes = [n for n in notes if n.strip()]
            if notes:
                out += "\n\n" + "\n".join(notes)
    return out


def odt_text(content: bytes) -> str:
    """Header texts of the styles, then headings and paragraphs."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        body = ET.fromstring(_member(archive, "content.xml"))
        out = "\n".join("".join(p.itertext()) for p in body.iter() if p.tag in (f"{TEXT}p", f"{TEXT}h"))
        if "styles.xml" in archive.namelist():
            header = [x.strip() for h in ET.fromstring(_member(archive, "styles.xml")).iter(f"{STYLE}header") for x in h.itertext() if x.strip()]
            if header:
                out = "\n".join(header) + "\n\n" + out
    return out


READERS = {"docx": docx_text, "odt": odt_text, "pdf": pdf_file.text_of}


def extract(files: DataFrame, errors: str = "coerce") -> DataFrame:
    """``path, extension, text, error``; ``errors`` is coerce (null and a message), ignore (null) or raise."""
    if errors not in ("coerce", "ignore", "raise"):
        raise ValueError(f"unknown mode {errors!r}")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, failures = [], []
            for kind, content in zip(batch.extension, batch.content):
                text = failure = None
                try:
                    if kind not in READERS:
                        raise ValueError(f"unsupported format: {kind}")
                    text = unicodedata.normalize("NFKC", READERS[kind](bytes(content)))
                except (ValueError, KeyError, IndexError, TypeError, zipfile.BadZipFile, zlib.error, ET.ParseError) as e:
                    if errors == "raise":
                        raise
                    failure = str(e) if errors == "coerce" else None
                texts.append(text)
                failures.append(failure)
            yield pd.DataFrame({"path": batch.path, "extension": batch.extension, "text": texts, "error": failures})

    return files.select("path", sniff(F.col("content")).alias("extension"), "content").mapInPandas(run, "path string, extension string, text string, error string")


def index_fragments(content: bytes) -> list[tuple[str, int, int, int, int, str]]:
    """(member, paragraph, fragment, start, end, text) of a docx; offsets run within a paragraph."""
    rows = []
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        for name in sorted(n for n in archive.namelist() if _PARTS.fullmatch(n)):
            for i, p in enumerate(ET.fromstring(_member(archive, name)).iter(f"{W}p")):
                at = 0
                for j, t in enumerate(p.iter(f"{W}t")):
                    text = unicodedata.normalize("NFKC", t.text or "")
                    rows.append((name, i, j, at, at + len(text), text))
                    at += len(text)
    return rows


def paragraph_index(files: DataFrame) -> DataFrame:
    """Text fragments of docx files with their place."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch.path, batch.content):
                yield pd.DataFrame([(path, *r) for r in index_fragments(bytes(content))], columns=["path", "xml_file", "paragraph_index", "fragment_index", "start", "end", "text"])

    return files.select("path", "content").mapInPandas(run, "path string, xml_file string, paragraph_index int, fragment_index int, start int, end int, text string")


def normalize_runs(root: ET.Element) -> None:
    """Lift runs out of hyperlinks, collapse blanks, trim paragraphs and drop runs without content.

    A run with anything but text in it (a break, a picture, a note) stays.
    """
    for parent in list(root.iter()):
        for k, child in reversed(list(enumerate(parent))):
            if child.tag == f"{W}hyperlink":
                parent.remove(child)
                for run in reversed(list(child)):
                    parent.insert(k, run)
    for p in root.iter(f"{W}p"):
        texts = list(p.iter(f"{W}t"))
        for t in texts:
            t.text = re.sub(r"\s+", " ", t.text or "")
        for a, b in zip(texts, texts[1:]):
            if a.text.endswith(" "):
                b.text = b.text.lstrip(" ")
        for run in (texts, texts[::-1]):  # blanks at both ends, over as many runs as have nothing else
            for t in run:
                t.text = t.text.lstrip() if run is texts else t.text.rstrip()
                if t.text:
                    break
        for t in texts:
            t.set("{http://www.w3.org/XML/1998/namespace}space", "preserve")
        for run in list(p.findall(f"{W}r")):
            content = [c for c in run if c.tag != f"{W}rPr"]
            if all(c.tag == f"{W}t" and not c.text for c in content):
                p.remove(run)


def _edited(content: bytes, edit) -> bytes:
    """The docx with ``edit(member, root)`` done to each part with text."""
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(content)) as archive, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as target:
        for name in archive.namelist():
            data = _member(archive, name)
            if _PARTS.fullmatch(name):
                root = ET.fromstring(data)
                edit(name, root)
                data = ET.tostring(root, xml_declaration=True, encoding="UTF-8")
            target.writestr(name, data)
    return out.getvalue()


def normalize_docx(content: bytes) -> bytes:
    return _edited(content, lambda _, root: normalize_runs(root))


def spread(texts: list[str], replaced: str) -> list[str]:
    """A paragraph's new text over the runs of its old one: what is unchanged stays in its run.

    Words that replace others go to the run where the first of these began.
    """
    if len(texts) == 1:
        return [replaced]
    pieces = [(k, m.group()) for k, text in enumerate(texts) for m in re.finditer(r"\S+\s*|\s+", text)]
    new = re.findall(r"\S+\s*|\s+", replaced)
    out = [""] * len(texts)
    for kind, a, b, c, d in SequenceMatcher(None, [x for _, x in pieces], new, autojunk=False).get_opcodes():
        if kind == "equal":
            for (k, x), _ in zip(pieces[a:b], new[c:d]):
                out[k] += x
        elif d > c:
            out[pieces[min(a, len(pieces) - 1)][0] if pieces else 0] += "".join(new[c:d])
    return out


def rebuild_docx(content: bytes, replaced: dict[tuple[str, int], str]) -> bytes:
    """The docx with the text of some paragraphs (member, number) replaced, run by run."""

    def edit(name: str, root: ET.Element) -> None:
        if not any(member == name for member, _ in replaced):
            return
        for i, p in enumerate(root.iter(f"{W}p")):
            texts = list(p.iter(f"{W}t"))
            if (text := replaced.get((name, i))) is not None and texts:
                for t, own in zip(texts, spread([t.text or "" for t in texts], text)):
                    t.text = own
                    t.set("{http://www.w3.org/XML/1998/namespace}space", "preserve")

    return _edited(content, edit)


def rebuild(files: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """``path, content`` of docx files with the paragraphs (path, xml_file, paragraph_index, text) put in."""
    edits = paragraphs.groupBy("path").agg(F.collect_list(F.struct("xml_file", "paragraph_index", "text")).alias("edits"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = []
            for path, kind, content, own in zip(batch.path, batch.extension, batch.content, batch.edits):
                if kind != "docx":
                    raise ValueError(f"{path}: only docx can be rebuilt")
                made.append(rebuild_docx(bytes(content), {(e["xml_file"], e["paragraph_index"]): e["text"] for e in (own if own is not None else [])}))
            yield pd.DataFrame({"path": batch.path, "content": made})

    told = files.select("path", sniff(F.col("content")).alias("extension"), "content").join(edits, "path", "left")
    return told.mapInPandas(run, "path string, content binary")


def normalize_files(files: DataFrame) -> DataFrame:
    """``path, content`` of docx files with their runs normalised; others stay as they are."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [normalize_docx(bytes(c)) if kind == "docx" else bytes(c) for kind, c in zip(batch.extension, batch.content)]
            yield pd.DataFrame({"path": batch.path, "content": made})

    return files.select("path", sniff(F.col("content")).alias("extension"), "content").mapInPandas(run, "path string, content binary")


def paragraph_texts(files: DataFrame) -> DataFrame:
    """``path, xml_file, paragraph_index, text`` of the paragraphs of docx files that have any."""
    parts = F.array_sort(F.collect_list(F.struct("fragment_index", "text")))
    text = F.array_join(F.transform(parts, lambda x: x["text"]), "")
    return paragraph_index(files).groupBy("path", "xml_file", "paragraph_index").agg(text.alias("text")).where(F.trim("text") != "")


def anonymize(files: DataFrame, predictions: DataFrame | None = None) -> DataFrame:
    """``path, content``: each docx with its personal data replaced by labels.

    ``predictions`` are path, pred_idx, text and entities of the paragraphs that a model saw; each
    paragraph of a file takes those of the equal or else the closest text of the same file, if
    one in five characters differs at most. Without predictions the shapes of personal data
    are sought in the paragraphs themselves. Files that aren't docx are an error.
    """
    from ..functions import spans
    from ..operators.matching import match_paragraphs

    files = normalize_files(files)
    texts = paragraph_texts(files)
    if predictions is None:
        found = texts.withColumn("spans", spans.extract_spans(F.col("text")))
    else:
        place = F.to_json(F.struct("xml_file", "paragraph_index"))
        matched = match_paragraphs(texts.select(F.col("path").alias("doc_id"), place.alias("para_idx"), "text"), predictions.select(F.col("path").alias("doc_id"), "pred_idx", "text"))
        told = texts.withColumn("para_idx", place).join(matched.where("cer <= 0.2").select(F.col("doc_id").alias("path"), "para_idx", "pred_idx"), ["path", "para_idx"])
        own = told.join(predictions.select("path", "pred_idx", F.col("text").alias("seen"), "entities"), ["path", "pred_idx"])
        # Offsets hold in the text that the model saw, so entities are found again in the paragraph.
        found = own.withColumn("spans", find_again(F.col("text"), F.col("seen"), F.col("entities")))
    redacted = found.where(F.size("spans") > 0).select("path", "xml_file", "paragraph_index", spans.redact(F.col("text"), F.col("spans"), escape=False).alias("text"))
    return rebuild(files, redacted)


def find_again(text: Column, seen: Column, entities: Column) -> Column:
    """Spans of entities in a text that may differ a little from the one that they were found in.

    Equal texts keep the offsets; else an entity is the first place of its own text, if any.
    """
    from ..functions.spans import SPAN, entity_spans

    again = F.transform(entities, lambda e: F.struct((F.instr(text, e["text"]) - 1).alias("start"), (F.instr(text, e["text"]) - 1 + F.length(e["text"])).alias("end"), e["label"].alias("label")).cast(SPAN))
    return F.when(text == seen, entity_spans(entities).cast(f"array<{SPAN}>")).otherwise(F.filter(again, lambda s: (s["start"] >= 0) & (s["end"] > s["start"])))


_NAMES = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def docx_of(text: str, notes: list[str] | None = None) -> bytes:
    """A docx with a paragraph for each line, and footnotes."""
    def paragraph(line: str) -> str:
        return f'<w:p><w:r><w:t xml:space="preserve">{escape(line)}</w:t></w:r></w:p>'

    parts = {
        "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>',
        "_rels/.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>',
        "word/document.xml": f'<w:document xmlns:w="{_NAMES}"><w:body>{"".join(map(paragraph, text.split(chr(10))))}</w:body></w:document>',
    }
    if notes:
        parts["word/footnotes.xml"] = f'<w:footnotes xmlns:w="{_NAMES}">{"".join(f"""<w:footnote w:id="{i}">{paragraph(n)}</w:footnote>""" for i, n in enumerate(notes, 1))}</w:footnotes>'
    return _zipped(parts)


def odt_of(text: str, header: str = "") -> bytes:
    """An odt with a paragraph for each line, and a page header."""
    office, kind = "urn:oasis:names:tc:opendocument:xmlns:office:1.0", "application/vnd.oasis.opendocument.text"
    lines = "".join(f"<text:p>{escape(x)}</text:p>" for x in text.split("\n"))
    parts = {
        "mimetype": kind,
        "content.xml": f'<office:document-content xmlns:office="{office}" xmlns:text="{TEXT[1:-1]}" office:version="1.2"><office:body><office:text>{lines}</office:text></office:body></office:document-content>',
        "META-INF/manifest.xml": f'<manifest:manifest xmlns:manifest="urn:oasis:names:tc:opendocument:xmlns:manifest:1.0"><manifest:file-entry manifest:full-path="/" manifest:media-type="{kind}"/><manifest:file-entry manifest:full-path="content.xml" manifest:media-type="text/xml"/></manifest:manifest>',
    }
    if header:
        parts["styles.xml"] = f'<office:document-styles xmlns:office="{office}" xmlns:style="{STYLE[1:-1]}" xmlns:text="{TEXT[1:-1]}"><office:master-styles><style:master-page style:name="Standard"><style:header><text:p>{escape(header)}</text:p></style:header></style:master-page></office:master-styles></office:document-styles>'
    return _zipped(parts)


def _zipped(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, text in parts.items():
            kind = zipfile.ZIP_STORED if name == "mimetype" else zipfile.ZIP_DEFLATED
            archive.writestr(zipfile.ZipInfo(name, (2000, 1, 1, 0, 0, 0)), ("" if name == "mimetype" else '<?xml version="1.0" encoding="UTF-8"?>') + text, kind)
    return out.getvalue()


WRITERS = {"docx": docx_of, "odt": odt_of, "pdf": pdf_file.pdf_of}
CONVERSIONS = {("pdf", "odt"), ("pdf", "docx"), ("docx", "odt"), ("odt", "docx"), ("docx", "pdf"), ("odt", "pdf")}


def check_conversion(path: str, source: str, target: str) -> None:
    """Which conversions exist, and that the file's name says so."""
    if (source, target) not in CONVERSIONS or not path.lower().endswith(f".{source}"):
        raise ValueError(f"can't convert {path} from {source} to {target}")


def convert(files: DataFrame, source: str, target: str) -> DataFrame:
    """``path, content`` of the files in another format: their text, a paragraph for each line.

    Layout and pictures aren't carried over. A file whose name has another ending is an error.
    """
    check_conversion(f".{source}", source, target)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch.path:
                check_conversion(path, source, target)
            made = [WRITERS[target](READERS[source](bytes(c))) for c in batch.content]
            yield pd.DataFrame({"path": [p[: -len(source)] + target for p in batch.path], "content": made})

    return files.select("path", "content").mapInPandas(run, "path string, content binary")


def render(texts: DataFrame, kind: Column | str) -> DataFrame:
    """``path, length, content`` of (path, text) in the format that ``kind`` names, as files would be read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [WRITERS[k](x or "") for k, x in zip(batch["_kind"], batch["text"])]
            yield pd.DataFrame({"path": batch.path, "length": [len(x) for x in made], "content": made})

    kind = F.lit(kind) if isinstance(kind, str) else kind
    return texts.select("path", "text", kind.alias("_kind")).mapInPandas(run, "path string, length long, content binary")
