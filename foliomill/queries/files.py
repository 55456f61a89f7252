"""Files made of the driver's texts, read back; documents in and out; loaders, sinks and caches."""

from __future__ import annotations

import atexit
import io
import json
import pickle
import shutil
import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..operators import store
from ..sources import annotations, documents, sinks, tables
from .entities import REDACT, SPANS, _sql
from .registry import query


def work_folder(spark) -> str:
    """A folder that driver and executors share; a local session without ``spark.checkpoint.dir`` gets one of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_foliomill_files", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="foliomill-files-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        spark._foliomill_files = root
    root = root if "://" in root else f"file://{root}"
    return f"{root.rstrip('/')}/foliomill-files/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def office(t, kind=None):
    """Every document as a file: (path, length, content)."""
    kinds = F.get(F.array(*map(F.lit, ("docx", "odt", "pdf"))), F.col("doc_id") % 3) if kind is None else F.lit(kind)
    return documents.render(t.documents.select(F.concat(F.col("doc_id").cast("string"), F.lit("."), kinds).alias("path"), "text"), F.substring_index("path", ".", -1))


def _id():
    return F.substring_index("path", ".", 1).cast("long").alias("doc_id")


_KIND = "['docx', 'odt', 'pdf'][1 + doc_id % 3]"
_LINES = "regexp_replace(regexp_replace(text, '\\n+', chr(10), 'g'), '^\\n|\\n$', '', 'g')"


@query(f"SELECT doc_id, {_KIND} AS extension FROM documents UNION ALL SELECT -page_id - 1, CASE page_id % 2 WHEN 0 THEN 'doc' ELSE 'unknown' END FROM pages")
def sniff_types(t):
    """Formats of files by their bytes, whatever their names say."""
    made = office(t).select(_id(), documents.sniff(F.col("content")).alias("extension"))
    other = F.when(F.col("page_id") % 2 == 0, F.concat(F.unhex(F.lit("D0CF11E0A1B11AE1")), F.encode("html", "UTF-8"))).otherwise(F.encode("html", "UTF-8"))
    return made.union(t.pages.select((-F.col("page_id") - 1).alias("doc_id"), documents.sniff(other).alias("extension")))


@query("SELECT doc_id, sha256(text) AS digest FROM documents WHERE doc_id % 3 < 2")
def office_text(t):
    """Texts of docx and odt files are those that they were made of."""
    made = documents.extract(office(t)).where("extension <> 'pdf' and error is null")
    return made.select(_id(), F.sha2("text", 256).alias("digest"))


@query("SELECT doc_id, sha256(string_agg(x, ' ' ORDER BY i)) AS digest FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE trim(x) <> '' GROUP BY doc_id")
def pdf_file_text(t):
    """Words of PDF files, paragraphs joined."""
    made = documents.extract(office(t, "pdf"))
    return made.where("text <> ''").select(_id(), F.sha2(F.replace("text", F.lit("\n\n"), F.lit(" ")), 256).alias("digest"))


@query("SELECT conv_id, turn, sha256('nota ' || turn || ': ' || role || chr(10) || chr(10) || text) AS odt, sha256(text || chr(10) || chr(10) || 'nota ' || turn || ': ' || role) AS docx FROM (SELECT conv_id, turn, role, text FROM conversations)")
def headers_and_footnotes(t):
    """A header comes before an odt's text, footnotes come after a docx's."""
    rows = t.conversations.select("conv_id", "turn", "text", F.concat(F.lit("nota "), F.col("turn").cast("string"), F.lit(": "), "role").alias("note"))

    @F.pandas_udf("struct<odt:binary,docx:binary>")
    def made(text: pd.Series, note: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"odt": [documents.odt_of(x, n) for x, n in zip(text, note)], "docx": [documents.docx_of(x, [n, "  "]) for x, n in zip(text, note)]})

    files = rows.select("conv_id", "turn", made("text", "note").alias("f"))
    path = F.concat_ws("/", "conv_id", "turn")
    read = lambda kind: documents.extract(files.select(path.alias("path"), F.col(f"f.{kind}").alias("content"))).select("path", F.sha2("text", 256).alias(kind))
    both = read("odt").join(read("docx"), "path")
    return both.select(F.substring_index("path", "/", 1).cast(t.conversations.schema["conv_id"].dataType).alias("conv_id"), F.substring_index("path", "/", -1).cast(t.conversations.schema["turn"].dataType).alias("turn"), "odt", "docx")


@query("SELECT lang, count(*) AS n_files, sum(strlen(html))::BIGINT AS n_bytes FROM pages JOIN documents ON doc_id = page_id GROUP BY lang")
def folder_scan(t):
    """Files of nested folders, found by a pattern."""
    from pyspark.sql import types as T

    folder = work_folder(t.spark)

    def put(batches):
        from pyarrow import fs

        store_, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for lang, page, html in zip(batch["lang"], batch["page_id"], batch["html"]):
                store_.create_dir(f"{root}/{lang}/x", recursive=True)
                for name in (f"{lang}/x/{page}.html", f"{lang}/{page}.skip"):
                    with store_.open_output_stream(f"{root}/{name}") as out:
                        out.write(html.encode())
            yield pd.DataFrame({"n": [len(batch)]})

    rows = t.pages.join(t.documents.select(F.col("doc_id").alias("page_id"), "lang"), "page_id").select("lang", "page_id", "html")
    rows.mapInPandas(put, T.StructType([T.StructField("n", T.LongType())])).write.format("noop").mode("overwrite").save()
    files = documents.list_files(t.spark, folder, "*.html")
    return files.groupBy(F.element_at(F.split("path", "/"), -3).alias("lang")).agg(F.count("*").alias("n_files"), F.sum("length").alias("n_bytes"))


_INDEX = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)"


@query(f"WITH {_INDEX} SELECT doc_id, 'word/document.xml' AS xml_file, (i - 1)::INT AS paragraph_index, 0::INT AS fragment_index, 0::INT AS start, length(x)::INT AS \"end\", x AS text FROM l")
def docx_paragraphs(t):
    """Fragments of docx files with their places."""
    return documents.paragraph_index(office(t, "docx")).select(_id(), "xml_file", "paragraph_index", "fragment_index", "start", "end", "text")


@query("SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(text, '[ \\t]+', ' ', 'g'), ' *\\n *', chr(10), 'g'), '^ +| +$', '', 'g')) AS digest FROM documents")
def docx_normalize(t):
    """Docx files with blanks collapsed, paragraphs trimmed and empty runs dropped."""
    made = documents.extract(documents.normalize_files(office(t, "docx")))
    return made.select(_id(), F.sha2("text", 256).alias("digest"))


@query(f"WITH {_INDEX} SELECT doc_id, sha256(string_agg(CASE WHEN i % 2 = 0 THEN replace(x, 'e', 'EE') ELSE x END, chr(10) ORDER BY i)) AS digest FROM l GROUP BY doc_id")
def docx_rebuild(t):
    """Docx files with every second paragraph rewritten."""
    files = office(t, "docx")
    edits = documents.paragraph_texts(files).where("paragraph_index % 2 = 1").withColumn("text", F.replace("text", F.lit("e"), F.lit("EE")))
    return documents.extract(documents.rebuild(files, edits)).select(_id(), F.sha2("text", 256).alias("digest"))


_TIDY = "tidy AS (SELECT doc_id, i AS para, trim(regexp_replace(x, '[ \\t]+', ' ', 'g')) AS text FROM l)"


@query(f"WITH {_INDEX}, {_TIDY}, {_sql(SPANS, 'doc_id, para', 'tidy')}, {_sql(REDACT, 'doc_id, para').replace('{left}', '<').replace('{right}', '>')} SELECT doc_id, sha256(string_agg(CASE WHEN raw IS NULL THEN t.text ELSE trim(regexp_replace(raw, ' +', ' ', 'g')) END, chr(10) ORDER BY para)) AS digest FROM tidy t LEFT JOIN joined USING (doc_id, para) GROUP BY doc_id")
def docx_anonymize(t):
    """Docx in, docx out, personal data replaced by labels."""
    return documents.extract(documents.anonymize(office(t, "docx"))).select(_id(), F.sha2("text", 256).alias("digest"))


@query("SELECT doc_id, 'odt' AS extension, sha256(text) AS digest FROM documents")
def convert_files(t):
    """Docx files as odt."""
    made = documents.extract(documents.convert(office(t, "docx"), "docx", "odt"))
    return made.select(_id(), "extension", F.sha2("text", 256).alias("digest"))


@query("SELECT doc_id, s AS start_char, s + length(w) AS end_char, w AS text, CASE WHEN doc_id % 2 = 0 THEN 'PER' ELSE 'LOC' END AS label, 'a,b' AS subclass, substr(text, greatest(s - 10, 0) + 1, s - greatest(s - 10, 0)) AS context_pre, substr(text, s + length(w) + 1, 10) AS context_post FROM (SELECT doc_id, text, regexp_extract(text, '[^\\s]+', 0) AS w, (strpos(text, regexp_extract(text, '[^\\s]+', 0)) - 1)::INT AS s FROM documents) WHERE w <> ''")
def annotation_export(t):
    """Annotation exports in JSON, written and read: spans with their label and choices."""
    w = F.regexp_extract("text", r"\S+", 0)
    start = (F.instr("text", w) - 1).cast("int")
    value = lambda **k: F.struct(F.col("s").alias("start"), (F.col("s") + F.length("w")).alias("end"), F.col("w").alias("text"), *[v.alias(n) for n, v in k.items()])
    label = F.array(F.when(F.col("doc_id") % 2 == 0, "PER").otherwise("LOC"))
    rows = t.documents.select("doc_id", "text", w.alias("w"), start.alias("s")).where("w <> ''")
    result = F.array(F.struct(F.lit("labels").alias("type"), value(labels=label, choices=F.lit(None).cast("array<string>")).alias("value")), F.struct(F.lit("choices").alias("type"), value(labels=F.lit(None).cast("array<string>"), choices=F.array(F.lit("b"), F.lit("a"))).alias("value")))
    task = F.struct(F.col("doc_id").alias("id"), F.struct("text").alias("data"), F.array(F.struct(result.alias("result"))).alias("annotations"))
    folder = work_folder(t.spark)
    # A list of tasks a file, as the tool exports them.
    lists = rows.groupBy((F.col("doc_id") % 16).alias("part")).agg(F.to_json(F.collect_list(task)).alias("value"))
    lists.repartition(16, "part").select("value", "part").write.partitionBy("part").text(folder)
    read = annotations.read_export(t.spark, f"{folder}/*")
    return annotations.export_entities(read).select("doc_id", "start_char", "end_char", "text", "label", F.array_join("subclass", ",").alias("subclass"), "context_pre", "context_post")


@query("SELECT conv_id, (dense_rank() OVER (PARTITION BY conv_id ORDER BY turn, text) - 1)::INT AS doc_ord, (i - 1)::INT AS tok_idx, w AS token, 'B-' || role AS label FROM (SELECT conv_id, turn, text, role, unnest(regexp_extract_all(text, '\\S+')) AS w, generate_subscripts(regexp_extract_all(text, '\\S+'), 1) AS i FROM conversations)")
def conll_read(t):
    """CoNLL files with a blank line between documents, read back into tokens."""
    lines = F.transform(F.filter(F.split("text", r"\s+"), lambda x: x != ""), lambda w: annotations.conll_line(w, F.concat(F.lit("B-"), "role")))
    files = t.conversations.select("conv_id", F.struct("turn", "text").alias("o"), F.array_join(lines, "\n").alias("doc")).where("doc <> ''")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "doc"))), lambda x: x["doc"]), "\n\n")
    raw = files.groupBy("conv_id").agg(F.concat(F.lit("-DOCSTART- -X- O\n"), whole, F.lit("\n")).alias("raw"))
    read = annotations.conll_tokens(raw.withColumn("path", F.col("conv_id").cast("string")))
    return read.select(F.col("path").cast(t.conversations.schema["conv_id"].dataType).alias("conv_id"), "doc_ord", "tok_idx", "token", "label")


@query("SELECT vec_id, 64::BIGINT AS n, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS total, label::VARCHAR AS label FROM embeddings")
def array_files(t):
    """Numpy arrays and pickles of plain data, read back."""

    @F.pandas_udf("struct<npy:binary,pkl:binary>")
    def made(vector: pd.Series, label: pd.Series) -> pd.DataFrame:
        def npy(x):
            out = io.BytesIO()
            np.save(out, np.asarray(x, dtype=np.float64))
            return out.getvalue()

        return pd.DataFrame({"npy": [npy(x) for x in vector], "pkl": [pickle.dumps({"label": str(x), "n": [1, 2.5]}) for x in label]})

    files = t.embeddings.select(F.col("vec_id").cast("string").alias("path"), made("embedding", "label").alias("f"))
    arrays = tables.read_arrays(files.select("path", F.col("f.npy").alias("content")))
    plain = tables.read_pickles(files.select("path", F.col("f.pkl").alias("content")))
    both = arrays.join(plain, "path")
    total = F.aggregate("values", F.lit(0.0), lambda a, x: a + x)
    return both.select(F.col("path").cast("long").alias("vec_id"), F.get("shape", 0).alias("n"), F.round(total, 6).alias("total"), F.get_json_object("value", "$.label").alias("label"))


@query("SELECT page_id, sha256(html) AS digest, true AS skipped FROM pages")
def download_files(t):
    """Links fetched by executors; a second run finds every file there."""
    folder = work_folder(t.spark)
    links = t.pages.select("page_id", F.concat(F.lit(f"{folder}/source/"), F.col("page_id").cast("string")).alias("link"), "html")

    def put(batches):
        from pyarrow import fs

        store_, root = fs.FileSystem.from_uri(f"{folder}/source")
        store_.create_dir(root, recursive=True)
        for batch in batches:
            for page, html in zip(batch["page_id"], batch["html"]):
                with store_.open_output_stream(f"{root}/{page}") as out:
                    out.write(html.encode())
            yield pd.DataFrame({"n": [len(batch)]})

    links.select("page_id", "html").mapInPandas(put, "n long").write.format("noop").mode("overwrite").save()
    tables.download(links, f"{folder}/kept").write.format("noop").mode("overwrite").save()
    again = tables.download(links, f"{folder}/kept")
    names = tables.with_files(links.select("page_id", "link"), again).join(again.select("link", "skipped"), "link")
    files = t.spark.read.format("binaryFile").load(f"{folder}/kept").select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    return names.withColumn("name", F.element_at(F.split("path", "/"), -1)).join(files, "name").select("page_id", F.sha2("content", 256).alias("digest"), "skipped")


@query("SELECT c_custkey, c_name, c_mktsegment, c_acctbal AS csv, c_acctbal AS json FROM customer")
def export_round_trip(t):
    """A table exported as CSV and as JSON, read back."""
    folder, rows = work_folder(t.spark), t.customer.select("c_custkey", "c_name", "c_mktsegment", F.col("c_acctbal").cast("double").alias("balance"))
    sinks.export(rows, f"{folder}/csv", "csv")
    sinks.export(rows, f"{folder}/json", "json")
    csv = t.spark.read.schema(rows.schema).option("header", "true").csv(f"{folder}/csv").withColumnRenamed("balance", "csv")
    return csv.join(t.spark.read.schema(rows.schema).json(f"{folder}/json").select("c_custkey", F.col("balance").alias("json")), "c_custkey")


@query("SELECT vec_id, label::VARCHAR AS label, CASE vec_id % 10 WHEN 0 THEN 'test' WHEN 1 THEN 'dev' ELSE 'train' END AS split, (dense_rank() OVER (ORDER BY label::VARCHAR) - 1)::INT AS code FROM embeddings")
def split_round_trip(t):
    """Samples by split with their label codes, written and read back."""
    folder = work_folder(t.spark)
    split = F.when(F.col("vec_id") % 10 == 0, "test").when(F.col("vec_id") % 10 == 1, "dev").otherwise("train")
    rows = t.embeddings.select("vec_id", F.col("label").cast("string").alias("label"), split.alias("split"))
    names = sorted(r[0] for r in rows.select("label").distinct().collect())
    sinks.write_splits(rows, folder, {x: i for i, x in enumerate(names)})
    codes = json.loads(t.spark.read.text(f"{folder}/label_mapping", wholetext=True).first()[0])
    table = t.spark.createDataFrame(list(codes.items()), "label string, code int")
    return t.spark.read.parquet(f"{folder}/samples").join(table, "label").select("vec_id", "label", "split", "code")


@query("SELECT lang, count(*) AS n, true AS known, false AS after FROM documents GROUP BY lang")
def cache_round_trip(t):
    """A table kept by key: made once, found again, forgotten."""
    cache, key = store.TableCache(t.spark, work_folder(t.spark)), "counts of languages"
    made = lambda: t.documents.groupBy("lang").agg(F.count("*").alias("n"))
    cache.cached(key, made)
    known = cache.exists(key)
    rows = [tuple(r) for r in cache.load(key).collect()]  # a row a language
    cache.clear(key)
    return t.spark.createDataFrame([(*r, known, cache.exists(key)) for r in rows], "lang string, n long, known boolean, after boolean")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 0 THEN (o_orderkey % 31 + 1)::VARCHAR END AS materia, o_orderkey % 3 = 0 AS v_fisica, '/data/' || o_orderkey || '.docx' AS path FROM orders WHERE o_orderkey % 7 > 0")
def loader_rows(t):
    """The public table's loading: typed fields, rows without a link left out; private rows are keyed by path."""
    cell = lambda c: c.cast("string")
    k = F.col("o_orderkey")
    raw = t.orders.select(cell(k).alias("nro_registro"), F.when(k % 5 > 0, cell(k % 31 + 1)).otherwise("s/d").alias("materia"), F.when(k % 3 == 0, "si").otherwise("no").alias("v_fisica"), F.when(k % 7 > 0, F.concat(F.lit("http://x/"), cell(k))).alias("link"), F.concat(cell(k), F.lit(".docx")).alias("path"))
    public = tables.public_rows(raw).select("nro_registro", "materia", "v_fisica")
    private = tables.private_rows(raw, "/data/").select("nro_registro", "path")
    return public.join(private, "nro_registro").select(k_of("nro_registro"), "materia", "v_fisica", "path")


def k_of(column: str):
    return F.col(column).cast("long").alias("o_orderkey")


@query("SELECT p.page_id, p.page_id % 40 AS tomo, '/data/f/' || p.page_id || '_T' || (p.page_id % 40) || '.pdf' AS path FROM pages p")
def metadata_join(t):
    """Rows of a private list and the metadata of its files agree in register number and volume."""
    rows = t.pages.select("page_id", F.col("page_id").cast("string").alias("nro_registro"), (F.col("page_id") % 40).cast("int").alias("tomo"))
    files = t.pages.select(F.concat(F.lit("/data/f/"), "page_id", F.lit("_T"), F.col("page_id") % 40, F.lit(".pdf")).alias("path"))
    meta = tables.with_file_metadata(files).where("nro_registro is not null")
    # The same numbers in another volume don't meet.
    meta = meta.union(meta.withColumn("tomo", F.lit("99")))
    return tables.with_metadata(rows, meta).select("page_id", F.col("tomo").cast("long").alias("tomo"), "path")


@query("SELECT 'article_group' AS name, count(*) AS n, count(DISTINCT lang) AS codes FROM documents UNION ALL SELECT 'values', count(*), 0 FROM (SELECT DISTINCT lang FROM documents UNION ALL SELECT DISTINCT source FROM documents)")
def option_groups(t):
    """Columns about articles side by side, and the distinct options of all columns in long form."""
    df = t.documents.select(F.col("source").alias("art_infringido"), F.col("lang").alias("codigo_o_ley"), F.lit(None).cast("string").alias("conducta"))
    group = tables.article_group(df)
    one = group.agg(F.count("*").alias("n"), F.countDistinct("codigo_o_ley").alias("codes")).select(F.lit("article_group").alias("name"), "n", "codes")
    return one.union(tables.validation_values(df).agg(F.count("*").alias("n")).select(F.lit("values"), "n", F.lit(0).cast("long")))
