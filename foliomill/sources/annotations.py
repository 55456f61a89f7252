"""Annotated corpora: annotation exports in JSON, CoNLL files (SRC-14..16, SNK-02..04)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EXPORT = (
    "id long, data struct<text:string,meta_info:struct<id:string,path:string>>, "
    "annotations array<struct<id:long,result:array<struct<id:string,from_name:string,to_name:string,type:string,"
    "value:struct<start:int,end:int,text:string,labels:array<string>,choices:array<string>>>>>>"
)


def read_export(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EXPORT).option("multiLine", "true").json(path)


def export_entities(tasks: DataFrame, context: int = 10) -> DataFrame:
    """One row a span of the first annotation: labels merged with the choices of the same span."""
    each = tasks.select(F.col("id").alias("doc_id"), F.col("data.text").alias("doc_text"), F.explode(F.get("annotations", 0)["result"]).alias("r"))
    rows = each.where(F.col("r.type").isin("labels", "choices")).select("doc_id", "doc_text", F.col("r.value.start").alias("start_char"), F.col("r.value.end").alias("end_char"), F.col("r.value.text").alias("text"), F.col("r.value.labels").alias("labels"), F.col("r.value.choices").alias("choices"))
    flat = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce(c, F.array().cast("array<string>"))))))
    out = rows.groupBy("doc_id", "start_char", "end_char", "text").agg(F.first("doc_text").alias("doc_text"), F.get(flat(F.col("labels")), 0).alias("label"), flat(F.col("choices")).alias("subclass"))
    low = F.greatest(F.col("start_char") - context, F.lit(0))
    return out.select("doc_id", "start_char", "end_char", "text", "label", "subclass", F.substr("doc_text", low + 1, F.col("start_char") - low).alias("context_pre"), F.substr("doc_text", F.col("end_char") + 1, F.lit(context)).alias("context_post"))


def export_metadata(tasks: DataFrame) -> DataFrame:
    """Free-text answers of each document: ``doc_id, field, text``."""
    each = tasks.select(F.col("id").alias("doc_id"), F.explode(F.get("annotations", 0)["result"]).alias("r"))
    return each.where("r.type = 'textarea'").select("doc_id", F.col("r.from_name").alias("field"), F.col("r.value.text").alias("text"))


def read_conll(spark: SparkSession, path: str) -> DataFrame:
    """``path, doc_ord, tok_idx, token, label``."""
    return conll_tokens(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw")))


def conll_tokens(files: DataFrame) -> DataFrame:
    """Tokens of (path, raw): the header goes, blank lines part documents, fields part at `` -X- _ ``."""
    body = F.regexp_replace("raw", r"^-DOCSTART-[^\n]*\n+", "")
    docs = files.select("path", F.posexplode(F.filter(F.split(body, r"\n\s*\n"), lambda x: F.trim(x) != "")).alias("doc_ord", "doc"))
    lines = docs.select("path", "doc_ord", F.posexplode(F.filter(F.split("doc", "\n"), lambda x: F.trim(x) != "")).alias("tok_idx", "line"))
    return lines.select("path", "doc_ord", "tok_idx", F.regexp_extract("line", r"^(.*) -X- _ (\S+)\s*$", 1).alias("token"), F.regexp_extract("line", r"^(.*) -X- _ (\S+)\s*$", 2).alias("label"))


def pair_with_text(tokens: DataFrame, texts: DataFrame) -> DataFrame:
    """Documents of a CoNLL file go with the texts of an export by their place."""
    return tokens.join(texts, ["path", "doc_ord"])


def conll_line(token: Column, label: Column) -> Column:
    return F.when(token == " ", "").otherwise(F.concat(token, F.lit(" -X- _ "), label))


def conll_text(tokens: DataFrame, keys: list[str], position: str = "tok_idx") -> DataFrame:
    """One rendered file for each key."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct(position, conll_line(F.col("token"), F.col("label")).alias("line")))), lambda x: x["line"])
    return tokens.groupBy(*keys).agg(F.concat(F.lit("-DOCSTART- -X- O\n"), F.array_join(lines, "\n"), F.lit("\n")).alias("raw"))


def pair_text(tokens: DataFrame, keys: list[str], position: str = "tok_idx") -> DataFrame:
    """``token label`` lines without a header."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct(position, F.concat_ws(" ", "token", "label").alias("line")))), lambda x: x["line"])
    return tokens.groupBy(*keys).agg(F.array_join(lines, "\n").alias("raw"))


def export_task(text: Column, path: Column) -> Column:
    """A task of an annotation project as JSON."""
    return F.to_json(F.struct(text.alias("text"), F.struct(path.alias("path")).alias("meta_info")))
