"""Tabular inputs: the public dataset, private lists, file names, validation fields (SRC-09..13, 17)."""

from __future__ import annotations

import hashlib
import io
import json
import pickle
import re
import urllib.request
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import format_dmy
from ..functions.normalize import enforce_fields, normalize_headers
from ..functions.text import is_url
from ..operators.aggregates import to_items
from ..operators.windows import drop_null_columns
from ..schema import PUBLIC_FIELDS


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings, headers lower-cased and trimmed."""
    return normalize_headers(spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(path))


def public_rows(raw: DataFrame) -> DataFrame:
    """Typed rows of the public dataset; rows without a link go, the date comes from ``fecha_resolucion``."""
    dated = raw.withColumn("date", format_dmy(F.col("fecha_resolucion"))) if "fecha_resolucion" in raw.columns else raw
    return enforce_fields(dated.where(F.col("link").isNotNull()), PUBLIC_FIELDS)


def private_rows(raw: DataFrame, prefix: str) -> DataFrame:
    """As :func:`public_rows`, keyed by a file path under ``prefix``."""
    fields = PUBLIC_FIELDS | {"path": "string"}
    dated = raw.withColumn("date", format_dmy(F.col("fecha_resolucion"))) if "fecha_resolucion" in raw.columns else raw
    rows = enforce_fields(dated, fields)
    return rows.withColumn("path", F.concat(F.lit(prefix.rstrip("/") + "/"), "path"))


def group_items(rows: DataFrame, keys: list[str]) -> DataFrame:
    flags = [c for c, t in PUBLIC_FIELDS.items() if t == "boolean" and c in rows.columns and c not in keys]
    lists = [c for c, t in PUBLIC_FIELDS.items() if t == "string" and c in rows.columns and c not in keys]
    return to_items(rows, keys, flags, lists)


def file_metadata(path: Column) -> dict[str, Column]:
    """Name, extension, year, register number and volume that a path states."""
    base = F.regexp_extract(path, r"([^/]*)$", 1)
    name = F.regexp_replace(base, r"(?<=.)\.[^.]*$", "")
    parts = F.split(F.regexp_replace(F.regexp_replace(name, r"\s", "_"), r"^[A-Z][0-9]+_", ""), "_")
    found = lambda c, pattern, g: F.nullif(F.regexp_extract(c, pattern, g), F.lit(""))
    folder = F.regexp_replace(path, r"/[^/]*$", "")
    return {
        "doc_name": name,
        "doc_extension": F.regexp_extract(base, r"(?<=.)(\.[^.]*)$", 1),
        "year": found(folder, r"/([0-9]{4})/", 1),
        "nro_registro": F.get(parts, 0),
        "tomo": found(F.coalesce(F.get(parts, 1), F.lit("")), r"([0-9]+)", 1),
    }


def with_file_metadata(df: DataFrame, path: str = "path") -> DataFrame:
    return df.withColumns(file_metadata(F.col(path)))


def validation_values(df: DataFrame) -> DataFrame:
    """``name, value``: the distinct non-null values of every column, as text."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").cast("string").alias("value")) for c in df.columns]))
    return df.select(each.alias("x")).select("x.*").where("value is not null").distinct()


def validation_fields(df: DataFrame) -> DataFrame:
    """One row: the sorted distinct values of every column that has any (an option list; for many values see above)."""
    values = validation_values(df)
    named = {r["name"] for r in values.select("name").distinct().collect()}
    return values.agg(*[F.array_sort(F.collect_list(F.when(F.col("name") == c, F.col("value")))).alias(c) for c in df.columns if c in named])


#: Columns of the options that belong to an article. Fixed values.
ARTICLE_GROUP = ["art_infringido", "codigo_o_ley", "conducta", "conducta_descripcion"]


def article_group(df: DataFrame) -> DataFrame:
    """The columns about articles side by side, row by row, without those that hold nothing."""
    return drop_null_columns(df.select(*[F.col(c) for c in ARTICLE_GROUP if c in df.columns]))


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def read_arrays(files: DataFrame) -> DataFrame:
    """``path, shape, values`` of the numpy arrays in (path, content); pickled objects are refused."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [np.load(io.BytesIO(bytes(c)), allow_pickle=False) for c in batch.content]
            yield pd.DataFrame({"path": batch.path, "shape": [list(x.shape) for x in made], "values": [x.ravel().astype(float).tolist() for x in made]})

    return files.select("path", "content").mapInPandas(run, "path string, shape array<long>, values array<double>")


class _PlainUnpickler(pickle.Unpickler):
    """Lists, dicts, strings and numbers only; anything that names a class or function is refused."""

    def find_class(self, module: str, name: str):
        raise pickle.UnpicklingError(f"{module}.{name} isn't plain data")


def read_pickles(files: DataFrame) -> DataFrame:
    """``path, value`` (JSON) of pickles of plain data in (path, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [json.dumps(_PlainUnpickler(io.BytesIO(bytes(c))).load(), ensure_ascii=False, sort_keys=True) for c in batch.content]
            yield pd.DataFrame({"path": batch.path, "value": made})

    return files.select("path", "content").mapInPandas(run, "path string, value string")


def file_name(link: str) -> str:
    """Name that a link's content is kept under: a digest of the link."""
    return hashlib.blake2b(link.encode(), digest_size=16).hexdigest()


def direct_link(link: str) -> str:
    """The address of the content behind a shared drive's page; other links stay as they are."""
    found = re.search(r"drive\.google\.com/(?:file/d/|open\?id=|uc\?(?:export=\w+&)?id=)([\w-]+)", link)
    return f"https://drive.google.com/uc?export=download&id={found[1]}" if found else link


def fetch_url(link: str) -> bytes:
    with urllib.request.urlopen(direct_link(link), timeout=60) as answer:  # noqa: S310
        return answer.read()


def download(links: DataFrame, folder: str, column: str = "link", fetch: Callable[[str], bytes] = fetch_url) -> DataFrame:
    """``link, path, skipped, error``: each distinct link's content as a file of a shared folder.

    A file that is there already isn't fetched again. Executors fetch and write; a file appears
    under its name when it is whole. The result is written down once it is counted or saved.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        for batch in batches:
            rows = []
            for link in batch["link"]:
                path = f"{root.rstrip('/')}/{file_name(link)}"
                skipped, error = store.get_file_info(path).type != fs.FileType.NotFound, None
                if not skipped:
                    try:
                        part = f"{path}.{uuid.uuid4().hex}"
                        with store.open_output_stream(part) as out:
                            out.write(fetch(link))
                        store.move(part, path)
                    except (OSError, ValueError) as e:
                        error = str(e)
                rows.append((link, path, skipped, error))
            yield pd.DataFrame(rows, columns=["link", "path", "skipped", "error"])

    wanted = links.select(F.col(column).alias("link")).where(is_url(F.col(column)) | F.col(column).startswith("file:")).distinct()
    return wanted.mapInPandas(run, "link string, path string, skipped boolean, error string")


def with_files(rows: DataFrame, downloaded: DataFrame, column: str = "link") -> DataFrame:
    """Rows with the ``path`` of their link's file; rows whose file couldn't be fetched go."""
    kept = downloaded.where("error is null").select(F.col("link").alias(column), "path")
    return rows.drop("path").join(kept, column)


def with_metadata(rows: DataFrame, metadata: DataFrame) -> DataFrame:
    """Rows and file metadata that agree in register number and volume."""
    keys = ["nro_registro", "tomo"]
    right = metadata.select(*[F.col(k).cast(rows.schema[k].dataType) for k in keys], *[c for c in metadata.columns if c not in rows.columns])
    return rows.join(right, keys)
