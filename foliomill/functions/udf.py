"""The few scalar functions that no built-in expresses, vectorised over Arrow."""

from __future__ import annotations

import hashlib
import unicodedata
import uuid

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def text_to_uuid(text: str) -> str:
    """UUID5 in the DNS namespace of the 128-bit BLAKE2b hex digest."""
    return str(uuid.uuid5(uuid.NAMESPACE_DNS, hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()))


@F.pandas_udf(T.StringType())
def nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda x: x if x is None or x.isascii() or unicodedata.is_normalized("NFKC", x) else unicodedata.normalize("NFKC", x))


@F.pandas_udf(T.StringType())
def content_uuid(values: pd.Series) -> pd.Series:
    return values.map(lambda x: None if x is None else text_to_uuid(x))
