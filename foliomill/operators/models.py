"""Model steps whose weights a user brings (ENT-06, SUB-07, SUB-09): Arrow batches, one load a worker."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class ConvClassifier:
    """Embedding, two convolutions with pooling between, maximum over time, linear layer.

    Shapes: embedding (words, width), conv1 (64, width, 7), conv2 (32, 64, 7), linear (classes, 32).
    The embedded text is reshaped, not transposed, to (width, tokens), as the trained weights expect.
    """

    embedding: np.ndarray
    conv1: tuple[np.ndarray, np.ndarray]
    conv2: tuple[np.ndarray, np.ndarray]
    linear: tuple[np.ndarray, np.ndarray]

    @staticmethod
    def _conv(x: np.ndarray, weight: np.ndarray, bias: np.ndarray) -> np.ndarray:
        k = weight.shape[2]
        padded = np.pad(x, ((0, 0), (0, 0), ((k - 1) // 2, k // 2)))
        windows = np.lib.stride_tricks.sliding_window_view(padded, k, axis=2)
        return np.maximum(np.einsum("nctk,ock->not", windows, weight, optimize=True) + bias[None, :, None], 0)

    def log_probabilities(self, ids: np.ndarray) -> np.ndarray:
        x = self.embedding[ids]
        x = x.reshape(len(ids), self.embedding.shape[1], ids.shape[1])
        x = self._conv(x, *self.conv1)
        even = x.shape[2] // 2 * 2
        x = np.maximum(x[:, :, 0:even:2], x[:, :, 1:even:2])
        x = self._conv(x, *self.conv2).max(axis=2) @ self.linear[0].T + self.linear[1]
        x = x - x.max(axis=1, keepdims=True)
        return x - np.log(np.exp(x).sum(axis=1, keepdims=True))

    def probability(self, ids: np.ndarray, label: int = 1) -> np.ndarray:
        return np.exp(self.log_probabilities(ids))[:, label]


def score(df: DataFrame, model: ConvClassifier, ids: str = "ids", name: str = "probability") -> DataFrame:
    """The chance of class 1 of rows with token ids."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(values: pd.Series) -> pd.Series:
        return pd.Series(shared.value.probability(np.array(values.tolist(), dtype=np.int64))) if len(values) else pd.Series(dtype="float64")

    return df.withColumn(name, run(ids))


def encode_texts(df: DataFrame, make: Callable[[], Callable[[list[str]], np.ndarray]], text: str = "text", batch: int = 256) -> DataFrame:
    """``_text, embedding`` of the distinct texts, ``batch`` at a time; ``make`` builds the encoder once a task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = None
        for rows in batches:
            encoder = encoder or make()
            texts = rows["_text"].tolist()
            for at in range(0, len(texts), batch):
                part = texts[at : at + batch]
                yield pd.DataFrame({"_text": part, "embedding": [v.tolist() for v in encoder(part)]})

    return df.select(F.col(text).alias("_text")).where("_text is not null").distinct().mapInPandas(run, "_text string, embedding array<double>")


def build_options(names: DataFrame, make: Callable[[], Callable[[list[str]], np.ndarray]]) -> DataFrame:
    """``option_id, embedding`` of option names, read with blanks for underscores."""
    spoken = names.select("option_id", F.replace("name", F.lit("_"), F.lit(" ")).alias("text"))
    return spoken.join(encode_texts(spoken, make).withColumnRenamed("_text", "text"), "text").select("option_id", "embedding")
