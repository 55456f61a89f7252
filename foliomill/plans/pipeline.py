"""Three-phase pipelines over paragraph frames, named in JSON (§3.0, ENT-01, 02, 08, MOD-01).

A stage is a function DataFrame -> DataFrame under a registered name; names outside the
registry are refused, so a configuration can't load code. Stages only add to the lazy plan.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates, normalize, rules, spans, text
from ..schema import ENTITIES

Stage = Callable[..., DataFrame]
REGISTRY: dict[str, Stage] = {}
PHASES = ("preprocess", "models", "postprocess")


def stage(name: str) -> Callable[[Stage], Stage]:
    def add(f: Stage) -> Stage:
        if name in REGISTRY:
            raise ValueError(f"stage {name!r} is registered twice")
        REGISTRY[name] = f
        return f

    return add


class Extractor(Protocol):
    """A model behind the ``extractor`` stage: entities (dicts of the schema's fields) for each text."""

    def predict(self, texts: list[str]) -> list[list[dict]]: ...


EXTRACTORS: dict[str, Callable[[], Extractor]] = {}


@stage("normalize_whitespace")
def normalize_whitespace(df: DataFrame) -> DataFrame:
    return df.withColumn("text", normalize.whitespace_normalize(F.col("text")))


@stage("normalize_document")
def normalize_document(df: DataFrame) -> DataFrame:
    return df.withColumn("text", normalize.document_normalize(F.col("text")))


@stage("split_paragraphs")
def split_paragraphs(df: DataFrame) -> DataFrame:
    keep = [c for c in df.columns if c not in ("text", "para_idx")]
    return df.select(*keep, F.posexplode(text.paragraphs(F.col("text"))).alias("para_idx", "text"))


@stage("rule_extractor")
def rule_extractor(df: DataFrame) -> DataFrame:
    """Entities of the shapes of personal data; runs in generated code, without a model."""
    made = F.transform(spans.extract_spans(F.col("text")), lambda s: F.struct(
        F.lit(None).cast("int"), F.lit(None).cast("int"), s["label"], spans.span_text(F.col("text"), s), s["start"], s["end"],
        spans.char_context(F.col("text"), s["start"], s["end"])["pre"], spans.char_context(F.col("text"), s["start"], s["end"])["post"],
        F.lit(None).cast("string"), F.lit(None).cast("int"), F.lit(None).cast("int"), F.array().cast("array<string>"), F.lit("rule"), F.lit(1.0)))
    return df.withColumn("entities", made.cast(ENTITIES))


@stage("extractor")
def extractor(df: DataFrame, name: str) -> DataFrame:
    """Entities by a registered model, made once a worker; each distinct text is predicted once."""
    make = EXTRACTORS[name]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for batch in batches:
            model = model or make()
            yield pd.DataFrame({"_text": batch["_text"], "entities": model.predict(batch["_text"].tolist())})

    keyed = df.drop("entities").withColumn("_key", _digest(F.col("text")))
    distinct = keyed.where("text is not null").groupBy("_key").agg(F.any_value("text").alias("_text"))
    made = distinct.mapInPandas(_keyed(run), f"_key binary, entities {ENTITIES}")
    return keyed.join(made, "_key", "left").drop("_key").withColumn("entities", F.coalesce("entities", F.array().cast(ENTITIES)))


def _digest(text):
    """A key of 128 bits, so that equal texts meet without their characters being compared or sorted."""
    return F.unhex(F.md5(text))


def _keyed(run):
    """Let a function of ``_text`` batches carry the key along."""

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys: list[pd.Series] = []

        def texts() -> Iterator[pd.DataFrame]:
            for batch in batches:
                keys.append(batch["_key"])
                yield batch[["_text"]]

        for made in run(texts()):
            yield pd.DataFrame({"_key": keys.pop(0).tolist(), "entities": made["entities"].tolist()})

    return keyed


@stage("line_extractor")
def line_extractor(df: DataFrame, name: str, split_lines: bool = True, context: int = 10) -> DataFrame:
    """Entities by a registered model that reads lines: ``start`` and ``end`` are tokens of the line.

    Each distinct text is split and each distinct line predicted once. ``start_char`` and ``end_char`` are moved to the whole
    text, contexts are the ``context`` tokens of the line on both sides, and the list of entities is
    written anew.
    """
    lines = text.split_lines(F.col("text")) if split_lines else F.array("text")
    rows = df.drop("entities").withColumn("_row", _digest(F.col("text")))
    texts = rows.where("text is not null").groupBy("_row").agg(F.any_value("text").alias("text"))
    each = texts.select("_row", F.posexplode(F.arrays_zip(lines.alias("line"), text.line_offsets(lines).alias("at"))).alias("_n", "x")).select("_row", "_n", F.col("x.line").alias("text"), F.col("x.at").alias("_at"))
    found = extractor(each, name)
    words = text.whitespace_tokens(F.col("text"))
    around = lambda e: spans.token_context(words, e["start"], e["end"], context)
    moved = F.transform("entities", lambda e: e.withField("start_char", (e["start_char"] + F.col("_at")).cast("int")).withField("end_char", (e["end_char"] + F.col("_at")).cast("int"))
        .withField("context_pre", around(e)["pre"]).withField("context_post", around(e)["post"]))
    whole = found.select("_row", "_n", moved.alias("e")).groupBy("_row").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_n", "e"))), lambda x: x["e"])).alias("entities"))
    return rows.join(whole, "_row", "left").drop("_row").withColumn("entities", F.coalesce("entities", F.array().cast(ENTITIES)))


@stage("filter_entities")
def filter_entities(df: DataFrame, enable: list[str] | None = None, disable: list[str] | None = None) -> DataFrame:
    return df.withColumn("entities", text.filter_entities(F.col("entities"), enable, disable))


@stage("clean_entities")
def clean_entities(df: DataFrame, legacy: bool = False) -> DataFrame:
    return df.withColumn("entities", spans.clean_entities(text.drop_punctuation(F.col("entities"), legacy)))


@stage("regex_subcategories")
def regex_subcategories(df: DataFrame, strict: bool = False) -> DataFrame:
    one = lambda e: e.withField("subclass", rules.regex_subcategory(e["label"], e["text"], e["subclass"], e["context_pre"], e["context_post"], strict))
    return df.withColumn("entities", F.transform("entities", one))


@stage("article_subcategories")
def article_subcategories(df: DataFrame, strict: bool = False) -> DataFrame:
    conducts = F.flatten(F.transform(F.filter("entities", lambda e: e["label"] == "CONDUCTA"), lambda e: F.coalesce(e["subclass"], F.array().cast("array<string>"))))
    one = lambda e: e.withField("subclass", rules.article_subclass(e["label"], e["text"], e["subclass"], F.col("_conducts"), strict))
    return df.withColumn("_conducts", conducts).withColumn("entities", F.transform("entities", one)).drop("_conducts")


@stage("datetime_format")
def datetime_format(df: DataFrame) -> DataFrame:
    one = lambda e: e.withField("subclass", dates.datetime_subclass(e["label"], e["text"], e["subclass"]))
    return df.withColumn("entities", F.transform("entities", one))


@stage("decide")
def decide(df: DataFrame, probability: str = "probability", threshold: float = 0.88, needs_detail: bool = False) -> DataFrame:
    return df.withColumn("entities", rules.decide(F.col("entities"), F.col("text"), F.col(probability), threshold, needs_detail))


@stage("entities_to_spans")
def entities_to_spans(df: DataFrame, key: str = "entities") -> DataFrame:
    old = F.col("spans") if "spans" in df.columns else F.lit(None).cast(f"map<string,{ENTITIES}>")
    return df.withColumn("spans", spans.set_spans(old, key, F.col("entities")))


@stage("annotations_to_predictions")
def annotations_to_predictions(df: DataFrame) -> DataFrame:
    return df.withColumn("entities", F.col("annotations"))


@stage("redact")
def redact(df: DataFrame, escape: bool = True, strict: bool = False) -> DataFrame:
    return df.withColumn("redacted", spans.redact(F.col("text"), spans.entity_spans(F.col("entities")), escape, strict))


@dataclass
class Pipeline:
    phases: dict[str, list[tuple[str, dict]]] = field(default_factory=dict)

    @staticmethod
    def from_json(config: str) -> Pipeline:
        """``{"preprocess": [[name, {arguments}], ...], "models": ..., "postprocess": ...}``."""
        raw = json.loads(config)
        phases = {p: [(s[0], dict(s[1]) if len(s) > 1 else {}) for s in raw.get(p, [])] for p in PHASES}
        if unknown := [n for own in phases.values() for n, _ in own if n not in REGISTRY]:
            raise ValueError(f"unknown stages: {', '.join(unknown)}")
        return Pipeline(phases)

    def to_json(self) -> str:
        return json.dumps({p: [[n, k] for n, k in self.phases.get(p, [])] for p in PHASES})

    def __call__(self, df: DataFrame) -> DataFrame:
        for phase in PHASES:
            for name, arguments in self.phases.get(phase, []):
                df = REGISTRY[name](df, **arguments)
        return df


ANONYMIZE = Pipeline({"preprocess": [("split_paragraphs", {}), ("normalize_whitespace", {})], "models": [("rule_extractor", {})], "postprocess": [("clean_entities", {}), ("redact", {"escape": False})]})


def infer_distinct(df: DataFrame, key: str, run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Apply a costly stage once a distinct text and join the result back by a digest of it."""
    keyed = df.withColumn("_key", _digest(F.col(key)))
    distinct = keyed.where(F.col(key).isNotNull()).groupBy("_key").agg(F.any_value(key).alias(key))
    return keyed.join(run(distinct).drop(key), "_key", "left").drop("_key")


def save_model(spark, folder: str, name: str, content: bytes) -> None:
    """Keep a model's bytes under a name in a folder that driver and executors share."""
    spark.createDataFrame([(name, bytearray(content))], "name string, content binary").coalesce(1).write.mode("overwrite").parquet(f"{folder.rstrip('/')}/{name}")


def load_model(spark, folder: str, name: str) -> bytes:
    return bytes(spark.read.parquet(f"{folder.rstrip('/')}/{name}").first()["content"])


@dataclass
class Training:
    """Models by name that are fitted one after the other on the same rows.

    A model has ``fit(df)``, which may do nothing, ``dumps()`` and a class method ``loads(bytes)``.
    """

    models: dict[str, object] = field(default_factory=dict)

    def fit(self, df: DataFrame) -> Training:
        for model in self.models.values():
            model.fit(df)
        return self

    def save(self, spark, folder: str) -> None:
        for name, model in self.models.items():
            save_model(spark, folder, name, model.dumps())

    @staticmethod
    def load(spark, folder: str, kinds: dict[str, type]) -> Training:
        return Training({name: kind.loads(load_model(spark, folder, name)) for name, kind in kinds.items()})
