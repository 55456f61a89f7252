"""Token labels: cleaning, BIO codes, entities from tags, samples (LBL-*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normalize import label_normalize
from .windows import running, same_as_previous

#: Raw label to canonical label where the two differ. Fixed values.
CANONICAL = {
    "NUM_DNI": "DNI", "FECHA_NUMERICA": "FECHA", "NUM_CAUSA": "NUM_EXPEDIENTE", "NUM_TELEFONO": "TELEFONO", "NUM_CUIT_CUIL": "CUIT_CUIL", "NUM_CUIJ": "CUIJ",
    "DEFENSORX": "PER", "FECHA_HECHO": "FECHA", "NUM_IP": "IP", "NUM_CVU": "CVU", "DIR": "DIRECCION", "DOMICILIO": "DIRECCION", "NUM_CBU": "CBU",
    "TEXTO_ANONIMIZADOR": "TEXTO_ANONIMIZAR", "NUM_CASO": "NUM_EXPEDIENTE", "NUM_PATENTE": "PATENTE_DOMINIO", "EDAD_ACUSADX": "EDAD", "NUM_TEL": "TELEFONO",
    "NUM_CUIT": "CUIT_CUIL", "TEL": "TELEFONO", "NUMERO_TELEFONO": "TELEFONO", "NRO_CAJA_AHORRO": "NUM_CAJA_AHORRO", "FISCAL": "PER",
    "DOMINIO_PATENTE": "PATENTE_DOMINIO", "USUARIE": "USUARIX", "ANONIMIZAR_TEXTO": "TEXTO_ANONIMIZAR", "NUM_ANON": "NUM", "DOM": "DIRECCION",
    "MATRICULA": "NUM_MATRICULA", "FECHA_NACIMIENTO": "FECHA", "HECHO": "FECHA", "NOMBRE": "PER", "CAUSA": "NUM_EXPEDIENTE", "ANONIMIZAR": "TEXTO_ANONIMIZAR",
    "NUM_EXPTE": "NUM_EXPEDIENTE", "FECHA_NUM": "FECHA", "MARCA_VEHICULO": "MARCA_AUTOMOVIL", "LUGAR": "LOC", "NUM_CAJA": "NUM_CAJA_AHORRO", "NUM_FECHA": "FECHA",
    "NUM_DOMINIO": "PATENTE_DOMINIO", "NUM_TELEFONICO": "TELEFONO", "MAIL": "CORREO_ELECTRONICO", "NUMTEL": "TELEFONO", "NUM_LIC": "NUM_LICENCIA",
    "USUARIO": "USUARIX", "NUM_CUENTA": "CUENTA",
}


def single_label(text: Column, labels: list[str]) -> Column:
    """The one known label that the normalised text names; null for none or several."""
    found = F.array_distinct(F.regexp_extract_all(label_normalize(text), F.lit("|".join(labels)), F.lit(0)))
    return F.when(F.size(found) == 1, F.get(found, 0))


def map_labels(df: DataFrame, mapping: DataFrame, label: str = "label") -> DataFrame:
    """Canonical labels from a ``raw, canonical`` table; unknown ones become null."""
    return df.join(mapping.withColumnRenamed("raw", label), label, "left").withColumn(label, F.col("canonical")).drop("canonical")


def canonical(label: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in CANONICAL.items() for x in pair]), label), label)


def bio_encode(df: DataFrame, label: str, keys: list[str], order: list[str], name: str = "tag") -> DataFrame:
    """``B-`` at each label, ``I-`` where the row before has the same, ``O`` for null.

    A group in which every label is null keeps nulls.
    """
    again = same_as_previous(label, keys, order)
    tag = F.when(F.col(label).isNull(), F.lit("O")).otherwise(F.concat(F.when(again, "I-").otherwise("B-"), F.col(label)))
    some = F.max(F.col(label).isNotNull()).over(Window.partitionBy(*keys))
    return df.withColumn(name, F.when(some, tag))


def bio_strip(tag: Column) -> Column:
    return F.regexp_replace(tag, "^[BI]-", "")


def bio_entities(df: DataFrame, tag: str, token: str, keys: list[str], position: str) -> DataFrame:
    """One row for each entity: its label, first and last position and text."""
    rows = df.withColumn("entity_id", F.sum(F.col(tag).startswith("B-").cast("int")).over(running(keys, position))).where(F.col(tag) != "O")
    words = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(position, token))), lambda x: x[token]), " ")
    return rows.groupBy(*keys, "entity_id").agg(F.min_by(bio_strip(F.col(tag)), position).alias("label"), F.min(position).alias("first_pos"), F.max(position).alias("last_pos"), words.alias("text"))


def number_labels(label: Column, anonymized: Column) -> Column:
    """What an open ``NUM_`` label means by its surrounding text, and other renames."""
    open_ = label.rlike("NUM_$")
    kind = F.when(anonymized.rlike("EXPEDIENTE|CAUSA"), "NUM_EXPEDIENTE").when(anonymized.contains("DNI"), "DNI").when(anonymized.contains("CUIJ"), "CUIJ").otherwise("NUM")
    out = F.when(open_, F.concat(F.regexp_replace(label, "NUM_$", ""), kind)).otherwise(label)
    out = F.replace(F.replace(out, F.lit("DOMINIO_PATENTE"), F.lit("PATENTE_DOMINIO")), F.lit("NUM_DOMINIO"), F.lit("PATENTE_DOMINIO"))
    return F.regexp_replace(out, "[BI]-HECHO", "FECHA")


def drop_bad_paragraphs(df: DataFrame, bad: Column, keys: list[str]) -> DataFrame:
    """Without the paragraphs that hold a bad row."""
    return df.withColumn("_bad", F.max(bad.cast("int")).over(Window.partitionBy(*keys))).where("_bad = 0").drop("_bad")


def label_codes(labels: list[str]) -> dict[str, int]:
    """``O`` is 0; then B- and I- of each label by name."""
    return {tag: i for i, tag in enumerate(["O", *(f"{p}-{x}" for x in sorted(set(labels)) for p in "BI")])}


def code_table(rows: DataFrame, label: str = "label") -> DataFrame:
    """``tag, code`` as :func:`label_codes` numbers the labels that occur, however many there are."""
    from .windows import ordered_rank

    names = rows.select(F.col(label).alias("name")).where("name is not null").distinct()
    ranked = ordered_rank(names, [F.substring("name", 1, 2)], [F.col("name")], "i")
    each = ranked.select(F.explode(F.array(F.struct(F.concat(F.lit("B-"), "name").alias("tag"), (2 * F.col("i") - 1).cast("int").alias("code")), F.struct(F.concat(F.lit("I-"), "name").alias("tag"), (2 * F.col("i")).cast("int").alias("code")))).alias("x")).select("x.*")
    return rows.sparkSession.createDataFrame([("O", 0)], "tag string, code int").union(each)


def to_samples(tokens: DataFrame, codes: dict[str, int], keys: list[str], position: str = "tok_idx") -> DataFrame:
    """A paragraph's tokens and tag codes; paragraphs without tokens or with an unknown tag go."""
    table = F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])
    rows = tokens.select(*keys, position, "token", F.try_element_at(table, F.col("tag")).alias("code"))
    out = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(position, "token", "code"))).alias("x"), F.count_if(F.col("code").isNull() | F.col("token").isNull()).alias("unknown"))
    out = out.where("unknown = 0").select(*keys, F.transform("x", lambda x: x["token"]).alias("tokens"), F.transform("x", lambda x: x["code"]).alias("tags"))
    return out.withColumn("n_labels", F.size(F.filter("tags", lambda t: t > 0))).withColumn("hash", F.sha2(F.array_join("tokens", " "), 256))


def from_samples(samples: DataFrame, codes: dict[str, int], keys: list[str]) -> DataFrame:
    """The token table of samples."""
    names = F.create_map(*[F.lit(x) for tag, code in codes.items() for x in (code, tag)])
    return samples.select(*keys, F.posexplode(F.arrays_zip("tokens", "tags")).alias("tok_idx", "x")).select(*keys, "tok_idx", F.col("x.tokens").alias("token"), F.element_at(names, F.col("x.tags")).alias("tag"))


def sentence_decisions(sentences: DataFrame, decisions: DataFrame, key: str = "doc_id") -> DataFrame:
    """Whether a sentence stands in one of its document's decision texts, and how the first such decided."""
    pairs = sentences.join(decisions.select(key, F.col("text").alias("_decision"), F.col("ord").alias("_ord"), F.col("subclass").alias("_sub")), key, "left")
    inside = F.col("_decision").contains(F.col("sentence"))
    out = pairs.groupBy(*sentences.columns).agg(F.coalesce(F.bool_or(inside), F.lit(False)).alias("decision"), F.min_by(F.when(inside, F.col("_sub")), F.when(inside, F.col("_ord"))).alias("_first"))
    return out.select(*sentences.columns, "decision", F.coalesce(F.col("_first") == "hace_lugar", F.lit(False)).alias("hace_lugar"))


def decision_category(decision: Column) -> Column:
    """1 for the spellings of true, 0 for anything else."""
    return F.when(decision.cast("string").isin("True", "true", "1"), 1).otherwise(0)
