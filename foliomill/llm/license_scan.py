"""License scans by diagonal voting.

Rolling hashes of all word k-grams are joined on Spark to the positions of the same k-grams
in the license templates. Each match votes for a diagonal, text position less template
position; votes are added up by (document, template, diagonal), neighbouring diagonals are
merged into one span, and each span is verified against the words of the text by the heaviest
common subsequence with the template; of verified spans over the same words the one that
explains most words stays. Base phrases are counted word for word beside it.

The templates are a fixed table of this module, so the join broadcasts it. k-grams that occur
in no template are left out before the rows reach the join (a semi-join by the same table),
and only texts with a match take their words along to the verification.

Defined results: null text counts as empty; a text without words has no labels and score 0;
repeated rows get equal results; rows are keyed by doc_id and text together, so a doc_id
that repeats with another text is judged by its own text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import materialize
from .words import LOWER, PLAIN, bounded_batches, encode, gram_hashes, slices, tokenize, word_hashes

K = 3

#: Base phrases and their labels.
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

#: License notices in their customary wording, by label. Fixed values.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("gpl-3.0", "licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", "you should have received a copy of the gnu general public license along with this program if not see"),
    ("gpl-2.0", "licensed under the gnu general public license version 2"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl", "licensed under the gnu affero general public license"),
    ("agpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2.0"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2.0 if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2.0"),
    ("cc-by-nc", "licensed under cc by nc 4.0"),
    ("cc-by-sa", "licensed under cc by sa 4.0"),
    ("cc-by", "licensed under cc by 4.0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4.0 international license"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4.0 international license"),
    ("cc-by-nd", "this work is licensed under a creative commons attribution noderivatives 4.0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4.0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("reserved", "all rights reserved no part of this publication may be reproduced distributed or transmitted in any form"),
)


def _hashed(text: str) -> np.ndarray:
    return word_hashes(tokenize([encode(text).translate(LOWER)], PLAIN))


_WORDS = [_hashed(text) for _, text in TEMPLATES]
_GRAMS = [gram_hashes(h, np.zeros(len(h), dtype=np.int64), K)[0] for h in _WORDS]
_SORTED = np.unique(np.concatenate(_GRAMS))
_SLOTS = np.zeros(1 << 16, dtype=bool)
_SLOTS[(_SORTED & np.uint64(0xFFFF)).astype(np.int64)] = True
_PHRASES = [(label, [encode(w) for w in phrase.split()], gram_hashes(_hashed(phrase), np.zeros(9, dtype=np.int64)[: len(phrase.split())], len(phrase.split()))[0][0]) for phrase, label in PHRASES.items()]


def template_positions(spark) -> DataFrame:
    """``gram, template, place``: every k-gram of the templates."""
    rows = [(int(np.int64(np.uint64(g).view(np.int64))), t, p) for t, grams in enumerate(_GRAMS) for p, g in enumerate(grams)]
    return spark.createDataFrame(rows, "gram long, template int, place int")


def _weights() -> list[np.ndarray]:
    """A template word weighs the inverse of the number of labels that use it."""
    used: dict[int, set[str]] = {}
    for (label, _), hashes in zip(TEMPLATES, _WORDS):
        for h in hashes.tolist():
            used.setdefault(h, set()).add(label)
    return [np.array([1 / len(used[h]) for h in hashes.tolist()]) for hashes in _WORDS]


_WEIGHTS = _weights()


def coverage_of(template: int, passage: np.ndarray) -> float:
    """Share of the template's weight in its heaviest common subsequence with the passage."""
    row = np.zeros(len(passage) + 1)
    for x, weight in zip(_WORDS[template], _WEIGHTS[template]):
        step = row.copy()
        step[1:] = np.maximum(row[1:], row[:-1] + weight * (passage == x))
        row = np.maximum.accumulate(step)
    return float(min(1.0, row[-1] / _WEIGHTS[template].sum()))


_SCAN = "doc_id long, row_key long, n_words long, n_base long, first_word long, last_word long, base array<string>, grams array<struct<gram:long,at:long>>, body string"


def _scan(docs: DataFrame) -> DataFrame:
    """Base counts of each row, its template k-grams, and its text if it has any of them."""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.struct([("gram", pa.int64()), ("at", pa.int64())])), pa.string()]
    names = ["doc_id", "row_key", "n_words", "n_base", "first_word", "last_word", "base", "grams", "body"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, texts = (batch.column(i).to_pylist() for i in range(3))
            rows = []
            for base, chunk in slices(encode(t).translate(LOWER) for t in texts):
                words = tokenize(chunk, PLAIN)
                hashes = word_hashes(words)
                starts: list[dict[str, list[int]]] = [{} for _ in chunk]
                for label, phrase, key in _PHRASES:
                    grams, first = gram_hashes(hashes, words.doc, len(phrase))
                    for i in first[grams == key].tolist():
                        if all(words.buf[words.start[i + j] : words.end[i + j]].tobytes() == w for j, w in enumerate(phrase)):
                            d = int(words.doc[i])
                            starts[d].setdefault(label, []).append(i - int(words.first[d]))
                grams, first = gram_hashes(hashes, words.doc, K)
                some = _SLOTS[(grams & np.uint64(0xFFFF)).astype(np.int64)]
                grams, first = grams[some], first[some]
                some = np.isin(grams, _SORTED)
                grams, first = grams[some].view(np.int64).tolist(), first[some]
                own: list[list[dict]] = [[] for _ in chunk]
                for g, i, d in zip(grams, first.tolist(), words.doc[first].tolist()):
                    own[d].append({"gram": g, "at": i - int(words.first[d])})
                n = np.diff(words.first).tolist()
                for d in range(len(chunk)):
                    places = sorted(x for v in starts[d].values() for x in v)
                    rows.append((ids[base + d], keys[base + d], n[d], len(places), places[0] if places else None, places[-1] if places else None, sorted(starts[d]), own[d], texts[base + d] if own[d] else None))
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], kinds[j]) for j in range(9)], names=names)

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.col("doc_id").cast("long"), "text").alias("row_key"), "text").mapInArrow(run, _SCAN)


def _verify(rows: DataFrame, least: float) -> DataFrame:
    """``found`` (label, coverage, first and last word) of the spans that the text's words confirm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("label", pa.string()), ("coverage", pa.float64()), ("low", pa.int64()), ("high", pa.int64())]))
        for batch in batches:
            ids, keys, bodies, spans = (batch.column(i).to_pylist() for i in range(4))
            out = []
            for body, own in zip(bodies, spans):
                hashes = _hashed(body)
                tried = []
                for s in own:
                    low, high = max(0, s["low"]), min(len(hashes), s["high"])
                    coverage = coverage_of(s["template"], hashes[max(0, low - 2) : high + 2])
                    if coverage >= least:
                        tried.append((-round(coverage * len(_WORDS[s["template"]]), 9), -coverage, low, high, TEMPLATES[s["template"]][0]))
                found, taken = [], np.zeros(len(hashes), dtype=bool)
                for _, c, low, high, label in sorted(tried):  # of spans over the same words, the one that explains most of them stays
                    if not taken[low:high].any():
                        taken[low:high] = True
                        found.append({"label": label, "coverage": -c, "low": low, "high": high})
                out.append(found)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(out, kind)], names=["doc_id", "row_key", "found"])

    return rows.mapInArrow(run, "doc_id long, row_key long, found array<struct<label:string,coverage:double,low:long,high:long>>")


def scan(docs: DataFrame, least: float = 0.8, gap: int = 4) -> DataFrame:
    """Base columns, ``labels``, ``score`` and the verified ``spans`` of every row of ``docs``.

    A span counts if at least ``least`` of its template's word weight stands in it in order;
    diagonals up to ``gap`` apart are one span.
    """
    bounded_batches(docs.sparkSession)
    rows = materialize(_scan(docs))
    votes = rows.where(F.size("grams") > 0).select("doc_id", "row_key", F.explode("grams").alias("g")).select("doc_id", "row_key", "g.gram", "g.at")
    votes = votes.join(F.broadcast(template_positions(docs.sparkSession)), "gram").withColumn("diagonal", F.col("at") - F.col("place"))
    lines = votes.groupBy("doc_id", "row_key", "template", "diagonal").agg(F.countDistinct("at").alias("votes"), F.min("at").alias("a"), F.max("at").alias("b"))
    near = Window.partitionBy("doc_id", "row_key", "template").orderBy("diagonal")
    lines = lines.withColumn("fresh", (F.col("diagonal") - F.lag("diagonal", 1, -(1 << 60)).over(near) > gap).cast("int"))
    lines = lines.withColumn("span", F.sum("fresh").over(near.rowsBetween(Window.unboundedPreceding, 0)))
    lengths = F.array(*[F.lit(len(w)) for w in _WORDS])
    spans = lines.groupBy("doc_id", "row_key", "template", "span").agg(F.sum("votes").alias("votes"), F.min("diagonal").alias("d0"), F.max("diagonal").alias("d1"))
    spans = spans.withColumn("low", F.col("d0")).withColumn("high", F.col("d1") + lengths[F.col("template")])
    spans = spans.groupBy("doc_id", "row_key").agg(F.sort_array(F.collect_list(F.struct("template", "low", "high", "votes"))).alias("spans"))
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["row_key"] == b["row_key"])
    bodies = rows.where("body is not null").dropDuplicates(["doc_id", "row_key"])
    checked = _verify(bodies.join(spans, same(bodies, spans)).select(bodies["doc_id"], bodies["row_key"], "body", "spans"), least).withColumnRenamed("found", "spans")
    slim = rows.drop("grams", "body")
    out = slim.join(checked, same(slim, checked), "left").select(*[slim[c] for c in slim.columns], F.coalesce("spans", F.array().cast("array<struct<label:string,coverage:double,low:long,high:long>>")).alias("spans"))
    labels = F.array_sort(F.array_distinct(F.concat("base", F.transform("spans", lambda x: x["label"]))))
    score = F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("spans", lambda x: x["coverage"])), F.lit(0.0)))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"), "spans")
