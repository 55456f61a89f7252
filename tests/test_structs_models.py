import datetime
import decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliomill.functions import structs
from foliomill.operators import models


def test_paths(spark):
    df = spark.sql("select named_struct('a', array(named_struct('b', 1))) as x, '{\"k\": {\"v\": 2}, \"l\": [{\"v\": [3]}]}' as j")
    row = df.select(structs.get_path(F.col("x"), ["a", 0, "b"]).alias("p"), structs.get_path(F.col("x"), ["a", 5, "b"], -1).alias("q"), structs.json_path(F.col("j"), ["k", "v"]).alias("r"), structs.json_path(F.col("j"), ["no"], "d").alias("s"), structs.values_of(F.col("j"), "v").alias("t")).first()
    assert tuple(row) == (1, -1, "2", "d", ["2", "[3]"])


def test_flatten(spark):
    df = spark.sql("select named_struct('a', 1, 'b', named_struct('c', 2)) as x, 3 as y")
    assert structs.flatten_structs(df).first().asDict() == {"x_a": 1, "x_b_c": 2, "y": 3}


def test_tagged_json():
    value = {"d": datetime.date(2020, 1, 2), "t": datetime.datetime(2020, 1, 2, 3, 4, 5, 6), "h": datetime.time(1, 2), "s": datetime.timedelta(1, 2, 3), "n": decimal.Decimal("1.50"), "x": [1, "é"]}
    assert structs.decode(structs.encode(value)) == value
    assert structs.decode('{"__type__": "os.system", "args": ["x"]}') == {"__type__": "os.system", "args": ["x"]}
    with pytest.raises(TypeError):
        structs.encode(object())


def slow_conv(x, weight, bias):
    k = weight.shape[2]
    padded = np.pad(x, ((0, 0), (k // 2, k // 2)))
    return np.maximum(np.array([[sum(weight[o, c, j] * padded[c, t + j] for c in range(x.shape[0]) for j in range(k)) + bias[o] for t in range(x.shape[1])] for o in range(weight.shape[0])]), 0)


def test_conv_classifier(spark):
    r = np.random.default_rng(0)
    m = models.ConvClassifier(r.normal(size=(20, 4)), (r.normal(size=(3, 4, 7)), r.normal(size=3)), (r.normal(size=(2, 3, 7)), r.normal(size=2)), (r.normal(size=(2, 2)), r.normal(size=2)))
    ids = r.integers(0, 20, (5, 8))
    for row, p in zip(ids, m.probability(ids)):
        x = slow_conv(m.embedding[row].reshape(4, 8), *m.conv1)
        x = slow_conv(x.reshape(3, 4, 2).max(axis=2), *m.conv2).max(axis=1) @ m.linear[0].T + m.linear[1]
        assert abs(p - np.exp(x[1]) / np.exp(x).sum()) < 1e-9
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(ids)], "i int, ids array<int>")
    got = [x["probability"] for x in models.score(df, m).orderBy("i").collect()]
    assert np.allclose(got, m.probability(ids))


def test_encoding_of_options(spark):
    def make():
        return lambda texts: np.array([[len(t), t.count(" ")] for t in texts], dtype=float)

    names = spark.createDataFrame([(1, "a_b"), (2, "abc"), (3, "a_b")], "option_id int, name string")
    assert {r["option_id"]: r["embedding"] for r in models.build_options(names, make).collect()} == {1: [3.0, 1.0], 2: [3.0, 0.0], 3: [3.0, 1.0]}
