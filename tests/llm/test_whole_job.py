"""Training-data operators that must look at every row: each test fails where rows are cut before they are looked at."""

import inspect
import random

import numpy as np
from pyspark.sql import functions as F

from vidsift.llm import mojibake, vector_neighbours


def test_a_rare_encoding_is_learned_in_a_large_table(spark):
    """Twenty garbled documents of 200,300, none of them in the text-hash sample of 50,000 that was learned from before."""
    words = "nước đường phố người đàn ông mặc áo đỏ trước cổng chợ lúc trời mưa giông tại thị trấn".split()
    rng = random.Random(1)
    clean = [" ".join(rng.choice(words) for _ in range(25)) for _ in range(300)]
    wrong = spark.createDataFrame([(mojibake.misread(t, ("utf-8", "mac_roman")),) for t in clean], "text string")
    wrong = wrong.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) > (1 << 20) // 3).orderBy("text").limit(20)
    d = wrong.unionByName(spark.createDataFrame([(t,) for t in clean], "text string")).unionByName(spark.range(200_000).select(F.concat(F.lit("plain "), F.col("id")).alias("text")))
    assert ("utf-8", "mac_roman") in mojibake.learn(d, text="text")


def test_many_vectors_that_tie_go_by_id(spark):
    """Forty scaled copies of a direction, blurred below six decimals, among others: all are as similar, so the smallest ids win."""
    rng = np.random.default_rng(4)
    one, other = rng.normal(size=16), rng.normal(size=(60, 16))
    x = np.concatenate([one * rng.uniform(0.1, 9.0, size=(40, 1)) * (1 + 1e-7 * rng.normal(size=(40, 16))), other])
    ids = rng.permutation(len(x)).tolist()
    d = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "vec_id long, v array<double>")
    got: dict[int, list[int]] = {}
    for r in vector_neighbours.nearest_vectors(d, vec_id="vec_id", vector="v", dims=16).orderBy("vec_id", "neighbour_rank").collect():
        got.setdefault(r.vec_id, []).append(r.neighbour_id)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u.T, 6)
    want = {ids[i]: [ids[j] for j in sorted((j for j in range(len(x)) if j != i), key=lambda j: (-s[i, j], ids[j]))[:5]] for i in range(len(x))}
    assert got == want


def test_recall_target_is_not_lowered():
    assert inspect.signature(vector_neighbours.nearest_vectors).parameters["target"].default >= 0.995
