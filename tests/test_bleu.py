"""BLEU counts against a plain count, over parts and batches of any size."""

import random
from collections import Counter, defaultdict

from loam.operators import evaluation


def by_force(rows, orders=4):
    """n: (hit, total); pairs of one id are one."""
    of = lambda a, n: Counter(tuple(a[i : i + n]) for i in range(len(a or []) - n + 1))
    ids, out = defaultdict(lambda: [[], []]), Counter()
    for i, h, r in rows:
        ids[i][0].append(h)
        ids[i][1].append(r)
    for hs, rs in ids.values():
        out[0, 0] += sum(len(x or []) for x in hs)
        out[0, 1] += sum(len(x or []) for x in rs)
        for n in range(1, orders + 1):
            a, b = (sum((of(x, n) for x in side), Counter()) for side in (hs, rs))
            if a or b:
                out[n, 0] += (a & b).total()
                out[n, 1] += max(1, a.total())
    return {n: (out[n, 0], out[n, 1]) for n in range(orders + 1) if (n, 1) in out}


def test_counts_against_force(spark, monkeypatch):
    rng = random.Random(4)
    text = lambda: rng.choice([None, [], *[[rng.choice("abcd") for _ in range(rng.randint(1, 30))] for _ in range(8)]])
    rows = [(rng.randint(0, 150), text(), text()) for _ in range(200)]
    df = spark.createDataFrame(rows, "id long, h array<string>, r array<string>").repartition(3, "id")
    sums = lambda: {x.n: (x.hit, x.total) for x in evaluation.bleu_counts(df).groupBy("n").sum("hit", "total").toDF("n", "hit", "total").collect()}
    assert sums() == by_force(rows)
    monkeypatch.setattr(evaluation, "GRAM_WORDS", 40)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert sums() == by_force(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert evaluation.bleu_counts(df.limit(0)).count() == 0


def test_no_row_for_each_gram(spark):
    """The plan has no n-grams as rows: nothing is exploded, and what is grouped are sums of parts."""
    df = spark.range(2).selectExpr("id", "split('a b c', ' ') h", "split('a b d', ' ') r")
    plan = evaluation.bleu_counts(df)._jdf.queryExecution().toString()
    assert "Generate" not in plan
    assert evaluation.bleu_counts(df).where("n = 1").groupBy().sum("hit", "total").first() == (4, 6)
