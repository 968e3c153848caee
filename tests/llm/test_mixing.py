import math

import pytest
from pyspark.sql import functions as F

from lotquery.llm.mixing import GRID, fit_exponent, mix_sources


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, "w " * (1 + i % 9), "big" if i % 3 else f"s{i % 6}", i) for i in range(900)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, mix_extra long").repartition(5)


def weights(tokens, a):
    p = [t ** a for t in tokens]
    return [x / sum(p) for x in p]


def test_exponents(spark):
    tokens = [5_000, 900, 40, 3]
    df = spark.createDataFrame([(t,) for t in [*tokens, 0]], "tokens long")
    entropy = lambda a: -sum(w * math.log(w) for w in weights(tokens, a))
    a = fit_exponent(df, entropy=1.1)
    assert entropy(a) >= 1.1 > entropy(a + 1 / GRID)
    assert fit_exponent(df, entropy=9.0) == 0 and fit_exponent(df, entropy=0.0) == 1
    a = fit_exponent(df, max_repetition=3.0)
    passes = lambda a: max(w / t for w, t in zip(weights(tokens, a), tokens)) / (weights(tokens, a)[0] / tokens[0])
    assert passes(a) <= 3.0 < passes(a - 1 / GRID)
    assert fit_exponent(df, max_repetition=1.0) == 1 and fit_exponent(df.limit(0)) == 1


@pytest.mark.parametrize("target", [{"max_repetition": 2.0}, {"entropy": 1.3}, {"entropy": 1.2, "budget": 3_000}])
def test_budgets_are_met(docs, target):
    own = {r.source: (r.n, r.t) for r in docs.groupBy("source").agg(
        F.count("*").alias("n"), F.sum(F.length("text") / 2).cast("long").alias("t")).collect()}
    got = mix_sources(docs, **target).collect()
    assert got[0].__fields__[:4] == docs.columns
    whole = target.get("budget") or max(t / w for (_, t), w in ((own[r.source], r.mix_weight) for r in got))
    for source, (n, t) in own.items():
        taken = [r for r in got if r.source == source]
        quota = round(taken[0].mix_weight * whole)
        assert quota <= sum(r.mix_tokens for r in taken) < quota + 9
        full, last = quota // t, [r for r in taken if r.mix_pass == quota // t]
        assert all(sum(r.mix_pass == p for r in taken) == n for p in range(full)) and len(taken) == full * n + len(last)
        orders = [[r.doc_id for r in sorted(taken, key=lambda r: (r.mix_block, r.mix_key)) if r.mix_pass == p] for p in range(full)]
        assert all(sorted(set(o)) == sorted(o) for o in orders) and len({tuple(o) for o in orders}) == len(orders)
    if "budget" not in target:
        assert {r.doc_id for r in got} == set(range(900))


def test_plan_is_native(docs):
    plan = mix_sources(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
