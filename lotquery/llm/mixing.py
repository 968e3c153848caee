"""Mixing sources to target weights by temperature.

A source's weight is its share of all tokens raised to an exponent, normalised.
Exponent 1 keeps the natural mix, 0 gives every source the same weight.  The
exponent is bisected to meet a target: an entropy of the weights, or a limit on
how often a document repeats.  Weights are realised as block permutations: each
source is read in passes, each pass a permutation of its documents in hash
blocks, until the source's token budget is spent.

DataFrame and SQL functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotquery.llm.common import stored

#: Exponents tried are multiples of 1 / GRID; one job tries SECTIONS - 1 of
#: them, as many as five bisections could reach.
GRID = 1 << 20
SECTIONS = 32
#: Hex digits of a copy's key that name its block: 4096 blocks in a pass.
BLOCK_DIGITS = 3
MAX_REPETITION = 1.25
WORDS = r"[^\x20\x09-\x0D]+"


def _met(positive: DataFrame, total: float, most: float, steps: list[int], entropy: float | None,
         max_repetition: float | None) -> dict[int, bool]:
    """For each exponent step / GRID: is the entropy too low, or the repetition low enough?"""
    tried = (positive.select("tokens", F.explode(F.array(*map(F.lit, steps))).alias("k"))
             .selectExpr("k", f"power(tokens / {total!r}D, k / {GRID}D) AS p", f"power(tokens / {most!r}D, k / {GRID}D - 1) AS r")
             .groupBy("k").agg(F.sum("p").alias("z"), F.sum(F.expr("p * ln(p)")).alias("plogp"), F.max("r").alias("r")))
    met = f"ln(z) - plogp / z < {entropy!r}D" if entropy is not None else f"r <= {max_repetition!r}D"
    return {k: ok for k, ok in tried.selectExpr("k", met).collect()}  # one row for each step


def fit_exponent(sources: DataFrame, entropy: float | None = None, max_repetition: float | None = None) -> float:
    """The exponent in [0, 1] that meets the target, by bisection: the largest
    whose weights have an entropy of ``entropy`` or more (0 if none has), or
    the least for which no source is passed over more than ``max_repetition``
    (1 or more) times as often as the largest.  ``sources``: column tokens."""
    positive = sources.filter("tokens > 0")
    total, most = positive.agg(F.sum("tokens").cast("double"), F.max("tokens").cast("double")).first()
    if total is None:
        return 1.0
    low, high = -1, GRID + (entropy is not None)
    while high - low > 1:
        steps = sorted({low + (high - low) * i // SECTIONS for i in range(1, SECTIONS)} - {low, high} or {low + 1})
        met = _met(positive, total, most, steps, entropy, max_repetition)
        high = min([high, *(k for k in steps if met[k])])
        low = max([low, *(k for k in steps if not met[k] and k < high)])
    return (max(0, high - 1) if entropy is not None else high) / GRID


def _key(pass_number) -> F.Column:
    return F.md5(F.concat_ws("|", pass_number.cast("string"), F.col("doc_id").cast("string"), "_body"))


def mix_sources(docs: DataFrame, entropy: float | None = None, max_repetition: float = MAX_REPETITION,
                budget: int | None = None) -> DataFrame:
    """The mix of ``docs`` (doc_id, text, source, ...): their columns and, for
    each copy taken, mix_tokens, mix_weight (its source's), mix_pass (from 0),
    mix_block and mix_key; (mix_pass, mix_block, mix_key) orders a source.

    With ``entropy`` (natural log) the weights have that entropy, otherwise
    ``max_repetition`` holds.  A source's budget is its weight of ``budget``
    tokens, rounded; by default of the least budget that reads every source
    whole once, so nothing is lost.  A copy is taken if fewer tokens than the
    source's budget stand before it.  Tokens are words between ASCII white
    space; a null text has none.  Null is a source like others.  A source
    without tokens is taken once, whole.  Equal rows share their place in a
    pass.  Columns of ``docs`` named like the five results are replaced, others
    stay whatever their names.  An empty table gives an empty result.
    """
    made = ["mix_tokens", "mix_weight", "mix_pass", "mix_block", "mix_key"]
    own = [c for c in docs.columns if c not in made]
    text = F.coalesce("text", F.lit(""))
    # The columns of docs travel as one struct, so their names meet none of those used here.
    rows = docs.select("doc_id", "source", F.regexp_count(text, F.lit(WORDS)).cast("long").alias("mix_tokens"),
                       F.md5(text.cast("binary")).alias("_body"), F.struct(*[F.col(f"`{c}`").alias(f"{i}") for i, c in enumerate(own)]).alias("_row"))
    narrow = stored(rows.select("doc_id", "source", "mix_tokens", "_body"), "mix-rows")
    sources = stored(narrow.groupBy("source").agg(F.sum("mix_tokens").alias("tokens")), "mix-sources")
    exponent = fit_exponent(sources, entropy, max_repetition)

    power = F.pow(F.col("tokens"), F.lit(exponent))
    weights = stored(sources.select("source", "tokens", (
        F.when(F.col("tokens") > 0, power).otherwise(0.0) / sources.filter("tokens > 0").agg(F.sum(power)).scalar()).alias("weight")), "mix-weights")
    whole = F.lit(float(budget)) if budget is not None else F.lit(
        weights.filter("tokens > 0").agg(F.max(F.col("tokens") / F.col("weight"))).first()[0] or 0.0)
    quotas = stored(weights.withColumn("_quota", F.round(F.col("weight") * whole).cast("long"))
                    .withColumn("_full", F.expr("CASE WHEN tokens > 0 THEN _quota div tokens ELSE 1 END"))
                    .withColumn("_rest", F.expr("CASE WHEN tokens > 0 THEN _quota % tokens ELSE 0 END"))
                    .select("source", "weight", "_full", "_rest"), "mix-quotas")

    # The last, partial pass ends at a key of each source: found by blocks, then inside one block.
    keyed = (narrow.join(quotas, narrow["source"].eqNullSafe(quotas["source"])).filter("_rest > 0")
             .select(narrow["source"], "mix_tokens", "_rest", _key(F.col("_full")).alias("_k"))
             .withColumn("_block", F.substring("_k", 1, BLOCK_DIGITS)))
    blocks = (keyed.groupBy("source", "_block", "_rest").agg(F.sum("mix_tokens").alias("_sum"))
              .selectExpr("source AS _s", "_block AS _b", "_rest",
                          "sum(_sum) OVER (PARTITION BY source ORDER BY _block) - _sum AS _before")
              .filter("_before < _rest")
              .groupBy("_s").agg(F.max(F.struct("_b", "_before")).alias("_edge")))
    edge = (keyed.join(blocks, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_block") == F.col("_edge._b")))
            .groupBy("_s", "_rest", "_edge", "_k").agg(F.sum("mix_tokens").alias("_sum"))
            .selectExpr("_s", "_rest", "_k",
                        "_edge._before + sum(_sum) OVER (PARTITION BY _s ORDER BY _k) - _sum AS _before")
            .filter("_before < _rest").groupBy("_s").agg(F.max("_k").alias("_last")))
    plan = stored(quotas.join(edge, F.col("source").eqNullSafe(F.col("_s")), "left")
                  .select("source", "weight", "_full", "_last"), "mix-plan")

    taken = (rows.join(plan, rows["source"].eqNullSafe(plan["source"]))
             .select("doc_id", "mix_tokens", "_body", "_row", F.col("weight").alias("mix_weight"), "_full",
                     (F.col("_full") + F.coalesce((_key(F.col("_full")) <= F.col("_last")).cast("long"), F.lit(0)))
                     .alias("_copies")))
    return (taken.withColumn("mix_pass", F.explode(F.expr("CASE WHEN _copies > 0 THEN sequence(0L, _copies - 1) ELSE array() END")))
            .withColumn("mix_key", _key(F.col("mix_pass")))
            .withColumn("mix_block", F.substring("mix_key", 1, BLOCK_DIGITS))
            .select(*[F.col(f"_row.`{i}`").alias(c) for i, c in enumerate(own)], *made))
