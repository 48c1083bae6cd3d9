"""Mixing sources to target weights: iterative proportional fitting of token weights, then sampling of documents."""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelweave.llm.shared import small, stored

MARGINS = ("source", "lang", "topic")
SWEEPS = 12
#: Sweeps between two written tables; the plan between them stays short.
STORED_EVERY = 2
#: Cells that are fitted on the driver at most; more are fitted as a table, with the same result.
LOCAL_CELLS = 50_000
#: A probability is above 1 from here on; less is rounding.
ABOVE = 1e-9


def tempered(cells: DataFrame, margin: str, power: float) -> DataFrame:
    """Target shares in proportion to the tokens of each value to ``power``: below 1, small values gain."""
    totals = cells.groupBy(margin).agg(F.sum("tokens").cast("double").alias("tokens"))
    lifted = totals.select(margin, F.pow("tokens", F.lit(power)).alias("lifted"))
    total = lifted.agg(F.sum("lifted")).first()[0] or 1.0
    return lifted.select(margin, (F.col("lifted") / total).alias("share"))


def raked(cells: DataFrame, targets: Mapping[str, DataFrame], sweeps: int = SWEEPS) -> DataFrame:
    """``cells`` (margins, tokens) with a weight, so that weight times tokens meets every margin's target shares.

    A sweep scales each margin in turn. ``targets`` has a table (margin, share) per margin; a value without target gets
    none of the mixture. Sums combine before they shuffle, and come back by an equi-join that Spark broadcasts if small.
    """
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    now = cells.withColumn("weight", F.lit(1.0))
    for sweep in range(sweeps):
        for margin, shares in targets.items():
            mass = now.groupBy(margin).agg(F.sum(F.col("tokens") * F.col("weight")).alias("mass"))
            factor = mass.join(shares, margin, "left").select(
                margin,
                F.when(F.col("mass") > 0, F.coalesce("share", F.lit(0.0)) * total / F.col("mass"))
                .otherwise(0.0)
                .alias("factor"),
            )
            now = now.join(factor, margin).withColumn("weight", F.col("weight") * F.col("factor")).drop("factor")
        if sweep % STORED_EVERY == STORED_EVERY - 1 or sweep == sweeps - 1:
            now = stored(now, "weights")
    return now


def fitted_cells(cells: DataFrame, rows: pd.DataFrame, name: str, values: np.ndarray) -> DataFrame:
    """Margins of ``rows`` and a column of numbers, as an Arrow table: a list of rows would go through an RDD, for which
    every executor starts Python workers of another kind that stay in its memory."""
    columns = {m: pa.array([str(v) for v in rows[m]], pa.string()) for m in MARGINS}
    return cells.sparkSession.createDataFrame(pa.table({**columns, name: pa.array(values, pa.float64())}))


def raked_here(cells: DataFrame, targets: Mapping[str, DataFrame], sweeps: int = SWEEPS) -> DataFrame:
    """As ``raked``, in numpy, for no more than ``LOCAL_CELLS`` cells."""
    rows = cells.select(*MARGINS, "tokens").toPandas().sort_values(list(MARGINS)).reset_index(drop=True)
    tokens = rows["tokens"].to_numpy(float)
    weight = np.ones(len(rows))
    margins = []
    for margin, shares in targets.items():
        share = {r[margin]: r["share"] for r in shares.collect()}
        values, number = np.unique(rows[margin].to_numpy(object).astype(str), return_inverse=True)
        margins.append((number, np.array([share.get(v, 0.0) for v in values]) * tokens.sum()))
    for _ in range(sweeps):
        for number, wanted in margins:
            mass = np.bincount(number, weights=tokens * weight, minlength=len(wanted)).astype(float)
            weight *= np.divide(wanted, mass, out=np.zeros_like(mass), where=mass > 0)[number]
    return fitted_cells(cells, rows, "weight", weight)


def reachable(cells: DataFrame, targets: Mapping[str, DataFrame], mass: float) -> dict[str, DataFrame]:
    """Per margin the tokens wanted of each value (margin, wanted): its share of ``mass``, but no more than it has.

    What a value lacks goes to the others of its margin in proportion to their shares.
    """
    wanted = {}
    for margin, shares in targets.items():
        tokens = cells.groupBy(margin).agg(F.sum("tokens").cast("double").alias("tokens"))
        values = stored(tokens.join(shares, margin, "left").na.fill(0.0, ["share"]), "values")
        scale, full = mass, -1
        while True:
            over = F.col("share") * scale >= F.col("tokens")
            held = values.agg(
                F.count(F.when(over, 1)).alias("n"), F.sum(F.when(over, F.col("tokens"))).alias("tokens"),
                F.sum(F.when(~over, F.col("share"))).alias("share"),
            ).first()
            if held["n"] <= full or not held["share"]:
                break
            full, scale = held["n"], (mass - (held["tokens"] or 0.0)) / held["share"]
        wanted[margin] = stored(values.select(margin, F.least("tokens", F.col("share") * scale).alias("wanted")), "wanted")
    return wanted


def bounded(cells: DataFrame, wanted: Mapping[str, DataFrame], sweeps: int = SWEEPS) -> DataFrame:
    """``cells`` (margins, tokens) with a probability of 1 at most, so that probability times tokens is what is wanted.

    After ``sweeps`` sweeps, cells above 1 are fixed at 1, their tokens leave every margin's target, and the other cells are
    raked on, until none is above 1.
    """
    now = cells.withColumn("p", F.lit(1.0)).withColumn("fixed", F.lit(False))
    while True:
        for sweep in range(sweeps):
            for margin, aims in wanted.items():
                sums = now.groupBy(margin).agg(
                    F.sum(F.when(~F.col("fixed"), F.col("tokens") * F.col("p"))).alias("mass"),
                    F.sum(F.when(F.col("fixed"), F.col("tokens")).otherwise(0)).alias("held"),
                )
                left = F.greatest(F.lit(0.0), F.coalesce("wanted", F.lit(0.0)) - F.col("held"))
                factor = sums.join(aims, margin, "left").select(
                    margin, F.when(F.col("mass") > 0, left / F.col("mass")).otherwise(0.0).alias("factor")
                )
                scaled = F.when(F.col("fixed"), F.lit(1.0)).otherwise(F.col("p") * F.col("factor"))
                now = now.join(factor, margin).withColumn("p", scaled).drop("factor")
            if sweep % STORED_EVERY == STORED_EVERY - 1 or sweep == sweeps - 1:
                now = stored(now, "weights")
        above = ~F.col("fixed") & (F.col("p") > 1 + ABOVE)
        if now.filter(above).isEmpty():
            return now.withColumn("probability", F.least(F.lit(1.0), "p")).drop("p", "fixed")
        now = now.withColumn("fixed", F.col("fixed") | above).withColumn("p", F.when(F.col("fixed"), 1.0).otherwise(F.col("p")))


def bounded_here(cells: DataFrame, wanted: Mapping[str, DataFrame], sweeps: int = SWEEPS) -> DataFrame:
    """As ``bounded``, in numpy, for no more than ``LOCAL_CELLS`` cells."""
    rows = cells.select(*MARGINS, "tokens").toPandas().sort_values(list(MARGINS)).reset_index(drop=True)
    tokens = rows["tokens"].to_numpy(float)
    p, fixed = np.ones(len(rows)), np.zeros(len(rows), bool)
    margins = []
    for margin, aims in wanted.items():
        aim = {r[margin]: r["wanted"] for r in aims.collect()}
        values, number = np.unique(rows[margin].to_numpy(object).astype(str), return_inverse=True)
        margins.append((number, np.array([aim.get(v, 0.0) for v in values])))
    while True:
        for _ in range(sweeps):
            for number, aim in margins:
                mass = np.bincount(number, weights=np.where(fixed, 0.0, tokens * p), minlength=len(aim)).astype(float)
                held = np.bincount(number, weights=np.where(fixed, tokens, 0.0), minlength=len(aim)).astype(float)
                factor = np.divide(np.maximum(aim - held, 0.0), mass, out=np.zeros_like(mass), where=mass > 0)
                p = np.where(fixed, 1.0, p * factor[number])
        above = ~fixed & (p > 1 + ABOVE)
        if not above.any():
            break
        fixed |= above
        p[fixed] = 1.0
    return fitted_cells(cells, rows, "probability", np.minimum(p, 1.0))


def uniform(key: Column, seed: str) -> Column:
    """A number from 0 to 1 that a document has in every run."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary")), 1, 8)
    return F.conv(digits, 16, 10).cast("double") / float(1 << 32)


def n_words(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")


def mixture(
    docs: DataFrame,
    topics: DataFrame | None = None,
    budget: float = 0.5,
    power: float = 0.7,
    sweeps: int = SWEEPS,
    seed: str = "mix",
    local_cells: int = LOCAL_CELLS,
) -> DataFrame:
    """Weight and decision of every document: doc_id, source, lang, topic, n_tokens, weight, probability, sampled.

    Tokens are words between ASCII spaces. The shares of sources, languages and topics are raked to their token counts to
    ``power``, which gives the weight. The probabilities of cells are raked to the same shares of ``budget`` of all tokens
    under the bound of 1, so the tokens expected of the sample meet them too; a value that has fewer tokens than that is
    taken whole, and the others of its margin share the rest (``reached`` compares). The decision depends on the id and the
    seed alone, so it is the same in every run, and equal ids fare alike. ``topics`` (doc_id, topic) may miss documents; repeated ids
    take their smallest topic. Null source, lang and topic are the value ``none``; a document of no words weighs nothing
    and is taken as its cell is; a null id counts in the weights and is never taken. Other columns are ignored.
    """
    words = docs.select(
        "doc_id", F.coalesce(F.col("source").cast("string"), F.lit("none")).alias("source"),
        F.coalesce(F.col("lang").cast("string"), F.lit("none")).alias("lang"), n_words(F.col("text")).alias("n_tokens"),
    )
    if topics is None:
        counted = words.withColumn("topic", F.lit("none"))
    else:
        one = topics.filter("doc_id is not null").groupBy("doc_id").agg(F.min(F.col("topic").cast("string")).alias("topic"))
        counted = words.join(one, "doc_id", "left").withColumn("topic", F.coalesce("topic", F.lit("none")))
    counted = stored(counted, "tokens")
    cells = stored(counted.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens")), "cells")
    targets = {m: stored(tempered(cells, m, power), "shares") for m in MARGINS}
    few = cells.limit(local_cells + 1).count() <= local_cells
    fitted = (raked_here if few else raked)(cells, targets, sweeps)
    wanted = reachable(cells, targets, budget * float(cells.agg(F.sum("tokens")).first()[0] or 0))
    taken = (bounded_here if few else bounded)(cells, wanted, sweeps)
    weights = stored(
        fitted.select(*MARGINS, F.round("weight", 9).alias("weight")).join(
            taken.select(*MARGINS, F.round("probability", 9).alias("probability")), list(MARGINS)
        ),
        "cell_weights",
    )
    return counted.join(weights, list(MARGINS)).select(
        "doc_id", *MARGINS, "n_tokens", "weight", "probability",
        F.coalesce(uniform(F.col("doc_id"), seed) < F.col("probability"), F.lit(False)).alias("sampled"),
    )


def reached(mixed: DataFrame, budget: float = 0.5, power: float = 0.7) -> DataFrame:
    """Margins of a ``mixture``: margin, value, tokens, aim (share of the budget), expected (tokens of the sample).

    ``aim`` above ``tokens`` can't be reached; ``expected`` off ``aim`` beside that is what these values left over, or
    margins that no probabilities meet together.
    """
    rows = None
    for margin in MARGINS:
        sums = mixed.groupBy(F.col(margin).alias("value")).agg(
            F.sum("n_tokens").alias("tokens"), F.sum(F.col("n_tokens") * F.col("probability")).alias("expected")
        )
        total = sums.agg(F.sum("tokens").alias("all"), F.sum(F.pow("tokens", F.lit(power))).alias("lifted"))
        aim = F.pow("tokens", F.lit(power)) / F.col("lifted") * F.col("all") * budget
        part = sums.crossJoin(total).select(F.lit(margin).alias("margin"), "value", "tokens", aim.alias("aim"), "expected")
        rows = part if rows is None else rows.unionByName(part)
    return rows


def sampled(docs: DataFrame, topics: DataFrame | None = None, **options) -> DataFrame:
    """Rows of ``docs`` that the mixture takes. Texts stay where they are while the ids taken are few enough to broadcast."""
    taken = mixture(docs, topics, **options).filter("sampled").select("doc_id").distinct()
    return docs.join(small(stored(taken, "taken")), "doc_id", "left_semi").select(docs.columns)
