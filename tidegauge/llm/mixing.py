"""Mixing sources to target weights by raking.

Documents are counted into cells of all dimensions (say source, language and topic), with
their tokens as weight. Iterative proportional fitting gives every value of every dimension
a factor; a cell's probability is the product of its factors, at most 1. Each sweep goes
over the dimensions and sets each value's factor so that the expected tokens of the value,
with those of its cells that are whole at 1 left as they are and the others scaled, are its
target. So cells that run out are raked again with all others, until the shares agree.

The expected tokens are the wanted part of all tokens, or less: no value can give more than
it has, so the part is at most the least ratio of a value's share of all tokens to its
target. It is not lowered below ``least_part`` for that, else a value with next to no tokens
would leave next to nothing of the others; at that part, values that run out are taken
whole, and the others keep their proportions to each other. Where targets are not met within
``TOLERANCE`` even so, as the values of several dimensions stand in each other's way, the
largest of ``FRACTIONS`` of the part is taken at which they are (if there is none, that with
the smallest deviation). ``shares`` returns what is reached. A document is taken if a hash
of its id, uniform in [0, 1), is below its probability, so a lost task takes the same
documents again.

Cells are a table with one row per combination of values that occurs. Up to ``FEW_CELLS``
of them are raked in numpy, each fraction in a task; more by exchanges on the values.

Definitions. A null value of a dimension is a value of its own. Target shares are taken
relative to each other over the values that have tokens. Documents without tokens have
probability 0. Rows with equal ids fall together. Extra columns of any name pass through,
except that ``probability`` and ``sampled`` are replaced; a dimension may not be called
``tokens``, by which targets know a value's tokens. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.functions.common import hash_uniform, require
from tidegauge.llm.common import by_value, own_name, release, saved

SWEEPS = 16
LEAST_PART = 0.1
TOLERANCE = 0.001
FRACTIONS = (1.0, 0.75, 0.5, 0.25)
FEW_CELLS = 20_000
#: Factors stay between this and its inverse, so that products of a few are finite.
LEAST = 1e-90
#: Sweeps that are planned together.
PLANNED = 2


def tempered(power: float) -> Column:
    """A target in proportion to a power of a value's tokens; 0 makes all values equal."""
    return F.pow(F.col("tokens"), F.lit(power))


def listed(column: str, shares: Mapping[str, float], other: float = 0.0) -> Column:
    """Given shares of the values of ``column``."""
    out = F.lit(float(other))
    for value, share in shares.items():
        out = F.when(F.col(column) == value, F.lit(float(share))).otherwise(out)
    return out


def cells_of(docs: DataFrame, dimensions: list[str], tokens: str) -> DataFrame:
    """``d0``, ``d1``, ... and ``tokens`` of each combination of values that has any."""
    keys = [F.col(f"`{n}`").alias(f"d{i}") for i, n in enumerate(dimensions)]
    return docs.groupBy(*keys).agg(F.sum(tokens).alias("tokens")).where(F.col("tokens") > 0)


def with_targets(cells: DataFrame, targets: Mapping[str, Column], part: float, least_part: float) -> DataFrame:
    """Every cell, for each of ``FRACTIONS``, with its ``part`` and ``t0``, ``t1``, ...: the share of all sampled
    tokens that the cell's value of each dimension is to have."""
    wanted_of = []
    for i, (name, wanted) in enumerate(targets.items()):
        values = cells.groupBy(F.col(f"d{i}").alias(name)).agg(F.sum("tokens").alias("tokens"))
        whole = Window.partitionBy()
        values = values.select(F.col(f"`{name}`").alias("_value"), "tokens", wanted.alias("_wanted"))
        wanted_of.append(saved(
            values.select(
                "_value", (F.col("tokens") / F.sum("tokens").over(whole)).alias("_share"),
                (F.col("_wanted") / F.sum("_wanted").over(whole)).alias("_target")),
            "mixing-values"))
    bounds = [v.agg(F.min(F.col("_share") / F.col("_target"))).first()[0] for v in wanted_of]
    largest = min([float(part), *[max(b, least_part) for b in bounds if b is not None]])
    cells = cells.withColumn("fraction", F.explode(F.array(*[F.lit(x) for x in FRACTIONS])))
    cells = cells.withColumn("part", F.lit(largest) * F.col("fraction"))
    for i, values in enumerate(wanted_of):
        values = values.withColumn("_of", F.explode(F.array(*[F.lit(x) for x in FRACTIONS])))
        values = values.withColumn("_most", F.col("_share") / (F.lit(largest) * F.col("_of")))
        # Targets are raised alike until those that are not cut at what there is make up for the rest.
        by = Window.partitionBy("_of").orderBy(F.desc(F.col("_target") / F.col("_most")))
        before = F.coalesce(F.sum("_most").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        rest = F.sum("_target").over(by.rowsBetween(0, Window.unboundedFollowing))
        values = values.withColumn("_raise", (1 - before) / rest)
        raised = F.max("_raise").over(Window.partitionBy("_of")) * F.col("_target")
        values = values.withColumn(f"t{i}", F.least("_most", raised)).select("_value", "_of", f"t{i}")
        same = F.col(f"d{i}").eqNullSafe(F.col("_value")) & (F.col("fraction") == F.col("_of"))
        cells = cells.join(values, same).drop("_value", "_of")
    return cells


def _product(names: list[str]) -> Column:
    return reduce(lambda a, b: a * b, [F.col(n) for n in names])


def _solved(cells: pd.DataFrame, dimensions: int, sweeps: int) -> pd.DataFrame:
    """``probability`` of the cells of one fraction."""
    tokens = cells["tokens"].to_numpy(np.float64)
    factors = np.ones((dimensions, len(cells)))
    wanted = [cells[f"t{i}"].to_numpy() * cells["part"].to_numpy() * tokens.sum() for i in range(dimensions)]
    codes = [pd.factorize(cells[f"d{i}"], use_na_sentinel=False)[0] for i in range(dimensions)]
    values = [np.split(np.argsort(c, kind="stable"), np.cumsum(np.bincount(c))[:-1]) for c in codes]
    for _ in range(sweeps):
        for i in range(dimensions):
            others = np.prod(np.delete(factors, i, axis=0), axis=0)
            for own in values[i]:
                own = own[np.argsort(-others[own], kind="stable")]
                # If the cells before one are whole, the others have this factor; the true one is the largest.
                before = np.concatenate([[0.0], np.cumsum(tokens[own])[:-1]])
                rest = np.cumsum((others[own] * tokens[own])[::-1])[::-1]
                factors[i, own] = min(1 / LEAST, max(LEAST, ((wanted[i][own] - before) / rest).max()))
    return cells.assign(probability=np.minimum(1.0, factors.prod(axis=0)))


def _raked_in_task(cells: DataFrame, dimensions: int, sweeps: int) -> DataFrame:
    schema = T.StructType([*cells.schema.fields, T.StructField("probability", T.DoubleType())])
    return cells.groupBy("fraction").applyInPandas(lambda group: _solved(group, dimensions, sweeps), schema)


def rake(cells: DataFrame, dimensions: int, sweeps: int = SWEEPS) -> DataFrame:
    """Add ``probability`` to the cells of each fraction, by exchanges on the values."""
    every = range(dimensions)
    out = cells.withColumn("_total", F.sum("tokens").over(Window.partitionBy("fraction")).cast("double"))
    out = out.withColumns({f"f{i}": F.lit(1.0) for i in every})
    for sweep in range(sweeps):
        for i in every:
            own = Window.partitionBy("fraction", f"d{i}")
            by = own.orderBy(F.desc("_others"))
            before = F.coalesce(F.sum("tokens").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
            rest = F.sum(F.col("_others") * F.col("tokens")).over(by.rowsBetween(0, Window.unboundedFollowing))
            wanted = F.col(f"t{i}") * F.col("part") * F.col("_total")
            others = [f"f{j}" for j in every if j != i]
            out = out.withColumn("_others", _product(others) if others else F.lit(1.0))
            out = out.withColumn("_own", (wanted - before) / rest)
            best = F.least(F.lit(1 / LEAST), F.greatest(F.lit(LEAST), F.max("_own").over(own)))
            out = out.withColumn(f"f{i}", best).drop("_others", "_own")
        if sweep % PLANNED == PLANNED - 1:
            out = saved(out, "raking")
            release(out)
    return out.withColumn("probability", F.least(F.lit(1.0), _product([f"f{i}" for i in every])))


def _few(cells: DataFrame) -> bool:
    return cells.limit(FEW_CELLS + 1).count() <= FEW_CELLS


def chosen(raked: DataFrame, dimensions: int, tolerance: float = TOLERANCE) -> DataFrame:
    """The cells at the largest fraction whose shares meet the targets."""
    expected = F.col("probability") * F.col("tokens")
    raked = raked.withColumn("_expected", F.sum(expected).over(Window.partitionBy("fraction")))
    away = [
        F.abs(F.sum(expected).over(Window.partitionBy("fraction", f"d{i}")) / F.col("_expected") - F.col(f"t{i}"))
        for i in range(dimensions)
    ]
    raked = raked.withColumn("_away", F.greatest(*away) if dimensions > 1 else away[0])
    away = F.max("_away").over(Window.partitionBy("fraction"))
    raked = raked.withColumn("_rank", F.when(away <= tolerance, -F.col("fraction")).otherwise(away))
    raked = raked.withColumn("_first", F.min("_rank").over(Window.partitionBy()))
    return raked.where(F.col("_rank") == F.col("_first")).drop("_expected", "_away", "_rank", "_first")


def mix(docs: DataFrame, targets: Mapping[str, Column], tokens: str, part: float, seed: int = 0,
        id_col: str = "doc_id", sweeps: int = SWEEPS, least_part: float = LEAST_PART) -> DataFrame:
    """All documents with ``probability`` and ``sampled``. ``targets`` has the wanted weight of each
    dimension's values, as a column of ``tokens`` (those of the value) or of the value."""
    names = list(targets)
    require("tokens" not in names, "a dimension may not be called tokens")
    docs = docs.drop("probability", "sampled")
    cells = saved(cells_of(docs, names, tokens), "cells")
    few = _few(cells)
    cells = saved(with_targets(cells, targets, part, least_part), "cell-targets")
    raked = (_raked_in_task if few else rake)(cells, len(names), sweeps)
    found = saved(chosen(raked, len(names)), "raked")
    keys = {n: own_name(docs.columns, f"cell_{n}") for n in names}
    chance = own_name(docs.columns, "chance")
    found = found.select(
        *[F.col(f"d{i}").alias(k) for i, k in enumerate(keys.values())], F.col("probability").alias(chance))
    same = F.lit(True)
    for n, k in keys.items():
        same = same & docs[f"`{n}`"].eqNullSafe(found[k])
    own = F.when(F.col(f"`{tokens}`") > 0, F.col(chance)).otherwise(0.0)
    return (
        docs.join(F.broadcast(found) if _few(found) else found, same, "left")
        .withColumn("probability", F.coalesce(own, F.lit(0.0)))
        .drop(*keys.values(), chance)
        .withColumn("sampled", hash_uniform(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")), seed=seed)
                    < F.col("probability"))
    )


def shares(mixed: DataFrame, targets: Mapping[str, Column], tokens: str) -> DataFrame:
    """``dimension``, ``value``, and its shares: of all tokens, ``target``, ``expected`` and ``sampled``."""
    out = []
    for name, wanted in targets.items():
        per = mixed.where(F.col(f"`{tokens}`") > 0).groupBy(F.col(f"`{name}`").alias(name)).agg(
            F.sum(tokens).alias("tokens"), F.sum(F.col(tokens) * F.col("probability")).alias("_expected"),
            F.sum(F.when(F.col("sampled"), F.col(tokens)).otherwise(0)).alias("_sampled"))
        per = per.select(
            F.lit(name).alias("dimension"), F.col(f"`{name}`").cast("string").alias("value"),
            F.col("tokens").alias("all"), wanted.alias("target"), F.col("_expected").alias("expected"),
            F.col("_sampled").alias("sampled"))
        whole = Window.partitionBy("dimension")
        out.append(per.select(
            "dimension", "value",
            *[(F.col(c) / F.sum(c).over(whole)).alias(c) for c in ("all", "target", "expected", "sampled")]))
    return reduce(DataFrame.unionByName, out)


by_value(__name__)
