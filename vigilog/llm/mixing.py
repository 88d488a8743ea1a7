"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by exact length (in words) for each source. A source is repeated as a whole
as often as its target allows; the remaining budget is first spread over its lengths in
proportion, and what that leaves is fitted by bounded-knapsack dynamic programming over the
counts. Which documents of a length are taken is decided by a seeded hash. Only counts by
(source, length) meet in one task, never documents; documents of one length and source are dealt
over salts, so that a large group of copies is ranked in many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from vigilog.llm import common

WEIGHTS = (1, 2, 3)
MOST_REPEATS = 3
SALTS = 256
#: Documents given back before the last fit, so that it has small lengths to choose from.
RESERVE = 64


def words(text: str | Column) -> Column:
    """Number of runs of anything but blanks; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(
    sizes: Sequence[tuple[str | None, int]],
    weights: Sequence[int] = WEIGHTS,
    most: int = MOST_REPEATS,
) -> dict[str | None, float]:
    """Words each source should give, from its size.

    Sources in order of code points, null last, get the weights in turn and share the sum of all
    sizes by them. A target stops at ``most`` times its source's size; the excess is shared anew
    by the others until no target is above.
    """
    ordered = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {name: weights[i % len(weights)] for i, (name, _) in enumerate(ordered)}
    size = dict(ordered)
    left, open_ = Fraction(sum(size.values())), list(size)
    target: dict[str | None, Fraction] = {}
    while open_:
        share = left / sum(weight[name] for name in open_)
        full = [name for name in open_ if share * weight[name] >= most * size[name]]
        if not full:
            target |= {name: share * weight[name] for name in open_}
            break
        for name in full:
            target[name] = Fraction(most * size[name])
            left -= target[name]
        open_ = [name for name in open_ if name not in target]
    return {name: float(value) for name, value in target.items()}


def fit(lengths: Sequence[int], counts: Sequence[int], goal: int) -> list[int]:
    """How many of each length to take so that the words come as near to ``goal`` as possible.

    Lengths are distinct; of two sums equally near the smaller is taken. With at most ``RESERVE`` documents the answer is the best possible.
    """
    total = sum(n * c for n, c in zip(lengths, counts, strict=True))
    if goal >= total:
        return list(counts)
    picks = [c * goal // total for c in counts]
    left = goal - sum(n * p for n, p in zip(lengths, picks, strict=True))
    ascending = sorted((i for i, n in enumerate(lengths) if n > 0), key=lambda i: lengths[i])
    for i in reversed(ascending):
        more = min(counts[i] - picks[i], left // lengths[i])
        # At most one over the proportion at first, so that no length is favoured.
        picks[i] += min(more, 1)
        left -= lengths[i] * min(more, 1)
    for i in reversed(ascending):
        more = min(counts[i] - picks[i], left // lengths[i])
        picks[i] += more
        left -= lengths[i] * more
    spare = RESERVE
    for i in ascending:
        back = min(picks[i], spare)
        picks[i] -= back
        spare -= back
        left += lengths[i] * back
    for i, more in _knapsack([(lengths[i], counts[i] - picks[i], i) for i in ascending], left):
        picks[i] += more
    return picks


def _knapsack(items: list[tuple[int, int, int]], budget: int) -> list[tuple[int, int]]:
    """Numbers of each (length, count, name) whose sum is the nearest to the budget.

    The largest sum not above the budget says how far above it a nearer one may lie.
    """
    below, taken = _fill(items, budget, budget)
    if below == budget:
        return taken
    above, more = _fill(items, budget, 2 * budget - below - 1)
    return more if above > budget else taken


def _fill(items: list[tuple[int, int, int]], budget: int, limit: int) -> tuple[int, list[tuple[int, int]]]:
    """The smallest sum from the budget to the limit, or else the largest below, and its parts.

    Bit s of ``reach`` says that a sum of s words can be made; counts are split into powers of 2.
    """
    reach, mask, steps = 1, (1 << (limit + 1)) - 1, []
    for length, count, name in items:
        left, power = min(count, limit // length), 1
        while left > 0 and not reach >> budget & 1:
            k = min(power, left)
            steps.append((reach, length * k, k, name))
            reach |= (reach << (length * k)) & mask
            left, power = left - k, power * 2
    over = reach >> budget
    best = budget + (over & -over).bit_length() - 1 if over else reach.bit_length() - 1
    at, taken = best, {}
    for before, words_, k, name in reversed(steps):
        if not before >> at & 1:
            at -= words_
            taken[name] = taken.get(name, 0) + k
    return best, list(taken.items())


_PICKS = "_source string, size bigint, picks bigint"


def _pick_lengths(rows: pa.Table) -> pa.Table:
    """The lengths of one source with their counts and the source's remaining budget."""
    ordered = rows.sort_by("size")
    lengths, counts = ordered["size"].to_pylist(), ordered["n"].to_pylist()
    picks = fit(lengths, counts, ordered["budget"][0].as_py())
    return pa.table(
        {"_source": ordered["_source"], "size": ordered["size"], "picks": pa.array(picks, pa.int64())}
    )


def mix(
    docs: DataFrame,
    key: str = "doc_id",
    source: str = "source",
    seed: int = 42,
    weights: Sequence[int] = WEIGHTS,
    most: int = MOST_REPEATS,
) -> DataFrame:
    """Append ``source_size``, ``target``, ``repeats`` and ``taken`` to rows with a ``size``.

    ``taken`` is the size times how often the mix repeats the document (0 to ``most``). Null
    sources are one source, the last. Null keys and repeated rows are fine: equal keys are told
    apart by the other columns, and rows equal in all columns can be swapped. Sizes of 0 are
    taken 0 times their words. An empty table stays empty. ``docs`` is read several times and
    should be a stored table; the list of sources, a part of the mix's definition, is planned on
    the driver. Columns of the input named like the new ones are replaced.
    """
    added = ["source_size", "target", "repeats", "taken"]
    mark = F.xxhash64(F.lit(seed), F.col(key), F.col("size"))
    rows = common.without(docs, [*added, "_source", "_mark", "_salt"])
    rows = rows.withColumns(
        {
            "_source": F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("n")),
            "_mark": mark,
            "_salt": F.pmod(mark, F.lit(SALTS)).cast("int"),
        }
    )
    cells = common.stage(rows.groupBy("_source", "size", "_salt").agg(F.count("*").alias("n")))
    sizes = {
        row["_source"]: row.words
        for row in cells.groupBy("_source").agg(F.sum(F.col("size") * F.col("n")).alias("words")).collect()
    }
    goal = targets([(None if k == "n" else k[1:], v) for k, v in sizes.items()], weights, most)
    plan = []
    for k, words_ in sizes.items():
        target = goal[None if k == "n" else k[1:]]
        wanted = int(target + 0.5)
        whole = min(wanted // words_, most) if words_ else 0
        plan.append((k, words_, target, whole, wanted - whole * words_))
    schema = "_source string, source_size bigint, target double, whole bigint, budget bigint"
    plan = docs.sparkSession.createDataFrame(plan, schema)
    lengths = cells.groupBy("_source", "size").agg(F.sum("n").alias("n"))
    lengths = lengths.join(plan.select("_source", "budget"), "_source")
    picks = lengths.groupBy("_source").applyInArrow(_pick_lengths, _PICKS)
    # Salts of a length are used up in their order, so only one is taken in part.
    before = Window.partitionBy("_source", "size").orderBy("_salt")
    quota = F.col("picks") - F.sum("n").over(before) + F.col("n")
    quotas = cells.join(picks, ["_source", "size"]).select(
        "_source", "size", "_salt", F.greatest(F.lit(0), F.least(quota, "n")).alias("quota")
    )
    cell = ["_source", "size", "_salt"]
    ties = [f"`{c}`" for c, kind in rows.dtypes if not c.startswith("_") and kind != "variant" and "map<" not in kind]
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*cell).orderBy("_mark", *ties)))
    found = ranked.join(common.stage(quotas), cell).join(plan, "_source")
    repeats = F.col("whole") + (F.col("_rank") <= F.col("quota")).cast("long")
    found = found.withColumn("repeats", F.least(repeats, F.lit(most).cast(T.LongType())))
    found = found.withColumn("taken", F.col("size") * F.col("repeats"))
    return found.select(*[f"`{c}`" for c in rows.columns if c not in ("_source", "_mark", "_salt")], *added)
