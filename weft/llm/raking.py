"""Mixing sources to target weights: token weights are raked to the marginals of source, language and topic.

1. Tokens are summed by cell (source, language, topic): a map-side sum, so a hot source costs no more.
2. Iterative proportional fitting scales the cells' weights until the sums over each of the three match its target.
   Every name is a name of its own, however many there are: up to CELLS cells are fitted in arrays on the driver, more
   than that as tables, a join and a sum for each margin and round. Both give the same weights.
3. A document's probability is its cell's weight over its tokens times a constant that makes the largest (or the
   budget) fit; a hash of doc_id decides, so a repeated run or a lost executor draws the same documents.

Targets can contradict each other (a source all in one language, and more wanted of the one than of the other). Then
the sums go round in circles and no weights meet all targets; the weights of the last round stand, all finite, and
the margin that is off is named: in a warning, or with `strict` in an error."""

from __future__ import annotations

import warnings
from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.base import WORD, durable, forget, fresh
from weft.plans.durable import counted

MARGINS = ("source", "lang", "topic")
#: Most cells that are fitted on the driver, a few MB. No cell is left out beyond.
CELLS = 100_000
TEMPER, SEED = 0.8, 5
ROUNDS, CLOSE, OFF = 200, 1e-9, 1e-3
NONE = "(none)"


def topic_of(text: Column) -> Column:
    """The default topic, by form: table, notice, contact or prose; none for a text without words."""
    low = F.lower(text)
    return (
        F.when(text.isNull() | ~text.rlike(WORD), NONE)
        .when(F.contains(text, F.lit(" | ")), "table")
        .when(F.contains(low, F.lit("license")) | F.contains(low, F.lit("copyright")), "notice")
        .when(F.contains(text, F.lit("@")), "contact")
        .otherwise("prose")
    )


def tokens_of(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def tempered(shares: Mapping[str, float], power: float = TEMPER) -> dict[str, float]:
    """Shares flattened by a power below 1, summing to 1."""
    raised = {k: v**power for k, v in shares.items() if v > 0}
    total = sum(raised.values())
    return {k: v / total for k, v in raised.items()}


class Unmet(ValueError):
    """Targets that no weights meet."""


@dataclass
class Fit:
    """Weights of cells, the factors of names that give them, and by how much each margin is off, as a share of all."""

    weights: np.ndarray
    factors: list[np.ndarray]
    off: list[float] = field(default_factory=list)


def _fit(n: np.ndarray, places: list[np.ndarray], goals: list[np.ndarray], rounds: int, close: float) -> Fit:
    """Scales n until its sums by places are goals. A name whose cells are all zero by then stays as it is."""
    w, total = n.astype(np.float64), max(n.sum(), 1)
    factors = [np.ones(len(g)) for g in goals]
    sums = lambda m: np.bincount(places[m], w, len(goals[m]))
    for _ in range(rounds):
        worst = 0.0
        for m, goal in enumerate(goals):
            now = sums(m)
            by = np.divide(goal, now, out=np.ones(len(goal)), where=now > 0)
            worst = max(worst, np.abs(by - 1).max(initial=0))
            w *= by[places[m]]
            with np.errstate(over="ignore", under="ignore"):
                factors[m] *= by
        if worst < close:
            break
    return Fit(w, factors, [float(np.abs(sums(m) - goals[m]).sum() / total) for m in range(len(goals))])


def _goal(own: Mapping[str, float], target: Mapping[str, float] | None, temper: float) -> dict[str, float]:
    """Shares of the names in own that sum to 1: the target's, own shares for names without one; or flattened ones."""
    if target is None:
        return tempered(own, temper)
    goal = {k: max(0.0, float(target.get(k, v))) for k, v in own.items()}
    whole = sum(goal.values())
    if not whole:
        raise Unmet("no target is over zero")
    return {k: v / whole for k, v in goal.items()}


def _said(off: Mapping[str, float], strict: bool) -> None:
    missed = {m: round(x, 6) for m, x in off.items() if x > OFF}
    if missed:
        text = f"the targets contradict each other; shares of the tokens that are off, by margin: {missed}"
        if strict:
            raise Unmet(text)
        warnings.warn(text, stacklevel=3)


def fit(cells: Mapping[tuple, int], targets: list[Mapping[str, float]], rounds: int = ROUNDS, close: float = CLOSE) -> list[dict[str, float]]:
    """A factor for each name of each margin, so that cells scaled by their factors have the target shares.

    Names without tokens take no share: the others' targets are scaled up. Names without a target keep
    their own share. Stops when every sum is within `close` of its target, relatively. Unmet is raised if
    the targets contradict each other."""
    held = {c: n for c, n in cells.items() if n > 0}
    if not held:
        return [{} for _ in targets]
    names, places, goals = [], [], []
    n = np.array([*held.values()], np.float64)
    for m, target in enumerate(targets):
        own: dict[str, float] = {}
        for c, x in held.items():
            own[c[m]] = own.get(c[m], 0) + x / n.sum()
        at = {k: i for i, k in enumerate(own)}
        names.append([*own])
        places.append(np.array([at[c[m]] for c in held]))
        goal = _goal(own, target, 1)
        goals.append(np.array([goal[k] for k in own]) * n.sum())
    got = _fit(n, places, goals, rounds, close)
    _said({str(m): x for m, x in enumerate(got.off)}, strict=True)
    return [dict(zip(k, f.tolist(), strict=True)) for k, f in zip(names, got.factors, strict=True)]


def _on_driver(cells: DataFrame, targets: Mapping[str, Mapping[str, float]], temper: float, rounds: int, close: float) -> tuple[DataFrame, dict[str, float]]:
    """(*MARGINS, n, weight) for cells with tokens, fitted in arrays; and how far each margin is off."""
    rows = cells.collect()  # at most CELLS
    n = np.array([r["n"] for r in rows], np.float64)
    places, goals = [], []
    for m in MARGINS:
        at: dict[str, int] = {}
        places.append(np.array([at.setdefault(r[m], len(at)) for r in rows], np.int64))
        sums = np.bincount(places[-1], n, len(at))
        goal = _goal(dict(zip(at, (sums / n.sum()).tolist(), strict=True)), targets.get(m), temper)
        goals.append(np.array([goal[k] for k in at]) * n.sum())
    got = _fit(n, places, goals, rounds, close)
    out = [(*(r[m] for m in MARGINS), int(r["n"]), float(w / x)) for r, w, x in zip(rows, got.weights, n, strict=True)]
    spark = cells.sparkSession
    return durable(spark.createDataFrame(out, ", ".join(f"{m} string" for m in MARGINS) + ", n long, weight double").coalesce(1)), dict(zip(MARGINS, got.off, strict=True))


def _as_tables(cells: DataFrame, targets: Mapping[str, Mapping[str, float]], temper: float, rounds: int, close: float) -> tuple[DataFrame, dict[str, float]]:
    """_on_driver for any number of cells: what the driver sees are sums over all and the largest change of a round."""
    spark, total = cells.sparkSession, cells.agg(F.sum("n")).first()[0]
    goals = {}
    for m in MARGINS:
        own = cells.groupBy(m).agg((F.sum("n") / total).alias("own"))
        if m in targets:
            wanted = spark.createDataFrame([(k, max(0.0, float(v))) for k, v in targets[m].items()], f"{m} string, goal double")
            goal = own.join(wanted, m, "left").select(m, F.coalesce("goal", "own").alias("goal"))
        else:
            goal = own.select(m, F.pow("own", F.lit(temper)).alias("goal"))
        goal = durable(goal)
        whole = goal.agg(F.sum("goal")).first()[0]
        if not whole:
            raise Unmet("no target is over zero")
        goals[m] = goal.select(m, (F.col("goal") / whole * total).alias("goal"))
    held = durable(cells.select(*MARGINS, "n", F.col("n").cast("double").alias("w")))
    for _ in range(rounds):
        worst = 0.0
        for m in MARGINS:
            now = held.groupBy(m).agg(F.sum("w").alias("now")).join(goals[m], m)
            by = now.select(m, F.when(F.col("now") > 0, F.col("goal") / F.col("now")).otherwise(1.0).alias("by"))
            scaled = held.join(by, m).select(*MARGINS, "n", (F.col("w") * F.col("by")).alias("w"), "by")
            changed, most = counted(scaled, F.max(F.abs(F.col("by") - 1)), spent=(held,))
            held = changed.select(*MARGINS, "n", "w")
            held.durable_path = changed.durable_path
            worst = max(worst, most or 0.0)
        if worst < close:
            break
    off = {m: float(held.groupBy(m).agg(F.sum("w").alias("now")).join(goals[m], m).agg(F.sum(F.abs(F.col("now") - F.col("goal")))).first()[0] / total) for m in MARGINS}
    return durable(held.select(*MARGINS, "n", (F.col("w") / F.col("n")).alias("weight")), spent=(held,)), off


def scale(cells: DataFrame, budget: float | None, points: int = 64) -> float:
    """The constant k of the probabilities min(1, k * weight), for cells (n, weight).

    Without a budget the largest probability is 1, and the expected shares are the targets exactly. With a
    budget (a share of all tokens) the expected tokens are the budget; cells that reach 1 stay there. Each pass over
    the cells tries `points` constants at once."""
    top, least, total = cells.agg(F.max("weight"), F.min(F.when(F.col("weight") > 0, F.col("weight"))), F.sum("n")).first()
    if not top:
        return 1.0
    if budget is None:
        return 1 / top
    low, high = 0.0, 1 / least
    while high - low > 1e-12 * high:
        tries = [low + (high - low) * (i + 1) / points for i in range(points)]
        got = cells.agg(*(F.sum(F.col("n") * F.least(F.lit(1.0), F.lit(k) * F.col("weight"))) for k in tries)).first()
        reached = next((i for i, x in enumerate(got) if x / total >= budget), points - 1)
        if (tries[reached - 1] if reached else low, tries[reached]) == (low, high):
            break
        low, high = tries[reached - 1] if reached else low, tries[reached]
    return high


@dataclass
class Mix:
    """Cells (*MARGINS, n, weight) with tokens, the constant of the probabilities, and how far margins are off."""

    cells: DataFrame
    k: float
    off: dict[str, float]

    def joined(self, docs: DataFrame, names: Mapping[str, str]) -> DataFrame:
        """docs with its cell's weight as the column names["weight"]; names has the docs' columns of the margins.
        Spark broadcasts the cells if they are small by its own measure."""
        cells = self.cells.select(*(F.col(m).alias(f"{names['weight']}_{m}") for m in MARGINS), F.col("weight").alias(names["weight"]))
        same = reduce(Column.__and__, (F.col(names[m]) == F.col(f"{names['weight']}_{m}") for m in MARGINS))
        return docs.join(cells, same, "left").drop(*(f"{names['weight']}_{m}" for m in MARGINS)).withColumn(names["weight"], F.coalesce(names["weight"], F.lit(1.0)))


def _values(topic: Column | None) -> dict[str, Column]:
    values = {"source": F.col("source"), "lang": F.col("lang"), "topic": topic_of(F.col("text")) if topic is None else topic}
    return {m: F.coalesce(v.cast("string"), F.lit(NONE)) for m, v in values.items()}


def rake(
    docs: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, topic: Column | None = None, budget: float | None = None, temper: float = TEMPER,
    strict: bool = False, cells: int = CELLS, rounds: int = ROUNDS, close: float = CLOSE,
) -> Mix:
    """Counts the tokens of all rows by cell and fits the weights.

    A margin without targets is flattened: its own shares to the power `temper`. Names without a target keep their
    own share, names without tokens take none. Null is a name. Without any tokens there is nothing to fit: every
    weight and the constant are 1. Targets that contradict each other give a warning, with `strict` an error (Unmet)."""
    if unknown := {*(targets or {})} - {*MARGINS}:
        raise ValueError(f"no such margin: {sorted(unknown)}")
    summed = docs.select(*(v.alias(m) for m, v in _values(topic).items()), tokens_of(F.col("text")).alias("n")).groupBy(*MARGINS).agg(F.sum("n").alias("n")).filter("n > 0")
    held, n = counted(summed, F.count(F.lit(1)))
    if not n:
        return Mix(held.withColumn("weight", F.lit(1.0)), 1.0, {})
    table, off = (_on_driver if n <= cells else _as_tables)(held, targets or {}, temper, rounds, close)
    forget(held)
    _said(off, strict)
    return Mix(table, scale(table, budget), off)


def uniform(*columns: str, seed: int = SEED) -> Column:
    """A number in [0, 1) from a hash."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11) / F.lit(2.0**53)


def drawn(docs: DataFrame, seed: int = SEED, topic: Column | None = None, **options) -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens, weight, probability, kept) for each row of docs.

    source, lang and topic are the cell's names. weight is the cell's scaled tokens over its tokens; in cells without
    tokens it is 1. Rows with one doc_id (or none) share the draw. A null text has no tokens. An empty
    table gives no rows; other columns are not read. A long text is counted whole."""
    mix = rake(docs, topic=topic, **options)
    rows = docs.select("doc_id", *(v.alias(m) for m, v in _values(topic).items()), tokens_of(F.col("text")).alias("n_tokens"))
    rows = mix.joined(rows, {m: m for m in MARGINS} | {"weight": "weight"})
    rows = rows.select("doc_id", *MARGINS, "n_tokens", "weight", F.least(F.lit(1.0), F.col("weight") * mix.k).alias("probability"))
    return rows.withColumn("kept", uniform("doc_id", seed=seed) < F.col("probability"))


def sample(docs: DataFrame, seed: int = SEED, topic: Column | None = None, **options) -> DataFrame:
    """The rows of docs that drawn keeps, columns as they are. Rows that share a doc_id in one cell stay or go
    together, null ids too; an empty table gives no rows."""
    mix = rake(docs, topic=topic, **options)
    names = {m: fresh(docs, f"_{m}") for m in (*MARGINS, "weight")}
    rows = mix.joined(docs.withColumns({names[m]: v for m, v in _values(topic).items()}), names)
    return rows.filter(uniform("doc_id", seed=seed) < F.least(F.lit(1.0), F.col(names["weight"]) * mix.k)).select(*docs.columns)
