"""Mixing sources to target weights by iterative proportional fitting.

Tokens are counted by cell (source, language, topic). The tokens to draw of the cells are raked to the target marginals of
source, language and topic in turn, ``ROUNDS`` times; a document of a cell is then kept with probability
tokens to draw / tokens of the cell, decided by a hash of its id, so the same document is kept at any partitioning.

No cell gives more than it has: a saturated cell stays at probability 1 and the others of its value make up for it, so the
budget is drawn in full. A value whose tokens don't reach its target is taken whole, and the other values of its dimension share
what it lacks in proportion to their targets. Where targets of two dimensions exclude each other the last one, topic, is met. ``marginals``
gives for every value its target, the goal that the tokens there are allow, and what is drawn. A larger budget keeps a superset as long as no cell is saturated.

Default targets temper the corpus' own shares: share ** ``TEMPER``, scaled to 1. The topic is the column ``topic``; where a table has none,
``with_topic`` gives the form of the text (table, licence, contact, brief, prose), all that these texts of invented words can tell. The cell table grows with the distinct
sources, not with documents: up to ``DRIVER_CELLS`` cells are raked in memory on the driver, beyond by the same steps on the executors.

Defined results: null source, language or topic are values of their own; null and empty texts have 0 tokens and share their cell's
probability (1 if the cell has no tokens); rows repeating a doc_id are kept or dropped together; rows with a null
doc_id hash like the empty string; an empty table gives an empty result; extra columns pass through, those named like a
computed one are replaced by ``drawn`` and come back as they were from ``mixed``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hash01, hash01_sql, materialize

ROUNDS, TEMPER, BUDGET, DRIVER_CELLS = 25, 0.7, 0.6, 200_000
DIMS = ("source", "lang", "topic")
NONE = "\x00none"


def tokens_of() -> Column:
    """Blank-separated words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return F.when(text == "", 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) + 1).cast("bigint")


def topic_of() -> Column:
    text = F.coalesce(F.col("text"), F.lit(""))
    return F.when(text.contains("|"), "table").when(text.contains("icense"),
        "licence").when(text.contains("@") | text.contains("://"), "contact").when(F.length(text) < 600,
        "brief").otherwise("prose")


def with_topic(docs: DataFrame) -> DataFrame:
    """``docs`` with a column ``topic``: the one there is, else the form of the text."""
    return docs if "topic" in docs.columns else docs.withColumn("topic", topic_of())


def with_cells(docs: DataFrame) -> DataFrame:
    """``docs``, which has a topic, with tokens and the cell columns _source, _lang, _topic."""
    value = {d: F.col(d) for d in DIMS}
    return docs.withColumn("tokens", tokens_of()).withColumns({f"_{d}": F.coalesce(value[d].cast("string"), F.lit(NONE)) for d in DIMS})


def cells(marked: DataFrame) -> DataFrame:
    return marked.groupBy(*(f"_{d}" for d in DIMS)).agg(F.sum("tokens").alias("cell_tokens"))


def _scales(code: np.ndarray, tokens: np.ndarray, p: np.ndarray, goal: np.ndarray) -> np.ndarray:
    """By value the factor f with sum(tokens * min(1, f * p)) = goal, which its cells must be able to give.

    Newton's steps from below: saturated cells are set apart and the others scaled to the rest, until no more saturate.
    """
    f, full = np.zeros(len(goal)), np.zeros(len(p), bool)
    while True:
        free = np.bincount(code, np.where(full, 0.0, tokens * p), len(goal))
        rest = np.maximum(goal - np.bincount(code, np.where(full, tokens, 0.0), len(goal)), 0.0)
        f = np.maximum(f, np.divide(rest, free, out=np.zeros(len(goal)), where=free > 0))
        more = ~full & (f[code] * p >= 1)
        if not more.any():
            return f
        full |= more


def rake_within(codes: list[np.ndarray], tokens: np.ndarray, targets: list[np.ndarray], budget: float, rounds: int = ROUNDS) -> np.ndarray:
    """Probabilities of the cells, none over 1, that draw ``budget`` of the tokens at the target marginals."""
    p = np.where(np.all([t[c] > 0 for c, t in zip(codes, targets)], 0) & (tokens > 0), 1.0, 0.0)
    there = tokens * p
    draw, goals = min(budget * tokens.sum(), there.sum()), []
    for code, target in zip(codes, targets):
        have = np.bincount(code, there, len(target))
        ratio = np.divide(target, have, out=np.zeros(len(target)), where=have > 0)
        goals.append(have * np.minimum(1.0, _scales(np.zeros(len(have), np.int64), have, ratio, np.array([draw]))[0] * ratio))
    for _ in range(rounds):
        for code, goal in zip(codes, goals):
            p = p * _scales(code, there, p, goal)[code]
    return np.minimum(1.0, p)


def _scale_rows(rows: DataFrame, by: list[str], have: str, p: str, goal: str) -> DataFrame:
    """(by, f): the same factor as ``_scales``, as the greatest over all cuts between free and saturated cells. Rows of p = 0 are left out."""
    w = Window.partitionBy(*by)
    run = w.orderBy(p).rowsBetween(Window.unboundedPreceding, 0)
    cut = rows.where(F.col(p) > 0).select(*by, (F.col(goal) - (F.sum(have).over(w) - F.sum(have).over(run))).alias("_rest"),
        F.sum(F.col(have) * F.col(p)).over(run).alias("_free"))
    return cut.groupBy(*by).agg(F.greatest(F.lit(0.0), F.max(F.col("_rest") / F.col("_free"))).alias("f"))


def _rake_cells_within(table: DataFrame, budget: float, rounds: int, temper: float, targets: dict[str, dict[str, float]] | None) -> DataFrame:
    """The same steps as ``rake_within`` on the executors, for very many cells."""
    names = [f"_{d}" for d in DIMS]
    shares = {d: _targets(table, d, temper, targets) for d in DIMS}
    p = table.withColumn("p", F.when(F.col("cell_tokens") > 0, 1.0).otherwise(0.0))
    for d in DIMS:
        p = p.join(shares[d], f"_{d}", "left").withColumn("p", F.when(F.coalesce("target", F.lit(0.0)) > 0, F.col("p")).otherwise(0.0)).drop("target")
    p = materialize(p.withColumn("_there", F.col("cell_tokens") * F.col("p")), "mix-cells")
    total, there = p.agg(F.coalesce(F.sum("cell_tokens"), F.lit(0)), F.coalesce(F.sum("_there"), F.lit(0.0))).first()
    draw, goals = min(budget * total, there), {}
    for d in DIMS:
        goals[d] = _goals(p.groupBy(f"_{d}").agg(F.sum("_there").alias("have")), shares[d], d, draw)
    for _ in range(rounds):
        for d in DIMS:
            f = _scale_rows(p.join(goals[d], f"_{d}"), [f"_{d}"], "_there", "p", "goal")
            p = p.join(f, f"_{d}", "left").withColumn("p", F.col("p") * F.coalesce("f", F.lit(0.0))).drop("f")
        p = materialize(p, "mix-cells")
    return p.select(*names, "cell_tokens", F.when(F.col("cell_tokens") > 0, F.least(F.lit(1.0), "p")).otherwise(1.0).alias("p"))


def _goals(have: DataFrame, share: DataFrame, d: str, draw: float) -> DataFrame:
    """(value, goal): the tokens to draw of each value of a dimension; none more than it has, the others in proportion to their targets."""
    both = have.where("have > 0").join(share, f"_{d}")
    both = materialize(both.select(f"_{d}", "have", (F.col("target") / F.col("have")).alias("ratio"), F.lit(float(draw)).alias("goal")), "mix-goal")
    f = (_scale_rows(both, [], "have", "ratio", "goal").first() or [0.0])[0] or 0.0
    return both.select(f"_{d}", (F.col("have") * F.least(F.lit(1.0), F.lit(f) * F.col("ratio"))).alias("goal"))


def _targets(table: DataFrame, d: str, temper: float, targets: dict[str, dict[str, float]] | None) -> DataFrame:
    """(value, target) of a dimension: as given, else the tempered shares of the tokens."""
    if targets and d in targets:
        return table.sparkSession.createDataFrame([(k, float(v)) for k, v in targets[d].items()], f"_{d} string, target double")
    total = Window.partitionBy()
    m = table.groupBy(f"_{d}").agg(F.sum("cell_tokens").alias("t")).withColumn("p", F.pow(F.col("t") / F.sum("t").over(total), F.lit(temper)))
    return materialize(m.select(f"_{d}", (F.col("p") / F.sum("p").over(total)).alias("target")), "mix-target")


def calibrated(docs_with_cells: DataFrame, budget: float = BUDGET, rounds: int = ROUNDS, temper: float = TEMPER,
    targets: dict[str, dict[str, float]] | None = None, driver_cells: int = DRIVER_CELLS) -> DataFrame:
    """(cell, cell_tokens, p): the probability that documents of a cell are kept with. ``budget`` is the share of all tokens to draw."""
    table = materialize(cells(docs_with_cells), "mix-cells")
    names = [f"_{d}" for d in DIMS]
    if table.count() > driver_cells:
        return _rake_cells_within(table, budget, rounds, temper, targets)
    t = table.toPandas().sort_values(names).reset_index(drop=True)
    tokens = t["cell_tokens"].to_numpy(np.float64)
    codes, goals = [], []
    for d in DIMS:
        values, code = np.unique(t[f"_{d}"].to_numpy(object), return_inverse=True)
        if targets and d in targets:
            goal = np.array([float(targets[d].get(v, 0.0)) for v in values])
        else:
            goal = (np.bincount(code, tokens, len(values)) / max(1.0, tokens.sum())) ** temper
            goal = goal / max(goal.sum(), 1e-300)
        codes.append(code)
        goals.append(goal)
    p = np.where(tokens > 0, rake_within(codes, tokens, goals, budget, rounds), 1.0)
    out = pa.table({**{n: pa.array(t[n].astype(str), pa.string()) for n in names},
            "cell_tokens": pa.array(t["cell_tokens"].to_numpy(np.int64)), "p": pa.array(p)})
    return docs_with_cells.sparkSession.createDataFrame(out, ", ".join(f"{n} string" for n in names) + ", cell_tokens bigint, p double")


def drawn(docs: DataFrame, budget: float = BUDGET, **how) -> DataFrame:
    """The sampled documents with tokens, p and the cell columns. Cells join by broadcast if AQE finds them small, else by shuffle."""
    names = [f"_{d}" for d in DIMS]
    marked = with_cells(with_topic(docs.drop("tokens", "p", "cell_tokens", *names)))
    return marked.join(calibrated(marked, budget, **how).drop("cell_tokens"), names).where(hash01(F.col("doc_id"), "mix:") < F.col("p"))


def mixed(docs: DataFrame, budget: float = BUDGET, **how) -> DataFrame:
    """The sampled documents with the columns of ``docs``, which travel as one struct beside the computed ones."""
    topic = ["topic"] if "topic" in docs.columns else []
    return drawn(docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text", "source", "lang", *topic), budget, **how).select("row.*")


def marginals(docs: DataFrame, budget: float = BUDGET, rounds: int = ROUNDS, temper: float = TEMPER,
    targets: dict[str, dict[str, float]] | None = None, driver_cells: int = DRIVER_CELLS) -> DataFrame:
    """(dimension, value, target, goal, drawn) as shares of the tokens drawn, in expectation.

    ``goal`` differs from ``target`` where a value has too few tokens for its target, or has to make up for one that has;
    ``drawn`` differs from ``goal`` where the goals of two dimensions exclude each other.
    """
    cell = materialize(calibrated(with_cells(with_topic(docs.drop("tokens", "p", "cell_tokens", *(f"_{d}" for d in DIMS)))),
            budget, rounds, temper, targets, driver_cells), "mix-drawn")
    cell = cell.withColumn("p", F.when(F.col("cell_tokens") > 0, F.col("p")).otherwise(0.0))
    names, parts = [f"_{d}" for d in DIMS], []
    shares = {d: _targets(cell.select(*names, "cell_tokens"), d, temper, targets) for d in DIMS}
    start = cell.withColumn("_there", F.col("cell_tokens").cast("double"))
    for d in DIMS:
        start = start.join(shares[d], f"_{d}", "left").withColumn("_there",
            F.when(F.coalesce("target", F.lit(0.0)) > 0, F.col("_there")).otherwise(0.0)).drop("target")
    total, there, taken = start.agg(F.coalesce(F.sum("cell_tokens"), F.lit(0)), F.coalesce(F.sum("_there"), F.lit(0.0)),
        F.coalesce(F.sum(F.col("cell_tokens") * F.col("p")), F.lit(0.0))).first()
    draw = min(budget * total, there)
    for d in DIMS:
        goal = _goals(start.groupBy(f"_{d}").agg(F.sum("_there").alias("have")), shares[d], d, draw)
        got = cell.groupBy(f"_{d}").agg((F.sum(F.col("cell_tokens") * F.col("p")) / F.lit(max(taken, 1e-300))).alias("drawn"))
        both = got.join(shares[d], f"_{d}", "full").join(goal, f"_{d}", "left")
        zero = F.lit(0.0)
        parts.append(both.select(F.lit(d).alias("dimension"), F.col(f"_{d}").alias("value"),
                F.coalesce("target", zero).alias("target"), F.coalesce(F.col("goal") / F.lit(max(draw, 1e-300)),
                    zero).alias("goal"), F.coalesce("drawn", zero).alias("drawn")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def report(docs: DataFrame, budget: float = BUDGET) -> DataFrame:
    return drawn(docs, budget).select("doc_id", "source", "lang", "topic", "tokens", F.round("p", 6).alias("p"))


def marginals_report(docs: DataFrame, budget: float = BUDGET) -> DataFrame:
    return marginals(docs, budget).select("dimension", "value", *(F.round(c, 6).alias(c) for c in ("target", "goal", "drawn")))


def _raked_sql(budget: float, rounds: int, temper: float) -> tuple[str, str]:
    """(CTEs, name of the last one: source, lang, topic, n, p before it is held at 1). The factor of a value is the greatest over all cuts between free and saturated cells."""
    topic = "CASE WHEN contains(t, '|') THEN 'table' WHEN contains(t, 'icense') THEN 'licence' WHEN contains(t, '@') OR contains(t, '://') THEN 'contact' WHEN length(t) < 600 THEN 'brief' ELSE 'prose' END"
    run = lambda x, p, by: f"sum({x}) OVER (PARTITION BY {by} ORDER BY {p} ROWS UNBOUNDED PRECEDING)"
    inner = lambda have, p, goal, by: f"({goal} - (sum({have}) OVER (PARTITION BY {by}) - {run(have, p, by)})) / {run(f'{have} * {p}', p, by)}"
    steps, last = [], "w0"
    for r in range(rounds):
        for i, d in enumerate(DIMS):
            name = f"w{r * 3 + i + 1}"
            steps.append(f"{name} AS MATERIALIZED (WITH cuts AS (SELECT c.{d} AS v, {inner('c.n', 'c.p', 'g.goal', f'c.{d}')} AS x FROM {last} c JOIN g_{d} g ON g.v = c.{d} WHERE c.p > 0 AND c.n > 0), f AS (SELECT v, greatest(0.0::double, max(x)) AS f FROM cuts GROUP BY v) SELECT c.source, c.lang, c.topic, c.n, c.p * coalesce(f.f, 0.0::double) AS p FROM {last} c LEFT JOIN f ON f.v = c.{d})")
            last = name
    goals = ", ".join(
        f"""t_{d} AS MATERIALIZED (SELECT v, have, s / sum(s) OVER () AS target FROM (SELECT {d} AS v, sum(n)::double AS have, pow(sum(n)::double / (SELECT sum(n) FROM cells)::double, {temper}::double) AS s FROM cells GROUP BY 1)),
g_{d} AS MATERIALIZED (WITH r AS (SELECT v, have, target, target / have AS ratio FROM t_{d} WHERE have > 0), c AS (SELECT {inner('have', 'ratio', '(SELECT x FROM draw)', '1')} AS x FROM r) SELECT v, target, have * least(1.0::double, (SELECT greatest(0.0::double, max(x)) FROM c) * ratio) AS goal FROM r)"""
        for d in DIMS
    )
    return (
        f"""d AS (SELECT doc_id, source, lang, coalesce(text, '') AS t FROM documents),
m AS (SELECT doc_id, source, lang, {topic} AS topic, CASE WHEN t = '' THEN 0 ELSE length(t) - length(replace(t, ' ', '')) + 1 END AS tokens FROM d),
cells AS MATERIALIZED (SELECT source, lang, topic, sum(tokens)::bigint AS n FROM m GROUP BY 1, 2, 3),
draw AS MATERIALIZED (SELECT {budget}::double * sum(n)::double AS x FROM cells),
{goals},
w0 AS MATERIALIZED (SELECT source, lang, topic, n::double AS n, CASE WHEN n > 0 THEN 1.0::double ELSE 0.0::double END AS p FROM cells),
{', '.join(steps)}""",
        last,
    )


def oracle(budget: float = BUDGET, rounds: int = ROUNDS, temper: float = TEMPER) -> str:
    ctes, last = _raked_sql(budget, rounds, temper)
    return f"""
WITH {ctes},
p AS (SELECT source, lang, topic, CASE WHEN n > 0 THEN least(1.0::double, p) ELSE 1.0::double END AS p FROM {last})
SELECT doc_id, m.source, m.lang, m.topic, tokens, round(p.p, 6) AS p FROM m JOIN p ON p.source = m.source AND p.lang = m.lang AND p.topic = m.topic
WHERE {hash01_sql('doc_id', 'mix:')} < p.p
"""


def marginals_oracle(budget: float = BUDGET, rounds: int = ROUNDS, temper: float = TEMPER) -> str:
    ctes, last = _raked_sql(budget, rounds, temper)
    one = lambda d: f"SELECT '{d}' AS dimension, g.v AS value, round(g.target, 6) AS target, round(g.goal / (SELECT x FROM draw), 6) AS goal, round(s.x / (SELECT sum(n * p) FROM got), 6) AS drawn FROM g_{d} g JOIN (SELECT {d} AS v, sum(n * p) AS x FROM got GROUP BY 1) s ON s.v = g.v"
    return f"WITH {ctes}, got AS (SELECT source, lang, topic, n, least(1.0::double, p) AS p FROM {last}) {' UNION ALL '.join(map(one, DIMS))}"
