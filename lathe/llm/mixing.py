"""Mixing sources to target weights by entropy balancing.

Each document gets a rate r = exp(lambda * x), where x is its size over its
source's mean size, cut off at ``LIMIT`` copies: among all rates between 0 and
LIMIT whose tokens add up to the source's target, these are nearest to "one copy
each" in relative entropy. The dual has one lambda for each source and is
convex; Newton steps (kept inside a shrinking bracket) solve it. Each step is a
distributed sum over a histogram (source, size), to which documents are
aggregated once; rates depend on nothing else.

Rounding: every document takes floor(r) copies, and some documents of each
histogram cell one more. How many is carried from cell to cell, largest sizes
first, so that a source's taken words miss its target by about half of its
smallest document. A cell's share is split over salts in proportion, and the
documents of a salt are ranked by a hash; salts grow with the number of rows, so
that no task ranks a third of the corpus even if it is one size, and rows that
repeat id and text are counted first.

The histogram of one source has at most sqrt(2 * words) cells, which bounds the
task that carries the rounding. The driver holds a few numbers for
each source, the granularity at which weights are stated.

Defined cases: null text has size 0 and takes 0; sources are ordered by code
point, null last; rows that repeat id and text share a draw, and if only some of
them may take one more copy, exactly so many do; an empty table gives an empty
result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, gathered, read, word_count

WEIGHTS = (5, 2, 1)
LIMIT = 3
LEAST_SALTS = 16
#: Rows of one (source, size) that one task ranks, about.
ROWS_PER_SALT = 5_000_000
STEPS = 60
TOLERANCE = 1e-9
SEED = 77
BROADCAST_SOURCES = 50_000


def targets(sizes: list[tuple[str | None, int]], weights=WEIGHTS, limit: int = LIMIT) -> dict[str | None, float]:
    """Target of each source: shares by weight of all sizes, none over ``limit`` times its own."""
    order = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    weighed = [(limit * n / weights[i % len(weights)], name, n, weights[i % len(weights)]) for i, (name, n) in enumerate(order)]
    weighed.sort(key=lambda w: w[0])
    rest, weight, out = sum(n for _, n in order), sum(w[3] for w in weighed), {}
    for cap, name, own, w in weighed:
        # Sources by the level at which they are full: all that lie below the present level stop at their limit.
        if rest > cap * weight:
            out[name] = float(limit * own)
            rest, weight = rest - limit * own, weight - w
        else:
            out[name] = rest * w / weight
    return out


def _hinted(table: DataFrame, rows: int) -> DataFrame:
    """Broadcast a table of sources while it is small; a larger one joins by shuffle."""
    return F.broadcast(table) if rows <= BROADCAST_SOURCES else table


def _solve(cells: DataFrame, spark: SparkSession, goals: dict) -> dict:
    """lambda of each source by safeguarded Newton; each step is one distributed sum."""
    state = {name: {"low": -60.0, "high": 60.0, "at": 0.0} for name, (_, goal, _) in goals.items() if goal > 0}
    open_names = set(state)
    for _ in range(STEPS):
        if not open_names:
            break
        table = spark.createDataFrame([(n, float(goals[n][2]), state[n]["at"]) for n in open_names], "source string, mean double, at double")
        x = F.col("size") / F.col("mean")
        rate = F.least(F.lit(float(LIMIT)), F.exp(F.least(F.col("at") * x, F.lit(5.0))))
        words = F.col("n") * F.col("size")
        slope = F.when(rate < LIMIT, words * x * rate).otherwise(0.0)
        sums = cells.join(_hinted(table.withColumnRenamed("source", "t_source"), len(open_names)), F.col("source").eqNullSafe(F.col("t_source"))).groupBy("source").agg(F.sum(words * rate).alias("got"), F.sum(slope).alias("slope")).collect()
        for row in sums:
            name, goal, s = row["source"], goals[row["source"]][1], state[row["source"]]
            miss = row["got"] - goal
            if abs(miss) <= TOLERANCE * max(goal, 1.0):
                open_names.discard(name)
                continue
            s["low" if miss < 0 else "high"] = s["at"]
            step = s["at"] - miss / row["slope"] if row["slope"] > 0 else math.nan
            s["at"] = step if s["low"] < step < s["high"] else (s["low"] + s["high"]) / 2
            if s["high"] - s["low"] < 1e-12:
                open_names.discard(name)
    return {n: s["at"] for n, s in state.items()}


def _round(frame: pd.DataFrame) -> pd.DataFrame:
    """Extra copies of each cell of a source, carried from the largest size down."""
    frame = frame.sort_values("size", ascending=False, kind="stable")
    size, n, rate = frame["size"].to_numpy(), frame["n"].to_numpy(), frame["rate"].to_numpy()
    whole = np.floor(rate + 1e-9).astype(np.int64)
    extra, owed = np.zeros(len(frame), np.int64), 0.0
    for i in range(len(frame)):
        owed += n[i] * (rate[i] - whole[i]) * size[i]
        room = n[i] if whole[i] < LIMIT else 0
        extra[i] = min(room, max(0, math.floor(owed / size[i] + 0.5)))
        owed -= extra[i] * size[i]
    # What small documents could not make good goes to any that still have room, or is taken back.
    for i in range(len(frame)):
        more = math.floor(owed / size[i] + 0.5)
        more = max(-n[i] * whole[i] - extra[i], min(n[i] * (LIMIT - whole[i]) - extra[i], more))
        extra[i] += more
        owed -= more * size[i]
    return pd.DataFrame({"source": frame["source"], "size": size, "n": n, "whole": whole, "extra": extra})


def _rows(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> list:
    """id, source, size and draw of each row as expressions."""
    text, doc_id = F.col(text_col).cast("string"), F.col(id_col).cast("long")
    draw = F.xxhash64(F.lit(SEED), doc_id, text)
    return [doc_id.alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(text).alias("size"), draw.alias("draw")]


def _salted(rows: DataFrame, salts: int) -> DataFrame:
    return rows.withColumn("salt", F.pmod(F.shiftright("draw", 7), F.lit(salts)).cast("int"))


def _allot(rows: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Copies of each salted cell (p_source, p_size, p_salt, n, whole, extra), facts of each source, and the number of salts."""
    spark = rows.sparkSession
    salts = max(LEAST_SALTS, rows.count() // ROWS_PER_SALT)
    salted = cut(_salted(rows, salts).groupBy("source", "size", "salt").agg(F.count("*").alias("n")), "mix-salted", narrow=True)
    cells = cut(salted.groupBy("source", "size").agg(F.sum("n").alias("n")), "mix-cells", narrow=True)
    by_source = cells.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("words"), F.sum("n").alias("docs")).collect()
    wanted = targets([(r["source"], r["words"]) for r in by_source])
    goals = {r["source"]: (r["words"], wanted[r["source"]], r["words"] / max(r["docs"], 1)) for r in by_source if r["words"]}
    found = _solve(cells, spark, goals)
    facts = [(r["source"], int(r["words"]), float(wanted[r["source"]]), float(r["words"]) / max(r["docs"], 1), float(found.get(r["source"], 0.0))) for r in by_source]
    table = _hinted(spark.createDataFrame(facts, "t_source string, source_size long, target double, mean double, at double"), len(facts))
    rate = F.when(F.col("target") >= LIMIT * F.col("source_size"), float(LIMIT)).otherwise(F.least(F.lit(float(LIMIT)), F.exp(F.least(F.col("at") * F.col("size") / F.col("mean"), F.lit(5.0)))))
    rated = cells.filter("size > 0").join(table, F.col("source").eqNullSafe(F.col("t_source"))).select("source", "size", "n", rate.alias("rate"))
    plan = rated.groupBy("source").applyInPandas(_round, "source string, size long, n long, whole long, extra long")
    plan = plan.select(F.col("source").alias("p_source"), F.col("size").alias("p_size"), F.col("n").alias("total"), (F.col("whole") + F.floor(F.col("extra") / F.col("n"))).alias("whole"), F.pmod("extra", "n").alias("more"))
    # What is left of a cell goes to its salts in proportion to their rows, to the last copy.
    upto = F.sum("n").over(Window.partitionBy("source", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    parts = salted.filter("size > 0").withColumn("upto", upto).join(plan, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("size") == F.col("p_size")))
    share = lambda end: F.expr(f"(cast({end} AS decimal(19, 0)) * cast(more AS decimal(19, 0))) div cast(total AS decimal(19, 0))")
    parts = parts.select("p_source", "p_size", F.col("salt").alias("p_salt"), "whole", (share("upto") - share("upto - n")).alias("extra"))
    # Compressed files look small; a table that grows with the input is never broadcast.
    return cut(parts, "mix-plan", narrow=True).hint("merge"), table, salts


def _same_cell(source: str = "source", size: str = "size", salt: str = "salt"):
    return F.col(source).eqNullSafe(F.col("p_source")) & (F.col(size) == F.col("p_size")) & (F.col(salt) == F.col("p_salt"))


def _limits(rows: DataFrame, plan: DataFrame, salts: int) -> DataFrame:
    """Of each salted cell: whole, the last draw that takes one more copy (``last``), the rows that have it (``ties``) and how many of them take it (``take``).

    Rows of one draw are counted before they are ranked, so a text that repeats
    under one id is one row here, however often it stands in the table.
    """
    groups = _salted(rows, salts).groupBy("source", "size", "salt", "draw").agg(F.count("*").alias("ties"))
    upto = F.sum("ties").over(Window.partitionBy("source", "size", "salt").orderBy("draw").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    met = groups.withColumn("before", upto - F.col("ties")).join(plan, _same_cell())
    last = met.filter((F.col("before") < F.col("extra")) & (F.col("extra") <= F.col("before") + F.col("ties")))
    last = last.select(F.col("p_source").alias("l_source"), F.col("p_size").alias("l_size"), F.col("p_salt").alias("l_salt"), F.col("draw").alias("last"), "ties", (F.col("extra") - F.col("before")).alias("take"))
    same = F.col("p_source").eqNullSafe(F.col("l_source")) & (F.col("p_size") == F.col("l_size")) & (F.col("p_salt") == F.col("l_salt"))
    return cut(plan.join(last, same, "left").select("p_source", "p_size", "p_salt", "whole", "last", "ties", "take"), "mix-limits", narrow=True).hint("merge")


def _copied(rows: DataFrame, limits: DataFrame, kept: list[str]) -> DataFrame:
    """``kept`` and copies of each row (columns source, size, salt, draw); rows without words take none.

    If only some rows of the last draw take one more copy, equal ones are counted
    and take it in the order of their other columns.
    """
    met = rows.join(limits, _same_cell(), "left")
    part = F.coalesce((F.col("draw") == F.col("last")) & (F.col("take") < F.col("ties")), F.lit(False))
    more = F.when(F.col("draw") <= F.col("last"), 1).otherwise(0)
    out = met.filter(~part).select(*kept, F.coalesce(F.col("whole") + more, F.lit(0)).cast("int").alias("copies"))
    torn = limits.filter("take < ties")
    if torn.isEmpty():
        return out
    tied = rows.join(torn, _same_cell() & (F.col("draw") == F.col("last")))
    alike = tied.groupBy("p_source", "p_size", "p_salt", "whole", "take", *kept).agg(F.count("*").alias("n"))
    order = Window.partitionBy("p_source", "p_size", "p_salt").orderBy(*kept).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = alike.withColumn("before", F.sum("n").over(order) - F.col("n"))
    each = placed.select("*", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i"))
    return out.unionByName(each.select(*kept, (F.col("whole") + F.when(F.col("before") + F.col("i") <= F.col("take"), 1).otherwise(0)).cast("int").alias("copies")))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size, source_size, target, copies for each row."""
    rows = cut(docs.select(*_rows(docs, id_col, text_col, source_col)), "mix-rows")
    plan, table, salts = _allot(rows)
    joined = _copied(_salted(rows, salts), _limits(rows, plan, salts), ["doc_id", "source", "size"])
    return joined.join(table, F.col("source").eqNullSafe(F.col("t_source"))).select("doc_id", "source", "size", "source_size", "target", "copies")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents, each repeated by its number of copies, with all their columns.

    Whole rows move once: each cell's allotment becomes a largest draw, to which a
    row compares its own. Columns must be of types that can be grouped.
    """
    exprs = _rows(docs, id_col, text_col, source_col)
    rows = cut(docs.select(*exprs), "mix-rows")
    plan, _, salts = _allot(rows)
    whole = _salted(docs.select(F.struct(*docs.columns).alias("row"), *exprs), salts)
    taken = _copied(whole, _limits(rows, plan, salts), ["row"]).filter("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), "copies")).alias("copy")).select("row.*")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gathered(mix(read(spark, sf_dir, "documents"))).select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "source", "copies")
