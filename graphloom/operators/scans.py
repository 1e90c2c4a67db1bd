"""Sequential readings of long groups as compositions of small maps.

Where what comes next depends on the rows before only through one of a few states, a row is a map
from the state before it to the state after it.  Maps compose: rows are taken in chunks of a bounded
number, each chunk's map goes up a level, and states come down again, so a group of any length takes
as many levels as its logarithm and no row's work grows with the group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.sources.stage import cut_lineage

#: Rows of a chunk.
WIDTH = 64


def states_before(rows: DataFrame, group: Sequence[str], at: str, step: str, carried: Sequence[str] = (), states: int = 4, width: int = WIDTH) -> DataFrame:
    """``group``, ``at``, ``state`` (before the row; 0 before the first) and the ``carried`` columns.

    Rows of a group are numbered by ``at`` from 0 without gaps; ``step`` is an array with the state
    after the row for each of the ``states`` before it.
    """
    longest = rows.agg(F.max(at).alias("n")).first()["n"] or 0
    return _scan(rows, list(group), at, step, list(carried), states, width, int(longest))


def _scan(rows: DataFrame, group: list[str], at: str, step: str, carried: list[str], states: int, width: int, longest: int) -> DataFrame:
    chunk = F.floor(F.col(at) / width).cast("long").alias("_chunk")
    own = F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), F.col(step).alias("step"), F.struct(*carried, F.lit(0).alias("_")).alias("row"))), lambda x, y: (x["at"] - y["at"]).cast("int"))
    chunks = rows.groupBy(*group, chunk).agg(own.alias("_rows"))
    if longest < width:
        chunks = chunks.withColumn("_entry", F.lit(0))
    else:  # only groups of several chunks go up a level
        long = rows.where(F.col(at) >= width).select(*group).distinct()
        chunks = cut_lineage(chunks)
        composed = F.array(*[F.aggregate("_rows", F.lit(s), _after) for s in range(states)])
        above = cut_lineage(chunks.join(long, group, "left_semi").select(*group, F.col("_chunk").alias("_at"), composed.alias("_step")))
        entries = _scan(above, group, "_at", "_step", [], states, width, longest // width).select(*group, F.col("_at").alias("_chunk"), F.col("state").alias("_entry"))
        chunks = chunks.join(entries, [*group, "_chunk"], "left").withColumn("_entry", F.coalesce("_entry", F.lit(0)))
    none = F.array().cast("array<int>")
    told = F.aggregate("_rows", F.struct(F.col("_entry").cast("int").alias("s"), none.alias("out")), lambda a, r: F.struct(_after(a["s"], r).alias("s"), F.concat(a["out"], F.array(a["s"])).alias("out")), lambda a: a["out"])
    each = chunks.select(*group, F.explode(F.arrays_zip("_rows", told.alias("_states"))).alias("_r"))
    return each.select(*group, F.col("_r._rows.at").alias(at), F.col("_r._states").alias("state"), *[F.col(f"_r._rows.row.{c}").alias(c) for c in carried])


def _after(state: Column, row: Column) -> Column:
    return row["step"][state]


def folded(rows: Column, start: Column, step, out_type: str, width: int = WIDTH) -> Column:
    """The outputs of a fold over an array whose state isn't one of a few: ``step(state, row)`` is a struct of ``state`` and ``out``.

    Outputs are gathered a chunk at a time, so that an array of n rows is not copied n times.
    """
    none = F.array().cast(f"array<{out_type}>")
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / width).cast("int")), lambda i: F.slice(rows, i * width + 1, F.lit(width)))
    chunks = F.when(F.size(rows) > 0, chunks).otherwise(F.filter(F.array(rows), lambda _: F.lit(False)))

    def inner(acc: Column, row: Column) -> Column:
        return F.transform(F.array(step(acc["state"], row)), lambda d: F.struct(d["state"].alias("state"), F.concat(acc["out"], F.array(d["out"])).alias("out")))[0]

    def outer(acc: Column, chunk: Column) -> Column:
        done = F.aggregate(chunk, F.struct(acc["state"].alias("state"), none.alias("out")), inner)
        return F.transform(F.array(done), lambda d: F.struct(d["state"].alias("state"), F.concat(acc["outs"], F.array(d["out"])).alias("outs")))[0]

    return F.flatten(F.aggregate(chunks, F.struct(start.alias("state"), F.array().cast(f"array<array<{out_type}>>").alias("outs")), outer, lambda a: a["outs"]))
