"""References to records that do not exist (problem 4).

The foreign keys form a graph of relations; each edge says which column of the child names which key of
the parent, and optionally until when the parent must have existed. A child row is a *direct* orphan when
an edge has no parent row, or only parents that arrived later than the child's reference time. Then the
cascade runs: rows whose parent is an orphan are *inherited* orphans, semi-joining only the newly found
rows (the frontier) down the graph until nothing new turns up.

Defined results
---------------
* a null key refers to nothing and is no orphan;
* a null date, on either side, is never late; of several parents with one key, the earliest counts, and one
  without a date is in time;
* each (table, row) is reported once for each kind at its first level: level 0 is direct, n is inherited in n steps;
* empty parents make every non-null reference an orphan; empty children give no rows;
* names are compared as written.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalbox.session import cut


@dataclass(frozen=True)
class Edge:
    """``child.key`` refers to ``parent.parent_key``; late when parent.born > child.until (if both are named)."""

    child: str
    key: str
    parent: str
    parent_key: str
    born: str | None = None
    until: str | None = None
    check: bool = True  # False: inherit over this edge, but report no direct orphans of it


@dataclass(frozen=True)
class Relation:
    """A table: its name, rows, row identifier and the month its orphans are reported under (a string column)."""

    name: str
    rows: DataFrame
    row_id: str
    period: str


def direct_orphans(relations: dict[str, Relation], edges: Sequence[Edge]) -> DataFrame:
    """(table_name, row_key, period) of rows with a broken reference, one row each."""
    found = []
    for e in (e for e in edges if e.check):
        child, parent = relations[e.child], relations[e.parent]
        refs = child.rows.where(F.col(e.key).isNotNull()).select(
            F.lit(e.child).alias("table_name"),
            F.col(child.row_id).cast("string").alias("row_key"),
            F.col(child.period).alias("period"),
            F.col(e.key).alias("__key"),
            (F.col(e.until) if e.until else F.lit(None).cast("timestamp_ntz")).alias("__until"),
        )
        keys = parent.rows.where(F.col(e.parent_key).isNotNull())
        if e.born:
            born = F.min(F.coalesce(F.col(e.born), F.to_timestamp_ntz(F.lit("0001-01-01 00:00:00"))))
            keys = keys.groupBy(F.col(e.parent_key).alias("__key")).agg(born.alias("__born"))
            joined = refs.join(keys, "__key", "left")
            lost = joined.where(F.col("__born").isNull() | (F.col("__born") > F.col("__until")))
        else:
            lost = refs.join(keys.select(F.col(e.parent_key).alias("__key")).distinct(), "__key", "left_anti")
        found.append(lost.select("table_name", "row_key", "period"))
    # A row may break several references; the period depends on the row alone.
    return reduce(DataFrame.unionAll, found).groupBy("table_name", "row_key").agg(F.min("period").alias("period"))


def _projected(relations: dict[str, Relation], edges: Sequence[Edge]) -> dict[str, Relation]:
    """The relations with no more columns than the graph needs, cut once, as every level reads them."""
    out = {}
    for name, r in relations.items():
        own = [(e.key, e.until) for e in edges if e.child == name] + [(e.parent_key, e.born) for e in edges if e.parent == name]
        columns = dict.fromkeys([r.row_id, r.period, *(c for pair in own for c in pair if c)])
        out[name] = replace(r, rows=cut(r.rows.select(*columns)))
    return out


def orphan_cascade(relations: dict[str, Relation], edges: Sequence[Edge]) -> DataFrame:
    """(table_name, row_key, period, kind, level): direct orphans and all that inherit from them.

    Every round semi-joins the frontier's keys with the children of its tables, removes the rows already
    known and stops when none are left. The frontier shrinks to nothing because rows are finite and never
    re-enter; cycles in the graph are therefore safe, and chains may be as deep as they are.
    """
    relations = _projected(relations, edges)
    known = cut(
        direct_orphans(relations, edges).select(
            "table_name", "row_key", "period", F.lit("direct").alias("kind"), F.lit(0).alias("level")
        )
    )
    levels, frontier = [known], known
    for level in count(1):
        steps = []
        for e in edges:
            child, parent = relations[e.child], relations[e.parent]
            lost = frontier.where(F.col("table_name") == e.parent).select(F.col("row_key").alias("__row"))
            lost_keys = (
                parent.rows.select(F.col(parent.row_id).cast("string").alias("__row"), F.col(e.parent_key).alias("__key"))
                .join(lost, "__row", "left_semi")
                .where(F.col("__key").isNotNull())
                .select("__key")
            )
            steps.append(
                child.rows.select(
                    F.lit(e.child).alias("table_name"),
                    F.col(child.row_id).cast("string").alias("row_key"),
                    F.col(child.period).alias("period"),
                    F.col(e.key).alias("__key"),
                )
                .join(lost_keys, "__key", "left_semi")
                .select("table_name", "row_key", "period")
            )
        reached = reduce(DataFrame.unionAll, steps).groupBy("table_name", "row_key").agg(F.min("period").alias("period"))
        seen = reduce(DataFrame.unionAll, levels).select("table_name", "row_key")
        frontier = cut(
            reached.join(seen, ["table_name", "row_key"], "left_anti").select(
                "table_name", "row_key", "period", F.lit("inherited").alias("kind"), F.lit(level).alias("level")
            )
        )
        if frontier.isEmpty():
            return reduce(DataFrame.unionAll, levels)
        levels.append(frontier)
    raise AssertionError("unreachable")


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphans per table and period, direct and inherited."""
    return orphans.groupBy("table_name", "period").agg(
        F.count_if(F.col("kind") == "direct").alias("direct"),
        F.count_if(F.col("kind") == "inherited").alias("inherited"),
    )
