"""Fitted models as rows of a table: written once, scored later, also elsewhere.

A model given by coefficients has a row for each term, a tree a row for each node.
The table holds models, not data: its size is that of the fits, and it is the only
thing read back before rows are scored.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.models.design import Design
from ledgerloom.models.scoring import linear_score, probability
from ledgerloom.models.tree import Node, tree_column
from ledgerloom.sources.frames import rows_to_df

MODEL_ROWS = (
    "model string, kind string, node int, column_name string, level string,"
    " threshold double, left_values array<double>, left_node int, right_node int, value double"
)


def _inputs(d: Design) -> dict[str, tuple[str, str | None]]:
    """Of each slot its column and, for factors, the level it stands for."""
    out = {}
    for term, slots in d.terms.items():
        for s in slots:
            level = d.names[s].removeprefix(f"{term}_") if term in d.levels else None
            out[d.names[s]] = (term, level)
    return out


def coefficient_rows(model: str, d: Design, coefs: Mapping[str, float]) -> list[tuple]:
    """Rows of a model on the log-odds scale; terms are those of the design."""
    places = _inputs(d) | {"(Intercept)": (None, None)}
    return [
        (model, "logistic", i, *places[term], None, None, None, None, float(value))
        for i, (term, value) in enumerate(coefs.items())
    ]


def tree_rows(model: str, d: Design, top: Node) -> list[tuple]:
    """Rows of a tree; node 0 is its top, ``value`` the probability of class 1."""
    places, rows = _inputs(d), []

    def put(node: Node) -> int:
        own = len(rows)
        rows.append(None)
        column, level, after = None, None, (None, None)
        if node.slot is not None:
            column, level = places[node.slot]
            after = (put(node.left), put(node.right))
        values = list(node.values) if node.values else None
        rows[own] = (
            model, "tree", own, column, level, node.threshold, values, *after, node.probability
        )
        return own

    put(top)
    return rows


def model_table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return rows_to_df(spark, rows, MODEL_ROWS)


def _value(row) -> Column:
    column = F.col(f"`{row.column_name}`")
    return (column == row.level if row.level is not None else column).cast("double")


def stored_columns(table: DataFrame) -> dict[str, Column]:
    """One probability expression for each model of a table, over uncoded columns."""
    rows = table.orderBy("model", "node").collect()
    models: dict[str, dict[int, object]] = {}
    for row in rows:
        models.setdefault(row.model, {})[row.node] = row
    return {name: _expression(nodes).alias(name) for name, nodes in models.items()}


def _expression(rows: dict) -> Column:
    if next(iter(rows.values())).kind == "logistic":
        columns = {str(k): _value(r) for k, r in rows.items() if r.column_name is not None}
        free = sum(r.value for r in rows.values() if r.column_name is None)
        coefs = {str(k): r.value for k, r in rows.items() if r.column_name is not None}
        return probability(linear_score({"(Intercept)": free} | coefs, columns))
    columns = {str(k): _value(r) for k, r in rows.items() if r.column_name is not None}

    def node(k: int) -> Node:
        r = rows[k]
        if r.column_name is None:
            return Node(0.0, r.value)
        return Node(
            0.0, r.value, 0.0, str(k), r.threshold, tuple(r.left_values or ()),
            node(r.left_node), node(r.right_node),
        )

    return tree_column(node(0), columns)


def known_rows(df: DataFrame, table: DataFrame, levels: Mapping[str, list[str]]) -> DataFrame:
    """The rows of ``df`` that the stored models can score: no null in a column they
    use, and factor levels among ``levels`` where given."""
    used = [r[0] for r in table.where("column_name IS NOT NULL").select("column_name").distinct().collect()]
    rows = df.na.drop(subset=sorted(used))
    for column, known in levels.items():
        rows = rows.where(F.col(f"`{column}`").isin(list(known)))
    return rows


def score_stored(df: DataFrame, table: DataFrame, *keep: str) -> DataFrame:
    """``keep`` columns and one probability column for each stored model; null where a
    model's column is."""
    return df.select(*keep, *stored_columns(table).values())
