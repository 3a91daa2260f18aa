"""Rules on writes: validators say what is wrong with a batch of changes before it is stored, reactors see it after."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgraph.operators import mutate
from loamgraph.plans import checks

#: (before, after) of the rows written, joined by id outside, to issues (severity, kind, node_id, message).
Validator = Callable[[DataFrame, DataFrame], DataFrame]
Reactor = Callable[[DataFrame, DataFrame], None]


@dataclass
class Pack:
    """The rules of one behaviour: validators and reactors by what is written, a node, an edge added or one removed."""

    name: str
    validators: dict[str, list[Validator]] = field(default_factory=dict)
    reactors: dict[str, list[Reactor]] = field(default_factory=dict)


def workflow(name: str, kind: str, prop: str, steps: dict[str, list[str]], initial: list[str]) -> Pack:
    """A pack that lets nodes of a type go through the states of a property only as declared."""

    def validate(before: DataFrame, after: DataFrame) -> DataFrame:
        rows = after.where(F.col("type") == kind).select("id", F.col(prop).alias("after")).join(before.select("id", F.col(prop).alias("before")), "id", "left")
        bad = checks.transition(rows, steps, initial).where("error is not null")
        return bad.select(F.lit("error").alias("severity"), F.lit(f"workflow.{name}").alias("kind"), F.col("id").alias("node_id"), F.concat_ws(" ", "error", F.coalesce("before", F.lit("-")), F.lit("to"), F.coalesce("after", F.lit("-"))).alias("message"))

    return Pack(name, {"node": [validate]})


def issues(packs: list[Pack], what: str, before: DataFrame, after: DataFrame) -> DataFrame:
    """What all validators say of a write, in their order."""
    none = after.sparkSession.createDataFrame([], "severity string, kind string, node_id string, message string")
    for pack in packs:
        for validate in pack.validators.get(what, []):
            none = none.union(validate(before, after))
    return none


def write_nodes(packs: list[Pack], nodes: DataFrame, edges: DataFrame, new_nodes: DataFrame, new_edges: DataFrame, create: bool = False) -> tuple[DataFrame, DataFrame]:
    """mutate.written() if no validator of a node write finds an error; reactors see the rows before and after."""
    before = nodes.join(new_nodes.select("id"), "id", "left_semi")
    first = issues(packs, "node", before, new_nodes).where("severity = 'error'").first()
    if first is not None:
        raise mutate.Refused(f"{first['kind']}: {first['node_id']}: {first['message']}")
    out = mutate.written(nodes, edges, new_nodes, new_edges, create)
    for pack in packs:
        for react in pack.reactors.get("node", []):
            react(before, new_nodes)
    return out
