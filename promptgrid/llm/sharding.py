"""Document placement by a hierarchical weighted hash tree.

Each document descends region, rack and shard. At a level every child i of weight w > 0 draws -ln(u) / w, where u in
(0, 1) comes from a hash of the child's path and the document's key, and the least draw wins: child i wins with
probability w / sum of weights. A child's draw depends on no other child, so changing one weight moves documents only
to or from that child, within its parent; the other subtrees' assignments stay. A shard's share is the product of the
shares along its path.

It is one projection: no shuffle, no state, the same answer on every executor.

Defined cases. The key is ``doc_id``; null ids take the key ``null``, so they lie together. Equal ids lie together.
Equal draws go to the name that sorts first. Weight 0: never drawn. Extra columns are not read. A tree must have three
levels wherever something can be drawn.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: name -> (weight, children), the shards' children being empty.
Tree = Mapping[str, tuple[float, "Tree"]]


def _shards(*weights: float) -> Tree:
    return {f"s{i}": (w, {}) for i, w in enumerate(weights)}


DEFAULT_TREE: Tree = {
    "eu": (3.0, {"r0": (1.0, _shards(1, 1, 1, 1)), "r1": (2.0, _shards(1, 1, 2, 2, 1, 1))}),
    "us": (5.0, {"r0": (1.0, _shards(1, 1, 1, 1)), "r1": (1.0, _shards(1, 1, 1, 1)), "r2": (3.0, _shards(2, 1, 1, 2, 1, 1, 2, 2))}),
    "ap": (2.0, {"r0": (1.0, _shards(1, 3)), "r1": (1.0, _shards(2, 1, 1))}),
}
LEVELS = ("region", "rack", "shard")


def check_tree(tree: Tree, path: str = "", levels: int = len(LEVELS)) -> None:
    """Raises on negative weights, on names with the path's separator, on a level without a positive weight, and where a
    region or rack that can be drawn has no children or a shard has some."""
    if not any(w > 0 for w, _ in tree.values()):
        raise ValueError(f"no positive weight under {path or 'the root'}")
    for name, (weight, children) in tree.items():
        if weight < 0 or "/" in name or "|" in name:
            raise ValueError(f"bad weight or name: {path}/{name}")
        if weight > 0 and bool(children) != (levels > 1):
            raise ValueError(f"bad weight or name: {path}/{name} must have {'children' if levels > 1 else 'no children'}")
        if children and weight > 0:
            check_tree(children, f"{path}/{name}", levels - 1)


def _draw(path: str, weight: float, key: Column) -> Column:
    hashed = F.conv(F.substring(F.md5(F.concat(F.lit(f"{path}|"), key)), 1, 13), 16, 10).cast("double")
    return -F.log((hashed + F.lit(0.5)) / F.lit(float(2**52))) / F.lit(float(weight))


def _pick(tree: Tree, path: str, key: Column) -> Column:
    """The winner's name among the children."""
    able = sorted((name, weight) for name, (weight, _) in tree.items() if weight > 0)
    draws = [F.struct(_draw(f"{path}/{name}", weight, key).alias("draw"), F.lit(name).alias("name")) for name, weight in able]
    return (F.least(*draws) if len(draws) > 1 else draws[0])["name"]


def _choose(parents: dict[str, Tree], place: Column, key: Column) -> Column:
    chosen = None
    for path, children in parents.items():
        chosen = (F.when if chosen is None else chosen.when)(place == F.lit(path), _pick(children, path, key))
    return chosen


def assign(docs: DataFrame, tree: Tree = DEFAULT_TREE) -> DataFrame:
    """(doc_id, region, rack, shard), a row for each row of ``docs``."""
    check_tree(tree)
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    racks = {f"/{r}": children for r, (w, children) in tree.items() if w > 0}
    shards = {f"{path}/{k}": children for path, level in racks.items() for k, (w, children) in level.items() if w > 0}
    placed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _pick(tree, "", key).alias("region"))
    placed = placed.withColumn("rack", _choose(racks, F.concat(F.lit("/"), "region"), key))
    return placed.withColumn("shard", _choose(shards, F.concat(F.lit("/"), "region", F.lit("/"), "rack"), key))


def sql(tree: Tree = DEFAULT_TREE) -> str:
    """DuckDB SQL of ``assign``."""
    paths = [(level, parent, name, weight) for level, parent, name, weight in _walk(tree, "", 0) if weight > 0]
    values = ", ".join(f"({level}, '{parent}', '{name}', {float(weight)}::DOUBLE)" for level, parent, name, weight in paths)
    draw = "(-ln((('0x' || substr(md5(n.parent || '/' || n.name || '|' || coalesce(d.doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)) / n.weight"
    step = "SELECT d.u, d.doc_id, d.place || '/' || arg_min(n.name, ({draw}, n.name)) AS place FROM {source} d JOIN nodes n ON n.level = {level} AND n.parent = d.place GROUP BY d.u, d.doc_id, d.place"
    return (
        f"WITH nodes(level, parent, name, weight) AS (VALUES {values}), l0 AS (SELECT row_number() OVER () AS u, doc_id, '' AS place FROM documents), "
        + ", ".join(f"l{i + 1} AS ({step.format(draw=draw, source=f'l{i}', level=i)})" for i in range(3))
        + " SELECT doc_id, split_part(place, '/', 2) AS region, split_part(place, '/', 3) AS rack, split_part(place, '/', 4) AS shard FROM l3"
    )


def _walk(tree: Tree, parent: str, level: int):
    for name, (weight, children) in tree.items():
        yield level, parent, name, weight
        yield from _walk(children, f"{parent}/{name}", level + 1)
