"""Category hierarchies and the expansion of annotations to ancestors."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Hierarchy:
    """child -> parent over category ids. Categories made up for inner nodes have ids from -2 down. Trees are small."""

    parents: dict[int, int]
    names: dict[int, str] = field(default_factory=dict)

    def __post_init__(self):
        for node in self.parents:
            self.ancestors(node)

    def ancestors(self, node: int) -> list[int]:
        """The node itself up to its root; ValueError for a cycle."""
        out = [node]
        while out[-1] in self.parents:
            if self.parents[out[-1]] in out:
                raise ValueError(f"cycle at category {node}")
            out.append(self.parents[out[-1]])
        return out

    def children(self, node: int) -> list[int]:
        return sorted(c for c, p in self.parents.items() if p == node)

    def parent(self, node: int) -> int | None:
        return self.parents.get(node)

    @classmethod
    def from_supercategories(cls, categories: DataFrame) -> Hierarchy:
        """Parents by supercategory name: the category of that name, or a made-up one."""
        rows = sorted((r["id"], r["name"], r["supercategory"]) for r in categories.select("id", "name", "supercategory").collect())
        by_name, made, parents = {n: i for i, n, _ in rows}, {}, {}
        for i, name, above in rows:
            if above and above != name:
                parents[i] = by_name[above] if above in by_name else made.setdefault(above, -2 - len(made))
        return cls(parents, {i: n for n, i in {**by_name, **made}.items()})

    @classmethod
    def from_tree(cls, tree: dict | str, ids: dict[str, int]) -> Hierarchy:
        """From nested LabelName / Subcategory objects (or a JSON file); labels without an id get made-up ones."""
        if isinstance(tree, str):
            with open(tree) as f:
                tree = json.load(f)
        made: dict[str, int] = {}
        number = lambda x: ids[x] if x in ids else made.setdefault(x, -2 - len(made))
        parents, waiting = {}, [tree]
        while waiting:
            node = waiting.pop()
            for child in node.get("Subcategory", ()):
                parents[number(child["LabelName"])] = number(node["LabelName"])
                waiting.append(child)
        return cls(parents, {i: n for n, i in {**ids, **made}.items()})

    def closure(self, spark) -> DataFrame:
        """category_id, ancestor, step of all proper ancestors."""
        rows = [(n, a, i) for n in self.parents for i, a in enumerate(self.ancestors(n)) if i]
        return spark.createDataFrame(rows, "category_id bigint, ancestor bigint, step int")


def expand(annotations: DataFrame, hierarchy: Hierarchy) -> DataFrame:
    """Annotations with copies for every ancestor of their category, one for each image, box and category.

    Copies get ids behind the largest one, in order of the original and the
    step to the ancestor; the numbering is by ranges, as ``numbered`` does it.
    """
    from detlake.operators.ranking import numbered

    spark = annotations.sparkSession
    copies = annotations.join(F.broadcast(hierarchy.closure(spark)), "category_id").withColumn("category_id", F.col("ancestor")).drop("ancestor")
    box = ["image_id", "category_id", "x", "y", "w", "h"]
    copies = copies.join(annotations.select(*box).distinct(), box, "left_anti")
    first = F.row_number().over(Window.partitionBy(*box).orderBy("id", "step"))
    copies = copies.withColumn("_first", first).where("_first = 1").drop("_first")
    top = annotations.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    ranked = numbered(copies, F.col("id") * 64 + F.col("step")).withColumn("id", F.col("number") + top + 1).drop("number", "step")
    return annotations.unionByName(ranked.select(*annotations.columns))
