"""Label taxonomies as flat trees: (framework, node_id, parent_id, name, type, definition, depth, path)."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.operators.intervals import overlapping

SCHEMA = "framework string, node_id string, parent_id string, name string, type string, definition string, depth int, path string"


def flatten(files: DataFrame) -> DataFrame:
    """Trees of any depth out of (path, value) JSON documents; Spark has no recursive type, so each file is walked in Python."""

    def walk(frames):
        for f in frames:
            rows = []
            for text in f["value"]:
                doc = json.loads(text)
                stack = [(doc.get("root") or {}, None, 0, "")]
                while stack:
                    node, parent, depth, path = stack.pop()
                    here = f"{path}/{node.get('name', '')}"
                    rows.append((doc.get("name"), node.get("id"), parent, node.get("name"), node.get("type"), node.get("definition"), depth, here))
                    stack += [(c, node.get("id"), depth + 1, here) for c in reversed(node.get("children") or [])]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return files.select("value").mapInPandas(walk, SCHEMA)


def tier_name(name: str) -> str:
    return name.strip().upper().replace(" ", "-")


def add(tree: DataFrame, framework: str, parent: str, node_id: str, name: str, kind: str = "label", definition: str = "") -> DataFrame:
    """tree with a node under the path `parent`; a sibling of that name is an error."""
    name = tier_name(name) if kind == "tier" else name
    here = tree.where((F.col("framework") == framework) & (F.col("path") == parent)).select("node_id", "depth").head()
    if here is None:
        raise ValueError(f"no node {parent}")
    if tree.where((F.col("framework") == framework) & (F.col("path") == f"{parent}/{name}")).limit(1).count():
        raise ValueError(f"{name} exists already")
    row = [(framework, node_id, here.node_id, name, kind, definition, here.depth + 1, f"{parent}/{name}")]
    return tree.unionByName(tree.sparkSession.createDataFrame(row, SCHEMA))


def rename(tree: DataFrame, framework: str, path: str, name: str) -> DataFrame:
    """The node at a path and the paths below it under a new name; the root keeps its own."""
    if path.count("/") < 2:
        raise ValueError("the root keeps its name")
    new = path.rsplit("/", 1)[0] + "/" + name
    inside = (F.col("framework") == framework) & ((F.col("path") == path) | F.col("path").startswith(path + "/"))
    moved = F.concat(F.lit(new), F.substring(F.col("path"), F.lit(len(path) + 1), F.length("path")))
    return tree.withColumn("name", F.when((F.col("framework") == framework) & (F.col("path") == path), name).otherwise(F.col("name"))).withColumn("path", F.when(inside, moved).otherwise(F.col("path")))


def delete(tree: DataFrame, framework: str, path: str) -> DataFrame:
    if path.count("/") < 2:
        raise ValueError("the root stays")
    return tree.where(~((F.col("framework") == framework) & ((F.col("path") == path) | F.col("path").startswith(path + "/"))))


def define(tree: DataFrame, framework: str, path: str, definition: str) -> DataFrame:
    here = (F.col("framework") == framework) & (F.col("path") == path)
    return tree.withColumn("definition", F.when(here, definition).otherwise(F.col("definition")))


def _pairs(manual: DataFrame, automatic: DataFrame) -> DataFrame:
    return overlapping(automatic, manual.select("doc_id", F.col("start").alias("other_start"), F.col("end").alias("other_end")))


def merge_annotations(manual: DataFrame, automatic: DataFrame) -> DataFrame:
    """Manual spans and those automatic ones that overlap none of them; (doc_id, start, end, label)."""
    taken = _pairs(manual, automatic.select("doc_id", "start", "end")).select("doc_id", "start", "end").distinct()
    free = automatic.select("doc_id", "start", "end", "label").join(taken, ["doc_id", "start", "end"], "left_anti")
    return manual.select("doc_id", "start", "end", "label").unionByName(free)


def merge_distinct(manual: DataFrame, automatic: DataFrame) -> DataFrame:
    """Manual spans and those automatic ones that no manual one equals in place and label."""
    same = ["doc_id", "start", "end", "label"]
    return manual.select(same).unionByName(automatic.select(same).join(manual.select(same).distinct(), same, "left_anti"))


def conflicts(manual: DataFrame, automatic: DataFrame) -> DataFrame:
    """Automatic spans (doc_id, start, end, label) that cross a manual one: they overlap, and neither holds the other's ends."""
    s, e, p, q = (F.col(c) for c in ("start", "end", "other_start", "other_end"))
    crossing = _pairs(manual, automatic.select("doc_id", "start", "end").distinct()).where(((p < s) & (s < q) & (q < e)) | ((s < p) & (p < e) & (e < q)))
    return automatic.select("doc_id", "start", "end", "label").join(crossing.select("doc_id", "start", "end").distinct(), ["doc_id", "start", "end"], "left_semi")
