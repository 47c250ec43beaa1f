"""Trained parameters as tables: forests, chains, networks, attention and calibration in one Parquet folder each.

A model is rows of (field, shape, values, text): numbers lie in `values` by rows, whatever their shape; names lie in
`text`. Tables are of the size of a model, not of the data, and are read by the driver.
"""

from __future__ import annotations

import json
from dataclasses import fields
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..operators.models import Attention, Chain, Forest, Network, Perceptron

SCHEMA = "field string, shape array<int>, values array<double>, text string"
KINDS = {"attention": Attention, "chain": Chain, "forest": Forest, "network": Network, "perceptron": Perceptron}


def _rows(model: object) -> list[tuple[str, Any]]:
    """Fields of a model as (name, array or text)."""
    if isinstance(model, Perceptron):
        return [(f"layers.{i}.{j}", np.array(x, float)) for i, layer in enumerate(model.layers) for j, x in enumerate(layer)]
    if isinstance(model, Chain):
        return [("states", json.dumps(model.states)), *((f"attributes.{k}", np.array(v, float)) for k, v in model.attributes.items()), ("transitions", np.array(model.transitions, float))]
    if isinstance(model, Forest):
        return [("classes", np.array(model.classes, float)), *((f"trees.{i}.{k}", np.array(nodes, float)) for i, (k, nodes) in enumerate(model.trees))]
    out: list[tuple[str, Any]] = []
    for f in fields(model):  # type: ignore[arg-type]
        value = getattr(model, f.name)
        if f.name == "head":
            out += [(f"head.{i}.{j}", np.array(x, float)) for i, layer in enumerate(value) for j, x in enumerate(layer)]
        elif isinstance(model, Network) and f.name in ("stack", "patch_weights", "patch_bias", "out"):
            out += [(f"{f.name}.{i}", np.array(x, float)) for i, x in enumerate(value)]
        else:
            out.append((f.name, np.array(value, float)))
    return out


def table(spark: SparkSession, model: object) -> DataFrame:
    """A model's parameters as rows."""
    rows = [(n, None, None, x) if isinstance(x, str) else (n, list(x.shape), x.ravel().tolist(), None) for n, x in _rows(model)]
    return spark.createDataFrame(rows, SCHEMA)


def write(spark: SparkSession, model: object, path: str) -> None:
    table(spark, model).coalesce(1).write.mode("overwrite").parquet(path)


def of_table(rows: DataFrame, kind: str) -> Any:  # noqa: ANN401
    """The model that rows tell; kind: one of KINDS."""
    found = {r["field"]: r["text"] if r["values"] is None else np.array(r["values"]).reshape(r["shape"]) for r in rows.collect()}
    numbered = lambda name: [found[k] for k in sorted((k for k in found if k.startswith(f"{name}.")), key=lambda k: [int(x) for x in k.split(".")[1:]])]
    if kind == "perceptron":
        flat = numbered("layers")
        return Perceptron([(flat[i].tolist(), flat[i + 1].tolist()) for i in range(0, len(flat), 2)])
    if kind == "chain":
        return Chain(tuple(json.loads(found["states"])), {k.partition(".")[2]: tuple(v.tolist()) for k, v in found.items() if k.startswith("attributes.")}, tuple(map(tuple, found["transitions"].tolist())))
    if kind == "forest":
        names = sorted((k for k in found if k.startswith("trees.")), key=lambda k: int(k.split(".")[1]))
        return Forest([(int(k.split(".")[2]), [(int(f), t, int(y), int(n), v) for f, t, y, n, v in found[k].tolist()]) for k in names], int(found["classes"]))
    if kind == "attention":
        return Attention(*(found[n].tolist() for n in ("slope", "constant", "kernel", "bias")), float(found["temperature"]))
    if kind == "network":
        head = numbered("head")
        return Network(found["embedding"], numbered("stack"), found["patches"].astype(int), numbered("patch_weights"), numbered("patch_bias"), found["query"], found["values"], [tuple(head[i : i + 4]) for i in range(0, len(head), 4)], tuple(numbered("out")), int(found["pool"]), float(found["leak"]))
    raise ValueError(f"no such model: {kind}")


def read(spark: SparkSession, path: str, kind: str) -> Any:  # noqa: ANN401
    return of_table(spark.read.schema(SCHEMA).parquet(path), kind)


def forest_of_json(text: str) -> Forest:
    """A forest of the boosted trees in gradient boosting's public JSON model format; missing values go to `yes`."""
    model = json.loads(text)["learner"]["gradient_booster"]["model"]
    trees = []
    for k, t in zip(model["tree_info"], model["trees"], strict=True):
        parts = zip(t["left_children"], t["right_children"], t["split_indices"], t["split_conditions"], strict=True)
        trees.append((int(k), [(-1, 0.0, 0, 0, float(c)) if left < 0 else (int(f), float(c), int(left), int(right), 0.0) for left, right, f, c in parts]))
    return Forest(trees, max(1, *(k + 1 for k, _ in trees)))
