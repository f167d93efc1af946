"""Configuration of flows: sources, models and guides by name, with overrides."""

from __future__ import annotations

import copy
import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..sources import files
from ..sources.positions import POSITION, positioned
from .flow import Context, FlowError, Node, load
from .roles import Dataset

#: Known kinds of sources and what reads them.
KINDS = ("csv", "tsv", "parquet", "json", "release_terms")


def read_source(spark: SparkSession, spec: dict[str, Any]) -> Dataset:
    """A dataset from its specification: {kind, path, columns?, roles?}; an unbuilt one has no table."""
    kind, path = spec.get("kind", "csv"), spec.get("path")
    if kind not in KINDS:
        raise FlowError(f"unknown source kind: {kind}")
    if not path:
        return Dataset(None, dict(spec.get("roles", {})))
    if kind == "parquet":
        df = positioned(spark.read.parquet(path), POSITION)
    elif kind == "json":
        df = positioned(spark.read.json(path), POSITION)
    elif kind == "release_terms":
        c = files.read_tsv(spark, files.find_release_file(spark, path, "sct2_Concept_*.txt"), files.CONCEPT_COLUMNS)
        d = files.read_tsv(spark, files.find_release_file(spark, path, "sct2_Description_*.txt"), files.DESCRIPTION_COLUMNS)
        df = files.concept_terms(c, positioned(d)).select("sctid", F.col("fsn").alias("en"), "synonyms", F.col("first").alias(POSITION))
    else:
        columns = spec.get("columns")
        if not columns:  # the header line alone, so that all columns stay text
            first = spark.read.text(path).first()
            columns = [x.strip().strip('"') for x in (first["value"] if first else "").lstrip("﻿").split("\t" if kind == "tsv" else ",")]
        df = positioned((files.read_tsv if kind == "tsv" else files.read_csv)(spark, path, columns), POSITION)
    return Dataset(df, dict(spec.get("roles", {})))


def assemble(spark: SparkSession, flow: dict[str, Any], environment: dict[str, Any], models: dict[str, Callable]) -> tuple[list[Node], Context]:
    """The nodes of a flow and a context with just what they refer to; an unknown name is an error."""
    nodes = load(flow)
    ctx = Context(spark, models=dict(models))
    for n in nodes:
        if n.function == "datasource":
            name = n.params.get("source")
            spec = environment.get("sources", {}).get(name)
            if spec is None:
                raise FlowError(f"{n.id}: unknown source {name}")
            if name not in ctx.sources:
                ctx.sources[name] = read_source(spark, spec)
        elif n.function == "style_guide":
            name = n.params.get("guide")
            text = environment.get("guides", {}).get(name)
            if text is None:
                raise FlowError(f"{n.id}: unknown guide {name}")
            ctx.guides[name] = text
        for key in ("model_key", "reflection_model_key", "model_id"):
            if n.params.get(key) and n.params[key] not in models:
                raise FlowError(f"{n.id}: unknown model {n.params[key]}")
    return nodes, ctx


def override(flow: dict[str, Any], changes: dict[str, str]) -> dict[str, Any]:
    """A copy of a flow with parameters set: {'node.param': value}, or {'param': value} for all nodes that have it."""
    out = copy.deepcopy(flow)
    for key, value in changes.items():
        node, _, param = key.rpartition(".")
        hit = False
        for n in out["nodes"]:
            if (node and n["id"] == node) or (not node and param in n.get("params", {})):
                n.setdefault("params", {})[param] = value
                hit = True
        if not hit:
            raise FlowError(f"nothing to override: {key}")
    return out


def read_json(path: str) -> dict[str, Any]:
    with open(path, encoding="utf-8") as f:
        return json.load(f)
