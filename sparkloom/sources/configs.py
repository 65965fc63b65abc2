"""Configurations from YAML files: nested mappings of scalars, with comments. Files are a few lines and are read by the driver."""

from __future__ import annotations

import ast
import os

from pyspark.sql import DataFrame, SparkSession

from .files import listed, opened

FOLDER = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "configs")


def _scalar(text: str):
    if text.lower() in ("", "null", "~"):
        return None
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    try:
        return ast.literal_eval(text)
    except (ValueError, SyntaxError):
        return text


def parse(text: str) -> dict:
    """Mappings by indentation. Lists, anchors and texts of several lines are an error or stay text."""
    top: dict = {}
    open_ = [(-1, top)]
    for number, line in enumerate(text.splitlines(), 1):
        body = line.split(" #", 1)[0].rstrip() if not line.lstrip().startswith("#") else ""
        if not body.strip():
            continue
        indent, (key, colon, value) = len(body) - len(body.lstrip()), body.strip().partition(":")
        if not colon:
            raise ValueError(f"line {number} is no mapping: {line!r}")
        while indent <= open_[-1][0]:
            open_.pop()
        into = open_[-1][1]
        if value.strip():
            into[key.strip()] = _scalar(value.strip())
        else:
            into[key.strip()] = {}
            open_.append((indent, into[key.strip()]))
    return top


def load(kind: str, name: str, folder: str = FOLDER) -> dict:
    """The configuration `name` (or a path that ends in .yaml) of a kind: models or training. One that is not there is a KeyError."""
    path = name if name.endswith(".yaml") and "/" in name else f"{folder}/{kind}/{name.removesuffix('.yaml')}.yaml"
    try:
        with opened(path) as f:
            return parse(f.read().decode())
    except FileNotFoundError:
        raise KeyError(f"there is no configuration {path}") from None


def load_model(name: str, folder: str = FOLDER) -> dict:
    return load("models", name, folder)


def load_training(name: str, folder: str = FOLDER) -> dict:
    return load("training", name, folder)


def models(spark: SparkSession, schema: str, folder: str = FOLDER) -> DataFrame:
    """All model configurations of a folder as rows of the schema."""
    names = [n for n, _ in listed(spark, f"{folder}/models", "*.yaml")]
    fields = [x.split()[0] for x in schema.split(", ")]
    return spark.createDataFrame([tuple(c[f] for f in fields) for c in (load_model(n, folder) for n in names)], schema)
