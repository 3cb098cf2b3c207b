"""Sequences as FASTA text and trees as Newick text."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import accession


def records(spark: SparkSession, path: str) -> DataFrame:
    """(value): each record of FASTA files, from its header on.

    Records begin with a > at the start of a line; one within a header is part of it, further ones at its start are not.
    """
    return spark.read.option("lineSep", "\n>").text(path).where(F.regexp_replace("value", r"^>+", "").rlike(r"\S"))


def header() -> Column:
    """Of a record."""
    return F.regexp_replace(F.get(F.split("value", "\n", 2), F.lit(0)), r"^>*\s*|\s+$", "")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(accession, header, seq) of each record; lines of a sequence are joined."""
    seq = F.regexp_replace(F.coalesce(F.get(F.split("value", "\n", 2), F.lit(1)), F.lit("")), r"\s", "")
    return records(spark, path).select(accession(header()).alias("accession"), header().alias("header"), seq.alias("seq"))


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """(accession, header) of each record; sequences are not kept."""
    return records(spark, path).select(accession(header()).alias("accession"), header().alias("header"))


def write_fasta(sequences: DataFrame, path: str, width: int = 80) -> None:
    """One text part for each partition; sequences (header, seq) are wrapped."""
    wrapped = F.rtrim(F.regexp_replace("seq", f"(.{{{width}}})", "$1\n"), F.lit("\n"))
    sequences.select(F.concat(F.lit(">"), "header", F.lit("\n"), wrapped).alias("value")).write.text(path)


def parse_newick(text: str) -> list[tuple[int, int | None, float | None, str]]:
    """(node, parent, branch, name) in the order nodes begin; the root is 0. Quotes keep their contents, [..] is skipped."""
    rows: list[list[object]] = [[0, None, None, ""]]
    at, i, n = 0, 0, len(text)
    while i < n and text[i] != ";":
        c = text[i]
        if c in "(,":
            parent = at if c == "(" else rows[at][1]
            rows.append([len(rows), parent, None, ""])
            at, i = len(rows) - 1, i + 1
        elif c == ")":
            at, i = int(rows[at][1]), i + 1  # type: ignore[call-overload]
        elif c == "[":
            i = text.index("]", i) + 1
        elif c == "'":
            end = text.index("'", i + 1)
            rows[at][3], i = text[i + 1 : end], end + 1
        elif c.isspace():
            i += 1
        else:
            end = i + (c == ":")
            while end < n and text[end] not in "(),:;[" and not text[end].isspace():
                end += 1
            if c == ":":
                rows[at][2] = float(text[i + 1 : end])
            else:
                rows[at][3] = text[i:end]
            i = end
    return [(int(a), None if b is None else int(b), c, str(d)) for a, b, c, d in rows]  # type: ignore[call-overload, misc]


def _parsed(spark: SparkSession, path: str, parse: Callable[[str], list[Any]], columns: dict[str, str]) -> DataFrame:
    """(file, columns) of trees, one in each file, parsed a file at a time."""
    files = spark.read.option("wholetext", True).text(path).select("value", F.input_file_name().alias("file"))
    kinds = {"bigint": pa.int64(), "double": pa.float64(), "string": pa.string()}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                found = list(zip(*parse(row["value"]), strict=True))
                arrays = [pa.array([row["file"]] * len(found[0]), pa.string()), *(pa.array(c, kinds[k]) for c, k in zip(found, columns.values(), strict=True))]
                yield pa.RecordBatch.from_arrays(arrays, names=["file", *columns])

    return files.mapInArrow(rows, ", ".join(["file string", *(f"{c} {k}" for c, k in columns.items())]))


def read_newick(spark: SparkSession, path: str) -> DataFrame:
    """(file, node, parent, branch, name) of trees, one in each file."""
    return _parsed(spark, path, parse_newick, {"node": "bigint", "parent": "bigint", "branch": "double", "name": "string"})


def _number(attributes: dict[str, Any], name: str) -> float | None:
    value = attributes.get(name)
    value = value.get("value") if isinstance(value, dict) else value
    return float(value) if isinstance(value, int | float) and not isinstance(value, bool) else None


def parse_tree_json(text: str) -> list[tuple[int, int | None, float, float, str]]:
    """(node, parent, branch, root_dist, name) of a nested JSON tree in order: a node's cumulative `div` where it has one,
    else its `branch_length`, gives the branch; no branch is below zero."""
    tree = json.loads(text)
    todo: list[tuple[dict[str, Any], int | None, float]] = [(tree.get("tree", tree), None, 0.0)]
    rows: list[tuple[int, int | None, float, float, str]] = []
    while todo:
        node, parent, above = todo.pop()
        attributes = node.get("node_attrs") or {}
        div, length = _number(attributes, "div"), _number(node, "branch_length")
        branch = max(0.0, div - above) if div is not None else max(0.0, length or 0.0)
        own = len(rows)
        rows.append((own, parent, branch if parent is not None else 0.0, above + branch, str(node.get("name", ""))))
        todo += [(child, own, above + branch) for child in reversed(node.get("children") or [])]
    return rows


def read_tree_json(spark: SparkSession, path: str) -> DataFrame:
    """(file, node, parent, branch, root_dist, name) of trees, one in each file."""
    return _parsed(spark, path, parse_tree_json, {"node": "bigint", "parent": "bigint", "branch": "double", "root_dist": "double", "name": "string"})
