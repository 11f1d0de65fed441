"""A source tree on disk, baselines of graphs and of violations."""

from __future__ import annotations

import json
import os

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata import config, schema
from codestrata.functions.classify import EXCLUDED_DIRS, is_project_file
from codestrata.operators.code import READ_LIMIT
from codestrata.storage import ship


def discover(root: str) -> list[str]:
    """Paths below ``root`` in order; linked folders, links out of the tree and excluded folders are left out."""
    real, found = os.path.realpath(root), []
    for here, dirs, names in os.walk(root):
        dirs[:] = [d for d in dirs if d not in EXCLUDED_DIRS and not d.startswith("cmake-build-") and not os.path.islink(os.path.join(here, d))]
        for name in names:
            full = os.path.join(here, name)
            if os.path.islink(full) and not os.path.realpath(full).startswith(real + os.sep):
                continue
            found.append(os.path.relpath(full, root).replace(os.sep, "/"))
    return sorted(found)


def tree(spark: SparkSession, root: str, snapshot: str = "cur", read_limit: int = READ_LIMIT) -> DataFrame:
    """``files`` of a folder that all executors can see; names are listed on the driver, contents read by the tasks."""
    ship(spark)
    paths = spark.createDataFrame([(p,) for p in discover(root)], "path string").where(is_project_file(F.col("path")))

    def kernel(batches):
        names, contents, held = [], [], 0

        def batch_of():
            nonlocal held
            out = pa.RecordBatch.from_arrays([pa.array([snapshot] * len(names)), pa.array(names), pa.array(contents, pa.binary())], names=["snapshot", "path", "content"])
            names.clear()
            contents.clear()
            held = 0
            return out

        for batch in batches:
            for path in batch.column("path").to_pylist():
                full = os.path.join(root, path)
                content = b""
                if os.path.isfile(full) and os.path.getsize(full) <= read_limit:
                    with open(full, "rb") as f:
                        content = f.read()
                names.append(path)
                contents.append(content)
                held += len(content)
                if held > 4 << 20 or len(names) >= 1000:
                    yield batch_of()
        if names:
            yield batch_of()

    return paths.mapInArrow(kernel, schema.FILES)


def save_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A graph baseline: nodes in order, edges as ordered pairs of node numbers, so equal graphs give equal bytes."""
    names = [r.path for r in nodes.select("path").distinct().orderBy("path").toLocalIterator()]
    at = {p: i for i, p in enumerate(names)}
    pairs = sorted((at[r.src], at[r.dst]) for r in edges.select("src", "dst").distinct().toLocalIterator())
    with open(path, "w", encoding="utf-8") as f:
        f.write('format_version: "1"\nnodes:\n' + "".join(f"  - {json.dumps(p, ensure_ascii=False)}\n" for p in names) + "edges:\n" + "".join(f"  - [{a}, {b}]\n" for a, b in pairs))


class BaselineError(ValueError):
    """``kind``: parse_error, unknown_version, missing_field or malformed_schema."""

    def __init__(self, kind: str, message: str):
        super().__init__(message)
        self.kind = kind


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """nodes and (unconditional) edges of a graph baseline."""
    with open(path, encoding="utf-8") as f:
        try:
            root = config.parse(f.read(), path)
        except config.ConfigError as e:
            raise BaselineError("parse_error", str(e)) from None
    if not root.is_map:
        raise BaselineError("malformed_schema", f"{path}: the top level must be a map")
    for key in ("format_version", "nodes", "edges"):
        if root.get(key) is None:
            raise BaselineError("missing_field", f"{path}: the key '{key}' is required")
    if root.get("format_version").value != "1":
        raise BaselineError("unknown_version", f"{path}: format_version {root.get('format_version').value} is not supported")
    bad = lambda what: BaselineError("malformed_schema", f"{path}: {what}")
    names, pairs = [n.value for n in root.get("nodes").value or ()], []
    if not all(isinstance(n, str) for n in names) or len(set(names)) != len(names):
        raise bad("nodes must be a list of names, each once")
    for e in root.get("edges").value or ():
        pair = [x.value for x in e.value] if isinstance(e, config.Node) and e.is_list else []
        if len(pair) != 2 or not all(isinstance(x, str) and x.isdigit() and int(x) < len(names) for x in pair):
            raise bad("edges must be pairs of node numbers")
        pairs.append((int(pair[0]), int(pair[1])))
    rows = [(names[a], names[b], False, i) for i, (a, b) in enumerate(pairs)]
    return spark.createDataFrame([(n,) for n in names], "path string"), spark.createDataFrame(rows, "src string, dst string, conditional boolean, ordinal int")


def load_violations(spark: SparkSession, path: str) -> DataFrame:
    """The violations of a saved baseline or JSON report."""
    with open(path, encoding="utf-8") as f:
        rows = json.load(f)["violations"]
    return spark.createDataFrame([(r["rule"], r["file"], int(r.get("line", 0)), r.get("message", "")) for r in rows], schema.VIOLATIONS)


def load_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """(repo, sha, label, fp_class, class) of a labelled corpus: fields between blanks, ``#`` in front a comment; short rows go."""
    t = spark.read.text(path).where("value <> '' AND NOT startswith(value, '#')").select(F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ").alias("f")).where(F.size("f") >= 5)
    return t.select(*[F.col("f")[i].alias(n) for i, n in enumerate(("repo", "sha", "label", "fp_class", "class"))])
