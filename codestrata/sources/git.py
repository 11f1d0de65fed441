"""Git as a source: trees, diffs and history of a repository whose folder all executors can see.

Listings are made on the driver (names only); contents are read by the tasks, each through one long-lived batch child.
"""

from __future__ import annotations

import os
import subprocess

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata import schema
from codestrata.functions.classify import has_excluded_dir, is_project_file
from codestrata.operators import history as _history
from codestrata.operators import lines as _lines
from codestrata.operators.code import READ_LIMIT
from codestrata.storage import ship

QUIET = [x for o in ("core.hooksPath=/dev/null", "core.fsmonitor=false", "core.pager=cat", "core.quotePath=false", "protocol.ext.allow=never") for x in ("-c", o)]


def _command(root: str, *args: str) -> list[str]:
    return ["git", "-C", root, *QUIET, *args]


def _env() -> dict[str, str]:
    return os.environ | {"GIT_CONFIG_NOSYSTEM": "1", "GIT_TERMINAL_PROMPT": "0", "GIT_OPTIONAL_LOCKS": "0", "LC_ALL": "C"}


def git(root: str, *args: str) -> str:
    done = subprocess.run(_command(root, *args), env=_env(), capture_output=True)
    if done.returncode:
        raise ValueError(f"git {args[0]}: {done.stderr.decode('utf-8', 'replace').strip()}")
    return done.stdout.decode("utf-8", "surrogateescape")


def parse_revspec(spec: str) -> tuple[str, str | None]:
    """``a..b`` to both, ``a`` to ``a`` and the work tree (None)."""
    if "..." in spec:
        raise ValueError("symmetric ranges are not supported")
    a, dots, b = spec.partition("..")
    if not a or (dots and not b) or a.startswith("-") or b.startswith("-"):
        raise ValueError(f"not a revision range: {spec!r}")
    return a, b or None


def find_root(path: str) -> str:
    return git(path, "rev-parse", "--show-toplevel").rstrip("\n")


def _own(df: DataFrame) -> DataFrame:
    return df.where(is_project_file(F.col("path")) & ~has_excluded_dir(F.col("path")))


def tree(spark: SparkSession, root: str, ref: str, snapshot: str = "cur", read_limit: int = READ_LIMIT) -> DataFrame:
    """``files`` of a revision; a blob over ``read_limit`` counts as empty, as does one that is missing."""
    ship(spark)
    commit = git(root, "rev-parse", "--verify", f"{ref}^{{commit}}").strip()
    names = [x for x in git(root, "ls-tree", "-r", "-z", "--name-only", commit).split("\0") if x and "\n" not in x]
    paths = _own(spark.createDataFrame([(x.encode("utf-8", "surrogateescape").decode("utf-8", "replace"),) for x in names], "path string"))
    command, env = _command(root, "cat-file", "--batch"), {k: v for k, v in _env().items() if k.startswith(("GIT_", "LC_", "PATH", "HOME"))}

    def kernel(batches):
        with subprocess.Popen(command, env=env, stdin=subprocess.PIPE, stdout=subprocess.PIPE) as child:
            for batch in batches:
                for name in batch.column("path").to_pylist():
                    child.stdin.write(f"{commit}:{name}\n".encode())
                    child.stdin.flush()
                    head = child.stdout.readline().split()
                    content = b""
                    if len(head) == 3 and head[1] == b"blob":
                        left = int(head[2])
                        if left <= read_limit:
                            content = child.stdout.read(left)
                        else:
                            while left:
                                left -= len(child.stdout.read(min(left, 1 << 20)))
                        child.stdout.read(1)
                    yield pa.RecordBatch.from_arrays([pa.array([snapshot]), pa.array([name]), pa.array([content], pa.binary())], names=["snapshot", "path", "content"])
            child.stdin.close()

    return paths.repartition(max(1, min(len(names) // 500 + 1, 10_000))).mapInArrow(kernel, schema.FILES)


def _numbered(spark: SparkSession, text: str) -> DataFrame:
    clean = text.encode("utf-8", "surrogateescape").decode("utf-8", "replace")
    return spark.createDataFrame([(n, x.rstrip("\r")) for n, x in enumerate(clean.split("\n")) if x], "n long, line string")


def _range(base: str, cur: str | None) -> list[str]:
    return [base] if cur is None else [base, cur]


def diff_lines(spark: SparkSession, root: str, base: str, cur: str | None) -> DataFrame:
    return _lines.parse_diff(_numbered(spark, git(root, "diff", "--unified=0", "--no-color", "--no-ext-diff", "--no-textconv", *_range(base, cur), "--")))


def numstat(spark: SparkSession, root: str, base: str, cur: str | None) -> DataFrame:
    return _lines.parse_numstat(_numbered(spark, git(root, "diff", "--numstat", "--no-ext-diff", *_range(base, cur), "--")))


def renamed(spark: SparkSession, root: str, base: str, cur: str | None) -> DataFrame:
    """(path) on the new side of renames."""
    rows = [x.split("\t")[2] for x in git(root, "diff", "--name-status", "-M", "--diff-filter=R", *_range(base, cur), "--").splitlines() if x.count("\t") == 2]
    return spark.createDataFrame([(x,) for x in rows], "path string")


def changed(spark: SparkSession, root: str, base: str, cur: str | None) -> DataFrame:
    """(path) of project files that differ; untracked ones belong to the work tree."""
    names = git(root, "diff", "--name-only", "--no-renames", "-z", *_range(base, cur), "--").split("\0")
    if cur is None:
        names += git(root, "ls-files", "-z", "--others", "--exclude-standard").split("\0")
    return _own(spark.createDataFrame([(x,) for x in names if x], "path string"))


def history(spark: SparkSession, root: str, limit: int = 200) -> tuple[DataFrame, DataFrame]:
    """commits and changes of the last ``limit`` commits, the newest at 0."""
    return _history.parse_log(_numbered(spark, git(root, "log", f"-n{int(limit)}", "--numstat", "--format=%H%x1f%s")))
