"""Source files of repositories: which ones there are, and their contents as a table.

Spark's own file sources skip names that begin with an underscore, ``__init__.py`` among them, so the driver lists the paths (names alone,
no contents) and the executors read the files, from any file system that PyArrow opens by its address.
"""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.columns import has_binary_mark, matches_any
from loomgraph.sources.registry import is_supported

#: Shell patterns of paths, relative to the root, that aren't source code.
IGNORED = (
    "*.db *.db-journal *.db-wal *.sqlite *.lock *.map *.pyc *.min.css *.min.js .terraform.lock.hcl package-lock.json yarn.lock "
    ".git/** .loomgraph/** .next/** .terraform/** .venv/** __pycache__/** build/** dist/** node_modules/** target/** venv/**"
).split()
IGNORE_FILE = ".loomgraphignore"
#: Seconds after which a call of git is given up.
GIT_SECONDS = int(os.environ.get("LOOMGRAPH_GIT_TIMEOUT", "30"))
#: Bytes of contents of one batch that a reader sends.
BATCH_BYTES = 4_000_000


def git(root: str, *args: str) -> tuple[int, list[str]]:
    """(exit code, lines) of a git command in a repository; (1, []) where git isn't there or takes too long."""
    try:
        done = subprocess.run(["git", *args], cwd=root, capture_output=True, text=True, timeout=GIT_SECONDS)
    except (OSError, subprocess.TimeoutExpired):
        return 1, []
    return done.returncode, [x.rstrip() for x in done.stdout.splitlines() if x.strip()]


def tracked(root: str) -> list[str]:
    """Paths that git tracks."""
    return [x.strip() for x in git(root, "ls-files")[1]]


def changed_since(root: str, base: str = "HEAD~1") -> list[str]:
    """Paths that differ from a commit; what is staged, where there is no such commit."""
    code, found = git(root, "diff", "--name-only", base)
    return [x.strip() for x in (found if code == 0 else git(root, "diff", "--name-only", "--cached")[1])]


def uncommitted(root: str) -> list[str]:
    """Staged, changed and untracked paths; a renamed file under its new name."""
    return [x[3:].strip().split(" -> ", 1)[-1] for x in git(root, "status", "--porcelain")[1] if len(x) > 3]


def repository_root(start: str | None = None) -> str | None:
    """The nearest folder upwards that git knows, or None."""
    at = Path(start or os.getcwd())
    return next((str(p) for p in (at, *at.parents) if (p / ".git").exists()), None)


def project_root(start: str | None = None) -> str:
    """``repository_root``, or the start itself."""
    return repository_root(start) or str(start or os.getcwd())


def ignore_patterns(root: str) -> list[str]:
    """``IGNORED`` and the lines of the root's ignore file, without blanks and comments."""
    at = Path(root) / IGNORE_FILE
    own = [x.strip() for x in at.read_text(errors="replace").splitlines()] if at.is_file() else []
    return [*IGNORED, *(x for x in own if x and not x.startswith("#"))]


def list_paths(root: str) -> list[str]:
    """Relative paths of files under a root: those that git tracks, else all; no symbolic links."""
    if "://" in root:
        from pyarrow import fs

        system, at = fs.FileSystem.from_uri(root)
        found = system.get_file_info(fs.FileSelector(at, recursive=True))
        return [i.path[len(at) :].lstrip("/") for i in found if i.type == fs.FileType.File]
    names = tracked(root) or [os.path.relpath(os.path.join(d, f), root) for d, _, files in os.walk(root) for f in files]
    return [n for n in names if os.path.isfile(p := os.path.join(root, n)) and not os.path.islink(p)]


def paths_table(spark: SparkSession, root: str, names: list[str] | None = None) -> DataFrame:
    """(file_path, name) of the files under a root, or of some names there, that have a parser and aren't ignored."""
    root = root.rstrip("/")
    names = list_paths(root) if names is None else names
    table = pa.table({"file_path": pa.array([f"{root}/{n}" for n in names], pa.string()), "name": pa.array(names, pa.string())})
    return spark.createDataFrame(table).filter(~matches_any(F.col("name"), ignore_patterns(root) if "://" not in root else IGNORED) & is_supported(F.col("name")))


def read_contents(paths: DataFrame) -> DataFrame:
    """(file_path, content) of paths; a file that is gone or can't be read has null."""

    def read(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in source:
            held: list[tuple[str, bytes | None]] = []
            for path in batch.column(0).to_pylist():
                system, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
                try:
                    with system.open_input_stream(at) as f:
                        held.append((path, f.read()))
                except OSError:
                    held.append((path, None))
                if sum(len(c or b"") for _, c in held) > BATCH_BYTES:
                    yield _batch(held)
                    held = []
            yield _batch(held)

    return paths.select("file_path").repartition("file_path").mapInArrow(read, "file_path string, content binary")


def _batch(held: list[tuple[str, bytes | None]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p for p, _ in held], pa.string()), pa.array([c for _, c in held], pa.binary())], ["file_path", "content"])


def source_files(spark: SparkSession, root: str, names: list[str] | None = None) -> DataFrame:
    """(file_path, content) of a root's source files, binary ones left out."""
    return read_contents(paths_table(spark, root, names)).filter(~has_binary_mark(F.col("content")))
