"""Repository sources: file discovery, snapshot metadata and the commit log."""

from __future__ import annotations

import hashlib
import os
import struct
import subprocess
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandgraph.config import EXTRACTOR_VERSION, GRAPH_SCHEMA_VERSION, RepositoryStateError, RetrievalConfig, full_commit
from strandgraph.functions.text import repository_name, sanitize_remote_url
from strandgraph.sources.python_source import EXCLUDED, LANGUAGES, indexed

DIGEST_TAG = b"strandgraph-indexed-source-v1\0"


def git(root: Path, *arguments: str, required: bool = True) -> str | None:
    done = subprocess.run(["git", "-C", str(root), *arguments], capture_output=True, text=True, check=False)
    if done.returncode:
        if required:
            raise RepositoryStateError(f"git {arguments[0]} failed: {done.stderr.strip()}")
        return None
    return done.stdout


def _wanted(path: str) -> bool:
    return Path(path).suffix.lower() in LANGUAGES and not set(path.split("/")) & set(EXCLUDED)


def discover(root: Path) -> list[str]:
    """Relative paths of indexed files in order of their parts: git's view, else a walk."""
    listed = git(root, "ls-files", "-co", "--exclude-standard", "-z", required=False)
    if listed is not None:
        found = {p for p in listed.split("\0") if p}
    else:
        found = set()
        for folder, names, files in os.walk(root):
            names[:] = [n for n in names if n not in EXCLUDED and not os.path.islink(os.path.join(folder, n))]
            found |= {os.path.relpath(os.path.join(folder, f), root).replace(os.sep, "/") for f in files}
    wanted = [p for p in found if _wanted(p) and os.path.lexists(root / p)]
    return sorted((p for p in wanted if check_path(root, p).is_file()), key=lambda p: p.split("/"))


def check_path(root: Path, path: str) -> Path:
    """The file inside the repository; links and climbing paths are refused."""
    at = root
    for part in path.split("/"):
        at = at / part
        if part in ("", "..") or at.is_symlink():
            raise RepositoryStateError(f"unsafe source path: {path}")
    return at


def read_files(spark: SparkSession, root: Path, paths: list[str]) -> DataFrame:
    """``(path, content, problem)`` of the listed files, read by the executors from a folder they share.

    A file that cannot be read has no content and a problem. Spark's own file sources skip
    names that start with an underscore, such as package files.
    """
    base = root.resolve()
    for path in paths:
        check_path(base, path)
    listed = spark.createDataFrame([(p,) for p in paths], "path string")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                content, problem = None, None
                try:
                    content = (base / path).read_bytes()
                except OSError as error:
                    problem = str(error)
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([content], pa.binary()), pa.array([problem], pa.string())], names=["path", "content", "problem"])

    return listed.filter(indexed(F.col("path"))).mapInArrow(read, "path string, content binary, problem string")


def read_log(spark: SparkSession, root: Path) -> DataFrame:
    """``(commit_id, path, ord)`` of all commits but merges, ``ord`` 0 for the newest; no log gives no rows."""
    text = git(root, "log", "--no-merges", "--format=@@%H", "--name-only", required=False) or ""
    rows, commit, place = [], "", -1
    for line in text.splitlines():
        if line.startswith("@@"):
            commit, place = line[2:], place + 1
        elif line:
            rows.append((commit, line, place))
    return spark.createDataFrame(rows, "commit_id string, path string, ord int")


def source_digest(root: Path, paths: list[str]) -> str:
    """SHA-256 over the tag and, by path, the lengths and bytes of name and content."""
    digest = hashlib.sha256(DIGEST_TAG)
    for path in sorted(paths):
        for part in (path.encode(), check_path(root, path).read_bytes()):
            digest.update(struct.pack(">Q", len(part)))
            digest.update(part)
    return digest.hexdigest()


@dataclass(frozen=True)
class Snapshot:
    name: str
    remote_url: str | None
    commit_sha: str
    tree_sha: str
    branch: str | None
    detached: bool
    dirty: bool
    shallow: bool
    indexed_source_sha256: str
    graph_schema_version: str = GRAPH_SCHEMA_VERSION
    extractor_version: str = EXTRACTOR_VERSION
    retrieval: dict | None = field(default=None, compare=False)


def snapshot(spark: SparkSession, root: Path, paths: list[str], *, public: bool = False, expected_commit: str | None = None, retrieval: RetrievalConfig | None = None) -> Snapshot:
    """State of the repository. Public mode asks for a clean, complete checkout of the expected commit."""
    commit = git(root, "rev-parse", "HEAD").strip()
    branch = (git(root, "symbolic-ref", "--short", "-q", "HEAD", required=False) or "").strip() or None
    dirty = bool(git(root, "status", "--porcelain", "--untracked-files=all").strip())
    shallow = git(root, "rev-parse", "--is-shallow-repository").strip() == "true"
    remote = (git(root, "remote", "get-url", "origin", required=False) or "").strip() or None
    row = spark.createDataFrame([(remote, root.name)], "r string, folder string").select(sanitize_remote_url(F.col("r")).alias("url"), "folder")
    row = row.select("url", repository_name(F.col("url"), F.col("folder")).alias("name")).first()
    if public and (dirty or shallow or commit != full_commit(expected_commit)):
        raise RepositoryStateError("public mode needs a clean, complete checkout of the expected commit")
    return Snapshot(row["name"], row.url, commit, git(root, "rev-parse", "HEAD^{tree}").strip(), branch, branch is None, dirty, shallow, source_digest(root, paths), retrieval=asdict(retrieval or RetrievalConfig()))


def verify_snapshot(spark: SparkSession, root: Path, before: Snapshot) -> None:
    """Raise if the repository changed since ``before``."""
    now = snapshot(spark, root, discover(root))
    changed = [name for name, value in asdict(before).items() if name != "retrieval" and getattr(now, name) != value]
    if changed:
        raise RepositoryStateError(f"the repository changed while it was read: {', '.join(changed)}")
