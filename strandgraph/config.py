"""Driver-side settings and errors."""

from __future__ import annotations

import math
import os
import re
from collections.abc import Mapping
from dataclasses import dataclass, field
from pathlib import Path

GRAPH_SCHEMA_VERSION = EXTRACTOR_VERSION = "1.0.0"
BUNDLE_SCHEMA_VERSION = BENCHMARK_SCHEMA_VERSION = 1
WEB_DATA_SCHEMA_VERSION = 3
TARGET_VARIABLE = "CODE_GRAPH_TARGET"
_COMMIT = re.compile("[0-9a-f]{40}")


class RepositoryStateError(ValueError):
    """The repository is not in the state the mode asks for."""


class BundleError(ValueError):
    """A query bundle contradicts itself or its schema."""


class BenchmarkError(ValueError):
    """A judged benchmark or a ranking is malformed."""


class PublicExportError(ValueError):
    """A payload must not be published."""


def full_commit(value: str | None) -> str | None:
    """A whole commit id in lower case; None stays."""
    if value is None:
        return None
    if not _COMMIT.fullmatch(value.lower()):
        raise ValueError("a commit must be given by its full 40 hexadecimal digits")
    return value.lower()


@dataclass(frozen=True)
class RetrievalConfig:
    seed_count: int = 6
    hops: int = 2
    related_count: int = 25
    hop_decay: float = 0.85

    def __post_init__(self) -> None:
        for name in ("seed_count", "hops", "related_count"):
            value = getattr(self, name)
            if isinstance(value, bool) or not isinstance(value, int) or value < 1:
                raise ValueError(f"{name} must be a positive integer")
        if isinstance(self.hop_decay, bool) or not math.isfinite(self.hop_decay) or not 0 < self.hop_decay <= 1:
            raise ValueError("hop_decay must lie in (0, 1]")


@dataclass(frozen=True)
class GraphConfig:
    """``public`` and ``demo`` graphs are those that may be published: they name their commit."""

    repository: Path
    mode: str = "dev"
    expected_commit: str | None = None
    cochange_minimum_support: int = 2
    cochange_maximum_files: int = 20
    retrieval: RetrievalConfig = field(default_factory=RetrievalConfig)

    def __post_init__(self) -> None:
        object.__setattr__(self, "repository", Path(self.repository).expanduser().resolve())
        if self.mode not in ("dev", "public", "demo"):
            raise ValueError("mode must be dev, public or demo")
        object.__setattr__(self, "expected_commit", full_commit(self.expected_commit))
        if self.is_public and self.expected_commit is None:
            raise ValueError(f"mode {self.mode} needs an expected commit")
        if self.cochange_minimum_support < 1 or self.cochange_maximum_files < 2:
            raise ValueError("co-change limits are too small")

    @property
    def is_public(self) -> bool:
        return self.mode in ("public", "demo")


def resolve_repository_root(
    explicit: str | Path | None = None, *, anchor: Path | None = None, environment: Mapping[str, str] | None = None, sibling: str = "target"
) -> Path:
    """The explicit folder, else the one in CODE_GRAPH_TARGET, else a sibling of the folder of ``anchor``.

    ``anchor`` is a file in the project that asks; by default one in the working folder. The
    first of the three that is given decides: a folder that does not exist is an error and
    not passed over.
    """
    configured = (os.environ if environment is None else environment).get(TARGET_VARIABLE)
    beside = (anchor or Path.cwd() / "anchor").resolve().parent.parent / sibling
    chosen, source = (explicit, "argument") if explicit is not None else (configured, TARGET_VARIABLE) if configured else (beside, "sibling folder")
    root = Path(chosen).expanduser().resolve()
    if not root.is_dir():
        raise FileNotFoundError(f"no such repository folder ({source}): {root}")
    return root
