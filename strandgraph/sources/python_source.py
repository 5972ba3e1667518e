"""Source text to rows: nodes, pending relations and import bindings of each file."""

from __future__ import annotations

import ast
import io
import tokenize
from collections.abc import Iterator
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Indexed suffixes with their language, folders left out.
LANGUAGES = {
    ".css": "css", ".html": "html", ".js": "javascript", ".json": "json", ".jsx": "javascript", ".mjs": "javascript", ".py": "python",
    ".sql": "sql", ".toml": "toml", ".ts": "typescript", ".tsx": "typescript", ".yaml": "yaml", ".yml": "yaml",
}
EXCLUDED = [".git", ".idg", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".venv", "__pycache__", "build", "dist", "node_modules"]

NODE = "id string, kind string, name string, qualified_name string, path string, module string, language string, start_line int, end_line int, signature string, docstring string, source string"
PENDING = "source_id string, kind string, target_text string, count long, confidence double, evidence array<string>, resolved boolean"
BINDING = "path string, bound string, module string, symbol string"
ISSUE = "path string, message string"
#: One row of a parsed file: exactly one of the structs is not null.
ROWS = f"ord int, node struct<{NODE}>, relation struct<{PENDING}>, binding struct<{BINDING}>, issue struct<{ISSUE}>"
_ARROW = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}


def _arrow_struct(fields: str) -> pa.DataType:
    return pa.struct([(name, _ARROW[kind]) for name, kind in (f.split() for f in fields.split(", "))])


ARROW_ROWS = pa.schema([("ord", pa.int32()), ("node", _arrow_struct(NODE)), ("relation", _arrow_struct(PENDING)), ("binding", _arrow_struct(BINDING)), ("issue", _arrow_struct(ISSUE))])


def indexed(path: F.Column) -> F.Column:
    """Whether a relative path has an indexed suffix and no excluded folder."""
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    return suffix.isin(list(LANGUAGES)) & ~F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(x) for x in EXCLUDED]))


def module_name(path: str) -> str:
    parts = list(PurePosixPath(path).with_suffix("").parts)
    if parts[:1] == ["src"]:
        parts = parts[1:]
    if parts[-1:] == ["__init__"]:
        parts = parts[:-1]
    return ".".join(parts) or PurePosixPath(path).stem


def name_of(expression: ast.AST) -> str | None:
    """Dotted text of a name or attribute chain; of an attribute of anything else the attribute."""
    tail: list[str] = []
    while isinstance(expression, ast.Attribute):
        tail.append(expression.attr)
        expression = expression.value
    if isinstance(expression, ast.Name):
        return ".".join([expression.id, *reversed(tail)])
    return tail[0] if tail else None


def absolute_module(module: str, path: str, imported: str | None, level: int) -> str:
    if not level:
        return imported or ""
    package = module.split(".") if PurePosixPath(path).stem == "__init__" else module.split(".")[:-1]
    if level - 1 > len(package):
        return imported or ""
    kept = package[: len(package) - (level - 1)]
    return ".".join([*kept, *([imported] if imported else [])])


class _Walker(ast.NodeVisitor):
    """Walks one module and emits (row kind, payload) pairs in source order."""

    def __init__(self, path: str, text: str) -> None:
        self.path, self.lines, self.module = path, text.splitlines(), module_name(path)
        self.file_id = f"file:{path}"
        self.scopes: list[tuple[str, str, str]] = []  # id, name, kind
        self.rows: list[tuple[str, dict]] = []

    def owner(self) -> str:
        return self.scopes[-1][0] if self.scopes else self.file_id

    def relate(self, kind: str, target: str, line: int, *, source: str | None = None, resolved: bool = False) -> None:
        """A relation whose evidence is the place in the source that states it."""
        self.rows.append(("relation", {"source_id": source or self.owner(), "kind": kind, "target_text": target, "count": 1, "confidence": 1.0, "evidence": [f"{self.path}:{line}"], "resolved": resolved}))

    def enter(self, node: ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef, kind: str, signature: str) -> None:
        qualified = ".".join([s[1] for s in self.scopes] + [node.name])
        own, end = f"symbol:{self.path}::{qualified}", node.end_lineno or node.lineno
        self.rows.append(("node", {
            "id": own, "kind": kind, "name": node.name, "qualified_name": qualified, "path": self.path, "module": self.module, "language": "python", "start_line": node.lineno, "end_line": end,
            "signature": signature, "docstring": ast.get_docstring(node) or "", "source": "\n".join(self.lines[node.lineno - 1 : end]),
        }))
        self.relate("CONTAINS", own, node.lineno, resolved=True)
        self.scopes.append((own, node.name, kind))

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        inner = ", ".join(map(ast.unparse, node.bases))
        self.enter(node, "class", f"class {node.name}" + (f"({inner})" if inner else ""))
        for base in node.bases:
            if text := name_of(base):
                self.relate("INHERITS", text, node.lineno)
        self.generic_visit(node)
        self.scopes.pop()

    def visit_FunctionDef(self, node: ast.FunctionDef | ast.AsyncFunctionDef) -> None:
        decorators = [name_of(d) or "" for d in node.decorator_list]
        if self.path.startswith("tests/") and node.name.startswith("test_"):
            kind = "test"
        elif any(d.endswith("fixture") for d in decorators):
            kind = "fixture"
        else:
            kind = "method" if self.scopes and self.scopes[-1][2] == "class" else "function"
        start = "async " if isinstance(node, ast.AsyncFunctionDef) else ""
        result = f" -> {ast.unparse(node.returns)}" if node.returns else ""
        self.enter(node, kind, f"{start}{node.name}({ast.unparse(node.args)}){result}")
        self.generic_visit(node)
        self.scopes.pop()

    visit_AsyncFunctionDef = visit_FunctionDef

    def bind(self, bound: str, module: str, symbol: str) -> None:
        self.rows.append(("binding", {"path": self.path, "bound": bound, "module": module, "symbol": symbol}))

    def visit_Import(self, node: ast.Import) -> None:
        for alias in node.names:
            self.relate("IMPORTS", f"@module:{alias.name}", node.lineno, source=self.file_id)
            top = alias.name.split(".")[0]
            self.bind(alias.asname or top, alias.name if alias.asname else top, "")

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        module = absolute_module(self.module, self.path, node.module, node.level)
        if module:
            self.relate("IMPORTS", f"@module:{module}", node.lineno, source=self.file_id)
        for alias in node.names:
            if alias.name != "*":
                self.bind(alias.asname or alias.name, module, alias.name)

    def visit_Call(self, node: ast.Call) -> None:
        if text := name_of(node.func):
            self.relate("CALLS", text, node.lineno)
        self.generic_visit(node)


def decoded(content: bytes) -> str:
    """Text by its byte order mark or coding line, else UTF-8, with line ends as \\n."""
    encoding = tokenize.detect_encoding(io.BytesIO(content).readline)[0]
    return io.TextIOWrapper(io.BytesIO(content), encoding).read()


def file_rows(path: str, content: bytes | None, problem: str | None = None) -> list[tuple[str, dict]]:
    """Rows of one file: a file node and, for Python, its symbols; or one issue if it cannot be read or parsed."""
    suffix = PurePosixPath(path).suffix.lower()
    rows, docstring = [], ""
    try:
        if content is None:
            raise OSError(problem or "no content")
        text = decoded(content)
        if suffix == ".py":
            tree = ast.parse(text, filename=path, type_comments=True)
            docstring = ast.get_docstring(tree) or ""
            walker = _Walker(path, text)
            walker.visit(tree)
            rows = walker.rows
    except (OSError, SyntaxError, ValueError) as error:  # Unicode errors are value errors
        return [("issue", {"path": path, "message": str(error)})]
    module = module_name(path)
    return [("node", {
        "id": f"file:{path}", "kind": "file", "name": PurePosixPath(path).name, "qualified_name": module, "path": path, "module": module, "language": LANGUAGES.get(suffix, "text"),
        "start_line": 1, "end_line": max(1, len(text.splitlines())), "signature": "", "docstring": docstring, "source": text,
    }), *rows]


def extract(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """``(nodes, relations, bindings, issues)`` of ``files(path, content binary)``.

    A file without content is an issue; its column ``problem``, if there is one, says why.
    Each file is parsed where it lies; a symbol defined twice keeps its last definition. The
    parse is stored once because four tables are read from it.
    """
    from strandgraph.plans.lineage import stored

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.to_pylist():
                parsed = file_rows(file["path"], file["content"], file["problem"])
                rows = [{"ord": k, kind: payload} for k, (kind, payload) in enumerate(parsed)]
                yield pa.RecordBatch.from_pylist(rows, schema=ARROW_ROWS)

    problem = F.col("problem") if "problem" in files.columns else F.lit(None).cast("string").alias("problem")
    rows = stored(files.select("path", "content", problem).mapInArrow(run, ROWS), "parsed")

    def part(kind: str) -> DataFrame:
        return rows.filter(F.col(kind).isNotNull()).select(f"{kind}.*", F.col("ord").alias("at"))

    nodes = part("node")
    fields = [c for c in nodes.columns if c not in ("id", "at")]
    nodes = nodes.groupBy("id").agg(F.max_by(F.struct(*fields, "at"), "at").alias("n")).select("id", "n.*")
    return nodes, part("relation"), part("binding").withColumnRenamed("at", "ord"), part("issue").drop("at")
