"""Source files to symbols, imports and calls.  Parsing needs Python; files are parsed in Arrow batches where they lie."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.shared import lean, parts, sliced

SYMBOLS = "path string, name string, symbol_type string, signature string, docstring string, content string, start_line int, end_line int, language string, is_async boolean, decorators array<string>"
JS = re.compile(r"(?:^|\n)[ \t]*(?:export\s+)?(?:default\s+)?(?:(async\s+)?function\s*\*?\s*(\w+)\s*(\([^)]*\))|class\s+(\w+)(?:\s+extends\s+[\w.]+)?\s*(?=\{))")


def python_symbols(path: str, text: str) -> Iterator[tuple]:
    """Top-level functions and classes, and the classes' methods (named Class.method)."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return
    lines = text.split("\n")
    functions = (ast.FunctionDef, ast.AsyncFunctionDef)

    def row(node, name: str, kind: str) -> tuple:
        is_async = isinstance(node, ast.AsyncFunctionDef)
        if kind == "class":
            bases = ", ".join(map(ast.unparse, node.bases))
            head = f"class {node.name}({bases})" if bases else f"class {node.name}"
        else:
            head = f"{'async ' * is_async}def {node.name}({ast.unparse(node.args)})" + (f" -> {ast.unparse(node.returns)}" if node.returns else "")
        start = min([node.lineno, *(d.lineno for d in node.decorator_list)])
        return path, name, kind, head, ast.get_docstring(node), "\n".join(lines[start - 1 : node.end_lineno]), start, node.end_lineno, "python", is_async, [ast.unparse(d) for d in node.decorator_list]

    for node in tree.body:
        if isinstance(node, functions):
            yield row(node, node.name, "function")
        elif isinstance(node, ast.ClassDef):
            yield row(node, node.name, "class")
            yield from (row(n, f"{node.name}.{n.name}", "method") for n in node.body if isinstance(n, functions))


def closing(text: str, at: int) -> int:
    """End of the block that opens at the first brace from `at`; strings and comments are skipped."""
    depth, k, n = 0, at, len(text)
    while k < n:
        c = text[k]
        if c in "\"'`":
            k += 1
            while k < n and text[k] != c:
                k += 1 + (text[k] == "\\")
        elif text.startswith("//", k):
            k = text.find("\n", k) if "\n" in text[k:] else n
        elif text.startswith("/*", k):
            k = text.find("*/", k) + 1 if "*/" in text[k:] else n
        elif c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if depth == 0:
                return k + 1
        k += 1
    return n


def script_symbols(path: str, text: str, language: str) -> Iterator[tuple]:
    for m in JS.finditer(text):
        start = m.start() + (text[m.start()] == "\n")
        end = closing(text, m.end())
        name, kind = (m[2], "function") if m[2] else (m[4], "class")
        body = text[start:end]
        first = text.count("\n", 0, start) + 1
        yield path, name, kind, m[0].strip(), None, body, first, first + body.count("\n"), language, bool(m[1]), []


def imports_of(text: str) -> Iterator[tuple]:
    """(module, names, alias) of top-level imports."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return
    for node in tree.body:
        if isinstance(node, ast.Import):
            yield from ((a.name, [], a.asname) for a in node.names)
        elif isinstance(node, ast.ImportFrom):
            yield "." * node.level + (node.module or ""), [a.name for a in node.names], None


def calls_of(text: str) -> list[str]:
    """Distinct names that are called, in order."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return []
    found = (n.func for n in ast.walk(tree) if isinstance(n, ast.Call))
    return [*dict.fromkeys(f.id if isinstance(f, ast.Name) else f.attr for f in found if isinstance(f, (ast.Name, ast.Attribute)))]


def _rows(files: DataFrame, each, schema: str) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for batch in batches for part in sliced(batch, "content")):
            out = [r for p, t, k in zip(*(b.column(c).to_pylist() for c in ("path", "content", "kind"))) for r in each(p, t or "", k)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [()] * len(arrow), arrow)], names=arrow.names)

    own = files.select("path", F.col("content").cast("string").alias("content"), "kind")
    # parsing takes long for its bytes: a table of few files would otherwise be read by few tasks
    return own.repartition(parts(own, 1)).mapInArrow(lean(run), schema)


def symbols(files: DataFrame) -> DataFrame:
    """Symbols of files (path, content, kind); files that don't parse have none."""
    return _rows(files, lambda p, t, k: python_symbols(p, t) if k == "python" else script_symbols(p, t, k) if k == "javascript" else (), SYMBOLS)


def imports(files: DataFrame) -> DataFrame:
    return _rows(files, lambda p, t, k: ((p, *i) for i in imports_of(t)) if k == "python" else (), "path string, module string, names array<string>, alias string")


def calls(files: DataFrame) -> DataFrame:
    return _rows(files, lambda p, t, k: ((p, c) for c in calls_of(t)) if k == "python" else (), "path string, callee string")


def chunks(symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """A chunk per symbol: the file's imports, then its text."""
    line = F.when(F.size("names") > 0, F.concat(F.lit("from "), "module", F.lit(" import "), F.array_join("names", ", "))).otherwise(F.concat(F.lit("import "), "module", F.coalesce(F.concat(F.lit(" as "), "alias"), F.lit(""))))
    head = imports.groupBy("path").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("head"))
    return symbols.join(head, "path", "left").withColumn("text", F.concat_ws("\n\n", "head", "content")).drop("head")
