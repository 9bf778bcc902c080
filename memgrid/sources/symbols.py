"""Symbols of source code: Python by its own parser, other languages by patterns."""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

SCHEMA = "path string, kind string, name string, line int, scope string"
#: Kind and pattern of definitions by language. Fixed values.
PATTERNS = {
    "javascript": (("function", r"function\s+(\w+)\s*\("), ("class", r"class\s+(\w+)"), ("import", r"import\s.*?from\s+['\"]([^'\"]+)")),
    "typescript": (("function", r"function\s+(\w+)\s*\("), ("class", r"class\s+(\w+)"), ("interface", r"interface\s+(\w+)"), ("import", r"import\s.*?from\s+['\"]([^'\"]+)")),
    "java": (("class", r"class\s+(\w+)"), ("import", r"import\s+([\w.]+);")),
    "go": (("function", r"func\s+(?:\([^)]*\)\s*)?(\w+)\s*\("), ("type", r"type\s+(\w+)\s+(?:struct|interface)")),
    "rust": (("function", r"fn\s+(\w+)"), ("struct", r"struct\s+(\w+)"), ("use", r"use\s+([\w:]+)")),
    "c": (("function", r"^[\w*]+\s+(\w+)\s*\([^;]*\)\s*\{"), ("include", r"#include\s*[<\"]([^>\"]+)")),
}


def python_symbols(text: str) -> list[tuple]:
    out = []

    def visit(node: ast.AST, scope: str) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                out.append(("class" if isinstance(child, ast.ClassDef) else "function", child.name, child.lineno, scope))
                visit(child, f"{scope}.{child.name}" if scope else child.name)
            elif isinstance(child, ast.Import):
                out.extend(("import", a.name, child.lineno, scope) for a in child.names)
            elif isinstance(child, ast.ImportFrom):
                out.append(("import", "." * child.level + (child.module or ""), child.lineno, scope))
            elif isinstance(child, ast.Assign) and not scope:
                out.extend(("constant", x.id, child.lineno, scope) for x in child.targets if isinstance(x, ast.Name) and x.id.isupper())
            else:
                visit(child, scope)

    visit(ast.parse(text), "")
    return out


def symbols_of(text: str, language: str) -> list[tuple]:
    if language == "python":
        try:
            return python_symbols(text)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return []
    return [(kind, m[1], text.count("\n", 0, m.start()) + 1, "") for kind, pattern in PATTERNS.get(language, ()) for m in re.finditer(pattern, text, re.M)]


def symbols(rows: DataFrame) -> DataFrame:
    """One row for each symbol of files (path, text, language)."""

    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(path, *x) for path, text, language in zip(b["path"], b["text"], b["language"], strict=True) for x in symbols_of(text or "", language or "")]
            yield pd.DataFrame(out, columns=["path", "kind", "name", "line", "scope"])

    return rows.select("path", "text", "language").mapInPandas(f, SCHEMA)


def python_metrics(text: str) -> tuple[int, int, int, int]:
    """Lines, syntax nodes, depth of nesting, and one plus the branches."""
    branches = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.Try, ast.With, ast.AsyncWith, ast.BoolOp, ast.IfExp, ast.ExceptHandler, ast.comprehension)

    def walk(node: ast.AST, depth: int) -> tuple[int, int, int]:
        nodes, deep, found = 1, depth, int(isinstance(node, branches))
        for child in ast.iter_child_nodes(node):
            n, d, f = walk(child, depth + 1)
            nodes, deep, found = nodes + n, max(deep, d), found + f
        return nodes, deep, found

    try:
        nodes, deep, found = walk(ast.parse(text), 0)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        nodes, deep, found = 0, 0, 0
    return text.count("\n") + 1, nodes, deep, found + 1


def metrics(rows: DataFrame) -> DataFrame:
    """(path, lines, nodes, depth, complexity) of Python files (path, text)."""

    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(path, *python_metrics(text or "")) for path, text in zip(b["path"], b["text"], strict=True)], columns=["path", "lines", "nodes", "depth", "complexity"])

    return rows.select("path", "text").mapInPandas(f, "path string, lines long, nodes long, depth long, complexity long")


def python_structure(text: str) -> list[tuple[str, str, int, int]]:
    """(kind, name, first line, last line) of the functions and classes at the top of a Python file."""
    try:
        body = ast.parse(text).body
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    kinds = {ast.FunctionDef: "function", ast.AsyncFunctionDef: "function", ast.ClassDef: "class"}
    return [(kinds[type(x)], x.name, x.lineno, x.end_lineno) for x in body if type(x) in kinds]


def structure(rows: DataFrame) -> DataFrame:
    """One row for each top-level definition of Python files (path, text), with its span of lines."""

    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(path, *x) for path, text in zip(b["path"], b["text"], strict=True) for x in python_structure(text or "")]
            yield pd.DataFrame(out, columns=["path", "kind", "name", "first", "last"])

    return rows.select("path", "text").mapInPandas(f, "path string, kind string, name string, first long, last long")


def python_details(text: str) -> list[tuple]:
    """(kind, name, parameters, decorators, bases, docstring) of all functions and classes of a Python file."""
    try:
        nodes = [x for x in ast.walk(ast.parse(text)) if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))]
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    out = []
    for x in nodes:
        of_class = isinstance(x, ast.ClassDef)
        names = [] if of_class else [a.arg for a in (*x.args.posonlyargs, *x.args.args, *([x.args.vararg] if x.args.vararg else []), *x.args.kwonlyargs, *([x.args.kwarg] if x.args.kwarg else []))]
        out.append(("class" if of_class else "function", x.name, names, [ast.unparse(d) for d in x.decorator_list], [ast.unparse(b) for b in x.bases] if of_class else [], ast.get_docstring(x)))
    return out


def details(rows: DataFrame) -> DataFrame:
    """One row for each function and class of Python files (path, text): parameters, decorators, bases and docstring."""

    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(path, *x) for path, text in zip(b["path"], b["text"], strict=True) for x in python_details(text or "")]
            yield pd.DataFrame(out, columns=["path", "kind", "name", "parameters", "decorators", "bases", "docstring"])

    kind = "path string, kind string, name string, parameters array<string>, decorators array<string>, bases array<string>, docstring string"
    return rows.select("path", "text").mapInPandas(f, kind)


def config_counts(text: str) -> tuple[int, int] | None:
    """Keys of a JSON text and how deep its containers are nested; None if it is no JSON."""
    try:
        stack = [(json.loads(text), 0)]
    except (ValueError, RecursionError, MemoryError):
        return None
    keys = deepest = 0
    while stack:
        at, depth = stack.pop()
        if isinstance(at, (dict, list)):
            deepest = max(deepest, depth + 1)
            keys += len(at) if isinstance(at, dict) else 0
            stack.extend((x, depth + 1) for x in (at.values() if isinstance(at, dict) else at))
    return keys, deepest


def config_metrics(rows: DataFrame) -> DataFrame:
    """(path, keys, depth, valid) of JSON files (path, text)."""

    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [config_counts(x or "") for x in b["text"]]
            yield pd.DataFrame({"path": b["path"], "keys": [x[0] if x else 0 for x in found], "depth": [x[1] if x else 0 for x in found], "valid": [x is not None for x in found]})

    return rows.select("path", "text").mapInPandas(f, "path string, keys long, depth long, valid boolean")
