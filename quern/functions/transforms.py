"""Variants of code that keep its meaning, and the comments that lead definitions (TXT-30, 32, VER-10)."""

from __future__ import annotations

import ast
import builtins
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_JS_WORD = re.compile(r"[A-Za-z_$][\w$]*")
_JS_STATEMENTS = frozenset("if for while switch with function return typeof await new delete void in of case do else".split())
_JS_PIECE = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`|//[^\n]*|/\*.*?\*/|\.?[A-Za-z_$][\w$]*|.", re.S)


class _Locals(ast.NodeVisitor):
    """Names that are bound inside functions: parameters and assigned names, without globals and builtins."""

    def __init__(self) -> None:
        self.bound: dict[str, None] = {}
        self.kept: set[str] = set(dir(builtins))
        self.depth = 0

    def visit_FunctionDef(self, node: ast.FunctionDef) -> None:
        self.kept.add(node.name)
        self.depth += 1
        for a in [*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs, node.args.vararg, node.args.kwarg]:
            if a is not None and a.arg not in ("self", "cls"):
                self.bound.setdefault(a.arg)
        self.generic_visit(node)
        self.depth -= 1

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_Name(self, node: ast.Name) -> None:
        if self.depth and isinstance(node.ctx, ast.Store):
            self.bound.setdefault(node.id)

    def visit_Global(self, node: ast.Global) -> None:
        self.kept.update(node.names)

    visit_Nonlocal = visit_Global


class _Rename(ast.NodeTransformer):
    def __init__(self, names: dict[str, str]):
        self.names = names

    def visit_Name(self, node: ast.Name) -> ast.Name:
        node.id = self.names.get(node.id, node.id)
        return node

    def visit_arg(self, node: ast.arg) -> ast.arg:
        node.arg = self.names.get(node.arg, node.arg)
        return node


def rename_python(source: str, style: str = "short") -> str:
    """The source with its local names exchanged (v0, v1, ... or value_0, ...); as it is where it does not parse."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return source
    found = _Locals()
    found.visit(tree)
    stem = "v" if style == "short" else "value_"
    names = {n: f"{stem}{k}" for k, n in enumerate(n for n in found.bound if n not in found.kept)}
    return ast.unparse(_Rename(names).visit(tree))


class _Script:
    """The pieces of a JavaScript source, which of them say something, and the bracket each of these stands in."""

    def __init__(self, source: str):
        self.pieces: list[str] = _JS_PIECE.findall(source)
        self.at = [k for k, p in enumerate(self.pieces) if not p.isspace() and not p.startswith(("//", "/*"))]
        self.inside: list[str] = []  # "{" of a block, "o" of an object or pattern, "(" or "["
        held = [""]
        for n in range(len(self.at)):
            sign = self.sign(n)
            if sign in ("}", ")", "]") and len(held) > 1:
                held.pop()
            self.inside.append(held[-1])
            if sign == "{":
                held.append("o" if self.sign(n - 1) in ("=", "(", ",", ":", "[", "?", "const", "let", "var", "return") else "{")
            elif sign in ("(", "["):
                held.append(sign)
        self.bound: dict[str, None] = {}
        for n in range(len(self.at)):
            self._bind(n)

    def sign(self, n: int) -> str:
        return self.pieces[self.at[n]] if 0 <= n < len(self.at) else ""

    def closing(self, n: int) -> int:
        """Where the bracket at n closes."""
        depth = 0
        for k in range(n, len(self.at)):
            depth += (self.sign(k) in ("(", "[", "{")) - (self.sign(k) in (")", "]", "}"))
            if depth == 0:
                return k
        return len(self.at)

    def _bind(self, n: int) -> None:
        sign, then = self.sign(n), self.sign(n + 1)
        if sign in ("const", "let", "var"):
            k = n + 1
            while True:
                k = self._value(self._pattern(k), len(self.at))
                if self.sign(k) != ",":
                    break
                k += 1
        elif sign == "(":
            end = self.closing(n)
            before, name = self.sign(n - 1), self.sign(n - 2)
            arrow = self.sign(end + 1) == "=" and self.sign(end + 2) == ">"
            body = self.sign(end + 1) == "{" and _JS_WORD.fullmatch(before) and before not in _JS_STATEMENTS
            if arrow or body or before == "function" or name == "function" or before == "*":
                self._list(n + 1, end)
        elif _JS_WORD.fullmatch(sign) and then == "=" and self.sign(n + 2) == ">" and self.at[n + 1] + 1 == self.at[n + 2]:
            self.bound.setdefault(sign)

    def _list(self, k: int, end: int) -> None:
        while k < end:
            k = self._value(self._pattern(k), end) + 1

    def _value(self, k: int, end: int) -> int:
        """Behind a default or initial value, at the comma or whatever ends it."""
        if self.sign(k) != "=":
            return k
        k += 1
        depth = 0
        while k < end:
            sign = self.sign(k)
            if depth == 0 and (sign in (",", ";", "of", "in") or "\n" in "".join(self.pieces[self.at[k - 1] + 1 : self.at[k]]) and self.sign(k - 1) not in ("=", ">", "(", "+", "?", ":", "|", "&")):
                return k
            depth += (sign in ("(", "[", "{")) - (sign in (")", "]", "}"))
            if depth < 0:
                return k
            k += 1
        return k

    def _pattern(self, k: int) -> int:
        """Bind the names of a pattern that begins at k; the place behind it."""
        sign = self.sign(k)
        if sign == "." and self.sign(k + 1) == "." and self.sign(k + 2).startswith("."):
            self.bound.setdefault(self.sign(k + 2)[1:])
            return k + 3
        if sign in ("{", "["):
            end = self.closing(k)
            n = k + 1
            while n < end:
                if sign == "{" and self.sign(n + 1) == ":":
                    n += 2
                n = self._value(self._pattern(n), end)
                n += self.sign(n) == "," or n < end and self.sign(n) not in ("{", "[") and not _JS_WORD.fullmatch(self.sign(n)) and self.sign(n) != "."
            return end + 1
        if _JS_WORD.fullmatch(sign) and sign not in _JS_STATEMENTS:
            self.bound.setdefault(sign)
        return k + 1

    def renamed(self, names: dict[str, str]) -> str:
        out = list(self.pieces)
        for n, k in enumerate(self.at):
            piece, before, then = self.pieces[k], self.sign(n - 1), self.sign(n + 1)
            if piece[1:] in names and piece[0] == "." and before == "." and self.sign(n - 2) == ".":
                out[k] = "." + names[piece[1:]]
            elif piece in names:
                key = self.inside[n] == "o" and before in ("{", ",")
                if key and then in (":", "("):
                    continue
                out[k] = f"{piece}: {names[piece]}" if key and then in (",", "}", "=") else names[piece]
        return "".join(out)


def rename_javascript(source: str, style: str = "short") -> str:
    """The source with the names it binds exchanged (declared, also by patterns, parameters, caught errors), outside of literals, comments, members and keys."""
    stem = "v" if style == "short" else "value"
    script = _Script(source)
    return script.renamed({n: f"{stem}{k}" for k, n in enumerate(script.bound)})


def reorder_python(source: str) -> str:
    """The source with its first two neighbouring assignments exchanged that do not touch each other's names."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return source

    def names(node: ast.AST, kind: type) -> set[str]:
        return {n.id for n in ast.walk(node) if isinstance(n, ast.Name) and isinstance(n.ctx, kind)}

    def plain(node: ast.AST) -> bool:
        return isinstance(node, ast.Assign) and not any(isinstance(n, ast.Call | ast.Await | ast.Yield | ast.Attribute | ast.Subscript) for n in ast.walk(node))

    for node in ast.walk(tree):
        body = getattr(node, "body", None)
        if isinstance(body, list):
            for k in range(len(body) - 1):
                a, b = body[k : k + 2]
                if plain(a) and plain(b) and not names(a, ast.Store) & (names(b, ast.Load) | names(b, ast.Store)) and not names(b, ast.Store) & names(a, ast.Load):
                    body[k], body[k + 1] = b, a
                    return ast.unparse(tree)
    return source


@F.pandas_udf(StringType())
def _renamed(source: pd.Series, language: pd.Series, style: pd.Series) -> pd.Series:
    return pd.Series([
        None if s is None else rename_python(s, y) if g == "python" else rename_javascript(s, y) if g in ("javascript", "typescript") else s
        for s, g, y in zip(source, language, style, strict=True)
    ])


@F.pandas_udf(StringType())
def _reordered(source: pd.Series) -> pd.Series:
    return pd.Series([None if s is None else reorder_python(s) for s in source])


def renamed(source: Column, language: Column, style: str = "short") -> Column:
    return _renamed(source, language, F.lit(style))


def reordered(source: Column) -> Column:
    return _reordered(source)


def leading_comment(source: Column) -> Column:
    """The comment a definition begins with (block or run of line comments), in one line without its marks; null if there is none."""
    block = F.regexp_extract(source, r"(?s)^\s*/\*+(.*?)\*/", 1)
    run = F.regexp_extract(source, r"^((?:\s*+(?://|#)[^\n]*+\n?+)*+)", 1)  # possessive: matched in a loop, however long the run is
    text = F.when(block != "", block).otherwise(run)
    clean = F.trim(F.regexp_replace(F.regexp_replace(text, r"(?dm)^\s*(?://+|#+|\*+)\s?", ""), r"\s+", " "))
    return F.nullif(clean, F.lit(""))


def later_version(snippets: DataFrame, version: str, style: str = "short") -> DataFrame:
    """A synthetic next version of snippets (id, content, lang): names exchanged."""
    return snippets.select("id", F.lit(version).alias("version"), renamed(F.col("content"), F.col("lang"), style).alias("content"))
