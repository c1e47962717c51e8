"""Python source by its own syntax tree."""

from __future__ import annotations

import ast
import re

_CONSTANT = re.compile(r"^[A-Z][A-Z0-9_]*$")


def visibility(name: str) -> str:
    if name.startswith("__") and name.endswith("__"):
        return "public"
    return "private" if name.startswith("__") else "internal" if name.startswith("_") else "public"


def _dotted(node: ast.AST) -> str | None:
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        base = _dotted(node.value)
        return f"{base}.{node.attr}" if base else node.attr
    return _dotted(node.func) if isinstance(node, ast.Call) else None


def extract(source: str, max_depth: int = 500) -> dict:
    """Classes, functions, constants and class attributes with their scope; names used; imports.

    Columns count UTF-8 bytes from 1. A file that doesn't parse gives one diagnostic and no facts.
    Names of nested functions keep the scope of the outer class.
    """
    symbols: list[dict] = []
    refs: list[dict] = []
    opens: list[str] = []
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError) as e:
        return {"symbols": [], "refs": [], "opens": [], "diagnostics": [{"severity": "error", "message": str(e), "line": getattr(e, "lineno", None)}]}
    lines = source.split("\n")

    def add(name: str, kind: str, node: ast.AST, scope: list[str], **more) -> None:
        line, column = node.lineno, node.col_offset + 1
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            text = lines[line - 1].encode()
            at = text.find(name.encode(), node.col_offset + 3)
            column = at + 1 if at >= 0 else column
        symbols.append({
            "name": name, "qualified": ".".join([*scope, name]), "kind": kind, "line": line, "column": column,
            "end_line": line, "end_column": column + len(name.encode()), "visibility": visibility(name), "parent": None,
            "mixins": None, "attributes": None, "implements": None, "doc": None, "signature": None,
        } | more)

    def used(name: str | None, node: ast.AST) -> None:
        if name:
            refs.append({"name": name, "line": node.lineno, "column": node.col_offset + 1})

    def uses(node: ast.AST | None) -> None:
        for n in ast.walk(node) if node is not None else ():
            if isinstance(n, ast.Attribute):
                used(_dotted(n), n)
            elif isinstance(n, ast.Name) and isinstance(n.ctx, ast.Load):
                used(n.id, n)

    work: list[tuple[list[ast.stmt], list[str], bool, int]] = [(tree.body, [], False, 0)]
    while work:
        body, scope, in_class, depth = work.pop(0)
        if depth > max_depth:
            continue
        for node in body:
            if isinstance(node, ast.ClassDef):
                bases = [b for b in map(_dotted, node.bases) if b]
                add(node.name, "class", node, scope, parent=bases[0] if bases else None, mixins=bases[1:] or None, attributes=[d for d in map(_dotted, node.decorator_list) if d] or None, doc=ast.get_docstring(node), signature=f"class {node.name}" + (f"({', '.join(bases)})" if bases else ""))
                for x in [*node.bases, *node.decorator_list, *(k.value for k in node.keywords)]:
                    uses(x)
                work.append((node.body, [*scope, node.name], True, depth + 1))
            elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                returns = f" -> {ast.unparse(node.returns)}" if node.returns else ""
                add(node.name, "function", node, scope, attributes=[d for d in map(_dotted, node.decorator_list) if d] or None, doc=ast.get_docstring(node), signature=f"def {node.name}({ast.unparse(node.args)}){returns}")
                for x in [*node.decorator_list, node.args, node.returns]:
                    uses(x)
                work.append((node.body, scope, False, depth + 1))
            elif isinstance(node, ast.Import):
                opens += [a.name for a in node.names]
            elif isinstance(node, ast.ImportFrom):
                opens.append("." * node.level + (node.module or ""))
            elif isinstance(node, (ast.Assign, ast.AnnAssign)):
                for target in node.targets if isinstance(node, ast.Assign) else [node.target]:
                    if isinstance(target, ast.Name):
                        if in_class:
                            add(target.id, "member", target, scope)
                        elif not scope and depth == 0 and _CONSTANT.match(target.id):
                            add(target.id, "value", target, scope)
                uses(node)
            else:
                inner = [s for f in ("body", "orelse", "finalbody") for s in getattr(node, f, [])]
                inner += [s for h in getattr(node, "handlers", []) for s in h.body] + [s for c in getattr(node, "cases", []) for s in c.body]
                if not inner:
                    uses(node)
                    continue
                for f in ("test", "iter", "subject"):
                    uses(getattr(node, f, None))
                for item in getattr(node, "items", []):
                    uses(item.context_expr)
                work.append((inner, scope, in_class, depth + 1))
    order = sorted(range(len(symbols)), key=lambda i: (symbols[i]["line"], i))
    refs.sort(key=lambda r: (r["line"], r["column"]))
    return {"symbols": [symbols[i] for i in order], "refs": refs, "opens": opens, "diagnostics": []}
