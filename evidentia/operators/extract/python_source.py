"""Symbols, dataflow edges and routes of Python source, from its syntax tree."""

from __future__ import annotations

import ast
from collections.abc import Iterator

Symbol = tuple[str, str, int, int]  # kind, name, first line, last line
Edge = tuple[str, str, str, int]  # from, to, kind, line
Route = tuple[str, str, str, str, int]  # method, path, handler, framework, line

# Verbs of route decorators.
VERBS = ["get", "post", "put", "delete", "patch", "options", "head", "trace"]


def symbol_name(file: str, function: str | None, name: str) -> str:
    return f"{file}:{function or ''}:{name}"


def dotted(node: ast.expr) -> str:
    return ast.unparse(node)


def _read(node: ast.expr) -> Iterator[tuple[str, str]]:
    """(identifier, edge kind) for what an assigned value reads.

    Attributes give each of their parts; a subscript gives its base once."""
    if isinstance(node, ast.Name):
        yield node.id, "assign"
    elif isinstance(node, ast.Subscript):
        yield dotted(node.value), "subscript"
    elif isinstance(node, ast.Attribute):
        yield from _read(node.value)
        yield node.attr, "assign"
    elif not isinstance(node, (ast.Lambda, ast.JoinedStr)):
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.expr):
                yield from _read(child)
            elif isinstance(child, ast.keyword):
                yield from _read(child.value)


class _Walker(ast.NodeVisitor):
    def __init__(self, file: str) -> None:
        self.file, self.functions, self.in_class = file, [], []
        self.symbols: list[Symbol] = []
        self.edges: list[Edge] = []
        self.routes: list[Route] = []

    def _name(self, name: str) -> str:
        return symbol_name(self.file, self.functions[-1] if self.functions else None, name)

    def _edge(self, source: str, target: str, kind: str, line: int) -> None:
        if source != target:
            self.edges.append((self._name(source), self._name(target), kind, line))

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        self.symbols.append(("class", node.name, node.lineno, node.end_lineno or node.lineno))
        self.in_class.append(True)
        self.generic_visit(node)
        self.in_class.pop()

    def visit_FunctionDef(self, node: ast.FunctionDef | ast.AsyncFunctionDef) -> None:
        self.symbols.append(("method" if any(self.in_class) else "function", node.name, node.lineno, node.end_lineno or node.lineno))
        self._decorators(node)
        self.functions.append(node.name)
        self.generic_visit(node)
        self.functions.pop()

    visit_AsyncFunctionDef = visit_FunctionDef

    def _assigned(self, targets: list[ast.expr], value: ast.expr | None, line: int) -> None:
        if value is None:
            return
        for target in targets:
            for name in [target] if not isinstance(target, (ast.Tuple, ast.List)) else target.elts:
                if isinstance(name, (ast.Name, ast.Attribute, ast.Subscript)):
                    to = dotted(name.value if isinstance(name, ast.Subscript) else name)
                    for source, kind in dict.fromkeys(_read(value)):
                        self._edge(source, to, kind, line)

    def visit_Assign(self, node: ast.Assign) -> None:
        self._assigned(node.targets, node.value, node.lineno)
        self.generic_visit(node)

    def visit_AnnAssign(self, node: ast.AnnAssign) -> None:
        self._assigned([node.target], node.value, node.lineno)
        self.generic_visit(node)

    def visit_AugAssign(self, node: ast.AugAssign) -> None:
        self._assigned([node.target], node.value, node.lineno)
        self.generic_visit(node)

    def visit_NamedExpr(self, node: ast.NamedExpr) -> None:
        self._assigned([node.target], node.value, node.lineno)
        self.generic_visit(node)

    def visit_Call(self, node: ast.Call) -> None:
        for arg in [*node.args, *(k.value for k in node.keywords)]:
            if isinstance(arg, ast.Name):
                self._edge(arg.id, dotted(node.func), "call_arg", node.lineno)
        self._django(node)
        self.generic_visit(node)

    def visit_Return(self, node: ast.Return) -> None:
        for name in [node.value] if not isinstance(node.value, ast.Tuple) else node.value.elts:
            if isinstance(name, ast.Name):
                self._edge(name.id, "<return>", "return", node.lineno)
        self.generic_visit(node)

    def _decorators(self, node: ast.FunctionDef | ast.AsyncFunctionDef) -> None:
        """Flask's route and FastAPI's verbs; of several decorators the last one counts."""
        found = None
        for d in node.decorator_list:
            if not (isinstance(d, ast.Call) and isinstance(d.func, ast.Attribute)):
                continue
            path = next((a.value for a in d.args if isinstance(a, ast.Constant) and isinstance(a.value, str)), "")
            if d.func.attr == "route":
                methods = next((k.value for k in d.keywords if k.arg == "methods"), None)
                listed = [e.value.upper() for e in getattr(methods, "elts", []) if isinstance(e, ast.Constant) and isinstance(e.value, str)]
                found = (",".join(listed) or "GET", path, node.name, "flask", d.lineno)
            elif d.func.attr in VERBS:
                found = (d.func.attr.upper(), path, node.name, "fastapi", d.lineno)
        if found:
            self.routes.append(found)

    def _django(self, node: ast.Call) -> None:
        if isinstance(node.func, ast.Name) and node.func.id == "path" and len(node.args) > 1 and isinstance(node.args[0], ast.Constant) and isinstance(node.args[0].value, str):
            self.routes.append(("ANY", node.args[0].value, dotted(node.args[1]), "django", node.lineno))


def extract(file: str, text: str) -> tuple[list[Symbol], list[Edge], list[Route]]:
    """Everything at once; source that does not parse has nothing."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return [], [], []
    walker = _Walker(file)
    walker.visit(tree)
    return walker.symbols, walker.edges, walker.routes


def symbols(text: str) -> list[Symbol]:
    """The symbols of :func:`extract` alone: expressions, which declare nothing, are not visited."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return []
    found: list[Symbol] = []
    _declared(tree, False, found)
    return found


def _declared(node: ast.AST, in_class: bool, found: list[Symbol]) -> None:
    for field in _BLOCKS:
        for child in getattr(node, field, None) or ():
            if isinstance(child, ast.ClassDef):
                found.append(("class", child.name, child.lineno, child.end_lineno or child.lineno))
                _declared(child, True, found)
            elif isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                found.append(("method" if in_class else "function", child.name, child.lineno, child.end_lineno or child.lineno))
                _declared(child, in_class, found)
            elif isinstance(child, _NESTING):
                _declared(child, in_class, found)


#: Fields that hold statements, in the order in which nodes have them, and what else has such fields.
_BLOCKS = ("cases", "body", "handlers", "orelse", "finalbody")
_NESTING = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.With, ast.AsyncWith, ast.Try, ast.TryStar, ast.Match, ast.match_case, ast.ExceptHandler)
