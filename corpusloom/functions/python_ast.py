"""What the syntax tree of a Python file holds, as rows of kind, value and number.

One walk fills all kinds; texts that don't parse give no rows. The renamers bring code into a form that does not depend
on the names its author chose.
"""

from __future__ import annotations

import ast
import hashlib
import re
import warnings
from collections.abc import Callable, Iterator

Row = tuple[str, str, float]

# --- fixed values ---
_KEPT_NAMES = frozenset("True False None print len range str int list dict set tuple".split())
_KEPT_NUMBERS = (0, 1, -1, 2, 100, 200, 404, 500)
_COMMON_NUMBERS = (0, 1, 2, -1, 100, 200, 201, 204, 400, 401, 403, 404, 500)
_NEVER_RENAMED = frozenset("self cls True False None".split())
_BRANCHES = (ast.If, ast.While, ast.For, ast.ExceptHandler, ast.With, ast.Assert, ast.comprehension)
_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
_MODEL_BASES = ("BaseModel", "BaseSettings", "BaseConfig")
_FLAGS: dict[str, tuple[type, ...]] = {"async": (ast.AsyncFunctionDef,), "generators": (ast.Yield, ast.YieldFrom), "contexts": (ast.With, ast.AsyncWith), "comprehensions": (ast.ListComp, ast.SetComp, ast.DictComp, ast.GeneratorExp)}


def parsed(text: str | None) -> ast.Module | None:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            return ast.parse(text or "")
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def complexity_of(node: ast.AST) -> int:
    """One more than the branches: if, loops, handlers, with, assert, comprehensions and extra operands of and/or."""
    return 1 + sum(isinstance(n, _BRANCHES) + (len(n.values) - 1 if isinstance(n, ast.BoolOp) else 0) for n in ast.walk(node))


def last_name(node: ast.AST) -> str | None:
    """The last part of a dotted name or of what is called; None for other expressions."""
    node = node.func if isinstance(node, ast.Call) else node.value if isinstance(node, ast.Subscript) else node
    return node.id if isinstance(node, ast.Name) else node.attr if isinstance(node, ast.Attribute) else None


def text_hash(lines: list[str], node: ast.AST) -> str:
    """Hash of a node's lines without remarks and with single blanks."""
    source = re.sub(r"(?m)#.*$", "", "\n".join(lines[node.lineno - 1 : node.end_lineno]))
    return hashlib.md5(" ".join(source.split()).encode("utf-8", "surrogatepass")).hexdigest()


def _of_function(node: ast.AST, lines: list[str]) -> Iterator[Row]:
    args = [a.arg for a in node.args.args]
    back = f" -> {ast.unparse(node.returns)}" if node.returns else ""
    yield "function", node.name, complexity_of(node)
    yield "function_length", node.name, node.end_lineno - node.lineno
    yield "signature", f"def {node.name}({', '.join(args)}){back}", len(args)
    yield "function_hash", f"{node.name}={text_hash(lines, node)}", node.lineno
    if node.returns or any(a.annotation for a in node.args.args):
        yield "hinted", node.name, 1
    if node.returns and (hint := last_name(node.returns)) and not isinstance(node.returns, (ast.Attribute, ast.Call)):
        yield "return_hint", hint, 0
    for d in node.decorator_list:
        yield "decorator", last_name(d) or ast.unparse(d), 0


def _of_class(node: ast.ClassDef, lines: list[str]) -> Iterator[Row]:
    methods = [n for n in node.body if isinstance(n, _FUNCTIONS)]
    yield "class", node.name, len(methods)
    yield "class_length", node.name, node.end_lineno - node.lineno
    yield "class_def", f"class {node.name}({', '.join(map(ast.unparse, node.bases))})", len(node.bases)
    yield "class_hash", f"{node.name}={text_hash(lines, node)}", node.lineno
    for base in node.bases:
        if (name := last_name(base)) and isinstance(base, (ast.Name, ast.Attribute)):
            yield "base", name, 0
    for method in methods:
        yield "method", f"{node.name}.{method.name}", complexity_of(method)
    for target in (t for n in node.body for t in ((n.target,) if isinstance(n, ast.AnnAssign) else n.targets if isinstance(n, ast.Assign) else ())):
        if isinstance(target, ast.Name):
            yield "attribute", f"{node.name}.{target.id}", 0


def _of_constant(node: ast.Constant) -> Iterator[Row]:
    v = node.value
    if isinstance(v, str):
        if len(v) > 10:
            yield "literal", v[:100], len(v)
        if len(v) > 15 and not v.startswith(("/", "http", "sqlite")):
            yield "string", v, len(v)
    elif isinstance(v, (int, float)) and v not in _COMMON_NUMBERS:
        yield "number", repr(v), float(v) if abs(v) < 1e300 else 0.0


def features_of(text: str | None) -> list[Row]:
    """Rows ``(kind, value, number)`` of a file; an unparsable file has none.

    Kinds: class, base, class_def, class_doc, class_hash, class_length, method, attribute, function, signature,
    function_hash, function_length, hinted, docstring, documented, decorator, return_hint, import, import_path, variable,
    literal, string, number, handler, model and flag.
    """
    tree = parsed(text)
    if tree is None:
        return []
    out: list[Row] = []
    lines = (text or "").split("\n")
    classes: list[str] = []
    bases: list[str] = []
    for node in ast.walk(tree):
        if isinstance(node, _FUNCTIONS):
            out += _of_function(node, lines)
        elif isinstance(node, ast.ClassDef):
            out += _of_class(node, lines)
            classes.append(node.name)
            bases += [n for b in node.bases if isinstance(b, (ast.Name, ast.Attribute)) and (n := last_name(b))]
        elif isinstance(node, (ast.Import, ast.ImportFrom)):
            for path in [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module] if node.module else []:
                out += [("import", path.split(".")[0], 0), ("import_path", path, 0)]
        elif isinstance(node, ast.Name) and isinstance(node.ctx, ast.Store):
            out.append(("variable", node.id, 0))
        elif isinstance(node, ast.Constant):
            out += _of_constant(node)
        elif isinstance(node, (ast.Try, ast.ExceptHandler)):
            out.append(("handler", type(node).__name__, 0))
        if isinstance(node, (*_FUNCTIONS, ast.ClassDef, ast.Module)) and (doc := ast.get_docstring(node, clean=False)) is not None:
            kind = "class_doc" if isinstance(node, ast.ClassDef) else "module_doc" if isinstance(node, ast.Module) else "documented"
            out.append((kind, doc[:200], len(doc)))
            if len(doc) > 10 and kind == "documented":
                out.append(("docstring", doc[:200], len(doc)))
        out += [("flag", name, 0) for name, kinds in _FLAGS.items() if isinstance(node, kinds)]
    # A class and the base at the same place of the two lists, whether or not they belong together: the job's rule.
    out += [("model", name, 0) for name, base in zip(classes, bases, strict=False) if base in _MODEL_BASES or "Base" in base]
    return out


def _numbered() -> Callable[[str, str], str]:
    """Placeholders by kind, numbered in order of appearance; a name keeps its first placeholder."""
    given: dict[str, str] = {}
    counts: dict[str, int] = {}

    def name(kind: str, original: str) -> str:
        if original not in given:
            given[original] = f"{kind}_{counts.get(kind, 0)}"
            counts[kind] = counts.get(kind, 0) + 1
        return given[original]

    return name


def renamed(tree: ast.AST) -> ast.AST:
    """The tree with placeholders for variables, functions and classes, long strings and unusual numbers; arguments,
    attributes, private names and a few built-ins stay. Changes the tree that is given."""
    name = _numbered()
    stack = [tree]
    while stack:
        node = stack.pop()
        if isinstance(node, ast.Name) and node.id not in _KEPT_NAMES:
            node.id = name("VAR", node.id)
        elif isinstance(node, (*_FUNCTIONS, ast.ClassDef)) and not node.name.startswith("_"):
            node.name = name("CLASS" if isinstance(node, ast.ClassDef) else "FUNC", node.name)
        elif isinstance(node, ast.Constant) and isinstance(node.value, str) and len(node.value) > 20:
            node.value = "STRING_LITERAL"
        elif isinstance(node, ast.Constant) and isinstance(node.value, (int, float)) and node.value not in _KEPT_NUMBERS:
            node.value = 0
        stack.extend(reversed(list(ast.iter_child_nodes(node))))
    return tree


def tree_outline(tree: ast.AST) -> str:
    """The classes of a tree's nodes, one a line, indented by depth."""
    lines, stack = [], [(tree, 0)]
    while stack:
        node, depth = stack.pop()
        lines.append(" " * depth + type(node).__name__)
        stack.extend((child, depth + 1) for child in reversed(list(ast.iter_child_nodes(node))))
    return "\n".join(lines)


def neutral_identifiers(code: str) -> str:
    """The text with its names, functions and arguments numbered VAR0, VAR1 and so on, longest first (equal lengths in
    alphabetical order); a text that doesn't parse by itself, such as an indented method, stays as it is."""
    tree = parsed(code)
    if tree is None:
        return code
    names = {n.id if isinstance(n, ast.Name) else n.arg if isinstance(n, ast.arg) else n.name for n in ast.walk(tree) if isinstance(n, (ast.Name, ast.arg, *_FUNCTIONS))}
    order = sorted((n for n in names if not n.startswith("_") and n not in _NEVER_RENAMED), key=lambda n: (-len(n), n))
    if not order:
        return code
    number = {n: f"VAR{k}" for k, n in enumerate(order)}
    return re.sub(r"\b(?:" + "|".join(map(re.escape, order)) + r")\b", lambda m: number[m.group()], code)


