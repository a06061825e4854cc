"""Python, by its own parser."""

from __future__ import annotations

import ast
import re

from relgraph.extract.facts import Facts, Import

_VERB_ROUTE = re.compile(r"@\w+\.(?:delete|get|head|options|patch|post|put)\s*\(\s*(?:\"([^\"']+)|'([^\"']+))[\"']", re.I)
_PLAIN_ROUTE = re.compile(r"@\w+\.route\s*\(\s*(?:\"([^\"']+)|'([^\"']+))[\"']")


def _root(expression: ast.AST) -> str:
    """The name that a chain of attributes begins with, if it begins with one."""
    while hasattr(expression, "attr"):
        expression = expression.value
    return getattr(expression, "id", "")


def extract(text: str) -> Facts:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError) as problem:
        return Facts(error=f"syntax: {problem}")
    doc, bound = ast.get_docstring(tree), {}
    facts = Facts(docstring=doc.strip() if doc else "")
    every = list(ast.walk(tree))
    for node in every:
        match node:
            case ast.Import(names=names):
                for a in names:
                    one = Import(a.name, local_names=[a.asname or a.name.partition(".")[0]])
                    facts.imports.append(one)
                    bound[one.local_names[0]] = one
            case ast.ImportFrom(module=module, names=names, level=level):
                named = [a for a in names if a.name != "*"]
                one = Import(module or "", level or 0, [a.name for a in named], [a.asname or a.name for a in named], bool(level))
                facts.imports.append(one)
                bound |= dict.fromkeys(one.local_names, one)
    for node in tree.body:
        match node:
            case ast.FunctionDef(name=name) | ast.AsyncFunctionDef(name=name) | ast.ClassDef(name=name):
                facts.defined_symbols.append(name)
            case ast.Assign(targets=targets):
                facts.defined_symbols += [t.id for t in targets if isinstance(t, ast.Name)]
    for node in every:
        name = None
        match node:
            case ast.ClassDef(bases=bases):
                for base in bases:
                    facts.inherit(bound, _root(base))
            case ast.Attribute():  # counts besides the name at its root
                name = _root(node)
            case ast.Name(id=name, ctx=ast.Load()):
                pass
            case _:
                name = None
        if name in bound:
            facts.usage_counts[name] = facts.usage_counts.get(name, 0) + 1
    found = [*_VERB_ROUTE.findall(text), *_PLAIN_ROUTE.findall(text)]
    facts.http_routes = list(dict.fromkeys(a or b for a, b in found))
    return facts
