from __future__ import annotations

import re
from dataclasses import asdict, dataclass, field


def _empty() -> list:
    return field(default_factory=list)


@dataclass
class Import:
    module: str
    level: int = 0
    symbols: list[str] = _empty()
    local_names: list[str] = _empty()
    is_relative: bool = False
    base_classes: list[str] = _empty()
    is_reexport: bool = False


@dataclass
class Facts:
    """What one file says, before its imports are resolved."""

    imports: list[Import] = _empty()
    defined_symbols: list[str] = _empty()
    usage_counts: dict[str, int] = field(default_factory=dict)
    docstring: str = ""
    has_inheritance: bool = False
    error: str = ""
    http_routes: list[str] = _empty()
    http_calls: list[str] = _empty()

    def row(self, path: str) -> dict:
        return {"path": path} | asdict(self)

    def count_words(self, names: list[str], text: str) -> None:
        """Usage of local names: whole-word hits but the one that binds it."""
        for name in names:
            word = re.compile(r"\b" + re.escape(name) + r"\b")
            self.usage_counts[name] = max(0, sum(1 for _ in word.finditer(text)) - 1)

    def inherit(self, bound: dict[str, Import], base: str) -> None:
        if base in bound:
            self.has_inheritance = True
            bound[base].base_classes.append(base)
