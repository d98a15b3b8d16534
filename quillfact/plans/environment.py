"""What validation knows of the catalog: signatures, fingerprint, suggestions."""

from __future__ import annotations

import hashlib

from ..sources.catalog import Catalog

LANGUAGE_VERSION = "quillfact-dsl/1"


def fingerprint(catalog: Catalog) -> str:
    """A digest of names, arities and observed types, and of the language's version."""
    said = []
    for name in sorted(catalog.predicates):
        p = catalog.predicates[name]
        said.append(f"{name}/{p.arity}[{','.join(f'{i}:{'|'.join(sorted(t))}' for i, t in enumerate(p.types))}]")
    return "sha256:" + hashlib.sha256(f"{';'.join(said)}|{LANGUAGE_VERSION}".encode()).hexdigest()


def _distance(a: str, b: str) -> int:
    """Edit distance, row by row."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def suggestions(catalog: Catalog, name: str, arity: int | None = None, most: int = 5) -> list[str]:
    """Known names close to ``name``: same but for case and dashes, then by edit
    distance less three times the share of common words, then by arity."""
    plain = lambda s: s.lower().replace("-", "_")
    want, words = plain(name), set(filter(None, plain(name).split("_")))
    found = []
    for p in catalog.predicates.values():
        have = plain(p.name)
        mine = set(filter(None, have.split("_")))
        common = len(words & mine) / len(words | mine) if words and mine else 0.0
        d = _distance(want, have)
        if d <= max(3, len(want) // 2) or common > 0:
            found.append((100.0 * (have != want) + d - 3 * common + 0.5 * (arity is not None and arity != p.arity), p.name, p.arity))
    return [n for _, n, _ in sorted(found)[:most]]
