"""Looking over a file of queries: errors of each, and what the queries never touch."""

from __future__ import annotations

from dataclasses import dataclass

from hopline.errors import HoplineError
from hopline.plans import ast as A
from hopline.plans.check import check
from hopline.plans.parser import parse_queries
from hopline.plans.schema import Catalog


@dataclass(frozen=True)
class Finding:
    code: str
    level: str
    where: str
    message: str


def _sets(q: A.Query) -> set[tuple[str, str]]:
    return {(q.mutation.type, p) for p, _ in q.mutation.sets} if q.mutation and q.mutation.kind != "delete" else set()


def lint(catalog: Catalog, text: str) -> list[Finding]:
    """Errors by query, then L201 for each nullable property of an updated type that no update sets."""
    out, updated, covered = [], set(), set()
    for name, q in parse_queries(text).items():
        try:
            check(catalog, q)
        except HoplineError as e:
            out.append(Finding(getattr(e, "code", "") or "E", "error", name, str(e)))
            continue
        if q.mutation and q.mutation.kind == "update":
            updated.add(q.mutation.type)
            covered |= _sets(q)
    for kind in sorted(updated):
        for p in catalog.nodes[kind].props.values():
            if p.type.nullable and (kind, p.name) not in covered:
                out.append(Finding("L201", "warning", f"{kind}.{p.name}", f"no update query sets the nullable property {kind}.{p.name}"))
    return out
