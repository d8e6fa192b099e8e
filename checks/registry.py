"""Registry of checked queries: Spark callable plus, where possible, the same result as SQL."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from checks.views import SQL_VIEWS


@dataclass(frozen=True)
class Check:
    build: Callable
    sql: str | None


CHECKS: dict[str, Check] = {}


def check(name: str, sql: str | None = None):
    def keep(build):
        if name in CHECKS:
            raise ValueError(f"query {name} is registered twice")
        CHECKS[name] = Check(build, None if sql is None else with_views(sql))
        return build

    return keep


def _needed(text: str, found: list[str]) -> None:
    for view in re.findall(r"\bv_\w+", text):
        if view in SQL_VIEWS and view not in found:
            _needed(SQL_VIEWS[view], found)
            found.append(view)


def with_views(sql: str) -> str:
    used: list[str] = []
    _needed(sql, used)
    body = sql.strip()
    if body[:4].lower() == "with":
        body = re.sub(r"^with(\s+recursive)?\s+", "", body, flags=re.I)
        prefix = "".join(f"{v} AS ({SQL_VIEWS[v]}), " for v in used)
        return f"WITH RECURSIVE {prefix}{body}"
    if not used:
        return body
    return "WITH RECURSIVE " + ", ".join(f"{v} AS ({SQL_VIEWS[v]})" for v in used) + " " + body
