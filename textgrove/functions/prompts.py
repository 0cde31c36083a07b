"""Instructions of the models: looked up by name, with defaults, and filled from columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULTS = {
    "toc": "Give the table of contents of this contract as JSON.\n\n{intro}",
    "boundaries": "Give the sections of this text as nested JSON, each with its first and last sentence.\n\n{table_of_contents}\n\n{content}",
    "summary": "Summarise this text in two sentences.\n\n{content}",
}


def prompt(name: str, lookup: Callable[[str], str | None] | None = None) -> str:
    """The instruction that lookup has by this name; the default where there is no lookup, or it fails or has none."""
    try:
        found = lookup(name) if lookup else None
    except Exception:  # noqa: BLE001  # a service that can't be reached must not stop a build
        found = None
    return found or DEFAULTS[name]


def filled(template: str, **values: Column | str) -> Column:
    """The template with each {name} replaced by the value of that column, null counting as empty; other braces stay."""
    out = F.lit(template)
    parts, rest = [], template
    while rest:
        at = min(((rest.find("{" + n + "}"), n) for n in values if "{" + n + "}" in rest), default=None)
        if at is None:
            parts.append(F.lit(rest))
            break
        parts.append(F.lit(rest[: at[0]]))
        value = values[at[1]]
        parts.append(F.coalesce(F.col(value) if isinstance(value, str) else value, F.lit("")))
        rest = rest[at[0] + len(at[1]) + 2 :]
    return F.concat(*parts) if parts else out
