"""Column names that cannot clash."""

from __future__ import annotations

from collections.abc import Iterable


def free(taken: Iterable[str], *names: str) -> list[str]:
    """The names, each with underscores added until it differs from all taken ones (in any case)."""
    used = {c.lower() for c in taken}
    made = []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        made.append(name)
    return made
