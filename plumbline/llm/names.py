"""Helper columns that never meet a caller's."""

from __future__ import annotations

from collections.abc import Iterable


def free_name(name: str, taken: Iterable[str]) -> str:
    """``name``, with as many underscores before it as it takes to differ from all ``taken`` names in any case."""
    held = {t.lower() for t in taken}
    while name.lower() in held:
        name = "_" + name
    return name
