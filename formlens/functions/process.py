"""Values that a Python process makes once, such as a loaded model."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Hashable
from typing import Any

REGISTRY = "_formlens_values_of_this_process"


def per_process(key: Hashable, make: Callable[[], Any]) -> Any:
    """The value under ``key``, made by the first call in this process.

    Functions travel to workers by value, so their own globals start anew with every task;
    a registered module stays as long as the worker does.
    """
    values = sys.modules.setdefault(REGISTRY, types.ModuleType(REGISTRY)).__dict__
    if key not in values:
        values[key] = make()
    return values[key]


def latest_of_process(slot: str, token: Hashable, make: Callable[[], Any]) -> Any:
    """The value of ``slot``, made anew when ``token`` is another than before: one model is kept, not each."""
    held = per_process(("slot", slot), dict)
    if held.get("token") != token:
        held.clear()
        held["value"] = make()
        held["token"] = token
    return held["value"]
