"""Naming styles for driver-side names; columns use `functions.scalars`."""

from __future__ import annotations

import re


def snake(name: str) -> str:
    edges = "(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|(?<=[0-9])(?=[A-Za-z])"
    return re.sub(edges, "_", name).lower()
