"""The JSON list of columns to drop (duplicates allowed in the file)."""

from __future__ import annotations

import json


def load_drop_list(path: str) -> list[str]:
    with open(path) as fh:
        names = json.load(fh)
    if not isinstance(names, list) or not all(isinstance(n, str) for n in names):
        raise ValueError(f"{path}: expected a JSON list of column names")
    return list(dict.fromkeys(names))  # de-duplicate, keep first-seen order
