"""Name rules for columns and datasets (driver-side, schema only)."""

from __future__ import annotations

import os
import re

_NON_ALNUM = re.compile(r"[\W_]+", re.UNICODE)


def normalize_name(raw: object, empty: str = "unnamed_column") -> str:
    """Strip, lower-case, turn every run of non-alphanumerics into one ``_``,
    trim ``_`` at both ends; an empty result becomes ``empty``."""
    lowered = str(raw).strip().lower()
    return _NON_ALNUM.sub("_", lowered).strip("_") or empty


def unique_names(names: list[str]) -> list[str]:
    """Resolve clashes after normalisation: the second ``x`` becomes ``x_2``,
    the third ``x_3`` and so on, skipping names already taken."""
    taken: set[str] = set()
    result: list[str] = []
    for name in names:
        candidate, k = name, 1
        while candidate in taken:
            k += 1
            candidate = f"{name}_{k}"
        taken.add(candidate)
        result.append(candidate)
    return result


def normalized_columns(columns: list[str]) -> list[str]:
    return unique_names([normalize_name(c) for c in columns])


def dataset_name(path: str) -> str:
    """Table name from a file path: the stem, normalised; empty -> ``dataset``."""
    base = os.path.basename(str(path).rstrip("/"))
    stem = os.path.splitext(base)[0]
    return normalize_name(stem, empty="dataset")


# The hints on a column's meaning, with the parts of a name and
# the ending that call for each; the first that fits holds.
HINTS = (
    ("Likely monetary value. Confirm currency with the user.", ("revenue", "sales", "amount", "price", "cost", "profit"), None),
    ("Likely date/time field.", ("date",), "_at"),
    ("Likely customer/account identifier or segment.", ("customer", "client", "account"), None),
    ("Likely geographic dimension.", ("region", "country", "city", "state"), None),
)


def semantic_hint(column: str) -> str | None:
    """Hint from the column name."""
    name = column.lower()
    fitting = (hint for hint, parts, ending in HINTS if any(p in name for p in parts) or (ending and name.endswith(ending)))
    return next(fitting, None)


def looks_like_key(column: str) -> bool:
    """Key-like names: ``id``, ``*id`` (covers ``*_id``) or containing ``key``."""
    name = column.lower()
    return name.endswith("id") or "key" in name


def looks_like_identifier(column: str) -> bool:
    """Identifier names excluded from chart measures: ``id`` or ``*id``."""
    return column.lower().endswith("id")
