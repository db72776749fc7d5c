"""Run parameters from the command line: `--name value` pairs folded into a dataclass."""

from __future__ import annotations

import logging
from collections.abc import Sequence
from dataclasses import fields, replace
from typing import TypeVar

T = TypeVar("T")


def fold_arguments(base: T, arguments: Sequence[str]) -> T:
    """base with the named fields replaced, in their own types; an unknown pair is a warning, not an error."""
    kinds = {f.name: type(getattr(base, f.name)) for f in fields(base)}
    found = {}
    for name, value in zip(arguments[::2], arguments[1::2], strict=False):
        key = name.removeprefix("--").replace("-", "_")
        if key in kinds:
            found[key] = value if kinds[key] is type(None) else kinds[key](value)
        else:
            logging.getLogger(__name__).warning("unknown argument %s", name)
    return replace(base, **found)
