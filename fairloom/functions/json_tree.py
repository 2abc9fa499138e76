"""Reading JSON texts on executors: order of keys kept, constants that are not JSON refused."""

from __future__ import annotations

import json


def _refuse(name: str):
    raise ValueError(name)


_DECODER = json.JSONDecoder(parse_constant=_refuse)


def parse(text: str | None):
    """The object of a JSON text; None for NULL, for invalid texts and for texts that hold something else than an object."""
    if not text:
        return None
    try:
        v = _DECODER.decode(text)
    except (ValueError, RecursionError):
        return None
    return v if isinstance(v, dict) else None


def parse_any(text: str):
    """The value of a JSON text, None if it is invalid."""
    try:
        return _DECODER.decode(text)
    except (ValueError, RecursionError):
        return None
