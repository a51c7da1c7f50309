"""The opaque cursor of a page: base64url of a JSON object with time (to the microsecond) and id (as digits)."""

from __future__ import annotations

import base64
import binascii
import json

from cinderlog.model import BadRequest, Position
from cinderlog.operators.params import iso_of, micros_of


def encode(position: Position) -> str:
    text = json.dumps({"t": iso_of(position.micros), "i": str(position.id)}, separators=(",", ":"))
    return base64.urlsafe_b64encode(text.encode()).decode().rstrip("=")


def decode(cursor: str) -> Position:
    try:
        blob = base64.b64decode(cursor + "=" * (-len(cursor) % 4), altchars=b"-_", validate=True)
        found = json.loads(blob)
        at, number = found["t"], found["i"]
        micros = micros_of(at) if isinstance(at, str) else None
        if micros is None or not (isinstance(number, str) and number.isascii() and number.isdigit()):
            raise ValueError("not a position")
        return Position(micros, int(number))
    except (binascii.Error, ValueError, KeyError, TypeError):
        raise BadRequest("invalid cursor") from None
