"""Reading the raw answers kept in ``adapted.payload``.

``spark``'s own JSON readers accept trailing text, coerce types and ignore unknown keys, so the gate and every
operator that needs the adapted text read the payload through :func:`read_payload`, an Arrow-batched UDF.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ``state``: ``null`` no payload; ``object`` one complete JSON object and white space only around it; ``wrapped`` a
#: complete object with other text around it; ``open`` an object begins and the payload ends before it is complete;
#: ``broken`` anything else.
PAYLOAD_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("state", "adapted_text", "hints", "notes")] + [T.StructField("schema_ok", T.BooleanType())]
)

_DECODER = json.JSONDecoder(strict=False)
_HINT_KEYS = {"term", "spoken_as", "reason"}
_KEYS = {"adapted_text", "pronunciation_hints", "notes"}


def object_is_open(text: str, start: int) -> bool:
    """Whether the object that begins at ``start`` is still open where the text ends."""
    depth, in_string, i, n = 0, False, start, len(text)
    while i < n:
        c = text[i]
        if in_string:
            if c == "\\":
                i += 1
            elif c == '"':
                in_string = False
        elif c == '"':
            in_string = True
        elif c in "{[":
            depth += 1
        elif c in "}]":
            depth -= 1
            if depth <= 0:
                return False
        i += 1
    return True


def _schema_ok(obj: dict) -> bool:
    text, hints, notes = obj.get("adapted_text"), obj.get("pronunciation_hints", []), obj.get("notes", "")
    if set(obj) - _KEYS or not isinstance(text, str) or not text or not isinstance(notes, str) or not isinstance(hints, list):
        return False
    for h in hints:
        if not isinstance(h, dict) or set(h) - _HINT_KEYS:
            return False
        if not all(isinstance(h.get(k), str) and h[k] for k in ("term", "spoken_as")) or not isinstance(h.get("reason", ""), str):
            return False
    return True


def payload_record(payload: str | None) -> tuple:
    """One payload's fields; see :data:`PAYLOAD_SCHEMA`. Without a string ``adapted_text`` that field is null."""
    if payload is None:
        return "null", None, None, None, False
    at = payload.find("{")
    if at < 0:
        return "broken", None, None, None, False
    try:
        obj, end = _DECODER.raw_decode(payload, at)
    except (ValueError, RecursionError):
        return ("open" if object_is_open(payload, at) else "broken"), None, None, None, False
    whole = not payload[:at].strip() and not payload[end:].strip()
    strict = whole
    if whole:
        try:
            json.loads(payload)
        except (ValueError, RecursionError):
            strict = False
    text, notes, hints = obj.get("adapted_text"), obj.get("notes"), obj.get("pronunciation_hints")
    return (
        "object" if strict else "wrapped" if not whole else "broken",
        text.encode("utf-8", "replace").decode() if isinstance(text, str) else None,
        json.dumps(hints, ensure_ascii=False) if isinstance(hints, list) else None,
        notes.encode("utf-8", "replace").decode() if isinstance(notes, str) else None,
        _schema_ok(obj),
    )


@F.pandas_udf(PAYLOAD_SCHEMA)
def read_payload(payload: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([payload_record(x) for x in payload], columns=["state", "adapted_text", "hints", "notes", "schema_ok"])
