"""Typed state trees: encoded as JSON with contents apart, decoded again, and digested by content."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Callable, Iterator, Mapping
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The member that marks an encoded node; plain members of that name are inside a mapping's items and can't be mistaken.
NODE = "@node"
#: Whole numbers beyond this are written as text, as not every JSON reader keeps them.
EXACT = 2**53


def encode(value: Any, put: Callable[[bytes], str] | None = None) -> Any:
    """A JSON value that keeps mappings with any keys, tuples, large numbers, bytes and arrays apart.

    Bytes and arrays go to `put`, which gives their digest. A value of another type, a number that isn't finite, or
    contents without a place for them are a TypeError, never a guess from how they print.
    """
    if isinstance(value, Mapping):
        return {NODE: "mapping", "items": [[encode(k, put), encode(v, put)] for k, v in value.items()]}
    if isinstance(value, list | tuple):
        return {NODE: "list" if isinstance(value, list) else "tuple", "items": [encode(v, put) for v in value]}
    if value is None or isinstance(value, bool | str):
        return value
    if isinstance(value, int):
        return value if abs(value) < EXACT else {NODE: "int", "value": str(value)}
    if isinstance(value, float):
        if not math.isfinite(value):
            raise TypeError("a number isn't finite")
        return value
    if put is None:
        raise TypeError(f"no place for the contents of a {type(value).__name__}")
    if isinstance(value, bytes | bytearray):
        return {NODE: "bytes", "sha256": put(bytes(value))}
    if hasattr(value, "dtype") and hasattr(value, "tobytes") and value.dtype.kind in "biufc":
        return {NODE: "array", "dtype": value.dtype.str, "shape": list(value.shape), "sha256": put(value.tobytes())}
    raise TypeError(f"a {type(value).__name__} can't be encoded")


def decode(value: Any, get: Callable[[str], bytes] | None = None) -> Any:
    """The value that was encoded; `get` gives contents by their digest."""
    if not isinstance(value, dict):
        return value
    kind = value[NODE]
    if kind == "mapping":
        return {decode(k, get): decode(v, get) for k, v in value["items"]}
    if kind in ("list", "tuple"):
        items = [decode(v, get) for v in value["items"]]
        return items if kind == "list" else tuple(items)
    if kind == "int":
        return int(value["value"])
    content = get(value["sha256"])
    if kind == "bytes":
        return content
    import numpy as np

    return np.frombuffer(content, dtype=value["dtype"]).reshape(value["shape"]).copy()


def digest(value: Any) -> str | None:
    """The SHA-256 of a value's types and whole contents; None if it can't be encoded."""
    contents: dict[str, bytes] = {}

    def put(data: bytes) -> str:
        name = hashlib.sha256(data).hexdigest()
        contents[name] = data
        return name

    try:
        text = json.dumps(encode(value, put), sort_keys=True, separators=(",", ":"), allow_nan=False)
    except (TypeError, ValueError, RecursionError):
        return None
    h = hashlib.sha256(text.encode())
    for name in sorted(contents):
        h.update(b"\0" + name.encode() + contents[name])
    return h.hexdigest()


def digests(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """id, sha256 of JSON values; null for what isn't JSON. Equal values with their members in another order are equal."""

    def run(source: Iterator[Any]) -> Iterator[Any]:
        import pandas as pd

        def one(text: str | None) -> str | None:
            try:
                return digest(json.loads(text, object_pairs_hook=lambda items: dict(sorted(items))))
            except (TypeError, ValueError):
                return None

        for pdf in source:
            yield pd.DataFrame({"id": pdf["id"], "sha256": [one(t) for t in pdf["text"]]})

    return df.select(F.col(id_col).cast("string").alias("id"), F.col(json_col).cast("string").alias("text")).mapInPandas(run, "id string, sha256 string")
