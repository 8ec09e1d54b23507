"""JSON of OpenAPI documents. Schemas nest without a bound, so two small Arrow UDFs read and write them."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from weftlog.functions.params import lists

METHODS = ("get", "post", "put", "patch", "delete", "head", "options")
FIELD = "struct<name:string,in:string,required:boolean,type:string>"
JSON_BODY = "application/json"


def properties(schema: object) -> Iterator[tuple[str, bool, str]]:
    """(dotted name, required, type) of each property, a property before those in it."""
    stack = [("", schema)]
    while stack:
        prefix, now = stack.pop()
        fields = now.get("properties") if isinstance(now, dict) else None
        if prefix:
            name, needed, kind = prefix
            yield name, needed, kind
        if isinstance(fields, dict):
            required = now["required"] if isinstance(now.get("required"), list) else []
            inner = []
            for name, child in fields.items():
                kind = child.get("type", "unknown") if isinstance(child, dict) else "unknown"
                inner.append(((f"{prefix[0]}.{name}" if prefix else name, name in required, str(kind)), child))
            stack.extend(reversed(inner))


def body_fields(schema: Column) -> Column:
    """The properties of a JSON schema as parameters in the body; none for null or bad JSON."""

    def read(text: str) -> list[tuple[str, str, bool, str]]:
        try:
            found = json.loads(text) if text else None
        except ValueError:
            found = None
        return [(n, "body", r, t) for n, r, t in properties(found)]

    @F.arrow_udf(f"array<{FIELD}>")
    def run(texts: pa.Array) -> pa.Array:
        return lists(texts, read, [("name", pa.string()), ("in", pa.string()), ("required", pa.bool_()), ("type", pa.string())])

    return run(F.coalesce(schema, F.lit("")))


def tidy(schema: dict) -> dict:
    """A schema without an empty format and without the one value that stands for an empty list."""
    return {k: v for k, v in schema.items() if not (k == "format" and v is None or k == "enum" and v == ["[]"])}


def with_request_body(operation: dict) -> dict:
    """An operation whose body parameters have become its request body; of several the last is the JSON body, and any may require it."""
    listed = operation.get("parameters")
    given = [p | {"schema": tidy(p["schema"])} if isinstance(p.get("schema"), dict) else p for p in listed if isinstance(p, dict)] if isinstance(listed, list) else []
    body = [p for p in given if str(p.get("in") or "").lower() == "body"]
    out = operation | {"parameters": [p for p in given if p not in body]}
    if body:
        last, needed = body[-1], any(p.get("required") for p in body)
        schema = last["schema"] if isinstance(last.get("schema"), dict) else {"type": "object"}
        if schema.get("type") != "object":
            name = str(last.get("name") or "body")
            schema = {"type": "object", "properties": {name: schema}, "required": [name] if last.get("required") else []}
        old = operation["requestBody"] if isinstance(operation.get("requestBody"), dict) else {}
        out["requestBody"] = old | {"required": bool(old.get("required") or needed), "content": (old.get("content") or {}) | {JSON_BODY: {"schema": schema}}}
    return out


def normal_operation(operation: Column) -> Column:
    """The JSON of an operation with its body parameters as request body; other JSON, bad JSON and null as they are."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        def one(text: str | None):
            try:
                found = json.loads(text) if text else None
            except ValueError:
                return text
            return json.dumps(with_request_body(found), ensure_ascii=False) if isinstance(found, dict) else text

        return texts.map(one)

    return run(operation)
