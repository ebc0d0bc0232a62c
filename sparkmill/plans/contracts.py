"""Storage contracts: a small JSON Schema says which columns the Parquet sink has, and which rows it takes as they are.

A contract is compiled once into nodes; a node gives its Spark type and the check whether a value fits without loss.
Without a contract the first accepted row's types are inferred and
fixed. Whole numbers are long, or decimal(20,0) where they are declared `uint64`; numbers are doubles, and a whole number
that no double holds exactly does not fit. An optional field may be absent; null fits only where it is declared.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The keywords that a contract may hold, and the type that each needs.
KEYWORDS = {"type": None, "description": None, "title": None, "properties": "object", "required": "object", "additionalProperties": "object", "items": "array", "format": "integer"}
META = {"record_id": "string", "run_id": "string", "source_fingerprint": "string", "pipeline_hash": "string", "stage": "string", "generator_provider": "string", "generator_model": "string", "prompt_hash": "string", "template_engine": "string", "source_position": "long", "pipeline_version": "long", "attempt": "long", "judge_provider": "string", "judge_model": "string", "judge_score": "double"}
_OPTIONAL = ("judge_provider", "judge_model", "judge_score")
_SIMPLE = {"null": T.NullType(), "boolean": T.BooleanType(), "string": T.StringType(), "integer": T.LongType(), "unsigned": T.DecimalType(20, 0), "number": T.DoubleType()}


class ContractError(ValueError):
    """A contract that cannot be compiled; the message holds a path and a rule."""


@dataclass(frozen=True)
class Node:
    kind: str
    nullable: bool = False
    item: Node | None = None
    fields: dict[str, tuple[Node, bool]] = field(default_factory=dict)

    def type(self) -> T.DataType:
        if self.kind == "array":
            return T.ArrayType(self.item.type(), True)
        if self.kind == "object":
            return T.StructType([T.StructField(n, x.type(), x.nullable or not needed) for n, (x, needed) in self.fields.items()])
        return _SIMPLE[self.kind]

    def takes(self, value: Any, loose: bool = False, extra: tuple[str, ...] = ()) -> bool:
        """Whether a JSON value fits without loss; `loose` lets null be anywhere, `extra` names keys without a rule."""
        if value is None:
            return self.nullable or loose
        if isinstance(value, bool) or self.kind == "boolean":
            return isinstance(value, bool) and self.kind == "boolean"
        if self.kind in ("integer", "unsigned"):
            least, most = (-(2**63), 2**63) if self.kind == "integer" else (0, 2**64)
            return isinstance(value, int) and least <= value < most
        if self.kind == "number":
            return isinstance(value, float) or isinstance(value, int) and -(2**63) <= value < 2**64 and int(float(value)) == value
        if self.kind == "string":
            return isinstance(value, str)
        if self.kind == "array":
            return isinstance(value, list) and all(self.item.takes(x, loose) for x in value)
        if self.kind != "object" or not isinstance(value, dict) or not set(value) <= {*self.fields, *extra}:
            return False
        return all(node.takes(value[n], loose) if n in value else not needed for n, (node, needed) in self.fields.items())

    def plain(self) -> dict:
        return {"kind": self.kind, "nullable": self.nullable, "item": self.item and self.item.plain(), "fields": {n: [x.plain(), needed] for n, (x, needed) in self.fields.items()}}


def from_plain(value: dict) -> Node:
    return Node(value["kind"], value["nullable"], value["item"] and from_plain(value["item"]), {n: (from_plain(x), needed) for n, (x, needed) in value["fields"].items()})


def _node(value: Any, path: str) -> Node:
    if not isinstance(value, dict):
        raise ContractError(f"{path}: schema must be an object")
    if odd := sorted(set(value) - set(KEYWORDS)):
        raise ContractError(f"{path}: unsupported schema keyword {odd[0]}")
    kind = value.get("type")
    nullable = kind == "null"
    if isinstance(kind, list):
        others = [k for k in kind if k != "null"]
        if len(kind) != 2 or len(others) != 1 or not isinstance(others[0], str):
            raise ContractError(f"{path}: a union is of one type and null")
        kind, nullable = others[0], True
    if not isinstance(kind, str):
        raise ContractError(f"{path}: type is required")
    for k, needs in KEYWORDS.items():
        if k in value and needs not in (None, kind):
            raise ContractError(f"{path}: {k} is not valid for {kind}")
    if kind == "array":
        if "items" not in value:
            raise ContractError(f"{path}: array items are required")
        return Node("array", nullable, _node(value["items"], f"{path}.items"))
    if kind == "object":
        own, needed = value.get("properties"), value.get("required", [])
        if value.get("additionalProperties", False) is not False:
            raise ContractError(f"{path}: additionalProperties must be false when given")
        if not isinstance(own, dict) or not own:
            raise ContractError(f"{path}: object properties are required and not empty")
        if not isinstance(needed, list) or any(not isinstance(n, str) or n not in own for n in needed) or len(set(needed)) < len(needed):
            raise ContractError(f"{path}: required names distinct declared properties")
        return Node("object", nullable, None, {n: (_node(x, f"{path}.properties.{n}"), n in needed) for n, x in sorted(own.items())})
    if kind == "integer" and "format" in value:
        if value["format"] not in ("int64", "uint64"):
            raise ContractError(f"{path}: integer format is int64 or uint64")
        kind = "unsigned" if value["format"] == "uint64" else kind
    if kind not in _SIMPLE or kind == "unsigned" and value.get("type") == "unsigned":
        raise ContractError(f"{path}: unsupported type")
    return Node(kind, nullable)


def meta() -> T.StructField:
    types = {"string": T.StringType(), "long": T.LongType(), "double": T.DoubleType()}
    return T.StructField("_meta", T.StructType([T.StructField(n, types[k], n in _OPTIONAL) for n, k in META.items()]), False)


@dataclass(frozen=True)
class Contract:
    """What rows the sink takes, and the schema they are written with. Inferred contracts take null anywhere."""

    root: Node
    inferred: bool = False

    def schema(self) -> T.StructType:
        own = [f for f in self.root.type().fields]
        return T.StructType([*own, meta()])

    def fits(self, row: str | Column) -> Column:
        """Whether a row, as canonical JSON, fits."""
        root, loose = self.root, self.inferred

        def run(texts: pd.Series) -> pd.Series:
            return pd.Series([t is not None and root.takes(json.loads(t), loose, ("_meta",)) for t in texts], dtype=bool)

        return F.pandas_udf(run, "boolean")(row)

    def typed(self, row: Column) -> Column:
        """The typed row of a JSON text that fits."""
        return F.from_json(row, self.schema(), {"mode": "FAILFAST"})


def compile_contract(schema: Any) -> Contract:
    root = _node(schema, "output.schema")
    if root.kind != "object" or root.nullable:
        raise ContractError("output.schema: root must have type object and not be nullable")
    if "_meta" in root.fields:
        raise ContractError("output.schema: _meta is managed automatically")
    return Contract(root)


def _inferred(value: Any) -> Node:
    if isinstance(value, bool):
        return Node("boolean", True)
    if value is None:
        return Node("null", True)
    if isinstance(value, int):
        if not -(2**63) <= value < 2**63:
            raise ContractError("a whole number beyond 64 bits has no inferred type")
        return Node("integer", True)
    if isinstance(value, float):
        return Node("number", True)
    if isinstance(value, str):
        return Node("string", True)
    if isinstance(value, list):
        found = [_inferred(x) for x in value if x is not None]
        kinds = [k for n, k in enumerate(found) if k not in found[:n]]
        if {k.kind for k in kinds} == {"integer", "number"}:
            kinds = [Node("number", True)]
        if len(kinds) > 1:
            raise ContractError("an array of several types has no inferred type")
        return Node("array", True, kinds[0] if kinds else Node("null", True))
    if not value:
        raise ContractError("an empty object has no inferred type")
    return Node("object", True, None, {k: (_inferred(x), False) for k, x in sorted(value.items())})


def infer(row: dict) -> Contract:
    """The contract of the first accepted row, without its `_meta`; ContractError, which names no value, where it has none."""
    return Contract(_inferred({k: v for k, v in row.items() if k != "_meta"}), True)
