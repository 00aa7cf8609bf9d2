"""Names of types in the dialect and in Spark."""

from __future__ import annotations

import re

TYPES = {
    "VARCHAR": "string", "TEXT": "string", "CHAR": "string", "STRING": "string", "BPCHAR": "string", "UUID": "string", "TIME": "string", "DECIMAL": "double", "NUMERIC": "double", "DOUBLE": "double", "FLOAT8": "double",
    "REAL": "float", "FLOAT4": "float", "FLOAT": "float", "TINYINT": "tinyint", "INT1": "tinyint", "SMALLINT": "smallint", "INT2": "smallint", "SHORT": "smallint", "INT": "int", "INT4": "int", "INTEGER": "int", "SIGNED": "int",
    "BIGINT": "bigint", "INT8": "bigint", "LONG": "bigint", "HUGEINT": "decimal(38,0)", "BOOL": "boolean", "BOOLEAN": "boolean", "LOGICAL": "boolean", "BLOB": "binary", "BYTEA": "binary", "BINARY": "binary", "VARBINARY": "binary",
    "TIMESTAMP": "timestamp_ntz", "TIMESTAMPTZ": "timestamp_ntz", "DATETIME": "timestamp_ntz", "DATE": "date",
}
INTEGERS = ("tinyint", "smallint", "int", "bigint")


def type_name(name: str) -> str:
    """Spark's name of a type, with or without (n) or (p, s)."""
    m = re.match(r"(\w+)(?:\s+PRECISION|\s+VARYING)?\s*(\(.*\))?$", name.strip(), re.I | re.S)
    return TYPES.get(m[1].upper(), name.strip().lower()) if m else name
