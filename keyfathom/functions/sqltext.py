"""Writing values into SQL text.

Large expressions are handed to Spark as one SQL string: the parser builds them
in a single call, where the column API needs thousands.
"""

from __future__ import annotations


def literal(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return repr(value)
    if isinstance(value, (list, tuple)):
        return "array(" + ", ".join(literal(v) for v in value) + ")"
    text = str(value).replace("\\", "\\\\").replace("'", "\\'")
    return f"'{text}'"
