"""Values of the filter language in Python: order, arithmetic, text forms and paths."""

from __future__ import annotations

import json
import math
from decimal import Decimal
from functools import cmp_to_key
from typing import Any


class Raised(Exception):
    """An error value of the language."""

    def __init__(self, value: Any) -> None:
        super().__init__(value)
        self.value = value


class Break(Exception):
    def __init__(self, label: object) -> None:
        self.label = label


class Spelled(float):
    """A number that remembers its digits, as a decimal number, as long as nothing is computed from it."""

    spelling: str

    def __new__(cls, text: str, exact: bool = False) -> Spelled:
        out = super().__new__(cls, text)
        out.spelling = text if exact else str(Decimal(text))
        return out

    def __reduce__(self) -> tuple:
        return Spelled, (self.spelling, True)


def _integer(text: str) -> float:
    return int(text) if text == str(int(text)) else Spelled(text)


def load(text: str, exact: bool = False) -> Any:
    """JSON text as a value. Fractions and exponents keep their digits; with exact, their very spelling."""
    return json.loads(text, parse_float=(lambda t: Spelled(t, True)) if exact else Spelled, parse_int=_integer if "-0" in text else None)


KINDS = {type(None): "null", bool: "boolean", int: "number", float: "number", Spelled: "number", str: "string", list: "array", dict: "object"}


def kind(v: Any) -> str:
    return KINDS[type(v)]


RANK = {"null": 0, "boolean": 1, "number": 3, "string": 4, "array": 5, "object": 6}


def truthy(v: Any) -> bool:
    return v is not None and v is not False


def compare(a: Any, b: Any) -> int:
    """Negative, 0 or positive in the total order null < false < true < numbers < strings < arrays < objects; NaN below all numbers."""
    x, y = kind(a), kind(b)
    if x != y:
        return RANK[x] - RANK[y]
    if x == "number":
        return -1 if a != a or a < b else 1 if b != b or a > b else 0
    if x == "boolean" or x == "string":
        return (a > b) - (a < b)
    if x == "array":
        return next((c for p, q in zip(a, b, strict=False) if (c := compare(p, q))), len(a) - len(b))
    if x == "object":
        p, q = sorted(a), sorted(b)
        return compare(p, q) or next((c for k in p if (c := compare(a[k], b[k]))), 0)
    return 0


def equal(a: Any, b: Any) -> bool:
    return compare(a, b) == 0


key = cmp_to_key(compare)


def number_text(v: float) -> str:
    if isinstance(v, Spelled):
        return v.spelling
    if isinstance(v, int):
        return str(v)
    if v != v:
        return "null"
    if math.isinf(v):
        return "1.7976931348623157e+308" if v > 0 else "-1.7976931348623157e+308"
    if v == int(v) and abs(v) < 1e17:
        return "-0" if v == 0 and math.copysign(1, v) < 0 else str(int(v))
    text = repr(v)
    if "e" in text:
        mantissa, exponent = text.split("e")
        return f"{mantissa}e{exponent[0] if exponent[0] in '+-' else '+'}{exponent.lstrip('+-').zfill(2)}"
    return text


def dump(v: Any, sort: bool = False, indent: int | str | None = None, ascii_only: bool = False, level: int = 0) -> str:
    """JSON text; compact without an indent."""
    if isinstance(v, bool) or v is None:
        return json.dumps(v)
    if isinstance(v, (int, float)):
        return number_text(v)
    if isinstance(v, str):
        return json.dumps(v, ensure_ascii=ascii_only).replace("\x7f", "\\u007f")
    opened, closed = "[]" if isinstance(v, list) else "{}"
    items = [dump(x, sort, indent, ascii_only, level + 1) for x in v] if isinstance(v, list) else [
        json.dumps(k, ensure_ascii=ascii_only).replace("\x7f", "\\u007f") + (":" if indent is None else ": ") + dump(v[k], sort, indent, ascii_only, level + 1) for k in (sorted(v) if sort else v)
    ]
    if not items or indent is None:
        return opened + ",".join(items) + closed
    step = indent if isinstance(indent, str) else " " * indent
    pad = "\n" + step * (level + 1)
    return opened + pad + ("," + pad).join(items) + "\n" + step * level + closed


def text(v: Any) -> str:
    return v if isinstance(v, str) else dump(v)


def short(v: Any) -> str:
    """A value as error messages show it."""
    t = dump(v).encode("utf-8", "surrogatepass")
    return (t if len(t) < 15 else t[:11]).decode("utf-8", "ignore") + ("..." if len(t) > 14 else "")


def fault(message: str) -> Raised:
    return Raised(message)


def merge(a: dict, b: dict) -> dict:
    out = dict(a)
    for k, v in b.items():
        out[k] = merge(out[k], v) if isinstance(out.get(k), dict) and isinstance(v, dict) else v
    return out


def arithmetic(op: str, a: Any, b: Any) -> Any:  # noqa: C901, PLR0911, PLR0912
    x, y = kind(a), kind(b)
    both = x if x == y else None
    if op == "+":
        if a is None or b is None:
            return b if a is None else a
        if both == "object":
            return {**a, **b}
        if both in ("number", "string", "array"):
            return _sized(a + b)
        raise fault(f"{x} ({short(a)}) and {y} ({short(b)}) cannot be added")
    if op == "-":
        if both == "number":
            return _sized(a - b)
        if both == "array":
            return [v for v in a if not any(equal(v, w) for w in b)]
        raise fault(f"{x} ({short(a)}) and {y} ({short(b)}) cannot be subtracted")
    if op == "*":
        if both == "number":
            return _sized(a * b)
        if {x, y} == {"string", "number"}:
            s, n = (a, b) if x == "string" else (b, a)
            return s * max(1, math.ceil(n)) if n > 0 and n == n else None
        if both == "object":
            return merge(a, b)
        raise fault(f"{x} ({short(a)}) and {y} ({short(b)}) cannot be multiplied")
    if op == "/":
        if both == "number":
            if b == 0:
                raise fault(f"{x} ({short(a)}) and {y} ({short(b)}) cannot be divided because the divisor is zero")
            q = a / b
            return int(q) if isinstance(a, int) and isinstance(b, int) and a % b == 0 else q
        if both == "string":
            return list(a) if b == "" else a.split(b) if a else []
        raise fault(f"{x} ({short(a)}) and {y} ({short(b)}) cannot be divided")
    if both == "number":
        if a != a or b != b:
            return math.nan
        m, n = _whole(a), _whole(b)
        if n == 0:
            raise fault(f"{x} ({short(a)}) and {y} ({short(b)}) cannot be divided (remainder) because the divisor is zero")
        return int(math.copysign(abs(m) % abs(n), m)) if m % n else 0
    raise fault(f"{x} ({short(a)}) and {y} ({short(b)}) cannot be divided (remainder)")


def _whole(v: float) -> int:
    return int(max(-(2**63), min(2**63 - 1, v))) if not (isinstance(v, float) and math.isinf(v)) else (2**63 - 1 if v > 0 else -(2**63))


def _sized(v: Any) -> Any:
    return float(v) if isinstance(v, int) and not isinstance(v, bool) and not -(2**63) <= v < 2**63 else v


def index(v: Any, k: Any) -> Any:  # noqa: PLR0911
    if isinstance(k, dict) and (v is None or isinstance(v, (list, str))):
        return cut(v, *slice_of(k))
    if v is None and (k is None or isinstance(k, (str, int, float))) and not isinstance(k, bool):
        return None
    if isinstance(v, dict) and isinstance(k, str):
        return v.get(k)
    if isinstance(v, list) and isinstance(k, (int, float)) and not isinstance(k, bool):
        if k != k or math.isinf(k):
            return None
        k = math.floor(k)
        return v[k] if -len(v) <= k < len(v) else None
    if isinstance(v, list) and isinstance(k, list):
        return [i for i in range(len(v) - len(k) + 1) if k and equal(v[i : i + len(k)], k)]
    raise no_index(v, k)


def no_index(v: Any, k: Any) -> Raised:
    return fault(f"Cannot index {kind(v)} with " + (f'string "{k}"' if isinstance(k, str) else kind(k)))


def slice_of(k: dict) -> tuple[Any, Any]:
    """The bounds of a slice as a path has it."""
    if not ("start" in k or "end" in k):
        raise fault("Array/string slice indices must be integers")
    return k.get("start"), k.get("end")


def bounds(size: int, lo: Any, hi: Any) -> tuple[int, int]:
    for b in (lo, hi):
        if b is not None and (isinstance(b, bool) or not isinstance(b, (int, float))):
            raise fault("Start and end indices of an array slice must be numbers")
    a = 0 if lo is None else math.floor(lo)
    b = size if hi is None else math.ceil(hi)
    a, b = (a + size if a < 0 else a), (b + size if b < 0 else b)
    a = min(max(a, 0), size)
    return a, max(a, min(max(b, 0), size))


def cut(v: Any, lo: Any, hi: Any) -> Any:
    if v is None:
        return None
    if not isinstance(v, (list, str)):
        raise fault(f"Cannot index {kind(v)} with object")
    a, b = bounds(len(v), lo, hi)
    return v[a:b]


def items(v: Any) -> list[tuple[Any, Any]]:
    if isinstance(v, list):
        return list(enumerate(v))
    if isinstance(v, dict):
        return list(v.items())
    raise fault(f"Cannot iterate over {kind(v)} ({short(v)})")


def get_path(v: Any, path: list) -> Any:
    for k in path:
        if v is None:
            return None
        v = index(v, k)
    return v


def set_path(v: Any, path: list, new: Any) -> Any:
    if not path:
        return new
    k, rest = path[0], path[1:]
    if isinstance(k, str):
        if v is not None and not isinstance(v, dict):
            raise no_index(v, k)
        out = dict(v or {})
        out[k] = set_path(out.get(k), rest, new)
        return out
    if isinstance(k, dict):
        if isinstance(v, str):
            raise fault("Cannot update string slices")
        if v is not None and not isinstance(v, list):
            raise no_index(v, k)
        out = list(v or [])
        a, b = bounds(len(out), *slice_of(k))
        part = set_path(out[a:b], rest, new)
        if not isinstance(part, list):
            raise fault("A slice of an array can only be assigned another array")
        return out[:a] + part + out[b:]
    if isinstance(k, bool) or not isinstance(k, (int, float)):
        raise fault(f"Invalid path component {kind(k)}")
    if v is not None and not isinstance(v, list):
        raise no_index(v, k)
    if k != k:
        raise fault("Cannot set array element at NaN index")
    out, k = list(v or []), math.floor(k)
    if k < 0:
        k += len(out)
        if k < 0:
            raise fault("Out of bounds negative array index")
    out += [None] * (k + 1 - len(out))
    out[k] = set_path(out[k], rest, new)
    return out


def delete_paths(v: Any, paths: list[list]) -> Any:
    """v without what the paths lead to, each of them in v as it was."""
    if any(not p for p in paths):
        return None
    below: dict[str, tuple[Any, list[list]]] = {}
    here: set = set()
    for path in paths:
        if (path := _unsliced(v, path)) is None:
            continue
        for k in _members(v, path[0]):
            if len(path) == 1:
                here.add(k)
            else:
                below.setdefault(repr(k), (k, []))[1].append(path[1:])
    if v is None or not (here or below):
        return v
    out = dict(v) if isinstance(v, dict) else list(v)
    for k, rest in below.values():
        if k not in here:
            out[k] = delete_paths(out[k], rest)
    if isinstance(out, dict):
        return {k: x for k, x in out.items() if k not in here}
    return [x for i, x in enumerate(out) if i not in here]


def _unsliced(v: Any, path: list) -> list | None:
    """A path into a slice of an array as one into the array; None if it leads beyond the slice."""
    while len(path) > 1 and isinstance(path[0], dict) and isinstance(v, list):
        a, b = bounds(len(v), *slice_of(path[0]))
        k = path[1]
        if isinstance(k, dict):
            low, high = bounds(b - a, *slice_of(k))
            path = [{"start": a + low, "end": a + high}, *path[2:]]
        elif isinstance(k, (int, float)) and not isinstance(k, bool):
            k = math.floor(k) + (b - a if k < 0 else 0)
            if not 0 <= k < b - a:
                return None
            path = [a + k, *path[2:]]
        else:
            raise no_index(v, k)
    return path


def _members(v: Any, k: Any) -> list:
    """The keys or places that a path's component stands for in a value; none where there is nothing."""
    if v is None:
        return []
    if isinstance(k, str):
        if not isinstance(v, dict):
            raise fault(f"Cannot delete field at object index of {kind(v)}" if isinstance(v, list) else f"Cannot delete fields from {kind(v)}" if isinstance(v, str) else f'Cannot index {kind(v)} with string "{k}"')
        return [k] if k in v else []
    if isinstance(k, dict):
        if isinstance(v, dict):
            raise fault("Cannot delete object field of object")
        if not isinstance(v, list):
            raise fault(f"Cannot delete fields from {kind(v)}")
        return list(range(*bounds(len(v), *slice_of(k))))
    if not isinstance(v, list) or isinstance(k, bool) or not isinstance(k, (int, float)):
        raise fault(f"Cannot delete field at array index of {kind(v)}")
    k = math.floor(k) + (len(v) if k < 0 else 0)
    return [k] if 0 <= k < len(v) else []
