"""Seeded synthetic corpora: JSON, YAML, delimited and plain texts of named patterns, a row each, the same for the same seed on any cluster."""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..plans import values as V
from ..sources import yaml12

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()
GREEK, CJK, EMOJI = "αβγδεжзийκ", "日本語中文字漢", "🎉🚀🌍💡"


def _word(r: random.Random) -> str:
    return r.choice(WORDS)


def _user(r: random.Random) -> dict:
    return {"id": r.randrange(10**6), "name": f"{_word(r)} {_word(r)}", "email": f"{_word(r)}{r.randrange(99)}@example.org", "age": r.randrange(18, 90), "active": r.random() < 0.5}


def _nested(r: random.Random, depth: int) -> object:
    return {"level": depth, "child": _nested(r, depth - 1)} if depth else _word(r)


def _mixed(r: random.Random) -> object:
    return r.choice([None, True, False, r.randrange(1000), r.random(), _word(r), [r.randrange(9)], {_word(r): r.randrange(9)}])


#: Values of each JSON pattern.
JSON: dict[str, Callable[[random.Random], object]] = {
    "comprehensive": lambda r: {"user": _user(r), "tags": [_word(r) for _ in range(3)], "values": [_mixed(r) for _ in range(4)], "nested": _nested(r, 3)},
    "users": lambda r: _user(r),
    "nested": lambda r: _nested(r, 12),
    "arrays": lambda r: [[r.randrange(100) for _ in range(5)] for _ in range(4)],
    "mixed": lambda r: [_mixed(r) for _ in range(8)],
    "strings": lambda r: [r.choice(['plain', 'with "quotes"', "back\\slash", "line\nfeed", "tab\t", _word(r)]) for _ in range(6)],
    "numbers": lambda r: [r.randrange(-(10**9), 10**9), r.random(), r.random() * 10 ** r.randrange(-9, 9), 0, -1],
    "literals": lambda r: [r.choice([True, False, None]) for _ in range(10)],
    "unicode": lambda r: {"greek": r.choice(GREEK) * 3, "cjk": r.choice(CJK) * 2, "emoji": r.choice(EMOJI)},
    "pathological": lambda r: _wrapped(r.randrange(20, 60)),
    "pretty": lambda r: {"a": _user(r), "b": [_word(r), _word(r)]},
    "wide": lambda r: {f"field_{k}": r.randrange(1000) for k in range(60)},
}


def _wrapped(depth: int) -> object:
    out: object = []
    for _ in range(depth):
        out = [out]
    return out


#: Texts of the YAML patterns that aren't another pattern's values.
YAML: dict[str, Callable[[random.Random], str]] = {
    "config": lambda r: f"server:\n  host: {_word(r)}.example.org\n  port: {r.randrange(1024, 65535)}\ndebug: {r.choice(['true', 'false'])}",
    "sequences": lambda r: "\n".join(f"- {_word(r)}" for _ in range(5)),
    "navigation": lambda r: yaml12.emit({"users": [_user(r) for _ in range(3)]}),
    "flow": lambda r: f"{{a: [{r.randrange(9)}, {r.randrange(9)}], b: {{c: {_word(r)}}}}}",
    "anchors": lambda r: f"base: &base\n  a: {r.randrange(9)}\n  b: {_word(r)}\nitem:\n  <<: *base\n  b: own",
    "block-scalars": lambda r: f"literal: |\n  {_word(r)}\n  {_word(r)}\nfolded: >\n  {_word(r)}\n  {_word(r)}",
    "explicit-keys": lambda r: f"? {_word(r)}\n: {r.randrange(9)}\n? [a, b]\n: {_word(r)}",
    "multi-doc": lambda r: "\n---\n".join(f"n: {k}\nw: {_word(r)}" for k in range(3)),
    "empty-items": lambda r: "- \n- \n-",
    "half-empty-items": lambda r: f"- {_word(r)}\n-\n- {r.randrange(9)}\n-",
}
FROM_JSON = ("comprehensive", "users", "nested", "mixed", "strings", "numbers", "unicode", "pathological")

#: Rows of the delimited patterns.
DSV: dict[str, Callable[[random.Random], list[str]]] = {
    "tabular": lambda r: [str(r.randrange(1000)) for _ in range(6)],
    "users": lambda r: [str(x) for x in _user(r).values()],
    "numeric": lambda r: [repr(r.random()) for _ in range(5)],
    "strings": lambda r: [_word(r) for _ in range(5)],
    "quoted": lambda r: [f'say "{_word(r)}"', f"{_word(r)}, {_word(r)}"],
    "multiline": lambda r: [f"{_word(r)}\n{_word(r)}", _word(r)],
    "wide": lambda r: [str(r.randrange(9)) for _ in range(80)],
    "long": lambda r: [" ".join(_word(r) for _ in range(60))],
    "mixed": lambda r: [V.text(_mixed(r)) for _ in range(5)],
    "pathological": lambda r: ['"' * r.randrange(1, 9), "," * r.randrange(1, 9), "\n"],
}

TEXT: dict[str, Callable[[random.Random], str]] = {
    "ascii": lambda r: " ".join(_word(r) for _ in range(12)),
    "latin": lambda r: " ".join(_word(r).replace("a", "à").replace("e", "é") for _ in range(12)),
    "greek-cyrillic": lambda r: "".join(r.choice(GREEK + " ") for _ in range(60)),
    "cjk": lambda r: "".join(r.choice(CJK) for _ in range(40)),
    "emoji": lambda r: "".join(r.choice(EMOJI) for _ in range(20)),
    "mixed": lambda r: "".join(r.choice("ab é" + GREEK + CJK + EMOJI) for _ in range(60)),
    "all-lengths": lambda r: "".join(r.choice(c) for c in ("a", "é", "日", "🎉")) * 8,
    "log-file": lambda r: f"2024-01-{r.randrange(1, 29):02d}T{r.randrange(24):02d}:00:00Z {r.choice(['INFO', 'WARN', 'ERROR'])} {_word(r)} {r.randrange(9999)}",
    "source-code": lambda r: f"def {_word(r)}({_word(r)}):\n    return {r.randrange(99)}\n",
    "json-like": lambda r: V.dump(_user(r)),
    "pathological": lambda r: "\x7f\u0080߿ࠀ￿\U00010000" * r.randrange(1, 5),
}


def field(text: str, sep: str = ",", quote: str = '"') -> str:
    """A field as delimited text spells it."""
    return quote + text.replace(quote, quote * 2) + quote if any(c in text for c in (sep, quote, "\n")) else text


def _maker(kind: str, pattern: str) -> Callable[[random.Random], str]:
    match kind:
        case "json" if pattern in JSON:
            return lambda r: V.dump(JSON[pattern](r), indent=2 if pattern == "pretty" else None)
        case "yaml" if pattern in YAML:
            return YAML[pattern]
        case "yaml" if pattern in FROM_JSON:
            return lambda r: yaml12.emit(JSON[pattern](r))
        case "dsv" if pattern in DSV:
            return lambda r: ",".join(map(field, DSV[pattern](r)))
        case "text" if pattern in TEXT:
            return TEXT[pattern]
    raise ValueError(f"no pattern {pattern} of {kind}")


def patterns(kind: str) -> list[str]:
    return {"json": [*JSON], "yaml": [*YAML, *FROM_JSON], "dsv": [*DSV], "text": [*TEXT]}[kind]


def generate(spark: SparkSession, kind: str, pattern: str, rows: int, seed: int = 0) -> DataFrame:
    """id and value: `rows` texts of a pattern of `json`, `yaml`, `dsv` or `text`; each depends on the seed and its id alone."""
    make = _maker(kind, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("id").to_pylist()
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([make(random.Random(f"{seed}/{pattern}/{k}")) for k in ids], pa.string())], ["id", "value"])

    return spark.range(rows).mapInArrow(run, "id long, value string")
