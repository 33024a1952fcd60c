"""The plan of a filter and the interpreter must give the same values, on rows with nulls, empty and unusual ones."""

import json
import math

import pytest

from docforge.plans.engine import NotTyped, compile_filter, documents, interpret
from docforge.plans.values import dump

SCHEMA = "k int, i int, n long, d double, s string, t string, b boolean, a array<int>, w array<string>, m map<string,int>, o struct<x:int,y:string>, aa array<array<int>>"
ROWS = [
    (1, 5, 7, 1.5, "abc", "b", True, [3, 1, None, 2], ["x", None, "é"], {"p": 1, "q": None}, (1, "u"), [[1], [2, 3]]),
    (2, -5, -7, -2.5, "", "", False, [], [], {}, (None, None), []),
    (3, 0, 0, 0.0, " a b ", " ", None, [1, 1], ["b", "a", "b"], {"z": 3}, (4, ""), [[]]),
    (4, 2**31 - 1, 2**40, 1e10, "日本 🎉", "本", True, [9], ["aa"], {"p": 9}, (7, "é"), [[5], None]),
]
#: Filters that raise no error on these rows.
SAFE = [
    ".i", ".missing", ".o.x", ".o.y", ".o.z", ".m.p", ".a[0]", ".a[-1]", ".a[7]", ".w[1]", ".a[1:]", ".a[:-1]", ".a[1:2]", ".s[1:]", ".s[:2]", ".s[-2:]",
    "null + .i", ".i + null", ".i + .n", ".s + .t", ".a + .a", ".i - .n", ".i * 2", ".n / 2", ".i % 3", "-.i % 3", "-.d", ".n - 1",
    ".i == 5", ".i != 5", ".i < 3", ".i <= 0", ".i > .n", ".i >= .n", ".s < .t", ".b == null", "null < .i", ".b < true", ".d > 0", ".d <= 1.5", ".missing == .b", ".s == \"\"",
    ".b and .i > 0", ".b or false", ".b | not", ".i | not", ".missing // 3", ".b // true", ".s // \"none\"", "if .b then 1 else 2 end", "if .missing then \"x\" else .s end", "if .i > 0 then .i elif .i == 0 then 10 else 20 end",
    "{a: .i, b: {c: .s}}", "{a: .i, a: .n}", "\"<\\(.i)|\\(.s)|\\(.b)|\\(.missing)>\"", "[.i, .n, 3]", "[.s, null]",
    ".s | length", ".a | length", ".m | length", ".o | length", ".i | length", ".missing | length", ".d | length", ". | length",
    ".i | floor", ".d | floor", ".d | ceil", ".d | round", ".d | trunc", ".d | fabs", ".i | tostring", ".s | tostring", ".b | tostring", ".missing | tostring",
    ".s | utf8bytelength", ".s | ascii_upcase", ".s | trim", ".s | ltrim", ".s | rtrim", ".s | explode", ".a | reverse", ".a | sort", ".w | sort", ".a | unique", ".w | unique", ".a | min", ".a | max", ".w | min", ".w | max",
    ".a | add", ".w | add", ".a | first", ".w | last", ".m | keys", ".m | to_entries", ".a | any", ".a | all", ".i | type", ".b | type", ".missing | type", ".o | type", ".i | isnumber", ".b | isboolean", ".missing | isnull", ".s | isstring",
    ".s | startswith(\"a\")", ".s | endswith(\"c\")", ".s | contains(\"b\")", ".s | split(\" \")", ".s | split(\"\")", ".s / .t", ".w | join(\"-\")", ".a | join(\",\")", ".m | has(\"p\")", ".a | has(1)", ".s | ltrimstr(\"a\")", ".s | rtrimstr(\"c\")", ".s | ltrimstr(\"\")",
    ".s | test(\"b\")", ".s | test(\"^[a-c]+\")", ".a | map(. == null)", ".w | map(length)", ".a | map(select(. != null))", ".a | map(select(. > 1) | . + 1)", "[.a[] | . == 1]", ".a | any(. == 1)", ".a | all(. == 1)",
    ".i as $x | [$x, $x + 1]", ".a - [1]", ".w - [\"b\"]", ".aa | flatten", "pow(.o.x // 2; 2) | floor", ".i | todate", ".i = 3 | .i", ".i |= . + 1 | .i", ".n += 1 | .n", ".b //= true | .b", "del(.i) | .i", "(.i, .n)", ".a[]", ".w | length > 1 and (.[0] == \"b\")",
]
#: Filters that the interpreter fails on for each row: the plan must fail too.
FAILING = [".missing - 1", ".i / 0", ".i % 0", ".missing | ascii_downcase", ".missing | sort", ".missing | map(.)", ".missing | floor", ".missing | startswith(\"a\")", "error(\"x\")"]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def plain(v):
    """A value from a plan or JSON: whole floating point numbers are the same number."""
    if isinstance(v, float):
        return None if math.isnan(v) else int(v) if v == int(v) and abs(v) < 2**53 else v
    if isinstance(v, dict):
        return {k: plain(x) for k, x in v.items()}
    if hasattr(v, "asDict"):
        return {k: plain(x) for k, x in v.asDict().items()}
    return [plain(x) for x in v] if isinstance(v, list) else v


def test_both_ways(df):
    """One job for each way: all filters that have a plan, and the same by the interpreter."""
    typed = []
    for p in SAFE:
        try:
            typed.append((p, compile_filter(df, ".[] | " + p)))
        except NotTyped:
            continue
    assert len(typed) > 0.9 * len(SAFE), sorted(set(SAFE) - {p for p, _ in typed})
    wrong = []
    for p, plan in typed:
        got = sorted(json.dumps(plain(r.asDict() if plan.columns != ["value"] else r.value), sort_keys=True) for r in plan.collect())
        want = sorted(json.dumps(plain(json.loads(r.value)), sort_keys=True) if r.error is None else r.error for r in interpret(documents(df), p).collect())
        if got != want:
            wrong.append((p, got, want))
    assert not wrong, wrong


@pytest.mark.parametrize("program", FAILING)
def test_errors_both_ways(df, program):
    assert all(r.error for r in interpret(documents(df), program).collect())
    try:
        plan = compile_filter(df, ".[] | " + program)
    except NotTyped:
        return
    with pytest.raises(Exception):  # noqa: B017  the job fails, whatever Spark makes of it
        plan.collect()


def test_nan_order(spark):
    df = spark.createDataFrame([(1, float("nan"), 1.0), (2, 1.0, float("nan")), (3, float("nan"), float("nan")), (4, 2.0, None), (5, None, 2.0)], "k int, x double, y double")
    want = {1: (True, True, False, False, False), 2: (False, False, True, True, False), 3: (True, True, False, False, False), 4: (False, False, True, True, False), 5: (True, True, False, False, False)}
    got = compile_filter(df, ".[] | {k, a: (.x < .y), b: (.x <= .y), c: (.x > .y), d: (.x >= .y), e: (.x == .y)}").collect()
    assert {r.k: (r.a, r.b, r.c, r.d, r.e) for r in got} == want
    from docforge.plans.interpreter import evaluate

    values = {1: ("nan", "1"), 2: ("1", "nan"), 3: ("nan", "nan"), 4: ("2", "null"), 5: ("null", "2")}
    for k, (x, y) in values.items():
        assert tuple(next(evaluate(f"{x} {op} {y}", None)) for op in ("<", "<=", ">", ">=", "==")) == want[k], (k, dump(want[k][0]))
