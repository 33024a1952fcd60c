"""Filters on values, against the semantics of the public jq manual."""

import json

import pytest

from docforge.plans.interpreter import evaluate
from docforge.plans.parser import FilterError, parse
from docforge.plans.values import Raised, dump

CASES = [
    (".", '{"a":1}', ['{"a":1}']),
    (".a.b", '{"a":{"b":2}}', ["2"]),
    (".[1.7], .[-1], .[9]", "[1,2,3]", ["2", "3", "null"]),
    (".[1:], .[:-1], .[1:2]", "[1,2,3]", ["[2,3]", "[1,2]", "[2]"]),
    ('.["a","b"]', '{"a":1,"b":2}', ["1", "2"]),
    (".[] | select(.x > 1) | .y", '[{"x":1,"y":"p"},{"x":2,"y":"q"}]', ['"q"']),
    ("{a: (1,2), b}", '{"b":3}', ['{"a":1,"b":3}', '{"a":2,"b":3}']),
    ("[..]", "[[1]]", ["[[[1]],[1],1]"]),
    (".a // 3, (false, null, 1) // 2", "{}", ["3", "1"]),
    ("if . > 1 then \"b\" elif . == 1 then \"o\" else \"s\" end", "1", ['"o"']),
    ("[.[] | tostring]", '[1,"1",[1],1.5,null]', ['["1","1","[1]","1.5","null"]']),
    ("sort", '[{"a":1},[1],"s",3,true,false,null]', ['[null,false,true,3,"s",[1],{"a":1}]']),
    ("group_by(.k) | map(length)", '[{"k":2},{"k":1},{"k":2}]', ["[1,2]"]),
    ("unique_by(.k)", '[{"k":1,"v":1},{"k":1,"v":2}]', ['[{"k":1,"v":1}]']),
    ("[min_by(.v), max_by(.v)]", '[{"v":1,"i":0},{"v":2,"i":1},{"v":2,"i":2}]', ['[{"v":1,"i":0},{"v":2,"i":2}]']),
    ("reduce .[] as $x (0; . + $x)", "[1,2,3]", ["6"]),
    ("[foreach .[] as $x (0; . + $x; [$x, .])]", "[1,2]", ["[[1,1],[2,3]]"]),
    ("[limit(2; range(10))], [first(range(5))], [skip(3; range(5))], nth(2; range(9))", "null", ["[0,1]", "[0]", "[3,4]", "2"]),
    ("to_entries, with_entries(.value += 1), (to_entries | from_entries)", '{"a":1}', ['[{"key":"a","value":1}]', '{"a":2}', '{"a":1}']),
    ("[paths], [leaf_paths]", '{"a":[1]}', ['[["a"],["a",0]]', '[["a",0]]']),
    ("del(.[1,2])", "[1,2,3,4]", ["[1,4]"]),
    (".a |= . + 1, .b = 5, .a += 2, .c //= 9", '{"a":1}', ['{"a":2}', '{"a":1,"b":5}', '{"a":3}', '{"a":1,"c":9}']),
    ("(.[] | select(. > 1)) |= empty", "[1,2,3]", ["[1]"]),
    ("[.[] as [$a, {b: $c}] | $a + $c]", '[[1,{"b":2}]]', ["[3]"]),
    (".[] as [$a] ?// $a | [$a]", "[[3],4]", ["[3]", "[4]"]),
    ("def f(g; $x): g + $x; f(. * 2; 3)", "4", ["11"]),
    ("def fac: if . <= 1 then 1 else . * (. - 1 | fac) end; fac", "5", ["120"]),
    ("[label $out | .[] | if . > 2 then break $out else . end]", "[1,2,3,1]", ["[1,2]"]),
    ("try error(\"x\") catch .", "null", ['"x"']),
    ("[.[] | try tonumber catch \"bad\"]", '["1","a"]', ['[1,"bad"]']),
    ('"a\\(1 + 1)b", @base64 "x\\(.)", @json "v\\(.)"', '"q"', ['"a2b"', '"xcQ=="', '"v\\"q\\""']),
    ("@csv, @tsv, @sh", '[1,"a\\"b",null]', ['"1,\\"a\\"\\"b\\","', '"1\\ta\\"b\\t"', '"1 \'a\\"b\' null"']),
    ("@uri, @html", '"é <&\'"', ['"%C3%A9%20%3C%26%27"', '"é &lt;&amp;&#39;"']),
    ('[match("(?<x>b)(c)?"; "g") | .offset, .captures[0].name]', '"abcb"', ['[1,"x",3,"x"]']),
    ('test("B"; "i"), [scan("[a-c]")], sub("(?<l>.)"; "\\(.l)!"), gsub("b"; "x"), [splits("b")]', '"abc"', ["true", '["a","b","c"]', '"a!bc"', '"axc"', '["a","c"]']),
    ('capture("(?<y>\\\\d+)-(?<m>\\\\d+)")', '"2020-05"', ['{"y":"2020","m":"05"}']),
    ("[.[] | floor, ceil, round, sqrt]", "[4.5]", ["[4,5,5,2.1213203435596424]"]),
    ("-5 % 3, 5 % -3, 7 / 2, 6 / 2", "null", ["-2", "2", "3.5", "3"]),
    ("nan < nan, nan == nan, ([nan, 1] | sort), [nan > nan, nan >= nan, nan <= 1, 1 >= nan]", "null", ["true", "false", "[null,1]", "[false,false,true,true]"]),
    ("gmtime, (gmtime | mktime), todate", "1425599621", ["[2015,2,5,23,53,41,4,63]", "1425599621", '"2015-03-05T23:53:41Z"']),
    ('fromdate, strptime("%Y-%m-%dT%H:%M:%SZ")', '"2015-03-05T23:51:47Z"', ["1425599507", "[2015,2,5,23,51,47,4,63]"]),
    ("[tostream], fromstream(tostream)", '{"a":[1,2]}', ['[[["a",0],1],[["a",1],2],[["a",1]],[["a"]]]', '{"a":[1,2]}']),
    ("[1|truncate_stream([[0],1],[[1,0],2],[[1,0]],[[1]])]", "null", ["[[[0],2],[[0]]]"]),
    ("[combinations]", "[[1,2],[3,4]]", ["[[1,3],[1,4],[2,3],[2,4]]"]),
    ("transpose, flatten, flatten(1)", "[[1],[2,[3]]]", ["[[1,2],[null,[3]]]", "[1,2,3]", "[1,2,[3]]"]),
    ("INDEX(.id), IN(.[]; {id:1})", '[{"id":1}]', ['{"1":{"id":1}}', "true"]),
    ("walk(if type == \"number\" then . + 1 else . end)", "[1,[2]]", ["[2,[3]]"]),
    ("[recurse(if . < 3 then . + 1 else empty end)], [while(. < 3; . + 1)], until(. > 4; . + 1), [limit(3; repeat(. * 2))]", "1", ["[1,2,3]", "[1,2]", "5", "[1,2,4]"]),
    ("contains({a:[\"x\"]}), inside({a:[\"xy\"],b:1})", '{"a":["xy"]}', ["true", "true"]),
    ("indices(\", \"), index(\"b\"), rindex(\"b\")", '"a, b, ab"', ["[1,4]", "3", "7"]),
    ("explode | implode", '"é🎉"', ['"é🎉"']),
    ("ltrimstr(\"a\"), rtrimstr(\"c\"), startswith(\"a\"), ascii_upcase, split(\"b\"), (. / \"b\" | join(\"-\"))", '"abc"', ['"bc"', '"ab"', "true", '"ABC"', '["a","c"]', '"a-c"']),
    ("bsearch(2), bsearch(0)", "[1,2,3]", ["1", "-1"]),
    ("{a:{b:1}} * {a:{c:2}}, ([1,2,1] - [1]), \"ab\" * 2", "null", ['{"a":{"b":1,"c":2}}', "[2]", '"abab"']),
    ("pick(.a.b), getpath([\"a\",\"b\"]), ([paths(type == \"number\")])", '{"a":{"b":1,"c":2}}', ['{"a":{"b":1}}', "1", '[["a","b"],["a","c"]]']),
    ("any, all, isempty(.[]), (map(not))", "[true,false]", ["true", "false", "false", "[false,true]"]),
    ("[.[]?], .a?", "3", ["[]"]),
    ("$x + 1", "null", ["3"]),
    ("[splits(\", *\"; null)], ascii_downcase, utf8bytelength, length", '"a, B"', ['["a","B"]', '"a, b"', "4", "4"]),
    ("tojson, (tojson | fromjson)", '[1,{"a":null}]', ['"[1,{\\"a\\":null}]"', '[1,{"a":null}]']),
]


@pytest.mark.parametrize(("program", "value", "expected"), CASES)
def test_filter(program, value, expected):
    assert [dump(x) for x in evaluate(program, json.loads(value), {"x": 2})] == expected


@pytest.mark.parametrize("program", ["1 +", "{(1)}", "if 1 then 2", ". as x | 1", "[1", '"a'])
def test_parse_errors(program):
    with pytest.raises((FilterError, IndexError)):
        parse(program)


@pytest.mark.parametrize(("program", "value", "message"), [(".a", "[1]", 'Cannot index array with string "a"'), (".[0]", "{}", "Cannot index object with number"), (".[]", "3", "Cannot iterate over number (3)"), ("1 / 0", "null", "number (1) and number (0) cannot be divided because the divisor is zero"), ("{} + 1", "null", "object ({}) and number (1) cannot be added"), ("keys", "1", "number (1) has no keys")])
def test_errors(program, value, message):
    with pytest.raises(Raised) as e:
        list(evaluate(program, json.loads(value)))
    assert e.value.value == message


def test_yq_mode():
    assert list(evaluate("2.0 == 2", None, mode="yq")) == [False]
    assert list(evaluate("keys", {"b": 1, "a": 2}, mode="yq")) == [["b", "a"]]
    assert list(evaluate('pick(["a"])', {"b": 1, "a": 2}, mode="yq")) == [{"a": 2}]
    assert list(evaluate('omit(["a"])', {"b": 1, "a": 2}, mode="yq")) == [{"b": 1}]
