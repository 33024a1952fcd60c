"""The engine's registered queries: filters over the shared tables, each with independent SQL.

`compiled` queries are filters that become plans over tables, `interpreted` ones run on each row as a JSON document.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import generators as G
from ..operators import bits as B
from ..sources import readers as R
from ..sources import writers as W
from ..sources.scratch import scratch
from . import spans as P
from .engine import compile_filter, documents, exit_status, interpret, interpret_stream, slurp, typed
from .nodes import leaf_events, node_table

FLAGSHIP = "group_by_agg"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: The filter of each query, for the tests that evaluate it both ways.
PROGRAMS: dict[str, tuple[str, str]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def add(name: str, sql: str | None, plan: Callable[[Callable[[str], DataFrame]], DataFrame]) -> None:
    assert name not in QUERIES, name
    QUERIES[name] = lambda spark, sf_dir: plan(lambda t: table(spark, sf_dir, t))
    if sql:
        ORACLE_SQL[name] = sql


def compiled(name: str, source: str, program: str, sql: str, *others: str) -> None:
    """A filter on a table as a plan; $name is another table."""
    add(name, sql, lambda t: compile_filter(t(source), program, **{o: t(o) for o in others}))
    PROGRAMS[name] = (source, program)


def interpreted(name: str, source: str, columns: str, program: str, schema: str, sql: str, mode: str = "jq") -> None:
    """A filter whose outputs are objects, on each row's columns as a document."""
    add(name, sql, lambda t: typed(interpret(documents(t(source).selectExpr(*columns.split("; "))), program, mode=mode), schema))


def derived(name: str, source: str, columns: str, program: str, sql: str) -> None:
    """A filter on columns made from a table's, as a plan."""
    add(name, sql, lambda t: compile_filter(t(source).selectExpr(*columns.split("; ")), program))


# Projections and navigation.
compiled("identity", "region", ".", "SELECT * FROM region")
compiled("nav_field", "customer", ".[] | {c_custkey, name: .c_name}", "SELECT c_custkey, c_name AS name FROM customer")
compiled("nav_value", "lineitem", ".[] | .l_extendedprice", "SELECT l_extendedprice AS value FROM lineitem")
compiled(
    "nav_missing",
    "nation",
    '{n_nationkey, none: (.nothing == null), quoted: ."n_name", bracket: .["n_name"]}',
    "SELECT n_nationkey, true AS none, n_name AS quoted, n_name AS bracket FROM nation",
)
compiled(
    "filter_select",
    "orders",
    '.[] | select(.o_totalprice > 200000 and .o_orderstatus == "F") | {o_orderkey, o_totalprice}',
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 200000 AND o_orderstatus = 'F'",
)
compiled(
    "object_construct",
    "orders",
    "{k: .o_orderkey, total: .o_totalprice}",
    "SELECT o_orderkey AS k, o_totalprice AS total FROM orders",
)
compiled(
    "object_nested",
    "nation",
    '{n_nationkey, x: {a: .n_name, "b": .n_regionkey}} | {n_nationkey, a: .x.a, b: .x.b}',
    "SELECT n_nationkey, n_name AS a, n_regionkey AS b FROM nation",
)
compiled(
    "object_literals",
    "nation",
    '{n_nationkey, s: "x", n: 3, t: true, f: 1.5}',
    "SELECT n_nationkey, 'x' AS s, 3::BIGINT AS n, true AS t, 1.5::DOUBLE AS f FROM nation",
)
compiled("alt_default", "part", "{p_partkey, size: (.p_size // 0)}", "SELECT p_partkey, coalesce(p_size, 0)::BIGINT AS size FROM part")
compiled("alt_null_field", "nation", '{n_nationkey, x: (.nothing // .n_name)}', "SELECT n_nationkey, n_name AS x FROM nation")
compiled(
    "if_elif",
    "orders",
    '{o_orderkey, band: (if .o_totalprice < 50000 then "low" elif .o_totalprice < 200000 then "mid" else "high" end)}',
    "SELECT o_orderkey, CASE WHEN o_totalprice < 50000 THEN 'low' WHEN o_totalprice < 200000 THEN 'mid' ELSE 'high' END AS band FROM orders",
)
compiled(
    "string_interpolation",
    "nation",
    '{n_nationkey, label: "n \\(.n_nationkey): \\(.n_name)"}',
    "SELECT n_nationkey, 'n ' || n_nationkey || ': ' || n_name AS label FROM nation",
)
compiled(
    "variable_binding",
    "part",
    '.[] | .p_size as $s | .p_name as $n | {p_partkey, twice: ($s + $s), n: ($n | length)}',
    "SELECT p_partkey, (p_size + p_size)::BIGINT AS twice, length(p_name)::BIGINT AS n FROM part",
)
compiled(
    "comma_outputs",
    "nation",
    ".[] | (.n_name, \"r\\(.n_regionkey)\")",
    "SELECT unnest([n_name, 'r' || n_regionkey]) AS value FROM nation",
)
compiled(
    "collect_index",
    "benchmark",
    '{item_id, w: (.text | split(" "))} | {item_id, first: .w[0], last: .w[-1], oob: .w[100000]}',
    "SELECT item_id, string_split(text, ' ')[1] AS first, string_split(text, ' ')[-1] AS last, string_split(text, ' ')[100001] AS oob FROM benchmark",
)
compiled(
    "slice_array",
    "benchmark",
    '{item_id, mid: (.text | split(" ") | .[2:5] | join("|")), tail: (.text | split(" ") | .[-2:] | join("|"))}',
    "SELECT item_id, array_to_string(string_split(text, ' ')[3:5], '|') AS mid, array_to_string(string_split(text, ' ')[-2:], '|') AS tail FROM benchmark",
)
compiled(
    "slice_string",
    "customer",
    "{c_custkey, mid: .c_name[2:6], tail: .c_name[-3:], head: .c_name[:4]}",
    "SELECT c_custkey, substr(c_name, 3, 4) AS mid, right(c_name, 3) AS tail, left(c_name, 4) AS head FROM customer",
)
interpreted(
    "index_float",
    "benchmark",
    "item_id; split(text, ' ') AS w",
    "{item_id, a: .w[1.7], b: (.w[1.2:3.5] | join(\"|\")), c: .w[2.0]}",
    "item_id long, a string, b string, c string",
    "SELECT item_id, w[2] AS a, array_to_string(w[2:4], '|') AS b, w[3] AS c FROM (SELECT item_id, string_split(text, ' ') AS w FROM benchmark)",
)
interpreted(
    "slice_computed",
    "benchmark",
    "item_id; split(text, ' ') AS w",
    "(.w | length) as $n | {item_id, half: (.w[:($n / 2 | floor)] | length), same: (.w[($n - 3):$n] | join(\" \"))}",
    "item_id long, half long, same string",
    "SELECT item_id, len(w) // 2 AS half, array_to_string(w[-3:], ' ') AS same FROM (SELECT item_id, string_split(text, ' ') AS w FROM benchmark)",
)
interpreted(
    "index_computed_key",
    "nation",
    "n_nationkey; n_name; n_regionkey",
    '("n_name", "n_regionkey") as $k | {n_nationkey, k: $k, v: (.[$k] | tostring)}',
    "n_nationkey int, k string, v string",
    "SELECT n_nationkey, 'n_name' AS k, n_name AS v FROM nation UNION ALL SELECT n_nationkey, 'n_regionkey', n_regionkey::VARCHAR FROM nation",
)
interpreted(
    "object_computed_key",
    "nation",
    "n_nationkey; n_name",
    '{n_nationkey, o: ({(.n_name): .n_nationkey} | tojson)}',
    "n_nationkey int, o string",
    "SELECT n_nationkey, '{\"' || n_name || '\":' || n_nationkey || '}' AS o FROM nation",
)
interpreted(
    "object_product",
    "region",
    "r_regionkey; r_name",
    "{r_regionkey, a: (1, 2), b: (3, 4)}",
    "r_regionkey int, a int, b int",
    "SELECT r_regionkey, a, b FROM region, (VALUES (1), (2)) x(a), (VALUES (3), (4)) y(b)",
)
interpreted(
    "try_optional",
    "events",
    "event_id; props",
    "{event_id, x: ([.event_id.a?, (.props | fromjson | .k?), .props[]?] | length)}",
    "event_id long, x int",
    "SELECT event_id, 1 AS x FROM events",
)
interpreted(
    "collect_outputs",
    "nation",
    "n_nationkey; n_regionkey",
    "{n_nationkey, s: ([.n_nationkey, .n_regionkey, (.n_nationkey + .n_regionkey)] | tojson)}",
    "n_nationkey int, s string",
    "SELECT n_nationkey, '[' || n_nationkey || ',' || n_regionkey || ',' || (n_nationkey + n_regionkey) || ']' AS s FROM nation",
)
interpreted(
    "recurse_all",
    "events",
    "event_id; from_json(props, 'k int') AS p; array(1, 2) AS a",
    "{event_id, n: ([..] | length), numbers: ([.. | numbers] | length), sum: ([.. | numbers] | add)}",
    "event_id long, n int, numbers int, sum long",
    "SELECT event_id, 7 AS n, 4 AS numbers, event_id + json_extract_string(props, '$.k')::BIGINT + 3 AS sum FROM events",
)
interpreted(
    "getpath_json",
    "events",
    "event_id; props",
    '{event_id, k: (.props | fromjson | getpath(["k"])), none: (.props | fromjson | getpath(["a", "b"]) == null)}',
    "event_id long, k long, none boolean",
    "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, true AS none FROM events",
)
interpreted(
    "pick_paths",
    "nation",
    "n_nationkey; named_struct('a', n_name, 'b', n_regionkey) AS x; 1 AS y",
    "{n_nationkey, p: (pick(.x.b) | tojson)}",
    "n_nationkey int, p string",
    "SELECT n_nationkey, '{\"x\":{\"b\":' || n_regionkey || '}}' AS p FROM nation",
)
interpreted(
    "pick_omit_yq",
    "nation",
    "n_nationkey; n_name; n_regionkey",
    '{"n_nationkey": .n_nationkey, "p": (pick(["n_name"]) | tojson), "o": (omit(["n_name"]) | tojson)}',
    "n_nationkey int, p string, o string",
    "SELECT n_nationkey, '{\"n_name\":\"' || n_name || '\"}' AS p, '{\"n_nationkey\":' || n_nationkey || ',\"n_regionkey\":' || n_regionkey || '}' AS o FROM nation",
    "yq",
)

# Predicates and type tests.
compiled(
    "compare_all",
    "part",
    "{p_partkey, a: (.p_size == 10), b: (.p_size != 10), c: (.p_size < 10), d: (.p_size <= 10), e: (.p_size > 10), f: (.p_size >= 10)}",
    "SELECT p_partkey, p_size = 10 AS a, p_size <> 10 AS b, p_size < 10 AS c, p_size <= 10 AS d, p_size > 10 AS e, p_size >= 10 AS f FROM part",
)
compiled(
    "compare_null",
    "documents",
    "{doc_id, n: (.lang == null), low: (null < .doc_id), s: (.lang < \"en\")}",
    "SELECT doc_id, lang IS NULL AS n, true AS low, coalesce(lang < 'en', true) AS s FROM documents",
)
compiled(
    "and_or_not",
    "orders",
    '.[] | select((.o_orderstatus == "F" or .o_orderstatus == "O") and (.o_totalprice < 100000 | not)) | {o_orderkey}',
    "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'O') AND NOT o_totalprice < 100000",
)
compiled(
    "type_names",
    "part",
    "{p_partkey, a: (.p_size | type), b: (.p_name | type), c: (.none | type), d: (. | type)}",
    "SELECT p_partkey, 'number' AS a, 'string' AS b, 'null' AS c, 'object' AS d FROM part",
)
compiled(
    "type_tests",
    "part",
    "{p_partkey, a: (.p_size | isnumber), b: (.p_name | isstring), c: (.none | isnull), d: (.p_name | isboolean), e: (.p_name | split(\" \") | isarray), f: isobject}",
    "SELECT p_partkey, true AS a, true AS b, true AS c, false AS d, true AS e, true AS f FROM part",
)
interpreted(
    "type_selectors",
    "nation",
    "n_nationkey; n_name",
    '[.n_nationkey, .n_name, null, true, [1], {a: 1}] as $x | {n_nationkey: $x[0], s: ([$x[] | strings] | length), n: ([$x[] | numbers] | length), b: ([$x[] | booleans] | length), z: ([$x[] | nulls] | length), a: ([$x[] | arrays] | length), o: ([$x[] | objects] | length), i: ([$x[] | iterables] | length), c: ([$x[] | scalars] | length), v: ([$x[] | values] | length)}',
    "n_nationkey int, s int, n int, b int, z int, a int, o int, i int, c int, v int",
    "SELECT n_nationkey, 1 AS s, 1 AS n, 1 AS b, 1 AS z, 1 AS a, 1 AS o, 2 AS i, 4 AS c, 5 AS v FROM nation",
)
interpreted(
    "normals_finites",
    "part",
    "p_partkey; p_size",
    "[.p_size, 0, infinite, nan] as $x | {p_partkey, n: ([$x[] | normals] | length), f: ([$x[] | finites] | length), t: ([$x[] | isinfinite] | map(select(.)) | length)}",
    "p_partkey long, n int, f int, t int",
    "SELECT p_partkey, 1 AS n, 2 AS f, 1 AS t FROM part",
)
compiled(
    "has_key",
    "part",
    '{p_partkey, w: (.p_name | split(" "))} | {p_partkey, a: (.w | has(0)), b: (.w | has(50))}',
    "SELECT p_partkey, true AS a, false AS b FROM part",
)
interpreted(
    "has_in",
    "nation",
    "n_nationkey; n_name",
    '{n_nationkey, a: has("n_name"), b: has("x"), c: ("n_name" | in({n_name: 1})), d: ([5] | has(0))}',
    "n_nationkey int, a boolean, b boolean, c boolean, d boolean",
    "SELECT n_nationkey, true AS a, false AS b, true AS c, true AS d FROM nation",
)
compiled(
    "contains_string",
    "part",
    '.[] | select(.p_type | contains("STEEL")) | {p_partkey, p_type}',
    "SELECT p_partkey, p_type FROM part WHERE contains(p_type, 'STEEL')",
)
interpreted(
    "contains_deep",
    "part",
    "p_partkey; split(p_name, ' ') AS w",
    '.w[0] as $f | {p_partkey, a: (.w | contains([$f])), b: ([$f] | inside(["zzz"])), c: ({w: .w, n: 1} | contains({n: 1, w: [$f]}))}',
    "p_partkey long, a boolean, b boolean, c boolean",
    "SELECT p_partkey, true AS a, false AS b, true AS c FROM part",
)
interpreted(
    "isvalid_isempty",
    "part",
    "p_partkey; p_name",
    "{p_partkey, a: isvalid(.p_name.x), b: isvalid(.p_name), c: isempty(empty), d: isempty(.p_name)}",
    "p_partkey long, a boolean, b boolean, c boolean, d boolean",
    "SELECT p_partkey, false AS a, true AS b, true AS c, false AS d FROM part",
)
compiled(
    "any_all_has",
    "lineitem",
    "group_by(.l_orderkey) | map({l_orderkey: .[0].l_orderkey, some: any(.l_quantity > 45), every: all(.[]; .l_quantity > 5)})",
    "SELECT l_orderkey, bool_or(l_quantity > 45) AS some, bool_and(l_quantity > 5) AS every FROM lineitem GROUP BY 1",
)
compiled(
    "any_all_array",
    "part",
    '{p_partkey, a: (.p_name | explode | any(. > 120)), b: (.p_name | explode | map(. > 31) | all)}',
    "SELECT p_partkey, list_bool_or([unicode(c) > 120 FOR c IN string_split(p_name, '')]) AS a, list_bool_and([unicode(c) > 31 FOR c IN string_split(p_name, '')]) AS b FROM part",
)
compiled(
    "in_semi",
    "customer",
    ".[] | select(IN(.c_custkey; $orders[] | .o_custkey)) | {c_custkey}",
    "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)",
    "orders",
)
compiled(
    "in_anti",
    "customer",
    ".[] | select(IN(.c_custkey; $orders[] | .o_custkey) | not) | {c_custkey}",
    "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)",
    "orders",
)
interpreted(
    "in_list",
    "orders",
    "o_orderkey; o_orderstatus",
    '{o_orderkey, a: (.o_orderstatus | IN("F", "P")), b: IN(.o_orderstatus; "O")}',
    "o_orderkey long, a boolean, b boolean",
    "SELECT o_orderkey, o_orderstatus IN ('F', 'P') AS a, o_orderstatus = 'O' AS b FROM orders",
)

# Joins.
compiled(
    "index_lookup_join",
    "customer",
    "($nation | INDEX(.n_nationkey)) as $n | .[] | {c_custkey, n_name: $n[.c_nationkey | tostring].n_name}",
    "SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey",
    "nation",
)
compiled(
    "generator_join",
    "orders",
    ".[] | select(.o_totalprice > 300000) | . as $o | $lineitem[] | select(.l_orderkey == $o.o_orderkey) | {o_orderkey: $o.o_orderkey, l_linenumber}",
    "SELECT o_orderkey, l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_totalprice > 300000",
    "lineitem",
)
compiled(
    "theta_join",
    "part",
    ".[] | select(.p_size == 1) | . as $p | $supplier[] | select(.s_acctbal / 100 > $p.p_retailprice / 20) | {p_partkey: $p.p_partkey, s_suppkey}",
    "SELECT p_partkey, s_suppkey FROM part JOIN supplier ON s_acctbal / 100 > p_retailprice / 20 WHERE p_size = 1",
    "supplier",
)
compiled(
    "three_way_join",
    "region",
    ".[] as $r | $nation[] | select(.n_regionkey == $r.r_regionkey) | . as $n | $customer[] | select(.c_nationkey == $n.n_nationkey) | {r: $r.r_name, n: $n.n_name, c_custkey}",
    "SELECT r_name AS r, n_name AS n, c_custkey FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey",
    "nation",
    "customer",
)
compiled(
    "combinations",
    "region",
    ".[] as $r | $nation[] | {r_name: $r.r_name, n_name}",
    "SELECT r_name, n_name FROM region, nation",
    "nation",
)
interpreted(
    "combinations_arrays",
    "nation",
    "n_nationkey; n_regionkey",
    "{n_nationkey, c: ([[.n_nationkey, 1], [2, 3]] | [combinations] | tojson), n: ([[0, 1] | combinations(3)] | length)}",
    "n_nationkey int, c string, n int",
    "SELECT n_nationkey, '[[' || n_nationkey || ',2],[' || n_nationkey || ',3],[1,2],[1,3]]' AS c, 8 AS n FROM nation",
)
compiled(
    "asof_last",
    "events",
    ".[] | select(.value > 50) | . as $x | {event_id, last_ts: (last($events[] | select(.user_id == $x.user_id and .ts <= $x.ts)) | .ts)}",
    "SELECT event_id, ts AS last_ts FROM events WHERE value > 50",
    "events",
)
compiled(
    "asof_other",
    "events",
    '.[] | select(.event_type == "purchase") | . as $x | {event_id, orders: (last($orders[] | select(.o_custkey == $x.user_id and .o_orderdate <= $x.ts)) | .o_orderdate)}',
    "SELECT event_id, max(o_orderdate) AS orders FROM events LEFT JOIN orders ON o_custkey = user_id AND o_orderdate <= ts WHERE event_type = 'purchase' GROUP BY event_id",
    "orders",
)
interpreted(
    "index_object",
    "part",
    "p_partkey; p_size; p_name",
    '[{id: .p_partkey, v: "a"}, {id: .p_partkey, v: "b"}] as $x | {p_partkey, last: ($x | INDEX(.id) | .[] | .v), n: (INDEX($x[]; .v) | length)}',
    "p_partkey long, last string, n int",
    "SELECT p_partkey, 'b' AS last, 2 AS n FROM part",
)
interpreted(
    "object_merge",
    "nation",
    "n_nationkey; n_name",
    "{n_nationkey, m: ({a: {x: .n_name, y: 1}, b: 2} * {a: {y: .n_nationkey}, c: 3} | tojson)}",
    "n_nationkey int, m string",
    "SELECT n_nationkey, '{\"a\":{\"x\":\"' || n_name || '\",\"y\":' || n_nationkey || '},\"b\":2,\"c\":3}' AS m FROM nation",
)

# Aggregation and grouping.
compiled(
    "group_by_agg",
    "lineitem",
    "group_by(.l_returnflag, .l_linestatus) | map({l_returnflag: .[0].l_returnflag, l_linestatus: .[0].l_linestatus, n: length, qty: (map(.l_quantity) | add), first_ship: (map(.l_shipdate) | min)})",
    "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS qty, min(l_shipdate) AS first_ship FROM lineitem GROUP BY 1, 2",
)
compiled(
    "group_collect",
    "orders",
    'group_by(.o_custkey) | map({o_custkey: .[0].o_custkey, keys: (map(.o_orderkey) | sort | map(tostring) | join(","))})',
    "SELECT o_custkey, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS keys FROM orders GROUP BY 1",
)
compiled(
    "group_having",
    "orders",
    "group_by(.o_custkey) | map(select(length > 12)) | map({o_custkey: .[0].o_custkey, n: length})",
    "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 12",
)
compiled(
    "group_count_if",
    "orders",
    'group_by(.o_orderpriority) | map({o_orderpriority: .[0].o_orderpriority, f: (map(select(.o_orderstatus == "F")) | length), share: ((map(select(.o_orderstatus == "O")) | length) / length | . > 0.3)})',
    "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') / count(*) > 0.3 AS share FROM orders GROUP BY 1",
)
compiled("count_table", "lineitem", "length", "SELECT count(*) AS value FROM lineitem")
compiled("add_numbers", "orders", "map(.o_custkey) | add", "SELECT sum(o_custkey)::BIGINT AS value FROM orders")
compiled(
    "add_strings",
    "part",
    '{p_partkey, s: (.p_name | split(" ") | add), n: (.p_name | explode | add)}',
    "SELECT p_partkey, replace(p_name, ' ', '') AS s, list_sum([unicode(c) FOR c IN string_split(p_name, '')])::BIGINT AS n FROM part",
)
compiled(
    "length_kinds",
    "customer",
    "{c_custkey, s: (.c_name | length), n: (-5 | length), z: (.none | length), a: (.c_name | split(\"#\") | length)}",
    "SELECT c_custkey, length(c_name) AS s, 5::BIGINT AS n, 0::BIGINT AS z, len(string_split(c_name, '#')) AS a FROM customer",
)
compiled("min_max", "orders", "map(.o_totalprice) | max", "SELECT max(o_totalprice) AS value FROM orders")
compiled(
    "min_by_max_by",
    "orders",
    "group_by(.o_custkey) | map({o_custkey: .[0].o_custkey, cheapest: (min_by(.o_totalprice) | .o_orderkey), dearest: (max_by(.o_totalprice) | .o_orderkey)})",
    "SELECT o_custkey, arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS cheapest, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS dearest FROM orders GROUP BY 1",
)
compiled(
    "max_by_rows",
    "orders",
    "group_by(.o_custkey) | map(max_by(.o_totalprice)) | map({o_custkey, o_orderkey})",
    "SELECT o_custkey, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS o_orderkey FROM orders GROUP BY 1",
)
compiled(
    "unique_by_first",
    "customer",
    "sort_by(.c_custkey) | unique_by(.c_nationkey) | map({c_nationkey, c_custkey})",
    "SELECT c_nationkey, min(c_custkey) AS c_custkey FROM customer GROUP BY 1",
)
compiled("unique_values", "lineitem", "map(.l_shipdate) | unique", "SELECT DISTINCT l_shipdate AS value FROM lineitem")
compiled(
    "unique_count",
    "lineitem",
    "group_by(.l_partkey) | map({l_partkey: .[0].l_partkey, n: (map(.l_suppkey) | unique | length)})",
    "SELECT l_partkey, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1",
)
compiled(
    "reduce_sum",
    "events",
    "group_by(.user_id) | map({user_id: .[0].user_id, total: (reduce .[] as $x (0; . + ($x.event_id * 2))), n: length})",
    "SELECT user_id, sum(event_id * 2)::BIGINT AS total, count(*) AS n FROM events GROUP BY 1",
)
compiled("reduce_table", "orders", "reduce .[] as $o (100; . + $o.o_custkey)", "SELECT (100 + sum(o_custkey))::BIGINT AS value FROM orders")
interpreted(
    "reduce_fold",
    "part",
    "p_partkey; split(p_name, ' ') AS w",
    '{p_partkey, s: (reduce .w[] as $x (""; $x + . )), m: (reduce .w[] as $x (0; if ($x | length) > . then ($x | length) else . end))}',
    "p_partkey long, s string, m int",
    "SELECT p_partkey, array_to_string(list_reverse(string_split(p_name, ' ')), '') AS s, list_max([length(x) FOR x IN string_split(p_name, ' ')])::INT AS m FROM part",
)
interpreted(
    "transpose_pivot",
    "nation",
    "n_nationkey; n_regionkey",
    '{n_nationkey, t: ([[.n_nationkey, 1], [2]] | transpose | tojson), p: ([{a: .n_regionkey}, {b: 5}] | pivot | tojson)}',
    "n_nationkey int, t string, p string",
    "SELECT n_nationkey, '[[' || n_nationkey || ',2],[1,null]]' AS t, '{\"a\":[' || n_regionkey || ',null],\"b\":[null,5]}' AS p FROM nation",
    "yq",
)
compiled(
    "pivot",
    "orders",
    'group_by(.o_orderpriority) | map({o_orderpriority: .[0].o_orderpriority, f: (map(select(.o_orderstatus == "F") | .o_custkey) | add), o: (map(select(.o_orderstatus == "O") | .o_custkey) | max)})',
    "SELECT o_orderpriority, sum(o_custkey) FILTER (o_orderstatus = 'F')::BIGINT AS f, max(o_custkey) FILTER (o_orderstatus = 'O') AS o FROM orders GROUP BY 1",
)
interpreted(
    "group_by_values",
    "part",
    "p_partkey; split(p_name, '') AS c",
    "{p_partkey, g: (.c | map(select(. != \"\")) | group_by(.) | map(\"\\(.[0])\\(length)\") | add), u: (.c | unique_by(.) | add), b: (.c | map(select(. != \"\")) | [min_by(.), max_by(.), min, max] | add)}",
    "p_partkey long, g string, u string, b string",
    "SELECT p_partkey, (SELECT string_agg(x || n, '' ORDER BY x) FROM (SELECT x, count(*) AS n FROM unnest(string_split(p_name, '')) AS q(x) GROUP BY x)) AS g, array_to_string(list_sort(list_distinct(string_split(p_name, ''))), '') AS u, list_min(string_split(p_name, '')) || list_max(string_split(p_name, '')) || list_min(string_split(p_name, '')) || list_max(string_split(p_name, '')) AS b FROM part",
)

# Windows.
compiled(
    "foreach_running",
    "orders",
    "group_by(.o_custkey)[] | sort_by(.o_orderkey) | foreach .[] as $o (0; . + $o.o_orderkey; {o_orderkey: $o.o_orderkey, running: .})",
    "SELECT o_orderkey, sum(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING)::BIGINT AS running FROM orders",
)
interpreted(
    "foreach_values",
    "part",
    "p_partkey; transform(split(p_name, ' '), x -> length(x)) AS n",
    "{p_partkey, s: ([foreach .n[] as $x (0; . + $x)] | map(tostring) | join(\",\")), e: ([foreach .n[] as $x (0; . + 1; [$x, .])] | length)}",
    "p_partkey long, s string, e int",
    "SELECT p_partkey, array_to_string([list_sum(n[1:i])::INT FOR i IN range(1, len(n) + 1)], ',') AS s, len(n)::INT AS e FROM (SELECT p_partkey, [length(x) FOR x IN string_split(p_name, ' ')] AS n FROM part)",
)
compiled(
    "first_last",
    "orders",
    "group_by(.o_custkey) | map({o_custkey: .[0].o_custkey, first: (sort_by(.o_orderkey) | first | .o_orderkey), last: (sort_by(-.o_orderkey) | .[0] | .o_orderkey)})",
    "SELECT o_custkey, min(o_orderkey) AS first, max(o_orderkey) AS last FROM orders GROUP BY 1",
)
compiled(
    "row_numbers",
    "nation",
    "sort_by(.n_name) | to_entries | map({i: .key, n: .value.n_name})",
    "SELECT row_number() OVER (ORDER BY n_name) - 1 AS i, n_name AS n FROM nation",
)
compiled(
    "topk_per_group",
    "orders",
    "group_by(.o_custkey) | map(sort_by(-.o_totalprice, .o_orderkey) | .[:3]) | add | map({o_custkey, o_orderkey, o_totalprice})",
    "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 3",
)
interpreted(
    "lag_pairs",
    "part",
    "p_partkey; split(p_name, ' ') AS w",
    '{p_partkey, p: (.w | [., .[1:]] | transpose | map("\\(.[0])>\\(.[1])") | join(";"))}',
    "p_partkey long, p string",
    "SELECT p_partkey, array_to_string([w[i] || '>' || coalesce(w[i + 1], 'null') FOR i IN range(1, len(w) + 1)], ';') AS p FROM (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part)",
)
interpreted(
    "bsearch_sorted",
    "part",
    "p_partkey; array_sort(split(p_name, ' ')) AS w",
    "{p_partkey, a: (.w as $w | .w[0] as $x | $w | bsearch($x) >= 0), b: (.w | bsearch(\"\")), c: ([1, 3, 5] | [bsearch(3), bsearch(4)] | tojson)}",
    "p_partkey long, a boolean, b int, c string",
    "SELECT p_partkey, true AS a, -1 AS b, '[1,-3]' AS c FROM part",
)

# Order, limits and generators.
compiled(
    "sort_limit",
    "orders",
    "sort_by(-.o_totalprice, .o_orderkey) | .[:10] | map({o_orderkey, o_totalprice})",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
)
compiled(
    "sort_array",
    "part",
    '{p_partkey, s: (.p_name | split(" ") | sort | join(" ")), r: (.p_name | split(" ") | sort | reverse | join(" ")), u: (.p_name | explode | unique | length)}',
    "SELECT p_partkey, array_to_string(list_sort(string_split(p_name, ' ')), ' ') AS s, array_to_string(list_reverse_sort(string_split(p_name, ' ')), ' ') AS r, len(list_distinct(string_split(p_name, ''))) AS u FROM part",
)
compiled(
    "skip_nth",
    "nation",
    "sort_by(.n_nationkey) | .[10:15] | map({n_nationkey, n_name})",
    "SELECT n_nationkey, n_name FROM nation ORDER BY n_nationkey LIMIT 5 OFFSET 10",
)
compiled(
    "limit_outputs",
    "customer",
    "sort_by(.c_custkey) | limit(7; .[]) | {c_custkey}",
    "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 7",
)
compiled("skip_outputs", "nation", "sort_by(.n_name) | skip(20; .[]) | {n_name}", "SELECT n_name FROM nation ORDER BY n_name OFFSET 20")
compiled("nth_output", "nation", "sort_by(.n_name) | nth(3; .[]) | {n_name}", "SELECT n_name FROM nation ORDER BY n_name LIMIT 1 OFFSET 3")
compiled("first_output", "nation", "sort_by(.n_name) | first(.[]) | {n_name}", "SELECT min(n_name) AS n_name FROM nation")
compiled("last_output", "nation", "sort_by(.n_name) | last(.[]) | {n_name}", "SELECT max(n_name) AS n_name FROM nation")
interpreted(
    "sort_mixed",
    "nation",
    "n_nationkey; n_name",
    '{n_nationkey, s: ([{a: 1}, [.n_nationkey], .n_name, .n_nationkey, true, false, null] | sort | tojson)}',
    "n_nationkey int, s string",
    "SELECT n_nationkey, '[null,false,true,' || n_nationkey || ',\"' || n_name || '\",[' || n_nationkey || '],{\"a\":1}]' AS s FROM nation",
)
interpreted(
    "generators",
    "nation",
    "n_nationkey; n_regionkey",
    ".n_regionkey as $r | {n_nationkey, a: ([range($r)] | length), b: ([range(1; $r)] | add), c: ([range(0; 10; 3)] | tojson), d: ([limit(3; repeat(1))] | length), e: ([$r | while(. < 9; . + 2)] | length), f: ($r | until(. > 20; . + 3)), g: first(range(5; 9)), h: last(range($r + 1)), i: nth(2; range(10)), j: ([skip(2; range(5))] | length)}",
    "n_nationkey int, a int, b int, c string, d int, e int, f int, g int, h int, i int, j int",
    "SELECT n_nationkey, n_regionkey AS a, CASE WHEN n_regionkey > 1 THEN (n_regionkey * (n_regionkey - 1) / 2)::INT END AS b, '[0,3,6,9]' AS c, 3 AS d, ((9 - n_regionkey + 1) // 2)::INT AS e, (n_regionkey + 3 * ((20 - n_regionkey) // 3 + 1))::INT AS f, 5 AS g, n_regionkey AS h, 2 AS i, 3 AS j FROM nation",
)
interpreted(
    "label_break",
    "part",
    "p_partkey; split(p_name, ' ') AS w",
    '{p_partkey, s: ([label $out | .w[] | ., (if length > 5 then break $out else empty end)] | join(" "))}',
    "p_partkey long, s string",
    "SELECT p_partkey, array_to_string(w[1:coalesce(list_position([length(x) > 5 FOR x IN w], true), len(w))], ' ') AS s FROM (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part)",
)
add(
    "shuffle_rows",
    None,
    lambda t: interpret(documents(t("nation").select("n_nationkey")), "[.n_nationkey, 1, 2] | shuffle | length", mode="yq").select("value"),
)

# Arrays and sets.
compiled(
    "union_all",
    "nation",
    "map({name: .n_name}) + ($region | map({name: .r_name}))",
    "SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region",
    "region",
)
compiled(
    "union_distinct",
    "customer",
    "map({k: .c_nationkey}) + ($supplier | map({k: .s_nationkey})) | unique",
    "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "supplier",
)
compiled(
    "array_minus",
    "customer",
    "map({k: .c_custkey}) - ($orders | map({k: .o_custkey}))",
    "SELECT c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
    "orders",
)
compiled(
    "array_minus_values",
    "part",
    '{p_partkey, m: ((.p_name | explode) - ("aeiou " | explode) | length)}',
    "SELECT p_partkey, length(translate(p_name, 'aeiou ', '')) AS m FROM part",
)
compiled(
    "array_intersect",
    "customer",
    "map({k: .c_nationkey}) - (map({k: .c_nationkey}) - ($supplier | map({k: .s_nationkey}))) | unique",
    "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    "supplier",
)
compiled(
    "flatten_explode",
    "lineitem",
    "group_by(.l_orderkey) | map({k: .[0].l_orderkey, lines: (map(.l_linenumber) | sort)}) | .[] | {k, line: .lines[]}",
    "SELECT l_orderkey AS k, l_linenumber AS line FROM lineitem",
)
interpreted(
    "flatten_depth",
    "nation",
    "n_nationkey",
    "{n_nationkey, a: ([.n_nationkey, [1, [2]]] | flatten | tojson), b: ([.n_nationkey, [1, [2]]] | flatten(1) | tojson)}",
    "n_nationkey int, a string, b string",
    "SELECT n_nationkey, '[' || n_nationkey || ',1,2]' AS a, '[' || n_nationkey || ',1,[2]]' AS b FROM nation",
)
interpreted(
    "string_indices",
    "part",
    "p_partkey; p_type",
    '{p_partkey, n: (.p_type | indices("E") | length), i: (.p_type | index("E")), r: (.p_type | rindex("E")), a: ([1, 2, 1, 2] | indices([1, 2]) | tojson)}',
    "p_partkey long, n int, i int, r int, a string",
    "SELECT p_partkey, (length(p_type) - length(replace(p_type, 'E', '')))::INT AS n, CASE WHEN contains(p_type, 'E') THEN instr(p_type, 'E')::INT - 1 END AS i, CASE WHEN contains(p_type, 'E') THEN (length(p_type) - instr(reverse(p_type), 'E'))::INT END AS r, '[0,2]' AS a FROM part",
)

# Objects, maps, paths and updates.
interpreted(
    "keys_entries",
    "nation",
    "n_nationkey; n_name",
    '{n_nationkey, k: (keys | join(",")), u: (keys_unsorted | join(",")), e: (to_entries | map(.key) | join("-")), f: ([{key: .n_name, value: 1}, {k: "b", v: 2}, {name: "c", value: 3}] | from_entries | tojson), i: ([5, 6] | keys | tojson)}',
    "n_nationkey int, k string, u string, e string, f string, i string",
    "SELECT n_nationkey, 'n_name,n_nationkey' AS k, 'n_nationkey,n_name' AS u, 'n_nationkey-n_name' AS e, '{\"' || n_name || '\":1,\"b\":2,\"c\":3}' AS f, '[0,1]' AS i FROM nation",
)
interpreted(
    "with_entries",
    "nation",
    "n_nationkey; n_regionkey",
    '{n_nationkey, w: (with_entries(select(.value > 1) | .value += 10 | .key |= ltrimstr("n_")) | tojson)}',
    "n_nationkey int, w string",
    "SELECT n_nationkey, '{' || concat_ws(',', CASE WHEN n_nationkey > 1 THEN '\"nationkey\":' || (n_nationkey + 10) END, CASE WHEN n_regionkey > 1 THEN '\"regionkey\":' || (n_regionkey + 10) END) || '}' AS w FROM nation",
)
compiled(
    "map_array",
    "part",
    '{p_partkey, s: (.p_name | split(" ") | map(ascii_upcase) | join("_")), n: (.p_name | split(" ") | map(length) | add), l: (.p_name | split(" ") | map(select(length > 4)) | length)}',
    "SELECT p_partkey, upper(replace(p_name, ' ', '_')) AS s, length(replace(p_name, ' ', '')) AS n, len([x FOR x IN string_split(p_name, ' ') IF length(x) > 4]) AS l FROM part",
)
interpreted(
    "map_values",
    "nation",
    "n_nationkey; n_regionkey",
    "{n_nationkey, m: (map_values(. + 1) | tojson), a: ([.n_nationkey, 2] | map_values(empty) | tojson), o: (map(. * 2) | tojson)}",
    "n_nationkey int, m string, a string, o string",
    "SELECT n_nationkey, '{\"n_nationkey\":' || (n_nationkey + 1) || ',\"n_regionkey\":' || (n_regionkey + 1) || '}' AS m, '[]' AS a, '[' || n_nationkey * 2 || ',' || n_regionkey * 2 || ']' AS o FROM nation",
)
interpreted(
    "walk_values",
    "nation",
    "n_nationkey; n_name",
    '{n_nationkey, w: ([.n_nationkey, [.n_name, {a: 1}]] | walk(if type == "number" then . + 1 elif type == "string" then ascii_downcase else . end) | tojson)}',
    "n_nationkey int, w string",
    "SELECT n_nationkey, '[' || (n_nationkey + 1) || ',[\"' || lower(n_name) || '\",{\"a\":2}]]' AS w FROM nation",
)
interpreted(
    "recurse_forms",
    "nation",
    "n_nationkey; n_name",
    '{n: .n_name, c: [{n: "x", c: [{n: "y", c: []}]}], k: .n_nationkey} | {n_nationkey: .k, d: ([recurse(.c[]) | .n] | join("/")), h: ([2 | recurse(. * .; . < 100)] | tojson), r: ([.c | recurse_down | scalars] | length)}',
    "n_nationkey int, d string, h string, r int",
    "SELECT n_nationkey, n_name || '/x/y' AS d, '[2,4,16]' AS h, 2 AS r FROM nation",
)
interpreted(
    "paths_all",
    "events",
    "event_id; from_json(props, 'k int') AS p; array(1) AS a",
    '{event_id, p: ([paths | map(tostring) | join(".")] | join(",")), l: ([leaf_paths] | length), n: ([paths(type == "number")] | length), q: ([path(.p.k, .a[0])] | tojson)}',
    "event_id long, p string, l int, n int, q string",
    "SELECT event_id, 'event_id,p,p.k,a,a.0' AS p, 3 AS l, 3 AS n, '[[\"p\",\"k\"],[\"a\",0]]' AS q FROM events",
)
interpreted(
    "parent_key_yq",
    "nation",
    "n_nationkey; named_struct('b', n_name) AS a",
    '{"n_nationkey": .n_nationkey, "k": (.a.b | key), "p": (.a.b | parent | tojson), "q": (.a.b | parent(2) | .n_nationkey), "d": (.a.b | path | join("."))}',
    "n_nationkey int, k string, p string, q int, d string",
    "SELECT n_nationkey, 'b' AS k, '{\"b\":\"' || n_name || '\"}' AS p, n_nationkey AS q, 'a.b' AS d FROM nation",
    "yq",
)
interpreted(
    "setpath_delete",
    "nation",
    "n_nationkey; n_name; n_regionkey",
    '{n_nationkey, s: (setpath(["a", 1]; 5) | .a | tojson), d: (del(.n_name) | tojson), p: (delpaths([["n_name"], ["n_regionkey"]]) | tojson), x: ([1, 2, 3, 4] | del(.[1, 2]) | tojson), y: ([1, 2, 3, 4] | del(.[1:]) | tojson)}',
    "n_nationkey int, s string, d string, p string, x string, y string",
    "SELECT n_nationkey, '[null,5]' AS s, '{\"n_nationkey\":' || n_nationkey || ',\"n_regionkey\":' || n_regionkey || '}' AS d, '{\"n_nationkey\":' || n_nationkey || '}' AS p, '[1,4]' AS x, '[1]' AS y FROM nation",
)
compiled(
    "update_assign",
    "part",
    ".[] | .p_size |= . + 1 | .p_brand = \"none\"",
    "SELECT * REPLACE ((p_size + 1)::BIGINT AS p_size, 'none' AS p_brand) FROM part",
)
compiled(
    "update_arithmetic",
    "supplier",
    ".[] | .s_suppkey += 10 | .s_nationkey *= 2 | .s_nationkey -= 1 | .s_nationkey %= 7",
    "SELECT * REPLACE (s_suppkey + 10 AS s_suppkey, ((s_nationkey * 2 - 1) % 7)::BIGINT AS s_nationkey) FROM supplier",
)
compiled(
    "update_alternative",
    "documents",
    '.[] | {doc_id, lang} | .lang //= "none"',
    "SELECT doc_id, coalesce(lang, 'none') AS lang FROM documents",
)
compiled("update_delete", "supplier", ".[] | del(.s_acctbal)", "SELECT * EXCLUDE (s_acctbal) FROM supplier")
interpreted(
    "update_paths",
    "nation",
    "n_nationkey; array(1, 2, 3) AS a",
    '{n_nationkey, u: (.a[] |= . * 2 | .a | tojson), e: ((.a[] | select(. == 2)) |= empty | .a | tojson), n: (.x.y = .n_nationkey | .x | tojson), s: (.a[1:] = [9] | .a | tojson), o: ((.a[0], .a[2]) += 10 | .a | tojson), d: (.z //= 4 | .z), v: (.a[0] /= 2 | .a[0] | tojson)}',
    "n_nationkey int, u string, e string, n string, s string, o string, d int, v string",
    "SELECT n_nationkey, '[2,4,6]' AS u, '[1,3]' AS e, '{\"y\":' || n_nationkey || '}' AS n, '[1,9]' AS s, '[11,2,13]' AS o, 4 AS d, '0.5' AS v FROM nation",
)

# Strings.
compiled(
    "string_ascii",
    "customer",
    '{c_custkey, low: (.c_name | ascii_downcase), up: (.c_name | ascii_upcase), n: (.c_name | length), bytes: (.c_name | utf8bytelength), pre: (.c_name | startswith("Customer")), suf: (.c_name | endswith("1"))}',
    "SELECT c_custkey, lower(c_name) AS low, upper(c_name) AS up, length(c_name) AS n, strlen(c_name)::BIGINT AS bytes, starts_with(c_name, 'Customer') AS pre, ends_with(c_name, '1') AS suf FROM customer",
)
compiled(
    "string_trimstr",
    "customer",
    '{c_custkey, l: (.c_name | ltrimstr("Customer#")), r: (.c_name | rtrimstr("1")), n: (.c_name | ltrimstr("x"))}',
    "SELECT c_custkey, CASE WHEN starts_with(c_name, 'Customer#') THEN substr(c_name, 10) ELSE c_name END AS l, CASE WHEN ends_with(c_name, '1') THEN left(c_name, length(c_name) - 1) ELSE c_name END AS r, c_name AS n FROM customer",
)
compiled(
    "string_trim",
    "nation",
    '{n_nationkey, t: (" \\t\\(.n_name)\\n " | trim), l: ("\\n \\(.n_name) " | ltrim), r: ("  \\(.n_name)\\t" | rtrim)}',
    "SELECT n_nationkey, n_name AS t, n_name || ' ' AS l, '  ' || n_name AS r FROM nation",
)
compiled(
    "string_split_join",
    "part",
    '{p_partkey, s: (.p_name | split(" ") | reverse | join("-")), d: (.p_name / " " | length)}',
    "SELECT p_partkey, array_to_string(list_reverse(string_split(p_name, ' ')), '-') AS s, len(string_split(p_name, ' ')) AS d FROM part",
)
compiled(
    "string_explode",
    "documents",
    '.[] | select(.doc_id < 50 and .text != null) | {doc_id, first: (.text | explode | .[0]), n: (.text | explode | length)}',
    "SELECT doc_id, CASE WHEN text <> '' THEN unicode(text)::BIGINT END AS first, length(text) AS n FROM documents WHERE doc_id < 50 AND text IS NOT NULL",
)
interpreted(
    "string_implode",
    "part",
    "p_partkey; p_name",
    "{p_partkey, s: (.p_name | explode | map(if . == 32 then 8364 else . end) | implode)}",
    "p_partkey long, s string",
    "SELECT p_partkey, replace(p_name, ' ', '€') AS s FROM part",
)
interpreted(
    "string_convert",
    "orders",
    "o_orderkey; o_orderstatus",
    '{o_orderkey, a: (.o_orderkey | tostring), b: ("\\(.o_orderkey)" | tonumber + 1), c: ("true" | toboolean), d: ([.o_orderkey, "a"] | tostring), e: (try (.o_orderstatus | tonumber) catch "no")}',
    "o_orderkey long, a string, b long, c boolean, d string, e string",
    "SELECT o_orderkey, o_orderkey::VARCHAR AS a, o_orderkey + 1 AS b, true AS c, '[' || o_orderkey || ',\"a\"]' AS d, 'no' AS e FROM orders",
)
interpreted(
    "json_convert",
    "events",
    "event_id; props",
    '{event_id, j: (.props | fromjson | tojson), k: (.props | fromjson | .k), s: ("a\\"\\u00e9\\n" | tojson)}',
    "event_id long, j string, k long, s string",
    "SELECT event_id, replace(props, ' ', '') AS j, json_extract_string(props, '$.k')::BIGINT AS k, '\"a\\\"é\\n\"' AS s FROM events",
)
compiled(
    "regex_test",
    "pages",
    '.[] | select(.url | test("^https://m[.]")) | {page_id, url}',
    "SELECT page_id, url FROM pages WHERE regexp_matches(url, '^https://m[.]')",
)
interpreted(
    "regex_match",
    "pages",
    "page_id; url",
    '{page_id, m: (.url | [match("[a-z]+"; "g") | .offset] | length), f: (.url | match("://(?<h>[^/]+)") | .captures[0] | "\\(.name) \\(.string)"), o: (.url | match("://") | .offset)}',
    "page_id long, m int, f string, o int",
    "SELECT page_id, len(regexp_extract_all(url, '[a-z]+'))::INT AS m, 'h ' || regexp_extract(url, '://([^/]+)', 1) AS f, instr(url, '://')::INT - 1 AS o FROM pages WHERE url LIKE '%://_%'",
)
interpreted(
    "regex_capture",
    "pages",
    "page_id; url",
    '.page_id as $p | .url | capture("^(?<scheme>https?)://(?<host>[^/?#]+)") | {page_id: $p} + .',
    "page_id long, scheme string, host string",
    "SELECT page_id, regexp_extract(url, '^(https?)://([^/?#]+)', 1) AS scheme, regexp_extract(url, '^(https?)://([^/?#]+)', 2) AS host FROM pages WHERE regexp_matches(url, '^(https?)://([^/?#]+)')",
)
interpreted(
    "regex_scan",
    "pages",
    "page_id; url",
    '{page_id, n: (.url | [scan("[a-z]+")] | length), w: (.url | [scan("[a-z]+")] | join(",")), g: (.url | [scan("([a-z])([0-9])")] | length), i: (.url | [scan("H"; "i")] | length)}',
    "page_id long, n int, w string, g int, i int",
    "SELECT page_id, len(regexp_extract_all(url, '[a-z]+'))::INT AS n, array_to_string(regexp_extract_all(url, '[a-z]+'), ',') AS w, len(regexp_extract_all(url, '[a-z][0-9]'))::INT AS g, len(regexp_extract_all(url, '[hH]'))::INT AS i FROM pages WHERE url IS NOT NULL",
)
interpreted(
    "regex_sub",
    "pages",
    "page_id; url",
    '{page_id, s: (.url | sub("[0-9]+"; "#")), g: (.url | gsub("[0-9]+"; "#")), c: (.url | gsub("(?<d>[0-9])"; "<\\(.d)>"))}',
    "page_id long, s string, g string, c string",
    "SELECT page_id, regexp_replace(url, '[0-9]+', '#') AS s, regexp_replace(url, '[0-9]+', '#', 'g') AS g, regexp_replace(url, '([0-9])', '<\\1>', 'g') AS c FROM pages WHERE url IS NOT NULL",
)
interpreted(
    "regex_splits",
    "pages",
    "page_id; url",
    '{page_id, s: (.url | [splits("[/?]")] | join("|")), t: (.url | split("[/?]"; null) | length), u: (.url | split("H"; "i") | length)}',
    "page_id long, s string, t int, u int",
    "SELECT page_id, array_to_string(regexp_split_to_array(url, '[/?]'), '|') AS s, len(regexp_split_to_array(url, '[/?]'))::INT AS t, len(regexp_split_to_array(url, '[hH]'))::INT AS u FROM pages WHERE url IS NOT NULL",
)

# Formats.
interpreted(
    "format_csv",
    "part",
    "p_partkey; p_name; p_size",
    "{p_partkey, line: ([.p_partkey, .p_name, null, true, \"a,\\\"b\\\"\"] | @csv)}",
    "p_partkey long, line string",
    "SELECT p_partkey, p_partkey || ',\"' || p_name || '\",,true,\"a,\"\"b\"\"\"' AS line FROM part",
)
interpreted(
    "format_tsv",
    "part",
    "p_partkey; p_name",
    '{p_partkey, line: ([.p_partkey, .p_name, null, "a\\tb\\\\c\\nd"] | @tsv)}',
    "p_partkey long, line string",
    "SELECT p_partkey, p_partkey || chr(9) || p_name || chr(9) || chr(9) || 'a\\tb\\\\c\\nd' AS line FROM part",
)
interpreted(
    "format_html",
    "documents",
    "doc_id; text",
    "{doc_id, h: ((.text // \"\") | @html)}",
    "doc_id long, h string",
    "SELECT doc_id, replace(replace(replace(replace(replace(coalesce(text, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '''', '&#39;'), '\"', '&quot;') AS h FROM documents",
)
interpreted(
    "format_uri",
    "part",
    "p_partkey; p_type; p_name",
    "{p_partkey, u: (.p_type | @uri), d: (.p_type | @uri | @urid), i: @uri \"q=\\(.p_name)&r=é\"}",
    "p_partkey long, u string, d string, i string",
    "SELECT p_partkey, url_encode(p_type) AS u, p_type AS d, 'q=' || url_encode(p_name) || '&r=é' AS i FROM part",
)
interpreted(
    "format_base64",
    "documents",
    "doc_id; text",
    '(.text // "") as $t | {doc_id, b: ($t | @base64), d: ($t | @base64 | @base64d == $t)}',
    "doc_id long, b string, d boolean",
    "SELECT doc_id, to_base64(encode(coalesce(text, ''))) AS b, true AS d FROM documents",
)
interpreted(
    "format_sh",
    "part",
    "p_partkey; p_name",
    "{p_partkey, s: (.p_name | @sh), a: ([.p_partkey, \"it's\"] | @sh)}",
    "p_partkey long, s string, a string",
    "SELECT p_partkey, '''' || p_name || '''' AS s, p_partkey || ' ''it''\\''''s''' AS a FROM part",
)
interpreted(
    "format_text_json",
    "part",
    "p_partkey; p_name; p_size",
    '{p_partkey, t: ([.p_size, .p_name] | @text), j: (.p_name | @json), k: @json "v\\(.p_size)\\(.p_name)"}',
    "p_partkey long, t string, j string, k string",
    "SELECT p_partkey, '[' || p_size || ',\"' || p_name || '\"]' AS t, '\"' || p_name || '\"' AS j, 'v' || p_size || '\"' || p_name || '\"' AS k FROM part",
)

# Numbers.
compiled(
    "math_floor",
    "orders",
    "{o_orderkey, f: (.o_totalprice | floor), c: (.o_totalprice | ceil), r: (.o_totalprice | round), t: (.o_totalprice | trunc), n: (-.o_totalprice | round)}",
    "SELECT o_orderkey, floor(o_totalprice)::BIGINT AS f, ceil(o_totalprice)::BIGINT AS c, round(o_totalprice)::BIGINT AS r, trunc(o_totalprice)::BIGINT AS t, (-round(o_totalprice))::BIGINT AS n FROM orders",
)
compiled(
    "math_arithmetic",
    "part",
    "{p_partkey, a: (.p_size + 3), s: (.p_size - 3), m: (.p_size * 3), d: (.p_size / 4), n: (-.p_size), x: (null + .p_size), c: (.p_name + \"!\")}",
    "SELECT p_partkey, (p_size + 3)::BIGINT AS a, (p_size - 3)::BIGINT AS s, (p_size * 3)::BIGINT AS m, p_size / 4.0::DOUBLE AS d, (-p_size)::BIGINT AS n, p_size AS x, p_name || '!' AS c FROM part",
)
compiled(
    "math_modulo",
    "orders",
    "{o_orderkey, m: (.o_custkey % 7), n: (-.o_custkey % 7)}",
    "SELECT o_orderkey, o_custkey % 7 AS m, (-o_custkey) % 7 AS n FROM orders",
)
compiled(
    "math_sqrt_pow",
    "part",
    "{p_partkey, s: (.p_size | sqrt | . * 1000 | floor), p: (pow(.p_size; 2) | floor), f: (-.p_size | fabs)}",
    "SELECT p_partkey, floor(sqrt(p_size) * 1000)::BIGINT AS s, (p_size * p_size)::BIGINT AS p, p_size::DOUBLE AS f FROM part",
)
interpreted(
    "math_log",
    "part",
    "p_partkey; p_size",
    "{p_partkey, a: (.p_size | log * 1000 | floor), b: (.p_size | log2 * 1000 | floor), c: (.p_size | log10 * 1000 | floor), d: (.p_size / 100 | exp * 1000 | floor), e: (3 | exp2), f: (2 | exp10)}",
    "p_partkey long, a int, b int, c int, d int, e int, f int",
    "SELECT p_partkey, floor(ln(p_size) * 1000)::INT AS a, floor(log2(p_size) * 1000)::INT AS b, floor(log10(p_size) * 1000)::INT AS c, floor(exp(p_size / 100.0) * 1000)::INT AS d, 8 AS e, 100 AS f FROM part",
)
compiled(
    "math_trig",
    "part",
    "{p_partkey, s: (.p_size | sin * 1000 | floor), c: (.p_size | cos * 1000 | floor), t: (.p_size | atan * 1000 | floor), a: (atan2(.p_size; 10) * 1000 | floor)}",
    "SELECT p_partkey, floor(sin(p_size) * 1000)::BIGINT AS s, floor(cos(p_size) * 1000)::BIGINT AS c, floor(atan(p_size) * 1000)::BIGINT AS t, floor(atan2(p_size, 10) * 1000)::BIGINT AS a FROM part",
)
interpreted(
    "math_hyperbolic",
    "part",
    "p_partkey; p_size",
    "(.p_size / 50) as $x | {p_partkey, a: ($x | sinh * 1000 | floor), b: ($x | cosh * 1000 | floor), c: ($x | tanh * 1000 | floor), d: ($x | asinh * 1000 | floor), e: (($x / 2) | atanh * 1000 | floor), f: ($x | tan * 1000 | floor), g: (($x / 2) | asin * 1000 | floor), h: (($x / 2) | acos * 1000 | floor), i: (($x + 1) | acosh * 1000 | floor)}",
    "p_partkey long, a int, b int, c int, d int, e int, f int, g int, h int, i int",
    "SELECT p_partkey, floor(sinh(x) * 1000)::INT AS a, floor(cosh(x) * 1000)::INT AS b, floor(tanh(x) * 1000)::INT AS c, floor(asinh(x) * 1000)::INT AS d, floor(atanh(x / 2) * 1000)::INT AS e, floor(tan(x) * 1000)::INT AS f, floor(asin(x / 2) * 1000)::INT AS g, floor(acos(x / 2) * 1000)::INT AS h, floor(acosh(x + 1) * 1000)::INT AS i FROM (SELECT p_partkey, p_size / 50.0::DOUBLE AS x FROM part)",
)
interpreted(
    "math_special",
    "nation",
    "n_nationkey",
    "{n_nationkey, a: (infinite | isinfinite), b: (nan | isnan), c: (.n_nationkey | isnormal), d: (nan < nan), e: ([nan, 1] | sort | .[1]), f: (infinite | tojson), g: (nan | tojson), h: (1 | isfinite), i: (-3.7 | abs | tostring)}",
    "n_nationkey int, a boolean, b boolean, c boolean, d boolean, e int, f string, g string, h boolean, i string",
    "SELECT n_nationkey, true AS a, true AS b, n_nationkey <> 0 AS c, true AS d, 1 AS e, '1.7976931348623157e+308' AS f, 'null' AS g, true AS h, '3.7' AS i FROM nation",
)

# Dates.
derived(
    "date_gmtime",
    "orders",
    "o_orderkey; unix_seconds(to_timestamp(o_orderdate)) AS s",
    '.s as $s | {o_orderkey, g: (.s | gmtime | tojson), m: (.s | gmtime | mktime == $s), l: (.s | localtime | mktime == $s)}',
    "SELECT o_orderkey, '[' || year(o_orderdate) || ',' || (month(o_orderdate) - 1) || ',' || day(o_orderdate) || ',' || hour(o_orderdate) || ',' || minute(o_orderdate) || ',' || second(o_orderdate) || ',' || dayofweek(o_orderdate) || ',' || (dayofyear(o_orderdate) - 1) || ']' AS g, true AS m, true AS l FROM orders",
)
interpreted(
    "date_strftime",
    "events",
    "event_id; unix_seconds(to_timestamp(ts)) AS s",
    '{event_id, a: (.s | strftime("%Y-%m-%dT%H:%M:%SZ")), b: (.s | todate), c: (.s | gmtime | strftime("%A, %B %d, %Y %j")), d: (.s | todateiso8601), e: (.s | from_unix)}',
    "event_id long, a string, b string, c string, d string, e string",
    "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS a, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS b, strftime(ts, '%A, %B %d, %Y %j') AS c, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS d, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS e FROM events",
)
interpreted(
    "date_parse",
    "events",
    "event_id; date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'Z'\") AS t",
    '{event_id, a: (.t | fromdate), b: (.t | strptime("%Y-%m-%dT%H:%M:%SZ") | mktime), c: (.t | fromdateiso8601), d: (.t | to_unix)}',
    "event_id long, a long, b long, c long, d long",
    "SELECT event_id, floor(epoch(ts))::BIGINT AS a, floor(epoch(ts))::BIGINT AS b, floor(epoch(ts))::BIGINT AS c, floor(epoch(ts))::BIGINT AS d FROM events",
)
interpreted(
    "date_now",
    "nation",
    "n_nationkey",
    "{n_nationkey, a: (now > 1600000000), b: (now | type), c: (now | todate | length)}",
    "n_nationkey int, a boolean, b string, c int",
    "SELECT n_nationkey, true AS a, 'number' AS b, 20 AS c FROM nation",
)

# Streaming events.
interpreted(
    "tostream_events",
    "events",
    "event_id; from_json(props, 'k int') AS p; array(1, 2) AS a",
    "{event_id, n: ([tostream] | length), r: (fromstream(tostream) == .), t: ([1 | truncate_stream([[0], 1], [[1, 0], 2], [[1, 0]], [[1]])] | tojson), l: ([tostream | select(length == 2)] | length)}",
    "event_id long, n int, r boolean, t string, l int",
    "SELECT event_id, 7 AS n, true AS r, '[[[0],2],[[0]]]' AS t, 4 AS l FROM events",
)
interpreted(
    "jsonstream",
    "nation",
    "n_nationkey; array(1, 2) AS a",
    "{n_nationkey, r: ((tojsonstream | fromjsonstream) == .), n: (tojsonstream | length)}",
    "n_nationkey int, r boolean, n int",
    "SELECT n_nationkey, true AS r, 5 AS n FROM nation",
)

# Binding, functions and control.
interpreted(
    "destructuring",
    "nation",
    "n_nationkey; n_name",
    '[.n_nationkey, {b: .n_name, "c": [1, 2]}] | . as [$a, {b: $b, c: [$c, $d]}] | {n_nationkey: $a, s: "\\($b)\\($c + $d)", t: ([[.[0]], 5] | [.[] as [$x] ?// $x | $x] | tojson)}',
    "n_nationkey int, s string, t string",
    "SELECT n_nationkey, n_name || '3' AS s, '[' || n_nationkey || ',5]' AS t FROM nation",
)
interpreted(
    "functions",
    "nation",
    "n_nationkey",
    "def fac: if . <= 1 then 1 else . * (. - 1 | fac) end; def twice(f): f | f; def plus($a; $b): $a + $b; {n_nationkey, a: ([.n_nationkey, 10] | min | fac), b: (.n_nationkey | twice(. + 3)), c: plus(.n_nationkey; 5)}",
    "n_nationkey int, a int, b int, c int",
    "SELECT n_nationkey, factorial(least(n_nationkey, 10)::INT)::INT AS a, n_nationkey + 6 AS b, n_nationkey + 5 AS c FROM nation",
)
interpreted(
    "try_catch",
    "nation",
    "n_nationkey; n_name",
    '{n_nationkey, a: (try error("x") catch .), b: (try (.n_name | .[0]) catch "bad"), c: ([.[] | try tonumber catch "no"] | tojson), d: (try error({a: 1}) catch .a), e: ([.n_nationkey, (1 / 0)?] | length)}',
    "n_nationkey int, a string, b string, c string, d int, e int",
    "SELECT n_nationkey, 'x' AS a, 'bad' AS b, '[' || n_nationkey || ',\"no\"]' AS c, 1 AS d, 1 AS e FROM nation",
)
interpreted(
    "environment",
    "nation",
    "n_nationkey",
    '{n_nationkey, a: ($ENV | type), b: (env | type), c: ($__loc__ | .line), d: (env.DOCFORGE_UNSET == null), e: (builtins | length > 150), f: ([$ARGS.named, $ARGS.positional] | tojson)}',
    "n_nationkey int, a string, b string, c int, d boolean, e boolean, f string",
    "SELECT n_nationkey, 'object' AS a, 'object' AS b, 1 AS c, true AS d, true AS e, '[{},[]]' AS f FROM nation",
)
interpreted(
    "debug_empty",
    "nation",
    "n_nationkey",
    "select(.n_nationkey < 5) | {n_nationkey, a: (debug | .n_nationkey), b: ([empty, 1] | length), c: (stderr | .n_nationkey), d: (null | type)}",
    "n_nationkey int, a int, b int, c int, d string",
    "SELECT n_nationkey, n_nationkey AS a, 1 AS b, n_nationkey AS c, 'null' AS d FROM nation WHERE n_nationkey < 5",
)
add(
    "modules",
    "SELECT n_nationkey, n_nationkey * 2 AS a, n_nationkey + 1 AS b, 7 AS c FROM nation",
    lambda t: typed(interpret(documents(t("nation").select("n_nationkey")), 'import "m" as m; include "n"; import "d" as $d; {n_nationkey, a: (.n_nationkey | m::twice), b: (.n_nationkey | more), c: $d::d[0].x}', modules={"m": "module {v: 1}; def two: 2; def twice: . * two;", "n": "def more: . + 1;", "d": '{"x": 7}'}), "n_nationkey int, a int, b int, c int"),
)
add(
    "modulemeta",
    "SELECT n_nationkey, '{\"v\":1,\"deps\":[]}' AS m FROM nation",
    lambda t: typed(interpret(documents(t("nation").select("n_nationkey")), 'import "m" as m; {n_nationkey, m: ("m" | modulemeta | tojson)}', modules={"m": "module {v: 1}; def f: 1;"}), "n_nationkey int, m string"),
)


# Sources and sinks: a table is written in a format and read again.


def stored(df: DataFrame, write: Callable[..., None], label: str, **options: object) -> str:
    path = scratch(df.sparkSession, label)
    write(df, path, **options)
    return path


def docs_of(t: Callable[[str], DataFrame], source: str, *columns: str) -> DataFrame:
    return documents(t(source).select(*columns))


def read(name: str, sql: str | None, plan: Callable[[SparkSession, Callable[[str], DataFrame]], DataFrame]) -> None:
    assert name not in QUERIES, name
    QUERIES[name] = lambda spark, sf_dir: plan(spark, lambda t: table(spark, sf_dir, t))
    if sql:
        ORACLE_SQL[name] = sql


NATION_SQL = "SELECT n_nationkey, n_name FROM nation"
NATION = "n_nationkey int, n_name string"
read(
    "json_scan",
    "SELECT event_id, event_type FROM events",
    lambda s, t: typed(interpret(R.json_values(s, stored(docs_of(t, "events", "event_id", "event_type"), W.write_lines, "json")).drop("error"), "."), "event_id long, event_type string"),
)
read(
    "json_lines_scan",
    NATION_SQL,
    lambda s, t: typed(interpret(R.json_lines(s, stored(docs_of(t, "nation", "n_nationkey", "n_name"), W.write_lines, "jsonl")), "."), NATION),
)
read(
    "json_seq",
    NATION_SQL,
    lambda s, t: typed(interpret(R.json_seq(s, stored(docs_of(t, "nation", "n_nationkey", "n_name"), W.write_seq, "seq")), "."), NATION),
)
read(
    "raw_text",
    "SELECT n_name || chr(13) AS value FROM nation",
    lambda s, t: R.raw_lines(s, stored(t("nation").select(F.concat("n_name", F.lit("\r")).alias("value")), W.write_lines, "raw")),
)
read(
    "dsv_scan",
    "SELECT p_partkey, p_name || ', \"' || p_brand || '\"' AS text, 2 AS n FROM part",
    lambda s, t: R.delimited(s, stored(t("part").withColumn("text", F.expr("p_name || ', \"' || p_brand || '\"'")).select(W.csv_line("p_partkey", "text").alias("value")), W.write_lines, "csv")).select(F.expr("cast(row[0] as bigint)").alias("p_partkey"), F.expr("row[1]").alias("text"), F.size("row").alias("n")),
)
read(
    "dsv_presets",
    "SELECT n_nationkey, n_name FROM nation",
    lambda s, t: R.delimited(s, stored(t("nation").select(F.concat_ws("\t", F.col("n_nationkey").cast("string"), "n_name").alias("value")), W.write_lines, "tsv"), "tsv", one_line=True).select(F.expr("cast(row[0] as int)").alias("n_nationkey"), F.expr("row[1]").alias("n_name")),
)
read(
    "dsv_access",
    "SELECT 'r0' AS first, 25 AS n",
    lambda s, t: R.cell(R.record(R.delimited(s, stored(s.range(25).coalesce(1).select(F.format_string("r%d|x", "id").alias("value")), W.write_lines, "psv"), "psv"), 0), 0).select(F.col("value").alias("first"), F.lit(25).alias("n")),
)
read(
    "dsv_roundtrip",
    "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    lambda s, t: R.delimited(s, stored(t("documents").select(W.csv_line("doc_id", "text").alias("value")), W.write_lines, "docs")).select(F.expr("cast(row[0] as bigint)").alias("doc_id"), F.expr("row[1]").alias("text")),
)
read(
    "yaml_scan",
    "SELECT p_partkey, p_name, p_size FROM part",
    lambda s, t: typed(interpret(R.yaml_values(s, stored(docs_of(t, "part", "p_partkey", "p_name", "p_size"), W.write_yaml, "yaml")).select("value"), "."), "p_partkey long, p_name string, p_size int"),
)
read(
    "yaml_core_schema",
    "SELECT n_nationkey, '[42,42,42,52,42,0.5,\"1e999\",null,true,\"yes\",\"12\"]' AS v FROM nation",
    lambda s, t: interpret(R.parse_yaml(t("nation").select(F.col("n_name").alias("file"), F.col("n_nationkey").cast("long").alias("file_idx"), F.lit('[0x2A, 0x2a, 0o52, 052, +42, .5, 1e999, ~, True, yes, "12"]').alias("value"))).select("file_idx", "value"), ".").select(F.col("file_idx").cast("int").alias("n_nationkey"), F.col("value").alias("v")),
)
read(
    "yaml_merge_anchors",
    "SELECT n_nationkey, '{\"a\":' || n_nationkey || ',\"b\":\"own\"}' AS v FROM nation",
    lambda s, t: interpret(R.parse_yaml(t("nation").select(F.col("n_name").alias("file"), F.col("n_nationkey").cast("long").alias("file_idx"), F.format_string("base: &x\n  a: %d\n  b: old\nitem:\n  <<: *x\n  b: own\n", "n_nationkey").alias("value"))).select("file_idx", "value"), ".item").select(F.col("file_idx").cast("int").alias("n_nationkey"), F.col("value").alias("v")),
)
read(
    "input_format",
    NATION_SQL,
    lambda s, t: typed(interpret(R.read_values(s, stored(docs_of(t, "nation", "n_nationkey", "n_name"), W.write_lines, "auto"), "json").select("value"), "."), NATION),
)
read(
    "doc_n",
    "SELECT 'b' AS value",
    lambda s, t: R.document(R.parse_yaml(s.createDataFrame([("f", 0, "a\n---\nb\n---\nc")], "file string, file_idx long, value string")), 1).select(F.from_json(F.concat(F.lit("["), "value", F.lit("]")), "array<string>")[0].alias("value")),
)
read(
    "eval_all",
    "SELECT count(*) AS n, sum(n_nationkey)::BIGINT AS total FROM nation",
    lambda s, t: typed(interpret(R.eval_all(R.yaml_values(s, stored(docs_of(t, "nation", "n_nationkey", "n_name"), W.write_yaml, "all"))), "{n: length, total: (map(.n_nationkey) | add)}", mode="yq"), "n long, total long"),
)
read(
    "front_matter",
    "SELECT doc_id, 'id: ' || doc_id || chr(10) AS front, coalesce(text, '') AS body FROM documents",
    lambda s, t: R.front_matter(t("documents").select("doc_id", F.concat(F.lit("---\nid: "), F.col("doc_id").cast("string"), F.lit("\n---\n"), F.coalesce("text", F.lit(""))).alias("value"))).select("doc_id", "front", "body"),
)
read("null_input", "SELECT 3 AS a", lambda s, t: typed(interpret(R.null_input(s), "{a: ([1, 2] | add)}"), "a int"))
read(
    "slurp",
    "SELECT o_custkey, count(*) AS n, sum(o_orderkey)::BIGINT AS total FROM orders GROUP BY 1",
    lambda s, t: typed(interpret(slurp(t("orders").select("o_custkey", "o_orderkey", F.col("o_orderkey").cast("string").alias("value")), ["o_orderkey"], ["o_custkey"]), "{n: length, total: add}"), "n long, total long", ["o_custkey"]),
)
read(
    "arguments",
    "SELECT n_nationkey, n_nationkey + 5 AS a, 'x' AS b, '{\"add\":5,\"name\":\"x\"}' AS named, 'p' AS pos FROM nation",
    lambda s, t: typed(interpret(docs_of(t, "nation", "n_nationkey"), "{n_nationkey, a: (.n_nationkey + $add), b: $name, named: ($ARGS.named | tojson), pos: $ARGS.positional[0]}", variables={"add": 5, "name": "x", "__positional__": ["p"]}), "n_nationkey int, a int, b string, named string, pos string"),
)
read(
    "json_sink",
    "SELECT n_nationkey, '{' || chr(10) || chr(9) || '\"n_name\": \"' || n_name || '\",' || chr(10) || chr(9) || '\"n_nationkey\": ' || n_nationkey || chr(10) || '}' AS value FROM nation",
    lambda s, t: W.render(t("nation").select("n_nationkey", F.to_json(F.struct("n_nationkey", "n_name")).alias("value")), sort_keys=True, tab=True),
)
read(
    "json_sink_ascii",
    "SELECT n_nationkey, '\"\\u00e9' || n_name || '\"' AS value FROM nation",
    lambda s, t: W.render(t("nation").select("n_nationkey", F.concat(F.lit('"é'), "n_name", F.lit('"')).alias("value")), ascii_only=True),
)
read(
    "json_sink_raw",
    "SELECT n_nationkey, n_name AS value FROM nation",
    lambda s, t: W.render(t("nation").select("n_nationkey", F.concat(F.lit('"'), "n_name", F.lit('"')).alias("value")), raw=True),
)
read(
    "json_sink_zero",
    "SELECT n_name || chr(10) AS value FROM nation",
    lambda s, t: s.read.option("lineSep", "\x00").text(stored(t("nation").select(F.concat("n_name", F.lit("\n")).alias("value")), W.write_lines, "zero", sep="\x00")),
)
read(
    "json_sink_joined",
    "SELECT sum(length(n_name))::BIGINT AS n FROM nation",
    lambda s, t: s.read.option("lineSep", "\x00").text(stored(t("nation").select(F.col("n_name").alias("value")), W.write_lines, "joined", sep="")).agg(F.sum(F.length("value")).alias("n")),
)
read(
    "json_sink_colour",
    "SELECT n_nationkey, chr(27) || '[1;39m[' || chr(27) || '[0m' || chr(27) || '[0;39m' || n_nationkey || chr(27) || '[0m' || chr(27) || '[1;39m]' || chr(27) || '[0m' AS value FROM nation",
    lambda s, t: W.render(t("nation").select("n_nationkey", F.format_string("[%d]", "n_nationkey").alias("value")), colour=True),
)
read(
    "preserve_input",
    "SELECT n_nationkey, '[1.50,1e100,' || n_nationkey || '.0]' AS value FROM nation",
    lambda s, t: interpret(t("nation").select("n_nationkey", F.format_string("[1.50,1e100,%d.0]", "n_nationkey").alias("value")), ".", preserve=True).select("n_nationkey", "value"),
)
read(
    "yaml_sink",
    "SELECT n_nationkey, 'n_nationkey: ' || n_nationkey || chr(10) || 'n_name: ' || n_name || chr(10) || 'w:' || chr(10) || '  - 1' || chr(10) || '  - \"2\"' AS value FROM nation",
    lambda s, t: W.to_yaml(t("nation").select("n_nationkey", F.to_json(F.struct("n_nationkey", "n_name", F.expr("from_json('[1,\"2\"]', 'array<variant>')").alias("w"))).alias("value"))),
)
read(
    "yaml_sink_styles",
    "SELECT n_nationkey, 'a: [1, 2]' || chr(10) || 'b: ''x''' AS value FROM nation",
    lambda s, t: W.to_yaml(R.parse_yaml(t("nation").select(F.lit("f").alias("file"), F.col("n_nationkey").cast("long").alias("file_idx"), F.lit("a: [1, 2]\nb: 'x'").alias("value"))).select("file_idx", "value", "places"), places="places").select(F.col("file_idx").cast("int").alias("n_nationkey"), "value"),
)
read(
    "split_files",
    "SELECT n_regionkey::VARCHAR AS name, count(*) AS n FROM nation GROUP BY 1",
    lambda s, t: s.read.schema("value string, name string").text(stored(t("nation").select(F.col("n_regionkey").cast("string").alias("region"), F.col("n_name").alias("value")), W.write_split, "split", name="region")).groupBy("name").agg(F.count(F.lit(1)).alias("n")),
)
read(
    "exit_status",
    "SELECT 0 AS ok, 1 AS falsy, 4 AS none, 5 AS bad",
    lambda s, t: s.createDataFrame([tuple(exit_status(interpret(docs_of(t, "nation", "n_nationkey"), p).withColumn("k", F.lit(1)), ["out_idx"]) for p in (".n_nationkey", "null", "empty", "error"))], "ok int, falsy int, none int, bad int"),
)
read(
    "inputs_stream",
    "SELECT n_regionkey, count(*) AS n, sum(n_nationkey)::BIGINT AS total FROM nation GROUP BY 1",
    lambda s, t: typed(interpret_stream(t("nation").select("n_regionkey", "n_nationkey", F.col("n_nationkey").cast("string").alias("value")), "reduce inputs as $x ({n: 0, total: 0}; .n += 1 | .total += $x)", ["n_regionkey"], ["n_nationkey"], null_input=True), "n long, total long", ["n_regionkey"]),
)
read(
    "input_pairs",
    "SELECT n_regionkey, sum(a * b)::BIGINT AS s FROM (SELECT n_regionkey, n_nationkey AS a, lead(n_nationkey) OVER w AS b, row_number() OVER w AS r FROM nation WINDOW w AS (PARTITION BY n_regionkey ORDER BY n_nationkey)) WHERE r % 2 = 1 GROUP BY 1",
    lambda s, t: interpret_stream(t("nation").select("n_regionkey", "n_nationkey", F.col("n_nationkey").cast("string").alias("value")), ". * (input? // empty)", ["n_regionkey"], ["n_nationkey"]).groupBy("n_regionkey").agg(F.sum(F.col("value").cast("long")).alias("s")),
)
read(
    "load_file",
    "SELECT n_nationkey, 7 AS a FROM nation",
    lambda s, t: typed(interpret(docs_of(t, "nation", "n_nationkey"), '{n_nationkey, a: (load("x.yaml") | .a)}', mode="yq", files={"x.yaml": R.load(s, stored(s.createDataFrame([('{"a": 7}',)], "value string"), W.write_lines, "load"))}), "n_nationkey int, a int"),
)
read(
    "validate_json",
    "SELECT event_id, event_id % 2 = 0 AS valid, CASE WHEN event_id % 2 = 1 THEN 1 END::BIGINT AS line FROM events",
    lambda s, t: R.validate_json(t("events").select("event_id", F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise(F.lit("{\"a\": }")).alias("value"))).select("event_id", "valid", "line"),
)
read(
    "validate_yaml",
    "SELECT n_nationkey, n_nationkey % 2 = 0 AS valid FROM nation",
    lambda s, t: R.validate_yaml(t("nation").select("n_nationkey", F.when(F.col("n_nationkey") % 2 == 0, F.lit("a: 1")).otherwise(F.lit("a: [1")).alias("value"))).select("n_nationkey", "valid"),
)
read(
    "validate_utf8",
    "SELECT n_nationkey, n_nationkey % 2 = 0 AS valid, CASE WHEN n_nationkey % 2 = 1 THEN 2 END::BIGINT AS line, CASE WHEN n_nationkey % 2 = 1 THEN 2 END::BIGINT AS col FROM nation",
    lambda s, t: R.validate_utf8(t("nation").select("n_nationkey", F.when(F.col("n_nationkey") % 2 == 0, F.encode("n_name", "utf-8")).otherwise(F.expr("X'610A62FF'")).alias("value"))).select("n_nationkey", "valid", "line", F.col("column").alias("col")),
)
read(
    "generators_suite",
    "SELECT 51 AS patterns, 510 AS n",
    lambda s, t: functools.reduce(DataFrame.unionAll, [G.generate(s, k, p, 10) for k in ("json", "yaml", "dsv", "text") for p in G.patterns(k)]).agg(F.lit(sum(len(G.patterns(k)) for k in ("json", "yaml", "dsv", "text"))).alias("patterns"), F.count("value").cast("int").alias("n")),
)
read(
    "locate",
    "SELECT event_id, '.k' AS path FROM events",
    lambda s, t: P.locate(t("events").select("event_id", "props", (F.instr("props", ":") + 1).cast("long").alias("o")), "props", offset="o").select("event_id", "path"),
)
read(
    "locate_position",
    "SELECT n_nationkey, '.a[1]' AS path FROM nation",
    lambda s, t: P.locate(t("nation").select("n_nationkey", F.lit('{"a": [1,\n 22]}').alias("j"), F.lit(2).cast("long").alias("l"), F.lit(3).cast("long").alias("c")), "j", line="l", column_number="c").select("n_nationkey", "path"),
)
interpreted(
    "at_offset_position",
    "nation",
    "n_nationkey; n_name",
    "{n_nationkey, a: (at_offset(0) | type), b: at_offset(15), c: (at_position(1; 16))}",
    "n_nationkey int, a string, b int, c int",
    "SELECT n_nationkey, 'object' AS a, n_nationkey AS b, n_nationkey AS c FROM nation",
)
read(
    "value_spans",
    "SELECT event_id, count(*) AS n, max(length(props))::BIGINT AS stop FROM (SELECT event_id, props, unnest([1, 2]) FROM events) GROUP BY event_id",
    lambda s, t: P.value_spans(t("events"), "event_id", "props").groupBy("event_id").agg(F.count(F.lit(1)).alias("n"), F.max("stop").alias("stop")),
)
read(
    "structural_index",
    "SELECT event_id, 3 AS n, instr(props, ':') - 1 AS colon FROM events",
    lambda s, t: P.structural_positions(t("events"), "event_id", "props").groupBy("event_id").agg(F.count(F.lit(1)).cast("int").alias("n"), F.max(F.when(F.col("char") == ":", F.col("pos"))).alias("colon")),
)
read(
    "paths_leaf",
    "SELECT event_id, '[\"' || k || '\"]' AS path, json_extract(props, '$.' || k)::VARCHAR AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)",
    lambda s, t: leaf_events(node_table(t("events"), "event_id", "props"), "event_id"),
)
YAML_NODE = "a: 0x1F # note\nb: &x 'q'\nc: [1, ~]\n"
read(
    "yaml_places",
    "SELECT n_nationkey, '[\"!!int\",\"!!str\",\"!!seq\",\"!!null\"]' AS tags, 'x' AS anchor, '[\"single\",\"flow\",\"\"]' AS styles, '[\"scalar\",\"sequence\",\"mapping\"]' AS kinds, '[1,2,3]' AS lines, 4 AS col, 'note' AS note FROM nation",
    lambda s, t: typed(interpret(R.parse_yaml(t("nation").select(F.lit("f").alias("file"), F.col("n_nationkey").cast("long").alias("file_idx"), F.lit(YAML_NODE).alias("value"))).drop("error"), '{"tags": ([(.a | tag), (.b | tag), (.c | tag), (.c[1] | tag)] | tojson), "anchor": (.b | anchor), "styles": ([(.b | style), (.c | style), (.a | style)] | tojson), "kinds": ([(.a | kind), (.c | kind), kind] | tojson), "lines": ([(.a | line), (.b | line), (.c | line)] | tojson), "col": (.a | column), "note": (.a | line_comment)}', mode="yq"), "tags string, anchor string, styles string, kinds string, lines string, col int, note string", ["file_idx"]).withColumn("n_nationkey", F.col("file_idx").cast("int")).drop("file_idx"),
)
read(
    "document_file_index",
    "SELECT n_nationkey, d AS di, n_nationkey AS fi, 'v' || d AS v FROM nation, (VALUES (0), (1)) x(d)",
    lambda s, t: typed(interpret(R.parse_yaml(t("nation").select(F.col("n_name").alias("file"), F.col("n_nationkey").cast("long").alias("file_idx"), F.lit("v0\n---\nv1").alias("value"))).select("file_idx", "doc_idx", "value"), '{"di": document_index, "fi": file_index, "v": (split_doc | .)}', mode="yq"), "di int, fi int, v string", ["file_idx"]).withColumn("n_nationkey", F.col("file_idx").cast("int")).drop("file_idx"),
)
interpreted(
    "format_yaml_props",
    "nation",
    "n_nationkey; n_name",
    "{\"n_nationkey\": .n_nationkey, \"y\": ({\"a\": [.n_name]} | @yaml), \"p\": ({\"a\": {\"b\": .n_name}, \"c\": [1]} | @props)}",
    "n_nationkey int, y string, p string",
    "SELECT n_nationkey, 'a:' || chr(10) || '  - ' || n_name AS y, 'a.b = ' || n_name || chr(10) || 'c.0 = 1' AS p FROM nation",
    "yq",
)
interpreted(
    "format_dsv",
    "part",
    "p_partkey; p_name",
    "{p_partkey, d: ([.p_partkey, .p_name, null] | @dsv(\"|\"))}",
    "p_partkey long, d string",
    "SELECT p_partkey, p_partkey || '|\"' || p_name || '\"|' AS d FROM part",
)
interpreted(
    "merge_flags",
    "nation",
    "n_nationkey; n_regionkey",
    '{"n_nationkey": .n_nationkey, "a": ([1] *+ [.n_regionkey] | tojson), "b": ({"x": 1} *? {"x": 2, "y": 3} | tojson), "c": ({"x": 1} *n {"x": 2, "y": 3} | tojson), "d": ([{"p": 1}, 2] *d [{"q": .n_regionkey}] | tojson)}',
    "n_nationkey int, a string, b string, c string, d string",
    "SELECT n_nationkey, '[1,' || n_regionkey || ']' AS a, '{\"x\":2}' AS b, '{\"x\":1,\"y\":3}' AS c, '[{\"p\":1,\"q\":' || n_regionkey || '},2]' AS d FROM nation",
    "yq",
)
interpreted(
    "time_zones",
    "events",
    "event_id; date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'Z'\") AS t",
    '{"event_id": .event_id, "a": (.t | tz("EST")), "b": (.t | tz("+02:00")), "c": (.t | tz("UTC"))}',
    "event_id long, a string, b string, c string",
    "SELECT event_id, strftime(ts - INTERVAL 5 HOUR, '%Y-%m-%dT%H:%M:%S-05:00') AS a, strftime(ts + INTERVAL 2 HOUR, '%Y-%m-%dT%H:%M:%S+02:00') AS b, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS c FROM events",
    "yq",
)
interpreted("halt", "nation", "n_nationkey", "{n_nationkey}, halt, error", "n_nationkey int", "SELECT n_nationkey FROM nation")

# Bits, sequences and trees.
BIT = "value > 50"
read(
    "rank_bits",
    "SELECT event_id, count(*) FILTER (value > 50) OVER w AS rank1, count(*) FILTER (NOT value > 50) OVER w AS rank0 FROM events WINDOW w AS (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)",
    lambda s, t: B.ranks(t("events"), [], "event_id", F.expr(BIT)).select("event_id", "rank1", "rank0"),
)
read(
    "select_bits",
    "SELECT row_number() OVER (ORDER BY event_id) - 1 AS k, event_id AS pos FROM events WHERE value > 50",
    lambda s, t: B.select1(t("events"), [], "event_id", F.expr(BIT)).select("k", F.col("event_id").alias("pos")),
)
read(
    "select_zeros",
    "SELECT row_number() OVER (ORDER BY event_id) - 1 AS k, event_id AS pos FROM events WHERE NOT value > 50",
    lambda s, t: B.select0(t("events"), [], "event_id", F.expr(BIT)).select("k", F.col("event_id").alias("pos")),
)
read(
    "bit_counts",
    "SELECT count(*) AS len, count(*) FILTER (value > 50) AS count_ones, count(*) FILTER (NOT value > 50) AS count_zeros FROM events",
    lambda s, t: B.counts(B.words(t("events"), [], "event_id", F.expr(BIT)).crossJoin(F.broadcast(t("events").agg((F.max("event_id") + 1).alias("size")))), [], F.col("size")),
)
read(
    "get_bits",
    "SELECT event_id, value > 50 AS bit FROM events",
    lambda s, t: t("events").withColumn("word_idx", F.floor(F.col("event_id") / 64)).join(B.words(t("events"), [], "event_id", F.expr(BIT)), "word_idx").select("event_id", B.get_bit("word", "event_id").alias("bit")),
)
read(
    "word_operators",
    "SELECT n_nationkey, bit_count(n_nationkey::BIGINT)::INT AS ones, CASE WHEN n_nationkey = 0 THEN 64 ELSE (SELECT min(i) FROM range(0, 6) r(i) WHERE (n_nationkey >> i::INT) & 1 = 1) END::INT AS first FROM nation",
    lambda s, t: t("nation").select("n_nationkey", F.bit_count(F.col("n_nationkey").cast("long")).cast("int").alias("ones"), F.expr("cast(n_nationkey as bigint)").alias("w")).select("n_nationkey", "ones", B.select_in_word("w", "0").cast("int").alias("first")),
)
EF_SQL = "SELECT l_orderkey, count(*) AS n, sum(l_partkey)::BIGINT AS total, min(l_partkey) AS first, max(l_partkey) FILTER (l_partkey <= 100) AS pred, count(*) FILTER (l_partkey < 100) AS seek FROM lineitem GROUP BY 1"
read(
    "elias_fano",
    EF_SQL,
    lambda s, t: B.elias_fano(t("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_partkey")).alias("v")), "l_orderkey", "v").select("l_orderkey", F.size("high").cast("long").alias("n"), F.aggregate(B.ef_values(), F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), B.ef_get("0").alias("first"), B.ef_predecessor("100").alias("pred"), B.ef_seek("100").cast("long").alias("seek")),
)


def parentheses(t: Callable[[str], DataFrame]) -> DataFrame:
    """Customers with their orders and those's lines as balanced parentheses: k, pos, open."""
    lines = t("orders").join(t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("o"), F.row_number().over(Window.partitionBy("o_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")).alias("l"))
    far = 2**62
    ends = [
        (t("customer").select(F.col("c_custkey").alias("k"), F.lit(-1).cast("long").alias("o"), F.lit(-1).cast("long").alias("l")), F.lit(far), F.lit(far)),
        (t("orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("o"), F.lit(-1).cast("long").alias("l")), F.col("o"), F.lit(far)),
        (lines, F.col("o"), F.col("l")),
    ]
    every = [x for d, o, last in ends for x in (d.select("k", F.col("o").cast("long").alias("o"), F.col("l").cast("long").alias("l"), F.lit(True).alias("open")), d.select("k", o.cast("long").alias("o"), last.cast("long").alias("l"), F.lit(False).alias("open")))]
    rows = functools.reduce(DataFrame.unionAll, every)
    return rows.select("k", (F.row_number().over(Window.partitionBy("k").orderBy("o", "l", F.desc("open"))) - 1).cast("long").alias("pos"), "open", "o", "l")


BP_SQL = "WITH c AS (SELECT c_custkey AS k FROM customer), o AS (SELECT o_custkey AS k, o_orderkey, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS n FROM orders WHERE o_custkey IN (SELECT k FROM c)) "
read(
    "bp_tree",
    BP_SQL + "SELECT c.k, 1 + count(o_orderkey) + coalesce(sum(n), 0)::BIGINT AS size, count(o_orderkey) AS children, CASE WHEN coalesce(sum(n), 0) > 0 THEN 2 WHEN count(o_orderkey) > 0 THEN 1 ELSE 0 END::BIGINT AS depth FROM c LEFT JOIN o ON o.k = c.k GROUP BY c.k",
    lambda s, t: B.tree(parentheses(t), ["k"]).groupBy("k").agg(F.max("subtree_size").alias("size"), F.count_if(F.col("parent") == 0).alias("children"), F.max("depth").alias("depth")),
)
read(
    "subtree_size",
    BP_SQL + "SELECT o_orderkey, 1 + n AS size FROM o",
    lambda s, t: (p := parentheses(t)) and B.tree(p, ["k"]).filter("depth = 1").join(p.filter("open AND l = -1 AND o >= 0"), ["k", "pos"]).select(F.col("o").alias("o_orderkey"), F.col("subtree_size").alias("size")),
)
read(
    "bp_navigation",
    BP_SQL + "SELECT c.k, (2 * (1 + count(o_orderkey) + coalesce(sum(n), 0)) - 1)::BIGINT AS close, CASE WHEN count(o_orderkey) > 0 THEN 1 END::BIGINT AS first_child, greatest(count(o_orderkey) - 1, 0)::BIGINT AS siblings FROM c LEFT JOIN o ON o.k = c.k GROUP BY c.k",
    lambda s, t: B.tree(parentheses(t), ["k"]).groupBy("k").agg(F.max(F.when(F.col("pos") == 0, F.col("close"))).alias("close"), F.max(F.when(F.col("pos") == 0, F.col("first_child"))).alias("first_child"), F.count_if((F.col("depth") == 1) & F.col("next_sibling").isNotNull()).alias("siblings")),
)
read(
    "bp_excess",
    BP_SQL + "SELECT c.k, 0 AS last, CASE WHEN coalesce(sum(n), 0) > 0 THEN 3 WHEN count(o_orderkey) > 0 THEN 2 ELSE 1 END::BIGINT AS most, 1 + count(o_orderkey) + coalesce(sum(n), 0)::BIGINT AS opens FROM c LEFT JOIN o ON o.k = c.k GROUP BY c.k",
    lambda s, t: B.excesses(parentheses(t), ["k"]).groupBy("k").agg(F.max_by("excess", "pos").cast("int").alias("last"), F.max("excess").cast("long").alias("most"), F.count_if("open").alias("opens")),
)
read(
    "recurse_tree",
    "SELECT r_regionkey, 1 + count(DISTINCT n_nationkey) + count(c_custkey) AS n FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1",
    lambda s, t: typed(interpret(t("customer").groupBy("c_nationkey").agg(F.collect_list(F.struct(F.col("c_custkey").alias("k"))).alias("c")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"), "right").groupBy("n_regionkey").agg(F.collect_list(F.struct(F.col("n_nationkey").alias("k"), "c")).alias("c")).select(F.to_json(F.struct(F.col("n_regionkey").alias("k"), "c")).alias("value")), "{r_regionkey: .k, n: ([recurse(.c[]?)] | length)}"), "r_regionkey int, n long"),
)
read(
    "line_column",
    "SELECT doc_id, length(h) - length(replace(h, chr(10), '')) + 1 AS line, length(h) - coalesce(nullif(length(h) - instr(reverse(h), chr(10)) + 1, length(h) + 1), 0) + 1 AS col, true AS back, length(text) - length(replace(text, chr(10), '')) + 1 AS lines FROM (SELECT doc_id, text, substr(text, 1, length(text) // 2) AS h FROM documents WHERE text IS NOT NULL)",
    lambda s, t: t("documents").filter("text IS NOT NULL").withColumn("o", F.expr("cast(length(text) div 2 as bigint)")).withColumn("p", B.to_line_column("text", "o")).select("doc_id", F.col("p.line").alias("line"), F.col("p.column").alias("col"), (B.to_offset("text", "p.line", "p.column") == F.col("o")).alias("back"), B.line_count("text").alias("lines")),
)
read(
    "utf8_code_points",
    "SELECT DISTINCT unicode(c) AS point, strlen(c) AS n FROM (SELECT unnest(string_split(text, '')) AS c FROM documents) WHERE c <> ''",
    lambda s, t: t("documents").select(F.explode(F.split("text", "")).alias("c")).filter("c <> ''").distinct().withColumn("b", F.encode("c", "utf-8")).withColumn("point", B.decode_code_point("b")).withColumn("first", F.expr("cast(conv(hex(substring(b, 1, 1)), 16, 10) as int)")).filter(B.encode_code_point("point") == F.col("b")).select("point", B.sequence_length("first").cast("long").alias("n")),
)
