"""Filters, readers, writers and table operators on DataFrames."""

import json
import re

import pytest
from pyspark.sql import functions as F

from docforge.functions import generators
from docforge.operators import bits
from docforge.operators.relational import as_of, top_k, unique_by
from docforge.plans import interpreter, modules, spans
from docforge.plans.engine import compile_filter, exit_status, interpret, interpret_stream, query, slurp
from docforge.plans.interpreter import evaluate
from docforge.plans.nodes import node_table
from docforge.plans.parser import FilterError
from docforge.sources import readers, writers, yaml12
from docforge.streaming.filters import running_fold, stream_filter


def test_compiled_filter_reaches_the_scan(spark, tmp_path):
    spark.range(10).select("id", (F.col("id") * 2).alias("d"), F.lit("x").alias("unused")).write.parquet(str(tmp_path / "t"))
    df = compile_filter(spark.read.parquet(str(tmp_path / "t")), ".[] | select(.id > 7) | {x: .d}")
    assert sorted(r.x for r in df.collect()) == [16, 18]
    plan = df._jdf.queryExecution().toString()
    assert "GreaterThan(id,7)" in plan and "unused" not in plan.split("Physical Plan")[1]


def test_group_by_combines_before_it_sends(spark):
    plan = compile_filter(spark.range(10).select("id", (F.col("id") % 3).alias("k")), "group_by(.k) | map({k: .[0].k, n: length, s: (map(.id) | add)})")
    assert {(r.k, r.n, r.s) for r in plan.collect()} == {(0, 4, 18), (1, 3, 12), (2, 3, 15)}
    assert "partial_sum" in plan._jdf.queryExecution().toString()


def test_interpreted_filter_keeps_outputs_before_errors(spark):
    df = spark.createDataFrame([(1, "[1,2,{}]"), (2, "bad"), (3, None)], "k int, value string")
    got = interpret(df, ".[]? + 1").orderBy("k", "out_idx").collect()
    assert [(r.k, r.value) for r in got if r.error is None] == [(1, "2"), (1, "3")]
    assert sorted({r.k for r in got if r.error is not None}) == [1, 2]


def test_large_ids_beside_nulls_stay(spark):
    big = 9007199254740993
    df = spark.createDataFrame([(big, "1"), (None, "2")], "id long, value string")
    assert {(r.id, r.value) for r in interpret(df, ".").collect()} == {(big, "1"), (None, "2")}


def test_query_falls_back(spark):
    df = spark.createDataFrame([(1, "a b")], "k int, s string")
    assert query(df, '[.s | splits(" ")] | reverse').collect()[0].value == '["b","a"]'
    assert query(df, "{(.s): 1, k}").collect()[0].value == '{"a b":1,"k":1}'


def test_streams_of_inputs(spark):
    df = spark.createDataFrame([("a", k, str(k)) for k in range(4)] + [("b", 0, "7")], "f string, n int, value string")
    rows = interpret_stream(df, "[., input?]", ["f"], ["n"]).collect()
    assert sorted((r.f, r.value) for r in rows) == [("a", "[0,1]"), ("a", "[2,3]"), ("b", "[7]")]
    assert sorted(r.value for r in interpret_stream(df, "[inputs]", ["f"], ["n"], null_input=True).collect()) == ["[0,1,2,3]", "[7]"]
    assert sorted(r.value for r in interpret_stream(df, "[inputs | input_line_number]", ["f"], ["n"], null_input=True).collect()) == ["[1,2,3,4]", "[1]"]
    assert [r.value for r in slurp(df, ["f", "n"]).collect()] == ["[0,1,2,3,7]"]
    assert interpret_stream(df.filter("false"), ".", ["f"], ["n"]).count() == 0


def test_exit_status(spark):
    df = spark.createDataFrame([(1, "1")], "k int, value string")
    assert [exit_status(interpret(df, p), ["out_idx"]) for p in (".", "null", "1, false", "empty", "1, error", "halt")] == [0, 1, 1, 4, 5, 4]


def test_modules(spark, tmp_path):
    (tmp_path / "m.jq").write_text('include "n"; def f: g + 1;')
    (tmp_path / "n.jq").write_text("def g: 41;")
    (tmp_path / "d.json").write_text('{"a":1} 2')
    program = 'import "m" as m; import "d" as $d; [m::f, $d::d[1]]'
    texts = modules.read_modules(program, [str(tmp_path)])
    df = spark.createDataFrame([("null",)], "value string")
    assert interpret(df, program, modules=texts).first().value == "[42,2]"
    assert interpret(df, 'import "m" as m; g', modules=texts).first().error == "g/0 is not defined"
    with pytest.raises(FilterError):
        interpret(df, 'import "x" as x; 1')


def test_readers(spark, tmp_path):
    (tmp_path / "v.json").write_text('{"a":1} [2]\n"x" {')
    got = readers.json_values(spark, str(tmp_path / "v.json")).orderBy("doc_idx").collect()
    assert [r.value for r in got[:3]] == ['{"a":1}', "[2]", '"x"'] and got[3].error
    (tmp_path / "s.json").write_text("\x1e1\n\x1e[2]\n")
    assert [r.value for r in readers.json_seq(spark, str(tmp_path / "s.json")).collect()] == ["1", "[2]"]
    (tmp_path / "d.csv").write_bytes(b'a,"b ""q""\nc",\r\n1,,3\n""\n')
    assert [r.row for r in readers.delimited(spark, str(tmp_path / "d.csv")).orderBy("row_idx").collect()] == [["a", 'b "q"\nc', "\r"], ["1", "", "3"], [""]]
    assert list(readers.records('a,""')) == [["a", ""]] and list(readers.records("x\ty", "\t")) == [["x", "y"]] and list(readers.records("")) == []
    with pytest.raises(ValueError):
        readers.delimited(spark, "x", "é")
    (tmp_path / "y.yaml").write_text("a: 1\n---\n- yes\n---\na: [")
    got = readers.read_values(spark, str(tmp_path / "y.yaml")).orderBy("doc_idx").collect()
    assert [r.value for r in got[:2]] == ['{"a":1}', '["yes"]'] and "line 5" in got[2].error
    checked = readers.validate_json(spark.createDataFrame([("[1",), ("{}",), (None,), ("NaN",)], "value string")).collect()
    assert [(r.valid, r.line) for r in checked] == [(False, 1), (True, None), (False, 1), (False, 1)]
    parts = readers.front_matter(spark.createDataFrame([("---\na: 1\n---\nbody\n",), ("no front",), ("---\n---\n",)], "value string")).collect()
    assert [(r.front, r.body) for r in parts] == [("a: 1\n", "body\n"), (None, "no front"), ("", "")]


def test_yaml_values():
    text = "a: &x {b: 052}\nc: *x\nd: {<<: *x, e: .inf}\nf: !!str 12\ng: |+\n  t\n\n? [1, 2]\n: ~\n"
    value, places = next(yaml12.documents(text))
    assert value == {"a": {"b": 52}, "c": {"b": 52}, "d": {"b": 52, "e": float("inf")}, "f": "12", "g": "t\n\n", "": None}
    assert {tuple(p[0]): p[2] for p in places if p[2]} == {("a",): "x"}
    for v in (1, "x", "", "no", "yes", "null", "a: b", "- x", " x", "x\ny", "x\n", "é\t", [1, [2, []], {}], {"a": {"b": [{"c": 1, "d": [None]}]}}, {"": "", "1": True}, 1.5, -1e300):
        assert next(yaml12.documents(yaml12.emit(v) + "\n"))[0] == v, v
        assert next(yaml12.documents(yaml12.emit(v, 0) + "\n"))[0] == v, v


def test_writers_and_nodes(spark, tmp_path):
    df = spark.createDataFrame([(1, '{"b":[1],"a":"é"}')], "k int, value string")
    assert writers.render(df, sort_keys=True, ascii_only=True).first().value == '{"a":"\\u00e9","b":[1]}'
    assert writers.render(df, tab=True).first().value == '{\n\t"b": [\n\t\t1\n\t],\n\t"a": "é"\n}'
    nodes = node_table(df, "k", "value").orderBy("node_id").collect()
    assert [(json.loads(r.path), r.type) for r in nodes] == [([], "object"), (["b"], "array"), (["b", 0], "number"), (["a"], "string")]
    line = spark.createDataFrame([(1, 'a"b', None, True)], "n int, s string, z string, b boolean").select(writers.csv_line("n", "s", "z", "b").alias("x")).first().x
    assert line == '1,"a""b",,true'


def test_places_in_json():
    data = b' {"a": ["x,]", {"b": null}], "c\\"": -1.5}'
    found = spans.spans(data)
    assert [(p, k, data[a:b].decode()) for p, k, a, b in found[2:]] == [(["a", 0], "string", '"x,]"'), (["a", 1], "object", '{"b": null}'), (["a", 1, "b"], "null", "null"), (['c"'], "number", "-1.5")]
    for path, _, a, b in found:
        assert json.loads(data[a:b]) == next(evaluate("getpath($p)", json.loads(data), {"p": path}))
    for o in range(len(data) + 1):
        assert spans.to_offset(data, *spans.to_line_column(data, o)) == o
    assert spans.to_line_column(b"a\nbc", 9) is None and spans.to_offset(b"a\nbc", 1, 3) is None


def test_bits_and_trees(spark):
    text = "(()(()))()"
    df = spark.createDataFrame([(k, c == "(") for k, c in enumerate(text)], "pos long, open boolean")
    got = {r.pos: (r.close, r.depth, r.parent, r.subtree_size, r.first_child, r.next_sibling) for r in bits.tree(df, []).collect()}
    assert got == {0: (7, 0, None, 4, 1, 8), 1: (2, 1, 0, 1, None, 3), 3: (6, 1, 0, 2, 4, None), 4: (5, 2, 3, 1, None, None), 8: (9, 0, None, 1, None, None)}
    v = [2, 3, 5, 5, 90, 1000]
    ef = bits.elias_fano(spark.createDataFrame([(1, v), (2, [])], "k int, v array<long>"), "k", "v")
    rows = {r.k: r for r in ef.select("k", bits.ef_values().alias("v"), bits.ef_get("4").alias("g"), bits.ef_predecessor("89").alias("p"), bits.ef_predecessor("1").alias("n"), bits.ef_seek("6").alias("s")).collect()}
    assert rows[1][1:] == (v, 90, 5, None, 4) and rows[2].v == []


def test_generators(spark):
    for kind in ("json", "yaml", "dsv", "text"):
        for p in generators.patterns(kind):
            rows = generators.generate(spark, kind, p, 3, 1)
            if p == "comprehensive":
                assert rows.collect() == generators.generate(spark, kind, p, 3, 1).collect() != generators.generate(spark, kind, p, 3, 2).collect()
    made = readers.validate_yaml(generators.generate(spark, "yaml", "explicit-keys", 5)).collect()
    assert all(r.valid for r in made)


def test_streaming(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(2):
        (tmp_path / "in" / f"{k}.json").write_text(f'{{"k":"a","v":{k + 1}}}\n{{"k":"b","v":10}}\n')
    stream = spark.readStream.schema("k string, v int").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    typed = stream_filter(stream, ".[] | select(.v < 10) | {k, w: (.v * 2)}")
    typed.writeStream.format("memory").queryName("typed").trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(r.w for r in spark.table("typed").collect()) == [2, 4]
    folded = running_fold(stream.select("k", F.col("v").cast("string").alias("value")), ["k"], "0", ". + $x")
    folded.writeStream.outputMode("update").format("memory").queryName("folded").trigger(availableNow=True).start().awaitTermination(120)
    assert sorted((r.k, r.n, r.value) for r in spark.table("folded").collect())[1::2] in ([("a", 2, "3"), ("b", 2, "20")],)


def test_relational(spark):
    df = spark.createDataFrame([(1, 3, "x"), (1, 2, "y"), (2, 9, "z")], "k int, t int, v string")
    assert sorted(r.v for r in unique_by(df, ["k"], ["t"]).collect()) == ["y", "z"]
    assert sorted(r.v for r in top_k(df, ["k"], [F.desc("t")], 1).collect()) == ["x", "z"]
    left = spark.createDataFrame([(1, 2), (1, 5), (3, 1)], "k int, t int")
    assert sorted((r.k, r.t, r.right_v) for r in as_of(left, df, ["k"], "t", ["v"]).collect()) == [(1, 2, "y"), (1, 5, "x"), (3, 1, None)]


def test_dates_of_a_plan_are_those_of_the_interpreter(spark):
    """Queries on dates are plans, whatever the session's zone; the zone of TZ is looked up once and not on every row."""
    seconds = [0, -1, 86399, 86400, -86401, 951782399, 951782400, 1425599621, -62135596800, 253402300799, *(k * 86400 * 37 + k * 7919 for k in range(-60, 60))]
    df = spark.createDataFrame([(s, [2024, s % 50 - 25, s % 99, 30, -5, 100]) for s in seconds], "s long, a array<long>")
    program = "{s, g: (.s | gmtime | tojson), m: (.s | gmtime | mktime), l: (.s | localtime | mktime), a: (.a | mktime), t: (.a | tojson)}"
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        plan = {r.value for r in compile_filter(df, program).selectExpr("to_json(struct(*)) AS value").collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert plan == {json.dumps(x, separators=(",", ":")) for r in df.collect() for x in evaluate(program, r.asDict())}
    for bad, why in (([253402300800, [2024]], "gmtime cannot be applied to number (253402300800)"), ([None, [2024]], "null (null) number required"), ([0, [2024]], "mktime requires array of 6 numbers"), ([0, [10000, 2, 3, 4, 5, 6]], "mktime cannot be applied to array ([10000,2,3,...)")):
        with pytest.raises(Exception, match=re.escape(why)):
            compile_filter(spark.createDataFrame([bad], "s long, a array<long>"), "{g: (.s | gmtime), a: (.a | mktime)}").collect()


def test_the_zone_database_is_listed_once(monkeypatch):
    listed = []
    monkeypatch.setattr(interpreter.zoneinfo, "available_timezones", lambda: listed.append(1) or {"Asia/Tokyo"})
    interpreter._zone.cache_clear()
    monkeypatch.setenv("TZ", ":Asia/Tokyo")
    assert [list(evaluate("localtime | mktime", k)) for k in range(3)] == [[k + 9 * 3600] for k in range(3)] and len(listed) == 1
    interpreter._zone.cache_clear()
