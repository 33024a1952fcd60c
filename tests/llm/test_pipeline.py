"""The pipeline against plain brute force, and its stages on unusual tables."""

import os
import random

import pyarrow as pa
import pytest

import corpus_pipeline
from docforge.llm import common, language_id

WORDS = {"en": "the and of to in that with from house river small town near old new road".split(), "de": "der und die nicht mit haus fluss klein auch schon weg neu alt stadt".split()}
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    r = random.Random(3)

    def text(lang, n):
        return " ".join(r.choice(WORDS[lang]) + str(r.randrange(40)) * (r.random() < 0.4) for _ in range(n))

    rows = [(k, text(lang, 40), lang) for k, lang in enumerate(["en", "de"] * 16)]
    copies = [(100 + k, rows[k][1].replace(" ", "  ", 3), "en") for k in range(0, 12, 3)]
    near = [(200 + k, rows[k][1] + " extra words", None) for k in range(1, 12, 4)]
    item = text("en", 24)
    leaks = [(300, f"{text('en', 20)} {item} {text('en', 20)}", "en"), (301, f"{text('de', 30)} {' '.join('x' if k % 8 == 3 else w for k, w in enumerate(item.split()))}", "de")]
    odd = [(400, None, "en"), (401, "", None), (402, "123 456", "en"), (403, "the", "en"), (404, "the", "de"), (None, "the house near the old road", "en")]
    every = [*rows, *copies, *near, *leaks, *odd]
    return [(i, t, lang, "web", None if t is None else len(t)) for i, t, lang in every], [(1, item), (2, None)]


def shingles(t, n=5):
    w = (t or "").lower().split()
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} - {()}


def brute(rows, items, model):
    names, score, many = language_id.infer(pa.array([r[1] for r in rows], pa.string()), model)
    rows = [r for r, s, m in zip(rows, score, many, strict=True) if m > 0 and s >= 0.5]
    best = {}
    for r in rows:
        key = "".join((r[1] or "").split())
        rank = (-len(r[1] or ""), r[0] is None, r[0])
        if key not in best or rank < best[key][0]:
            best[key] = (rank, r)
    rows = [r for _, r in best.values()]
    sets = [shingles(r[1]) for r in rows]
    of = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if rows[a][0] is not None and rows[b][0] is not None and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = of[a], of[b]
                of = [min(x, y) if z in (x, y) else z for z in of]
    groups = {}
    for r, g in zip(rows, of, strict=True):
        groups.setdefault(g, []).append(r)
    rows = [r for g in groups.values() for r in ([min(g)] if len(g) > 1 else g)]

    def tokens(t):
        return "".join(c.lower() if c.isalnum() else " " for c in t or "").split()

    def leaks(t):
        d = tokens(t)
        for _, item in items:
            i = tokens(item)
            n = min(20, len(i))
            if n and any(sum(i[a + k] == d[s + k] for k in range(n)) >= 0.8 * n for a in range(len(i) - n + 1) for s in range(len(d) - n + 1)):
                return True
        return False

    return [r for r in rows if r[0] is None or not leaks(r[1])]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("corpus")
    docs, items = corpus()
    spark.createDataFrame(docs, COLUMNS).coalesce(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_pipeline_is_brute_force(spark, folder):
    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=common.tokenizer_path("piece_bpe_32k.model"))
    docs, items = corpus()
    model = language_id.fit(spark.createDataFrame(docs, COLUMNS))
    want = sorted(((r[0] is None, r[0] or 0), sp.encode(r[1])) for r in brute(docs, items, model))
    got = corpus_pipeline.run(spark, folder).collect()
    assert sorted(((r.doc_id is None, r.doc_id or 0), r.token_ids) for r in got) == want
    assert all(r.round_trip and r.n_tokens == len(r.token_ids) for r in got)
    kept = {r.doc_id for r in got}
    assert {300, 301}.isdisjoint(kept) and {400, 401, 402}.isdisjoint(kept) and 403 in kept and None in kept


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_unusual_tables(spark, folder, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    none = stage(spark, docs.filter("false"), folder)
    assert none.count() == 0 and (name == "tokens" or none.columns == docs.columns)
    odd = docs.filter("doc_id >= 400 OR doc_id IS NULL").selectExpr("*", "1 AS _may", "'x' AS digest", "2 AS bit", "array(3) AS spans", "4 AS n")
    out = stage(spark, odd.union(odd), folder)
    assert name == "tokens" or out.columns == odd.columns
    # Each twice: 400 to 404 and a row without an id; two hold the same word.
    assert out.count() == {"language": 6, "exact": 4, "near": 12 - 2, "benchmark": 12, "tokens": 12}[name]


def test_stage_names_and_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "exact", "near", "benchmark", "tokens"]
    assert os.path.basename(corpus_pipeline.__file__) == "corpus_pipeline.py"
