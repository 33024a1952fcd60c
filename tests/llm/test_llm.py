"""The operators against brute force, on rows with nulls, empty, long, repeated and clashing ones."""

import hashlib
import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from docforge.llm import common, decontaminate, exact_dedup, html_text, jaccard_join, language_id, quality, sentencepiece_codec, sharding, suffix_dedup, url_filter

SCHEMA = "doc_id long, text string, lang string, _may boolean, digest string"


def table(spark, texts):
    return spark.createDataFrame([(k, t, "en", None, "x") for k, t in enumerate(texts)], SCHEMA)


def corpus(seed=1):
    r = random.Random(seed)
    words = ["w%d" % k for k in range(400)]
    texts = [" ".join(r.choices(words, k=r.choice([1, 2, 5, 60, 120]))) for _ in range(40)]
    for t in list(texts[:20]):
        w = t.split()
        w[r.randrange(len(w))] = "changed"
        texts += [t, " ".join(w), t.upper(), texts[30] + " " + t]
    return [*texts, None, "", "  \n", "a" * 500, "a" * 500]


def test_jaccard_join_is_exact(spark):
    texts = corpus()
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) > 2 else {tuple(w)} - {()})
    label = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for a in range(len(texts)):
            for b in range(a):
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]) and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.linked_components(table(spark, texts), 90, 3).collect()}
    assert got == {k: (len(s), c) for k, (s, c) in enumerate(zip(sets, label, strict=True))}


def test_region_chain_is_connected():
    base = np.arange(100, dtype=np.uint64)
    sets = [np.sort(np.concatenate([base[4 * k :], np.arange(1000, 1000 + 4 * k, dtype=np.uint64)])) for k in range(6)]
    links = jaccard_join.join_region(np.arange(6), sets, np.arange(6), 90)
    near = {tuple(sorted(x)) for x in links}
    assert len(near) == 5


def test_parity_is_a_lower_bound():
    r = np.random.default_rng(3)
    for n, m in ((5, 700), (100, 110), (300, 280)):
        a, b = np.unique(r.integers(0, 1000, n).astype(np.uint64)), np.unique(r.integers(0, 1000, m).astype(np.uint64))
        assert jaccard_join.unlike(jaccard_join.parity(a), jaccard_join.parity(b)) <= len(np.setxor1d(a, b))


@pytest.mark.parametrize("most", [suffix_dedup.MERGE, 12, 1])
def test_suffix_dedup_is_exact(spark, monkeypatch, most):
    monkeypatch.setattr(suffix_dedup, "MERGE", most)  # grams with more suffixes are aggregated
    r = random.Random(5)
    passage = "".join(r.choices("abcdé ", k=260))
    texts = ["".join(r.choices("abcd ", k=r.choice([0, 90, 300]))) + r.choice([passage, passage[40:200], ""]) + "".join(r.choices("xyz", k=50)) for _ in range(30)]
    texts += [None, "", "a" * 700, texts[3], passage * 3]
    seen, want = set(), {}
    for k, t in enumerate(texts):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 99):
            if b[i : i + 100] in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(b[i : i + 100])
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        want[k] = (len(b), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest())
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in suffix_dedup.remove_repeats(table(spark, texts)).collect()}
    assert got == want


def test_suffix_dedup_takes_repeated_rows_as_one(spark):
    r = random.Random(9)
    a, b, c = ("".join(r.choices("abcdef ", k=400)) for _ in range(3))
    rows = [(1, a), (2, a[50:300] + b), (2, b), (None, c), (None, c), (None, a), (3, "short"), (3, "short")]
    df = spark.createDataFrame(rows, "doc_id long, text string")

    def found(d):
        return sorted(((x.doc_id is None, x.doc_id or 0), x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in suffix_dedup.remove_repeats(d).collect())

    once = found(df.distinct())
    assert [(x[0][1], x[1], x[2]) for x in once if x[0][1] == 1 or x[0][0] and x[2] == 0] == [(1, 400, 0), (0, 400, 0)]
    assert set(found(df)) == set(once) and len(found(df)) == len(rows)
    twice = found(df.distinct().union(df.distinct()))
    assert twice == sorted([*once, *once])


def test_loser_tree_merges():
    r = np.random.default_rng(2)
    runs, every = [], []
    for _ in range(5):
        keys = sorted(bytes(x) for x in r.integers(0, 2, (20, suffix_dedup.KEY)).astype(np.uint8))
        every += keys
        m = np.frombuffer(b"".join(keys), np.uint8).reshape(-1, suffix_dedup.KEY)
        lcp = suffix_dedup.common_prefixes(m)
        runs.append((lcp.astype(np.uint8), m[np.arange(suffix_dedup.KEY) >= lcp[:, None]].tobytes()))
    got = list(suffix_dedup.LoserTree(runs))
    assert [k for _, k, _ in got] == sorted(every)
    for (_, a, _), (_, b, n) in zip(got, got[1:], strict=False):
        assert a[:n] == b[:n] and (n == len(a) or a[n] != b[n])


def test_exact_dedup(spark):
    texts = ["a b", "ab", None, "", " \x0b", "c", "a  b"]
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(table(spark, texts)).collect()}
    assert got == {0: (6, 3, False), 1: (6, 3, False), 6: (6, 3, True), 2: (4, 3, False), 3: (4, 3, False), 4: (4, 3, True), 5: (5, 1, True)}
    twice = table(spark, texts).union(table(spark, texts))
    assert sum(r.kept for r in exact_dedup.exact_dedup(twice).collect()) == 3
    assert sorted(r.doc_id for r in exact_dedup.keep_one(twice).collect()) == [4, 5, 6]


def test_decontamination(spark):
    item = " ".join(f"t{k}" for k in range(30))
    near = " ".join("x" if k % 6 == 5 else f"t{k}" for k in range(30))
    far = " ".join("x" if k % 2 else f"t{k}" for k in range(30))
    docs = table(spark, [f"before {item.upper()}, after", f"a {near} b", far, None, "", "t1 t2 t3 t4 t5 t6", "say two words now", "two say words"])
    bench = spark.createDataFrame([(1, item), (2, "two words"), (3, None), (4, "")], "item_id long, text string")
    got = decontaminate.contaminated(docs, bench)
    assert sorted((r.doc_id, r.item_id) for r in got.collect()) == [(0, 1), (1, 1), (6, 2)]
    assert sorted(r.doc_id for r in decontaminate.decontaminate(docs, bench).collect()) == [2, 3, 4, 5, 7]


def test_masks_reach_every_allowed_substitution():
    for n in range(decontaminate.SPAN, 21):
        masks = [*decontaminate.MASKS, *([decontaminate.EXTRA] if n < decontaminate.FULL else [])]
        seeds = [{p + o for o in m} for m in masks for p in range(n - m[-1])]
        for changed in itertools.combinations(range(n), n - -(-n * 4 // 5)):
            assert any(s.isdisjoint(changed) for s in seeds), (n, changed)


def test_short_items_with_substitutions(spark):
    docs, items = [], []
    for n, changed in ((8, {3}), (10, {1, 5}), (11, {4, 5}), (15, {3, 8, 9})):
        items.append((n, " ".join(f"i{n}t{k}" for k in range(n))))
        docs.append(f"some words {' '.join('x' if k in changed else f'i{n}t{k}' for k in range(n))} and more")
    got = decontaminate.contaminated(table(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((r.doc_id, r.item_id) for r in got.collect()) == [(0, 8), (1, 10), (2, 11), (3, 15)]


def test_sharding(spark):
    texts = corpus()
    rows = sharding.pack_shards(table(spark, texts), 5).collect()
    sizes = [sum(r.size for r in rows if r.shard == s) for s in range(5)]
    assert len(rows) == len(texts) and max(sizes) - min(sizes) < 0.1 * max(sizes)
    for s in range(5):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    packed, used = sharding.best_fit([(6, 1), (5, 2), (4, 1)], 10)
    assert used == 2 and packed == [[(0, 1)], [(1, 2)], [(0, 1)]]


def test_codec_is_the_library(spark):
    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=common.tokenizer_path("piece_bpe_32k.model"))
    with open(common.tokenizer_path("piece_bpe_32k.model"), "rb") as f:
        codec = sentencepiece_codec.Codec(f.read())
    texts = ["Hello world", " a  b\n\tc", "été 🎉 日本", "", "x" * 300, "    def f():", *[t for t in corpus() if t][:30]]
    ids, begins = codec.encode(texts)
    for k, t in enumerate(texts):
        own = ids[begins[k] : begins[k + 1]].tolist()
        assert own == sp.encode(t)
        assert codec.decode(own) == t
    ids, _ = codec.encode(["▁ marker ▁"])
    assert codec.decode(ids.tolist()) == "▁ marker ▁"
    assert all(r.round_trip for r in sentencepiece_codec.tokenise(table(spark, [None, "", "a", "▁"])).collect())


def test_language(spark):
    texts = ["the cat sat on the mat with the hat"] * 6 + ["der hund und die katze sind nicht hier"] * 6 + [None, "", "123", "the cat sat"]
    docs = spark.createDataFrame([(k, t, ("en" if k < 6 else "de") if k < 12 else None) for k, t in enumerate(texts)], "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(docs).collect()}
    assert [got[k][0] for k in (0, 7, 12, 13, 14, 15)] == ["en", "de", "und", "und", "und", "en"] and got[12][1] == 0
    both = language_id.infer(pa.array([" ".join([texts[0], texts[6]] * 8)]), language_id.fit(docs))
    assert both[2][0] == 2 and 0.3 < both[1][0] < 0.7
    assert sorted(r.doc_id for r in language_id.keep_identified(docs).collect()) == [*range(12), 15]


def test_quality(spark):
    docs = table(spark, [("good plain words here" if k % 2 else "###$$$ %%%junk!!") + f" n{k}" for k in range(80)] + [None, ""])
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(80)] + [(None, 1, 0), (81, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.score(docs, labels).collect()
    assert len(got) == 82 and all(r.predicted == r.doc_id % 2 for r in got if r.doc_id < 80 and r.held_out)
    assert all(r.score == 0.5 for r in quality.score(docs, labels.filter("false")).collect())


def test_urls(spark):
    urls = ["http://a.net/", "http://A.example.NET/en/x?q", "https://net/a", "http://xnet/a", "http://casino.org/", "http://b.org/fr/casino", None, "nothing", "http://a.net", "x://h.com/a.exe#b"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = [(r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages).orderBy("page_id").collect()]
    assert [g[2:] for g in got] == [("net/", "block"), ("example.net/en/", "allow"), ("net/", "block"), (None, "allow"), (None, "block"), ("org/fr/", "allow"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "block")]
    assert got[1][:2] == ("a.example.net", "/en/x") and got[6][:2] == ("", "")


def test_html(spark):
    page = "<html><head><title>T</title></head><body><nav><ul><li>m</li></ul></nav><div class=ad>buy</div><article><h1>A &amp; B</h1><p>one<b> two</b>\n three<p>four<script>var a='</p>'</script><form>f</form></article><div id='comments'><p>c</p></div><footer>x</footer>"
    boiler = "<body><p>this very long line of boilerplate is on each page here</p><p>own %d words</p>"
    pages = spark.createDataFrame([(1, "http://h/1", page), (2, "http://h/2", boiler % 2), (3, "http://h/3", boiler % 3), (4, None, None), (5, "u", "")], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    assert got == {1: "A & B\n\none two three\n\nfour", 2: "own 2 words", 3: "own 3 words", 4: "", 5: ""}


def test_html_marked_by_the_parser(spark):
    page = "<body>%s<p>this very long line of boilerplate is on each page here</p><p>own %d words</p>"
    marks = ["<!-- <article> -->", "<div class=comment><article>c</article></div>", "<script>'<main>'</script>"]
    pages = spark.createDataFrame([(k, f"http://h/{k}", page % (m, k)) for k, m in enumerate(marks)], "page_id long, url string, html string")
    assert {r.page_id: (r.text, r.n_chars) for r in html_text.extract(pages).collect()} == {k: (f"own {k} words", 11) for k in range(3)}


def test_html_keeps_copies_and_quotations(spark):
    def words(name, n):
        return " ".join(f"{name}{k}" for k in range(n))

    quote, story = words("q", 12), [words(f"s{k}_", 40) for k in range(4)]
    texts = {(1, "copy"): story, (2, "copy"): story, (3, "near"): story, (4, "near"): [*story, "edited today"]}
    texts |= {(k, "quote"): [f"{words(f'a{k}_', 20)} {quote} {words(f'b{k}_', 20)}"] for k in (5, 6)}
    texts |= {(k, None): [words("z", 20), words(f"c{k}_", 20)] for k in (7, 8)}
    menu = {(k, "menu"): ["home about", words(f"d{k}_", 20)] for k in range(10, 15)}
    rows = [(k, h and f"http://{h}/{k}", "".join(f"<p>{t}</p>" for t in p)) for (k, h), p in (texts | menu).items()]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: "\n\n".join(p) for (k, _), p in texts.items()} | {k: p[1] for (k, _), p in menu.items()}


def test_html_repeats_on_a_large_host(spark):
    line = "<p>passage %d stands word for word on just these two pages here</p>"
    rows = [(k, f"http://big/{k}", (line % (k // 2)) + f"<p>own {k}</p>") for k in range(1200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    assert got == {k: f"own {k}" for k in range(1200)}


def test_empty_tables(spark):
    none = table(spark, ["x"]).filter("false")
    bench = spark.createDataFrame([(1, "a")], "item_id long, text string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    for df in (language_id.identify(none), sharding.pack_shards(none), jaccard_join.linked_components(none), exact_dedup.exact_dedup(none), decontaminate.contaminated(none, bench), quality.score(none, labels), suffix_dedup.remove_repeats(none), sentencepiece_codec.tokenise(none)):
        assert df.count() == 0
