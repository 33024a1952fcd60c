"""The operators without SQL against plain brute force, and long texts against uncut ones."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from docforge.llm import common, decontaminate, html_text, jaccard_join, language_id, quality, sentencepiece_codec, sharding, url_filter, words

SCHEMA = "doc_id long, text string, lang string, _may boolean, digest string"
PARTS = {"en": "the and of to in that with from house river small", "de": "der und die nicht mit haus fluss klein auch schon", "fr": "le et les dans que avec maison petit aussi encore"}


def table(spark, texts, langs=None):
    return spark.createDataFrame([(k, t, langs[k] if langs else "en", None, "x") for k, t in enumerate(texts)], SCHEMA)


def sentence(r, lang, n):
    return " ".join(r.choices(PARTS[lang].split(), k=n))


# Language identification.


def exhaustive(p, n):
    """The best set of languages by penalised likelihood, over all sets, with EM run to its end."""
    best = None
    for size in range(1, p.shape[1] + 1):
        for use in itertools.combinations(range(p.shape[1]), size):
            q, share = p[:, use], np.full(size, 1 / size)
            for _ in range(3000):
                part = q * share
                share = (part * (n / part.sum(1))[:, None]).sum(0) / n.sum()
            if share.min() < language_id.LEAST_SHARE and size > 1:
                continue
            value = n @ np.log(q @ share) - 0.5 * np.log(n.sum()) * size
            if best is None or value > best[0]:
                best = (value, use, share)
    return best


def test_mixtures_are_the_best_sets(spark):
    r = random.Random(4)
    langs = [x for x in PARTS for _ in range(8)]
    model = language_id.fit(table(spark, [sentence(r, x, 30) for x in langs], langs))
    texts = [" ".join(sentence(r, x, n) for x, n in mix) for mix in ([("en", 20)], [("de", 3)], [("en", 30), ("de", 30)], [("fr", 40), ("en", 12)], [("en", 20), ("de", 20), ("fr", 20)], [("fr", 1)])]
    names, score, many = language_id.infer(pa.array(texts), model)
    for k, t in enumerate(texts):
        grams, _, _ = language_id.trigrams(pa.array([t]))
        kinds, n = np.unique(grams, return_counts=True)
        _, use, share = exhaustive(np.exp(model.log_p[kinds].astype(float)), n.astype(float))
        assert many[k] == len(use) and names[k] == model.languages[use[int(share.argmax())]], (t, use, share)
        assert score[k] <= share.max() + 0.01


def test_long_text_is_identified_as_its_parts(monkeypatch):
    text = sentence(random.Random(1), "en", 400_000) + " ὈΔΥΣΣΕΎΣ.Σ"
    assert words.is_long(pa.array([text]))
    kinds, times, _ = language_id.trigrams(pa.array([text]))
    monkeypatch.setattr(words, "CHUNK_BYTES", 1 << 30)
    plain, _, _ = language_id.trigrams(pa.array([text]))
    assert (np.bincount(plain, minlength=language_id.BUCKETS)[kinds] == times).all() and times.sum() == len(plain)


# Sharding.


def naive_fit(sizes, capacity, bins):
    room = []
    for s in sizes:
        fits = [k for k in range(len(room)) if room[k] >= s]
        if not fits:
            if len(room) == bins or s > capacity:
                return None
            room.append(capacity)
            fits = [len(room) - 1]
        best = min(fits, key=lambda k: (room[k], k))
        room[best] -= s
    return sorted(capacity - x for x in room)


def test_packing_is_best_fit_decreasing(spark):
    r = random.Random(6)
    texts = ["x" * r.randrange(0, 300) + str(k % 37) for k in range(200)] + [None, None, "", "same"] + ["same"] * 5
    groups = {}
    for t in texts:
        groups[t] = groups.get(t, 0) + len((t or "").encode()) + 8
    sizes = sorted(groups.values(), reverse=True)
    capacity, placed = sharding.least_capacity([(s, sizes.count(s)) for s in sorted(set(sizes), reverse=True)], 6)
    want = naive_fit(sizes, capacity, 6)
    rows = sharding.pack_shards(table(spark, texts), 6).collect()
    assert sorted(sum(x.size for x in rows if x.shard == s) for s in range(6)) == want
    shard_of = {}
    for x in rows:
        shard_of.setdefault(texts[x.doc_id], set()).add(x.shard)
    assert all(len(s) == 1 for s in shard_of.values())
    low = capacity - max(1, capacity // 10_000) - 1
    assert naive_fit(sizes, low, 6) is None or low < -(-sum(sizes) // 6)
    twice = table(spark, texts).union(table(spark, texts))
    assert sharding.pack_shards(twice, 3).count() == 2 * len(texts)


# Decontamination.


def overlaps(doc, item, window=20):
    n = min(window, len(item))
    if not item:
        return False
    need = len(item) if len(item) < decontaminate.SPAN else -(-n * 4 // 5)
    for start in range(-len(item) + 1, len(doc)):
        for a in range(len(item) - n + 1):
            if start + a >= 0 and start + a + n <= len(doc) and sum(item[a + k] == doc[start + a + k] for k in range(n)) >= need:
                return True
    return False


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST_SEEDS, 0])
def test_overlaps_are_all_found(spark, monkeypatch, limit):
    monkeypatch.setattr(decontaminate, "BROADCAST_SEEDS", limit)
    r = random.Random(8)
    vocabulary = [f"w{k}" for k in range(60)]
    items = [r.choices(vocabulary, k=n) for n in (2, 5, 8, 9, 11, 14, 16, 20, 23, 40)] + [[]]
    docs = []
    for _ in range(60):
        item = list(r.choice(items))
        for k in r.sample(range(len(item)), min(len(item), r.choice([0, 1, 2, 4]))):
            item[k] = "other"
        cut = r.choice([0, 0, 3])
        docs.append([*r.choices(vocabulary, k=r.randrange(6)), *item[cut:], *r.choices(vocabulary, k=r.randrange(6))])
    bench = spark.createDataFrame([(k, " ".join(i)) for k, i in enumerate(items)], "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in decontaminate.contaminated(table(spark, [" ".join(d) for d in docs]), bench).collect()}
    assert got == {(d, i) for d in range(len(docs)) for i in range(len(items)) if overlaps(docs[d], items[i])}


# Quality.


def test_score_is_the_average_of_word_vectors():
    r = np.random.default_rng(2)
    model = quality.Model(r.normal(size=quality.BUCKETS), 0.3)
    texts = ["a bb a\tccc", "", None, "é 日本 x" * 3, "long " * 50]
    got = quality.score_texts(pa.array(texts), model)
    for t, s in zip(texts, got, strict=True):
        scores = []
        for w in (t or "").split():
            buckets, _ = quality.features(pa.array([w]))
            scores.append(model.weight[buckets].mean())
        z = np.mean(scores) + model.bias if scores else model.bias
        assert abs(s - 1 / (1 + np.exp(-z))) < 1e-9


def test_long_texts_score_and_hash_as_uncut_ones(monkeypatch):
    r = random.Random(3)
    text = " ".join(r.choices([f"wörd{k}" for k in range(3000)], k=400_000))
    model = quality.Model(np.random.default_rng(1).normal(size=quality.BUCKETS), 0.0)
    cut = quality.score_texts(pa.array([text]), model), next(quality.document_features(pa.array([text]))), next(jaccard_join.shingle_sets(pa.array([text]), 5))
    monkeypatch.setattr(words, "CHUNK_BYTES", 1 << 30)
    whole = quality.score_texts(pa.array([text]), model), next(quality.document_features(pa.array([text]))), next(jaccard_join.shingle_sets(pa.array([text]), 5))
    assert np.allclose(cut[0], whole[0]) and (cut[1][0] == whole[1][0]).all() and np.allclose(cut[1][1], whole[1][1]) and (cut[2] == whole[2]).all()


def test_training_takes_no_more_than_its_bound(spark, monkeypatch):
    monkeypatch.setattr(quality, "SAMPLE_BYTES", 2000)
    docs = table(spark, [f"word{k} " * 30 for k in range(60)] * 2)
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)] * 2, "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality, "train", lambda samples: seen.append(samples) or quality.Model(np.zeros(quality.BUCKETS), 0.0))
    quality.fit(docs.union(docs), labels)
    assert 0 < len(seen[0]) < 48 and sum(a.size * 4 + w.size * 4 for a, w, _ in seen[0]) <= 2000


# Jaccard regions.


def test_regions_join_exactly():
    r = np.random.default_rng(7)
    base = [np.unique(r.integers(0, 2**60, 80).astype(np.uint64)) for _ in range(12)]
    sets = []
    for k in range(240):
        s = base[k % 12].copy()
        s[r.integers(0, len(s), r.integers(0, 12))] = r.integers(0, 2**60, 1)[0]
        sets.append(np.unique(s))
    for percent in (80, 90):
        links = jaccard_join.join_region(np.arange(len(sets)), sets, np.arange(len(sets)), percent)

        def labels(pairs):
            of = list(range(len(sets)))
            for a, b in pairs:
                x, y = of[a], of[b]
                of = [min(x, y) if z in (x, y) else z for z in of]
            return of

        every = [(a, b) for a in range(len(sets)) for b in range(a) if 100 * len(np.intersect1d(sets[a], sets[b])) >= percent * len(np.union1d(sets[a], sets[b]))]
        assert labels(links) == labels(every) and len(links) <= len(sets)


def test_repeated_rows_are_one_node(spark):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(1, text)] * 40 + [(2, text.replace("w59", "x"))] * 40 + [(None, text), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard_join.linked_components(df, 90, 3).collect()
    assert len(got) == len(rows) and {(r.doc_id, r.component_id) for r in got} == {(1, 1), (2, 1), (None, None)}
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in jaccard_join.keep_first(df, 90, 3).collect()) == [(False, 1)] * 40 + [(True, 0)] * 2


def test_shingles_are_written_once(spark, monkeypatch):
    r = random.Random(5)
    base = [[f"w{r.randrange(10**6)}" for _ in range(60)] for _ in range(8)]
    texts = [" ".join([*base[k % 8][:50], *(f"x{k}" for _ in range(k % 3)), *base[k % 8][50:]]) for k in range(64)]
    wide, write = [], jaccard_join.materialise
    monkeypatch.setattr(jaccard_join, "materialise", lambda df, name, **o: wide.extend([name] * ("firsts" in df.columns)) or write(df, name, **o))
    got = {x.doc_id: x.component_id for x in jaccard_join.linked_components(table(spark, texts).union(table(spark, texts)), 90, 3).collect()}
    sets = [{tuple(w[i : i + 3]) for i in range(len(w) - 2)} for w in map(str.split, texts)]
    assert got == {k: min(_reached(sets, k)) for k in range(64)} and wide == ["jaccard-keys"]
    members = write(spark.createDataFrame([(1, 1, 5, 1), (1, 2, 5, 2)], "region long, node long, n_shingles long, label long"), "members")
    more = spark.createDataFrame([(1, b"a"), (2, b"b")], "node long, shingles binary")
    assert sorted((x.region, x.i, x.j, x.node, bytes(x.shingles)) for x in jaccard_join._blocks(members, more).collect()) == [(1, 0, 0, 1, b"a"), (1, 0, 0, 2, b"b")]


def _reached(sets, k):
    found, todo = {k}, [k]
    while todo:
        x = sets[todo.pop()]
        new = {m for m, y in enumerate(sets) if m not in found and 100 * len(x & y) >= 90 * len(x | y)}
        found |= new
        todo += new
    return found


# Pages.


def test_suffix_array_finds_the_repeats(spark):
    r = random.Random(11)
    vocabulary = [f"v{k}" for k in range(25)]
    shared = [" ".join(r.choices(vocabulary, k=n)) for n in (3, 7, 8, 12, 20)]
    streams = [[" ".join(filter(None, (" ".join(r.choices(vocabulary, k=r.randrange(1, 30))), r.choice([*shared, ""])))), r.choice([*shared, f"own {k}"])] for k in range(40)]
    df = spark.createDataFrame([(k % 2, k, 0, s) for k, s in enumerate(streams)], "site long, mark long, n_main long, stream array<string>")
    kept = {}
    for k, s in enumerate(streams):
        for block in s:
            w = block.split(" ")
            found = {("block", block)} | {("run", *w[i : i + 8]) for i in range(len(w) - 7)}
            for u in found:
                kept.setdefault((k % 2, u), set()).add(k)
    times = {}
    for x in html_text.suffix_array(df).collect():
        times.setdefault((x.site, x.unit), set()).add(x.mark)
    want = sorted(sorted(v) for v in kept.values() if len(v) > 1)
    assert sorted(sorted(v) for v in times.values() if len(v) > 1) == want


def test_units_and_keys_are_the_same_behind_a_filter():
    r = random.Random(13)
    vocabulary = ["a", "ab", "\u00fc\u00fc", "eightchr", "ninechars", "x" * 64, "x" * 65, "y" * 3000, *(f"v{k}" for k in range(30))]
    passages = [r.choices(vocabulary, k=n) for n in (1, 7, 8, 9, 25)]
    streams = [[" ".join(r.choices(vocabulary, k=r.randrange(1, 40)) + r.choice(passages)) for _ in range(r.randrange(4))] + [" ".join(r.choice(passages))] * r.randrange(3) for _ in range(30)]
    listed = pa.array([["cut off"], *streams], pa.list_(pa.string())).slice(1)
    of, owner, first, n, _, units, keys = html_text.suffixes(listed, keyed=True)
    flat = [b.split(" ") for s in streams for b in s]
    told = {(b, 0): (len(w), tuple(w[:8]), tuple(w)) for b, w in enumerate(flat)}
    want = sorted([(b, 0, *x) for (b, _), x in told.items()] + [(b, i, 8, tuple(w[i : i + 8]), ()) for b, w in enumerate(flat) for i in range(len(w) - 7)])
    names = {}
    for o, f, k, u, key in zip(owner.tolist(), first.tolist(), n.tolist(), units.tolist(), map(bytes, keys), strict=True):
        names.setdefault((u, key), []).append((o, f, k))
    groups = {}
    for o, f, k, *what in want:
        groups.setdefault(tuple(what), []).append((o, f, k))
    assert sorted(map(sorted, names.values())) == sorted(map(sorted, groups.values())) and len({u for u, _ in names}) == len(names)
    # Behind a filter only what it lets through, with the same units and keys.
    sites = np.arange(30) * 2**40 + 7
    known = np.random.default_rng(1).integers(0, 256, 1 << 10, np.uint8)
    spot = (units ^ sites[of]) & (8 * len(known) - 1)
    there = (known[spot >> 3] >> (spot & 7) & 1).astype(bool)
    for whole, part in zip(html_text.suffixes(listed, keyed=True), html_text.suffixes(listed, sites, known, True), strict=True):
        assert 0 < there.sum() < len(there) and (whole[there] == part).all()
    # Each unit once a stream, where it first occurs.
    got = html_text._distinct(listed, keyed=True)
    assert [(o, u) for o, u in zip(got[0].tolist(), got[1].tolist(), strict=True)] == list(dict.fromkeys(zip(of.tolist(), units.tolist(), strict=True)))


def test_pages_are_read_by_few_passes(spark, monkeypatch):
    passes, over = [], type(spark.range(1)).mapInArrow
    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", lambda df, *x: passes.append(df.columns) or over(df, *x))
    rows = [(k, f"http://h/{k}", f"<nav>menu of the host</nav><article><p>story {k}</p></article>") for k in range(6)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: f"story {k}" for k in range(6)}
    # Parsing, the filter, both passes of the array and its numbers, the units asked for, the texts: main text goes through the workers three times after parsing.
    assert len(passes) == 7 and sum("main" in c and "key" not in c for c in passes) == 3


def test_article_keeps_what_names_only_hint_at(spark):
    page = "<article><p title=it's>one</p><p>don't two</p><p id=\"share-prices\">Share prices rose.</p><p class=related-work>Related work exists.</p><div class=ad>buy</div><p class='comment-list'>nice!</p></article><p>outside</p>"
    nested = "<body class='has-header'><div class='no-sidebar'><nav>menu</nav><main><p>text</p></main><p>after</p></div></body>"
    rows = [(1, "http://h/1", page), (2, "http://h/2", nested), (9007199254740993, None, "<p>big</p>"), (None, "http://h/3", "<p>null</p>")]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "one\n\ndon't two\n\nShare prices rose.\n\nRelated work exists.", 2: "text", 9007199254740993: "big", None: "null"}


def test_main_text_of_other_pages_votes_for_a_repeat(spark):
    line = "a verse that the articles of this host quote word for word"
    footer = "this long line stands below each page of the host as it is"
    rows = [(k, f"http://h/{k}", f"<article><p>{line}</p><p>{' '.join(f'a{k}_{n}' for n in range(20))}</p></article><div>{footer}</div>") for k in range(3)]
    rows += [(k, f"http://h/{k}", f"<p>{line}</p><p>{' '.join(f'b{k}_{n}' for n in range(20))}</p><div>{footer}</div>") for k in (3, 4)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: f"{line}\n\n" + " ".join(f"{'a' if k < 3 else 'b'}{k}_{n}" for n in range(20)) for k in range(5)}


def test_pages_alone_and_none(spark):
    pages = spark.createDataFrame([(9007199254740993, "http://a.net/"), (None, "x")], "page_id long, url string").selectExpr("*", "'z' AS host", "1 AS verdict")
    assert {r.page_id for r in url_filter.filter_urls(pages).collect()} == {9007199254740993, None}
    none = spark.createDataFrame([(1, "u", "h")], "page_id long, url string, html string").filter("false")
    assert url_filter.filter_urls(none).count() == html_text.extract(none).count() == 0


# SentencePiece.


def unigram_model(pieces):
    """A serialised unigram model with byte pieces, written by hand."""

    def varint(n):
        out = b""
        while n > 127:
            out += bytes([n & 127 | 128])
            n >>= 7
        return out + bytes([n])

    def field(k, data):
        return varint(k << 3 | 2) + varint(len(data)) + data

    def piece(text, score, kind):
        return field(1, field(1, text.encode()) + varint(2 << 3 | 5) + np.float32(score).tobytes() + varint(3 << 3) + varint(kind))

    every = [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3), *((f"<0x{b:02X}>", 0, 6) for b in range(256)), *((p, s, 1) for p, s in pieces)]
    trainer = varint(3 << 3) + varint(1) + varint(35 << 3) + varint(1)
    normalizer = field(1, b"identity") + varint(3 << 3) + varint(1) + varint(4 << 3) + varint(0) + varint(5 << 3) + varint(1)
    return b"".join(piece(*p) for p in every) + field(2, trainer) + field(3, normalizer)


@pytest.mark.parametrize("inside", ["", "▁"])
def test_unigram_viterbi_is_the_library(inside):
    sp = pytest.importorskip("sentencepiece")
    r = random.Random(2)
    texts = {"▁", *"abcde", *(r.choice(["", "▁"]) + "".join(r.choices("abcde" + inside, k=r.randrange(1, 6))) for _ in range(120))}
    model = unigram_model([(p, -r.uniform(1, 12)) for p in sorted(texts)])
    library, codec = sp.SentencePieceProcessor(model_proto=model), sentencepiece_codec.Codec(model)
    assert codec.unigram and codec.split == (not inside)
    for _ in range(300):
        t = "".join(r.choices("abcde  éx", k=r.randrange(0, 30)))
        ids = codec.encode([t])[0].tolist()
        assert ids == library.encode(t), t
        assert codec.decode(ids) == t


def test_cuts_encode_as_the_whole():
    with open(common.tokenizer_path("piece_bpe_32k.model"), "rb") as f:
        codec = sentencepiece_codec.Codec(f.read())
    r = random.Random(5)
    for _ in range(60):
        t = "".join(r.choices(["a", "bc ", " ", "  x", "▁", "\n", "é"], k=40))
        parts = list(sentencepiece_codec.cuts(t, r.randrange(1, 12)))
        assert [i for p in parts for i in codec.encode([p])[0].tolist()] == codec.encode([t])[0].tolist(), t


def test_long_text_is_tokenised(spark, monkeypatch):
    df = spark.createDataFrame([(None, "ab cd " * 600_000), (2, "x"), (2, "x")], "doc_id long, text string")
    got = sentencepiece_codec.tokenise(df).collect()
    assert all(r.round_trip for r in got) and sorted(r.doc_id or 0 for r in got) == [0, 2, 2]


# Rows alone: nulls, repeats and clashing columns.


def test_rows_are_judged_alone(spark):
    rows = [(1, "the house of the river", "en"), (None, "der fluss und das haus", "de"), (3, None, "en"), (4, "", None), (1, "the house of the river", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS held_out", "2 AS score", "'x' AS token_ids", "3 AS shard", "4 AS size", "5 AS bytes", "6 AS owner")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    for made in (language_id.identify, lambda d: quality.score(d, labels), sentencepiece_codec.tokenise, lambda d: sharding.pack_shards(d, 2)):
        once, twice = made(docs).collect(), made(docs.union(docs)).collect()
        assert sorted(r.doc_id or 0 for r in once) == [0, 1, 1, 3, 4]
        assert sorted(r.doc_id or 0 for r in twice) == sorted([0, 1, 1, 3, 4] * 2)
    found = {(r.doc_id, r.lang_pred, r.held_out) for r in language_id.identify(docs).collect()}
    assert {(3, "und"), (4, "und")} <= {f[:2] for f in found} and (None, True) in {(f[0], f[2]) for f in found}


def test_small_batches_leave_smaller_settings(spark):
    keys = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
    before = [spark.conf.get(k) for k in keys]
    try:
        spark.conf.set(keys[0], "100")
        spark.conf.set(keys[1], "64k")
        common.small_batches(spark)
        assert [spark.conf.get(k) for k in keys][0] == "100" and spark.conf.get(keys[1]) == "64k"
        spark.conf.set(keys[0], "0")
        spark.conf.set(keys[1], "64m")
        common.small_batches(spark)
        assert int(spark.conf.get(keys[0])) == 2000 and spark.conf.get(keys[1]).startswith(str(768 << 10))
    finally:
        for k, v in zip(keys, before, strict=True):
            spark.conf.set(k, v)
