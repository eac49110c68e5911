"""The llm operators against brute force, and over awkward rows.

Every operator gets a table with null ids, null, empty and very long texts, repeated
rows, ties and extra columns whose names clash with those used inside.
"""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecspark.llm import _tokens, _words, ann, components, decontam, html_extract, minhash, packing, pii, quality, substring, tokenbin, warc

CLASH = ["id", "tk", "k", "h", "key", "score", "bands", "label", "piece", "text_", "host", "part", "digest", "first", "at"]
WORDS = [f"w{i}" for i in range(400)]


def prose(seed, n):
    r = np.random.default_rng(seed)
    return " ".join(r.choice(WORDS, n))


def table(spark, rows, schema):
    df = spark.createDataFrame(rows, schema)
    return df.withColumns({c: F.lit(i) for i, c in enumerate(CLASH)})


@pytest.fixture(scope="module")
def awkward(spark):
    long_ = prose(1, 60_000)
    near = prose(2, 300)
    rows = [
        (None, None), (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "one"), (5, "one"), (6, long_), (7, "x" * 300_000),
        (8, near), (9, near + " tail"), (None, near), (10, "z@"), (11, prose(3, 100) + " " + prose(4, 50)), (12, prose(5, 60) + " " + prose(4, 50)),
        (13, "日本語 テキスト <|endoftext|> 👍🏽 İß"), (14, "mail a.b@c.de and +1 (212) 555-0100, 4532015112830366, 10.0.0.1 or 10.0.0.999"),
    ]
    return table(spark, rows, "doc_id long, text string")


@pytest.fixture(scope="module")
def none(awkward):
    return awkward.filter("false")


def by_row(df):
    return sorted(map(repr, df.collect()))


def test_rolling_equals_direct():
    h = np.arange(50, dtype=np.uint64) * np.uint64(77)
    for width in (1, 2, 5, 12, 35):
        a = _words.rolling(h, width)
        assert len(a) == 51 - width
        assert a[3] == _words.rolling(h[3 : 3 + width], width)[0] and len(set(a.tolist())) == len(a)
    starts, docs = _words.within(np.array([3, 0, 1, 4]), 2)
    assert starts.tolist() == [0, 1, 4, 5, 6] and docs.tolist() == [0, 0, 3, 3, 3]


@pytest.mark.parametrize("name", list(_tokens.PATTERNS))
def test_tokens_are_the_library_s(awkward, name):
    enc = _tokens.Encoder(_tokens.tokenizer_path(name))
    texts = [r.text or "" for r in awkward.collect()] + ["a  b\n\n c\t", "don't 'S x'll ?!'s", " ½ ² 12", "áe ſK", "\x0b\x1c a", "it’s — “q”…", "  x"]
    for _ in range(2):
        for text, ids in zip(texts, enc.encode_many(texts)):
            assert ids.tolist() == enc.tok.encode(text, add_special_tokens=False).ids


# 1


def test_html_blocks_and_roles():
    page = """<!doctype html><html><head><title>t</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav>menu</nav>
    <div class="cookie-notice">We use</div><main><article><h1>Head &amp; more</h1><p>One<br>two <b>three</b><p>Four&nbsp; five
    <aside>side</aside><form><input>Send</form><script>var a="</p>";</script><!-- <p>no</p> --><ul><li>a<li>b</ul><div class="ad">Buy</div></article>
    <section id="comments"><p>First!</p></section></main><footer>&copy;</footer></body></html>"""
    assert html_extract.extract_block([page], html_extract.WrapperParams()) == ["Head & more\n\nOne two three\n\nFour five\n\na\n\nb"]
    assert html_extract.extract_block(["", "<p>cut off <b", "plain", "<article><p>x"], html_extract.WrapperParams()) == ["", "cut off", "plain", "x"]


def test_html_template_is_induced():
    pages = [f"<body><div><p>Same banner text</p><div><p>{prose(i, 30)}</p><p>{prose(i + 100, 20)}</p></div><p>Same foot</p></div></body>" for i in range(6)]
    got = html_extract.extract_block(pages, html_extract.WrapperParams())
    assert got == [f"{prose(i, 30)}\n\n{prose(i + 100, 20)}" for i in range(6)]
    copies = [pages[0]] * 6  # one page, not a template
    assert all("Same banner text" in t and prose(0, 30) in t for t in html_extract.extract_block(copies, html_extract.WrapperParams()))


def test_html_names_do_not_cut_articles():
    whole = prose(1, 40)
    one = lambda page: html_extract.extract_block([page], html_extract.WrapperParams())[0]
    assert one(f'<body><nav><a>x</a></nav><article><p class="notice-period">{whole}</p><div class="related-work">{whole}</div><div class="ad">Buy</div></article></body>') == f"{whole}\n\n{whole}"
    assert one(f'<main><p>{whole}</p><p>{whole}</p></main><article class="teaser"><p>More</p></article>') == f"{whole}\n\n{whole}"


def test_html_deep_pages():
    pages = [f"<body><nav><a>x</a></nav>{'<div>' * (1500 + 7 * i)}<p>{prose(i, 30)}</p><p>{prose(i + 9, 30)}</p>" for i in range(6)]
    assert html_extract.extract_block(pages, html_extract.WrapperParams()) == [f"{prose(i, 30)}\n\n{prose(i + 9, 30)}" for i in range(6)]


def test_induction_alone_finds_the_articles_of_sample_pages():
    """All sample pages: with names, every article; with all names hidden, nearly every one, and fewer without induction."""
    import pyarrow.parquet as pq

    hosts = {}
    for r in pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist():
        hosts.setdefault(r["url"].split("/")[2], []).append(r["html"])
    wants = {}
    for host, pages in hosts.items():
        for page in pages:
            inner = re.sub(r"<(?!/?(?:h1|p|li|br)\b)[^>]*>", "", re.search(r"(?s)<article>(.*?)(?:</article>|\Z)", page)[1])
            inner = re.sub(r"<[^>]*\Z", "", inner)
            lines = [html_extract._html.unescape(re.sub(r"<br[^>]*>", " ", x)) for x in re.split(r"</?(?:h1|p|li)\b[^>]*>", inner)]
            wants[page] = "\n\n".join(" ".join(x.split()) for x in lines if x.split())
    right = {}
    for mode in ({}, {"names": False}, {"names": False, "least_pages": 10**9}):
        p = html_extract.WrapperParams(**mode)
        right[len(mode)] = sum(t == wants[x] for pages in hosts.values() if len(pages) >= 4 for x, t in zip(pages, html_extract.extract_block(pages, p)))
    many = sum(len(pages) for pages in hosts.values() if len(pages) >= 4)
    assert right[0] == many and right[1] >= 0.95 * many and right[2] < right[1]


def test_simple_tree_matching_is_the_best_alignment():
    def brute(a, b):
        if a.key != b.key:
            return 0
        x, y = a.elements(), b.elements()
        m = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, p in enumerate(x):
            for j, q in enumerate(y):
                m[i + 1][j + 1] = max(m[i][j + 1], m[i + 1][j], m[i][j] + brute(p, q))
        return 1 + m[-1][-1]

    r = np.random.default_rng(0)

    def tree(depth):
        tag = "abc"[r.integers(3)] if depth < 3 else "d"
        inner = "".join(tree(depth - 1) for _ in range(r.integers(0, 5))) if depth else "t"
        return f"<x{tag}>{inner}</x{tag}>"

    for _ in range(40):
        shapes = html_extract.Shapes()
        a, b = html_extract.parse(tree(3)), html_extract.parse(tree(3))
        shapes.label(a), shapes.label(b)
        assert shapes.matched(a, b) == brute(a, b) == len(shapes.align(a, b))


def test_html_rows(spark):
    rows = [(1, "http://a.com/x", "<article><p>Hi</p></article>"), (1, "http://a.com/x", "<article><p>Hi</p></article>"), (None, None, None), (2, "bad url", ""), (3, "http://b.com", "<p>" * 3000 + "deep")]
    pages = table(spark, rows, "page_id long, url string, html string")
    got = {(r.page_id, r.url, r.text, r.n_chars) for r in html_extract.extract(pages).collect()}
    assert got == {(1, "http://a.com/x", "Hi", 2), (None, None, "", 0), (2, "bad url", "", 0), (3, "http://b.com", "deep", 4)}
    assert html_extract.extract(pages).count() == 5 and html_extract.extract(pages.filter("false")).count() == 0


# 2


def test_quality_separates_and_ignores_labels_of_the_fold(spark, awkward):
    rows = [(i, prose(i, 80).capitalize() + "." if i % 3 else " ### ".join(WORDS[i % 50 : i % 50 + 40]).upper() + " !!", "en", "s") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(0, 900, 2)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    got = quality.scores(docs, model).collect()
    assert np.mean([r.predicted == (r.doc_id % 3 > 0) for r in got if r.held_out]) > 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    flipped = labels.withColumn("quality", F.when(quality.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert np.allclose(quality.fit(docs, flipped).weights, model.weights)
    odd = quality.scores(awkward, model)
    assert odd.count() == awkward.count() and odd.filter("score IS NULL OR isnan(score)").count() == 0
    assert quality.keep(awkward, model).columns == awkward.columns
    assert quality.scores(awkward.filter("false"), quality.fit(awkward, labels.filter("false"))).count() == 0


# 3


def test_quality_of_real_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality.scores(docs, quality.fit(docs, labels)).join(labels, "doc_id").filter("held_out").collect()
    assert len(got) > 50 and np.mean([r.predicted == r.quality for r in got]) >= 0.95


def test_repeats_do_not_fill_the_quality_sample(spark):
    rows = [(1, "same text of a row")] * 3000 + [(i, prose(i, 30)) for i in range(2, 60)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, 1, 0) for i in range(2, 40)], "doc_id long, quality int, toxic int")
    seen = []
    import vecspark.llm.quality as q

    rows_, q._rows = q._rows, lambda df: seen.append(df.count()) or rows_(df)
    try:
        q.fit(docs, labels)
    finally:
        q._rows = rows_
    assert seen[0] <= 59


def test_neighbours_equal_brute_force(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(1500, 8)).astype(np.float32)
    x[100:600] = x[100]  # one hot vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(0, x[0].tolist()), (9000, None), (9100, [0.0] * 8), (9200, [float("nan")] * 8), (9300, [1.0, None] * 4), (None, x[1].tolist()), (9400, [1.0]), (9500, [float("inf")] * 8)]
    df = table(spark, rows, "vec_id long, embedding array<float>")
    got = {}
    for row in ann.search(df, "id % 100 = 0", ann.AnnParams(vectors_per_list=50, list_rows=100, list_queries=4)).collect():
        got.setdefault(row.query_id, []).append((row["rank"], row.vec_id, row.score))
    hits = total = 0
    y = x.astype(np.float64)
    for q in range(0, 1500, 100):
        d = np.sqrt(((y - y[q]) ** 2).sum(1))
        order = [i for i in np.lexsort((np.arange(1500), d)) if i != q][:10]
        mine = sorted(got[q])
        assert [m[0] for m in mine] == list(range(1, 11)) and all(m[2] == d[m[1]] for m in mine)
        hits += len({m[1] for m in mine} & set(order))
        total += 10
    assert len(got) == 15 and hits / total >= 0.95
    assert ann.search(df.filter("false"), "id % 100 = 0").count() == 0
    assert ann.search(df.filter("vec_id < 3"), "id = 0").count() == 2


# 4


def test_loser_tree_merges():
    r = np.random.default_rng(1)
    for k in range(12):
        runs = [sorted(r.integers(0, 50, r.integers(0, 9)).tolist()) for _ in range(k)]
        assert list(warc.LoserTree([iter(x) for x in runs])) == sorted(v for x in runs for v in x)


def test_archives_give_pages_back(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK", 3)
    monkeypatch.setattr(warc, "FAN_IN", 2)
    body = "é" * 60
    rows = [(i, f"http://www.h{i % 3}.com/{i}", body if i % 2 else f"page {i}") for i in range(30, 0, -1)]
    rows += [(40, None, None), (41, "http://x/\r\ny", ""), (42, "u", "s" * 99), (43, "u", "s" * 99), (None, "u", body), (1, "http://www.h1.com/1", body)]
    pages = table(spark, rows, "page_id long, url string, html string").repartition(5)
    found = warc.write_and_read(pages)
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        again = len(raw) >= 100 and (i is None or i > 1)
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", 1 if again else None))
    got = found.collect()
    assert sorted(map(repr, want)) == sorted(repr((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got)
    order = [(r.urlkey, r.stamp) for r in sorted(got, key=lambda r: (r.part, r.pos))]
    assert order == sorted(order)
    assert warc.write_and_read(pages.filter("false")).count() == 0


def test_merge_passes_are_cut_into_ranges(spark, monkeypatch):
    monkeypatch.setattr(warc, "FAN_IN", 2)
    monkeypatch.setattr(warc, "BLOCK", 3)
    monkeypatch.setattr(warc, "INDEXED", 2)
    folder, r, want, runs = warc.scratch(spark, "runs"), np.random.default_rng(1), [], []
    for i in range(7):
        entries = sorted([f"k{r.integers(30)}", f"{r.integers(10**6):014d}", int(r.integers(99)), "f", j, 1] for j in range(int(r.integers(0, 40))))
        want += entries
        runs.append(("f", f"{folder}/{i}.run", warc.write_run(f"{folder}/{i}.run", iter(entries))))
    cuts = warc._cuts(spark, runs, 10)
    assert len(cuts) > 4
    ranges = warc._pass(spark, folder, [(0, len(cuts) - 1, [x for _, x, _ in runs])], cuts)
    assert len(ranges) > 1 and all(len(x) == 4 for *_, x in ranges)  # seven runs, two at a time, in several ranges
    got = sorted(warc.merge(spark, folder, runs, 10).collect(), key=lambda x: (x.part, x.pos))
    assert [(x.urlkey, x.stamp, x.page_id, x.offset) for x in got] == [(*e[:3], e[4]) for e in sorted(want)]


# 5


def plain_report(docs, items):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    out = []
    for i, text in docs:
        w = pattern.findall(lower(text))
        hit, found = set(), set()
        for item, t in items:
            b = pattern.findall(lower(t))
            for win in {tuple(b[a : a + min(13, len(b))]) for a in range(max(1, len(b) - 12))} if b else ():
                for a in range(len(w) - len(win) + 1):
                    if tuple(w[a : a + len(win)]) == win:
                        hit |= set(range(a, a + len(win)))
                        found |= {item} - {None}
        names = ",".join(sorted(map(str, found)))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


@pytest.mark.parametrize("shard_bytes", [1 << 20, 150])
def test_decontamination_equals_brute_force(spark, shard_bytes):
    r = np.random.default_rng(8)
    vocab = ["a", "B", "é", "1", "c-d", "E.", "ß2"]
    text = lambda n: " ".join(r.choice(vocab, n))
    items = [(i, text(n)) for i, n in enumerate([1, 2, 3, 5, 12, 13, 14, 30, 30])] + [(20, None), (21, ""), (22, "..."), (None, text(4)), (2, text(2)), (30, "aBc, " * 20)]
    docs = [(i, text(n)) for i, n in enumerate([0, 1, 2, 12, 13, 40, 200, 400])] + [(50, None), (None, items[7][1]), (51, "x y " + items[5][1].upper() + " z" * 400), (51, "abc " * 60), (51, "abc " * 60)]
    d, b = table(spark, docs, "doc_id long, text string"), table(spark, items, "item_id long, text string")
    got = decontam.report(d, b, shard_bytes=shard_bytes).drop("spans")
    assert sorted(map(repr, plain_report(docs, items))) == sorted(repr(tuple(x)) for x in got.collect())
    kept = decontam.clean(d, b, shard_bytes=shard_bytes)
    whole = decontam.report(d, b.filter("length(text) > 30"), shard_bytes=shard_bytes)  # items with a window of 13 words
    gone = {i for i, x in enumerate(plain_report(docs, items)) if x[5]} | {i for i, x in enumerate(plain_report(docs, [x for x in items if len(decontam.words((x[1] or "").encode())) >= 13])) if x[2]}
    assert kept.columns == d.columns and kept.count() == len(docs) - len(gone) and whole.count() == len(docs)
    assert decontam.report(d.filter("false"), b).count() == 0 and decontam.report(d, b.filter("false")).filter("n_hit > 0").count() == 0


# 6


def plain_classes(docs, threshold=0.8):
    sets = []
    for _, t in docs:
        w = (t or "").split()
        n = min(5, len(w))
        sets.append(Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else None)

    def jp(a, b):
        return sum(1 / sum(max(a.get(e, 0) / a[x], b.get(e, 0) / b[x]) for e in a.keys() | b.keys()) for x in a.keys() & b.keys())

    root = list(range(len(docs)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if (docs[i][1] or "") == (docs[j][1] or "") or sets[i] and sets[j] and sets[i].keys() & sets[j].keys() and jp(sets[i], sets[j]) >= threshold:
                root[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    return sorted(repr((d, least.get(top(i)))) for i, (d, _) in enumerate(docs))


def edited(text, seed, n):
    r, w = np.random.default_rng(seed), text.split()
    for i in r.choice(len(w), n, replace=False):
        w[i] = f"edit{seed}"
    return " ".join(w)


def test_classes_equal_brute_force(spark):
    base = [prose(i, 200) for i in range(6)]
    docs = [(i, t) for i, t in enumerate(base)]
    docs += [(100 + i, edited(base[i % 6], i, n)) for i, n in enumerate([1, 2, 3, 4, 2, 1, 8, 12, 20, 2, 3])]
    docs += [(200 + i, edited(base[0], 50 + i, 4)) for i in range(30)]  # near the base, not near one another
    docs += [(300, None), (301, ""), (302, " "), (303, "a b"), (304, "a b"), (305, "a  b"), (None, base[3]), (100, docs[6][1]), (306, (base[5] + " ") * 4)]
    d = table(spark, docs, "doc_id long, text string")
    got = minhash.classes(d)
    assert sorted(repr((r.doc_id, r.class_id)) for r in got.collect()) == plain_classes(docs)
    one = minhash.one_of_each(d)
    assert one.columns == d.columns and one.count() == len({r.split(", ")[1] for r in plain_classes(docs)})
    assert minhash.classes(d.filter("false")).count() == 0 and minhash.one_of_each(d.filter("false")).count() == 0


def test_copies_without_their_base(spark, monkeypatch):
    """Each text is a copy of an absent base with edits of its own; brute force is over all pairs."""
    r, docs = np.random.default_rng(7), []
    for i in range(400):
        x = [f"u{k}" for k in range(204)]
        for k in r.choice(20, 4, replace=False):
            x[10 * k + 5] = f"edit{i}-{k}" if r.random() < 0.6 else f"edit{k}"
        docs.append((i, " ".join(x)))
    sets = [minhash.shingles([t.encode()], 5)[1:] for _, t in docs]
    root = np.arange(len(docs))
    for j in range(len(docs)):
        for i in range(j):
            if root[i] != root[j] and minhash.similarity(sets[i], sets[j]) >= 0.8:
                root[root == max(root[i], root[j])] = min(root[i], root[j])
    d = table(spark, docs, "doc_id long, text string")
    monkeypatch.setattr(minhash, "BLOCK", 150, raising=False)
    assert {x.doc_id: x.class_id for x in minhash.classes(d).collect()} == dict(enumerate(root.tolist()))


def test_blocks_find_the_links_of_all_pairs():
    r, p = np.random.default_rng(3), minhash.NearParams()
    base = [f"v{k}" for k in range(60)] * 2 + [f"v{k}" for k in range(40)]
    texts = []
    for i in range(80):
        x = list(base)
        for k in r.choice(len(x), r.integers(0, 7), replace=False):
            x[k] = f"e{i}"
        texts.append(" ".join(x[: r.integers(150, 161)]).encode())
    sets = [minhash.shingles([t], 5)[1:] for t in texts]
    names = [bytes([i]) for i in range(80)]
    for n_left in (80, 30):
        pairs = [(i, j) for i in range(n_left) for j in range(i + 1 if n_left == 80 else n_left, 80)]
        near = {q for q in pairs if minhash.similarity(sets[q[0]], sets[q[1]]) >= p.similarity}
        bands = np.zeros((80, p.bands), np.uint64)  # all texts share the first band's bucket
        assert not minhash.cross_links(texts, names, bands, 1, n_left, p)  # a later bucket leaves them to it
        got = [tuple(sorted(q)) for q in minhash.cross_links(texts, names, bands, 0, n_left, p)]
        assert set(got) <= near and 0 < len(near) < len(pairs)
        groups = []
        for edges in (near, got):
            root = list(range(80))
            for i, j in edges:
                root = [root[i] if x == root[j] else x for x in root]
            groups.append({frozenset(k for k in range(80) if root[k] == x) for x in root})
        assert groups[0] == groups[1]


def test_signatures_estimate_the_similarity():
    a, b = (prose(1, 400) + " ") * 2 + prose(2, 200), prose(1, 400) + " " + prose(3, 100)
    docs, e, w = minhash.shingles([a.encode(), b.encode()], 5)
    sig = minhash.prob_minhash(docs, e, w, 2, 4000)
    exact = minhash.similarity((e[docs == 0], w[docs == 0]), (e[docs == 1], w[docs == 1]))
    assert abs((sig[0] == sig[1]).mean() - exact) < 0.04 and 0.2 < exact < 0.9


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 101), (102, 101), (200, 200)], "a long, b long")
    got = {r.node: r.label for r in components.components(links).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}
    assert components.components(links.filter("false")).count() == 0


def test_near_duplicates_in_awkward_rows(awkward):
    rows = {(r.doc_id, r.class_id) for r in minhash.classes(awkward).collect()}
    assert {(1, 1), (2, 1), (None, 1), (3, 3), (4, 4), (5, 4), (8, 8), (9, 8), (None, 8)} <= rows


# 7


def plain_base(x):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", x)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", x) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", x) if 13 <= len(pii.digits_of(m.group())) <= 19 and pii.luhn(pii.digits_of(m.group()))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", x) if 9 <= len(pii.digits_of(m.group())) <= 15]


def test_base_spans_equal_the_patterns():
    r = np.random.default_rng(4)
    parts = ["a", "b.", "@", "@", "1", "25", "9.", "300", ".", ".", "-", " ", "+", "+1", "(", ")", "é", "4532015112830366", "\n", "a@b.c"]
    for _ in range(20_000):
        x = "".join(r.choice(parts, r.integers(0, 14)))
        assert pii.base(x) == plain_base(x), x


def test_gradient_is_the_loss_s():
    r, t = np.random.default_rng(0), pii.Tagger.fresh(1)
    x, y = r.integers(0, 30, (3, 8)), r.choice([0, 1, 2, 0, 3, 4], (3, 8))
    _, g = t.gradient(x, y)
    for k, w in t.w.items():
        at = tuple(int(r.integers(0, n)) for n in w.shape)
        old, loss = w[at], []
        for step in (1e-5, -1e-5):
            w[at] = old + step
            loss.append(t.gradient(x, y)[0])
        w[at] = old
        assert abs(g[k][at] - (loss[0] - loss[1]) / 2e-5) < 1e-6


def test_personal_data(spark, small, awkward):
    tagger = pii.fit(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    for text, span in (("call (649) 555-1648 now", ("phone", 5, 19)), ("the ip 10 . 20 . 30 . 40 here", ("ip", 7, 24)), ("card 4532.0151.1283.0366 is", ("card", 5, 24))):
        assert span in pii.find([text], tagger)[0][1]
    clean = [prose(i, 50) + f" chapter {i} of 2020, page 12" for i in range(50)]
    assert all(not spans for _, spans in pii.find(clean, tagger))
    got = pii.report(awkward, tagger).collect()
    assert len(got) == awkward.count()
    row = next(r for r in got if r.doc_id == 14)
    text = awkward.filter("doc_id = 14").first().text
    assert (row.n_email, row.n_ip, row.n_card, row.n_phone) == (1, 1, 1, 1)
    assert row.base_sha256 == hashlib.sha256(pii.digest_text(plain_base(text)).encode()).hexdigest()
    red = pii.redact(awkward, tagger)
    assert red.columns == awkward.columns and red.filter("doc_id = 14").first().text.startswith("mail [EMAIL] and [PHONE], [CARD], [IP]")
    assert red.filter("text IS NULL").count() == 2 and pii.report(awkward.filter("false")).count() == 0
    assert pii.fit(awkward.filter("doc_id = 4")) is None


def test_viterbi_is_the_best_path():
    from itertools import product

    tagger = pii.Tagger.fresh(4)
    r = np.random.default_rng(4)
    tagger.w["trans"] = r.normal(0, 1, tagger.w["trans"].shape)
    x = r.integers(1, 20, (3, 4))
    e, _ = tagger.emissions(x)
    for row, tags in zip(e, tagger.decode(x)):
        score = lambda p: tagger.w["start"][p[0]] + row[0, p[0]] + sum(tagger.w["trans"][a, b] + row[t + 1, b] for t, (a, b) in enumerate(zip(p, p[1:])))  # noqa: B023, E731
        paths = list(product(range(pii.TAGS), repeat=4))
        assert max(paths, key=score) == tuple(tags.tolist())
        logz = np.log(sum(np.exp(score(p)) for p in paths))
        y = np.array([tags])
        one = x[[i for i in range(3) if np.array_equal(e[i], row)][:1]]
        assert abs(tagger.gradient(one, y)[0] - (logz - score(tuple(tags.tolist())))) < 1e-9


def test_the_model_finds_forms_that_the_patterns_miss(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    tagger = pii.fit(docs)
    r, texts, want = np.random.default_rng(9), [], []
    kinds = {"email": lambda: f"{WORDS[r.integers(400)]}.{WORDS[r.integers(400)]}@host{r.integers(99)}.org", "card": lambda: "4532015112830366", "ip": lambda: ".".join(map(str, r.integers(1, 255, 4)))}
    for row in docs.filter("length(text) > 400 AND NOT text RLIKE '[0-9@]'").orderBy("doc_id").limit(200).collect():
        kind = ("email", "card", "ip")[r.integers(3)]
        new = pii.variants(kind, kinds[kind](), r)
        at = row.text.find(" ", 200) + 1
        texts.append(row.text[:at] + new + " " + row.text[at:])
        want.append((kind, at, at + len(new)))
    got = pii.find(texts, tagger)
    caught = sum(any(k == w[0] and a < w[2] and w[1] < e for k, a, e in spans) for w, (_, spans) in zip(want, got))
    extra = sum(not (a < w[2] and w[1] < e) for w, (_, spans) in zip(want, got) for _, a, e in spans)
    assert len(want) > 50 and caught >= 0.6 * len(want) and extra <= 0.05 * len(want)


def test_long_addresses_and_long_numbers():
    assert pii.base("0000000000000000000001.1.1.1 " + "9" * 5000 + ".1.1.1") == [("ip", 0, 28)]
    name = "n" * 100
    a, b = pii.regions("x " * 50 + name + " @ " + "h" * 120 + ".org and")[0]
    assert b - a >= 100 + 3 + 124


def test_windows_are_reconciled():
    regs = [(0, 200)]
    wins = pii.windows(regs)
    assert wins[0] == (0, 64) and wins[-1][1] == 200 and all(b - a <= 64 for a, b in wins)
    tags = np.zeros((len(wins), 64), np.int8)
    for i, (a, b) in enumerate(wins):
        for at in range(50, 60):
            if a <= at < b:
                tags[i, at - a] = 1 if at == 50 else 2
    assert pii.reconcile(wins, tags) == [("email", 50, 60)]


# 8


def plain_removed(docs):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in docs]
    count = Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    out = []
    for (d, _), w in zip(docs, words):
        gone = {j for i in range(len(w) - 34) if count[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append(repr((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())))
    return sorted(out)


def test_repeated_passages_equal_brute_force(spark, awkward, monkeypatch):
    shared, line = prose(90, 50), "the same line again and again "
    docs = [(i, f"{prose(i, 40)} {shared}\n{prose(i + 50, 30)}") for i in range(12)]
    docs += [(20, line * 30), (21, prose(91, 34)), (22, prose(91, 34)), (23, prose(92, 35)), (24, prose(92, 35)), (25, prose(93, 90) + " x " + prose(93, 90)), (None, None), (26, ""), (26, "a b")]
    docs += [(30 + i, edited(prose(94, 300), i, 3)) for i in range(8)] + [(30, docs[0][1])]
    d = table(spark, docs, "doc_id long, text string")
    for shard in (20_000, 7):
        monkeypatch.setattr(substring, "SHARD_PHRASES", shard)
        monkeypatch.setattr(substring, "TASK_TEXTS", shard)
        assert sorted(repr(tuple(r)) for r in substring.remove(d).drop("kept").collect()) == plain_removed(docs)
    odd = [(r.doc_id, r.text) for r in awkward.collect()]
    assert sorted(repr(tuple(r)) for r in substring.remove(awkward).drop("kept").collect()) == plain_removed(odd)
    assert substring.remove(d.filter("false")).count() == 0


# 9


def check_packing(rows, tokens=2048):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    for some in by.values():
        at = 0
        for r in sorted(some, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= tokens
    return by


def test_packing_holds_every_token(spark, awkward):
    rows = packing.pack(awkward).collect()
    check_packing(rows)
    enc = _tokens.Encoder(_tokens.tokenizer_path("word_bpe_49k.json"))
    want = []
    for r in awkward.collect():
        ids = np.array(enc.tok.encode(r.text or "", add_special_tokens=False).ids + [0])
        want += [repr((r.doc_id, k, s, len(ids[s : s + 2048]), _tokens.crc(ids[s : s + 2048]))) for k, s in enumerate(range(0, len(ids), 2048))]
    assert sorted(repr((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in rows) == sorted(want)
    assert packing.pack(awkward.filter("false")).count() == 0


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_every_capacity_binds(rule):
    r = np.random.default_rng(2)
    lengths = r.integers(1, 2049, 800)
    free = packing.PackParams(rule=rule)
    bins, _ = packing.best_fit(lengths, free)
    assert bins.max() + 1 <= 1.06 * -(-lengths.sum() // 2048)
    tight = packing.PackParams(documents=2, attention=2048**2, rule=rule)
    bins, offsets = packing.best_fit(lengths, tight)
    for b in range(bins.max() + 1):
        some = lengths[bins == b]
        assert len(some) <= 2 and some.sum() <= 2048 and (some.astype(float) ** 2).sum() <= 2048**2
    cheap = packing.PackParams(attention=500_000, rule=rule)
    bins, _ = packing.best_fit(lengths, cheap)
    cost = np.bincount(bins, lengths.astype(float) ** 2)
    assert ((cost <= 500_000) | (np.bincount(bins) == 1)).all() and (np.bincount(bins) > 1).any() and bins.max() + 1 > lengths.sum() / 2048 * 1.5
    plain, left = [], []  # best fit on tokens alone, bin by bin
    for i in np.argsort(-lengths, kind="stable"):
        at = min((x for x in range(len(left)) if left[x] >= lengths[i]), key=lambda x: (left[x], x), default=None)
        if at is None:
            at = len(left)
            left.append(2048)
        left[at] -= lengths[i]
        plain.append((i, at))
    if rule == "norm":
        only = packing.PackParams(weights=(1.0, 0.0, 0.0))
        assert packing.best_fit(lengths, only)[0].tolist() == [at for _, at in sorted(plain)]
    with pytest.raises(ValueError):
        packing.PackParams(rule="worst")


# 10


def test_token_shards_round_trip(spark, awkward):
    rows = tokenbin.write_and_read(awkward).collect()
    enc = _tokens.Encoder(_tokens.tokenizer_path("byte_bpe_50k.json"))
    want = Counter()
    for r in awkward.collect():
        ids = np.array(enc.tok.encode(r.text or "", add_special_tokens=False).ids + [2])
        want[r.doc_id, len(ids), _tokens.crc(ids)] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == want
    at = 0
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    ordered = [r.doc_id if r.doc_id is not None else -1 for r in sorted(rows, key=lambda r: r.start)]
    assert ordered == sorted(ordered)
    assert tokenbin.write_and_read(awkward.filter("false")).count() == 0


def test_rows_by_key(awkward):
    folder = tokenbin.scratch(awkward.sparkSession, "token-ids")
    manifest = tokenbin.write(awkward, folder)
    enc = _tokens.Encoder(_tokens.tokenizer_path("byte_bpe_50k.json"))
    want = {}
    for r in awkward.collect():
        want.setdefault(r.doc_id, []).append([*enc.tok.encode(r.text or "", add_special_tokens=False).ids, 2])
    for key in [*want, -1, 10**12]:
        assert sorted(x.tolist() for x in tokenbin.rows_of(manifest, key)) == sorted(want.get(key, []))


def test_keyed_access(tmp_path):
    r = np.random.default_rng(6)
    ids = sorted(r.choice(10**9, 3000, replace=False).tolist())
    docs = [r.integers(0, 50_000, r.integers(1, 30)) for _ in ids]
    file = f"{tmp_path}/s.ids"
    tokenbin.write_shard(file, 2, iter([(ids[:1000], docs[:1000]), (ids[1000:], docs[1000:])]))
    shard = tokenbin.Shard(file)
    assert all(shard.get(i).tolist() == d.tolist() for i, d in zip(ids, docs))
    h = tokenbin.key_hash(np.array(ids), np.zeros(3000, bool), np.zeros(3000, np.int64))
    assert sorted(shard.slot(h[i : i + 1]) for i in range(3000)) == list(range(3000))  # minimal and perfect
    assert not any(shard.get(int(x)) is not None for x in set(r.integers(10**9, 2 * 10**9, 500).tolist()))


# The pipeline


def test_pipeline(spark, small):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in p.STAGES[:-1]:
        docs = p.saved(stage(spark, docs, small), name)
        assert docs.columns == columns and 0 < docs.count() <= n
    check_packing(p.STAGES[-1][1](spark, docs, small).collect())
    assert {r.doc_id for r in p.run(spark, small).collect()} == {r.doc_id for r in docs.collect()}


def test_pipeline_stages_on_awkward_rows(spark, small, awkward, none):
    import corpus_pipeline as p

    for name, stage in p.STAGES[:-1]:
        got = stage(spark, awkward, small)
        assert got.columns == awkward.columns and 0 < got.count() <= awkward.count(), name
        empty = stage(spark, none, small)
        assert empty.columns == awkward.columns and empty.count() == 0, name
    kept = {(r.doc_id, r.text) for r in p.near_duplicates(spark, awkward, small).select("doc_id", "text", "key").filter("key = 4").collect()}
    assert (1, None) in kept and not any(i in (2, 9) for i, _ in kept)
    check_packing(p.pack(spark, awkward, small).collect())
    assert p.pack(spark, none, small).count() == 0


def test_sql_of_the_expressible(spark, small):
    import duckdb

    from vecspark.llm.queries import ORACLES, QUERIES

    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    for name, sql in ORACLES.items():
        df, q = QUERIES[name](spark, small), con.sql(sql)
        at = [q.columns.index(c) for c in sorted(df.columns) if c in q.columns]
        rows = sorted(repr(tuple(r[c] for c in sorted(df.columns) if c in q.columns)) for r in df.collect())
        assert rows == sorted(repr(tuple(r[i] for i in at)) for r in q.fetchall())
        assert sorted(q.columns) == sorted(df.columns)


def test_neighbours_of_outliers_are_complete(spark):
    """A query whose list holds little but itself reads further lists."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(2_000, 16))
    x[::100] *= 12
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    p = ann.AnnParams(vectors_per_list=20, least_rows=1)
    got = ann.search(df, "id % 100 = 0", p).toPandas()
    assert (got.groupby("query_id").size() == 10).all() and got.query_id.nunique() == 20
    got = ann.search(df, "id % 100 = 0", ann.AnnParams(vectors_per_list=20)).toPandas()
    hit = 0
    for q in range(0, 2_000, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        hit += len(set(np.argsort(d)[:10]) & set(got.vec_id[got.query_id == q]))
    assert hit >= 180
    few = ann.search(df.filter("vec_id < 5"), "id = 0", p).toPandas()
    assert sorted(few.vec_id) == [1, 2, 3, 4]
