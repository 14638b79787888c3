"""Operators on texts against brute force: repeats, contamination, near duplicates."""

import random
import re

import numpy as np
import pytest

from quire.llm import near_dedup as nd
from quire.llm.common import shared_dir
from quire.llm.components import components
from quire.llm.decontamination import decontaminate, winnowed
from quire.llm.near_dedup import near_dedup, rows_of_band, shingle_sets, superminhash
from quire.llm.substring_dedup import Sketch, packed, sketch_for, substring_dedup, unpacked
from quire.llm.words import Words, window_hashes

SCHEMA = "doc_id long, text string, N_Words string, blk int, id string"


def corpus(seed=1, n=60, vocabulary=30):
    r = random.Random(seed)
    word = lambda: r.choice(["wa", "wé", "x", "Yes", "no,"]) + str(r.randrange(vocabulary))
    passage = [word() for _ in range(40)]
    texts = []
    for i in range(n):
        words = [word() for _ in range(r.randrange(0, 60))]
        if r.random() < 0.4:
            at, cut = r.randrange(len(words) + 1), r.randrange(0, 25)
            words[at:at] = passage[cut : cut + r.randrange(8, 30)]
        if texts and r.random() < 0.3:
            words = (r.choice(texts) or "").split()
            if words and r.random() < 0.6:
                words[r.randrange(len(words))] = "edit"
        texts.append("".join(w + r.choice([" ", "  ", "\n", "\t "]) for w in words))
    return texts + ["", "   ", None, "one", passage and " ".join(passage * 400)]


def rows(texts):
    return [(i * 3 - 9, t, "old", i, "x") for i, t in enumerate(texts)] + [(None, texts[0], None, None, None), (None, "alone here", None, None, None), (6, texts[1], "r", 1, "y")]


def frame(spark, texts):
    return spark.createDataFrame(rows(texts), SCHEMA)


def words_of(text, lower=False, pattern=r"[^\x20\x09-\x0d]+"):
    text = text or ""
    if lower:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return re.findall(pattern, text)


def test_word_hashes_tell_words_apart():
    w = Words([b"a bb a", None, b"", b" bb\ta\n", b"b ba"])
    h = w.hashes()
    assert w.counts.tolist() == [3, 0, 0, 2, 2]
    assert h[0] == h[2] == h[4] and h[1] == h[3] and len(set(h.tolist())) == 4
    at, doc = w.windows(2)
    assert doc.tolist() == [0, 0, 3, 4]
    g = window_hashes(h, at, 2)
    assert g[1] == g[2] and g[0] != g[1]


@pytest.mark.parametrize("window", [3, 13])
def test_substring_dedup(spark, window):
    texts = corpus()
    data = rows(texts)
    first = {}
    for i, t, *_ in data:
        w = words_of(t)
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, float("inf")), float("inf") if i is None else i)
    want = []
    for i, t, *_ in data:
        w = words_of(t)
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < (float("inf") if i is None else i):
                gone.update(range(k, k + window))
        want.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    done = substring_dedup(frame(spark, texts), window=window)
    assert done.columns == ["doc_id", "text", "blk", "id", "n_words", "n_removed", "kept_text"]
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in done.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert any(r[2] for r in want)


@pytest.mark.parametrize("shape", [(4, 2, "<u2"), (24, 8, "<u2"), (40, 8, "<u4")])
def test_substring_dedup_with_any_sketch(spark, monkeypatch, shape):
    texts = corpus()
    want = sorted(substring_dedup(frame(spark, texts)).collect(), key=str)
    monkeypatch.setattr("quire.llm.substring_dedup.sketch_for", lambda *_: Sketch(*shape))
    assert sorted(substring_dedup(frame(spark, texts)).collect(), key=str) == want


@pytest.mark.parametrize("shape", [(12, 2, "<u2"), (24, 8, "<u2"), (36, 8, "<u2"), (40, 8, "<u4")])
def test_sketch_cells_survive_packing(shape):
    sketch, r = Sketch(*shape), random.Random(5)
    h = np.array([0, 1, 2**64 - 1] + [r.getrandbits(64) for _ in range(500)], np.uint64)
    for row in (0, 1):
        c = np.unique(sketch.cells(h, row))
        parts = [unpacked(p, sketch.gap) + (np.uint64(s) << np.uint64(sketch.width - sketch.segments)) for s, p in packed(c, sketch)]
        assert np.concatenate(parts).tolist() == c.tolist()


def test_sketch_grows_with_the_input():
    for size in (1 << 20, 1 << 30, 1 << 40, 1 << 47):
        sketch = sketch_for(size, max(256, size >> 23))
        assert 2**sketch.width > 8 * size / 6 and 2**sketch.segments >= size >> 23


def test_substring_dedup_of_nothing(spark):
    assert substring_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def brute_hits(text, items, span):
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    w = words_of(text, True, pattern)
    hit, found = set(), set()
    for name, item in items:
        v = words_of(item, True, pattern)
        n = min(span, len(v))
        for k in range(len(v) - n + 1 if n else 0):
            for j in range(len(w) - n + 1):
                if w[j : j + n] == v[k : k + n]:
                    hit.update(range(j, j + n))
                    found.add(str(name))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("blocks", [1, 3])
def test_decontamination(spark, monkeypatch, blocks):
    import quire.llm.decontamination as module

    texts = corpus(7, 40, 4)[:-1]
    source = [t for t in texts if t]
    items = [(1, source[3]), (2, " ".join(source[5].split()[:14])), (10, source[5]), (3, "one"), (4, "x1 x2"), (5, None), (6, ""), (7, "no,1 Yes2 no,3"), (2, "unseen words " * 9)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    if blocks > 1:
        monkeypatch.setattr(module, "BLOCK_BYTES", sum(len(t or "") for _, t in items) // blocks + 1)
    want = {(i, *brute_hits(t, items, 10)[:2], ",".join(brute_hits(t, items, 10)[2])) for i, t, *_ in rows(texts)}
    done = decontaminate(frame(spark, texts), bench)
    assert {(r.doc_id, r.n_words, r.n_hit, ",".join(r["items"])) for r in done.collect()} == want
    assert all(r.contaminated == (r.n_hit > 0) for r in done.collect())
    assert decontaminate(frame(spark, texts), bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate(spark.createDataFrame([], SCHEMA), bench).count() == 0


def test_winnowing_keeps_one_in_every_window():
    g = np.random.default_rng(0).integers(1, 50, 300).astype(np.uint64)
    at = np.arange(290)
    kept = set(winnowed(g, at, 300, 6).tolist())
    assert all(kept & set(range(i, i + 6)) for i in at.tolist()) and len(kept) < 160


def brute_components(data, k, percent):
    sets = {}
    for i, t, *_ in data:
        w = words_of(t, True)
        s = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
        if i is not None:
            sets[i] = s
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("family", [1024, 3])
def test_near_dedup(spark, monkeypatch, family):
    monkeypatch.setattr(nd, "FAMILY", family)
    r = random.Random(4)
    base = [f"w{r.randrange(500)}" for _ in range(120)]
    texts = corpus(3, 50)[:-1]
    for _ in range(40):
        w = list(base)
        for _ in range(r.randrange(0, 6)):
            w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
        texts.append(" ".join(w).upper() if r.random() < 0.3 else " ".join(w))
    data = [(i, t, None, None, None) for i, t in enumerate(texts)] + [(None, texts[0], None, None, None)]
    want = brute_components(data, 3, 85)
    got = near_dedup(spark.createDataFrame(data, SCHEMA), shingle=3, percent=85).collect()
    assert len(got) == len(data)
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got if x.doc_id is not None} == want
    assert all(x.kept == (x.doc_id is None or x.doc_id == x.component_id) for x in got)
    assert len({c for _, c in want.values()}) < len(want) - 20


def test_near_dedup_of_nothing_and_repeated_ids(spark):
    assert near_dedup(spark.createDataFrame([], SCHEMA)).count() == 0
    same = spark.createDataFrame([(5, "a b c d e f g", None, None, None)] * 2 + [(7, "a b c d e f g", None, None, None), (9, None, None, None, None)], SCHEMA)
    assert sorted((r.doc_id, r.component_id, r.kept) for r in near_dedup(same).collect()) == [(5, 5, True), (5, 5, True), (7, 5, False), (9, 9, True)]


def test_superminhash_estimates_similarity():
    texts = [" ".join(f"w{i}" for i in range(a, a + 300)).encode() for a in (0, 30, 100, 1000)] + [b"w1 w2", b""]
    h, ends = shingle_sets(texts, 1)
    sig = superminhash(h, ends)
    for b, true in ((1, 270 / 330), (2, 200 / 400), (3, 0.0)):
        assert abs((sig[0] == sig[b]).mean() - true) < 0.12
    assert (sig[:4] < 128 << 24).all() and rows_of_band(85) == 7 and rows_of_band(80) == 6


def test_components(spark):
    r = random.Random(6)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2000 + i) for i in range(50)] + [(5, 5)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
    assert got == {x: find(x) for x in parent if find(x) != x}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert shared_dir(spark).startswith(spark.conf.get("spark.checkpoint.dir"))


def test_hits_of_a_common_passage(monkeypatch):
    """A passage of many items in many texts: pairs are expanded a few at a time, with the same result."""
    from quire.llm import decontamination as dc

    passage = " ".join(f"p{i}" for i in range(25))
    items = [f"i{i} {passage} {'z' * (i % 3 + 1)}" for i in range(90)] + [passage, "short one"]
    values = [f"{i} {passage} x{i} short one" for i in range(60)] + ["nothing here", None, ""]
    index = dc.index_items(list(range(len(items))), [t.encode() for t in items], 10, 5)[1]
    data = [v.encode() if v is not None else None for v in values]
    _, hit, doc, item = dc.find_hits(data, index, 10, 5)
    assert sorted(zip(doc.tolist(), item.tolist())) == [(d, i) for d in range(60) for i in range(92)]
    monkeypatch.setattr(dc, "PAIRS", 37)
    again = dc.find_hits(data, index, 10, 5)
    assert (again[1] == hit).all() and (again[2] == doc).all() and (again[3] == item).all()


def test_fingerprints_without_a_whole_window_are_no_hits(spark):
    """Quotes shorter than a window share fingerprints with an item, but no window; no other text of their chunk is hit."""
    from quire.llm import decontamination as dc

    items = [(i, " ".join(f"b{i}x{j}" for j in range(12))) for i in range(60)]
    quotes = [" ".join([f"u{i}x{j}" for j in range(12)] + t.split()[3:9] + [f"w{i}x{j}" for j in range(12)]) for i, t in items]
    index = dc.index_items([i for i, _ in items], [t.encode() for _, t in items], 10, 5)[1]
    w = Words([t.encode() for t in quotes], lower=True)
    grams = dc._grams(w, w.hashes(), 5)
    kept = winnowed(grams, w.windows(10)[0], len(grams), 6)
    assert len(index[10].hit(grams[kept]))
    for t in quotes:
        _, hit, doc, item = dc.find_hits([t.encode()], index, 10, 5)
        assert not hit.any() and not len(doc) and not len(item)
    bench = spark.createDataFrame(items, "item_id long, text string")
    done = decontaminate(frame(spark, quotes), bench)
    assert {(r.doc_id, r.n_words, r.n_hit) for r in done.collect()} == {(i, *brute_hits(t, items, 10)[:2]) for i, t, *_ in rows(quotes)}
    assert done.where("contaminated OR n_hit > 0").count() == 0
