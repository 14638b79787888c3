"""Tokenizers against their libraries, models against brute force and held-out cases."""

import base64
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from quire.llm import bloom_lm, bpe, language_id, preference, token_files, topk, toxicity
from quire.llm.common import shared_dir

ODD = ["", " ", None, "a  b   c\n\n d", "\x1c\x85\xa0x", "'s're it's", "日本語 été ÉTÉ İΣσς", "<|endoftext|> ok", "😀‍😀 ½ ² ٣", "x" * 1500, "ab" * 700 + " z", "the The THE the, the. (the)", "é ́e", "tab\tend \r\n"]


def texts(n=150, seed=3):
    r = random.Random(seed)
    return ODD + ["".join(r.choice(["the ", "Then", " cat", "é", "\n", "12", "!!", "  ", "'ll ", "straße "]) for _ in range(r.randrange(30))) for _ in range(n)]


def frame(spark, values):
    rows = [(i * 7 % 501, t, "old", 1) for i, t in enumerate(values)]
    return spark.createDataFrame(rows, "doc_id long, text string, Ids string, n_tokens int")


def test_bpe_equals_tiktoken(spark):
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    values = texts()
    df = bpe.bpe_decode(bpe.bpe_encode(frame(spark, values), path, P.PATTERN), path, P.PATTERN)
    assert df.columns == ["doc_id", "text", "n_tokens", "ids", "decoded"]
    for r in df.collect():
        want = own.encode_ordinary(r.text or "")
        assert np.frombuffer(r.ids, "<u4").tolist() == want and r.n_tokens == len(want)
        assert bytes(r.decoded) == (r.text or "").encode()
    both = bpe.bpe_round_trip(frame(spark, values), path, P.PATTERN).collect()
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in both)


def test_bpe_random_vocabulary():
    """Leftmost pair of minimum rank, one merge at a time, on a vocabulary where new tokens make lower ranks; long pieces merge many places a round."""
    r = random.Random(0)
    tokens = [bytes([i]) for i in range(256)]
    while len(tokens) < 420:
        t = r.choice(tokens[97:101] + tokens[256:]) + r.choice(tokens[97:101] + tokens[256:])
        if t not in tokens and len(t) < 12:
            tokens.append(t)
    order = tokens[256:]
    r.shuffle(order)
    ranks = {t: i for i, t in enumerate(tokens[:256] + order)}
    own = bpe.Bpe(ranks, P.PATTERN)
    for size in [1, 2, 3, 5, 9, 17, 40, 100, 600, 1300]:
        for _ in range(12):
            piece = bytes(r.choice(b"abcd") for _ in range(size))
            parts = [bytes([c]) for c in piece]
            while piece not in ranks:
                at = [(ranks[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in ranks]
                if not at:
                    break
                _, i = min(at)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            want = [ranks[piece]] if piece in ranks else [ranks[p] for p in parts]
            ids, count = own.pieces([piece, b"a"])
            assert ids.tolist() == [*want, 97] and count.tolist() == [len(want), 1]


def test_token_files(spark):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    model = Tokenizer.from_file(path)
    values = texts()
    where = shared_dir(spark)
    token_files.write_tokens(frame(spark, values), path, where)
    got = {r.doc_id: r for r in token_files.read_tokens(spark, where).collect()}
    start = 0
    for i, t in sorted((i * 7 % 501, t) for i, t in enumerate(values)):
        want = model.encode(t or "", add_special_tokens=False).ids + [2]
        r = got[i]
        assert np.frombuffer(r.ids, "<u4").tolist() == want and (r.start, r.n_tokens) == (start, len(want))
        assert zlib.crc32(r.ids) == zlib.crc32(np.array(want, "<u4").tobytes())
        start += len(want)
    empty = shared_dir(spark)
    token_files.write_tokens(frame(spark, values).limit(0), path, empty)
    assert token_files.read_tokens(spark, empty).count() == 0


def test_token_files_null_and_equal_ids(spark):
    where = shared_dir(spark)
    df = spark.createDataFrame([(None, "b"), (4, "a"), (4, "a"), (None, None)], "doc_id long, text string")
    token_files.write_tokens(df, P.path("word_bpe_49k.json"), where)
    assert sorted((r.doc_id is not None, r.start, r.n_tokens) for r in token_files.read_tokens(spark, where).collect()) == [(False, 0, 1), (False, 1, 2), (True, 3, 2), (True, 5, 2)]


@pytest.mark.parametrize("limit", [6, 20])
def test_huffman(limit):
    rng = np.random.default_rng(limit)
    ids = np.minimum(rng.geometric(0.2, 5000), 40) + 3
    counts = np.bincount(ids, minlength=60)
    lengths = token_files.code_lengths(counts, limit)
    used = lengths[lengths > 0].astype(float)
    assert lengths.max() <= limit and (2.0**-used).sum() <= 1 and ((lengths > 0) == (counts > 0)).all()
    p = counts[counts > 0] / counts.sum()
    bits = (lengths * counts).sum() / counts.sum()
    assert limit < 20 or -(p * np.log2(p)).sum() <= bits <= -(p * np.log2(p)).sum() + 1
    codec = token_files.Codec(lengths)
    for n in (0, 1, 255, 256, 257, 5000):
        payload, offsets = codec.encode(ids[:n])
        assert codec.decode([payload] * 2, [offsets] * 2, [n] * 2)[1].tolist() == ids[:n].tolist()
    assert token_files.code_lengths(np.array([0, 5, 0])).tolist() == [0, 1, 0]
    with pytest.raises(ValueError):
        token_files.code_lengths(np.ones(9, int), 3)


def languages(n=240):
    r = random.Random(1)
    words = {"aa": ["thing", "other", "when", "with"], "bb": ["straße", "nicht", "über", "auch"], "cc": ["être", "dans", "où", "cette"]}
    return [(i, " ".join(r.choice(words[k]) + r.choice(words[k])[:2] for _ in range(r.randrange(3, 20))), k) for i, k in enumerate(r.choices(list(words), k=n))]


def test_language_id(spark):
    rows = languages() + [(900, None, "aa"), (901, "", None), (902, "12 34 !?", "bb"), (903, "nicht über", None), (904, "thing " * 20000, "aa")]
    df = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, SCORE double")
    train = df.where("doc_id % 3 = 0")
    done = language_id.identify(df, language_id.train(train)).collect()
    by = {r.doc_id: r for r in done}
    assert all(by[i].lang_pred == k for i, _, k in rows[:240])
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (900, 901, 902)) and by[903].lang_pred == "bb"
    assert all(0 <= r.score <= 1 for r in done) and "SCORE" not in done[0].asDict()
    nothing = language_id.train(train.limit(0))
    assert {r.lang_pred for r in language_id.identify(df, nothing).collect()} == {"und"}
    assert language_id.identify(df.limit(0), nothing).count() == 0
    bounded = language_id.train(train, sample=30)
    good = [r.lang_pred == k for r, (_, _, k) in zip(sorted(language_id.identify(df, bounded).collect(), key=lambda r: r.doc_id), rows[:240])]
    assert sum(good) > 230


def toxic_rows(n=700):
    r = random.Random(2)
    plain = ["river", "stone", "walk", "green", "paper", "table", "music", "window", "yellow", "garden"]
    out = []
    for i in range(n):
        w = [r.choice(plain) + r.choice(["", "s", "er", "ing"]) for _ in range(r.randrange(5, 60))]
        bad = i % 4 == 0
        for _ in range(r.randrange(1, 4) if bad else 0):
            w[r.randrange(len(w))] = r.choice(["snarfbad", "snarfbadly", "grulk", "grulks", "grulkish"])
        out.append((i, " ".join(w), int(bad)))
    return out


def test_toxicity(spark):
    rows = toxic_rows()
    docs = spark.createDataFrame([(i, t, 3) for i, t, _ in rows] + [(8000, None, 3), (8001, "", 3), (8002, "river snarfbadd stone xgrulkx walk", 3)], "doc_id long, text string, predicted int")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(5, None), (None, 1), (99999, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels.where("doc_id % 5 <> 0"))
    done = {r.doc_id: r for r in toxicity.toxicity(docs, model).collect()}
    held = [(done[i].predicted, y) for i, _, y in rows if i % 5 == 0]
    assert sum(p == y for p, y in held) >= 0.97 * len(held)
    assert done[8002].predicted == 1  # a misspelling that training has not seen
    assert done[8000].score == done[8001].score and done[8000].predicted == 0
    again = toxicity.train(docs.repartition(7), labels.where("doc_id % 5 <> 0").repartition(3))
    assert np.allclose(again[0], model[0]) and again[1] == pytest.approx(model[1])
    for some in (labels.limit(0), labels.where("toxic = 1")):
        assert {r.predicted for r in toxicity.toxicity(docs, toxicity.train(docs, some)).collect()} == {int(some.count() > 0)}


def test_language_id_samples_each_language(spark):
    """A rare language is learned in full beside a common one; priors are those of all rows."""
    rows = [(i, "the house and the tree", "en") for i in range(3000)] + [(3000 + i, "qvixu zwolk pfrump", "xx") for i in range(3)]
    names, prior, logs = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample=30)
    assert names == ["en", "xx"] and np.allclose(np.exp(prior), [3000 / 3003, 3 / 3003])
    assert language_id.predict([b"qvixu pfrump", b"the tree"], names, prior, logs)[0] == ["xx", "en"]


def test_toxicity_holds_used_buckets_only(spark):
    """The sample, and a model of the used buckets alone that is that of the whole bags."""
    assert toxicity.SAMPLE == (4500, 2500)
    r = random.Random(6)
    rows = [(i, " ".join([f"rare{i}x{r.randrange(10**6)}"] + [r.choice(["bad", "worse", "awful"] if i % 3 == 0 else ["good", "fine", "nice"]) if r.random() < 0.3 else f"w{r.randrange(40)}" for _ in range(20)]), int(i % 3 == 0)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    part, bias = toxicity.train(df, df.select("doc_id", "toxic"))
    bags = next(toxicity._bags([pa.record_batch({"text": [t for _, t, _ in rows], "label": pa.array([y for _, _, y in rows], pa.int32())})]))
    whole = sorted((y, zlib.crc32(b), b) for y, b in zip(bags.column(0).to_pylist(), bags.column(1).to_pylist()))
    cut = np.concatenate([[0], np.cumsum([len(x[2]) // 8 for x in whole])])
    bucket, n = (np.concatenate(x) for x in zip(*(toxicity._parts(x[2]) for x in whole)))
    want = toxicity.fit(np.array([x[0] for x in whole]), cut, bucket, n)
    assert np.allclose(part, want[0]) and bias == pytest.approx(want[1])


def test_toxicity_gradients():
    rng = np.random.default_rng(2)
    e, w, b = rng.normal(size=(4, 9)), rng.normal(size=(4, 2)), rng.normal(size=2)
    row = np.repeat(np.arange(6), 5)
    f, weight, y = rng.integers(0, 9, 30), rng.random(30), rng.integers(0, 2, 6)
    _, de, dw, db = toxicity.gradients(e, w, b, f, weight, row, y)
    for x, g in ((e, np.array(de)), (w, dw), (b, db)):
        for at in np.ndindex(x.shape):
            old, ends = x[at], []
            for step in (1e-6, -1e-6):
                x[at] = old + step
                ends.append(toxicity.gradients(e, w, b, f, weight, row, y)[0])
            x[at] = old
            assert (ends[0] - ends[1]) / 2e-6 == pytest.approx(g[at], abs=1e-6)


def folded(text, keep):
    return "".join(c if keep(c) else " " for c in (text or "").lower())


def bucket_of(gram, bits):
    """The hash of a character n-gram, in plain integers."""
    h = 0
    for c in gram:
        h = (h * 0x01000193 + ord(c)) & 0xFFFFFFFF
    x = (h + len(gram) * 0x9E3779B1) & 0xFFFFFFFF
    x ^= x >> 16
    x = x * 0x7FEB352D & 0xFFFFFFFF
    x ^= x >> 15
    return (x * 0x846CA68B & 0xFFFFFFFF) >> (32 - bits)


def grams(text, longest):
    """All n-grams with a letter, in which a space is at most the first and the last character."""
    padded = f" {text} "
    for n in range(1, longest + 1):
        for i in range(len(padded) - n + 1):
            g = padded[i : i + n]
            if g.strip() and " " not in g[1:-1]:
                yield g


def test_toxicity_score_by_loops():
    """Whole texts, also very long ones, against a loop over the distinct words of each."""
    from quire.llm.char_ngrams import Chars

    rng = np.random.default_rng(4)
    part, bias = rng.normal(size=1 << toxicity.BITS), -0.4
    values = ["Bad worse, bad!", "", None, "ok", "  x1 É\u00df ", "a " * 4000 + "b" * 3000, " ".join(f"w{i % 977}q{i}" for i in range(30_000)), "same same same"]
    got = toxicity.score([v.encode() if v is not None else None for v in values], part, bias)
    for v, s in zip(values, got):
        words = list(dict.fromkeys(folded(v, str.isalnum).split()))
        total, n = 0.0, 0
        for x in words:
            chars = Chars([x.encode()], digits=True)
            *_, (_, whole) = toxicity._features(chars)  # the hash of the word itself
            found = [bucket_of(g, toxicity.BITS) for g in grams(x, toxicity.LONGEST) if len(g) >= 3] + whole.tolist()
            total, n = total + sum(part[i] for i in found), n + len(found)
        assert s == pytest.approx(1 / (1 + math.exp(-(bias + total / max(n, 1)))), abs=1e-9)


def test_toxicity_counts_are_not_capped():
    """An n-gram that over 255 distinct words hold counts in training as in scoring."""
    text = " ".join(f"abc{i}z" for i in range(700))
    bags = next(toxicity._bags([pa.record_batch({"text": [text], "label": pa.array([1], pa.int32())})]))
    bucket, n = toxicity._parts(bags.column(1)[0].as_py())
    assert n.max() == 700 and dict(zip(bucket.tolist(), n.tolist()))[bucket_of("abc", toxicity.BITS)] == 700


def test_language_id_by_loops(spark):
    """lang_pred and score against a plain naive Bayes over the same buckets, through the query."""
    r = random.Random(12)
    make = {"aa": "abcde", "bb": "defgh", "cc": "ghiab"}
    values = [(i, " ".join("".join(r.choice(make[x]) for _ in range(r.randrange(1, 7))) for _ in range(r.randrange(1, 12))), x) for i in range(150) for x in [r.choice("abc") * 2]]
    values += [(900, None, "aa"), (901, " 12 !", "bb"), (902, "unlabelled dead", None), (903, "abc gh", None), (904, "ab gh " * 20_000, "cc")]
    df = spark.createDataFrame(values, "doc_id long, text string, lang string").repartition(3)
    learned = [(t, x) for i, t, x in values if x and zlib.crc32(str(i).encode()) % 5]
    names = sorted({x for _, x in learned})
    counts = {x: Counter(bucket_of(g, 16) for t, y in learned if y == x for g in grams(folded(t, str.isalpha), 3)) for x in names}
    model = language_id.train(df.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0))
    done = {x.doc_id: x for x in language_id.identify(df, model).collect()}
    assert model[0] == names and len(done) == len(values)
    for i, t, _ in values:
        text = folded(t, str.isalpha)
        if not text.strip():
            assert (done[i].lang_pred, done[i].score) == ("und", 0.0)
            continue
        found = Counter(bucket_of(g, 16) for g in grams(text, 3))
        logs = [math.log(sum(y == x for _, y in learned) / len(learned)) + sum(k * math.log((counts[x][b] + 0.5) / (sum(counts[x].values()) + 0.5 * 65536)) for b, k in found.items()) for x in names]
        best = max(logs)
        assert done[i].lang_pred == names[logs.index(best)]
        assert done[i].score == pytest.approx(1 / sum(math.exp(x - best) for x in logs), rel=1e-6)


def lm_brute_force(values, trains):
    """Per text: n_tokens, n_known, train_tokens, base_score and, from exact counts, score."""
    words = [["".join(c.lower() if "A" <= c <= "Z" else c for c in x) for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")] + [None] for t in values]
    counts, pairs = Counter(), Counter()
    for w, on in zip(words, trains):
        if on:
            counts.update(w)
            pairs.update(zip([None, *w], w))
    n, v = sum(counts.values()), len(counts)
    mid = lambda c: (2 ** (c.bit_length() - 1) + 2 ** c.bit_length() - 1) / 2 if c else 0.0
    out = []
    for w in words:
        base = sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in w)
        score = sum(math.log10(0.3 * min(1.0, mid(pairs[a, b]) / (mid(counts[a]) or math.inf)) + 0.7 * (mid(counts[b]) + 1) / (n + v + 1)) for a, b in zip([None, *w], w))
        out.append((len(w), sum(counts[t] > 0 for t in w), n, base, score))
    return out


LM_TEXTS = [" ".join(random.Random(i).choice(["the", "The", "a", "of", "ÉTÉ"]) if random.Random(i * 99 + k).random() < 0.5 else f"w{int(random.Random(i * 77 + k).paretovariate(0.5)) % 3000}" for k in range(i % 40)) for i in range(200)]
LM_TEXTS += [None, "", " \t", "never seen", "the\nthe\t the", "a\u00a0b \x1c the", "of " * 30_000, LM_TEXTS[9], LM_TEXTS[9]]


@pytest.mark.parametrize("small", [0, 1 << 30])
@pytest.mark.parametrize("hashes", [5, 24])
def test_bloom_lm(spark, monkeypatch, small, hashes):
    """Both ways against brute force. With 24 places an entry no probe is wrong, so scores are those of exact counts."""
    monkeypatch.setattr(bloom_lm, "LEAST_BLOCKS", 5)
    trains = [i % 7 != 2 for i in range(len(LM_TEXTS))]
    df = spark.createDataFrame([(i, t, 1.0, "x") for i, t in enumerate(LM_TEXTS)], "doc_id long, text string, Score double, base_score string").repartition(3)
    out = bloom_lm.lm_score(df, F.col("doc_id") % 7 != 2, small=small, hashes=hashes)
    assert out.columns == ["doc_id", "text", *bloom_lm.NAMES]
    done = {x.doc_id: x for x in out.collect()}
    assert len(done) == len(LM_TEXTS)
    off = []
    for i, (n, known, total, base, score) in enumerate(lm_brute_force(LM_TEXTS, trains)):
        x = done[i]
        assert (x.n_tokens, x.n_known, x.train_tokens) == (n, known, total)
        assert x.base_score == pytest.approx(base)
        off.append((x.score - score) / n)
        if hashes == 24:
            assert x.score == pytest.approx(score)
    assert np.abs(off).mean() < 0.05


def test_bloom_lm_ways_agree(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(LM_TEXTS)], "doc_id long, score string").repartition(4)
    one, two = ({r.doc_id: r for r in bloom_lm.lm_score(df, F.col("doc_id") % 7 != 2, "score", small).collect()} for small in (0, 1 << 30))
    assert len(one) == len(LM_TEXTS) and one.keys() == two.keys()
    assert all(one[i].score == pytest.approx(two[i].score, rel=1e-12) for i in one)


@pytest.mark.parametrize("small", [-1, 1 << 30])
def test_bloom_lm_of_nothing(spark, small):
    df = spark.createDataFrame([(1, "a b"), (None, None), (1, "a b")], "doc_id long, text string")
    got = bloom_lm.lm_score(df, F.lit(None).cast("boolean"), small=small).collect()
    assert len(got) == 3 and all(r.n_known == r.train_tokens == 0 and r.base_score == 0 for r in got)
    assert bloom_lm.lm_score(df.limit(0), F.lit(True), small=small).count() == 0


def test_bloom_filter_holds_all_and_counts_survive():
    rng = np.random.default_rng(5)
    h = np.unique(rng.integers(0, 2**63, 5000, dtype=np.uint64)) << np.uint64(1)
    n = np.where(rng.random(len(h)) < 0.7, 1, rng.integers(0, 10**7, len(h)))
    on = bloom_lm.segment(h, n)
    q = bloom_lm.probe(on, h)
    assert (q >= bloom_lm.level(n)).all() and (q[n > 0] == bloom_lm.level(n)[n > 0]).mean() > 0.9
    for kind, bits in ((0, 8), (1, 8), (1, 12)):
        x = h if kind == 0 else np.unique((h >> np.uint64(24 - bits)) << np.uint64(24 - bits))
        cut = bloom_lm._cuts(x, bits)
        for b, (i, j) in enumerate(zip(cut, cut[1:])):
            h2, n2 = bloom_lm._unpacked(kind, bits, b, bloom_lm._packed(kind, bits, x[i:j], n[i:j]))
            assert (h2 == x[i:j]).all() and (n2 == n[i:j]).all()


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 7)
    rng = np.random.default_rng(3)
    vectors = [(i, [float(x) for x in rng.normal(size=16)]) for i in range(120)]
    vectors += [(200 + i, vectors[4][1]) for i in range(9)] + [(300, None), (301, [float("nan")] * 16), (302, [None] * 16), (303, [1.0, 2.0]), (304, [3.0, -1.0]), (306, []), (None, vectors[0][1]), (308, [1e6] * 16)]
    df = spark.createDataFrame([(i, v, 7) for i, v in vectors], "vec_id long, embedding array<double>, rank int").repartition(5)
    got: dict = {}
    for r in topk.top_k(df, F.col("vec_id") % 4 == 0, k=5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    good = {i: np.floor(256 * np.array(v, float)).astype(object) for i, v in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    want = {}
    for q, a in good.items():
        if q % 4 == 0:
            some = sorted((-int((a.astype(np.int64) * b.astype(np.int64)).sum()), i) for i, b in good.items() if i != q and len(b) == len(a))[:5]
            if some:
                want[q] = [(i, -s) for s, i in some]
    assert got == want
    assert topk.top_k(df.limit(0), F.lit(True)).count() == 0


def test_preference_format(spark):
    turn = lambda r, t: (r, t)
    talk = [turn("user", "hi"), turn("assistant", "yo"), turn("user", "é?"), turn("assistant", "ok")]
    cases = [
        (1, talk, [*talk[:3], turn("assistant", "no")]),
        (2, talk, talk),
        (3, talk, talk[:2]),
        (4, [], talk),
        (5, None, None),
        (6, [turn(None, None), turn("assistant", None)], [turn(None, ""), turn("assistant", "x")]),
        (7, talk, [turn("user", "other")]),
        (8, talk * 100, [*(talk * 100)[:-1], turn("assistant", "end")]),
    ]
    df = spark.createDataFrame([(*c, "keep", "old") for c in cases], "pair int, chosen array<struct<role: string, text: string>>, rejected array<struct<role: string, text: string>>, note string, Prompt string")
    done = preference.format_preferences(df)
    assert done.columns == ["pair", "note", *preference.OUTPUTS]
    assert "Python" not in done._jdf.queryExecution().toString()
    show = lambda ts: "".join(f"<|im_start|>{r or ''}\n{t or ''}<|im_end|>\n" for r, t in ts)
    got = {r.pair: r for r in done.collect()}
    for i, c, r in cases:
        c, r = [[(a or "", b or "") for a, b in x or []] for x in (c, r)]
        n = 0
        while n < min(len(c), len(r)) - 1 and c[n] == r[n]:
            n += 1
        x = got[i]
        assert (x.n_prompt_turns, x.prompt, x.chosen_text, x.rejected_text) == (n, show(c[:n]), show(c[n:]), show(r[n:]))
        for spans, text, ts in ((x.chosen_spans, x.chosen_text, c[n:]), (x.rejected_spans, x.rejected_text, r[n:])):
            assert [text[s.start : s.end] for s in spans] == [f"{t}<|im_end|>\n" for role, t in ts if role == "assistant"]
    assert preference.format_preferences(df.limit(0)).count() == 0


def test_conversation_pairs(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "good"), (2, 1, "assistant", "bad"), (2, 0, "user", "q"), (3, 0, "user", "z"), (3, 1, "assistant", "abcd"), (4, None, None, None), (None, 0, "user", "q")]
    got = {r.conv_id: r for r in preference.conversation_pairs(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert set(got) == {1, 2, 3, 4} and got[2].chosen_id == 1 and got[1].chosen_id == 1
    assert got[2].chosen[1].text == "good" and got[2].rejected[1].text == "bad" and got[3].rejected[1].text == "ab" and got[1].rejected[1].text == "go"
