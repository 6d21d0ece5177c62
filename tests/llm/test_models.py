"""Trained operators, vectors, URLs and the pipeline."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest

from gridweave.llm import queries
from gridweave.llm.embedneighbours import near_vectors
from gridweave.llm.graph import components
from gridweave.llm.quality import resample
from gridweave.llm.toxicity import fit, score_toxicity, without_toxic
from gridweave.llm.urlfilter import judge_urls

from . import brute
from .conftest import DIR


# --- toxicity


def sample(n, seed):
    rng = random.Random(seed)
    syllables = ["ka", "lo", "mi", "re", "tu", "sen", "dor", "pal"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4)))
    rows = []
    for i in range(n):
        text = [word() for _ in range(40)]
        toxic = rng.random() < 0.3
        if toxic:
            text[rng.randrange(40)] = rng.choice(["vozzik", "vozzikan", "brogfut"])
        rows.append((i, " ".join(text) + ".", int(toxic)))
    return rows


def test_toxicity_learns_gapped_words(spark, make):
    rows = sample(400, 1)
    docs = make([(i, t) for i, t, _ in rows])
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    model = fit(docs, labels)
    got = {r["doc_id"]: r for r in score_toxicity(docs, model).collect()}
    held = [(y, got[i]["predicted"]) for i, _, y in rows if got[i]["held_out"]]
    assert len(held) > 80 and sum(a == b for a, b in held) / len(held) > 0.98
    odd = [(1, "ka lo voz-zik mi"), (2, "ka v o z z i k lo"), (3, "VOZZIKS"), (4, "vo.z.z.i.k"), (5, "vozxzik"), (6, "kalo miretu"), (7, None), (8, ""), (9, "漢字 !!!"), (10, "ka " * 50_000 + "brogfut")]
    score = {r["doc_id"]: r["score"] for r in score_toxicity(make(odd), model).collect()}
    assert all(score[i] > 0.7 for i in (1, 2, 3, 4, 10)), score
    assert all(score[i] < 0.05 for i in (6, 7, 8, 9)), score
    assert score[5] > 0.4  # a foreign letter in the middle of a short word leaves few subsequences
    clean = without_toxic(make(odd), model)
    assert clean.columns == make(odd).columns and [6, 7, 8, 9] == sorted(r["doc_id"] for r in clean.collect() if r["doc_id"] != 5)


def _phi(window: bytes) -> dict:
    """Every 4-letter subsequence of a window between two breaks, by enumeration."""
    from itertools import combinations

    from gridweave.llm import toxicity as x

    padded, out = b"\0" + window + b"\0", {}
    for at in combinations(range(len(padded)), 4):
        span = at[3] - at[0] + 1
        if span <= x.SPAN:
            u = bytes(padded[i] for i in at)
            out[u] = out.get(u, 0.0) + x.DECAY**span
    return out


def _kernel(s: bytes, t: bytes) -> float:
    own, other = _phi(s), _phi(t)
    plain = lambda w: _phi(bytes(range(1, len(w) + 1)))  # noqa: E731  as many letters, all different
    norm = math.prod(sum(v * v for v in plain(w).values()) for w in (s, t))
    return sum(v * other.get(u, 0.0) for u, v in own.items()) / math.sqrt(norm or 1.0)


def _folded_words(text: str) -> list[list[bytes]]:
    import re

    return [[bytes(ord(c) - 96 for c in w) for w in s.lower().split()] for s in re.split(r"[.!?]+\s|\n", text)]


def test_string_kernel_against_brute_force():
    from gridweave.llm import toxicity as x

    rng = random.Random(3)
    word = lambda n: bytes(rng.choice(b"\x01\x02\x03\x04\x05") for _ in range(n))
    some = [word(n) for n in (1, 2, 3, 5, 9)] + [word(4) + b"\0" + word(3), word(2) + b"\0" + word(1) + b"\0" + word(6)]
    marks = [word(n) for n in (2, 4, 6)] + [word(3) + b"\0" + word(3)]
    index, table = x._landmark_table(marks)
    got = x._features(some, index, table)
    assert np.allclose(got, [[_kernel(s, t) for t in marks] for s in some], atol=1e-6)
    # Nystrom features of the landmarks have the kernel as inner products
    kernel = x._features(marks, index, table).astype(float)
    mapped = kernel @ x.nystrom(kernel)
    assert np.allclose(mapped @ mapped.T, kernel, atol=1e-3)


def test_window_scores_against_brute_force():
    """Scoring by one weight per subsequence gives each window the machine's value on its kernel features."""
    from gridweave.llm import toxicity as x

    rng = random.Random(4)
    marks = [bytes(rng.randrange(1, 8) for _ in range(n)) for n in (4, 5, 6, 7)]
    index, table = x._landmark_table(marks)
    alpha = np.array([0.7, -0.4, 1.1, 0.2])
    weights = x.folded(index, table, alpha)
    texts = ["abc de fga bcd. efga bb\ncdefg abdc", "", "ab", "gfedc bagfe. dcb agf edcba  gfe"]
    for text in texts:
        codes, sentence, _ = x.encode([text])
        start, end, score = x.window_scores(codes, sentence, weights)
        got = sorted((codes[a:b].tobytes(), round(float(v), 4)) for a, b, v in zip(start, end, score, strict=True))
        windows = [b"\0".join(ws[i : i + m]) for ws in _folded_words(text) for m in (1, 2, 3) for i in range(len(ws) - m + 1)]
        want = sorted((w, round(sum(a * _kernel(w, t) for a, t in zip(alpha, marks, strict=True)), 4)) for w in windows)
        assert [w for w, _ in got] == [w for w, _ in want]
        assert np.allclose([v for _, v in got], [v for _, v in want], atol=2e-4)
    each = [max([0.0] if not _folded_words(t)[0] else [float(v) for v in x.window_scores(*x.encode([t])[:2], weights)[2]]) for t in texts]
    assert np.allclose(x.worst_windows(texts, weights), each, atol=1e-5)


def test_machine_minimises_its_loss():
    from gridweave.llm import toxicity as x

    rng = np.random.default_rng(1)
    features, y = rng.standard_normal((300, 5)).astype(np.float32), np.where(rng.random(300) < 0.3, 1.0, -1.0)
    cost = rng.random(300)
    w = x._svm(features, y, cost)

    def loss(v):
        f = features.astype(float) @ v[:-1] + v[-1]
        return 0.5 * x.RIDGE * (v[:-1] ** 2).sum() + 0.5e-6 * v[-1] ** 2 + (cost * np.maximum(1 - y * f, 0) ** 2).sum()

    assert all(loss(w) <= loss(w + step) + 1e-9 for step in 0.01 * rng.standard_normal((200, 6)))


def test_toxicity_learns_sentences_of_several_words(spark, make):
    """An insult that only several harmless words make, and a toxic sentence far into a long text."""
    rng = random.Random(8)
    syllables = ["ka", "lo", "mi", "re", "tu", "sen", "dor", "pal"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4)))
    insult = ["zuv", "fib", "goq"]

    def text(toxic):
        sentences = [[word() for _ in range(8)] for _ in range(rng.choice([3, 6, 500]) if rng.random() < 0.05 else 4)]
        for w in insult:  # each word alone is harmless
            sentences[0].insert(rng.randrange(4) * 2, w)
        if toxic:
            s = sentences[-1]
            at = rng.randrange(len(s))
            s[at:at] = insult
        return ". ".join(" ".join(s) for s in sentences) + "."

    rows = [(i, text(i % 3 == 0), int(i % 3 == 0)) for i in range(600)]
    docs = make([(i, t) for i, t, _ in rows])
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in score_toxicity(docs, fit(docs, labels)).collect()}
    held = [(y, got[i]["predicted"]) for i, _, y in rows if got[i]["held_out"]]
    assert sum(a == b for a, b in held) / len(held) > 0.9, held


def test_toxicity_without_labels(spark, make):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = make([(1, "a"), (2, None)])
    assert [r["score"] for r in score_toxicity(docs, fit(docs, none)).collect()] == [0.0, 0.0]
    assert score_toxicity(make([]), fit(docs, none)).count() == 0


# --- quality


def test_quality_keeps_good_text(spark, make):
    rng = random.Random(2)
    good = ["the", "cat", "sat", "on", "a", "mat", "with", "its", "hat"]
    rows = [(i, " ".join(rng.choice(good) if i % 4 else f"{rng.choice(good)}***" for _ in range(60))) for i in range(400)] + [(900, None), (901, "")]
    docs = make(rows)
    labels = spark.createDataFrame([(i, int(bool(i % 4)), 0) for i in range(0, 400, 2)], "doc_id long, quality int, toxic int")
    out = resample(docs, labels).collect()
    share = sum(bool(i % 4) for i in range(0, 400, 2)) / 200
    assert len(out) == len(rows) and sum(r["kept"] for r in out) == round(share * len(rows))
    kept = [r["doc_id"] for r in out if r["kept"]]
    assert all(i % 4 for i in kept if i < 400)
    top = sorted(out, key=lambda r: (-r["key"], r["doc_id"]))[: len(kept)]
    assert {r["doc_id"] for r in top} == set(kept)
    assert resample(make([]), labels).count() == 0
    empty = spark.createDataFrame([], labels.schema)
    assert all(r["kept"] for r in resample(docs, empty).collect())


def test_quality_against_brute_force(spark, make):
    """Weights are sums of log ratios of two counted models; the kept rows are the k largest keys."""
    import re
    from collections import Counter

    from gridweave.llm import quality

    rng = random.Random(4)
    words = ["alpha", "Beta", "ga_mma", "??", "délta", "x1"]
    rows = [(i, " ".join(rng.choice(words[: 3 + 3 * (i % 2)]) for _ in range(rng.randrange(0, 30)))) for i in range(120)] + [(200, None), (201, " \t"), (None, "alpha ??beta"), (5, "alpha")]
    quality_of = {i: int(i % 3 > 0) for i in range(0, 60)}
    labels = spark.createDataFrame([(i, q, 0) for i, q in quality_of.items()], "doc_id long, quality int, toxic int")
    got = resample(make(rows), labels).collect()

    def grams(text):
        low = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())
        tokens = re.findall(rb"[0-9a-z_\x80-\xff]+|[^0-9a-z_\x80-\xff\x20\x09-\x0d]+", low)
        return [(t,) for t in tokens] + list(zip(tokens, tokens[1:], strict=False))

    raw, target = Counter(), Counter()
    for i, text in rows:
        raw.update(grams(text))
        if quality_of.get(i):
            target.update(grams(text))
    every = sorted({b"\n".join(g) for g in raw})
    import pyarrow as pa

    hashed, owner = quality.ngrams(pa.array([" ".join(x.decode() for x in g.split(b"\n")) for g in every]))
    assert len({tuple(hashed[owner == i]) for i in range(len(every))}) == len(every)  # no bucket is shared
    prior, share = quality.PRIOR, {g: raw[g] / raw.total() for g in raw}
    ratio = {g: math.log((target[g] + prior * share[g]) / (target.total() + prior)) - math.log(share[g]) for g in raw}
    want = sorted((str(i), len(grams(t)), round(sum(ratio[g] for g in grams(t)), 6)) for i, t in rows)
    assert sorted((str(r["doc_id"]), r["n_grams"], round(r["log_weight"], 6)) for r in got) == want
    k = round(sum(quality_of.values()) / len(quality_of) * len(rows))
    keys = sorted((r["key"] for r in got), reverse=True)
    assert sum(r["kept"] for r in got) == k and {r["key"] for r in got if r["kept"]} == set(keys[:k])


def test_quality_ties(spark, make):
    """Of equal keys exactly as many stay as are wanted, those of smaller id first."""
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 0)], "doc_id long, quality int, toxic int")
    for rows in ([(5, "same text")] * 10, [(5, "same text")] * 7 + [(None, "same text")] * 3, [(None, "t")] * 10, [(i % 2, "") for i in range(20)]):
        for share in (0.0, 0.1, 0.5, 0.8, 0.95):
            out = resample(make(rows), labels, share).collect()
            assert len(out) == len(rows) and sum(r["kept"] for r in out) == round(share * len(rows))
            low, high = (sorted((r["key"] for r in out if r["kept"] == x), reverse=True) for x in (True, False))
            assert not low or not high or low[-1] >= high[0]


# --- vectors


def vectors(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int").selectExpr("*", "1 AS row", "2 AS size")


def test_vectors(spark):
    rng = np.random.default_rng(0)
    rows, n = [], 0
    for label in (0, 1, None):
        centres = rng.standard_normal((12, 24))
        for c in centres:
            for _ in range(int(rng.integers(1, 40))):
                rows.append((n, (c + rng.standard_normal(24) * rng.choice([0.01, 0.15, 0.3])).astype(np.float32).tolist(), label))
                n += 1
    tight = rng.standard_normal(24)
    for _ in range(1200):  # larger than a block
        rows.append((n, (tight + rng.standard_normal(24) * 0.02).astype(np.float32).tolist(), 1))
        n += 1
    rows += [(n, None, 0), (n + 1, [0.0] * 24, 0), (n + 2, [math.nan] * 24, 0), (n + 3, [1.0, None] * 12, 0), (n + 4, [], 0), (n + 5, [math.inf] * 24, 0), (n + 6, [1.0] * 3, 0)]
    got = {r["vec_id"]: r for r in near_vectors(vectors(spark, rows), 0.93).collect()}
    assert len(got) == len(rows)
    want_links = missed = 0
    u = brute.Union()
    by_label = {}
    for i, v, label in rows:
        u.find(i)
        if label is not None and v and len(v) == 24 and all(x is not None and math.isfinite(x) for x in v) and any(v):
            by_label.setdefault(label, []).append((i, np.array(v, np.float64)))
        else:
            assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    for own in by_label.values():
        m = np.stack([v / np.linalg.norm(v) for _, v in own])
        near = m @ m.T >= 0.93
        np.fill_diagonal(near, False)
        for k, (i, _) in enumerate(own):
            links = int(near[k].sum())
            assert got[i]["n_links"] <= links
            want_links, missed = want_links + links, missed + links - got[i]["n_links"]
            for j in np.flatnonzero(near[k]):
                u.join(i, own[j][0])
    assert missed <= 0.01 * want_links
    assert sum(got[i]["component_id"] != u.find(i) for i in got) <= 0.01 * len(rows)
    assert all(r["kept"] == (r["component_id"] == i) for i, r in got.items())


def test_vectors_empty_and_double(spark):
    assert near_vectors(vectors(spark, [])).count() == 0
    rows = [(1, [1e300, 0.0], 3), (2, [2e300, 1e290], 3), (2, [0.0, 1.0], 3), (9, [1.0, 0.0], 4)]
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in near_vectors(vectors(spark, rows, "double")).collect())
    assert got == [(1, 1, 1), (2, 0, 2), (2, 1, 1), (9, 0, 9)]


@pytest.mark.parametrize("k", [0, 5])
def test_vectors_of_a_crowded_label(spark, monkeypatch, k):
    """A label whose vectors have a mean cosine of 0.8, with isolated pairs; by one bucket, dealt into blocks, and by many."""
    from gridweave.llm import embedneighbours

    monkeypatch.setattr(embedneighbours, "BUCKET", 1500, raising=False)
    if k:

        def fixed(*_):
            passes = embedneighbours.passes_for(k, 0.93)
            return lambda rows: rows[["label", "size"]].head(1).assign(k=k, passes=passes)

        monkeypatch.setattr(embedneighbours, "_choose", fixed, raising=False)
    rng = np.random.default_rng(5)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    x = unit(2 * unit(rng.standard_normal(64)) + unit(rng.standard_normal((6000, 64))))
    x = np.concatenate((x, unit(x[:1000] + 0.35 * unit(rng.standard_normal((1000, 64))))))
    rows = [(i, v, 1) for i, v in enumerate(x.astype(np.float32).tolist())]
    got = {r["vec_id"]: r for r in near_vectors(vectors(spark, rows), 0.93).collect()}
    m = unit(x.astype(np.float32).astype(np.float64))
    near = m @ m.T >= 0.93
    np.fill_diagonal(near, False)
    u = brute.Union()
    for i, j in zip(*np.nonzero(near), strict=True):
        u.join(int(i), int(j))
    links = near.sum(axis=1)
    found = sum(r["n_links"] for r in got.values())
    assert links.sum() >= 2000 and all(got[i]["n_links"] <= links[i] for i in got)
    assert found >= 0.998 * links.sum(), (found, links.sum())
    assert sum(got[i]["component_id"] != u.find(i) for i in got) <= 0.004 * len(rows)


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(k, k + 1) for k in range(1000, 1060)] + [(2000, k) for k in range(2001, 2200)] + [(None, 1), (7, 7)]
    u = brute.Union()
    for a, b in edges:
        if a is not None and a != b:
            u.join(a, b)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: u.find(x) for x in u}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_state_of_many_edges(spark):
    from gridweave.llm import graph

    edges = spark.range(20_000_000).selectExpr("id AS a", "id + 1 AS b")
    n, h = graph._state(edges)
    assert n == 20_000_000 and (n, h) == graph._state(edges.repartition(3)) and (n, h) != graph._state(edges.selectExpr("a", "a + 2 AS b"))


# --- URLs


def test_urls(spark):
    rows = [
        (1, "http://WWW.Example.com/en/x"), (2, "http://example.com/en/x?y#z"), (3, "https://a.b.example.com/fr/"), (4, "http://example.com"), (5, None), (6, "example.com/en/"),
        (7, "http://x.net/es/1"), (8, "http://net/fr/"), (9, "http://notnet/fr/"), (10, "http://x.net/es"), (11, "http://example.com?/en/"), (12, "x://"), (13, "http://example.com/en/a://b"), (13, "http://a.com/"),
        (14, "http://example.com:80/en/"), (15, "http://example.com#/en/"), (16, "://NET/es/"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'x' AS host", "'y' AS rule")
    got = sorted((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in judge_urls(pages, queries.URL_RULES).select("page_id", "host", "path", "rule", "verdict").na.fill("-").collect())
    assert got == [
        (1, "www.example.com", "/en/x", "www.example.com/en/", "allow"), (2, "example.com", "/en/x", "example.com/en/", "block"), (3, "a.b.example.com", "/fr/", "com/", "allow"),
        (4, "example.com", "", "-", "allow"), (5, "", "", "-", "allow"), (6, "", "", "-", "allow"), (7, "x.net", "/es/1", "net/es/", "block"), (8, "net", "/fr/", "net/fr/", "block"),
        (9, "notnet", "/fr/", "-", "allow"), (10, "x.net", "/es", "-", "allow"), (11, "example.com", "", "-", "allow"), (12, "", "", "-", "allow"),
        (13, "a.com", "/", "com/", "allow"), (13, "example.com", "/en/a://b", "example.com/en/", "block"), (14, "example.com:80", "/en/", "-", "allow"), (15, "example.com", "", "-", "allow"), (16, "net", "/es/", "net/es/", "block"),
    ]
    assert judge_urls(pages.limit(0), queries.URL_RULES).count() == 0
    assert {r["verdict"] for r in judge_urls(pages, [], "block").collect()} == {"block"}


def test_urls_of_very_many_labels(spark):
    """Expressions are as many as the rules' label counts, not the host's."""
    many = "a." * 100_000
    rows = [(1, f"http://{many}example.com/en/x"), (2, f"http://{many}net/es/"), (3, "http://" + "." * 50_000), (4, f"http://www.{many}com/{'x' * 200_000}"), (5, "http://" + "b" * 300_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    rules = [*queries.URL_RULES, (".", "", "block"), ("", "", "block")]
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in judge_urls(pages, rules).collect()}
    assert got == {1: ("example.com/en/", "block"), 2: ("net/es/", "block"), 3: (".", "block"), 4: ("com/", "allow"), 5: (None, "allow")}


def test_many_rules_are_joined_by_shuffle(spark, monkeypatch):
    from gridweave.llm import urlfilter

    pages = spark.read.parquet(f"{DIR}/pages.parquet")
    want = sorted(map(tuple, judge_urls(pages, queries.URL_RULES).na.fill("-").collect()))
    monkeypatch.setattr(urlfilter, "BROADCAST_RULES", 1)
    assert sorted(map(tuple, judge_urls(pages, queries.URL_RULES).na.fill("-").collect())) == want


# --- pipeline


def test_pipeline(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns, stage = docs.columns, dict(corpus_pipeline.STAGES)
    assert list(stage) == ["toxicity", "exact_dedup", "near_dedup", "mixing", "packing"] and corpus_pipeline.ORACLE_SQL is None
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    clean = stage["toxicity"](spark, docs, DIR).cache()
    scores = {r["doc_id"]: r["predicted"] for r in score_toxicity(docs, fit(docs, spark.read.parquet(f"{DIR}/labels.parquet"))).collect()}
    assert clean.columns == columns and {r["doc_id"] for r in clean.collect()} == {i for i, p in scores.items() if not p}
    unique = stage["exact_dedup"](spark, clean, DIR).cache()
    norm = lambda i: " ".join((texts[i] or "").split())
    ids = [r["doc_id"] for r in unique.collect()]
    assert unique.columns == columns and len({norm(i) for i in ids}) == len(ids) == len({norm(r["doc_id"]) for r in clean.collect()})
    left = stage["near_dedup"](spark, unique, DIR).cache()
    want = {i for i, (_, _, kept) in brute.near_duplicates([(i, texts[i]) for i in ids], 5, 80).items() if kept}
    assert left.columns == columns and {r["doc_id"] for r in left.collect()} == want
    mixed = stage["mixing"](spark, left, DIR).cache()
    assert mixed.columns == columns and {r["doc_id"] for r in mixed.collect()} <= want
    pieces = stage["packing"](spark, mixed, DIR).collect()
    assert {r["doc_id"] for r in pieces} == {r["doc_id"] for r in mixed.collect()}


AWKWARD = [
    (1, None, "en", None, None), (2, "", None, "a", 0), (None, "no id", "en", "a", 5), (None, "no  id", "en", "b", 6), (3, "same text", "en", "a", 9), (3, "same text", "en", "a", 9),
    (3, "another text of the id", "en", None, 9), (4, "x " * 30_000, "en", "a", 60_000), (5, "same\ttext", "de", "b", 9),
]


@pytest.mark.parametrize("kind", ["empty", "awkward", "no labels"])
def test_pipeline_of_awkward_tables(spark, tmp_path, kind):
    """All stages on an empty table, on nulls, repeats and clashing column names, and without labels."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rows = [] if kind == "empty" else AWKWARD
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    clashing = {c: "'x'" for c in ("slot", "place", "th", "digest", "kept", "key", "row", "copies", "size", "`a.b`")}
    docs.selectExpr("*", *(f"{v} AS {k}" for k, v in clashing.items())).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [] if kind == "no labels" else [(1, 1, 0), (2, 0, 1), (3, 1, 0), (4, None, None), (None, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    if kind == "empty":
        assert not pieces
        return
    taken = defaultdict(list)
    for r in pieces:
        taken[r["row"]].append(r)
    for own in taken.values():  # every row of the mix lies in the windows once
        assert sum(r["length"] for r in own) == own[0]["doc_tokens"]
        assert sorted(r["start"] for r in own) == [sum(r["length"] for r in own if r["start"] < x) for x in sorted(r["start"] for r in own)]
    if kind == "no labels":
        texts = {(i, " ".join((t or "").split())) for i, t, *_ in AWKWARD}
        assert {r["doc_id"] for r in pieces} <= {i for i, _ in texts} and 5 not in {r["doc_id"] for r in pieces}
