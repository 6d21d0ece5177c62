"""Operators over documents, against brute force, with awkward rows and empty tables."""

import random
import re
import zlib
from collections import defaultdict

import pytest

from gridweave.llm import queries
from gridweave.llm.exactdedup import exact_duplicates, without_duplicates
from gridweave.llm.minhash import near_duplicates, without_near_duplicates
from gridweave.llm.mixing import mix, mixed
from gridweave.llm.packing import differencing, pack, pack_block
from gridweave.llm.repeats import repeated_passages
from gridweave.llm.tokencount import count_tokens

from . import brute
from .conftest import DIR


def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def documents(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet")


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


# --- near duplicates


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(spark, make, awkward, size):
    for df in (make(awkward), documents(spark)):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(df, size, 80).collect()}
        assert got == brute.near_duplicates(rows_of(df), size, 80)


def test_near_copies_of_one_text_and_bridges(make):
    """A cloud of copies that differ from each other by more than from their source, and chains."""
    rng = random.Random(1)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    rows = []
    for i in range(120):
        own = list(base)
        for _ in range(rng.randrange(0, 9)):
            own[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
        rows.append((1000 - i, " ".join(own)))
    df = make(rows)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(df, 2, 80).collect()}
    assert got == brute.near_duplicates(rows, 2, 80)


def test_near_duplicates_of_repeated_and_missing_ids(make):
    """Rows of one id are judged by their own texts; rows without id are compared like any other."""
    rng = random.Random(11)
    text = lambda: [f"w{rng.randrange(10**6)}" for _ in range(60)]
    one, two, three = text(), text(), text()
    near = lambda t: " ".join([*t[:-1], "changed"])
    rows = [(1, " ".join(one)), (7, near(one)), (7, " ".join(two)), (9, near(two)), (None, " ".join(three)), (None, near(three)), (None, near(one)), (12, " ".join(text()))]
    got = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(make(rows), 2, 80).collect()}
    assert got == {(1, 59, 1, True), (7, 59, 1, False), (7, 59, 7, True), (9, 59, 7, False), (None, 59, None, True), (None, 59, 1, False), (12, 59, 12, True)}
    left = sorted((str(r["doc_id"]), r["text"]) for r in without_near_duplicates(make(rows), 2, 80).collect())
    assert left == sorted((str(i), t) for i, t in (rows[0], rows[2], rows[4], rows[5], rows[7]))


def test_near_duplicates_with_a_shared_half(make, monkeypatch):
    """Texts of which half is one boilerplate: buckets stay split, but rare shingles bring few pairs."""
    from gridweave.llm import minhash

    counts = []
    across = minhash._across
    monkeypatch.setattr(minhash, "_across", lambda *a: (out := across(*a), counts.append(out.count()))[0])
    rng = random.Random(12)
    common = [f"c{k}" for k in range(60)]
    rows = []
    for i in range(300):
        own = [*common, *(f"u{rng.randrange(10**6)}" for _ in range(40))]
        rows.append((2 * i, " ".join(own)))
        if i % 10 == 0:
            rows.append((2 * i + 1, " ".join([*own[:-2], "x", "y"])))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(make(rows), 2, 80).collect()}
    assert got == brute.near_duplicates(rows, 2, 80)
    assert all(n <= 100 for n in counts), counts


def test_near_duplicates_empty_and_filter(spark, make, awkward):
    assert near_duplicates(make([]), 2, 80).count() == 0
    df = make(awkward)
    kept = without_near_duplicates(df, 2, 80)
    want = {i for i, (_, _, keep) in brute.near_duplicates(awkward, 2, 80).items() if keep}
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == want


# --- exact duplicates


def test_exact_duplicates(make, awkward):
    rows = [*awkward, (7, "other text of a repeated id"), (6, "two  words"), (6, "two  words")]
    got = exact_duplicates(make(rows)).collect()
    assert len(got) == len(rows)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append(i)
    import hashlib

    by_hash = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in groups.items()}
    for r in got:
        own = by_hash[r["text_sha256"]]
        assert (r["keep_id"], r["group_size"]) == (min(own), len(own))
    assert sum(r["kept"] for r in got) == len(groups)
    left = without_duplicates(make(rows)).collect()
    assert sorted(norm(r["text"]) for r in left) == sorted(groups)
    assert exact_duplicates(make([])).count() == 0 and without_duplicates(make([])).count() == 0


def test_exact_duplicates_of_two_arrivals(spark, make, awkward, tmp_path):
    """The second call goes on with the first one's state, reads only its own rows, and fetches earlier content by locator."""
    state, first, second = (str(tmp_path / x) for x in ("state", "one.parquet", "two.parquet"))
    make([(10, "a b"), (11, "alone"), (12, "a  b")]).write.parquet(first)
    make([(5, "a\nb"), (20, "alone"), (21, "new"), (None, "new"), (22, "own")]).write.parquet(second)
    key = lambda r: (r["doc_id"], r["keep_id"], r["group_size"], r["kept"])
    one = exact_duplicates(spark.read.parquet(first), state).collect()
    assert sorted(map(key, one)) == [(10, 10, 2, True), (11, 11, 1, True), (12, 10, 2, False)]
    two = exact_duplicates(spark.read.parquet(second), state).collect()
    assert sorted(map(key, two), key=str) == sorted([(5, 5, 3, True), (20, 11, 2, False), (21, 21, 2, True), (None, 21, 2, False), (22, 22, 1, True)], key=str)
    three = exact_duplicates(make([(1, "own"), (2, None)]), state).collect()  # not from a file
    assert sorted(map(key, three)) == [(1, 1, 2, True), (2, 2, 1, True)]
    four = exact_duplicates(make([(3, "")]), state).collect()  # meets the copy of the third arrival
    assert sorted(map(key, four)) == [(3, 2, 2, False)]
    assert exact_duplicates(make([]), state).count() == 0


def test_exact_duplicates_with_colliding_digests(spark, make, monkeypatch, tmp_path):
    """Digests that say little: full bytes tell the texts apart, within an arrival and between two."""
    from pyspark.sql import functions as F

    from gridweave.llm import exactdedup

    monkeypatch.setattr(exactdedup, "digest_of", lambda body: F.unhex(F.substring(F.sha2(body, 256), 1, 1)))
    rows = [(i % 40, f"text {i % 60 // 3}") for i in range(300)] + [(None, "text 1"), (7, "text 1"), (7, "text 2")]
    got = exact_duplicates(make(rows)).collect()
    groups = defaultdict(list)
    for i, t in rows:
        groups[t].append(i)
    assert len(got) == len(rows)
    want = sorted((str(i), min(x for x in groups[t] if x is not None), len(groups[t])) for i, t in rows)
    assert sorted((str(r["doc_id"]), r["keep_id"], r["group_size"]) for r in got) == want
    assert sum(r["kept"] for r in got) == len(groups)
    state, first = str(tmp_path / "state"), str(tmp_path / "one.parquet")
    make([(i, f"old {i}") for i in range(30)]).write.parquet(first)
    exact_duplicates(spark.read.parquet(first), state).count()
    later = exact_duplicates(make([(100 + i, f"old {i}" if i < 5 else f"new {i}") for i in range(30)]), state).collect()
    assert all(r["keep_id"] == (r["doc_id"] - 100 if r["doc_id"] < 105 else r["doc_id"]) for r in later)
    assert all(r["kept"] == (r["doc_id"] >= 105) for r in later)


# --- the sieve


def test_sieve_of_too_many_keys_is_a_join(spark, make, awkward, monkeypatch):
    """Results don't depend on whether keys are looked for in a bitmap, however full, or by joins."""
    from gridweave.llm import sieve

    rows = [*awkward, *((100 + i, " ".join(f"w{(i // 4) * 50 + k}" for k in range(60)) + " " + "x" * (i % 4)) for i in range(80))]
    df = make(rows)
    run = lambda: (
        sorted(map(str, near_duplicates(df, 2, 80).collect())), sorted(map(str, repeated_passages(df).collect())),
        sorted(map(str, without_duplicates(df).collect())), sorted(map(str, without_near_duplicates(df, 2, 80).collect())),
    )
    want = run()
    monkeypatch.setattr(sieve, "MOST_KEYS", -1)
    assert run() == want
    monkeypatch.undo()

    class Full(sieve.Sieve):
        def __init__(self, *a, **k):
            super().__init__(*a, **k)
            self.bitmap = self.keys.sparkSession.sparkContext.broadcast(b"\xff" * (self.bits // 8))

    for module in ("minhash", "repeats", "exactdedup"):
        monkeypatch.setattr(f"gridweave.llm.{module}.Sieve", Full)
    assert run() == want


# --- repeated passages


def test_repeats(make, awkward):
    rng = random.Random(2)
    text = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz é") for _ in range(n))
    shared = [text(400), text(199), text(200), text(215)]
    rows = [*((i, t) for i, t in awkward if i not in (11, 12))]
    for i in range(60):
        parts = [text(rng.randrange(0, 150))]
        for s in rng.sample(shared, rng.randrange(0, 3)):
            low = rng.randrange(0, 40)
            parts += [s[low:], text(rng.randrange(0, 60))]
        rows.append((100 + i, "".join(parts)))
    cloud = text(1500)
    for i in range(25):  # near copies with changed, missing and added letters
        own = list(cloud)
        for _ in range(rng.randrange(0, 8)):
            p = rng.randrange(len(own))
            own[p : p + rng.randrange(0, 2)] = [text(1)] * rng.randrange(0, 2)
        rows.append((300 + i, "".join(own)))
    rows += [(500, cloud + cloud), (501, "ab" * 700), (502, shared[0])]
    import hashlib

    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeated_passages(make(rows)).collect()}
    want = {i: (*v[0][:3], hashlib.sha256(v[0][3]).hexdigest()) for i, v in brute.repeats(rows, 200).items()}
    assert got == want
    assert repeated_passages(make([])).count() == 0


@pytest.mark.parametrize("partitions", [1, 4, 50])
def test_repeats_of_few_contexts(spark, make, partitions):
    """Texts that share less than a passage leave a few contexts to sort, none of which may meet itself."""
    import hashlib

    rng = random.Random(7)
    text = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    cases = []
    for size in (150, 190):
        shared = text(size)
        cases.append([(i, text(300) + shared + text(300)) for i in range(1, 4)])
    parts = [text(190) for _ in range(5)]  # 15 contexts, and no repeat
    cases.append([(i, "".join(text(100) + p for p in parts)) for i in range(3)])
    long = text(260)  # few contexts that do repeat, among others that don't
    cases.append([(1, text(120) + long + text(90)), (2, text(200) + long), (3, text(80) + long[:199] + text(80)), (4, long[30:])])
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for rows in cases:
            got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeated_passages(make(rows)).collect()}
            assert got == {i: (*v[0][:3], hashlib.sha256(v[0][3]).hexdigest()) for i, v in brute.repeats(rows, 200).items()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_repeats_in_rows_without_id(make):
    import hashlib

    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    shared = text(400)
    rows = [(i, text(250) + shared + text(250)) for i in (None, 1, 2)] + [(3, text(500))]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeated_passages(make(rows)).collect()}
    assert got == {i: (*v[0][:3], hashlib.sha256(v[0][3]).hexdigest()) for i, v in brute.repeats(rows, 200).items()}


# --- tokens and packing


def test_token_counts(spark, make, awkward):
    lib = library()
    for df in (make(awkward), documents(spark)):
        got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in count_tokens(df).collect()}
        for i, t in rows_of(df):
            n = len(lib.encode(t or "", add_special_tokens=False).ids)
            assert got[i] == (len((t or "").encode()), n, n > 512)
    assert count_tokens(make([])).count() == 0


SCRIPTS = [
    "Съешь же ещё этих мягких французских булок, да выпей чаю 123 раза!", "私は学生です。東京2024年、大学に行きます", "مرحبا بالعالم ١٢٣ كيف حالك؟", "😀👍🏽 emoji\u200dzwj 🇫🇷 e\u0301tude", "हिन्दी पाठ १२३",
    "a\u00a0b\u2003c\u3000d \x1c\x1d\x85 e\u2028f", "½ Ⅷ ①x² ٣", "it's IT'S don't they'll 'tis we've", "\ufb01ligature ŉ ǅ", "\u0378 unassigned \u1c89", "x" * 1000 + " " + "漢" * 700, "   \n\n  two  ",
]


def test_lookup_serves_all_scripts(make, monkeypatch):
    """Ids and counts are the library's, without asking it for whole texts unless a character is unassigned."""
    from gridweave.llm import pretokens

    lib = library()
    own = pretokens.Encoder(__import__("public_tokenizers").path("byte_bpe_50k.json"), __import__("public_tokenizers").path("byte_bpe_50k.tiktoken"))
    asked = []
    monkeypatch.setattr(own, "library", lambda t: (asked.append(t), lib.encode(t, add_special_tokens=False).ids)[1])
    for text in SCRIPTS:
        for _ in range(2):
            assert own.ids(text) == pretokens.to_bytes(lib.encode(text, add_special_tokens=False).ids), text
    assert set(asked) == {SCRIPTS[9]}
    assert all(len(p) <= pretokens.LONGEST for p in own.cache.table)
    got = {r["doc_id"]: r["n_tokens"] for r in count_tokens(make(list(enumerate(SCRIPTS)))).collect()}
    assert got == {i: len(lib.encode(t, add_special_tokens=False).ids) for i, t in enumerate(SCRIPTS)}


def test_cuts_agree_on_every_character():
    """For all of Unicode: what the regular expressions cut, the library cuts, or the character is left to it."""
    from gridweave.llm import pretokens

    lib = library().pre_tokenizer
    own = pretokens.Encoder(__import__("public_tokenizers").path("byte_bpe_50k.json"), None)
    for low in range(0, 0x110000, 128):
        chars = [chr(c) for c in range(low, low + 128) if not 0xD800 <= c < 0xE000]
        chars = [c for c in chars if not pretokens.unassigned().match(c)]
        text = "".join(f"a{c}1{c}-{c} {c}{c}" for c in chars)
        if chars:
            assert own.cut(text) == [text[a:b] for _, (a, b) in lib.pre_tokenize_str(text)], hex(low)


def test_cache_is_bounded_in_bytes(monkeypatch):
    from gridweave.llm import pretokens

    monkeypatch.setattr(pretokens, "CACHE_BYTES", 10 * pretokens.ENTRY)
    cache = pretokens.Cache({"the": 1})
    for i in range(1000):
        cache.learn(f"w{i}", i)
        assert cache.table["the"] == 1 and len(cache.table) <= 11 and cache.table[f"w{i}"] == i
    cache.learn("x" * 10_000, 3)
    assert "x" * 10_000 not in cache.table


def test_workers_give_memory_back():
    from pathlib import Path

    import numpy as np
    import pyarrow as pa

    from gridweave.llm.runtime import tidy

    def held() -> int:
        return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) // 1024

    pinned = []

    def grow(batches):
        for batch in batches:
            freed = [np.ones(8000) for _ in range(3200)]  # 200 MB in pieces that malloc keeps
            pinned.append(np.ones(8000))  # lies above them, so that the heap can't shrink from its end
            del freed
            yield batch

    one = pa.RecordBatch.from_arrays([pa.array(["a", None])], names=["text"])
    before = held()
    assert [b.to_pydict() for b in tidy(grow)(iter([one, one]))] == [{"text": ["a", None]}] * 2
    assert held() - before < 100
    assert list(tidy(grow)(iter([]))) == []


def test_mappers_give_memory_back(make, monkeypatch):
    rows = make([(1, "a b c d e f g h"), (2, "a b c d e f g h i"), (3, None)])
    seen, real = [], type(rows).mapInArrow
    monkeypatch.setattr(type(rows), "mapInArrow", lambda df, f, *more: (seen.append(f.__qualname__), real(df, f, *more))[1])
    near_duplicates(rows)
    pack(rows)
    assert len(seen) >= 2 and set(seen) == {"tidy.<locals>.run"}


def test_packing_round_trip(spark, make, awkward):
    lib = library()
    for df in (make(awkward), documents(spark)):
        pieces = pack(df, 1024).collect()
        by_doc, by_seq = defaultdict(list), defaultdict(list)
        for r in pieces:
            assert zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] > 0
            by_doc[r["doc_id"]].append(r)
            by_seq[r["sequence_id"]].append(r)
        for i, t in rows_of(df):
            want = b"".join(x.to_bytes(4, "little") for x in [*lib.encode(t or "", add_special_tokens=False).ids, 0])
            own = sorted(by_doc[i], key=lambda r: r["start"])
            assert b"".join(bytes(r["ids"]) for r in own) == want and all(r["doc_tokens"] == len(want) // 4 for r in own)
        total = padding = 0
        assert len({r["row"] for r in pieces}) == df.count() and len({(r["row"], r["start"]) for r in pieces}) == len(pieces)
        for own in by_seq.values():
            at = 0
            for r in sorted(own, key=lambda r: r["offset"]):
                assert r["offset"] == at
                at += r["length"]
            assert at <= 1024
            total, padding = total + at, padding + (0 if at & (at - 1) == 0 else 1024 - at)
        assert padding <= 0.01 * total + 4 * 1024  # each task may leave one window open
    assert pack(make([])).count() == 0


def test_differencing_is_near_equal():
    rng = random.Random(4)
    sizes = [rng.randrange(1, 200) for _ in range(300)]
    parts = differencing(sizes, 20)
    sums = [sum(sizes[i] for i in p) for p in parts]
    assert sorted(i for p in parts for i in p) == list(range(300)) and max(sums) - min(sums) <= 0.01 * sum(sums) / 20


def test_windows_come_from_differencing(monkeypatch):
    """Every window is a part that differencing gave, the count rises until all fit, and pieces tile their items."""
    from gridweave.llm import packing

    calls = []

    def counted(sizes, k):
        calls.append((k, differencing(sizes, k)))
        return calls[-1][1]

    monkeypatch.setattr(packing, "differencing", counted)
    rng = random.Random(5)
    for capacity, own in ((1024, [1]), (1024, [1023, 1]), (1024, [rng.randrange(1, 1024) for _ in range(768)]), (4, [3, 3, 3]), (1, [1, 1]), (1024, [600] * 90)):
        calls.clear()
        pieces, windows = pack_block(own, capacity)
        assert windows == [w for w in calls[-1][1] if w] and [k for k, _ in calls] == list(range(calls[0][0], calls[-1][0] + 1))
        assert all(sum(pieces[p][2] for p in w) <= capacity for w in windows)
        assert all(any(sum(pieces[p][2] for p in w) > capacity for w in parts) for _, parts in calls[:-1])
        tiled = [(i, x) for i, start, n in sorted(pieces) for x in range(start, start + n)]
        assert tiled == [(i, x) for i, n in enumerate(own) for x in range(n)]
        assert sorted(p for w in windows for p in w) == list(range(len(pieces)))
        if len(own) > 100:
            assert len(windows) <= 1.01 * sum(own) / capacity


# --- mixing


def targets(size, share=1.5):
    order = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None] * (None in size)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    out, left, open_ = {}, share * sum(size.values()), set(order)
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > 2 * size[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in open_}
        for s in over:
            out[s] = 2 * size[s]
        left -= sum(out[s] for s in over)
        open_ -= set(over)
    return out


def test_mixing(make):
    rng = random.Random(6)
    rows = [(i, " ".join(["w"] * int(rng.lognormvariate(4, 1))), rng.choice(["é", "b", "a", "Z", None])) for i in range(1500)]
    rows += [(2000, None, "a"), (2001, "", None), (2002, "x", "empty"), (2003, None, "void"), (0, rows[0][1], rows[0][2])]
    got = mix(make(rows)).collect()
    assert len(got) == len(rows)
    size, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        size[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert r["taken"] == r["copies"] * r["size"] <= 2 * r["size"]
    want = targets(dict(size))
    for s in size:
        assert target[s] == pytest.approx(want[s], abs=1e-6)
        assert abs(taken[s] - target[s]) <= 0.01 * target[s] + 2
    key = lambda r: (r["doc_id"], r["size"], r["taken"])
    assert sorted(map(key, mix(make(rows)).collect())) == sorted(map(key, got))
    df = make(rows)
    out = mixed(df)
    assert out.columns == df.columns
    assert sum(len((r["text"] or "").split()) for r in out.collect()) == sum(taken.values())
    assert mix(make([])).count() == 0


def test_mixing_cuts(spark):
    from gridweave.llm.mixing import _cuts

    rng = random.Random(9)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(4), rng.randrange(30), rng.choice([0.25, 0.5, 1.0, 1.75]), rng.randrange(1, 64)) for _ in range(800)]
    frame = spark.createDataFrame(rows, "source string, class int, part int, rate double, size long").selectExpr("*", "floor(rate) AS base")
    words, due = defaultdict(int), defaultdict(float)
    for source, c, part, rate, size in rows:
        if rate > int(rate):
            words[source, c, part] += size
            due[source, c] += (rate - int(rate)) * size
    want = {}
    for source in ("a", "b", None):
        taken, goal, want[source] = 0, 0.0, {}
        for c in range(4):
            goal += due[source, c]
            for part in sorted(p for s, k, p in words if (s, k) == (source, c)):
                if taken + words[source, c, part] / 2 > goal:
                    want[source][c] = part
                    break
                taken += words[source, c, part]
    assert {r["source"]: r["cuts"] for r in _cuts(frame).collect()} == want


# --- the queries


def test_registered(spark):
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 11)]
    assert set(queries.SQL) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    got = queries.QUERIES[name](spark, DIR)
    rows = con.execute(queries.SQL[name]).fetchdf()[got.columns].astype(object)
    clean = lambda r: tuple(None if x is None or x != x else x for x in r)
    assert sorted(map(repr, (clean(r) for r in rows.itertuples(index=False)))) == sorted(map(repr, (clean(r) for r in got.toPandas().astype(object).itertuples(index=False))))
