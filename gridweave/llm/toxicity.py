"""Toxicity by a support vector machine on a gap-weighted subsequence string kernel with Nystrom landmarks.

Kernel. phi_u(s) sums DECAY**span over the occurrences of the 4-letter subsequence u in a string s of words,
spans of up to 6 letters, breaks between words counting as letters; k(s, t) = <phi(s), phi(t)> /
sqrt(c(|s|) c(|t|)), c(n) being the self-kernel of n different letters. Gaps let a word with inserted or
missing letters match, within words and across them; punctuation is skipped and letters set apart by single
spaces are joined, so that i.d.i.o.t and i d i o t match too.

Training. The examples are sentences with the label of their document. A sentence is as toxic as its worst
window, one to WORDS words long: of a long sentence a short insult must not be diluted. Of a toxic document
only the worst sentence need be toxic, so the examples are chosen anew as the machine improves (multiple
instances): each toxic document's worst sentence by its worst window, the words that recur in toxic documents
and in no clean one, and of clean documents' sentences the windows that the machine finds worst and a fixed
sample of all others. A window's features are its kernel
values with the landmarks, whitened by the landmarks' kernel matrix (Nystrom); the machine minimises squared
hinge loss plus a ridge. The commonest positive windows are also shown with a letter put in at each place,
with a tenth of the weight, so that such spellings pass the threshold: the kernel alone finds most of them,
but not all. Folded back through the landmarks the machine is one weight per subsequence, so scoring is
linear in the text. Platt's sigmoid makes the margin a probability.

Labels are learnt from at most TRAIN_ROWS clean and toxic rows (those of smallest hash of the id), from all of
their sentences; texts are scored whole, whatever their length. Language, source and id are no inputs.

Defined results: null and word-less texts get the score of no evidence; without training rows of both
classes every score is the toxic share (0 if unknown); conflicting labels of one id: the larger; extra
columns are ignored; repeated rows stay; an empty table gives an empty one.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import filtered, prepare, tidy

#: At most so many clean and toxic training documents.
TRAIN_ROWS = (3000, 1500)
LANDMARKS, ROUNDS = 240, 4
DECAY, SPAN, RIDGE = 0.7, 6, 1e-3
#: Words of a sentence's window at most; breaks crossed by a subsequence are fewer.
WORDS = 3
#: Windows of clean sentences shown as negatives: hard ones, and others by position.
HARD, OTHERS = 20_000, 18_000
#: The hardest of them weigh as much as all others.
HARDEST = 1000
#: Positive windows that are also shown with an inserted letter.
SPOILT = 60
THRESHOLD = 0.7
#: Letters scored at a time in training, and in a task beyond which texts aren't put together.
CHUNK, PORTION = 1 << 19, 1 << 17

BREAK, DROP = 0, 255
#: Offsets of the 2nd to 4th letter from the 1st, and the weight of that span.
OFFSETS = [(a, b, c, DECAY ** (c + 1)) for c in range(3, SPAN) for b in range(2, c) for a in range(1, b)]
CODES = 1 << 20


def _fold_table() -> np.ndarray:
    """Code of each character below U+3000: 0 breaks words, 255 is skipped, 1-26 are letters without accents."""
    table = np.full(0x3000, DROP, np.uint8)
    for cp in range(0x3000):
        ch = chr(cp)
        if ch.isspace():
            table[cp] = BREAK
        elif ch.isalpha():
            base = unicodedata.normalize("NFKD", ch)[0].lower()
            table[cp] = ord(base) - 96 if "a" <= base <= "z" else 27 + cp % 4
        elif ch.isdigit():
            table[cp] = 31
    return table


FOLD = _fold_table()


#: Marks that end a sentence before white space.
STOPS = np.array([ord(c) for c in ".!?…。！？"], np.uint32)


def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letter codes of all texts with a break before and after every word, the sentence number of each, and the texts' n + 1 bounds."""
    joined = "\n".join(["", *texts]) + "\n"
    cps = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(cps < 0x3000, FOLD[np.minimum(cps, 0x2FFF)], 27 + (cps & 3).astype(np.uint8)).astype(np.uint8)
    stop = cps == 10
    stop[:-1] |= np.isin(cps[:-1], STOPS) & (codes[1:] == BREAK)
    sentence = np.cumsum(stop, dtype=np.int32)
    bounds = np.concatenate(([1], 1 + np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)))
    keep = codes != DROP
    codes, sentence, bounds = _kept(keep, codes, sentence, bounds)
    # join letters that single spaces set apart: drop a break between two one-letter words of a text
    is_break = codes == BREAK
    last = np.zeros(len(codes) + 1, bool)
    last[bounds] = True
    single = np.zeros(len(codes), bool)
    single[1:-1] = ~is_break[1:-1] & is_break[:-2] & is_break[2:]
    lone = np.zeros(len(codes), bool)
    lone[1:-1] = is_break[1:-1] & single[:-2] & single[2:] & ~last[2:-1]
    # of breaks in a row the last stays
    lone[:-1] |= is_break[:-1] & is_break[1:]
    return _kept(~lone, codes, sentence, bounds)


def _kept(keep: np.ndarray, codes: np.ndarray, sentence: np.ndarray, bounds: np.ndarray):
    at = np.concatenate(([0], np.cumsum(keep)))
    return codes[keep], sentence[keep], at[bounds]


def word_bounds(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    solid = codes != BREAK
    before = np.concatenate(([False], solid[:-1]))
    after = np.concatenate((solid[1:], [False]))
    return np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1


def _self_kernel(n: np.ndarray) -> np.ndarray:
    """c(n) for n different letters with a break at either side."""
    n = np.asarray(n) + 2
    out = np.zeros(n.shape)
    for _, _, c, w in OFFSETS:
        out += np.maximum(n - c, 0) * w * w
    return np.maximum(out, 1e-12)


def subsequences(codes: np.ndarray) -> Iterator[tuple[np.ndarray, int, float]]:
    """For each offset pattern: code of the subsequence from each position, its span, its weight.

    A break may be its first or last letter, so that words of two letters have features.
    """
    n = len(codes)
    wide = codes.astype(np.int32)
    for a, b, c, w in OFFSETS:
        m = n - c
        if m > 0:
            yield ((wide[:m] * 32 + wide[a : a + m]) * 32 + wide[b : b + m]) * 32 + wide[c : c + m], c, w


def rooms(codes: np.ndarray) -> list[np.ndarray]:
    """For each position the distances to the first WORDS breaks after it."""
    n = len(codes)
    breaks = np.flatnonzero(codes == BREAK)
    after = np.searchsorted(breaks, np.arange(n), side="right")
    padded = np.concatenate((breaks, np.full(WORDS, n + 2 * SPAN)))
    return [np.minimum(padded[after + k] - np.arange(n), 100).astype(np.int8) for k in range(WORDS)]


def position_scores(codes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """[k, i]: the weighted sum over the subsequences from position i that cross exactly k breaks."""
    out = np.zeros((WORDS, len(codes)), np.float32)
    room = rooms(codes)
    for code, c, w in subsequences(codes):
        m = len(code)
        value = weights[code] * np.float32(w)
        low = None
        for k in range(WORDS):
            within = room[k][:m] >= c
            out[k, :m] += value * (within if low is None else within & ~low)
            low = within
            if k == 0 and within.all():
                break
    return out


def window_scores(codes: np.ndarray, sentence: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and length-normalised score of every window of up to WORDS words of one sentence."""
    start, end = word_bounds(codes)
    own = sentence[start]
    run = np.zeros((WORDS, len(codes) + 1))
    np.cumsum(position_scores(codes, weights), axis=1, dtype=np.float64, out=run[:, 1:])
    firsts, lasts, found = [], [], []
    for m in range(1, WORDS + 1):
        j = np.flatnonzero(own[m - 1 :] == own[: max(0, len(own) - m + 1)])
        low, high = start[j] - 1, end[j + m - 1]
        total = run[0][high] - run[0][low]
        for k in range(1, m):  # what crosses k breaks starts k words before the window's last, or earlier
            total += run[k][start[j + m - k] - 1] - run[k][low]
        firsts.append(low + 1)
        lasts.append(high)
        found.append(total / np.sqrt(_self_kernel(high - low - 1)))
    return np.concatenate(firsts), np.concatenate(lasts), np.concatenate(found)


def worst_windows(texts: list[str], weights: np.ndarray) -> np.ndarray:
    """For each text its largest window score, 0 without words."""
    best, low = np.zeros(len(texts)), 0
    while low < len(texts):
        high, letters = low + 1, len(texts[low])
        while high < len(texts) and letters + len(texts[high]) <= PORTION:
            letters += len(texts[high])
            high += 1
        codes, sentence, bounds = encode(texts[low:high])
        start, _, score = window_scores(codes, sentence, weights)
        worst = np.full(high - low, -np.inf)
        np.maximum.at(worst, np.searchsorted(bounds, start, side="right") - 1, score)
        best[low:high] = np.where(np.isfinite(worst), worst, 0.0)
        low = high
    return best


# --- training, on the driver, over the bounded sample


def _features(windows: list[bytes], index: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Kernel values of windows (letter codes, words set apart by breaks) with the landmarks behind index and table."""
    out = np.zeros((len(windows), table.shape[1]), np.float32)
    for low in range(0, len(windows), 2000):
        part = windows[low : low + 2000]
        codes = np.frombuffer(b"".join(b"\0" + w + b"\0" for w in part), np.uint8)
        size = np.array([len(w) for w in part])
        begin = np.concatenate(([0], np.cumsum(size + 2)[:-1]))
        owner = np.repeat(np.arange(len(part)), size + 2)
        room = (begin + size + 1)[owner] - np.arange(len(codes))
        for code, c, w in subsequences(codes):
            row = index[code]
            hit = np.flatnonzero((room[: len(code)] >= c) & (row >= 0))
            if len(hit):
                who = owner[hit]
                cuts = np.flatnonzero(np.concatenate(([True], who[1:] != who[:-1])))
                out[low + who[cuts]] += np.add.reduceat(table[row[hit]], cuts, axis=0) * np.float32(w)
        out[low : low + len(part)] /= np.sqrt(_self_kernel(size))[:, None]
    return out


def _landmark_table(marks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """index: subsequence code -> row or -1; table[row, j] = phi of landmark j, normalised."""
    found: dict[int, dict[int, float]] = {}
    for j, word in enumerate(marks):
        norm = float(np.sqrt(_self_kernel(np.array(len(word)))))
        for code, _, w in subsequences(np.frombuffer(b"\0" + word + b"\0", np.uint8)):
            for u in code:
                own = found.setdefault(int(u), {})
                own[j] = own.get(j, 0.0) + w / norm
    index = np.full(CODES, -1, np.int32)
    table = np.zeros((len(found), len(marks)), np.float32)
    for row, (u, own) in enumerate(sorted(found.items())):
        index[u] = row
        for j, v in own.items():
            table[row, j] = v
    return index, table


def _svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Weights (last: bias) minimising RIDGE/2 |w|^2 + sum cost * max(0, 1 - y f)^2 by Newton steps."""
    w = np.zeros(x.shape[1] + 1)
    ridge = np.full(len(w), RIDGE)
    ridge[-1] = 1e-6
    value = lambda v: x @ v[:-1].astype(x.dtype) + v[-1]
    loss = lambda v: 0.5 * (ridge * v * v).sum() + (cost * np.maximum(1 - y * value(v), 0) ** 2).sum()
    now = loss(w)
    for _ in range(60):
        margin = 1 - y * value(w)
        gradient, hessian = ridge * w, np.diag(ridge)
        on = np.flatnonzero(margin > 0)
        for at in range(0, len(on), 4096):
            i = on[at : at + 4096]
            part = np.hstack((x[i].astype(np.float64), np.ones((len(i), 1))))
            gradient -= 2 * part.T @ (cost[i] * y[i] * margin[i])
            hessian += 2 * (part * cost[i, None]).T @ part
        if np.linalg.norm(gradient) < 1e-6:
            break
        step, size = np.linalg.solve(hessian, gradient), 1.0
        while size > 1e-6 and (new := loss(w - size * step)) > now - 1e-4 * size * (gradient @ step):
            size /= 2
        if size <= 1e-6:
            break
        w, now = w - size * step, new
    return w


def _platt(f: np.ndarray, positive: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """a, b of 1 / (1 + exp(-(a f + b))) by Newton steps, with Platt's smoothed targets."""
    p, n = weight[positive].sum(), weight[~positive].sum()
    t = np.where(positive, (p + 1) / (p + 2), 1 / (n + 2))
    x = np.stack((f, np.ones(len(f))), axis=1)
    w = np.array([1.0, 0.0])
    for _ in range(100):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (q - t)) + 1e-3 * np.array([w[0], 0])
        hessian = (x * (weight * q * (1 - q))[:, None]).T @ x + np.diag([1e-3, 1e-9])
        step = np.linalg.solve(hessian, gradient)
        w = w - step * min(1.0, 5 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


class Bags:
    """Sentences of training documents, scored chunk by chunk."""

    def __init__(self, documents: list[list[bytes]]):
        self.size = len(documents)
        # a chunk: its sentences' codes, one break ahead and one after each, their lengths, and their documents
        self.chunks: list[tuple[bytes, np.ndarray, np.ndarray]] = []
        some: list[bytes] = []
        owner: list[int] = []
        for k, sentences in enumerate(documents):
            some += sentences
            owner += [k] * len(sentences)
            if sum(map(len, some)) > CHUNK or k == len(documents) - 1:
                lengths = np.array([1, *(len(s) + 1 for s in some)])
                self.chunks.append((b"\0" + b"".join(s + b"\0" for s in some), lengths, np.array([k, *owner], np.int32)))
                some, owner = [], []

    def scored(self, weights: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """codes, and start, end, score and document of the windows of each chunk."""
        for raw, lengths, owner in self.chunks:
            codes, sentence = np.frombuffer(raw, np.uint8), np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
            start, end, score = window_scores(codes, sentence, weights)
            yield codes, start, end, score, owner[sentence[start]]

    def worst(self, weights: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
        """Score and window of the worst sentence of each document that has words; the window b"" of others."""
        best, windows = np.full(self.size, -np.inf), [b""] * self.size
        for codes, start, end, score, owner in self.scored(weights):
            order = np.lexsort((start, -score, owner))
            first = order[np.concatenate(([True], owner[order][1:] != owner[order][:-1]))] if len(order) else order
            for i in first.tolist():
                if score[i] > best[owner[i]]:
                    best[owner[i]], windows[owner[i]] = score[i], codes[start[i] : end[i]].tobytes()
        return best, windows

    def hardest(self, weights: np.ndarray, n: int) -> list[bytes]:
        """The n windows of greatest score, without repeats."""
        found: dict[bytes, float] = {}
        for codes, start, end, score, _ in self.scored(weights):
            some = np.argsort(-score, kind="stable")[: 2 * n]
            found |= {codes[start[i] : end[i]].tobytes(): float(score[i]) for i in some.tolist()}
            found = dict(sorted(found.items(), key=lambda x: (-x[1], x[0]))[:n])
        return list(found)

    def every(self, n: int) -> list[bytes]:
        """About n windows at equal steps."""
        out: dict[bytes, None] = {}
        total = sum(raw.count(b"\0") for raw, _, _ in self.chunks) * WORDS  # one break a word
        step = max(1, total // max(1, n))
        for codes, start, end, _, _ in self.scored(np.zeros(CODES, np.float32)):
            out |= dict.fromkeys(codes[start[i] : end[i]].tobytes() for i in range(0, len(start), step))
        return list(out)


def _odds(toxic: list[list[bytes]], clean: list[list[bytes]]) -> np.ndarray:
    """How much more often a subsequence occurs in toxic documents than in clean ones, as log odds."""
    df = []
    for documents in (toxic, clean):
        count = np.zeros(CODES, np.int32)
        for sentences in documents:
            codes = np.frombuffer(b"\0" + b"\0".join(sentences) + b"\0", np.uint8)
            seen = np.zeros(CODES, bool)
            for code, _, _ in subsequences(codes):
                seen[code] = True
            count += seen
        df.append(count)
    odds = np.log((df[0] + 0.5) / (len(toxic) + 1)) - np.log((df[1] + 0.5) / (len(clean) + 1))
    return np.where(df[0] >= 2, np.maximum(odds, 0), 0).astype(np.float32)


def telling(toxic: list[list[bytes]], clean: list[list[bytes]]) -> dict[bytes, int]:
    """Words of many toxic sentences, a hundredth of the documents or 5 at least, that no clean one has, and of how many.

    Sentences that repeat count once, so that words of copied texts aren't taken for insults.
    """
    seen = [{}, {}]
    for count, documents in zip(seen, (toxic, clean), strict=True):
        for s in {s for sentences in documents for s in sentences}:
            for w in {w for w in s.split(b"\0") if len(w) > 1}:
                count[w] = count.get(w, 0) + 1
    return {w: n for w, n in sorted(seen[0].items()) if n >= max(5, len(toxic) / 100) and w not in seen[1]}


def train(rows: list[tuple[int, int, list[bytes]]]) -> dict:
    """A model from (doc_id, toxic, distinct folded sentences) of the sample."""
    rows = sorted(rows, key=lambda r: (r[1], r[0]))
    toxic, clean = ([r[2] for r in rows if bool(r[1]) == y] for y in (True, False))
    share = len(toxic) / max(1, len(rows))
    if not toxic or not clean:
        return {"weights": None, "bias": 0.0, "a": 0.0, "b": 0.0, "share": float(share)}
    bad, good = Bags(toxic), Bags(clean)
    weights, bias, spoilt = _odds(toxic, clean), 0.0, []
    others, words = good.every(OTHERS), telling(toxic, clean)
    hard: dict[bytes, None] = {}
    for _ in range(ROUNDS):
        hard = dict.fromkeys([*good.hardest(weights, HARD), *hard])
        negatives = list(dict.fromkeys([*list(hard)[: HARD + HARD // 2], *others]))
        # the worst window hides others beside it, which are examples, too, where only toxic documents have them
        count = dict(words)
        for w in filter(None, bad.worst(weights)[1]):
            count[w] = count.get(w, 0) + 1
        common = sorted(count, key=lambda w: (-count[w], w))
        marks = common[: LANDMARKS // 2]
        marks += [w for w in negatives[:: max(1, len(negatives) // (LANDMARKS // 2))] if w not in count][: LANDMARKS // 2]
        index, table = _landmark_table(marks)
        positives = sorted(count)
        spoilt = sorted({v for w in common[:SPOILT] for v in with_letter(w)})
        y = np.concatenate((np.ones(len(positives) + len(spoilt)), -np.ones(len(negatives))))
        share_of = [np.array([count[w] for w in positives]) / max(1, sum(count.values())), np.full(len(spoilt), 0.1 / max(1, len(spoilt))), np.full(len(negatives), 1 / max(1, len(negatives)))]
        share_of[2][:HARDEST] += 1 / HARDEST
        whiten = nystrom(_features(marks, index, table))
        w = _svm(_features(positives + spoilt + negatives, index, table) @ whiten.astype(np.float32), y, np.concatenate(share_of) * 200)
        bias, weights = float(w[-1]), folded(index, table, whiten @ w[:-1])
    best = np.maximum(np.concatenate((bad.worst(weights)[0], good.worst(weights)[0])), 0.0)
    # misspelt windows count as toxic texts here, too, by a tenth of what the toxic ones weigh
    spelt = np.maximum(Bags([[w] for w in spoilt]).worst(weights)[0], 0.0)
    positive = np.concatenate((np.ones(len(toxic), bool), np.zeros(len(clean), bool), np.ones(len(spelt), bool)))
    weight = np.concatenate((np.ones(len(toxic) + len(clean)), np.full(len(spelt), 0.1 * len(toxic) / max(1, len(spelt)))))
    a, b = _platt(np.concatenate((best, spelt)) + bias, positive, weight)
    return {"weights": weights, "bias": bias, "a": a, "b": b, "share": float(share)}


def nystrom(kernel: np.ndarray) -> np.ndarray:
    """Columns that map kernel values with the landmarks to features whose inner products are the kernel's."""
    kernel = kernel.astype(np.float64)
    values, vectors = np.linalg.eigh((kernel + kernel.T) / 2)
    keep = values > 1e-4 * values.max()
    return vectors[:, keep] / np.sqrt(values[keep])


def folded(index: np.ndarray, table: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    """The weight of each subsequence, given that of each landmark."""
    weights = np.zeros(CODES, np.float32)
    known = np.flatnonzero(index >= 0)
    weights[known] = table[index[known]] @ alpha
    return weights


def with_letter(window: bytes) -> list[bytes]:
    """The window with one letter, fixed by a hash, put in at each place inside a word."""
    inside = (i for i in range(1, len(window)) if window[i - 1] and window[i])
    return [window[:i] + bytes([1 + zlib.crc32(window + bytes([i % 256])) % 26]) + window[i:] for i in inside]


def _training_sentences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, toxic, text) -> the distinct folded sentences of each text, breaks between words, two between sentences."""
    for batch in batches:
        out = []
        for text in batch.column(2).to_pylist():
            codes, sentence, _ = encode([text or ""])
            start, end = word_bounds(codes)
            own = sentence[start]
            first = np.flatnonzero(np.diff(own, prepend=-1))
            last = np.append(first, len(own))[1:]
            raw = codes.tobytes()
            out.append(b"\0\0".join(sorted({raw[start[a] : end[b - 1]] for a, b in zip(first.tolist(), last.tolist(), strict=True)})))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["doc_id", "toxic", "sentences"])


def fit(docs: DataFrame, labels: DataFrame) -> dict:
    """A model from the labelled rows whose crc32(doc_id as text) mod 3 is not 1."""
    prepare(docs.sparkSession)
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) != 1))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max("toxic").cast("int").alias("toxic"))
    )
    rank = F.xxhash64(F.lit(7), "doc_id")
    some = [known.where(F.col("toxic") == y).orderBy(rank, "doc_id").limit(TRAIN_ROWS[y]) for y in (0, 1)]
    # at most sum(TRAIN_ROWS) ids: small enough to broadcast whatever the input
    chosen = F.broadcast(some[0].unionByName(some[1]))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(chosen, "doc_id")
    rows = texts.select("doc_id", "toxic", "text").mapInArrow(tidy(_training_sentences), "doc_id long, toxic int, sentences binary").collect()
    first = {r["doc_id"]: r for r in sorted(rows, key=lambda r: (r["doc_id"], bytes(r["sentences"])))}  # a doc_id that repeats counts once
    return train([(i, r["toxic"], [s for s in bytes(r["sentences"]).split(b"\0\0") if s]) for i, r in first.items()])


def scores(texts: list[str | None], m: dict) -> np.ndarray:
    if m["weights"] is None:
        return np.full(len(texts), m["share"])
    f = np.maximum(worst_windows([t or "" for t in texts], m["weights"]), 0.0) + m["bias"]
    return 1 / (1 + np.exp(-np.clip(m["a"] * f + m["b"], -30, 30)))


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = scores(batch.column(1).to_pylist(), model.value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], names=["doc_id", "score", "predicted"]
            )

    return run


def score_toxicity(docs: DataFrame, model: dict) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, held_out, score, predicted."""
    spark = prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(tidy(_score(spark.sparkContext.broadcast(model))), "doc_id long, score double, predicted int")
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", "predicted")


def _clean(model, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(scores(batch.column(at).to_pylist(), model.value) < THRESHOLD))

    return run


def without_toxic(docs: DataFrame, model: dict) -> DataFrame:
    """docs without the rows whose score reaches THRESHOLD, with their columns as they are."""
    spark = prepare(docs.sparkSession)
    return filtered(docs, _clean(spark.sparkContext.broadcast(model), docs.columns.index("text")))
