"""Toxicity: a linear-chain conditional random field over words, learnt from document labels.

Labels are per document, so the words' labels are latent. They begin as a guess: in a training document that is
labelled toxic, a word is toxic if it, or one of its prefixes, is clearly more frequent (documents
counted) in toxic training documents than in clean ones. Then expectation and maximisation alternate ``ROUNDS`` times:

- E: forward-backward over each whole document under its label. No word of a clean document is toxic; a toxic
  document holds ``LEAST`` toxic words or more in expectation (the marginals are tilted by one number per
  document until it does). The marginals of words and of neighbouring pairs are the new token labels.
- M: a two-state chain with features of the word, its prefixes and suffix and its two neighbours, by
  gradient ascent of the expected conditional log-likelihood over windows of words.

For scoring, forward-backward gives each word its marginal; expected number,
largest marginal and length give the document score through a logistic calibration on the training
documents; words with a marginal of one half or more are the offending offsets.

Forward and backward messages of two states are one ratio each. Documents are laid out in blocks that
step together; a block starts ``warm`` words early, where ``warm`` follows from the contraction of the
transition matrix, so that the ratio at its first own word is that of the whole text to 1e-9.

Rows with crc32(id) mod 4 = 2 are held out and never read in training. The fit uses a bounded sample of labelled rows:
about ``TOXIC`` and ``CLEAN`` documents, those of a small id hash, and of their windows about ``WINDOWS`` with
toxic words and twice as many others. Whole texts stay on the executors; windows, of a fixed number of words, reach the driver.

Defined cases: a null or empty text has no words and a score like any other; a null id is not held
out; repeated rows get equal scores and train once; an id that is labelled both ways trains as toxic; without toxic or without clean rows
the score is the smoothed share of toxic labels; only the id and text columns are read; an empty table gives an empty table.
"""

from __future__ import annotations

import functools
import itertools
import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from shoebox.llm.common import Memo, documents, hash_sample, id_remainder, map_texts, table
from shoebox.plans.tables import Scratch

MODULUS, HELD_OUT, TOXIC, CLEAN, THRESHOLD = 4, 2, 2_000, 4_000, 0.3
WINDOW, WINDOWS, ROUNDS, EPOCHS, LEAST, REACH = 24, 10_000, 2, (12, 4), 1.0, 3.0
DIM, CORE, LOG_ODDS, LEAST_DOCS = 1 << 18, 256, 3.0, 4
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")


def split(text: str | None) -> list[str]:
    """White-space words; str.split() cuts at more, so the contract's set is translated first."""
    return WORDS.findall(text) if text else []


def plain(word: str) -> str:
    return word.lower() if word.isalnum() else _EDGE.sub("", word).lower()


def stems(word: str) -> list[str]:
    """The word and its prefixes of 4 to 6 letters."""
    return ["=" + word, *["^" + word[:k] for k in (4, 5, 6) if len(word) > k]]


def _id(name: str) -> int:
    return xxhash.xxh32_intdigest(name) & (DIM - 1)


CASE = _id("low"), _id("caps")


def plain_ids(word: str) -> tuple[list[int], int, int]:
    """Hashed features of a plain word: its own, as a left and as a right neighbour."""
    return [_id(x) for x in (*stems(word), "$" + word[-3:], f"#{min(len(word), 12)}")], _id("<" + word), _id(">" + word)


class Tokens(dict):
    """Rows of weights of the words met, at most ``limit`` besides those of one text."""

    def __init__(self, crf: Crf, limit: int = 300_000):
        super().__init__()
        self.crf, self.limit, self.table = crf, limit, np.empty((4096, 3))
        self.plain = Memo(crf.plain_token, limit)

    def __missing__(self, word: str) -> int:
        at = self[word] = len(self)
        if at == len(self.table):
            self.table = np.concatenate([self.table, np.empty_like(self.table)])
        own, left, right = self.plain[plain(word)]
        self.table[at] = own + self.crf.flat[CASE[word.isupper()]], left, right
        return at

    def rows(self, words: list[str]) -> np.ndarray:
        if len(self) > self.limit:
            self.clear()
        ids = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return self.table[ids]


class Crf:
    """Weights of the chain; states are clean (0, the reference) and toxic (1)."""

    def __init__(self):
        self.w = np.zeros(DIM)
        self.bias, self.trans = -4.0, np.zeros((2, 2))

    def plain_token(self, word: str) -> tuple[float, float, float]:
        """Weight of a plain word itself, as a left neighbour and as a right neighbour."""
        w = self.flat
        own, left, right = plain_ids(word)
        return sum([w[i] for i in own]) + self.bias, w[left], w[right]

    @functools.cached_property
    def flat(self) -> list[float]:
        return self.w.tolist()

    def scores(self, words: list[str], known: Tokens) -> np.ndarray:
        """Score of each word of a text for the toxic state."""
        if not words:
            return np.empty(0)
        x = known.rows(words)
        out = x[:, 0].copy()
        out[1:] += x[:-1, 1]
        out[:-1] += x[1:, 2]
        return out

    def warm(self) -> int:
        """Words after which a chain has forgotten its start to 1e-9."""
        spread = abs(self.trans[0, 0] + self.trans[1, 1] - self.trans[0, 1] - self.trans[1, 0])
        shrink = math.tanh(spread / 4)
        return 1 if shrink < 1e-9 else math.ceil(math.log(1e-11) / math.log(shrink)) + 1


def messages(e: np.ndarray, lengths, trans: np.ndarray, warm: int, core: int = CORE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Odds of the toxic state of each word: from the words before, its own, from the words after. ``e``: the
    words' scores, text after text."""
    n = len(e)
    if not n:
        return np.empty(0), np.empty(0), np.empty(0)
    lengths = np.array([x for x in lengths if x], np.int64)
    ends = np.cumsum(lengths)
    blocks = -(-lengths // core)
    text = np.repeat(np.arange(len(lengths)), blocks)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    lo, hi = (ends - lengths)[text], ends[text]
    start = lo + nth * core
    stop = np.minimum(start + core, hi)
    a = np.exp(trans)
    x = np.exp(np.clip(e, -30, 30))
    ahead, behind = np.empty(n), np.empty(n)
    # forward: r = P(toxic, words so far) / P(clean, words so far), before the word's own factor
    r = np.full(len(text), 1.0)
    for k in range(-warm, core):
        at = start + k
        ok = (at >= lo) & (at < stop)
        if not ok.any():
            continue
        i = at[ok]
        if k >= 0:
            ahead[i] = r[ok]
        m = r[ok] * x[i]
        r[ok] = (a[0, 1] + m * a[1, 1]) / (a[0, 0] + m * a[1, 0])
    r = np.full(len(text), 1.0)
    for k in range(-warm, core):
        at = stop - 1 - k
        ok = (at < hi) & (at >= start)
        if not ok.any():
            continue
        i = at[ok]
        if k >= 0:
            behind[i] = r[ok]
        m = r[ok] * x[i]
        r[ok] = (a[1, 0] + m * a[1, 1]) / (a[0, 0] + m * a[0, 1])
    return ahead, x, behind


def marginals(e: np.ndarray, lengths, trans: np.ndarray, warm: int, core: int = CORE) -> np.ndarray:
    """Probability of the toxic state of each word."""
    ahead, x, behind = messages(e, lengths, trans, warm, core)
    odds = ahead * x * behind
    return odds / (1 + odds)


def under_labels(e: np.ndarray, lengths: np.ndarray, toxic: np.ndarray, trans: np.ndarray, warm: int, least: float = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of the words, and (toxic then toxic, toxic then clean, clean then toxic) of each word and its next, given the labels
    of the documents: none in clean ones, ``least`` or more expected in toxic ones (nine tenths of a word if they have one only)."""
    ends = np.cumsum(lengths)
    text = np.repeat(np.arange(len(lengths)), lengths)
    want = np.minimum(least, 0.9 * lengths)
    number = lambda p: np.bincount(text, p, minlength=len(lengths))
    low = toxic & (lengths > 0) & (number(marginals(e, lengths, trans, warm)) < want)
    few, most = np.zeros(len(lengths)), np.where(low, 60.0, 0.0)
    for _ in range(30 if low.any() else 0):
        mid = (few + most) / 2
        short = number(marginals(e + mid[text], lengths, trans, warm)) < want
        few, most = np.where(short & low, mid, few), np.where(short | ~low, most, mid)
    ahead, x, behind = messages(e + most[text], lengths, trans, warm)
    odds = ahead * x * behind
    p = odds / (1 + odds) * toxic[text]
    pairs = np.zeros((len(e), 3))
    at = np.flatnonzero(np.arange(len(e)) + 1 < ends[text]) if len(e) else np.empty(0, np.int64)
    a = np.exp(trans)
    left, right = ahead[at] * x[at], x[at + 1] * behind[at + 1]
    both = np.stack([left * right * a[1, 1], left * a[1, 0], right * a[0, 1], np.full(len(at), a[0, 0])], axis=1)
    pairs[at] = (both / both.sum(axis=1, keepdims=True))[:, :3] * toxic[text[at], None]
    return p, pairs


class Windows:
    """Windows of words with feature ids and expected labels, as arrays over all their words."""

    def __init__(self, rows: list[dict]):
        of = lambda c, kind: [np.frombuffer(r[c], kind) for r in rows]
        self.ids, self.sizes = of("ids", np.int32), [x.astype(np.int64) for x in of("sizes", np.uint8)]
        self.gold = np.zeros((len(rows), WINDOW))
        for g, x in zip(self.gold, of("gold", np.float32)):
            g[: len(x)] = x
        self.pairs = np.array(of("pairs", np.float64)).reshape(-1, 2, 2)
        self.length = np.array([len(x) for x in self.sizes])

    def part(self, which: np.ndarray) -> tuple:
        ids = np.concatenate([self.ids[i] for i in which])
        at = np.repeat(np.concatenate([np.arange(self.length[i]) + k * WINDOW for k, i in enumerate(which)]), np.concatenate([self.sizes[i] for i in which]))
        return ids, at, self.gold[which], self.pairs[which].sum(axis=0), self.length[which]


def likelihood(w: np.ndarray, bias: float, trans: np.ndarray, ids, at, gold, pairs, length) -> tuple[float, np.ndarray, np.ndarray]:
    """Expected conditional log-likelihood of some windows, and its gradient by the words' scores and by the
    transitions."""
    live = np.arange(WINDOW)[None, :] < length[:, None]
    e = np.where(live, np.bincount(at, weights=w[ids], minlength=gold.size).reshape(gold.shape) + bias, 0)
    a, psi = np.exp(trans), np.stack([np.ones_like(e), np.exp(np.clip(e, -30, 30))], axis=2)
    alpha, beta, log_z = np.ones((*e.shape, 2)), np.ones((*e.shape, 2)), np.zeros(len(e))
    for k in range(WINDOW):
        v = (alpha[:, k - 1] @ a if k else np.ones((len(e), 2))) * psi[:, k]
        total = v.sum(axis=1)
        log_z += np.where(live[:, k], np.log(total), 0)
        alpha[:, k] = np.where(live[:, k, None], v / total[:, None], alpha[:, k - 1] if k else 1)
    for k in range(WINDOW - 2, -1, -1):
        v = (beta[:, k + 1] * psi[:, k + 1]) @ a.T
        beta[:, k] = np.where(live[:, k + 1, None], v / v.sum(axis=1, keepdims=True), 1)
    p = alpha * beta
    p = (p / p.sum(axis=2, keepdims=True))[:, :, 1]
    both = alpha[:, :-1, :, None] * a[None, None] * (beta[:, 1:] * psi[:, 1:])[:, :, None, :]
    both = (both / both.sum(axis=(2, 3), keepdims=True))[live[:, 1:]].sum(axis=0)
    return float((gold * e).sum() + (pairs * trans).sum() - log_z.sum()), np.where(live, gold - p, 0), pairs - both


def fit_crf(model: Crf, windows: Windows, epochs: int, rate: float = 0.3, seed: int = 1, chain: bool = True) -> Crf:
    """Gradient ascent with AdaGrad steps and a small decay, from ``model`` on; the weights of ``model`` are changed."""
    rng = np.random.default_rng(seed)
    g2, b2, t2 = np.full(DIM, 1e-6), 1e-6, np.full((2, 2), 1e-6)
    for _ in range(epochs):
        order = rng.permutation(len(windows.length))
        for start in range(0, len(order), 256):
            part = windows.part(order[start : start + 256])
            n = len(part[-1])
            _, d, d_trans = likelihood(model.w, model.bias, model.trans, *part)
            step = np.bincount(part[0], weights=d.ravel()[part[1]], minlength=DIM) / n - 1e-5 * model.w
            g2 += step * step
            model.w += rate * step / np.sqrt(g2)
            db = d.sum() / n
            b2 += db * db
            model.bias += 0.3 * rate * db / math.sqrt(b2)
            d_trans = d_trans / n * chain
            t2 += d_trans**2
            model.trans = np.clip(model.trans + 0.3 * rate * d_trans / np.sqrt(t2), -REACH, REACH)
    model.__dict__.pop("flat", None)
    return model


def summary(p: np.ndarray) -> list[float]:
    """What the calibration sees of a text's marginals."""
    if not len(p):
        return [0.0, 0.0, 0.0, 0.0]
    total = float(p.sum())
    return [math.log1p(total), float(p.max()), min(1.0, total * 20 / len(p)), min(3.0, total) / 3]


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 50) -> np.ndarray:
    """Newton steps for a logistic model with a ridge."""
    z = np.hstack([x, np.ones((len(x), 1))])
    c = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ c, -30, 30)))
        grad = z.T @ (weight * (y - p)) - 1e-1 * c
        hess = (z * (weight * p * (1 - p))[:, None]).T @ z + 1e-1 * np.eye(len(c))
        c = c + np.clip(np.linalg.solve(hess, grad), -2, 2)
    return c


class Model:
    """A trained chain and its calibration."""

    def __init__(self, crf: Crf, calibration: np.ndarray):
        self.crf, self.calibration, self.warm = crf, calibration, crf.warm()

    def tag(self, texts: list[list[str]], memo) -> list[np.ndarray]:
        e = [self.crf.scores(w, memo) for w in texts]
        p = marginals(np.concatenate(e) if e else np.empty(0), [len(x) for x in e], self.crf.trans, self.warm)
        return np.split(p, np.cumsum([len(x) for x in e])[:-1]) if e else []

    def score(self, tags: list[np.ndarray]) -> np.ndarray:
        x = np.array([summary(p) for p in tags]).reshape(-1, 4)
        return 1 / (1 + np.exp(-np.clip(x @ self.calibration[:-1] + self.calibration[-1], -30, 30)))


SAMPLE = "toxic boolean, text string"
ROWS = "toxic boolean, key long, ids binary, sizes binary, gold binary, pairs binary"


def training_rows(docs: DataFrame, labels: DataFrame, toxic: int, clean: int) -> tuple[DataFrame, float]:
    """(toxic, text) of the sampled training rows, and the smoothed share of toxic labels."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("toxic is not null").where(id_remainder("doc_id", MODULUS) != HELD_OUT)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, bad = known.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    some = hash_sample(known.where("toxic = 1"), "doc_id", toxic).unionByName(hash_sample(known.where("toxic <> 1"), "doc_id", clean))
    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(some), "doc_id")
    return rows.select((F.col("toxic") == 1).alias("toxic"), "text").distinct(), (bad + 1) / (n + 2)


def stem_counts(rows: DataFrame) -> DataFrame:
    """(stem, t, c): toxic and clean documents that hold it."""

    def make():
        def apply(batch, texts):
            out: dict[str, list[int]] = {}
            for toxic, text in zip(batch.column("toxic").to_pylist(), texts):
                for x in {s for w in set(map(plain, set(split(text)))) if w for s in stems(w)}:
                    out.setdefault(x, [0, 0])[not toxic] += 1
            return pa.RecordBatch.from_arrays([pa.array(list(out)), *(pa.array([x[i] for x in out.values()], pa.int64()) for i in (0, 1))], ["stem", "t", "c"])

        return apply

    return map_texts(rows, make, "stem string, t long, c long").groupBy("stem").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))


def toxic_stems(rows: DataFrame, n_toxic: int, n_clean: int) -> set[str]:
    """Stems whose smoothed log odds of document frequencies are ``LOG_ODDS`` or more."""
    odds = F.log((F.col("t") + 0.5) / (n_toxic + 1) / ((F.col("c") + 0.5) / (n_clean + 1)))
    return {r["stem"] for r in stem_counts(rows).where((F.col("t") >= LEAST_DOCS) & (odds >= LOG_ODDS)).select("stem").collect()}


def window_rows(rows: DataFrame, marks: set[str] | None, model: Crf | None, share: float) -> DataFrame:
    """Windows of the training rows with expected labels: by the stems ``marks``, or of ``model`` under the documents'
    labels. Of windows without toxic words a share goes on, by the hash of their words."""
    shared = rows.sparkSession.sparkContext.broadcast((marks, model))

    def make():
        marks, model = shared.value
        of_plain = Memo(plain_ids, 50_000)
        own_ids = Memo(lambda w: [*of_plain[plain(w)][0], CASE[w.isupper()]], 50_000)
        hot = Memo(lambda w: any(s in marks for s in stems(plain(w))) if plain(w) else False)
        known = Tokens(model) if model else None

        def labels(words, toxic):
            lengths = np.array([len(w) for w in words], np.int64)
            if model:
                e = np.concatenate([model.scores(w, known) for w in words] or [np.empty(0)])
                return under_labels(e, lengths, toxic, model.trans, model.warm())
            p = np.array([t and hot[x] for w, t in zip(words, toxic) for x in w], float)
            after = np.append(p[1:], 0.0)[: len(p)]
            if len(p):
                after[np.cumsum(lengths[lengths > 0]) - 1] = -1  # no word follows
            return p, np.stack([p * (after == 1), p * (after == 0), (1 - p) * (after == 1)], axis=1)

        def apply(batch, texts):
            words, toxic = [split(t) for t in texts], np.array(batch.column("toxic").to_pylist(), bool)
            p, pairs = labels(words, toxic)
            cols: list[list] = [[] for _ in range(6)]
            start = 0
            for ws, t in zip(words, toxic):
                for lo in range(0, len(ws), WINDOW):
                    hi = min(len(ws), lo + WINDOW)
                    gold, key = p[start + lo : start + hi], xxhash.xxh64_intdigest(" ".join(ws[lo:hi]).encode(), int(t)) >> 1
                    some = bool(gold.max() >= 0.05)
                    if not some and key >= share * (1 << 63):
                        continue
                    each = [[*own_ids[ws[k]], *([of_plain[plain(ws[k - 1])][1]] if k else ()), *([of_plain[plain(ws[k + 1])][2]] if k + 1 < len(ws) else ())] for k in range(lo, hi)]
                    tt, tc, ct = pairs[start + lo : start + hi - 1].sum(axis=0)
                    arrays = np.array(list(itertools.chain.from_iterable(each)), np.int32), np.array([len(x) for x in each], np.uint8), gold.astype(np.float32), np.array([hi - lo - 1 - tt - tc - ct, ct, tc, tt])
                    for col, x in zip(cols, (some, key, *(x.tobytes() for x in arrays))):
                        col.append(x)
                start += len(ws)
            kinds = pa.bool_(), pa.int64(), *[pa.binary()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["toxic", "key", "ids", "sizes", "gold", "pairs"])

        return apply

    return map_texts(rows, make, ROWS, max_chars=1_000_000)


def sizes(rows: DataFrame) -> tuple[int, int, int]:
    """Toxic rows, clean rows and windows of the training rows."""
    words = F.size(F.split("text", r"[\x20\x09-\x0D]+"))
    return tuple(rows.agg(F.count_if("toxic"), F.count_if(~F.col("toxic")), F.coalesce(F.sum(F.ceil(words / WINDOW)), F.lit(0))).first())


def summaries(rows: DataFrame, crf: Crf) -> tuple[np.ndarray, np.ndarray]:
    """What the calibration sees of every training row, and whether it is toxic."""
    shared = rows.sparkSession.sparkContext.broadcast(crf)

    def make():
        m = Model(shared.value, np.zeros(5))
        known = Tokens(m.crf)

        def apply(batch, texts):
            x = np.array([summary(p) for p in m.tag([split(t) for t in texts], known)])
            return pa.RecordBatch.from_arrays([batch.column("toxic"), *(pa.array(c) for c in x.T)], ["toxic", "a", "b", "c", "d"])

        return apply

    got = map_texts(rows, make, "toxic boolean, a double, b double, c double, d double", max_chars=1_000_000).toArrow()
    got = got.sort_by([(c, "ascending") for c in got.column_names])
    return np.stack([got[c].to_numpy() for c in "abcd"], axis=1), got["toxic"].to_numpy(zero_copy_only=False).astype(float)


def train(docs: DataFrame, labels: DataFrame, toxic: int = TOXIC, clean: int = CLEAN, rounds: int = ROUNDS, chain: bool = True) -> Model:
    """The model from training rows alone. ``chain``: transitions are learnt."""
    scratch = Scratch(docs.sparkSession, "toxicity")
    found, share = training_rows(docs, labels, toxic, clean)
    written = scratch.write(found)
    n_toxic, n_clean, n_windows = sizes(written)
    if not n_toxic or not n_clean:
        return Model(Crf(), np.array([0.0] * 4 + [math.log(share / (1 - share))]))
    rows = written.repartition(max(1, min(n_toxic + n_clean, 4 * docs.sparkSession.sparkContext.defaultParallelism)))
    marks, crf = toxic_stems(rows, n_toxic, n_clean), None
    for k in range(1 + rounds):
        every = scratch.write(window_rows(rows, marks, crf, min(1.0, 2 * WINDOWS / max(1, n_windows))))
        some = hash_sample(every.where("toxic"), "key", WINDOWS).unionByName(every.where("not toxic")).toArrow()
        windows = Windows(some.sort_by([(c, "ascending") for c in ("key", "ids", "gold")]).to_pylist())
        scratch.drop(every)
        crf = fit_crf(crf or Crf(), windows, EPOCHS[min(k, 1)], seed=1 + k, chain=chain)
    x, y = summaries(rows, crf)
    weight = np.where(y == 1, share * len(y) / n_toxic, (1 - share) * len(y) / n_clean)
    scratch.drop(written)
    return Model(crf, fit_logistic(x, y, weight))


def score_documents(docs: DataFrame, model: Model, spans: bool = True) -> DataFrame:
    """(doc_id, score, spans array<struct<start, end, p>>): spans of toxic words in code points."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()
    item = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())])

    def make():
        m = shared.value
        memo = Tokens(m.crf)

        def apply(batch, texts):
            words = [split(t) for t in texts]
            tags = m.tag(words, memo)
            found = []
            for t, p in zip(texts, tags):
                hits = np.flatnonzero(p >= 0.5) if spans else ()
                at = [x.span() for x in WORDS.finditer(t)] if len(hits) else []
                found.append([{"start": at[i][0], "end": at[i][1], "p": float(p[i])} for i in hits])
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(m.score(tags), pa.float64()), pa.array(found, pa.list_(item))], ["doc_id", "score", "spans"])

        return apply

    return map_texts(docs.select("doc_id", "text"), make, f"doc_id {kind}, score double, spans array<struct<start: int, end: int, p: double>>", max_chars=1_000_000)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    out = score_documents(docs, train(docs, table(spark, sf_dir, "labels")))
    held = F.coalesce(id_remainder("doc_id", MODULUS) == HELD_OUT, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "spans")
