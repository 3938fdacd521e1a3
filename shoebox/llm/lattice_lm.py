"""Language-model scores: the marginal probability of a text over all its subword segmentations.

A text is a sequence of words (lower-cased A-Z, cut at ASCII white space) and one end. A word is
``▁`` and its characters, spelled by pieces of an existing subword vocabulary; no piece crosses a
word, so the lattice of a text falls apart into one lattice a word. Each lattice is summed
in log space by forward recursion. Characters that the vocabulary lacks are spelled by its byte
pieces. The pieces' weights start from the vocabulary's own scores (a rank r has weight
1 / (r + OFFSET)) and are re-estimated by expectation-maximisation over all training words, with the end
as a further piece, until a round gains less than ``GAIN`` of the log-likelihood. They sum to
one, and so do the lattices of all words: a text's score is the sum over its words' lattices and the end, and nothing else.

Spark side, per word type and not per token:
1. count words (map-side in Python, then a Spark aggregation) over all documents;
2. write the edges of all lattices once, words of one length side by side in blocks, with the edges
   of one (end, length) together, so that a round of expectations is a few array operations for
   each of those; words longer than ``LONG`` are walked one by one;
3. one pass over the blocks a round, expected counts summed by Spark; a last pass for log probabilities;
4. sums per document: the ``HEAD`` most frequent types are broadcast (a fixed number, short ones),
   all others are joined on the word. Frequent words are in the head, so the join has no hot key.

The base score (add-one smoothed word counts) takes the same two ways.

Defined cases: a null or empty text is the end alone; an end is known if there is a training
document; with no training documents N = V = 0, each token has base log10(1 / 1), and the
weights stay those of the vocabulary; a null id is in training; equal rows get equal scores each;
only ``doc_id`` and ``text`` are read; an empty table gives an empty table.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from shoebox.llm.byte_bpe import read_file
from shoebox.llm.common import documents, id_remainder, lower_words, map_texts, most_frequent
from shoebox.plans.tables import Scratch

HEAD, HEAD_BYTES, OFFSET, FLUSH, MODULUS, HELD_OUT = 150_000, 40, 10.0, 150_000, 7, 2
#: EM ends when a round gains less than this share of the log-likelihood, or after ROUNDS rounds.
GAIN, ROUNDS, PRIOR = 1e-4, 60, 1e-3
#: Words of a block, and the longest word (in code points, with the mark) that goes to one.
BLOCK, LONG = 4096, 96
MARK = "▁"


class Lattice:
    """Forward and backward sums over the segmentations of a word."""

    def __init__(self, vocabulary: bytes, weights: np.ndarray | None = None):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=vocabulary)
        self.size = sp.get_piece_size()
        self.end = self.size
        self.bytes = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        usable = [i for i in range(self.size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        self.first = np.zeros(self.size + 1)
        rank = np.array([-sp.get_score(i) for i in usable])
        self.first[usable] = 1 / (np.maximum(rank, 0) + OFFSET)
        self.first[self.bytes] = 1 / (self.size + OFFSET)
        self.first[self.end] = 1 / OFFSET
        self.first /= self.first.sum()
        self.found = ahocorasick.Automaton()
        self.single = set()
        for i in usable:
            p = sp.id_to_piece(i)
            if MARK not in p[1:]:
                self.found.add_word(p, len(p) << 32 | i)
                if len(p) == 1:
                    self.single.add(p)
        self.found.make_automaton()
        self.use(self.first if weights is None else weights)

    def use(self, weights: np.ndarray) -> Lattice:
        self.weights = weights
        with np.errstate(divide="ignore"):
            self.logs = np.log(weights)
        return self

    def block(self, words: list[str]) -> Block:
        """The lattices of marked words of one length. They are searched as one string: a piece has no mark but its
        first character, so none crosses into the next word. A character without a piece of its own has an edge of byte
        pieces, whose number is below zero: -1 less its code point."""
        n, every = len(words[0]), "".join(words)
        found = np.fromiter(itertools.chain.from_iterable(self.found.iter(every)), np.int64).reshape(-1, 2)
        at, length, piece = found[:, 0], found[:, 1] >> 32, found[:, 1] & 0xFFFFFFFF
        missing = set(every) - self.single
        if missing:
            codes = np.frombuffer(every.encode("utf-32-le"), np.uint32).astype(np.int64)
            odd = np.flatnonzero(np.isin(codes, list(map(ord, missing))))
            at, length, piece = np.append(at, odd), np.append(length, np.ones_like(odd)), np.append(piece, -1 - codes[odd])
        key = ((at % n + 1) << 16 | length) << 16 | at // n
        order = np.argsort(key)
        key = key[order]
        groups, sizes = np.unique(key >> 16, return_counts=True)
        return Block(n, np.stack([groups >> 16, groups & 0xFFFF], axis=1), sizes, (key & 0xFFFF).astype(np.uint16), piece[order].astype(np.int32), len(words))

    def spelled(self, piece: int) -> np.ndarray:
        """The byte pieces of an edge below zero."""
        return self.bytes[np.frombuffer(chr(-1 - piece).encode(), np.uint8)]

    def edge_logs(self, pieces: np.ndarray) -> np.ndarray:
        out = self.logs[np.maximum(pieces, 0)]
        odd = np.flatnonzero(pieces < 0)
        if len(odd):
            kinds, at = np.unique(pieces[odd], return_inverse=True)
            out[odd] = np.array([self.logs[self.spelled(k)].sum() for k in kinds.tolist()])[at]
        return out

    def put(self, pieces: np.ndarray, counts: np.ndarray, into: np.ndarray) -> None:
        """Add expected counts of edges to those of pieces."""
        plain = pieces >= 0
        into += np.bincount(pieces[plain], counts[plain], minlength=len(into))
        if not plain.all():
            kinds, at = np.unique(pieces[~plain], return_inverse=True)
            for k, x in zip(kinds.tolist(), np.bincount(at, counts[~plain]).tolist()):
                np.add.at(into, self.spelled(k), x)

    def log_prob(self, word: bytes) -> float:
        """Natural log of the word's marginal probability."""
        w = MARK + word.decode("utf-8", "replace")
        block = self.block([w])
        return float(block.forward(self.edge_logs(block.pieces))[-1, 0])


class Block:
    """The lattices of words of one length ``n``: edges by (end, length), ``sizes`` of each such group, the
    ``words`` and ``pieces`` of its edges."""

    def __init__(self, n: int, groups: np.ndarray, sizes: np.ndarray, words: np.ndarray, pieces: np.ndarray, count: int):
        self.n, self.groups, self.words, self.pieces, self.count = n, groups.reshape(-1, 2), words, pieces, count
        ends = np.cumsum(sizes).tolist()
        self.parts = [(int(e), int(length), a, b) for (e, length), a, b in zip(self.groups, [0, *ends], ends)]

    def row(self) -> dict:
        sizes = np.array([b - a for _, _, a, b in self.parts], np.int32)
        return {"n": self.n, "groups": self.groups.astype(np.int32).tobytes(), "sizes": sizes.tobytes(), "at": self.words.tobytes(), "pieces": self.pieces.tobytes()}

    @staticmethod
    def read(row: dict, count: int) -> Block:
        i32 = lambda c: np.frombuffer(row[c], np.int32)
        return Block(row["n"], i32("groups"), i32("sizes"), np.frombuffer(row["at"], np.uint16), i32("pieces"), count)

    def forward(self, logs: np.ndarray) -> np.ndarray:
        """alpha[k, w]: log of the summed weights of all spellings of the first k characters of word w."""
        alpha = np.full((self.n + 1, self.count), -np.inf)
        alpha[0] = 0
        for e, k, a, b in self.parts:
            w = self.words[a:b]
            alpha[e, w] = np.logaddexp(alpha[e, w], alpha[e - k, w] + logs[a:b])
        return alpha

    def backward(self, logs: np.ndarray) -> np.ndarray:
        beta = np.full((self.n + 1, self.count), -np.inf)
        beta[self.n] = 0
        for e, k, a, b in reversed(self.parts):
            w = self.words[a:b]
            beta[e - k, w] = np.logaddexp(beta[e - k, w], beta[e, w] + logs[a:b])
        return beta

    def expect(self, lattice: Lattice, times: np.ndarray, into: np.ndarray) -> float:
        """Add the expected piece counts of ``times`` of each word; gives their log-likelihood."""
        logs = lattice.edge_logs(self.pieces)
        alpha, beta = self.forward(logs), self.backward(logs)
        total, share = alpha[self.n], logs
        for e, k, a, b in self.parts:
            w = self.words[a:b]
            share[a:b] += alpha[e - k, w] + beta[e, w] - total[w]
        lattice.put(self.pieces, np.exp(share) * times[self.words], into)
        return float(total @ times)


@functools.lru_cache(1)
def _lattice(vocabulary: bytes) -> Lattice:
    return Lattice(vocabulary)


def count_words(docs: DataFrame) -> DataFrame:
    """(word binary, c): occurrences of every word type of the table, ``c`` in training rows.
    ``docs`` has columns train and text."""

    def run(batches):
        from shoebox.llm.common import chunks

        every, train = set(), Counter()

        def flush():
            words = list(every)
            out = pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([train.get(w, 0) for w in words], pa.int64())], ["word", "c"])
            every.clear()
            train.clear()
            return out

        for part, texts in chunks(batches):
            for text, learn in zip(texts, part.column("train").to_pylist()):
                words = lower_words(text)
                every.update(words)
                if learn:
                    train.update(words)
            if len(every) > FLUSH:
                yield flush()
        if every:
            yield flush()

    return docs.select("train", "text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


BLOCKS = "n int, words array<binary>, c binary, groups binary, sizes binary, at binary, pieces binary"
BLOCK_TYPE = pa.schema([("n", pa.int32()), ("words", pa.list_(pa.binary())), *((x, pa.binary()) for x in ("c", "groups", "sizes", "at", "pieces"))])


def block_rows(batch: pa.RecordBatch):
    """One block's row at a time: a batch holds many MB."""
    for i in range(batch.num_rows):
        yield {c: batch.column(c)[i].as_py() for c in batch.schema.names}


def word_blocks(types: DataFrame, vocabulary) -> DataFrame:
    """The lattices of all word types; one word of more than ``LONG`` characters is a block of its own."""

    def run(batches):
        lattice = _lattice(vocabulary.value)
        waiting: dict[int, tuple[list, list, list]] = {}

        def block(words, c, marked):
            return pa.RecordBatch.from_pylist([{"words": words, "c": np.array(c, np.int64).tobytes(), **lattice.block(marked).row()}], BLOCK_TYPE)

        for batch in batches:
            for word, c in zip(batch.column("word").to_pylist(), batch.column("c").to_pylist()):
                w = MARK + word.decode("utf-8", "replace")
                if len(w) > LONG:
                    yield block([word], [c], [w])
                    continue
                at = waiting.setdefault(len(w), ([], [], []))
                for col, x in zip(at, (word, c, w)):
                    col.append(x)
                if len(at[0]) == BLOCK:
                    yield block(*waiting.pop(len(w)))
        for at in waiting.values():
            yield block(*at)

    return types.mapInArrow(run, BLOCKS)


def expected_pieces(blocks: DataFrame, vocabulary, weights) -> DataFrame:
    """(piece, n): expected counts over the training words' segmentations; piece -1 has their log-likelihood."""

    def run(batches):
        lattice = _lattice(vocabulary.value).use(np.frombuffer(weights.value))
        into, total = np.zeros(lattice.size + 1), 0.0
        for batch in batches:
            for row in block_rows(batch):
                times = np.frombuffer(row["c"], np.int64).astype(float)
                if times.any():
                    total += Block.read(row, len(times)).expect(lattice, times, into)
        at = np.flatnonzero(into)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int64()), pa.array(np.append(into[at], total))], ["piece", "n"])

    return blocks.select("n", "c", "groups", "sizes", "at", "pieces").mapInArrow(run, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n"))


def next_weights(counts: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Expected counts with ``PRIOR`` of their sum dealt by the first weights: every piece stays possible."""
    mixed = counts + first * PRIOR * max(1.0, counts.sum())
    return mixed / mixed.sum()


def learn_weights(blocks: DataFrame, vocabulary, ends: int, gain: float = GAIN) -> np.ndarray:
    """Expectation-maximisation over the training words and ``ends`` ends."""
    sc, lattice = blocks.sparkSession.sparkContext, _lattice(vocabulary.value)
    weights, before = lattice.first, -math.inf
    if not ends:
        return weights
    for _ in range(ROUNDS):
        shared = sc.broadcast(weights.tobytes())
        got = expected_pieces(blocks, vocabulary, shared).toArrow()
        shared.unpersist()
        piece, n = got["piece"].to_numpy(), got["n"].to_numpy()
        counts = np.zeros(lattice.size + 1)
        counts[piece[piece >= 0]] = n[piece >= 0]
        counts[lattice.end] = ends
        reached = n[piece < 0].sum() + ends * math.log(weights[lattice.end])
        weights = next_weights(counts, lattice.first)
        if reached - before <= gain * abs(reached):
            break
        before = reached
    return weights


def word_scores(blocks: DataFrame, vocabulary, weights) -> DataFrame:
    """(word, c, lp): ``lp`` the natural log of the word's marginal probability."""

    def run(batches):
        lattice = _lattice(vocabulary.value).use(np.frombuffer(weights.value))
        for batch in batches:
            for row in block_rows(batch):
                block = Block.read(row, len(row["words"]))
                lp = block.forward(lattice.edge_logs(block.pieces))[-1]
                yield pa.RecordBatch.from_arrays([pa.array(row["words"], pa.binary()), pa.array(np.frombuffer(row["c"], np.int64)), pa.array(lp)], ["word", "c", "lp"])

    return blocks.mapInArrow(run, "word binary, c long, lp double")


def _sums(docs: DataFrame, head) -> DataFrame:
    """Rows (a, b, doc_id, train, n, known, lc, lp, word, times): one per document (word null) with
    sums over its head words, and one per document and other word. (a, b) is the text's digest."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def make():
        table = head.value

        def apply(batch, texts):
            rows, a, b, n, known, lc, lp, word, times = ([] for _ in range(9))
            for row, text in enumerate(texts):
                d = xxhash.xxh128_digest(text.encode())
                d = int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)
                words = lower_words(text)
                k, x, y, rest = 0, [], [], []
                for w, t in Counter(words).items():
                    got = table.get(w)
                    if got is None:
                        rest.append((w, t))
                    else:
                        k += t * got[0]
                        x.append(t * got[1])
                        y.append(t * got[2])
                for values, col in zip((row, *d, len(words), k, math.fsum(x), math.fsum(y), None, None), (rows, a, b, n, known, lc, lp, word, times)):
                    col.append(values)
                m = len(rest)
                rows += [row] * m
                a += [d[0]] * m
                b += [d[1]] * m
                for col in (n, known):
                    col += [0] * m
                for col in (lc, lp):
                    col += [0.0] * m
                word += [w for w, _ in rest]
                times += [t for _, t in rest]
            ids, train = (batch.column(c).take(pa.array(rows, pa.int32())) for c in ("doc_id", "train"))
            arrays = [*(pa.array(x, pa.int64()) for x in (a, b)), ids, train, *(pa.array(x, pa.int64()) for x in (n, known))]
            arrays += [*(pa.array(x, pa.float64()) for x in (lc, lp)), pa.array(word, pa.binary()), pa.array(times, pa.int64())]
            return pa.RecordBatch.from_arrays(arrays, ["a", "b", "doc_id", "train", "n", "known", "lc", "lp", "word", "times"])

        return apply

    return map_texts(docs, make, f"a long, b long, doc_id {kind}, train boolean, n long, known long, lc double, lp double, word binary, times long")


def lm_scores(docs: DataFrame, path: str, head: int = HEAD, gain: float = GAIN) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score). The driver reads the vocabulary at ``path``
    and sends it to the workers."""
    spark = docs.sparkSession
    vocabulary = spark.sparkContext.broadcast(read_file(path))
    scratch = Scratch(spark, "lattice")
    docs = docs.select("doc_id", F.coalesce(id_remainder("doc_id", MODULUS) != HELD_OUT, F.lit(True)).alias("train"), "text")
    types = scratch.write(count_words(docs))
    ends = docs.where("train").count()
    total, distinct = types.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    n, v = total + ends, distinct + (ends > 0)

    blocks = scratch.write(word_blocks(types, vocabulary))
    scratch.drop(types)
    weights = learn_weights(blocks, vocabulary, ends, gain)
    end_lp = math.log(weights[_lattice(vocabulary.value).end])
    scored = scratch.write(word_scores(blocks, vocabulary, spark.sparkContext.broadcast(weights.tobytes())))
    scratch.drop(blocks)
    base = -math.log10(n + v + 1)
    top = most_frequent(scored.where(F.length("word") <= HEAD_BYTES), "c", head).toArrow()
    table = {w: (c > 0, math.log10(c + 1), lp) for w, c, lp in zip(top["word"].to_pylist(), top["c"].to_pylist(), top["lp"].to_pylist())}
    rows = scratch.write(_sums(docs, spark.sparkContext.broadcast(table)))

    rest = rows.where("word is not null").select("a", "b", "word", "times").join(scored, "word").groupBy("a", "b")
    rest = rest.agg(F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("known2"), F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("lc2"), F.sum(F.col("times") * F.col("lp")).alias("lp2"))
    texts = rows.where("word is null")
    rest = rest.join(texts.groupBy("a", "b").agg(F.count("*").alias("copies")), ["a", "b"])  # equal texts have summed theirs together
    rest = rest.select("a", "b", (F.col("known2") / F.col("copies")).cast("long").alias("known2"), *[(F.col(c) / F.col("copies")).alias(c) for c in ("lc2", "lp2")])
    out = texts.join(rest, ["a", "b"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return out.select(
        "doc_id",
        (~F.col("train")).alias("held_out"),
        (F.col("n") + 1).alias("n_tokens"),
        (F.col("known") + F.coalesce("known2", F.lit(0)) + int(ends > 0)).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("lc") + zero("lc2") + math.log10(ends + 1) + (F.col("n") + 1) * base).alias("base_score"),
        ((F.col("lp") + zero("lp2") + end_lp) / math.log(10)).alias("score"),
    )


def default_vocabulary() -> str:
    import public_tokenizers as p

    return p.path("piece_bpe_32k.model")


def op8_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(documents(spark, sf_dir), default_vocabulary())
