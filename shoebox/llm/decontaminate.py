"""Benchmark decontamination: BM25 with block-max WAND, then word-shingle overlap.

The test items are the collection: an inverted index with BM25 impacts, postings cut into aligned
blocks of items with each term's largest impact in the block. Every training document is a query of the
distinct words that stand in a shingle of some test item, wherever in the document (shingles are looked up
by a hash of term numbers; a clash adds words, none is lost). For each item there is a threshold that no
document which holds ``SIMILAR`` of its shingles can miss: the item's summed impacts without its heaviest
words that so large an overlap may lack. A block is skipped for a document whose block maxima don't add up
to the block's least threshold; in the others WAND walks the postings from pivot to pivot. The reported
score is that of the best passage (windows of twice the longest item, half overlapping).

Retrieved pairs are verified, and the unit is the whole document: it is contaminated by an item if it has
``SIMILAR`` or more of the item's five-word shingles, wherever they stand, and ``PART`` or more of the three-word
shingles of its question and of its answer (the answer is the last line of an item that has several, else its last
third; a part without words counts as the item).

The index is the only thing broadcast. It is made for ``ITEMS`` test items at a time, so its size is
bounded; more items mean more scans, in blocks, whose rows are written. Words are runs of letters and digits, lower-cased.

Defined cases: a null or empty document or item gives no rows; an item shorter than five words is one
shingle of all its words; an item without words never matches; repeated documents give repeated
rows and repeated items one row each; only the id and text columns are read; empty tables give an
empty table. Memory: one document at a time, whole.
"""

from __future__ import annotations

import functools
import math
import re
from bisect import bisect_left
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from shoebox.llm.common import documents, free, map_texts, row_digest, table
from shoebox.plans.tables import Scratch

WORD, SHINGLE, SIMILAR, PART_SHINGLE, PART, K1, B, BLOCK, MAX_BLOCKS, ITEMS = re.compile(r"[^\W_]+"), 5, 0.8, 3, 0.5, 1.2, 0.5, 4, 64, 2_000

MIX = np.uint64(0x9E3779B97F4A7C15)


def terms_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def shingles(words: list[str], width: int = SHINGLE) -> set[tuple[str, ...]]:
    if not words:
        return set()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def answer_start(text: str, words: list[str]) -> int:
    """The number of words before the answer."""
    lines = [x for x in text.split("\n") if terms_of(x)]
    if len(lines) > 1:
        return len(words) - len(terms_of(lines[-1]))
    return len(words) - len(words) // 3


class Index:
    """Postings with impacts of one block of test items."""

    def __init__(self, items: list[tuple[object, str]]):
        items = [(i, t, terms_of(t)) for i, t in items]
        df = Counter(t for _, _, w in items for t in set(w))
        # items that share their most common word stand together: blocks then bound more tightly
        items = sorted((x for x in items if x[2]), key=lambda x: (max((df[t], t) for t in x[2]), x[2]))
        self.ids = [i for i, _, _ in items]
        self.words = [w for _, _, w in items]
        self.shingles = [shingles(w) for w in self.words]
        cut = [answer_start(t, w) for _, t, w in items]
        self.question = [shingles(w[:c], PART_SHINGLE) or s for w, c, s in zip(self.words, cut, self.shingles)]
        self.answer = [shingles(w[c:], PART_SHINGLE) or s for w, c, s in zip(self.words, cut, self.shingles)]
        n = len(items)
        self.longest = max(map(len, self.words), default=1)
        mean = sum(map(len, self.words)) / max(1, n)
        posted: dict[str, list[tuple[int, float]]] = {}
        self.least, self.impacts = [], []
        for i, words in enumerate(self.words):
            impacts = {}
            for t, tf in Counter(words).items():
                idf = math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5))
                impacts[t] = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(words) / mean))
                posted.setdefault(t, []).append((i, impacts[t]))
            self.impacts.append(impacts)
            lacking = math.floor((1 - SIMILAR) * len(self.shingles[i]) + 1e-9)
            if len(self.shingles[i]) < len(words) - SHINGLE + 1:  # a repeated shingle that lacks may take its first and its last word
                lacking *= 2
            weights = sorted(impacts.values())
            self.least.append(max(1e-9, sum(weights[: max(1, len(weights) - lacking)]) - 1e-9))
        size = max(BLOCK, -(-n // MAX_BLOCKS))
        self.post: dict[str, list[tuple[int, float]]] = posted
        self.blocks = []
        for lo in range(0, n, size):
            self.blocks.append(({}, min(self.least[lo : lo + size])))
        for t, p in posted.items():
            for i, x in p:
                self.blocks[i // size][0].setdefault(t, ([], []))[0].append(i)
                self.blocks[i // size][0][t][1].append(x)
        self.blocks = [({t: (d, x, max(x)) for t, (d, x) in terms.items()}, floor) for terms, floor in self.blocks]
        self.term = {t: k + 1 for k, t in enumerate(posted)}
        self.most = np.zeros((len(posted) + 1, max(1, len(self.blocks))))
        for b, (terms, _) in enumerate(self.blocks):
            for t, (_, _, x) in terms.items():
                self.most[self.term[t], b] = x
        by_width: dict[int, list[np.ndarray]] = {}
        for words in self.words:
            width = min(SHINGLE, len(words))
            by_width.setdefault(width, []).append(self.hashes(np.array([self.term[t] for t in words]), width))
        self.hashed = {w: np.unique(np.concatenate(x)) for w, x in by_width.items()}
        self.floors = np.array([f for _, f in self.blocks] or [math.inf]) - 1e-6

    def search(self, query: set[str], blocks=None) -> list[tuple[int, float]]:
        """Block-max WAND: all items of the blocks whose score for the query reaches their threshold."""
        out = []
        for b in range(len(self.blocks)) if blocks is None else blocks:
            terms, floor = self.blocks[b]
            lists = [[0, *terms[t]] for t in query & terms.keys()]
            if sum(c[3] for c in lists) < floor:
                continue
            while lists:
                lists.sort(key=lambda c: c[1][c[0]])
                bound, pivot = 0.0, -1
                for k, c in enumerate(lists):
                    bound += c[3]
                    if bound >= floor:
                        pivot = k
                        break
                if pivot < 0:
                    break
                item = lists[pivot][1][lists[pivot][0]]
                if lists[0][1][lists[0][0]] == item:
                    at = [c for c in lists if c[1][c[0]] == item]
                    score = sum(c[2][c[0]] for c in at)
                    if score >= self.least[item]:
                        out.append((item, score))
                    for c in at:
                        c[0] += 1
                else:
                    for c in lists[:pivot]:
                        c[0] = bisect_left(c[1], item, c[0])
                lists = [c for c in lists if c[0] < len(c[1])]
        return out

    def hashes(self, rows: np.ndarray, width: int) -> np.ndarray:
        """A number for each run of ``width`` term numbers; zero where one is no term."""
        n = max(0, len(rows) - width + 1)
        out, known = np.zeros(n, np.uint64), np.ones(n, bool)
        for j in range(width):
            part = rows[j : j + n]
            known &= part > 0
            out = (out * MIX) ^ part.astype(np.uint64)
        out = (out * MIX) | np.uint64(1)
        out[~known] = 0
        return out

    def query(self, words: list[str], rows: np.ndarray) -> set[str]:
        """The distinct words of a document that stand in a shingle of an item."""
        covered = np.zeros(len(words) + 1, np.int64)
        for width, known in self.hashed.items():
            found = self.hashes(rows, width)
            at = np.flatnonzero(found)
            k = np.minimum(np.searchsorted(known, found[at]), len(known) - 1)
            at = at[known[k] == found[at]]
            covered[at] += 1  # at one width, starts differ
            covered[at + width] -= 1
        return {words[j] for j in np.flatnonzero(np.cumsum(covered[:-1])).tolist()}

    def score(self, item: int, passages: list[set[str]]) -> float:
        """BM25 of the item for the best passage."""
        impacts = self.impacts[item]
        return max(sum(x for t, x in impacts.items() if t in p) for p in passages)

    def overlaps(self, text: str) -> list[tuple[int, float, float, float, float]]:
        """(item, BM25, overlap, question overlap, answer overlap) of the items found in the text."""
        words = terms_of(text)
        if not words or not self.ids:
            return []
        query = self.query(words, np.fromiter(map(self.term.get, words, repeat(0)), np.int64, len(words)))
        if not query:
            return []
        bound = self.most[[self.term[t] for t in query]].sum(axis=0)
        items = [i for i, _ in self.search(query, np.flatnonzero(bound >= self.floors).tolist())]
        if not items:
            return []
        passages = [set(words[k : k + 2 * self.longest]) for k in range(0, max(1, len(words) - self.longest), self.longest)]
        scores = {i: self.score(i, passages) for i in items}
        have: dict[int, set] = {}
        out = []
        for i, score in sorted(scores.items()):
            for w in {len(next(iter(s))) for s in (self.shingles[i], self.question[i], self.answer[i])} - have.keys():
                have[w] = set(zip(*(words[j:] for j in range(w)), strict=False))
            share = [sum(s in have[len(s)] for s in part) / len(part) for part in (self.shingles[i], self.question[i], self.answer[i])]
            out.append((i, score, *share))
        return out


def contaminated(docs: DataFrame, items: DataFrame, similar: float = SIMILAR, block: int = ITEMS) -> DataFrame:
    """(doc_id, item_id, bm25, overlap, question_overlap, answer_overlap) for every document and test
    item with ``similar`` of the item's shingles, and ``PART`` of its question's and answer's, in the document."""
    spark = docs.sparkSession
    if similar < SIMILAR:
        raise ValueError(f"the thresholds are made for an overlap of {SIMILAR} or more")
    kinds = docs.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType
    schema = f"doc_id {kinds[0]}, item_id {kinds[1].simpleString()}, bm25 double, overlap double, question_overlap double, answer_overlap double"
    from pyspark.sql.pandas.types import to_arrow_type

    item_type = to_arrow_type(kinds[1])

    def scan(index: Index) -> DataFrame:
        shared = spark.sparkContext.broadcast(index)

        def make():
            at = shared.value

            def apply(batch, texts):
                found = [(row, *x) for row, t in enumerate(texts) for x in at.overlaps(t) if x[2] >= similar and min(x[3:]) >= PART]
                cols = list(zip(*found)) or [()] * 6
                names = batch.column("doc_id").take(pa.array(cols[0], pa.int32()))
                rest = [pa.array(c, pa.float64()) for c in cols[2:]]
                return pa.RecordBatch.from_arrays([names, pa.array([at.ids[i] for i in cols[1]], item_type), *rest], ["doc_id", "item_id", "bm25", "overlap", "question_overlap", "answer_overlap"])

            return apply

        return map_texts(docs.select("doc_id", "text"), make, schema)

    scratch, part, blocks = Scratch(spark, "contaminated"), [], []
    for row in items.select("item_id", "text").where("text is not null").orderBy("item_id", "text").toLocalIterator():
        if len(part) == block:
            blocks.append(scratch.write(scan(Index(part))))
            part = []
        part.append((row["item_id"], row["text"]))
    return functools.reduce(DataFrame.unionByName, [*blocks, scan(Index(part))])


def drop_contaminated(docs: DataFrame, items: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """``docs`` without the documents that hold a test item. Only digests of those rows are joined, so
    other rows under the same id, or without one, stay."""
    keys = free(docs, "r1", "r2")
    keyed = docs.select("*", *row_digest(docs, keys))
    bad = contaminated(keyed.select(F.struct(*keys).alias("doc_id"), "text"), items, similar).select("doc_id.*").distinct()
    return keyed.join(bad, keys, "left_anti").select([F.col(f"`{c}`") for c in docs.columns])


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
