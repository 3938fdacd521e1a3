"""Secret scan: fixed patterns, and novelty under a dictionary-primed zstandard compressor.

The base is three patterns. The method adds candidates: every run of eight or more characters
without white space, quotes or brackets that has a sensitive word within ``CONTEXT`` code points, before or after it. A
candidate's novelty is its marginal compressed size: the bytes that it adds to the text around it (both
sides), when the compressor is primed with a dictionary of identifiers, over its own bytes.
Strings that the surroundings or the dictionary explain cost little, random ones cost their entropy. What
reaches the threshold of its class is reported as ``novel``, unless a base span overlaps it.

The dictionary holds the ``FREQUENT`` most frequent words of the whole corpus (counted in all documents by
Spark) and common words of code. A fixed ballast of ordinary strings, made of these and of the words that follow in frequency, precedes every text, so that a
few bytes more don't switch the compressor's literal coding, and the mean over ``BALLASTS`` of them tells fractions of a byte. Thresholds are calibrated on insertions: ordinary
strings (words, identifiers, paths, hosts, dates, versions, numbers) are put into ordinary
text, and a threshold is what a share of ``FALSE`` of them exceed, for strings with letters and numbers
apart and for each of the ``LENGTHS``. Every word of the corpus stands in one of these strings at least; tasks measure
them, and the shares are exact, taken over all of them.

Defined cases: a null or empty text has no spans; spans are code points, end exclusive, sorted by
start and then kind as listed in ``KINDS``; repeated rows give repeated rows; only ``doc_id`` and
``text`` are read; an empty table gives an empty table, and trains on the words of code alone. Memory: one text at a time, whole.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from shoebox.llm.common import documents, map_texts, most_frequent, sha256
from shoebox.plans.tables import Scratch

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
#: A run is maximal, so asking for its least length in the pattern drops the same matches.
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
CANDIDATE = re.compile(r"""[^\s"'`<>(){}\[\],;|]{8,}""")
#: What a candidate loses at its ends: the name before = or :, and marks that end a sentence.
NAME, MARKS = re.compile(r"[A-Za-z_][\w.-]*[=:]+"), ".:!?"
SENSITIVE = re.compile(r"passw|passphrase|secret|token|api[_ -]?key|credential|private|bearer|authorization|signature|access[_ -]?key|client[_ -]?id", re.I | re.A)
LETTERS = re.compile(r"[^\W\d_]{3,40}")
CONTEXT, FREQUENT, FALSE, LENGTHS, BALLAST, BALLASTS, LEVEL = 120, 4_000, 0.01, (8, 10, 12, 14, 16, 20, 24, 32), 1_500, 4, 3
#: Words of a bucket and of a task, and those whose strings share their surroundings; the words of a small corpus are used again until
#: so many were put in.
BUCKET, TASK, GROUP, INSERTIONS = 64, 32_768, 16, 24_000
#: A number follows every so many strings.
NUMBER = 3
#: Common words of code and configuration.
CODE = (
    "import from return class def function public static private string const variable null true false none self this new that with when then else while break "
    "username user password passwd secret token api key apikey value name id host port url http https www localhost example com org net io dev email mail "
    "config configuration settings environment production development staging default options request response header headers authorization bearer "
    "client server session cookie access refresh certificate begin end rsa signature credential credentials database connection number version "
    "select insert update delete where table index primary integer boolean float array object list map get set put post main test docs src lib usr local "
    "release candidate final report author chapter section document readme license build target package module service handler manager controller"
).split()


def identifiers(docs: DataFrame) -> DataFrame:
    """(word, n) of all runs of three or more letters of all documents."""

    def make():
        def apply(batch, texts):
            words = Counter()
            for t in texts:
                words.update(LETTERS.findall(t))
            return pa.RecordBatch.from_arrays([pa.array(list(words)), pa.array(list(words.values()), pa.int64())], ["word", "n"])

        return apply

    return map_texts(docs.select("text"), make, "word string, n long", max_chars=8_000_000).groupBy("word").agg(F.sum("n").alias("n"))


class Ordinary:
    """Ordinary strings and text, made of the words given, each used once before any again, of frequent words and words of code."""

    def __init__(self, words: list[str], frequent: list[str], rng: random.Random):
        self.rng, self.words, self.used, self.due = rng, words, 0, False
        self.pools = [x for x in (words, frequent, CODE) if x]

    def word(self) -> str:
        pool = self.words if self.due else self.rng.choice(self.pools)
        self.due = False
        if pool is self.words and self.used < len(pool):
            self.used += 1
            return pool[self.used - 1]
        return self.rng.choice(pool)

    def strings(self) -> Iterator[str]:
        """Strings as long as candidates are, each with a new one of the words or more, until every word stood in one."""
        while self.used < len(self.words):
            used, self.due = self.used, True
            x = self.string()
            if len(x) >= LENGTHS[0]:
                yield x
            else:
                self.used = used

    def text(self, size: int) -> str:
        out = ""
        while len(out) < size:
            out += (self.string() if self.rng.random() < 0.2 else self.word()) + " "
        return out

    def number(self) -> str:
        n = self.rng.randrange
        date, clock = f"{n(1990, 2040)}-{n(1, 13):02d}-{n(1, 29):02d}", f"{n(24):02d}:{n(60):02d}:{n(60):02d}"
        dots = ".".join(str(n(256)) for _ in range(4))
        some = (date, clock, f"{date}T{clock}", dots, f"{dots}:{n(1, 65536)}", f"+{n(1, 99)}-{n(1000):03d}-{n(1000):03d}-{n(10000):04d}", str(n(1, 10**4) * 10 ** n(4, 12)), f"{date}/{n(1, 99)}/{date}")
        return self.rng.choice(some)

    def string(self) -> str:
        n, w = self.rng.randrange, self.word
        date = f"{n(1990, 2040)}-{n(1, 13):02d}-{n(1, 29):02d}"
        kind = n(9)
        if kind == 0:
            return w()
        if kind == 1:
            return "_".join(w() for _ in range(n(2, 5)))
        if kind == 2:
            return "-".join([w(), w(), date, w()])
        if kind == 3:
            return "/".join([w(), w(), f"{w()}-{n(2000, 2040)}-{w()}-{w()}{n(20)}"])
        if kind == 4:
            return w() + w().capitalize() + w().capitalize()
        if kind == 5:
            return f"{w()}@{w()}.{w()}"
        if kind == 6:
            return f"{w()}-{w()}-v{n(20)}.{n(20)}.{n(20)}"
        if kind == 7:
            return "_".join([w().capitalize(), w().capitalize(), w().capitalize(), str(n(100))])
        return f"//{w()}.{w()}/{w()}/{w()}.{self.rng.choice(('html', 'py', 'md', 'json'))}"


def kind_of(candidate: str) -> int:
    """The class of a string: numbers first, then strings with letters, by length."""
    return (any(map(str.isalpha, candidate))) * len(LENGTHS) + max(0, bisect_right(LENGTHS, len(candidate)) - 1)


def insertions(words: list[str], frequent: list[str], seed: int, rounds: int) -> Iterator[tuple[str, str, list[str]]]:
    """(before, after, strings): in every round each of ``words`` stands in a string, and others of them in the text around it."""
    rng = random.Random(seed)
    n = rng.randrange(NUMBER)
    for _ in range(rounds):
        rng.shuffle(words := sorted(words))
        for at in range(0, len(words), GROUP):
            text = Ordinary(words[at + GROUP :] + words[:at], frequent, rng).text(2 * CONTEXT)
            ordinary, strings = Ordinary(words[at : at + GROUP], frequent, rng), []
            for x in ordinary.strings():
                strings.append(x)
                n += 1
                if n % NUMBER == 0 and len(x := ordinary.number()) >= LENGTHS[0]:
                    strings.append(x)
            yield text[:CONTEXT], text[CONTEXT:], strings


def least_of(seen: list[tuple[int, float, int]]) -> list[float]:
    """From (class, novelty, how many) the novelty that a share of ``FALSE`` of a class exceed, for each class."""
    total, out = Counter(), [1.0] * (2 * len(LENGTHS))
    for kind, _, n in seen:
        total[kind] += n
    rank = {kind: int(n * (1 - FALSE)) for kind, n in total.items()}
    for kind, value, n in sorted(seen):
        if rank[kind] >= 0:
            out[kind] = value
            rank[kind] -= n
    return out


class Novelty:
    """Marginal compressed bytes of a string in its surroundings, per byte of the string, and the
    thresholds of novelty, without which it tells no novel strings."""

    def __init__(self, frequent: list[str] = (), next_frequent: list[str] = (), least: list[float] | None = None):
        self.frequent, self.next_frequent, self.least = list(frequent), list(next_frequent), least
        ordinary = Ordinary(self.next_frequent, self.frequent, random.Random(1))
        self.ballasts = [ordinary.text(BALLAST).encode() for _ in range(BALLASTS)]
        self.dictionary = " ".join([*reversed(self.frequent), *CODE]).encode()
        primed = zstandard.ZstdCompressionDict(self.dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        primed.precompute_compress(level=LEVEL)
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False)

    def __reduce__(self):
        return Novelty, (self.frequent, self.next_frequent, self.least)

    def size(self, text: str) -> int:
        data = text.encode()
        return sum(len(self.compressor.compress(x + data)) for x in self.ballasts)

    def per_byte(self, more: int, candidate: str) -> float:
        return more / max(1, len(self.ballasts) * len(candidate.encode()))

    def __call__(self, before: str, candidate: str, after: str) -> float:
        around = before + after + " "
        return self.per_byte(self.size(around + candidate) - self.size(around), candidate)

    def measured(self, words: list[str], seed: int, rounds: int) -> Counter:
        """How many insertions of ``words`` have which (class, novelty)."""
        seen = Counter()
        for before, after, strings in insertions(words, self.frequent, seed, rounds):
            around = before + after + " "
            empty = self.size(around)
            for x in strings:
                seen[kind_of(x), self.per_byte(self.size(around + x) - empty, x)] += 1
        return seen

    def novel(self, before: str, candidate: str, after: str) -> bool:
        return self(before, candidate, after) > self.least[kind_of(candidate)]


def calibrate(counts: DataFrame, novelty: Novelty) -> list[float]:
    """The thresholds from insertions of all words of ``counts``. What is measured for a word depends on all words, not on how they are dealt."""
    total = counts.count()
    rounds = -(-INSERTIONS // max(1, total))
    if not total:
        return least_of([(*k, n) for k, n in novelty.measured(CODE, 0, -(-INSERTIONS // len(CODE))).items()])
    shared = counts.sparkSession.sparkContext.broadcast(novelty)
    bucket = F.pmod(F.xxhash64("word"), F.lit(-(-total // BUCKET)))

    def run(batches):
        novelty, seen = shared.value, Counter()
        for batch in batches:
            for i, words in zip(batch.column("bucket").to_pylist(), batch.column("words").to_pylist()):
                seen.update(novelty.measured(words, i, rounds))
        kinds, values = zip(*seen) if seen else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(values, pa.float64()), pa.array(list(seen.values()), pa.int64())], ["kind", "novelty", "n"])

    buckets = counts.select("word", bucket.alias("bucket")).repartition(-(-total // TASK), "bucket").groupBy("bucket").agg(F.collect_list("word").alias("words"))
    rows = buckets.mapInArrow(run, "kind int, novelty double, n long").groupBy("kind", "novelty").agg(F.sum("n").alias("n")).collect()
    return least_of([tuple(r) for r in rows])


def train(docs: DataFrame, frequent: int = FREQUENT) -> Novelty:
    """The dictionary from word counts over all documents, the thresholds from all words."""
    scratch = Scratch(docs.sparkSession, "identifiers")
    counts = scratch.write(identifiers(docs))
    ranked = lambda k: [r["word"] for r in sorted(most_frequent(counts, "n", k).collect(), key=lambda r: (-r["n"], r["word"]))]
    top = ranked(frequent)
    more = ranked(2 * frequent)[len(top) :]
    least = calibrate(counts, Novelty(top, more))
    scratch.drop(counts)
    return Novelty(top, more, least)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [("access", *m.span()) for m in ACCESS.finditer(text)]
    return found + [("hex", *m.span()) for m in HEX.finditer(text)]


def candidates(text: str, start: int, stop: int):
    """(start, end) of the candidates that begin and end within a part of the text, whose ends are no cuts."""
    for m in CANDIDATE.finditer(text, start, stop):
        s, e = m.span()
        name = NAME.match(text, s, e)
        if name:
            s = name.end()
        while e > s and text[e - 1] in MARKS:
            e -= 1
        if e - s >= LENGTHS[0]:
            yield s, e


def regions(text: str, context: int) -> list[tuple[int, int]]:
    """Parts of the text around sensitive words that hold all candidates in question, cut at white space."""
    out: list[list[int]] = []
    for m in SENSITIVE.finditer(text):
        lo, hi = max(0, m.start() - context), min(len(text), m.end() + context)
        if out and lo <= out[-1][1]:
            out[-1][1] = max(hi, out[-1][1])
        else:
            out.append([lo, hi])
    merged: list[tuple[int, int]] = []
    for lo, hi in out:
        while lo and not text[lo - 1].isspace():
            lo -= 1
        while hi < len(text) and not text[hi].isspace():
            hi += 1
        if merged and lo < merged[-1][1]:
            merged[-1] = merged[-1][0], max(hi, merged[-1][1])
        else:
            merged.append((lo, hi))
    return merged


def novel_spans(text: str, base: list[tuple[str, int, int]], novelty: Novelty, context: int = CONTEXT) -> list[tuple[str, int, int]]:
    """Novel candidates with a sensitive word outside of them, at most ``context`` code points away, which no
    base span overlaps."""
    words = [m.span() for m in SENSITIVE.finditer(text)]
    if not words:
        return []
    starts, ends = [s for s, _ in words], [e for _, e in words]
    covered = sorted((s, e) for _, s, e in base)
    out, j = [], 0
    for lo, hi in regions(text, context):
        for s, e in candidates(text, lo, hi):
            k = bisect_right(ends, s) - 1  # the last sensitive word before, and the first after
            i = bisect_left(starts, e)
            if not (k >= 0 and s - ends[k] <= context or i < len(starts) and starts[i] - e <= context):
                continue
            while j < len(covered) and covered[j][1] <= s:
                j += 1
            if any(a < e and b > s for a, b in covered[j : j + 3]):
                continue
            if novelty.novel(text[max(0, s - context) : s], text[s:e], text[e : e + context]):
                out.append(("novel", s, e))
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    order = {k: i for i, k in enumerate(KINDS)}
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], order[x[0]])))


def scan_documents(docs: DataFrame, novelty: Novelty | None = None, context: int = CONTEXT) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, found array<struct<kind, start, end, value>>).
    Without ``novelty`` it is trained on ``docs``."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, found array<struct<kind: string, start: int, end: int, value: string>>"
    item = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())])
    shared = docs.sparkSession.sparkContext.broadcast(novelty or train(docs))

    def make():
        novelty = shared.value

        def apply(batch: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
            counts, hashes, spans, found = ([], [], []), [], [], []
            for text in texts:
                base = base_spans(text)
                every = base + novel_spans(text, base, novelty, context)
                for col, k in zip(counts, KINDS):
                    col.append(sum(x[0] == k for x in base))
                hashes.append(sha256(joined(base).encode()))
                spans.append(joined(every))
                found.append([{"kind": k, "start": s, "end": e, "value": text[s:e]} for k, s, e in sorted(every, key=lambda x: x[1])])
            cols = [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(hashes), pa.array(spans), pa.array(found, pa.list_(item))]
            return pa.RecordBatch.from_arrays(cols, ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "found"])

        return apply

    return map_texts(docs.select("doc_id", "text"), make, schema)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_documents(documents(spark, sf_dir)).drop("found")
