"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def line_dedup(docs, min_docs=10):
    """docs: [(id, text)] with distinct (id, text)."""
    keys = [[x.strip(" \t\n\x0b\x0c\r").translate(LOWER) for x in (t or "").split("\n")] for _, t in docs]
    n = Counter(k for ks in keys for k in set(ks) if k)
    out = []
    for (i, t), ks in zip(docs, keys):
        kept = [x for x, k in zip((t or "").split("\n"), ks) if n[k] < min_docs]
        out.append((i, len(ks), len(ks) - len(kept), sha("\n".join(kept))))
    return out


def simhash(text):
    w = words((text or "").translate(LOWER))
    if not w:
        return 0
    s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near_components(docs):
    fps = [simhash(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(docs):
        r = find(k)
        if i is not None:
            least[r] = min(i, least.get(r, i))
    return [(i, f"{fps[k]:016x}", least.get(find(k))) for k, (i, _) in enumerate(docs)]


def substring(docs, window=35):
    seen = Counter()
    split = [words(t) for _, t in docs]
    for w in split:
        seen.update(tuple(w[i : i + window]) for i in range(len(w) - window + 1))
    out = []
    for (i, _), w in zip(docs, split):
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            if seen[tuple(w[s : s + window])] > 1:
                gone[s : s + window] = [True] * window
        out.append((i, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g))))
    return out


def payload(text):
    data = (text or "").encode()
    return data.ljust(max(64, -(-len(data) // 64) * 64), b"\0"), len(data)


def media(text):
    p, n = payload(text)
    m = f"P5\n64 {len(p) // 64}\n255\n".encode() + p
    return n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(m), hashlib.sha256(m).hexdigest()


def feature(text):
    """Mean and deviation of the samples, and which of 8 x 8 areas are brighter than their mean."""
    p, _ = payload(text)
    mean = sum(p) / len(p)
    dev = math.sqrt(sum((x - mean) ** 2 for x in p) / len(p))
    rows, areas, at = len(p) // 64, [], 0
    for band in range(8):
        n = rows // 8 + (band < rows % 8)
        for column in range(8):
            areas.append(sum(p[r * 64 + column * 8 + k] for r in range(at, at + n) for k in range(8)) / n if n else 0.0)
        at += n
    bits = "".join("1" if x > sum(areas) / 64 + 1e-9 else "0" for x in areas)
    return f"mean={mean:.4f};dev={dev:.4f};hash={int(bits, 2):016x}"


def leaks(docs, items, similar=0.8, part=0.5):
    """Documents with the item's five-word shingles, and the three-word ones of its question and its answer."""
    terms = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    cut = lambda w, k: {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    share = lambda w, k, x: len(cut(w, min(k, len(w))) & cut(x, min(k, len(w)))) / len(cut(w, min(k, len(w))))
    out = set()
    for j, t in items:
        w = terms(t)
        if not w:
            continue
        lines = [x for x in map(terms, t.split("\n")) if x]
        answer = len(lines[-1]) if len(lines) > 1 else len(w) // 3
        parts = [p for p in (w[: len(w) - answer], w[len(w) - answer :]) if p]
        for i, x in docs:
            x = terms(x)
            if share(w, 5, x) >= similar and all(share(p, 3, x) >= part for p in parts):
                out.add((i, j))
    return out


def secrets(text):
    text = text or ""
    found = [("assign", m.span(), len(m[2]) >= 8) for m in re.finditer(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD])|(?:[pP][aA][sS][sS][wW][dD])|(?:[sS][eE][cC][rR][eE][tT])|(?:[tT][oO][kK][eE][nN])|(?:[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text)]
    found += [("access", m.span(), len(m[0]) >= 16) for m in re.finditer(r"AKIA[A-Z0-9]+", text)]
    found += [("hex", m.span(), len(m[0]) >= 32) for m in re.finditer(r"[0-9a-f]+", text)]
    order = {"assign": 0, "access": 1, "hex": 2}
    kept = sorted(((s, order[k], e, k) for k, (s, e), ok in found if ok))
    return Counter(x[3] for x in kept), sha(",".join(f"{k}:{s}:{e}" for s, _, e, k in kept)), {f"{k}:{s}:{e}" for s, _, e, k in kept}


def novel(text, novelty, context=120):
    """Novel spans: every run, every sensitive word, and sizes of whole compressed texts."""
    import zstandard

    primed = zstandard.ZstdCompressionDict(novelty.dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    primed.precompute_compress(level=3)
    size = lambda ballast, t: len(zstandard.ZstdCompressor(level=3, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False).compress(ballast + t.encode()))
    words = [m.span() for m in re.finditer(r"(?ai)passw|passphrase|secret|token|api[_ -]?key|credential|private|bearer|authorization|signature|access[_ -]?key|client[_ -]?id", text)]
    base = [tuple(map(int, x.split(":")[1:])) for x in secrets(text)[2]]
    out, at = [], 0
    stop = set("\"'`<>(){}[],;|")
    while at < len(text):
        end = at
        while end < len(text) and not text[end].isspace() and text[end] not in stop:
            end += 1
        s, e = at, end
        at = end + 1
        if e - s < 8:
            continue
        m = re.match(r"[A-Za-z_][\w.-]*[=:]+", text[s:e])
        s += m.end() if m else 0
        while e > s and text[e - 1] in ".:!?":
            e -= 1
        near = any(b <= s and s - b <= context or a >= e and a - e <= context for a, b in words)
        if e - s < 8 or not near or any(a < e and b > s for a, b in base):
            continue
        around = text[max(0, s - context) : s] + text[e : e + context] + " "
        cost = sum(size(b, around + text[s:e]) - size(b, around) for b in novelty.ballasts) / len(novelty.ballasts) / len(text[s:e].encode())
        row = sum(e - s >= x for x in (8, 10, 12, 14, 16, 20, 24, 32)) - 1 + 8 * any(c.isalpha() for c in text[s:e])
        if cost > novelty.least[row]:
            out.append(("novel", s, e))
    return out


def thresholds(novelty, insertions):
    """The 99 % points of novelty of (before, after, strings), from whole compressed texts and full sorted lists."""
    import zstandard

    primed = zstandard.ZstdCompressionDict(novelty.dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    primed.precompute_compress(level=3)
    size = lambda t: sum(len(zstandard.ZstdCompressor(level=3, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False).compress(b + t.encode())) for b in novelty.ballasts)
    seen = [[] for _ in range(16)]
    for before, after, strings in insertions:
        for x in strings:
            row = sum(len(x) >= k for k in (8, 10, 12, 14, 16, 20, 24, 32)) - 1 + 8 * any(c.isalpha() for c in x)
            around = before + after + " "
            seen[row].append((size(around + x) - size(around)) / len(novelty.ballasts) / len(x.encode()))
    return [sorted(x)[int(len(x) * 0.99)] if x else 1.0 for x in seen]


def base_lm(docs):
    """(held out, tokens, known, N, base score) by id."""
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    tokens = [[*words((t or "").translate(LOWER)), None] for _, t in docs]
    c = Counter(w for (i, _), ws in zip(docs, tokens) if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    return [(held(i), len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) for (i, _), ws in zip(docs, tokens)]


def segmentations(word, pieces):
    """Every way to spell a word with the pieces."""
    if not word:
        yield []
    for k in range(1, len(word) + 1):
        if word[:k] in pieces:
            for rest in segmentations(word[k:], pieces):
                yield [word[:k], *rest]


def lattice_lm(texts, held, lattice, prior, gain):
    """log10 probability of each text: every word's segmentations listed, weights by plain EM."""
    tokens = [words((t or "").translate(LOWER)) for t in texts]
    c = Counter(w for ws, h in zip(tokens, held) if not h for w in ws)
    ends = held.count(False)
    ids = {p: (x & 0xFFFFFFFF,) for p, x in lattice.found.items()}
    ways = {}
    for w in {w for ws in tokens for w in ws}:
        spelled = {**ids, **{x: tuple(int(lattice.bytes[b]) for b in x.encode()) for x in set(w) if x not in ids}}
        ways[w] = [[i for p in s for i in spelled[p]] for s in segmentations("▁" + w, spelled)]
    prob = lambda s, weights: math.prod(weights[i] for i in s)
    weights, before = [float(x) for x in lattice.first], -math.inf
    while ends:
        counts, reached = [0.0] * len(weights), ends * math.log(weights[lattice.end])
        counts[lattice.end] += ends
        for w, n in c.items():
            p = [prob(s, weights) for s in ways[w]]
            reached += n * math.log(sum(p))
            for s, x in zip(ways[w], p):
                for i in s:
                    counts[i] += n * x / sum(p)
        total = sum(counts)
        mixed = [x + float(f) * prior * max(1.0, total) for x, f in zip(counts, lattice.first)]
        weights = [x / sum(mixed) for x in mixed]
        if reached - before <= gain * abs(reached):
            break
        before = reached
    return [(sum(math.log(sum(prob(s, weights) for s in ways[w])) for w in ws) + math.log(weights[lattice.end])) / math.log(10) for ws in tokens]


def groups(pairs):
    out = defaultdict(set)
    for a, b in pairs:
        out[a].add(b)
    return out
