"""Quality scores, language mixtures and fingerprints against plain versions of the same method."""

import re
import zlib

import numpy as np
import xxhash
from test_llm import SCHEMA, _rows

from gritstone.llm import language_id, order_minhash, quality


def test_quality_equals_plain_densities(spark):
    """Means and covariances by numpy over the labelled rows, densities by inverse and determinant."""
    rows = [r for r in _rows() if r[0] is not None]
    marked = {r[0]: int(len(r[1] or "") % 3 > 0) for r in rows if r[0] % 7}
    labels = spark.createDataFrame([(i, y, 0) for i, y in marked.items()] + [(3, None, 0), (900, 1, 0)], "doc_id long, quality int, node int")
    got = quality.quality(spark.createDataFrame(rows, SCHEMA).repartition(3), labels).collect()
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    d = len(quality.NAMES)
    x = {c: np.array([quality.statistics(r[1]) for r in rows if not held(r[0]) and marked.get(r[0]) == c]) for c in (0, 1)}
    n = sum(map(len, x.values()))
    cov = {c: np.cov(v.T, bias=True) for c, v in x.items()}
    within = sum(len(v) / n * cov[c] for c, v in x.items())
    scale = np.sqrt(np.maximum(np.diag(within), 1e-6))

    def density(c, v):
        lam = max(0.25, d / (d + len(x[c])))
        s = ((1 - lam) * cov[c] + lam * within) / np.outer(scale, scale)
        s = 0.98 * s + 0.02 * max(np.trace(s) / d, 1e-3) * np.eye(d)
        z = (v - x[c].mean(0)) / scale
        return np.log(len(x[c]) / n) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * z @ np.linalg.inv(s) @ z

    text = {r[0]: r[1] for r in rows}
    assert len(got) == len(rows) and min(map(len, x.values())) > 8
    for r in got:
        v = np.array(quality.statistics(text[r.doc_id]))
        want = 1 / (1 + np.exp(-np.clip(density(1, v) - density(0, v), -40, 40)))
        assert abs(r.score - want) < 1e-6 and r.held_out == held(r.doc_id) and r.predicted == int(r.score >= 0.3)


def test_language_mixtures_equal_plain_em():
    """One text at a time, words and languages by loops; and no text depends on those beside it."""
    r = np.random.default_rng(3)
    langs = ["aa", "bb", "cc", "dd"]
    vocab = {k: ["".join(r.choice(list("abcdefghijklmnop"), 5)) for _ in range(30)] for k in langs}
    counts = np.stack([np.bincount(language_id.ngrams([" ".join(v)])[0], minlength=language_id.BUCKETS) for v in vocab.values()], axis=1)
    table = np.log((counts + 0.5) / (counts.sum(axis=0) + 0.5 * language_id.BUCKETS)).astype(np.float32)
    texts = [" ".join(w for k in r.choice(langs, r.integers(1, 5), replace=False) for w in r.choice(vocab[k], r.integers(1, 30))) for _ in range(60)] + ["", "12 ½"]

    def plain(text):
        if not any(c.isalpha() for c in text):
            return "und", 0.0, []
        grams, word, _ = language_id.ngrams([text])
        like = []
        for w in sorted(set(word.tolist()), key=word.tolist().index):
            s = np.sum([table[g].astype(float) for g, x in zip(grams, word) if x == w], axis=0)
            like.append(np.exp(np.maximum(s - s.max(), -20)))

        def em(allowed, rounds):
            share = np.array(allowed, float) / sum(allowed)
            for _ in range(rounds):
                total = np.zeros(len(langs))
                for p in like:
                    total += p * share / max((p * share).sum(), 1e-30)
                share = np.where(allowed, total / len(like), 0)
                share /= share.sum()
            return share, sum(np.log(max((p * share).sum(), 1e-30)) for p in like)

        full, _ = em([1] * 4, 6)
        order = sorted(range(4), key=lambda k: -full[k])
        first = lambda k: [int(i in order[:k]) for i in range(4)]
        chosen, best = em(first(1), 0)
        for k in range(2, 5):
            share, fit = em(first(k), 6)
            fit -= 0.5 * (k - 1) * np.log(len(like) + 1)
            if fit <= best:
                break
            chosen, best = share, fit
        return langs[int(np.argmax(chosen))], float(full[np.argmax(chosen)]), {langs[i]: s for i, s in enumerate(chosen) if s > 0}

    together, sizes = list(zip(*language_id.infer(texts, langs, table))), set()
    for text, (pred, score, own) in zip(texts, together):
        alone = [x[0] for x in language_id.infer([text], langs, table)]
        assert alone[0] == pred and abs(alone[1] - score) < 1e-6 and [x["lang"] for x in alone[2]] == [x["lang"] for x in own]
        want = plain(text)
        assert pred == want[0] and abs(score - want[1]) < 1e-3
        assert {x["lang"] for x in own} == set(want[2]) and all(abs(x["share"] - want[2][x["lang"]]) < 1e-3 for x in own)
        sizes.add(len(own))
    assert sizes >= {0, 1, 2, 3}


def _hash(parts):
    h = 42
    for p in parts:
        h = xxhash.xxh64_intdigest(p.encode() if isinstance(p, str) else p, h)
    return h - (1 << 64) if h >> 63 else h


def _fingerprint(text):
    words = re.findall(order_minhash._PIECE.removesuffix("+"), text)
    low = (1 << 23) - 1
    seen, keys = {}, []
    for i in range(max(len(words) - 2, 1) if words else 0):
        head = _hash(words[i : i + 3]) >> 23
        n = seen[head] = seen.get(head, -1) + 1
        keys.append((_hash([head.to_bytes(8, "little", signed=True), n.to_bytes(4, "little")]) & ~low) | i)
    out = []
    for j in range(-16, 16):
        least = sorted(k for k in keys if k >> 59 == j)[:2]
        top = [(k % (1 << 64) >> 24) for k in sorted(least, key=lambda k: (k & low, k % (1 << 64) >> 24))]
        out.append(f"{_hash([x.to_bytes(8, 'little') for x in top]) % (1 << 64):016x}"[:8] if top else "-" * 8)
    return "".join(out)


def _like(a, b):
    pairs = [(a[i : i + 8], b[i : i + 8]) for i in range(0, 256, 8)]
    used = [x == y for x, y in pairs if (x, y) != ("-" * 8, "-" * 8)]
    return 1.0 if a == b else sum(used) / len(used) if used else 0.0


def test_fingerprints_equal_plain_ones(spark):
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    texts = {r[0]: r[1] for r in _rows() if r[0] is not None} | {1000: "a b a b a b a b a b", 1001: "one", 1002: "x" * 400, 1003: long, 1004: "b a b a b a b a b a"}
    rows = [(i, t, None, None, 0, 1, "k", 0.5, "q", 1.0) for i, t in texts.items()]
    got = {r.doc_id: r for r in order_minhash.order_minhash(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    ids = sorted(texts, reverse=True)
    for i, x in enumerate(ids):
        t, n = texts[x] or "", texts[ids[(i + 1) % len(ids)]] or ""
        c = len(t) // 3
        own, edited, after = _fingerprint(t), _fingerprint(t[: len(t) - c] + n[:c]), _fingerprint(n)
        assert (got[x].fingerprint, got[x].edited_fingerprint) == (own, edited), x
        assert abs(got[x].near_edited - _like(own, edited)) < 1e-12 and abs(got[x].near_next - _like(own, after)) < 1e-12
    assert "-" not in got[1003].fingerprint and got[1002].fingerprint != got[1001].fingerprint
