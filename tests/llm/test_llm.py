"""The ten operators on small tables, against brute force; nulls, blanks, ties, repeats, clashing columns, no rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import public_tokenizers
import pytest
import tiktoken
import tiktoken.load

import corpus_pipeline
from gritstone.llm import byte_bpe, exact_dedup, language_id, lm, mixing, ngram_join, order_minhash, private, quality, substring_dedup

LOW = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, key string, score double, spans string, weight double"


def _rows():
    r = random.Random(5)
    en = "the of and to in is was that for with as his on be at by had not are but from".split()
    fr = "le la les des est dans que pour qui une sur avec plus par été mais nous vous leur".split()
    word = lambda v: r.choice(v) if r.random() < 0.5 else "".join(r.choice(v)[:2] for _ in range(3))
    texts = [" ".join(word(en if i % 2 else fr) for _ in range(r.choice([3, 60, 120]))) for i in range(36)]
    shared = " ".join(f"s{i}" for i in range(50))
    near = texts[5] + " " + " ".join(f"n{i}" for i in range(80))
    texts += [near, near + " tail", near.replace("n40", "other"), near, "  " + near.replace(" ", "\n"), shared, "x " + shared, shared + " y z", "", None, " \n\t ", "123 456", "日本語のテキスト" * 20, "a " * 3000, "Ünï " * 50]
    texts += [f"call +1 (415) 555-{n:04d} or mail jo{n}@ex.am.ple, card 4111 1111 1111 1111 at 10.0.{n}.7 near Zebulon" for n in range(4)] + ["ask Xanthippe at secret@corp.org now please", "Xanthippe wrote secret@corp.org today", "via Xanthippe: secret@corp.org!"]
    rows = [(i, t, ("en" if i % 2 else "fr") if i < 36 else (None if i % 3 else "en"), f"s{i % 3}" if i % 7 else None, 0, 1, "k", 0.5, "q", 1.0) for i, t in enumerate(texts)]
    return rows + [rows[3], (None, "a null id", None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def rows():
    return _rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def _words(t, lower=True):
    b = (t or "").encode()
    return (b.translate(LOW) if lower else b).split()


def test_substring_dedup(docs, none, rows):
    got = Counter((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in substring_dedup.substring_dedup(docs).collect())
    seen = Counter(tuple(w[i : i + 35]) for r in rows for w in [_words(r[1], False)] for i in range(len(w) - 34))
    want = Counter()
    for r in rows:
        w = _words(r[1], False)
        gone = set()
        for i in range(len(w) - 34):
            if seen[tuple(w[i : i + 35])] > 1:
                gone.update(range(i, i + 35))
        want[(r[0], len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest())] += 1
    assert got == want and sum(n for _, _, n, _ in want) > 3000
    assert substring_dedup.substring_dedup(none).count() == 0


def test_repeats_equal_brute_force():
    r = random.Random(1)
    for _ in range(60):
        rows = [([r.randrange(3) for _ in range(r.randrange(5, 14))], r.choice([1, 1, 2])) for _ in range(5)]
        c = Counter()
        for w, n in rows:
            for i in range(len(w) - 4):
                c[tuple(w[i : i + 5])] += n
        assert substring_dedup.repeats(rows, 5) == [sum(1 << i for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1) for w, _ in rows]


def test_ngram_join(docs, none, rows, monkeypatch):
    sets = []
    for r in rows:
        w = _words(r[1])
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set())
    comp = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 75 * len(a | b):
                    comp[i] = comp[j] = min(comp[i], comp[j])
    want = Counter()
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if comp[j] == comp[i] and rows[j][0] is not None]
        want[(r[0], len(sets[i]), min(ids) if sets[i] and ids else r[0])] += 1
    assert Counter(tuple(r) for r in ngram_join.near_duplicates(docs).collect()) == want
    monkeypatch.setattr(ngram_join, "FAMILY", 0)  # leaders' rounds to the end
    assert Counter(tuple(r) for r in ngram_join.near_duplicates(docs).collect()) == want
    assert ngram_join.near_duplicates(none).count() == 0


def _linked(texts):
    """(number of shingles, least place linked) of each text, by counting what each pair shares."""
    sets, holders = [], {}
    for i, t in enumerate(texts):
        w = _words(t)
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set())
        for x in sets[-1]:
            holders.setdefault(x, []).append(i)
    comp = list(range(len(texts)))

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i, own in enumerate(sets):
        for j, n in Counter(j for x in own for j in holders[x] if j < i).items():
            if 100 * n >= 75 * (len(own) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                comp[b] = a
    return [(len(x), find(i)) for i, x in enumerate(sets)]


@pytest.mark.parametrize("family", [ngram_join.FAMILY, 30])
def test_ngram_join_of_crowds(spark, monkeypatch, family):
    """Copies with one word changed, unlike texts that share a passage or most of their words, a very long text."""
    r = random.Random(9)
    new = lambda n: [f"w{r.randrange(10**9)}" for _ in range(n)]
    texts = []
    for size, copies in ((60, 80), (200, 40), (12, 30)):
        base = new(size)
        for _ in range(copies):
            own = list(base)
            own[r.randrange(size)] = new(1)[0]
            texts.append(own)
    passage = new(40)
    texts += [new(k := r.randrange(1, 60)) + passage + new(3 + k // 9) for _ in range(300)]
    texts += [passage[: r.randrange(5, 40)] for _ in range(40)]
    long = new(60_000)
    texts += [long, long[:50_000] + new(9_000), long[:30_000], long]
    texts = [" ".join(t) for t in texts]
    monkeypatch.setattr(ngram_join, "FAMILY", family)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_join.near_duplicates(docs).collect()}
    want = _linked(texts)
    assert got == dict(enumerate(want)) and len(set(c for _, c in want)) < len(texts) - 100


@pytest.mark.parametrize("few", [1, 3, 1000])
def test_blocks_lose_no_pair(monkeypatch, few):
    """What a whole block yields, pairs or the sweep's connections, connects all open pairs; counts are exact."""
    import numpy as np

    monkeypatch.setattr(ngram_join, "FEW", few)
    g = np.random.default_rng(few)
    for _ in range(40):
        k = int(g.integers(2, 40))
        n = np.sort(g.integers(4, 60, k))
        pos = (g.random(k) * (n // 4 + 1)).astype(np.int64)
        tok, node = np.sort(g.integers(0, 4, k)), g.permutation(k) + 100
        order = np.lexsort((node, n, tok))
        tok, n, pos, node = tok[order], n[order], pos[order], node[order]
        up = {int(x): int(x) for x in node}

        def find(x):
            while up[x] != x:
                x = up[x]
            return x

        named, large = Counter(), Counter()
        for batch in ngram_join.settled_blocks(tok, n, pos, node, np.zeros(k, bool)):
            for x in batch.to_pylist():
                if x["kind"] == ngram_join.PAIR:
                    named[x["node"], x["other"]] += x["shared"]
                if x["kind"] == ngram_join.LARGE:
                    large[x["node"]] += x["shared"]
                elif x["kind"] == ngram_join.OPEN or x["tok"]:
                    up[find(x["node"])] = find(x["other"])
        for i in range(k):
            for j in range(k):
                if tok[i] == tok[j] and node[i] < node[j] and min(n[i] - pos[i], n[j] - pos[j]) * 7 >= 3 * (n[i] + n[j]):
                    a, b = int(node[i]), int(node[j])
                    assert find(a) == find(b) and (named[a, b] or min(large[a], large[b]))


def test_components_agree(spark):
    from gritstone.llm.common import components

    r = random.Random(3)
    e = spark.createDataFrame([(r.randrange(60), r.randrange(60)) for _ in range(45)], "a long, b long")
    assert sorted(components(e).collect()) == sorted(components(e, in_one_task=0).collect())


def test_probe_equals_brute_force():
    r = random.Random(2)
    base = sorted(r.sample(range(200), 40))
    sets = [tuple(sorted(set(base) - set(r.sample(base, r.randrange(12))) | set(r.sample(range(200), r.randrange(8))))) for _ in range(200)]
    want = [i for i, s in enumerate(sets) if 4 * len(set(base) & set(s)) >= 3 * len(set(base) | set(s))]
    assert sorted(ngram_join.probe(base, sorted((s, i) for i, s in enumerate(sets)))) == want and 0 < len(want) < 200


def test_lm(docs, none, rows):
    import math

    c = Counter(t for r in rows if r[0] is None or zlib.crc32(str(r[0]).encode()) % 7 != 2 for t in [*_words(r[1]), None])
    n, v = sum(c.values()), len(c)
    by = {}
    for x in lm.lm_scores(docs).collect():
        by.setdefault(x.doc_id, x)
    for r in rows:
        w, x = [*_words(r[1]), None], by[r[0]]
        assert (x.n_tokens, x.n_known, x.train_tokens) == (len(w), sum(c[t] > 0 for t in w), n)
        assert abs(x.base_score - sum(math.log10((c[t] + 1) / (n + v + 1)) for t in w)) < 1e-6 * (1 + abs(x.base_score))
    assert sum(x.score for x in by.values()) > sum(x.base_score for x in by.values())
    assert lm.lm_scores(none).count() == 0


def test_lm_scores_equal_brute_force(docs, rows, spark):
    """The score without codes: discounts by shard (the first bits of the left word's hash), all pairs kept."""
    import math

    import xxhash

    name = lambda w: xxhash.xxh3_64_intdigest(b" end " if w is None else w)
    seqs = [[None, *_words(r[1]), None] for r in rows if r[0] is None or zlib.crc32(str(r[0]).encode()) % 7 != 2]
    pairs = Counter(p for s in seqs for p in zip(s, s[1:]))
    left, count = Counter(), Counter()
    for (u, w), n in pairs.items():
        left[u] += n
        count[w] += n
    total = sum(count.values())
    shard = lambda u: name(u) >> 60
    ones = {k: Counter(shard(u) for (u, _), n in pairs.items() if n == k) for k in (1, 2)}
    discount = lambda k: min(0.95, max(0.1, ones[1][k] / max(ones[1][k] + 2 * ones[2][k], 1)))
    followers = Counter(u for u, _ in pairs)
    got = {x.doc_id: x.score for x in lm.lm_scores(docs).collect()}
    for r in rows:
        want, s = 0.0, [None, *_words(r[1]), None]
        for u, w in zip(s, s[1:]):
            d = discount(shard(u))
            back = followers[u] * d / left[u] if left[u] else 1.0
            seen = (pairs[u, w] - d) / left[u] if pairs[u, w] else 0.0
            want += math.log10(seen + back * (count[w] + 1) / (total + len(count) + 1))
        assert abs(got[r[0]] - want) <= 0.02 * abs(want) + 0.02, (r[0], got[r[0]], want)


def test_elias_fano():
    import numpy as np

    r = np.random.default_rng(0)
    for n, top in ((0, 10), (1, 1 << 60), (1000, 1500), (5000, 1 << 63)):
        v = np.sort(r.integers(0, top, n, dtype=np.uint64))
        ef = lm.EliasFano(np.frombuffer(lm.EliasFano.pack(v, top), np.uint8), 0)
        assert (ef.get(np.arange(n)) == v).all()


def test_private(docs, none, rows, spark):
    kinds = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]

    def luhn(g):
        return sum(sum(divmod(int(c) * (2 if i % 2 else 1), 10)) for i, c in enumerate(reversed(g))) % 10 == 0

    def spans(t):
        out = []
        for k, (kind, p) in enumerate(kinds):
            for m in re.finditer(p, t or ""):
                g = re.sub("[^0-9]", "", m[0])
                if {"email": True, "ip": kind == "ip" and all(int(x) < 256 for x in m[0].split(".")), "card": 12 <= len(g) <= 19 and luhn(g), "phone": 9 <= len(g) <= 15}[kind]:
                    out.append((m.start(), k, m.end()))
        return sorted(out)

    odd = ["a@b.c_d@e.f g@h", "999.1.1.1 1.2.3.4.5 0001.2.3.4", "+1+1 555 123 4567-", "x" * 5000, "1" * 3000, "a.b-c@x.y.z.", "😀 a@b.co 4111-1111-1111-1111"]
    odd += [f"plain text {i} without values" for i in range(60)]  # 4 bits take more texts without the address
    extra = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(odd)], "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(extra)
    texts = {**{r[0]: r[1] for r in rows}, **{1000 + i: t for i, t in enumerate(odd)}}
    got = private.find_private(both).collect()
    for x in got:
        s = spans(texts[x.doc_id])
        assert x.base_sha256 == hashlib.sha256(",".join(f"{kinds[k][0]}:{a}:{b}" for a, k, b in s).encode()).hexdigest(), texts[x.doc_id]
        assert set(f"{kinds[k][0]}:{a}:{b}" for a, k, b in s) <= set(x.spans.split(","))
    assert sum(x.n_term for x in got) >= 3  # Xanthippe gives the address away
    assert private.find_private(none).count() == 0


def test_private_terms(spark):
    """Terms of values and of a kind, at the edges of a text, far from the value, and in texts without it; a word that
    stands once says nothing, for all words that stand once beside a value do as much by chance."""
    r = random.Random(4)
    common = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(40)]
    fill = lambda n: " ".join(r.choice(common) for _ in range(n))
    texts = [fill(200) for _ in range(60)]
    texts += [fill(50) for _ in range(140)]
    texts = [t + " " + "".join(r.choice("klmnopqrst") for _ in range(9)) for t in texts]  # words that stand once, beside no value
    texts += [f"Xanthippe once {fill(60)} to one@corp.org {fill(60)} near Zebulon"]
    texts += [f"{fill(60)} quorl {fill(60)} +1 415 555 {i:04d}" for i in range(8)] + [f"{fill(20)} Quorl alone"] * 2  # the kind, from values that stand once
    texts += [f"{fill(30)} mira two@corp.org {i} mira" for i in range(3)] + [f"{fill(30)} Mira again"]
    texts += [f"Yorick {fill(60)} three@corp.org {fill(60)} Ophelia" for _ in range(4)]  # far beyond 40 characters, at both edges
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x for x in private.find_private(docs).collect()}
    marked = {i: [texts[i][int(a) : int(b)].lower() for k, a, b in (s.split(":") for s in x.spans.split(",") if s) if k == "term"] for i, x in got.items()}
    assert len(got) == len(texts) and all(len(marked[i]) == x.n_term for i, x in got.items())
    assert not any(marked[i] for i in range(200))
    assert not marked[200] and all({"yorick", "ophelia"} <= set(marked[i]) and not set(marked[i]) & set(common) for i in range(215, 219))
    assert all("quorl" in marked[i] for i in range(201, 211))
    assert all(marked[i].count("mira") == 2 for i in (211, 212, 213)) and "mira" in marked[214]


def test_private_precision_and_recall(spark):
    """Planted names beside their values among rare random words: what is marked are names, and they all are."""
    r = random.Random(11)
    rare = lambda: "".join(r.choice("ijklmnopqrst") for _ in range(8))
    pool = [rare() for _ in range(4000)]  # words that stand about twice
    texts = [" ".join([*r.choices(pool, k=6), *(rare() for _ in range(6)), *r.choices(["of", "the", "and", "with"], k=20)]) for _ in range(1400)]
    names = {f"Name{a}{b}": f"u{a}{b}@corp.org" for a in "abcde" for b in "fgh"}
    for i in range(140):  # values beside chance words alone
        texts[i] += f" 10.0.{i}.1" if i % 2 else f" v{i}@other.org"
    at = 200
    for name, value in names.items():
        for _ in range(4):
            texts[at] = f"{name} {texts[at]} {value}"
            at += 1
    got = private.find_private(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    marked = Counter(texts[x.doc_id][int(a) : int(b)] for x in got for k, a, b in (s.split(":") for s in x.spans.split(",") if s) if k == "term")
    assert all(marked[n] == 4 for n in names)
    assert sum(marked[n] for n in names) / sum(marked.values()) >= 0.95


def test_sanitised(spark):
    t = "mail a@b.co and 10.0.0.1 from Quorl, a@b.co"
    rows = spark.createDataFrame([(t, "email:5:11,ip:16:24,term:30:35,email:37:43"), (t, ""), ("", ""), (t, "email:0:11,ip:5:24")], "t string, s string")
    from pyspark.sql import functions as F

    assert [r[0] for r in rows.select(private.sanitised(F.col("t"), F.col("s"))).collect()] == ["mail <email> and <ip> from <term>, <email>", t, "", "<email> and 10.0.0.1 from Quorl, a@b.co"]


def test_language_sets():
    """Two halves give two languages in the set, with their shares; signs that are no letters give none."""
    import numpy as np

    vocab = {"aa": ["abra", "casta", "mala"], "bb": ["pilit", "dirik", "silim"], "cc": ["hugu", "drumu", "stumu"], "dd": ["ponto", "gorro", "solon"]}
    counts = np.stack([np.bincount(language_id.ngrams([" ".join(v) * 50])[0], minlength=language_id.BUCKETS) for v in vocab.values()], axis=1)
    table = np.log((counts + 0.5) / (counts.sum(axis=0) + 0.5 * language_id.BUCKETS)).astype(np.float32)
    four = " ".join(w for v in vocab.values() for w in v * 20)
    pred, score, sets = language_id.infer(["abra casta mala " * 20 + "pilit dirik " * 20, "hugu drumu", four, "\u00bd \u00b2 \u2460 12", ""], list(vocab), table)
    assert pred[:2] == ["aa", "cc"] and pred[3:] == ["und", "und"] and sets[3:] == [[], []]
    assert {x["lang"] for x in sets[0]} == {"aa", "bb"} and abs(sets[0][0]["share"] - 0.6) < 0.1 and len(sets[1]) == 1 and len(sets[2]) == 4
    assert all(0 <= s <= 1 for s in score)


def test_language_and_quality(docs, none, rows, spark):
    got = {r.doc_id: r for r in language_id.language_id(docs).collect()}
    assert all(got[r[0]].lang_pred == r[2] for r in rows[:36])
    assert all(got[i].lang_pred == "und" for i, r in enumerate(rows) if r[1] in (None, "", " \n\t ", "123 456"))
    assert language_id.language_id(none).count() == 0
    labels = spark.createDataFrame([(i, int(i < 36), 0) for i in range(48)] + [(50, None, 0)], "doc_id long, quality int, toxic int")
    q = quality.quality(docs, labels).collect()
    assert len(q) == len(rows) and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.3) for x in q)
    assert quality.quality(none, labels).count() == 0 and {x.score for x in quality.quality(docs, labels.limit(0)).collect()} == {0.5}


def test_exact_dedup(docs, none, rows):
    norm = lambda t: re.sub("[\x20\x09-\x0d]", "", t or "")
    groups = {}
    for r in rows:
        groups.setdefault(norm(r[1]), []).append(r)
    want = Counter()
    for k, g in groups.items():
        keep = min(g, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))[0]
        want.update((r[0], keep, len(g), r[0] == keep, hashlib.sha256(k.encode()).hexdigest()) for r in g)
    assert Counter(tuple(r) for r in exact_dedup.exact_dedup(docs).collect()) == want
    assert exact_dedup.exact_dedup(none).count() == 0


def test_cuckoo_index():
    index = exact_dedup.CuckooIndex(8)
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(3000)]
    for i, k in enumerate(keys):
        index.insert(k, (i,))
    for k in keys[::3]:
        index.delete(k)
    assert index.resizes > 0 and all(index.get(k) == (None if i % 3 == 0 else (i,)) for i, k in enumerate(keys))


def test_mixing(docs, none, rows):
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows) and all(0 < x.probability <= 1 for x in got)
    total = sum(x.tokens for x in got)
    by = Counter()
    for x in got:
        by[x.topic] += x.weight * x.tokens
    assert abs(sum(by.values()) / total - 1) < 1e-3
    assert mixing.mix(none).count() == 0


def test_bpe(docs, none, rows):
    ranks = byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for r in rows:
        ids = enc.encode_ordinary(r[1] or "")
        want[(r[0], len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest())] += 1
    args = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    assert Counter(tuple(r) for r in byte_bpe.digests(byte_bpe.bpe(docs, *args)).collect()) == want
    assert byte_bpe.bpe(none, *args).count() == 0


def test_order_minhash(docs, none, rows):
    once = {r[0]: r[1] or "" for r in rows}
    ids = sorted((i for i in once if i is not None), reverse=True)
    d = docs.dropDuplicates(["doc_id"]).where("doc_id is not null")
    got = {r.doc_id: r for r in order_minhash.order_minhash(d).collect()}
    for i, x in enumerate(ids):
        t, n = once[x], once[ids[(i + 1) % len(ids)]]
        c = len(t) // 3
        assert got[x].edited_sha256 == hashlib.sha256((t[: len(t) - c] + n[:c]).encode()).hexdigest() and got[x].n_chars == len(t)
    by = {}
    for x in ids:
        by.setdefault(once[x], set()).add(got[x].fingerprint)
    assert all(len(s) == 1 for s in by.values())
    assert order_minhash.order_minhash(docs).count() == len(rows) and order_minhash.order_minhash(none).count() == 0


def test_pipeline(spark, tmp_path, rows):
    spark.createDataFrame([r for r in rows[:-2]], SCHEMA).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r.doc_id for r in out}
    assert len(out) == len(ids) and not ids & {i for i, r in enumerate(rows) if r[1] in (None, "", " \n\t ", "123 456")}
    assert len(ids & {36, 37, 38, 39, 40}) <= 1


def test_pipeline_keeps_one_row_of_null_and_repeated_ids(spark, rows):
    own = [*rows, (7, rows[8][1], *rows[7][2:]), (None, rows[9][1] + " more", *rows[-1][2:])]  # an id with two texts
    docs = spark.createDataFrame(own, SCHEMA).select("doc_id", "text", "lang", "source", "n_chars").repartition(3)
    out = corpus_pipeline.language(spark, docs, "").cache()
    want = Counter((r[0], r[1]) for r in own if re.search(r"[^\W\d_]", r[1] or ""))
    assert Counter((r.doc_id, r.text) for r in out.collect()) == want
    out = corpus_pipeline.exact(spark, out, "").cache()
    got = [(r.doc_id, r.text) for r in out.collect()]
    norm = lambda t: re.sub("[\x20\x09-\x0d]", "", t)
    assert sorted(norm(t) for _, t in got) == sorted({norm(t) for _, t in want})
    assert (7, rows[8][1]) in got and (8, rows[8][1]) not in got and (7, rows[7][1]) in got and (None, "a null id") in got
    near = Counter(r.text for r in corpus_pipeline.near(spark, out, "").collect())
    assert max(near.values()) == 1 and near["a null id"] == 1 and sum(t in near for t in (rows[36][1], rows[37][1], rows[38][1])) == 1


DOCS = ("doc_id", "text", "lang", "source", "n_chars")


def test_pipeline_takes_no_column_for_its_key(spark, rows):
    """Columns called like the key are data; stages carry them."""
    own = [(r[0], r[1], r[2], r[3], r[4], 0, 7.5) for r in rows]
    docs = spark.createDataFrame(own, "doc_id long, text string, lang string, source string, n_chars long, _row int, _ROW_ double").repartition(3)
    plain = docs.drop("_row", "_ROW_")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs, plain = (stage(spark, d, "").cache() for d in (docs, plain))
        ids = Counter((r.doc_id, r.text) for r in docs.collect())
        assert ids == Counter((r.doc_id, r.text) for r in plain.collect()) and ids, name
        assert {(r._row, r._ROW_) for r in docs.collect()} == {(0, 7.5)}
    assert sorted(r.ids_sha256 for r in corpus_pipeline.encode(spark, docs, "").collect()) == sorted(r.ids_sha256 for r in corpus_pipeline.encode(spark, plain, "").collect())


def test_pipeline_rows_equal_brute_force(spark, tmp_path, rows):
    """All rows, the repeated, the null-id and a very long one included, through every stage by plain Python."""
    long = " ".join(f"w{i % 977}x{i}" for i in range(60_000))
    own = [*rows, (500, long, "en", "s1", 0, *rows[0][5:])]
    spark.createDataFrame(own, SCHEMA).select(*DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    docs = sorted((r[:5] for r in own if re.search(r"[^\W\d_]", r[1] or "")), key=lambda r: (r[0] is None, r[0] or 0))
    groups = {}
    for r in docs:  # exact: the longest, then the smallest id
        groups.setdefault(re.sub("[\x20\x09-\x0d]", "", r[1]), []).append(r)
    docs = [max(g, key=lambda r: (len(r[1]), -(10**9 if r[0] is None else r[0]))) for g in groups.values()]
    docs.sort(key=lambda r: (r[0] is None, r[0] or 0))
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := _words(r[1])) else set() for r in docs]
    up = list(range(len(docs)))
    find = lambda x: x if up[x] == x else find(up[x])
    for a in range(len(docs)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) > 0:
                x, y = sorted((find(a), find(b)))
                up[y] = x
    docs = [r for i, r in enumerate(docs) if find(i) == i]
    cells, topic = {}, lambda t: next((n for n, s in mixing.TOPIC_SIGNS if s in t), "prose")
    key = lambda r: (r[3] or "", r[2] or "", topic(r[1]))
    for r in docs:
        cells[key(r)] = cells.get(key(r), 0) + len(_words(r[1]))
    weight, goals = dict.fromkeys(cells, 1.0), []
    for d, p in enumerate(mixing.POWERS.values()):
        by = {}
        for c, n in cells.items():
            by[c[d]] = by.get(c[d], 0) + n
        norm = sum(n**p for n in by.values())
        goals.append({v: sum(by.values()) * n**p / norm for v, n in by.items()})
    for _ in range(mixing.SWEEPS):
        for d, goal in enumerate(goals):
            have = {v: sum(weight[c] * n for c, n in cells.items() if c[d] == v) for v in goal}
            weight = {c: w * goal[c[d]] / have[c[d]] for c, w in weight.items()}
    draw = lambda i: int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:8], 16) / 2**32
    docs = [r for r in docs if draw(r[0]) < weight[key(r)]]
    bpe = tiktoken.Encoding("b", pat_str=public_tokenizers.PATTERN, mergeable_ranks=tiktoken.load.load_tiktoken_bpe(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = Counter()
    for r in docs:
        ids = bpe.encode_ordinary(r[1])
        want[(r[0], len(ids), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest(), hashlib.sha256(r[1].encode()).hexdigest())] += 1
    assert got == want and sum(want.values()) > 15


def test_pipeline_without_rows(spark, tmp_path, none):
    none.select(*DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
