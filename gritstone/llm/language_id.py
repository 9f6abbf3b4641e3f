"""Language identification by multilingual mixture inference (operator 6).

Byte 4-grams of lower-cased letters, hashed into a table of fixed size, give each language a smoothed likelihood
learned from all training rows. A document is a mixture: each word is drawn from one of its languages, and
expectation-maximisation estimates the proportions. Language sets of growing size are compared by likelihood less
half the log of the word count per free proportion; the set that wins gives the prediction.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out

BUCKETS = 1 << 16
_LETTER = regex.compile(r"\p{L}")
#: Bytes that belong to words: ASCII letters and all of a multi-byte character; the rest are spaces.
_KEEP = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each 4-gram, index of its word, text of each word). A gram belongs to the word it starts in; the
    space before a word is its first character."""
    raws = [b" " + t.lower().encode().translate(_KEEP) + b"   " for t in texts]
    raw = np.frombuffer(b"".join(raws), np.uint8)
    if not len(raw):
        e = np.empty(0, np.int64)
        return e, e, e
    ends = np.cumsum(np.fromiter(map(len, raws), np.int64, len(raws)))
    letter = raw != 32
    begins = np.zeros(len(raw), bool)
    begins[:-1] = ~letter[:-1] & letter[1:]  # the space before a word
    word = np.cumsum(begins) - 1
    use = np.flatnonzero((begins | letter)[:-3])
    b = raw.astype(np.uint32)
    # What follows a word's end counts as one space, so grams do not see the next word.
    b1 = b[1:-2]
    b2 = np.where(letter[1:-2], b[2:-1], 32)
    b3 = np.where(letter[1:-2] & letter[2:-1], b[3:], 32)
    with np.errstate(over="ignore"):
        key = (b[:-3] | b1 << np.uint32(8) | b2 << np.uint32(16) | b3 << np.uint32(24)) * np.uint32(0x9E3779B1)
    grams = (key >> np.uint32(16)).astype(np.int64)[use]
    return grams, word[use], np.searchsorted(ends, np.flatnonzero(begins), side="right")


_SET = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
_COUNTS = "lang string, bucket int, n long"


def _count(batches):
    seen: dict[str, np.ndarray] = {}
    for batch in batches:
        texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        by: dict[str, list[str]] = {}
        for t, lang in zip(texts, langs):
            by.setdefault(lang, []).append(t or "")
        for lang, own in by.items():
            for lo, hi in _slices(own):
                seen[lang] = seen.get(lang, 0) + np.bincount(ngrams(own[lo:hi])[0], minlength=BUCKETS)
    for lang, counts in seen.items():
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(counts[at].astype(np.int64))], names=["lang", "bucket", "n"])


def _slices(texts: list[str], chars: int = 2_000_000):
    lo = total = 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= chars:
            yield lo, i + 1
            lo, total = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def learn(rows: DataFrame, text: str, lang: str) -> tuple[list[str], np.ndarray]:
    """Languages and their log-likelihood table (buckets x languages), from all rows with a language. What comes to
    the driver is at most 65,536 counts a language."""
    counts = rows.where(F.col(lang).isNotNull()).select(F.col(text), F.col(lang)).mapInArrow(_count, _COUNTS)
    table = counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(table["lang"].unique())
    c = np.zeros((BUCKETS, len(langs)))
    c[table["bucket"].to_numpy(), [langs.index(x) for x in table["lang"]]] = table["n"].to_numpy()
    return langs, np.log((c + 0.5) / (c.sum(axis=0) + 0.5 * BUCKETS)).astype(np.float32)


def _em(like: np.ndarray, starts: np.ndarray, size: np.ndarray, allowed: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions (texts x languages) and log-likelihood of each text; like: words x languages, largest 1."""
    share = allowed / allowed.sum(axis=1, keepdims=True)
    for _ in range(rounds):
        r = like * np.repeat(share, size, axis=0)
        r /= np.maximum(r.sum(axis=1, keepdims=True), 1e-30)
        share = np.add.reduceat(r, starts, axis=0) / size[:, None]
        share = np.where(allowed > 0, share, 0).astype(np.float32)
        share /= np.maximum(share.sum(axis=1, keepdims=True), 1e-30)
    mix = np.maximum((like * np.repeat(share, size, axis=0)).sum(axis=1), 1e-30)
    return share, np.add.reduceat(np.log(mix), starts)


def infer(texts: list[str], langs: list[str], table: np.ndarray, rounds: int = 6) -> tuple[list, list, list]:
    """Of each text: the prediction, its share in the unrestricted mixture, and the chosen set as (language, share)
    by falling share. A text's set grows by one language, in order of the unrestricted shares, as long as its own
    penalised likelihood grows, whatever texts stand beside it."""
    pred, score, sets = ["und"] * len(texts), [0.0] * len(texts), [[] for _ in texts]
    has = [i for i, t in enumerate(texts) if _LETTER.search(t)]
    if not has or not langs:
        return pred, score, sets
    grams, word, text = ngrams([texts[i] for i in has])
    starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    like = np.add.reduceat(table[grams], starts, axis=0)
    like = np.exp(np.maximum(like - like.max(axis=1, keepdims=True), -20))
    at = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
    size = np.diff(np.r_[at, len(text)])
    full, _ = _em(like, at, size, np.ones((len(at), len(langs)), np.float32), rounds)
    place = np.argsort(np.argsort(-full, axis=1, kind="stable"), axis=1, kind="stable")
    chosen, best = _em(like, at, size, (place < 1).astype(np.float32), 0)
    better = np.ones(len(at), bool)
    for k in range(2, len(langs) + 1):
        share, fit = _em(like, at, size, (place < k).astype(np.float32), rounds)
        fit = fit - 0.5 * (k - 1) * np.log(size + 1.0)
        better &= fit > best
        if not better.any():
            break
        best, chosen = np.where(better, fit, best), np.where(better[:, None], share, chosen)
    top = np.argmax(chosen, axis=1)
    for j, i in enumerate(text[at]):
        pred[has[i]] = langs[top[j]]
        score[has[i]] = float(min(1.0, max(0.0, full[j, top[j]])))
        order = np.argsort(-chosen[j], kind="stable")
        sets[has[i]] = [{"lang": langs[x], "share": float(chosen[j, x])} for x in order if chosen[j, x] > 0]
    return pred, score, sets


def language_id(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", key: str | None = None) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score (share of the predicted language's words in the mixture
    of all languages) and languages, the chosen set with its shares.

    Learned from the text and non-null lang of rows whose crc32(doc_id) mod 3 is not 1. A null text, or one without
    a letter, is ``und`` with score 0 and no languages; so is everything if there is nothing to learn from. Very long
    texts are read whole, repeated rows repeat, no rows give no rows, other columns are not read. ``key``, a long that
    names rows, is carried."""
    own = [F.col(key).cast("long").alias(key)] if key else []
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"), held_out(doc_id, 3, 1).alias("held_out"), *own)
    langs, table = learn(rows.where(~F.col("held_out")), "text", "lang")
    shared = docs.sparkSession.sparkContext.broadcast((langs, table))

    names = [key] if key else []

    def run(batches):
        langs, table = shared.value
        for batch in batches:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            pred, score, sets = [], [], []
            for lo, hi in _slices(texts, 1_000_000):
                p, s, own = infer(texts[lo:hi], langs, table)
                pred += p
                score += s
                sets += own
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(sets, _SET), *batch.columns[3:]], names=["doc_id", "held_out", "lang_pred", "score", "languages", *names])

    return rows.select("doc_id", "held_out", "text", *names).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, languages array<struct<lang:string,share:double>>" + "".join(f", `{k}` long" for k in names))
