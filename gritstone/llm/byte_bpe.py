"""Byte-level BPE by corpus-level merge replay (operator 9).

The distinct pieces of a batch are laid out as one array of symbols. An inverted index maps each mergeable pair
(named by the rank of the joined bytes) to its positions; pairs are replayed in rank order, and a merge touches only
the neighbours at its position. Pieces are independent, so this equals encoding each piece alone.
"""

from __future__ import annotations

import base64
import re
from array import array
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F



def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Merges:
    """Rank of each pair of ids whose joined bytes are a token; byte pairs also as a table for whole arrays."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.rank: dict[int, int] = {}
        for token, r in ranks.items():
            for cut in range(1, len(token)):
                x, y = ranks.get(token[:cut]), ranks.get(token[cut:])
                if x is not None and y is not None:
                    self.rank[x << 32 | y] = r
        self.first = np.full(65536, -1, np.int64)
        for x in range(256):
            for y in range(256):
                self.first[x << 8 | y] = ranks.get(bytes([x, y]), -1)


def replay(pieces: list[bytes], merges: Merges) -> list[list[int]]:
    """Token ids of each piece. A token's id is its rank, so a merge of rank r leaves the symbol r."""
    raw = np.frombuffer(b"".join(pieces), np.uint8)
    total = len(raw)
    ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
    last = np.zeros(total, bool)
    last[ends[ends > 0] - 1] = True
    first = np.zeros(total, bool)
    first[1:] = last[:-1]
    first[:1] = True
    place = np.arange(total)
    nxt = np.where(last, -1, place + 1).tolist()
    prv = np.where(first, -1, place - 1).tolist()
    sym = merges.byte_id[raw].tolist()
    # The inverted index: rank -> positions, in order.
    pair = np.full(total, -1, np.int64)
    if total > 1:
        pair[:-1] = merges.first[raw[:-1].astype(np.int64) << 8 | raw[1:]]
    pair[last] = -1
    at = np.flatnonzero(pair >= 0)
    at = at[np.argsort(pair[at], kind="stable")]
    kinds, begin = np.unique(pair[at], return_index=True)
    index = {r: part.tolist() for r, part in zip(kinds.tolist(), np.split(at, begin[1:]))} if len(at) else {}
    order = list(index)
    heapify(order)
    rank_of = merges.rank.get
    while order:
        r = heappop(order)
        held = index.pop(r, None)
        if held is None:
            continue
        held.sort()
        for j, i in enumerate(held):
            n = nxt[i]
            if n < 0 or sym[i] < 0 or rank_of(sym[i] << 32 | sym[n]) != r:
                continue  # a neighbour has gone meanwhile
            sym[i] = r
            sym[n] = -1
            after = nxt[i] = nxt[n]
            low = r
            if after >= 0:
                prv[after] = i
                s = rank_of(r << 32 | sym[after])
                if s is not None:
                    if s in index:
                        index[s].append(i)
                    else:
                        index[s] = [i]
                        heappush(order, s)
                    if s < low:
                        low = s
            before = prv[i]
            if before >= 0:
                s = rank_of(sym[before] << 32 | r)
                if s is not None:
                    if s in index:
                        index[s].append(before)
                    else:
                        index[s] = [before]
                        heappush(order, s)
                    if s < low:
                        low = s
            if low < r and j + 1 < len(held):  # a lower rank has come up: it goes first
                rest = held[j + 1 :]
                if r in index:
                    index[r].extend(rest)
                else:
                    index[r] = rest
                    heappush(order, r)
                break
    out, begin = [], 0
    for end in ends.tolist():
        out.append([s for s in sym[begin:end] if s >= 0])
        begin = end
    return out


def latin_pattern(pattern: str) -> re.Pattern:
    r"""The same pattern for ``re`` on texts of Latin-1 alone, about twice as fast: \p{L}, \p{N} and \s become the
    characters that the ``regex`` library gives them."""
    of = {k: "".join(rf"\x{c:02x}" for c in range(256) if regex.match(k, chr(c))) for k in (r"\p{L}", r"\p{N}", r"\s")}
    spare = "".join(rf"\x{c:02x}" for c in range(256) if not regex.match(r"\s", chr(c)))
    pattern = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{of[r'\s']}{of[r'\p{L}']}{of[r'\p{N}']}]").replace(r"\S", f"[{spare}]")
    for k, chars in of.items():
        pattern = pattern.replace(k, f"[{chars}]")
    return re.compile(pattern)


class Encoder:
    """Encodes texts; pieces once replayed are remembered, up to ``limit`` of them."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, limit: int = 800_000):
        self.merges, self.limit = Merges(ranks), limit
        self.any_text, self.latin = regex.compile(pattern).findall, latin_pattern(pattern).findall
        self.known: dict[str, bytes] = {}
        self.bytes_of = {i: b for b, i in ranks.items()}

    def find(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.any_text(text)
        return self.latin(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        pieces = [self.find(t) for t in texts]
        new = list(set().union(*pieces).difference(self.known)) if pieces else []
        if len(self.known) + len(new) > self.limit:
            self.known.clear()
            new = list(set().union(*pieces))
        for piece, ids in zip(new, replay([p.encode() for p in new], self.merges)):
            a = array("I", ids)
            self.known[piece] = a.tobytes()
        return [b"".join(map(self.known.__getitem__, p)) for p in pieces]

    def decode(self, ids: bytes) -> bytes:
        a = array("I")
        a.frombytes(ids)
        return b"".join(map(self.bytes_of.__getitem__, a))


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(ranks: dict[bytes, int], pattern: str) -> Encoder:
    """One per Python worker and table, so that later tasks find the pieces of earlier ones."""
    key = (pattern, len(ranks), hash(frozenset(ranks.items())))
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(ranks, pattern)
    return _ENCODERS[key]


def _batched(texts: list[str], chars: int):
    """Runs of rows of about so many characters: bounds what one replay holds."""
    start = total = 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= chars:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def bpe(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", doc_id: str = "doc_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids (little-endian unsigned 32-bit integers), decoded (the bytes that
    the ids stand for), and the columns to ``carry``. No shuffle.

    Null texts count as empty (no tokens); repeated rows repeat; no rows give no rows. A text is encoded whole: one
    match of the pattern, however long, is one word of the replay and takes about 150 bytes a byte. Other columns are
    not read. The rank table is of fixed size (read once on the driver, then broadcast)."""
    shared = docs.sparkSession.sparkContext.broadcast(load_ranks(ranks_path))

    def run(batches):
        enc = encoder(shared.value, pattern)
        for batch in batches:
            ids, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            packed = [x for lo, hi in _batched(texts, 1_500_000) for x in enc.encode(texts[lo:hi])]
            n = pa.array([len(x) // 4 for x in packed], pa.int64())
            yield pa.RecordBatch.from_arrays([ids, n, pa.array(packed, pa.binary()), pa.array(map(enc.decode, packed), pa.binary()), *batch.columns[2:]], names=["doc_id", "n_tokens", "ids", "decoded", *carry])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), *carry)
    kinds = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded binary" + kinds)


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of what ``bpe`` gives."""
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
