"""Chunkers. Greedy and sequential within a document, so they run by document in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_lines(text: str, size: int = 2000) -> list[str]:
    """C4: whole lines while they fit; a longer line stands alone."""
    out, now = [], ""
    for line in text.splitlines(keepends=True):
        if now and len(now) + len(line) > size:
            out.append(now)
            now = ""
        now += line
    return out + [now] if now else out


def greedy(parts: list[str], size: int, carry: Callable[[str], str], shown: Callable[[str], str] = lambda c: c) -> list[str]:
    """Parts go into a chunk while it stays within ``size``; the next begins with what ``carry`` keeps of it."""
    out, now = [], ""
    for part in parts:
        if len(now) + len(part) <= size:
            now += part
        else:
            out += [shown(now)] * bool(now)
            now = (carry(now) if now else "") + part
    return out + [shown(now)] * bool(now)


def by_sentences(text: str, size: int = 1000, overlap: int = 100) -> list[str]:
    """Sentences while they fit, the space after one not counted; a chunk of more than ``overlap`` words leaves its
    last ones to the next, a shorter one all of its text."""
    parts = [s + " " for s in re.split(r"(?<=[.!?])\s+", text)]
    out, now = [], ""
    for s in parts:
        if now and len(now) + len(s) - 1 > size:
            out.append(now.strip())
            words = now.split()
            now = (" ".join(words[-overlap:]) if len(words) > overlap else now) + " "
        now += s
    return [*out, now.strip()] if now else out


# Where RTL is cut, in the order in which the words are tried.
RTL_WORDS = ["module", "endmodule", "function", "endfunction", "task", "endtask"]


def by_rtl(text: str, size: int = 2000, overlap: int = 200) -> list[str]:
    """Cut before and after six words, wherever they stand and however they are written; a chunk leaves its last
    ``overlap`` characters to the next."""
    return greedy(re.split(f"({'|'.join(RTL_WORDS)})", text, flags=re.IGNORECASE), size, lambda c: c[-overlap:] if overlap else "")


def by_spec(text: str, size: int = 1500) -> list[str]:
    """Cut only at a heading, indented or not, once the chunk is longer than ``size``; the heading before stands
    again at the beginning of the next chunk."""
    out, now, head = [], "", ""
    for line in text.split("\n"):
        heading = line.strip().startswith("#")
        if heading and len(now) > size:
            out.append(now)
            now = head + "\n"
        now += line + "\n"
        head = line if heading else head
    return [*out, now] if now else out


def by_reference(text: str, size: int = 3000, overlap: int = 200, tail: int = 300) -> list[str]:
    """Cut after the last line end among the final characters; always moves on; blank chunks go."""
    out, at = [], 0
    while at < len(text):
        end = min(at + size, len(text))
        if end < len(text):
            cut = text.rfind("\n", end - tail, end)
            end = cut + 1 if cut > at else end
        if text[at:end].strip():
            out.append(text[at:end])
        if end >= len(text):
            break
        at = max(at + 1, end - overlap)
    return out


def pack(sizes: list[int], most: int) -> list[int]:
    """Greedy group number of each item."""
    group = used = 0
    out = []
    for n in sizes:
        if used and used + n > most:
            group, used = group + 1, 0
        used += n
        out.append(group)
    return out


#: Fixed value: characters of chunks that a task gathers before it hands them on.
HELD = 1 << 20


def chunks(docs: DataFrame, how: Callable[[str], list[str]], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, chunk index, chunk); a null text has none."""

    def made(out):
        ids, index, parts = map(list, zip(*out)) if out else ([], [], [])
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(index, pa.int64()), pa.array(parts, pa.string())], names=["doc_id", "chunk", "part"])

    def run(batches):
        for batch in batches:
            out, held = [], 0
            # One text at a time, and chunks leave as they come: a batch of long texts is never there as objects.
            for k, t in zip(batch.column(0), batch.column(1)):
                for i, c in enumerate(how(whole) if (whole := t.as_py()) else []):
                    out.append((k.as_py(), i, c))
                    held += len(c)
                if held > HELD:
                    yield made(out)
                    out, held = [], 0
            yield made(out)

    return docs.select(F.col(key).cast("long"), text).mapInArrow(run, "doc_id long, chunk long, part string")
