"""Cost-balanced packing of tokenised documents into fixed-length training sequences.

Each Spark task packs its own documents in windows of about a million tokens, so no token is
shuffled and memory does not depend on the table. A window's cost model is linear plus quadratic in
a piece's length (feed-forward and attention work): cost(n) = n + n*n / quadratic_at. Documents, and
what is left of those longer than a sequence, are assigned in descending length to the sequence of
least cost that still has room; a piece that no sequence has room for is cut over those with most
room left. A window opens just as many sequences as its tokens need, so at most one sequence's worth
of padding is left per window.

Null text counts as empty; an empty text is one piece holding only the end token; repeated rows and
doc_ids are packed as separate documents; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .words import Encoded, segments

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
SPECIAL = "<|endoftext|>"
_workers: dict[str, tuple] = {}


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for the 256 bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _worker(path: str) -> tuple:
    """(encoder of plain texts, of any text, its tables) for a vocabulary file, once per Python worker.

    The ids are those of the tokenizers library on this file. Distinct segments go through the
    tiktoken merger loaded with the file's own vocabulary, which is several times quicker on short
    strings; texts that contain the special token's string go through tokenizers itself.
    """
    if path not in _workers:
        import json

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        back = _byte_alphabet()
        ranks = {bytes(back[c] for c in token): i for token, i in vocabulary.items() if token != SPECIAL}
        quick = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        whole = cache(lambda: Tokenizer.from_file(path))  # few workers ever meet such a text, and it takes memory in each
        heads, tails = (Encoded(lambda s: array("I", quick.encode_ordinary(s)).tobytes(), lead) for lead in ("", " "))

        def plain(text: str) -> bytes:
            first, *rest = segments(text)
            return heads[first] + b"".join(map(tails.__getitem__, rest))

        _workers[path] = plain, lambda t: np.array(whole().encode(t, add_special_tokens=False).ids, "<u4").tobytes(), (heads, tails)
    return _workers[path]


def token_ids(texts: list[str | None], path: str, end_id: int = 0) -> list[np.ndarray]:
    """Each text's ids and the end id, as unsigned 32-bit arrays."""
    plain, whole, _ = _worker(path)
    tail = np.array([end_id], "<u4").tobytes()
    texts = [t if isinstance(t, str) else "" for t in texts]
    return [np.frombuffer((whole if SPECIAL in t else plain)(t) + tail, "<u4") for t in texts]


def assign(lengths: list[int], size: int, quadratic_at: float) -> list[tuple[int, int, int, int, int]]:
    """Pack documents of these lengths; pieces (document, start, length, sequence, offset)."""
    out, rest, sequence = [], [], 0
    for d, n in enumerate(lengths):
        for start in range(0, n - n % size, size):
            out.append((d, start, size, sequence, 0))
            sequence += 1
        if n % size:
            rest.append((d, n - n % size, n % size))
    bins = -(-sum(n for _, _, n in rest) // size)
    cost, room = np.zeros(bins), np.full(bins, size, np.int64)
    for d, start, n in sorted(rest, key=lambda p: (-p[2], p[0])):
        while n:
            fits = np.flatnonzero(room >= n)
            b = int(fits[np.argmin(cost[fits])]) if len(fits) else int(np.argmax(room))
            take = min(n, int(room[b]))
            out.append((d, start, take, sequence + b, size - int(room[b])))
            room[b] -= take
            cost[b] += take + take * take / quadratic_at
            start, n = start + take, n - take
    return out


def pack(docs: DataFrame, tokenizer_path: str, size: int = 1024, end_id: int = 0, quadratic_at: float = 4096.0, window_tokens: int = 1 << 20) -> DataFrame:
    """Pieces of all documents with their place in the packed sequences (see the module text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base = TaskContext.get().partitionId() << 32
        held_id, held, total = [], [], 0

        def flush() -> pd.DataFrame:
            nonlocal base, held_id, held, total
            got = assign([len(x) for x in held], size, quadratic_at)
            rows = [(held_id[d], s, n, zlib.crc32(held[d][s : s + n].tobytes()), len(held[d]), base + q, o) for d, s, n, q, o in got]
            base += max((q for *_, q, _ in got), default=-1) + 1
            held_id, held, total = [], [], 0
            frame = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            return frame

        for pdf in batches:
            for lo in range(0, len(pdf), 128):
                part = pdf.iloc[lo : lo + 128]
                for i, ids in zip(part["doc_id"].tolist(), token_ids(part["text"].tolist(), tokenizer_path, end_id), strict=True):
                    held_id.append(None if pd.isna(i) else int(i))
                    held.append(ids)
                    total += len(ids)
                    if total >= window_tokens:
                        yield flush()
        if held:
            yield flush()
        for table in _worker(tokenizer_path)[2]:  # a worker outlives its task: leave no segments behind
            table.clear()

    return docs.select("doc_id", "text").mapInPandas(run, SCHEMA)
