"""Byte-level BPE encoding and decoding by recursive DuckDB queries inside Spark partitions.

Every batch's distinct pattern matches become token-position rows; a recursive query joins adjacent
tokens with the merge table and contracts pairs until none is left. Short words lose their leftmost pair
of least rank a step; longer ones every pair that no other merge can overtake, which gives the same tokens
in a number of steps that hardly grows with the word.
Decoding joins ids with the vocabulary and aggregates the bytes in position order.

Null text counts as empty (no ids; the digests of no bytes). Lone surrogates cannot occur in Spark
strings. Repeated rows give repeated results; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from collections.abc import Iterator

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .words import segments

BATCH = 4_000_000
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

#: For words up to SHORT bytes: one contraction a step. A row's key is its word and place in one number, and
#: so is a word's least pair (token made, place, place of the second token), so every step joins plain numbers.
SHORT = 63
ENCODE_SHORT = """
with recursive t(k, tok, step) as (
    select w << 6 | pos, tok::bigint, 0 from byte_rows
    union all
    (with near as (
        select k, tok, lead(tok) over win as next_tok, lead(k) over win as next_k from t window win as (order by k)),
    best as (
        select k >> 6 as w, min((m.made << 12) | ((k & 63) << 6) | (next_k & 63)) as least_pair
        from near join pairs m on ((tok << 20) | next_tok) = m.ab where next_k >> 6 = k >> 6 group by k >> 6)
    select k, case when (k & 63) = ((least_pair >> 6) & 63) then least_pair >> 12 else tok end, step + 1
    from t join best on k >> 6 = w where (k & 63) <> (least_pair & 63))
)
select t.k, t.tok
from t join (select k >> 6 as w, max(step) as step from t group by k >> 6) l on t.k >> 6 = l.w and t.step = l.step
"""
#: For longer words: every place that nothing can overtake, in one step. `ending` and `beginning` are the least
#: ranks of a token that ends, or begins, with the bytes of two adjacent tokens. A pair of rank `made` is contracted if no
#: token of lesser rank can take its left or right part first, and none can take what it makes; of a run of one
#: token, every second place from such a one on. Two adjacent tokens whose bytes no token holds are never joined, so there
#: the word falls into parts; a part's leftmost least pair is always contracted, and a part without a pair is done.
#: The rows of a run are bounded by its steps; what is not finished then starts the next run.
ROWS = 3_000_000
ENCODE = """
with recursive t(part, g, tok, step, done) as (
    select part, g, tok::bigint, 0, false from byte_rows
    union all
    (with near as (
        select part, g, tok, step, lag(tok) over win as prev, lead(tok) over win as nxt, lead(tok, 2) over win as nxt2
        from t where not done window win as (partition by part order by g)),
    pair as (
        select near.* exclude (part), ab, made, ending, beginning, prev is not distinct from tok and nxt is not distinct from tok as repeats
        from near left join links on ((tok << 20) | nxt) = ab),
    cut as (
        select *, row_number() over win as k, lag(ending) over win as before, lead(beginning) over win as after,
            max(case when repeats then null else g end) over (win rows unbounded preceding) as start_g,
            coalesce(sum(case when ab is null then 1 else 0 end) over (win rows between unbounded preceding and 1 preceding), 0)::bigint as part
        from pair window win as (order by g)),
    around as (
        select *, min(made) over (partition by part) as least, max(case when repeats then null else k end) over (order by g rows unbounded preceding) as start
        from cut),
    cand as (
        select part, g, k, start, start_g, repeats, made = least as is_least,
            coalesce(after >= made, true) and (case when repeats then (k - start) % 2 = 0 and ending >= made else coalesce(before > made, true) end) as is_sure,
            (prev << 20) | made as left_ab, (made << 20) | nxt2 as right_ab, made
        from around where made is not null),
    clear as (
        select c.g, c.start_g, c.repeats
        from cand c left join links l on c.left_ab = l.ab left join links r on c.right_ab = r.ab
        where c.is_sure and coalesce(l.ending > c.made, true) and coalesce(r.beginning > c.made, true)),
    heads as (select g from clear where not repeats union select min(g) from cand where is_least group by part),
    chosen as (select g from heads union select c.g from clear c join heads h on c.start_g = h.g where c.repeats),
    marked as (
        select a.part, a.g, a.tok, a.step, a.made, a.least, here.g is not null as first, coalesce(lag(here.g is not null) over (order by a.g), false) as second
        from around a left join chosen here on a.g = here.g)
    select part, g, case when first then made else tok end, step + 1, least is null from marked where not second and step < ?)
)
select g, part, tok, done from t where done or step = ?
"""


def merge_rows(ranks: dict[bytes, int]) -> pa.Table:
    """All pairs of tokens whose bytes make a token, as (ab, made): both tokens in one number."""
    rows = [(ranks[t[:i]] << 20 | ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
    ab, made = map(list, zip(*rows, strict=True)) if rows else ([], [])
    return pa.table({"ab": pa.array(ab, pa.int64()), "made": pa.array(made, pa.int64())})


def link_rows(ranks: dict[bytes, int]) -> pa.Table:
    """All pairs of tokens whose bytes some token holds, as (ab, made, ending, beginning): the rank of the
    token that they are, and the least ranks of tokens that end and begin with them (null: none)."""
    ends: dict[bytes, int] = {}
    begins: dict[bytes, int] = {}
    held: set[bytes] = set()
    for t, r in ranks.items():
        for i in range(len(t) - 1):
            ends[t[i:]] = min(r, ends.get(t[i:], r))
            begins[t[: len(t) - i]] = min(r, begins.get(t[: len(t) - i], r))
            held.update(t[i:j] for j in range(i + 2, len(t) + 1))
    rows = []
    for s in held:
        about = (ranks.get(s), ends.get(s), begins.get(s))
        rows += [(ranks[s[:i]] << 20 | ranks[s[i:]], *about) for i in range(1, len(s)) if s[:i] in ranks and s[i:] in ranks]
    columns = zip(*rows, strict=True) if rows else ([], [], [], [])
    return pa.table({c: pa.array(list(x), pa.int64()) for c, x in zip(("ab", "made", "ending", "beginning"), columns, strict=True)})


class Coder:
    """One DuckDB connection with the vocabulary and the merge table; one per Python worker."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = regex.compile(pattern)
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "1GB", "temp_directory": ""})  # nothing is spilled to a local folder
        self.con.register("m_in", merge_rows(self.ranks))
        self.con.execute("create table pairs as select * from m_in")
        self.linked = False  # the links are made when a long word is first met
        self.con.register("v_in", pa.table({"tok": pa.array(list(self.ranks.values()), pa.int32()), "bytes": pa.array([t.hex() for t in self.ranks], pa.string())}))
        self.con.execute("create table vocabulary as select * from v_in")
        self.first = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)

    def rows(self, words: list[bytes]) -> pa.Table:
        n = np.array([len(w) for w in words], np.int64)
        flat = np.frombuffer(b"".join(words), np.uint8)
        w = np.repeat(np.arange(len(words)), n)
        return pa.table({"w": w.astype(np.int32), "pos": (np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32), "tok": self.first[flat]})

    def encode(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word (one pattern match each), as little-endian unsigned 32-bit integers."""
        out = [b""] * len(words)
        for run, todo in ((self._short, [i for i, w in enumerate(words) if 0 < len(w) <= SHORT]), (self._long, [i for i, w in enumerate(words) if len(w) > SHORT])):
            lo = 0
            while lo < len(todo):
                hi, size = lo, 0
                while hi < len(todo) and (hi == lo or size + len(words[todo[hi]]) < 250_000):
                    size += len(words[todo[hi]])
                    hi += 1
                w, tok = run(self.rows([words[i] for i in todo[lo:hi]]))
                flat, cuts = tok.astype("<u4").tobytes(), (4 * np.searchsorted(w, np.arange(hi - lo + 1))).tolist()
                for i, start, stop in zip(todo[lo:hi], cuts, cuts[1:], strict=False):
                    out[i] = flat[start:stop]
                lo = hi
        return out

    def _short(self, rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        self.con.register("byte_rows", rows)
        got = self.con.execute(ENCODE_SHORT).fetchnumpy()
        order = np.argsort(got["k"], kind="stable")
        return np.asarray(got["k"])[order] >> 6, np.asarray(got["tok"])[order]

    def _long(self, rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        if not self.linked:
            self.con.register("l_in", link_rows(self.ranks))
            self.con.execute("create table links as select * from l_in")
            self.linked = True
        word, done = rows["w"].to_numpy(), []
        rows = pa.table({"part": rows["w"], "g": np.arange(len(word), dtype=np.int64), "tok": rows["tok"]})
        while len(rows):
            steps = max(1, ROWS // len(rows))
            self.con.register("byte_rows", rows)
            got = self.con.execute(ENCODE, [steps, steps]).fetchnumpy()
            g, part, tok, ready = (np.asarray(got[c]) for c in ("g", "part", "tok", "done"))
            done.append((g[ready], tok[ready]))
            rows = pa.table({"part": part[~ready], "g": g[~ready], "tok": tok[~ready]})
        g, tok = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(g, kind="stable")
        return word[g[order]], tok[order]

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """The bytes of each list of ids, put together by an ordered aggregation."""
        flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
        word = np.repeat(np.arange(len(ids), dtype=np.int32), [len(x) // 4 for x in ids])
        self.con.register("id_rows", pa.table({"w": word, "pos": np.arange(len(flat), dtype=np.int32), "tok": flat}))
        got = dict(self.con.execute("select w, string_agg(bytes, '' order by pos) from id_rows join vocabulary using (tok) group by w").fetchall())
        return [bytes.fromhex(got.get(i, "")) for i in range(len(ids))]


class Known:
    """A growing table of strings with their ids and decoded bytes, in two generations: what was not
    asked for while the younger one filled up is forgotten. A place holds until the next call of age()."""

    def __init__(self, limit: int):
        self.limit, self.place, self.ids, self.decoded, self.old = limit, {}, [], [], ({}, [], [])

    def missing(self, strings: set[str]) -> list[str]:
        """Those of the strings that have no entry, after taking over those of the older generation."""
        places, ids, decoded = self.old
        absent = strings - self.place.keys()
        for s in absent & places.keys():
            at = places.pop(s)
            self.add(s, ids[at], decoded[at])
        return sorted(absent - self.place.keys())

    def add(self, s: str, ids: bytes, decoded: bytes) -> None:
        self.place[s] = len(self.ids)
        self.ids.append(ids)
        self.decoded.append(decoded)

    def age(self) -> None:
        if len(self.ids) > self.limit:
            self.old = self.place, self.ids, self.decoded
            self.place, self.ids, self.decoded = {}, [], []


class Worker:
    """Encodes and decodes texts in one Python worker, from the matches and segments that it knows."""

    def __init__(self, path: str, pattern: str, limit: int = 250_000):
        self.coder, self.matches = Coder(path, pattern), Known(limit)
        self.segments = {lead: Known(limit) for lead in ("", " ")}

    def learn(self, lead: str, strings: set[str]) -> None:
        """Make these segments known, given without their leading character."""
        known, matches = self.segments[lead], self.matches
        new = known.missing(strings)
        found = list(map(self.coder.pattern.findall, new if not lead else [lead + s for s in new]))
        fresh = matches.missing(set().union(*found))
        ids = self.coder.encode([m.encode() for m in fresh])
        for m, i, d in zip(fresh, ids, self.coder.decode(ids), strict=True):
            matches.add(m, i, d)
        for s, cut in zip(new, found, strict=True):
            at = [matches.place[m] for m in cut]
            known.add(s, b"".join([matches.ids[i] for i in at]), b"".join([matches.decoded[i] for i in at]))
        matches.age()

    def batch(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """(ids, decoded bytes) of each text."""
        cut = [segments(t) for t in texts]
        first, rest = [s.pop(0) for s in cut], cut
        self.learn("", set(first))
        self.learn(" ", set().union(*rest))
        heads, tails, out = self.segments[""], self.segments[" "], []
        for head, tail in zip(first, rest, strict=True):
            h, t = heads.place[head], [*map(tails.place.__getitem__, tail)]
            out.append((heads.ids[h] + b"".join(map(tails.ids.__getitem__, t)), heads.decoded[h] + b"".join(map(tails.decoded.__getitem__, t))))
        heads.age()
        tails.age()
        return out


_workers: dict[tuple[str, str], Worker] = {}


def _worker(path: str, pattern: str) -> Worker:
    if (path, pattern) not in _workers:
        _workers[path, pattern] = Worker(path, pattern)
    return _workers[path, pattern]


def encode_texts(texts: list[str | None], path: str, pattern: str) -> list[tuple[bytes, bytes]]:
    """(ids as little-endian unsigned 32-bit integers, decoded bytes) of each text."""
    worker = _worker(path, pattern)
    gc.disable()  # a batch makes millions of strings and no cycles: collections would only walk over them
    try:
        return worker.batch([t if isinstance(t, str) else "" for t in texts])
    finally:
        gc.enable()


def encode_decode(docs: DataFrame, vocabulary_path: str, pattern: str) -> DataFrame:
    """Digests of every text's ids and of the bytes those ids decode to."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            # whole texts, about BATCH characters at a time
            place = (pdf["text"].str.len().fillna(0).cumsum() // BATCH).to_numpy()
            for _, part in pdf.groupby(place):
                got = encode_texts(part["text"].tolist(), vocabulary_path, pattern)
                yield pd.DataFrame({
                    "doc_id": part["doc_id"].astype("Int64").tolist(), "n_tokens": [len(i) // 4 for i, _ in got],
                    "ids_sha256": [hashlib.sha256(i).hexdigest() for i, _ in got], "decoded_sha256": [hashlib.sha256(d).hexdigest() for _, d in got],
                }).astype({"doc_id": "Int64"})

    return docs.select("doc_id", "text").mapInPandas(run, SCHEMA)
