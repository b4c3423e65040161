"""Byte-level BPE, encoded and decoded by recursive DuckDB queries in each partition.

A rank file gives every token's bytes; two neighbouring tokens merge when their bytes together are a token, lowest rank
first, leftmost first among equals.  Texts are cut by the split pattern; each distinct piece that is no token itself
becomes rows (piece, position, token).  The recursive query joins neighbours with the merge table and contracts every
piece's leftmost pair of minimum rank until none is left.  Pieces repeat, so a task remembers a bounded number of them, and
the ids of whole texts are put together from them.  Decoding starts from these ids alone: it joins them with their bytes and
aggregates in order.

The recursive query keeps every step of a piece, so its rows grow with the square of the piece's length.  Pieces of more
than ``LONG`` bytes (runs without a break; one of so many takes the recursion 1.6 s, one of 40,000 would take minutes and
gigabytes) are contracted in the same order with a heap instead.

Null and empty texts have no tokens and decode to no bytes.  Repeated rows are encoded each.  No special tokens exist.
Other columns than id and text are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
import sys
import types
from collections.abc import Callable, Iterator
from itertools import islice

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidlens.llm.tables import released

LONG = 4000  # bytes of a piece up to which it goes to the recursive query; at most 4,096
CHUNK = 200_000  # bytes of pieces in one query
SLICE = 1 << 20  # characters of text handled at once
REMEMBERED = 400_000  # pieces that a worker remembers, over its tasks; never changes a result

# Positions take 12 bits, so a pair's rank and both positions are one number, whose minimum is the leftmost lowest pair.
# A row's rank is that of the pair it opens with the row after it (null: no token).  A step renames the left half of each
# piece's lowest pair to the merged token, drops its right half and looks up the two pairs that are new.  A piece without
# ranks is at its fixpoint and takes part in no further step.
FIXPOINT = """
WITH RECURSIVE opened AS (
  SELECT piece, pos, token, lead(pos) OVER w AS next_pos, lead(token) OVER w AS follows FROM start WINDOW w AS (PARTITION BY piece ORDER BY pos)
), state AS (
  SELECT 0 AS step, o.piece, o.pos, o.token, o.next_pos, o.follows, m.merged AS rank
  FROM opened o LEFT JOIN merges m ON m.l = o.token AND m.r = o.follows
  UNION ALL (
    WITH best AS (
      SELECT piece, min((CAST(rank AS BIGINT) << 24) + (pos << 12) + next_pos) AS b FROM state WHERE rank IS NOT NULL GROUP BY piece
    ), merging AS (
      SELECT b.piece, CAST(b.b >> 24 AS INT) AS merged, CAST((b.b >> 12) & 4095 AS INT) AS spot, s.pos AS gone, s.next_pos AS then_pos, s.follows AS then_token
      FROM best b JOIN state s ON s.piece = b.piece AND s.pos = CAST(b.b & 4095 AS INT)
    ), changed AS (
      SELECT s.step + 1 AS step, s.piece, s.pos, CASE WHEN s.pos = spot THEN merged ELSE s.token END AS token,
        CASE WHEN s.pos = spot THEN then_pos ELSE s.next_pos END AS next_pos,
        CASE WHEN s.pos = spot THEN then_token WHEN s.next_pos = spot THEN merged ELSE s.follows END AS follows,
        s.pos = spot OR s.next_pos IS NOT DISTINCT FROM spot AS fresh, s.rank
      FROM state s JOIN merging b ON s.piece = b.piece WHERE s.pos <> gone
    )
    SELECT c.step, c.piece, c.pos, c.token, c.next_pos, c.follows, CASE WHEN fresh THEN m.merged ELSE c.rank END AS rank
    FROM changed c LEFT JOIN merges m ON m.l = c.token AND m.r = c.follows
  )
), last AS (SELECT piece, max(step) AS step FROM state GROUP BY piece)
SELECT s.piece, list(s.token ORDER BY s.pos) AS tokens FROM state s JOIN last USING (piece, step) GROUP BY s.piece ORDER BY s.piece
"""
DECODE = """
SELECT t.row, unhex(array_to_string(list(v.hex ORDER BY t.pos), '')) AS bytes FROM tokens t JOIN vocabulary v ON v.token = t.token GROUP BY t.row
"""


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank, from lines of a base64 token and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def merge_rows(ranks: dict[bytes, int]) -> dict[str, np.ndarray]:
    """(l, r, merged): every way to put a token together from two others."""
    rows = [(ranks[t[:k]], ranks[t[k:]], n) for t, n in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
    return dict(zip(("l", "r", "merged"), np.array(rows, dtype=np.int32).reshape(-1, 3).T))


def database(ranks: dict[bytes, int], merges: dict[str, np.ndarray]) -> duckdb.DuckDBPyConnection:
    """The task's own in-memory database with the merge table and the vocabulary."""
    db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
    db.register("given", pa.table({name: pa.array(column) for name, column in merges.items()}))
    db.execute("CREATE TABLE merges AS FROM given")
    db.register("given", pa.table({"token": pa.array(list(ranks.values()), pa.int32()), "hex": [t.hex() for t in ranks]}))
    db.execute("CREATE TABLE vocabulary AS FROM given")
    db.unregister("given")
    return db


def differing() -> str:
    """All characters that Python's own engine and ``regex`` class differently (letter, number, blank, other).

    They are compared one by one, because the two may know different versions of Unicode.
    """
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    classes = np.zeros((2, len(every)), np.int8)
    for n, (ours, exact) in enumerate(((r"[^\W\d_]+", r"\p{L}+"), (r"\d+", r"\p{N}+"), (r"\s+", r"\s+")), 1):
        for row, found in ((0, re.finditer(ours, every)), (1, regex.finditer(exact, every))):
            for m in found:
                classes[row, m.start():m.end()] = n
    return "".join(every[i] for i in np.flatnonzero(classes[0] != classes[1]))


def splitter(pattern: str, odd: str | None = None) -> Callable[[str], list[str]]:
    """All matches of the split pattern in a text.  ``odd``: what ``differing`` gives, where the caller has it.

    For the public pattern Python's own engine finds the same matches faster, unless a text holds a character that the two
    class differently.
    """
    exact = regex.compile(pattern)
    if pattern != public_tokenizers.PATTERN:
        return exact.findall
    quick = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
    odd_ones = frozenset(odd or differing())
    return lambda text: quick.findall(text) if odd_ones.isdisjoint(set(text)) else exact.findall(text)


def merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Tokens of one long piece: the same contractions, lowest pair from a heap."""
    parts = [piece[i:i + 1] for i in range(len(piece))]
    after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
    heap: list[tuple[int, int, bytes]] = []

    def offer(i: int) -> None:
        if i >= 0 and after[i] < len(parts) and (rank := ranks.get(both := parts[i] + parts[after[i]])) is not None:
            heapq.heappush(heap, (rank, i, both))

    for i in range(len(parts)):
        offer(i)
    while heap:
        _, i, both = heapq.heappop(heap)
        if not parts[i] or after[i] >= len(parts) or parts[i] + parts[after[i]] != both:
            continue
        gone = after[i]
        parts[i], parts[gone], after[i] = both, b"", after[gone]
        if after[i] < len(parts):
            before[after[i]] = i
        offer(before[i])
        offer(i)
    return [ranks[p] for p in parts if p]


def fixpoints(db: duckdb.DuckDBPyConnection, pieces: list[bytes], of_byte: np.ndarray) -> Iterator[bytes]:
    """Tokens of each piece as little-endian unsigned 32-bit integers."""
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    every = np.frombuffer(b"".join(pieces), np.uint8)
    start = {  # noqa: F841  read by the query
        "piece": np.repeat(np.arange(len(pieces), dtype=np.int32), sizes),
        "pos": (np.arange(len(every)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32), "token": of_byte[every],
    }
    db.register("start", pa.table(start))
    found = db.sql(FIXPOINT).to_arrow_table().combine_chunks()
    db.unregister("start")
    tokens = found.column("tokens").chunk(0)
    flat, ends = tokens.flatten().to_numpy().astype("<u4").tobytes(), (tokens.offsets.to_numpy() * 4).tolist()
    return (flat[at:after] for at, after in zip(ends, ends[1:]))


def decoded(db: duckdb.DuckDBPyConnection, ids: list[bytes]) -> list[bytes]:
    """Bytes of each list of token ids: ids joined with their bytes, aggregated in order."""
    sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
    at = np.arange(sizes.sum(), dtype=np.int64) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    token = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
    db.register("tokens", pa.table({"row": np.repeat(np.arange(len(ids)), sizes), "pos": at, "token": token}))
    found = dict(db.execute(DECODE).fetchall())
    db.unregister("tokens")
    return [bytes(found.get(n, b"")) for n in range(len(ids))]


class Encoder:
    """Encodes texts in one worker: the split pattern, the merge table and the pieces remembered so far."""

    def __init__(self, ranks: dict[bytes, int], merges: dict[str, np.ndarray], pattern: str, odd: str):
        self.ranks, self.db, self.split = ranks, database(ranks, merges), splitter(pattern, odd)
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self.tokens: dict[str, bytes] = {}

    def learn(self, texts: list[list[str]]) -> None:
        if len(self.tokens) > REMEMBERED:  # the older half goes
            for piece in list(islice(self.tokens, len(self.tokens) // 2)):
                del self.tokens[piece]
        waiting: list[tuple[str, bytes]] = []
        for piece in set().union(*texts) - self.tokens.keys():
            raw = piece.encode()
            if raw in self.ranks:
                self.tokens[piece] = np.uint32(self.ranks[raw]).astype("<u4").tobytes()
            elif len(raw) > LONG:
                self.tokens[piece] = np.array(merge_long(raw, self.ranks), "<u4").tobytes()
            else:
                waiting.append((piece, raw))
        at = 0
        while at < len(waiting):
            size, n = 0, at
            while n < len(waiting) and size < CHUNK:
                size += len(waiting[n][1])
                n += 1
            part = waiting[at:n]
            self.tokens.update(zip((piece for piece, _ in part), fixpoints(self.db, [raw for _, raw in part], self.of_byte)))
            at = n

    def encode(self, texts: list[str]) -> list[bytes]:
        pieces = [self.split(text) for text in texts]
        self.learn(pieces)
        return [b"".join(map(self.tokens.__getitem__, p)) for p in pieces]


def encoder_of(key: str, ranks: dict[bytes, int], merges: dict[str, np.ndarray], pattern: str, odd: str) -> Encoder:
    """The worker's encoder for the rank file and pattern that ``key`` names: its tasks follow each other and share it.

    It hangs on a module of the process, because this function itself comes anew with every task.
    """
    held = sys.modules.setdefault("byte_bpe_encoder", types.ModuleType("byte_bpe_encoder"))
    if getattr(held, "key", None) != key:
        held.encoder, held.key = Encoder(ranks, merges, pattern, odd), key
    return held.encoder


def _encoded(documents: DataFrame, rank_file: str | None, pattern: str | None, columns: str, result: Callable) -> DataFrame:
    """``result(ids, bytes)`` gives the Arrow columns after doc_id from the ids and decoded bytes of some texts."""
    ranks = read_ranks(rank_file or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    merges, cut, odd = merge_rows(ranks), pattern or public_tokenizers.PATTERN, differing()
    key = hashlib.sha256(repr((sorted(ranks.items()), cut)).encode()).hexdigest()
    rows = documents.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {columns}"
    names = ["doc_id", *(c.split()[0] for c in columns.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(key, ranks, merges, cut, odd)
        for batch in batches:
            doc_ids, texts, at = batch.column(0), batch.column(1), 0
            while at < batch.num_rows:
                part, size, first = [], 0, at
                while at < batch.num_rows and size < SLICE:
                    part.append(texts[at].as_py())
                    size += len(part[-1])
                    at += 1
                ids = encoder.encode(part)
                yield pa.RecordBatch.from_arrays([doc_ids.slice(first, at - first), *result(ids, decoded(encoder.db, ids))], names=names)
        released()

    return rows.mapInArrow(run, schema)


def encode(documents: DataFrame, rank_file: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, ids, decoded) of every row: ids as little-endian unsigned 32-bit integers, and the bytes they decode to."""
    return _encoded(documents, rank_file, pattern, "ids binary, decoded binary", lambda ids, back: [pa.array(ids, pa.binary()), pa.array(back, pa.binary())])


def digests(documents: DataFrame, rank_file: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row; ids and bytes stay in the task."""
    def result(ids: list[bytes], back: list[bytes]) -> list[pa.Array]:
        hexed = ([hashlib.sha256(v).hexdigest() for v in values] for values in (ids, back))
        return [pa.array([len(v) // 4 for v in ids], pa.int64()), *(pa.array(v, pa.string()) for v in hexed)]

    return _encoded(documents, rank_file, pattern, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", result)


def decode(encoded: DataFrame, rank_file: str | None = None) -> DataFrame:
    """(doc_id, decoded) from (doc_id, ids): tokens joined with their bytes, aggregated in order."""
    ranks = read_ranks(rank_file or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    rows = encoded.select("doc_id", F.coalesce("ids", F.lit(b"")).alias("ids"))
    schema = rows.select("doc_id", F.col("ids").alias("decoded")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        db = database(ranks, {name: np.zeros(0, np.int32) for name in ("l", "r", "merged")})
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(decoded(db, part.column(1).to_pylist()), pa.binary())], names=["doc_id", "decoded"])

    return rows.mapInArrow(run, schema)


def bpe_table(documents: DataFrame, rank_file: str | None = None) -> DataFrame:
    return digests(documents, rank_file)
