"""Byte-level BPE as recursive queries: encoding by contraction of token rows, decoding by ordered aggregation.

A task splits its texts into words, the matches of the tokenizer's pattern, and keeps the distinct
words it has not met. Their tokens are rows (word, position, token) of a DuckDB database that lives in
the task's own process. A recursive query joins neighbouring rows with the merge table, in which any
two tokens whose bytes together are a token have that token's rank, and contracts in each round the
leftmost pair of smallest rank of every word, until no word has a pair. Ids of a text are those of
its words in order. Decoding joins (text, position, id) rows with the vocabulary and collects the
bytes in order of position.

One contraction a round makes the query quadratic in a word's length. Words longer than ``LONG``
bytes, such as runs of one letter, are contracted in the same order with a heap, in n log n.
"""

from __future__ import annotations

import base64
import heapq
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltacell.llm import words as W

#: Words of more bytes than this are contracted with a heap; positions in a query must stay below 256.
LONG = 200
#: Words of a text taken at a time; longer texts are encoded and decoded in several pieces.
PIECE = 500_000
#: Ids decoded by one query.
DECODED = 250_000
#: Bytes of texts that are encoded together, so that a query meets many new words at once.
RUN_BYTES = 4 << 20
#: Ids of distinct words kept by a worker before it starts anew.
KEPT_IDS = 4_000_000

#: A round finds each word's smallest ``merged`` (a rank and the new token at once), leftmost first, in
#: one ordered pass; only the new token and the one before it then have a new neighbour to look up.
CONTRACT = """
WITH RECURSIVE tokens AS MATERIALIZED (
  SELECT f.word, f.pos, f.token, f.next, 0 AS round, m.merged FROM fresh f
  LEFT JOIN merges m ON m.token = f.token AND m.next = f.next
  UNION ALL
  SELECT f.word, f.pos, f.token, f.next, f.round, m.merged FROM (
    SELECT word, pos, CASE WHEN pos = best % 256 THEN (best // 256)::INTEGER ELSE token END AS token, round + 1 AS round,
      CASE WHEN pos = best % 256 THEN second WHEN after = best % 256 THEN (best // 256)::INTEGER ELSE next END AS next
    FROM (
      SELECT *, lead(next) OVER w AS second, lead(pos) OVER w AS after, lag(pos) OVER w AS before,
        min(merged::BIGINT * 256 + pos) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS best
      FROM tokens WINDOW w AS (PARTITION BY word ORDER BY pos))
    WHERE best IS NOT NULL AND before IS DISTINCT FROM best % 256) f
  LEFT JOIN merges m ON m.token = f.token AND m.next = f.next
)
SELECT word, list(token ORDER BY pos) AS ids
FROM tokens JOIN (SELECT word, max(round) AS round FROM tokens GROUP BY word) USING (word, round) GROUP BY word
"""

DECODE = """
SELECT text, list(bytes ORDER BY pos) AS parts FROM coded JOIN vocabulary USING (token) GROUP BY text
"""


@dataclass(frozen=True)
class Ranks:
    """A vocabulary: a file of tokens in base64 with their ranks, which are their ids, and the word pattern."""

    path: str
    pattern: str


def public_ranks(name: str = "byte_bpe_50k") -> Ranks:
    import public_tokenizers as P

    return Ranks(P.path(f"{name}.tiktoken"), P.PATTERN)


def contract_long(tokens: list[int], merges: dict[tuple[int, int], int]) -> list[int]:
    """Contract the leftmost pair of smallest rank until none is left, by a heap over a linked list."""
    n = len(tokens)
    token, after, before = list(tokens), [*range(1, n), -1], [-1, *range(n - 1)]
    alive = [True] * n
    heap = [(m, i, tokens[i], tokens[i + 1]) for i in range(n - 1) if (m := merges.get((tokens[i], tokens[i + 1]))) is not None]
    heapq.heapify(heap)
    while heap:
        merged, i, left, right = heapq.heappop(heap)
        j = after[i] if alive[i] else -1
        if j < 0 or token[i] != left or token[j] != right:
            continue  # one of the two has changed since
        token[i], alive[j], after[i] = merged, False, after[j]
        if after[j] >= 0:
            before[after[j]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b >= 0 and (m := merges.get((token[a], token[b]))) is not None:
                heapq.heappush(heap, (m, a, token[a], token[b]))
    return [t for t, here in zip(token, alive, strict=True) if here]


class Coder:
    """Encoder and decoder of one worker process, with the distinct words it has met."""

    def __init__(self, ranks: Ranks):
        import duckdb
        import regex

        with open(ranks.path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = regex.compile(ranks.pattern)
        self.byte = np.full(256, -1, np.int32)
        for t, r in self.ranks.items():
            if len(t) == 1:
                self.byte[t[0]] = r
        if (self.byte < 0).any():
            raise ValueError("the vocabulary lacks single bytes")
        merges = [(self.ranks[t[:i]], self.ranks[t[i:]], r) for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        self.merges: dict[tuple[int, int], int] | None = None
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        rows = np.array(merges, np.int32).reshape(-1, 3)
        self.rows = rows
        self._load("merges", {"token": rows[:, 0], "next": rows[:, 1], "merged": rows[:, 2]})
        self._load("vocabulary", {"token": np.array(list(self.ranks.values()), np.int32), "bytes": pa.array(list(self.ranks), pa.binary())})
        self._forget()

    def _load(self, name: str, columns: dict) -> None:
        self.db.register("given", pa.table({k: pa.array(v) for k, v in columns.items()}))
        self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.pool = np.zeros(1 << 16, "<u4")
        self.ends = np.zeros(1 << 16, np.int64)
        self.used = 0

    def _keep(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        """Append the ids of distinct words; word n's lie in ``pool`` from ``ends[n]`` to ``ends[n + 1]``."""
        first, n = len(self.known), len(ids)
        while self.used + n > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while first + len(words) >= len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.pool[self.used:self.used + n] = ids
        self.ends[first + 1:first + 1 + len(words)] = self.used + np.cumsum(sizes)
        self.known.update(zip(words, range(first, first + len(words)), strict=True))
        self.used += n

    def _learn(self, fresh: list[str]) -> None:
        """Ids of words not met before: whole tokens at once, the rest by contraction."""
        rest, whole = [], []
        for w in fresh:
            raw = w.encode()
            if (r := self.ranks.get(raw)) is not None:
                whole.append((w, r))
            elif len(raw) > LONG:
                if self.merges is None:
                    self.merges = {(a, b): m for a, b, m in self.rows.tolist()}
                ids = contract_long(self.byte[np.frombuffer(raw, np.uint8)].tolist(), self.merges)
                self._keep([w], np.array(ids), np.array([len(ids)]))
            else:
                rest.append((w, raw))
        self._keep([w for w, _ in whole], np.array([r for _, r in whole], np.int64), np.ones(len(whole), np.int64))
        if not rest:
            return
        sizes = np.array([len(raw) for _, raw in rest])
        ends = np.cumsum(sizes)
        token = self.byte[np.frombuffer(b"".join(raw for _, raw in rest), np.uint8)]
        word = np.repeat(np.arange(len(rest), dtype=np.int32), sizes)
        pos = (np.arange(len(token)) - np.repeat(ends - sizes, sizes)).astype(np.int32)
        last = np.zeros(len(token), bool)
        last[ends - 1] = True
        follows = pa.array(np.concatenate([token[1:], token[:1]]), mask=last)
        self.db.register("fresh", pa.table({"word": word, "pos": pos, "token": token, "next": follows}))
        found = self.db.sql(CONTRACT).to_arrow_table()
        self.db.unregister("fresh")
        for chunk in found.to_batches():
            ids = chunk.column("ids")
            self._keep([rest[w][0] for w in chunk.column("word").to_pylist()], ids.flatten().to_numpy(), ids.value_lengths().to_numpy())

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words in order, and how many each word has."""
        if not words:
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        if self.used > KEPT_IDS:
            self._forget()
        coded = pa.array(words, pa.large_string()).dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        self._learn([w for w in distinct if w not in self.known])
        at = np.array([self.known[w] for w in distinct])[coded.indices.to_numpy()]
        starts, sizes = self.ends[at], self.ends[at + 1] - self.ends[at]
        ends = np.cumsum(sizes)
        return self.pool[np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1])], sizes

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of every text; texts of many words go in several pieces, short ones together."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        words: list[str] = []
        owners: list[tuple[int, int]] = []

        def flush():
            ids, sizes = self.encode_words(words)
            ends = np.concatenate([[0], np.cumsum(sizes)])
            at = 0
            for i, n in owners:
                out[i].append(ids[ends[at]:ends[at + n]])
                at += n
            words.clear()
            owners.clear()

        for i, t in enumerate(texts):
            if not t or len(t) <= PIECE:
                pieces = [self.pattern.findall(t)] if t else []
            else:
                found = self.pattern.finditer(t)
                pieces = iter(lambda: [m.group() for m in islice(found, PIECE)], [])  # noqa: B023 - used up below
            for piece in pieces:
                words += piece
                owners.append((i, len(piece)))
                if len(words) >= PIECE:
                    flush()
        flush()
        return [np.concatenate(x) if x else np.zeros(0, "<u4") for x in out]

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        """Bytes of every sequence of ids."""
        out: list[list[bytes]] = [[] for _ in ids]
        pieces = [(i, x[a:a + DECODED]) for i, x in enumerate(ids) for a in range(0, len(x), DECODED)]
        at = 0
        while at < len(pieces):
            end, held = at, 0
            while end < len(pieces) and (held == 0 or held + len(pieces[end][1]) <= DECODED):
                held += len(pieces[end][1])
                end += 1
            run = pieces[at:end]
            sizes = [len(x) for _, x in run]
            token = np.concatenate([x for _, x in run]).astype(np.int32)
            text = np.repeat(np.arange(len(run), dtype=np.int32), sizes)
            self.db.register("coded", pa.table({"text": text, "pos": np.arange(len(token), dtype=np.int32), "token": token}))
            found = self.db.sql(DECODE).to_arrow_table().combine_chunks()
            self.db.unregister("coded")
            parts = [b""] * len(run)
            counts = 0
            for chunk in found.to_batches():
                lists = chunk.column("parts")
                values, bounds = lists.values, lists.offsets.to_numpy()
                places = np.frombuffer(values.buffers()[1], np.int32, len(values) + 1, 4 * values.offset)
                data = memoryview(values.buffers()[2])
                for k, a, b in zip(chunk.column("text").to_pylist(), bounds[:-1], bounds[1:], strict=True):
                    parts[k] = bytes(data[places[a]:places[b]])
                    counts += b - a
            if counts != len(token):
                raise ValueError("an id is not in the vocabulary")
            for (i, _), p in zip(run, parts, strict=True):
                out[i].append(p)
            at = end
        return [b"".join(x) for x in out]


_CODERS: dict[Ranks, Coder] = {}


def coder(ranks: Ranks) -> Coder:
    """The worker's coder of a vocabulary."""
    if ranks not in _CODERS:
        _CODERS[ranks] = Coder(ranks)
    return _CODERS[ranks]


def _slim(docs: DataFrame, id_column: str, *columns: str) -> DataFrame:
    W.text_batches(docs)
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), *columns)


def encode(docs: DataFrame, ranks: Ranks | None = None, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``n_tokens`` and ``ids`` (little-endian unsigned 32-bit) of every row's whole text.

    Special tokens' strings are ordinary text. A null or empty text has no ids. Rows may repeat and
    doc_id may be null; every row gives one. Texts of any length are encoded whole, in pieces. An
    empty table gives no rows; other columns are not looked at.
    """
    ranks = ranks or public_ranks()

    def run(batches):
        for batch in W.slices(batches, RUN_BYTES):
            ids = coder(ranks).encode(batch.column(1).to_pylist())
            yield pa.record_batch(
                [batch.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())],
                names=["doc_id", "n_tokens", "ids"],
            )

    return _slim(docs, id_column, F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decode(coded: DataFrame, ranks: Ranks | None = None, id_column: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids`` and ``decoded`` (the bytes that the ids stand for) of every row.

    Null ids are none. An id outside the vocabulary raises.
    """
    ranks = ranks or public_ranks()

    def run(batches):
        for batch in W.slices(batches):
            given = [x or b"" for x in batch.column(1).to_pylist()]
            made = coder(ranks).decode([np.frombuffer(x, "<u4") for x in given])
            yield pa.record_batch(
                [batch.column(0), pa.array([len(x) // 4 for x in given], pa.int64()), pa.array(given, pa.binary()), pa.array(made, pa.binary())],
                names=["doc_id", "n_tokens", "ids", "decoded"],
            )

    slim = _slim(coded, id_column, F.col(ids).cast("binary").alias("ids"))
    return slim.mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded binary")


def digests(docs: DataFrame, ranks: Ranks | None = None) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of every document, encoded and decoded again."""
    both = decode(encode(docs, ranks), ranks)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
