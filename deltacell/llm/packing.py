"""Hierarchical packing of documents into token sequences of several lengths.

A document is cut into full windows of the longest size; what is left goes to the tier of the
smallest size that holds it. Tiers are packed from the longest down: a tier's own pieces open
windows, and the gap behind each is filled from shorter tiers, longest fitting piece first; where
none fits, one is cut to fill the gap exactly. So every window of a tier is full and only the last
tokens of a task remain, which close in windows of powers of two. Sequences of one tier form step
groups of equal token counts, dealt so that their attention cost (squares of piece lengths) is even.

Packing needs no shuffle: a task packs what it reads, holding ``pool`` tokens at a time. Rows of one
task depend on its input alone, so a task that is run again returns them again.
"""

from __future__ import annotations

import base64
import os
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltacell.llm import words as W

SCHEMA = (
    "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, tier int, step_group long, ids binary"
)


@dataclass(frozen=True)
class Vocabulary:
    """Where a byte-level BPE vocabulary lies: as ranks, which are fast to apply, and as the tokenizer it must agree with."""

    ranks: str
    reference: str
    pattern: str
    special: tuple[tuple[str, int], ...] = (("<|endoftext|>", 50256),)


def public_vocabulary(name: str = "byte_bpe_50k") -> Vocabulary:
    import public_tokenizers as P

    return Vocabulary(P.path(f"{name}.tiktoken"), P.path(f"{name}.json"), P.PATTERN)


class Encoder:
    """Ids of texts. The first text of every batch is also encoded by the reference; a difference raises."""

    def __init__(self, vocabulary: Vocabulary):
        import tiktoken

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(vocabulary.ranks, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._fast = tiktoken.Encoding("ranks", pat_str=vocabulary.pattern, mergeable_ranks=ranks, special_tokens=dict(vocabulary.special))
        self._reference = Tokenizer.from_file(vocabulary.reference)

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        out = [self._fast.encode_to_numpy(t, allowed_special="all").astype("<u4") if t else np.zeros(0, "<u4") for t in texts]
        if texts and self._reference.encode(texts[0], add_special_tokens=False).ids != out[0].tolist():
            raise ValueError("the ranks and the reference tokenizer give different ids")
        return out


class Piece:
    __slots__ = ("doc", "start", "ids", "total")

    def __init__(self, doc, start, ids, total):
        self.doc, self.start, self.ids, self.total = doc, start, ids, total

    def __len__(self):
        return len(self.ids)

    def split(self, n):
        return Piece(self.doc, self.start, self.ids[:n], self.total), Piece(self.doc, self.start + n, self.ids[n:], self.total)


class Pool:
    """Pieces by length, with the longest up to a limit and the shortest at hand."""

    def __init__(self, pieces):
        self.by: dict[int, list[Piece]] = {}
        self.held = 0
        for p in pieces:
            self.put(p)

    def put(self, p):
        self.by.setdefault(len(p), []).append(p)
        self.held |= 1 << len(p)

    def take(self, n):
        p = self.by[n].pop()
        if not self.by[n]:
            self.held &= ~(1 << n)
        return p

    def longest(self, most) -> int:
        return (self.held & ((1 << (most + 1)) - 1)).bit_length() - 1

    def shortest(self) -> int:
        return (self.held & -self.held).bit_length() - 1


def pack_pieces(pieces: list[Piece], sizes: tuple[int, ...], last: bool) -> tuple[list[list[Piece]], list[Piece]]:
    """Full sequences, and the pieces to go on with (none if ``last``)."""
    pool, done, open_windows = Pool(pieces), [], []
    for k, size in enumerate(sizes):
        least = sizes[k + 1] if k + 1 < len(sizes) else 0
        while (n := pool.longest(size)) > least:
            window, gap = [pool.take(n)], size - n
            while gap:
                n = pool.longest(min(gap, least) if least else gap)
                if n > 0:
                    window.append(pool.take(n))
                else:
                    n = pool.shortest()
                    if n < 0 or least and n > least:
                        break
                    head, tail = pool.take(n).split(gap)
                    window.append(head)
                    pool.put(tail)
                gap -= len(window[-1])
            (open_windows if gap else done).append(window)
    rest = [p for w in open_windows for p in w] + [p for ps in pool.by.values() for p in ps]
    if not last:
        while sum(map(len, rest)) >= sizes[0]:
            window, rest = _fill(rest, sizes[0])
            done.append(window)
        return done, rest
    left = sum(map(len, rest))
    while left:
        size = min(sizes[0], 1 << (left.bit_length() - 1))
        window, rest = _fill(rest, size)
        done.append(window)
        left -= size
    return done, []


def _fill(pieces: list[Piece], size: int) -> tuple[list[Piece], list[Piece]]:
    """The first ``size`` tokens of a row of pieces, and the rest."""
    window, at = [], 0
    for k, p in enumerate(pieces):
        if at + len(p) > size:
            head, tail = p.split(size - at)
            return window + ([head] if len(head) else []), [tail, *pieces[k + 1:]]
        window.append(p)
        at += len(p)
        if at == size:
            return window, pieces[k + 1:]
    return window, []


def step_groups(sequences: list[list[Piece]], step_tokens: int) -> list[int]:
    """Group of every sequence: one length a group, equal tokens as far as the number allows, even attention cost."""
    group, at = [0] * len(sequences), 0
    by: dict[int, list[int]] = {}
    for k, s in enumerate(sequences):
        by.setdefault(sum(map(len, s)), []).append(k)
    for size, members in sorted(by.items(), reverse=True):
        n = max(1, len(members) * size // step_tokens)
        members.sort(key=lambda k: -sum(len(p) ** 2 for p in sequences[k]))
        for i, k in enumerate(members):
            turn, place = divmod(i, n)
            group[k] = at + (place if turn % 2 == 0 else n - 1 - place)
        at += n
    return group


def pack(
    docs: DataFrame, vocabulary: Vocabulary | None = None, sizes: tuple[int, ...] = (1024, 512, 256, 128), end_id: int = 0,
    step_tokens: int = 16 * 1024, pool: int = 1 << 18,
) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, tier (tokens of the
    sequence), step_group, ids (little-endian unsigned 32-bit).

    ``docs`` needs doc_id and text; other columns are ignored. A document's ids are those of its
    whole text and ``end_id``; a null or empty text has ``end_id`` alone. Each id lies in exactly
    one piece. Repeated rows and null doc_ids are packed like others. An empty table gives an empty
    table. Ids of sequences and groups are unique, not gapless. ``sizes`` are powers of two, falling.
    """
    vocabulary = vocabulary or public_vocabulary()
    W.text_batches(docs)

    def run(batches):
        from pyspark import TaskContext

        encode = Encoder(vocabulary)
        sequence = group = TaskContext.get().partitionId() << 36
        full: list[list[Piece]] = []
        rest: list[Piece] = []
        held = 0

        def flush(last):
            nonlocal sequence, group, full, rest, held
            done, rest = pack_pieces(rest, sizes, last)
            done = full + done
            full, held = [], sum(map(len, rest))
            if not done:
                return None
            groups = step_groups(done, step_tokens)
            columns: list[list] = [[] for _ in range(9)]
            for k, window in enumerate(done):
                size, offset = sum(map(len, window)), 0
                for p in window:
                    values = (p.doc, p.start, len(p), p.total, sequence + k, offset, size, group + groups[k], p.ids.tobytes())
                    for column, v in zip(columns, values, strict=True):
                        column.append(v)
                    offset += len(p)
            sequence += len(done)
            group += max(groups) + 1
            kinds = [pa.int64()] * 6 + [pa.int32(), pa.int64(), pa.binary()]
            names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "tier", "step_group", "ids"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        for batch in W.slices(batches):
            ids = batch.column(0).to_pylist()
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for doc, found in zip(ids, encode(texts), strict=True):
                found = np.append(found, np.uint32(end_id)).astype("<u4")
                n = len(found)
                for at in range(0, n - sizes[0] + 1, sizes[0]):
                    full.append([Piece(doc, at, found[at:at + sizes[0]], n)])
                    held += sizes[0]
                    if held >= pool and (out := flush(False)) is not None:
                        yield out
                if n % sizes[0]:
                    rest.append(Piece(doc, n - n % sizes[0], found[n - n % sizes[0]:], n))
                    held += n % sizes[0]
                    if held >= pool and (out := flush(False)) is not None:
                        yield out
        if (out := flush(True)) is not None:
            yield out

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def pieces(docs: DataFrame, **options) -> DataFrame:
    """The packed pieces with the checksum of their ids in place of the ids."""
    packed = pack(docs, **options)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset",
                         "tier", "step_group")
