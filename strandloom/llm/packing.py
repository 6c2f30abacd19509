"""Hierarchical packing of token sequences into windows of several lengths.

Each document's ids, closed by one end id, are routed to tiers of power-of-two window lengths: whole windows of the longest
tier are cut off first, and the rest goes to the shortest tier that holds it. Each tier is packed from its longest rests
down; the gap of a window is filled from the shorter tiers, by the largest rest that fits, and at last by cutting a short
one. So windows are full, and as their lengths are powers of two nothing is padded but the last one of a partition.
Windows of one tier form step groups with an equal number of tokens.
"""

from __future__ import annotations

import functools
from bisect import bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import tokens
from .common import arrow_map, texts_of

PIECES = "doc_id long, start long, ids binary, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


@dataclass(frozen=True)
class Plan:
    """tiers: window lengths, powers of two, longest first. pool: ids held by a task before it packs. step: ids of a step group."""

    tiers: tuple[int, ...] = (2048, 1024, 512, 256)
    pool: int = 2_000_000
    step: int = 32_768
    end_id: int = 1

    def __post_init__(self):
        if not self.tiers or list(self.tiers) != sorted(set(self.tiers), reverse=True) or any(t < 1 or t & (t - 1) for t in self.tiers):
            raise ValueError("tiers are distinct powers of two, longest first")
        if self.step % self.tiers[0]:
            raise ValueError("a step group holds whole windows of each tier")


class Packer:
    """Packs the documents of one task; rows of pieces leave as they are ready."""

    def __init__(self, plan: Plan, partition: int):
        self.plan, self.base = plan, partition << 33
        self.sequences = self.groups = self.held = 0
        self.filled: dict[int, tuple[int, int]] = {}  # of each tier: its open step group and the ids in it
        self.rests: dict[int, list] = {t: [] for t in plan.tiers}  # sorted (length, number, key, start, ids, tokens)
        self.number = 0
        self.rows: list[tuple] = []

    def window(self, tier: int, pieces: list[tuple]) -> None:
        """One sequence of the pieces (key, start, ids, tokens)."""
        group, ids = self.filled.get(tier, (None, self.plan.step))
        if ids >= self.plan.step:
            group, ids, self.groups = self.base + self.groups, 0, self.groups + 1
        self.filled[tier] = group, ids + tier
        at = 0
        for key, start, piece, n in pieces:
            self.rows.append((key, start, piece.astype("<u4").tobytes(), n, self.base + self.sequences, at, tier, group))
            at += len(piece)
        self.sequences += 1

    def keep(self, key, start: int, ids: np.ndarray, n: int) -> None:
        """A rest that is shorter than the longest window goes to the shortest tier that holds it."""
        tier = min(t for t in self.plan.tiers if t >= len(ids))
        if len(ids) == tier:
            self.window(tier, [(key, start, ids, n)])
        else:
            self.number += 1
            insort(self.rests[tier], (len(ids), self.number, key, start, ids, n), key=lambda x: x[:2])
            self.held += len(ids)

    def add(self, key, ids: np.ndarray) -> None:
        top, n = self.plan.tiers[0], len(ids)
        for start in range(0, n - top + 1, top):
            self.window(top, [(key, start, ids[start : start + top], n)])
        if rest := n % top:
            self.keep(key, n - rest, ids[n - rest :], n)
        if self.held >= self.plan.pool:
            self.pack()

    def take(self, tier: int, gap: int) -> tuple | None:
        """The largest rest of the tiers up to this one that fits the gap, else the start of the smallest rest, cut to fit it."""
        shorter = [t for t in self.plan.tiers if t <= tier]
        for t in shorter:
            if k := bisect_right(self.rests[t], gap, key=lambda x: x[0]):
                return self.rests[t].pop(k - 1)
        for t in reversed(shorter):
            if self.rests[t]:
                size, _, key, start, ids, n = self.rests[t].pop(0)
                self.held -= size - gap
                self.keep(key, start + gap, ids[gap:], n)
                return gap, 0, key, start, ids[:gap], n
        return None

    def pack(self, last: bool = False) -> None:
        """Packs all rests into full windows; what can't fill one of the shortest tier waits, or at the end forms the one short sequence."""
        for tier in self.plan.tiers:
            while self.rests[tier] and (last or self.held >= tier):
                own, pieces, room = self.rests[tier].pop(), [], tier
                while own is not None:
                    size, _, key, start, ids, n = own
                    self.held -= size
                    pieces.append((key, start, ids, n))
                    room -= size
                    own = self.take(tier, room) if room else None
                if room and not last:  # nothing is left to fill it: it waits
                    for key, start, ids, n in pieces:
                        self.keep(key, start, ids, n)
                    break
                self.window(tier, pieces)

    def ready(self) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
        columns = list(zip(*self.rows, strict=True)) or [()] * len(kinds)
        names = [x.split()[0] for x in PIECES.split(", ")]
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def _pack(batches: Iterator[pa.RecordBatch], tokenizer: str, whole: dict[str, int], plan: Plan) -> Iterator[pa.RecordBatch]:
    memo = tokens.memo(tokenizer, whole)
    packer = Packer(plan, TaskContext.get().partitionId())
    end = np.array([plan.end_id], np.uint32)
    for batch in batches:
        keys = batch.column(0).to_pylist()
        for at, texts in texts_of(batch):
            for key, ids in zip(keys[at : at + len(texts)], memo.of(texts, False), strict=True):
                packer.add(key, np.concatenate([ids, end]))
                if len(packer.rows) >= 2000:
                    yield packer.ready()
    packer.pack(last=True)
    yield packer.ready()


def pack_documents(docs: DataFrame, tokenizer: str, plan: Plan = Plan(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs all documents; a row per piece: doc_id, start, ids (little-endian 32-bit), doc_tokens, sequence_id, offset, tier, step_group.

    tier is the window length of the piece's sequence. Each task packs what it reads, so nothing is shuffled, one source
    or many copies change nothing, and a lost task is simply run again. Null and empty texts are the end id alone; a null id
    stays null; repeated rows are packed each; an empty table gives an empty result; other columns are ignored.
    """
    rows = docs.selectExpr(f"CAST({id_col} AS BIGINT) doc_id", f"{text_col} text")
    step = functools.partial(_pack, tokenizer=tokenizer, whole=tokens.proven_whole(tokenizer), plan=plan)
    return arrow_map(rows, step, PIECES)
