"""Jaccard join of shingle sets by signature trees, and the groups that its links form.

A document's set holds the hashes of its distinct 5-word shingles; documents with equal sets are one node. Three steps:

1. Who can link at all. In any fixed order of the elements, two nodes of Jaccard similarity t or more share k or more of their first
   size - ceil(t * size) + k elements. Those are dealt out by element, and a node of which fewer than k are held by another node is done
   with. An element that several nodes of a task hold leaves the task once, so that passages of many documents make no large groups.
2. Who can link with whom. The sets of the nodes that are left are ordered by how many of these nodes hold an element, rare ones
   first; two nodes that link share one of the first size - ceil(t * size) + 1. Nodes that are joined by such elements, through others too,
   form a unit, and no link leaves a unit.
3. A unit is a signature tree: nodes ordered by size and least hash in leaves, each tree node with the OR of the token bitmaps below
   it and its range of sizes. The tree is traversed against itself; pairs of tree nodes whose greatest possible overlap is too small, and those
   that are one group already, go with all below them. What is left is verified on the whole sets at once, and each link
   joins two groups, so that a unit gives fewer links than it has nodes.

A unit of more than `chunk` nodes is first cut into trees of nodes that agree in a smallest hash; that finds most links, each
verified. Then the nodes that still share elements with another group are dealt to cells by size, and cells meet pair by pair where
their sizes can link; a group that fills cells of its own doesn't meet itself.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, drop_stored, released, stored, texts_of

_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_ODD = np.uint64(0x9E3779B97F4A7C15)
_KEYS = (0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93)
#: Bits of the fixed-size filter that is shipped to the workers (4 MB).
_FILTER = 25
#: Elements that a task gathers before it deals them out, and rows of a batch that it hands on.
_SLICE, _ROWS = 2_000_000, 100_000


@dataclass(frozen=True)
class Rule:
    """words: of a shingle. percent: of the union that the intersection must reach. extra: one of how many elements more are dealt
    out in step 1. chunk: nodes that one tree holds. tokens: elements that one tree holds, but for a single larger node. cells: how
    many half trees of nodes a unit may deal to all its others; a larger one gives way to units of elements."""

    words: int = 5
    percent: int = 80
    extra: int = 10
    chunk: int = 4096
    tokens: int = 4_000_000
    cells: int = 32

    def need(self, size):
        """The least overlap that a set of this size has with any it links to."""
        return (self.percent * size + 99) // 100

    def more(self, size: int) -> int:
        """k of step 1: how many elements of the dealt ones a partner holds at least."""
        return min(self.need(size), max(1, size // self.extra))


def shingles(text: str | None, words: int) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; of fewer words, one hash of all; without words, none."""
    found = (text or "").encode().translate(_FOLD).split()
    if not found:
        return np.empty(0, np.uint64)
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    n = min(words, len(each))
    out = np.full(len(each) - n + 1, n, np.uint64)
    for k in range(n):
        out = (out ^ each[k : len(each) - n + 1 + k]) * _ODD
        out ^= out >> np.uint64(29)
    return np.unique(out * np.uint64(_KEYS[0]))


def _node(tokens: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(tokens.tobytes())


def _raw(text: str | None) -> int:
    return xxhash.xxh3_64_intdigest((text or "").encode())


def _signed(x) -> np.ndarray:
    return np.asarray(x, np.uint64).view(np.int64)


def _bits(df: DataFrame, column: str, bits: int) -> np.ndarray:
    """A bitmap of fixed size over the low bits of a column of longs, built where the rows are; 4 MB at most reach the driver."""
    at = df.select(F.expr(f"({column} & {(1 << bits) - 1}L) + 1 AS at"))  # buckets count from 1
    parts = at.groupBy(F.expr("bitmap_bucket_number(at)").alias("b")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(at))").alias("m"))
    out = np.zeros(1 << bits >> 3, np.uint8)
    for r in parts.collect():
        out[(r.b - 1) * 4096 : r.b * 4096] = np.frombuffer(bytes(r.m), np.uint8)
    return out


# Step 1: nodes that share enough of their first elements with any other node


def _members(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[pa.RecordBatch]:
    """Of each row its node and a hash of its text; where the node is met first in this task, the first elements of its set."""
    seen: set[int] = set()
    for batch in batches:
        sizes, raws, nodes, firsts = [], [], [], []
        for _, texts in texts_of(batch):
            for text in texts:
                tokens = shingles(text, rule.words)
                n = len(tokens)
                node = _node(tokens) if n else None
                sizes.append(n)
                raws.append(_raw(text))
                nodes.append(node)
                firsts.append(tokens[: n - rule.need(n) + rule.more(n)] if n and node not in seen else None)
                if n:
                    seen.add(node)
        upto = np.cumsum([0, *(0 if x is None else len(x) for x in firsts)])
        flat = pa.array(_signed(np.concatenate([np.empty(0, np.uint64), *(x for x in firsts if x is not None)])))
        lists = pa.ListArray.from_arrays(pa.array(upto, pa.int32()), flat, mask=pa.array([x is None for x in firsts], pa.bool_()))
        own = pa.array(_signed([n or 0 for n in nodes]), pa.int64(), mask=np.array([n is None for n in nodes], bool))
        columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(_signed(raws)), own, lists]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "size", "raw", "node", "first"])


def _in_batches(columns: list, names: list[str]) -> Iterator[pa.RecordBatch]:
    whole = pa.RecordBatch.from_arrays(columns, names)
    for at in range(0, whole.num_rows, _ROWS):
        yield whole.slice(at, _ROWS)


def _offers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, node, count): an element that one node of the slice holds, with that node and 0; an element that several hold, with
    null and 0; and for each node that holds some of the latter, twice the node and how many."""

    def dealt(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        nodes, lengths, elements = (np.concatenate(x) for x in zip(*held, strict=True))
        first = np.zeros(len(nodes), bool)  # a node that two tasks have met counts once
        first[np.unique(nodes, return_index=True)[1]] = True
        owners, elements = np.repeat(nodes, lengths)[np.repeat(first, lengths)], elements[np.repeat(first, lengths)]
        order = np.argsort(elements, kind="stable")
        elements, owners = elements[order], owners[order]
        same = elements[1:] == elements[:-1]
        several = np.append(False, same) | np.append(same, False)
        marks = np.unique(elements[several])
        holders, counts = np.unique(owners[several], return_counts=True)
        keys = np.concatenate([elements[~several], marks, holders])
        none = np.zeros(len(keys), bool)
        none[len(keys) - len(holders) - len(marks) : len(keys) - len(holders)] = True
        who = np.concatenate([owners[~several], np.zeros(len(marks), np.int64), holders])
        count = np.concatenate([np.zeros(len(keys) - len(holders), np.int32), counts.astype(np.int32)])
        yield from _in_batches([pa.array(keys), pa.array(who, mask=none), pa.array(count)], ["key", "node", "count"])

    held, total = [], 0
    for batch in batches:
        lists = batch.column("first")
        held.append((batch.column("node").to_numpy(), pc.list_value_length(lists).to_numpy().astype(np.int64), lists.flatten().to_numpy()))
        total += len(held[-1][2])
        if total >= _SLICE:
            yield from dealt(held)
            held, total = [], 0
    if held:
        yield from dealt(held)


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of _offers come by key: (node, how many of its elements another node holds), in parts to be summed. A key has a row for each slice at most."""

    def counted(keys, nodes, none):
        marks, keys, nodes = np.unique(keys[none]), keys[~none], nodes[~none]
        order = np.lexsort((nodes, keys))
        keys, nodes = keys[order], nodes[order]
        once = np.append(True, (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1]))[: len(keys)]
        keys, nodes = keys[once], nodes[once]
        _, at, each = np.unique(keys, return_inverse=True, return_counts=True)
        holders, counts = np.unique(nodes[(each[at] > 1) | np.isin(keys, marks)], return_counts=True)
        yield from _in_batches([pa.array(holders), pa.array(counts.astype(np.int64))], ["node", "shared"])

    left = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool))
    for batch in batches:
        key, node, count = batch.columns
        own = count.to_numpy() > 0
        yield from _in_batches([node.filter(pa.array(own)), count.filter(pa.array(own)).cast(pa.int64())], ["node", "shared"])
        now = key.to_numpy()[~own], node.fill_null(0).to_numpy()[~own], node.is_null().to_numpy(zero_copy_only=False)[~own]
        now = tuple(np.concatenate(x) for x in zip(left, now, strict=True))
        cut = np.searchsorted(now[0], now[0][-1]) if len(now[0]) else 0  # the last key may go on
        yield from counted(*(x[:cut] for x in now))
        left = tuple(x[cut:] for x in now)
    yield from counted(*left)


# Step 2: the sets of these nodes, and the units that rare elements join


def _sets(batches: Iterator[pa.RecordBatch], rule: Rule, wanted) -> Iterator[pa.RecordBatch]:
    """The sets of texts whose hash the filter may hold, each once for a task, with the smallest hashes by each key."""
    seen: set[int] = set()
    bitmap, low = wanted.value, (1 << _FILTER) - 1
    for batch in batches:
        for _, texts in texts_of(batch):
            rows = []
            for text in texts:
                at = _raw(text) & low
                if not bitmap[at >> 3] >> (at & 7) & 1 or not len(tokens := shingles(text, rule.words)) or (node := _node(tokens)) in seen:
                    continue
                seen.add(node)
                rows.append((node, len(tokens), [int((tokens * np.uint64(k)).min()) for k in _KEYS], tokens.tobytes()))
            if rows:
                node, size, keys, sets = zip(*rows, strict=True)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * len(_KEYS), pa.int32()), pa.array(_signed(keys).ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(_signed(node)), pa.array(size, pa.int64()), lists, pa.array(sets, pa.binary())], ["node", "size", "keys", "tokens"])


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row (element, node) for each element of each set."""
    for batch in batches:
        nodes, sets = batch.column("node").to_numpy(), batch.column("tokens")
        for at in range(0, len(nodes), 256):
            part = [np.frombuffer(x, np.int64) for x in sets.slice(at, 256).to_pylist()]
            yield from _in_batches([pa.array(np.concatenate(part)), pa.array(np.repeat(nodes[at : at + 256], [len(x) for x in part]))], ["element", "node"])


def _held(batches: Iterator[pa.RecordBatch], most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Rows come by element: (node, element, how many nodes hold it) of those with two holders or more. From `most` holders on, all count
    as so many, so that no more have to be gathered."""

    def told(keys, nodes):
        _, at, each = np.unique(keys, return_inverse=True, return_counts=True)
        n = np.minimum(each[at], most)
        n[keys == long] = most
        several = n > 1
        yield from _in_batches([pa.array(nodes[several]), pa.array(keys[several]), pa.array(n[several].astype(np.int32))], ["node", "element", "holders"])

    long, left = None, (np.empty(0, np.int64), np.empty(0, np.int64))
    for batch in batches:
        keys, nodes = (np.concatenate([a, b.to_numpy()]) for a, b in zip(left, batch.columns, strict=True))
        cut = np.searchsorted(keys, keys[-1]) if len(keys) else 0
        yield from told(keys[:cut], nodes[:cut])
        left = keys[cut:], nodes[cut:]
        if len(left[0]) >= most or len(left[0]) and left[0][0] == long:
            long = left[0][0]
            yield from told(*left)
            left = np.empty(0, np.int64), np.empty(0, np.int64)
    yield from told(*left)


# Step 3: signature trees


def linked(a: np.ndarray, b: np.ndarray, rule: Rule) -> bool:
    if rule.need(max(len(a), len(b))) > min(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= rule.percent * (len(a) + len(b) - both)


def signature(tokens: np.ndarray) -> np.ndarray:
    """A bitmap of the tokens, of sixteen to thirty-two bits for each."""
    width = max(128, 1 << int(16 * len(tokens) - 1).bit_length())
    out = np.zeros(width, np.uint8)
    out[(tokens & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little")


def _fold(sign: np.ndarray, width: int) -> np.ndarray:
    """A bitmap of fewer bytes: an element's bit is then given by fewer of its low bits."""
    return np.bitwise_or.reduce(sign.reshape(-1, width), 0) if len(sign) > width else sign


class Tree:
    """The rows from `start` to `end` of a unit, or the part of it below one tree node."""

    LEAF, FAN = 16, 8

    def __init__(self, sizes: np.ndarray, signs: list[np.ndarray], start: int, end: int):
        self.start, self.end, own = start, end, sizes[start:end]
        self.low, self.high = int(own.min()), int(own.max())
        self.sizes, self.width, self._at = own, min(len(s) for s in signs[start:end]), {}
        step = self.LEAF
        while step * self.FAN < end - start:
            step *= self.FAN
        self.parts = [] if end - start <= self.LEAF else [Tree(sizes, signs, a, min(a + step, end)) for a in range(start, end, step)]
        self.signs = [] if self.parts else signs[start:end]

    def at(self, width: int) -> tuple:
        """At a width in bytes: the OR of all bitmaps below, and the most tokens of one row beyond its bits; of a leaf, also each row's."""
        if width not in self._at:
            if self.parts:
                below = [p.at(width) for p in self.parts]
                self._at[width] = np.bitwise_or.reduce([x[0] for x in below]), max(x[1] for x in below)
            else:
                rows = np.stack([_fold(s, width) for s in self.signs])
                slack = self.sizes - np.bitwise_count(rows).sum(1, dtype=np.int64)
                self._at[width] = np.bitwise_or.reduce(rows, 0), int(slack.max()), rows, slack
        return self._at[width]


def traverse(one: Tree, two: Tree, rule: Rule, labels: np.ndarray) -> Iterator[tuple[int, int]]:
    """Dual traversal: pairs of rows with different labels whose greatest possible overlap suffices. two may be one; labels may change meanwhile.

    Overlap o of sizes x and y suffices if (100 + t) * o >= t * (x + y); o is at most what the bitmaps share and the tokens beyond their bits.
    """
    t, stack = rule.percent, [(one, two)]
    while stack:
        a, b = stack.pop()
        if 100 * a.high < t * b.low or 100 * b.high < t * a.low:
            continue
        group = labels[a.start]
        if (labels[a.start : a.end] == group).all() and (labels[b.start : b.end] == group).all():
            continue
        width = min(a.width, b.width)
        x, y = a.at(width), b.at(width)
        common = int(np.bitwise_count(x[0] & y[0]).sum(dtype=np.int64))
        if (100 + t) * min(a.high, b.high, common + min(x[1], y[1])) < t * (a.low + b.low):
            continue
        if not a.parts and not b.parts:
            common = np.bitwise_count(x[2][:, None, :] & y[2][None, :, :]).sum(2, dtype=np.int64)
            m, n = a.sizes[:, None], b.sizes[None, :]
            ok = (100 + t) * np.minimum(np.minimum(m, n), common + np.minimum(x[3][:, None], y[3][None, :])) >= t * (m + n)
            if a is b:
                ok = np.triu(ok, 1)
            for i, j in zip(*np.nonzero(ok), strict=True):
                if labels[a.start + i] != labels[b.start + j]:
                    yield a.start + int(i), b.start + int(j)
        elif a is b:
            stack += [(p, q) for k, p in enumerate(a.parts) for q in a.parts[k + 1 :]]
            stack += [(p, p) for p in a.parts]  # taken first: what is near joins first
        elif not b.parts or a.parts and a.end - a.start >= b.end - b.start:
            stack += [(p, b) for p in a.parts]
        else:
            stack += [(a, q) for q in b.parts]


def forest(rows: list[tuple[int, int, int, bytes]], rule: Rule) -> list[tuple[int, int]]:
    """Of a unit's rows (side, node, group, tokens), verified links between different groups, as few as connect what is connected.

    With one side, its rows meet each other; with two, those of one meet those of the other.
    """
    sets = [np.frombuffer(r[3], np.uint64) for r in rows]
    band = [int(np.log(len(s)) * 4) for s in sets]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0], band[i], sets[i][0], rows[i][1]))
    rows, sets = [rows[i] for i in order], [sets[i] for i in order]
    sizes, signs = np.array([len(s) for s in sets], np.int64), [signature(s) for s in sets]
    first = sum(r[0] == 0 for r in rows)
    trees = [Tree(sizes, signs, a, b) for a, b in ((0, first), (first, len(rows))) if a < b]
    _, labels = np.unique([r[2] for r in rows], return_inverse=True)
    out = []
    for i, j in traverse(trees[0], trees[-1], rule, labels):
        if labels[i] != labels[j] and linked(sets[i], sets[j], rule):
            out.append((rows[i][1], rows[j][1]))
            labels[labels == labels[i]] = labels[j]
    return out


def _links(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[pa.RecordBatch]:
    """Rows come by unit: (unit, cells, side, node, group, tokens)."""
    unit, rows = None, []

    def found():
        out = forest(rows, rule) if len(rows) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    for batch in batches:
        units = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        rest = [batch.column(k) for k in range(2, 6)]
        for at in range(0, len(units), 256):
            for own, *row in zip(units[at : at + 256], *(c.slice(at, 256).to_pylist() for c in rest), strict=True):
                if own != unit:
                    yield found()
                    unit, rows = own, []
                rows.append(tuple(row))
    yield found()


def _by_trees(units: DataFrame, rule: Rule) -> DataFrame:
    """Links (a, b) of rows (unit, cells, side, node, group, tokens)."""
    laid = units.select("unit", "cells", "side", "node", "group", "tokens").repartition("unit", "cells").sortWithinPartitions("unit", "cells")
    return arrow_map(laid, functools.partial(_links, rule=rule), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node reachable along edges (a, b), by large-star and small-star rounds, each written out."""

    def state(df: DataFrame):
        return tuple(df.selectExpr("count(*)", "bit_xor(xxhash64(a, b))", "bit_xor(xxhash64(b, a, 1))").first())

    edges, was = stored(edges.select("a", "b").filter("a <> b").distinct(), "join-edges"), None
    while True:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # stored, so that Spark can split a node of many edges
        least = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "join-least")
        large = stored(both.join(least, "a").filter("b > a").selectExpr("b AS a", "m AS b").filter("a <> b").distinct(), "join-large")
        drop_stored(edges)
        down = large.selectExpr("greatest(a, b) AS a", "least(a, b) AS b")
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a")
        small = stored(small.selectExpr("b AS a", "m AS b").unionAll(least.selectExpr("a", "m AS b")).filter("a <> b").distinct(), "join-small")
        drop_stored(large)
        if (now := state(small)) == was:  # each node but a root points at its root
            return small.selectExpr("a AS node", "b AS root")
        edges, was = small, now


def _able(met: DataFrame, rule: Rule) -> DataFrame:
    """node, size, raw: the nodes that step 1 leaves, with the hash of one of their texts."""
    offered = arrow_map(met.select("node", "first").filter("first IS NOT NULL"), _offers, "key long, node long, count int")
    counts = arrow_map(offered.repartition("key").sortWithinPartitions("key"), _met, "node long, shared long").groupBy("node").agg(F.sum("shared").alias("shared"))
    nodes = met.filter("node IS NOT NULL").groupBy("node").agg(F.min("size").alias("size"), F.min("raw").alias("raw"))
    able = nodes.join(counts, "node").filter(F.expr(f"shared >= least(({rule.percent} * size + 99) DIV 100, greatest(1, size DIV {rule.extra}))"))
    return stored(able.select("node", "size", "raw"), "join-able")


def _routes(sets: DataFrame, rule: Rule) -> DataFrame:
    """element, node: the first size - need + 1 elements of each set, rare ones first, as far as another set holds them."""
    dealt = arrow_map(sets.select("node", "tokens"), _elements, "element long, node long").repartition("element").sortWithinPartitions("element")
    held = arrow_map(dealt, _held, "node long, element long, holders int").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("holders", "element"))).alias("held"))
    # of the first size - need + 1, those that no other set holds come before
    first = F.expr(f"slice(held, 1, greatest(0, size(held) - ({rule.percent} * size + 99) DIV 100 + 1))")
    return stored(held.join(sets.select("node", "size"), "node").select("node", F.explode(first).alias("of")).select("of.element", "node"), "join-routes")


def _meetings(rows: DataFrame, rule: Rule) -> DataFrame:
    """Rows (unit, node, group, size) with cells and side, as trees take them: each row goes once to each meeting of its cell.

    A unit that one tree holds is one cell. Of others, cells are dealt by a band of sizes and a hash; a group that fills a cell has cells of its own, and those
    don't meet each other. Else a cell meets itself and each one of its band and of the next. What is counted is stored, so that Spark sends it to all tasks
    or, where it is large, splits the rows of a large unit.
    """
    half = f"(n > {rule.chunk} DIV 2 OR tokens > {rule.tokens} DIV 2)"
    counted = lambda *by: rows.groupBy(*by).agg(F.count("*").alias("n"), F.sum("size").alias("tokens"))
    whole = stored(counted("unit").selectExpr("unit", f"n <= {rule.chunk} AND tokens <= {rule.tokens} AS whole"), "join-whole")
    alone = stored(counted("unit", "group").filter(half).select("unit", "group", F.lit(True).alias("alone")), "join-alone")
    # sizes that link differ by no more than one band
    band = F.when(F.col("whole"), 0).otherwise(F.floor(F.log("size") / F.log(F.lit(100 / min(rule.percent, 99)))))
    own = F.when(~F.col("whole") & F.col("alone"), F.col("group").cast("string")).otherwise(F.lit(""))
    rows = rows.join(whole, "unit").join(alone, ["unit", "group"], "left").select("unit", "node", "group", "size", "whole", band.alias("band"), own.alias("own"))
    cells = rows.groupBy("unit", "band", "own", "whole").agg(F.count("*").alias("n"), F.sum("size").alias("tokens"))
    cells = stored(cells.selectExpr("unit", "band", "own", f"IF(whole, 1, CAST(greatest(ceil(2 * n / {rule.chunk}), ceil(2 * tokens / {rule.tokens})) AS INT)) AS parts"), "join-cells")
    placed = rows.join(cells, ["unit", "band", "own"]).withColumn("cell", F.expr("concat_ws(':', band, own, pmod(xxhash64(node), parts))"))
    each = cells.select("unit", "band", "own", F.explode(F.expr("sequence(0, parts - 1)")).alias("part")).withColumn("cell", F.concat_ws(":", "band", "own", "part"))
    one, two = each.alias("p"), each.alias("q")
    meet = one.join(two, F.expr("p.unit = q.unit AND p.cell <= q.cell AND abs(p.band - q.band) <= 1 AND (p.own = '' OR p.own <> q.own)"))
    meet = meet.select(F.col("p.unit").alias("unit"), F.col("p.cell").alias("one"), F.col("q.cell").alias("two"), F.concat_ws("/", "p.cell", "q.cell").alias("cells"))
    sides = stored(meet.selectExpr("unit", "one AS cell", "cells", "0 AS side").unionAll(meet.filter("one < two").selectExpr("unit", "two AS cell", "cells", "1 AS side")), "join-sides")
    return placed.select("unit", "cell", "node", "group").join(sides, ["unit", "cell"])


def _large(routes: DataFrame, sets: DataFrame, groups: DataFrame, rule: Rule) -> DataFrame:
    """Links between groups, for nodes whose first units were too large for one tree; groups: node, root (the unit), group.

    Only nodes that share an element of their first ones with another group are left. Those of a first unit stay one unit where all of them, but for groups that
    fill a cell, are few cells; else each element that two groups hold is a unit, and elements with the same nodes count once.
    """
    own = routes.join(groups, "node")
    mixed = own.groupBy("element").agg(F.min("group").alias("least"), F.max("group").alias("most"), F.bit_xor(F.xxhash64("node")).alias("alike"), F.count("*").alias("n")).filter("least < most")
    mixed = stored(mixed.select("element", "alike", "n"), "join-mixed")
    left = stored(own.join(mixed.select("element"), "element", "left_semi").select("node", "root", "group").distinct(), "join-left")
    parts = left.groupBy("root", "group").agg(F.count("*").alias("n")).groupBy("root").agg(F.sum(F.expr(f"IF(n > {rule.chunk} DIV 2, 0, n)")).alias("n"))
    few = stored(parts.selectExpr("root", f"n <= {rule.cells * rule.chunk} DIV 2 AS few"), "join-few")
    left = left.join(few, "root")
    by_root = left.filter("few").selectExpr("root AS unit", "node", "group")
    kept = stored(mixed.groupBy("alike", "n").agg(F.min("element").alias("element")).select("element"), "join-kept")
    by_element = own.join(kept, "element").join(left.filter("NOT few").select("node"), "node", "left_semi").selectExpr("element AS unit", "node", "group")
    rows = stored(by_root.unionAll(by_element).join(sets.select("node", "size"), "node").select("unit", "node", "group", "size"), "join-rows")
    return _by_trees(_meetings(rows, rule).join(sets.select("node", "tokens"), "node"), rule)


def _all_links(able: DataFrame, rows: DataFrame, rule: Rule) -> DataFrame:
    """Links (a, b) that connect what similarity connects, of the nodes that step 1 leaves."""
    context = rows.sparkSession.sparkContext
    wanted = context.broadcast(_bits(able, "raw", _FILTER))
    sets = arrow_map(rows.select("text"), functools.partial(_sets, rule=rule, wanted=wanted), "node long, size long, keys array<long>, tokens binary")
    sets = stored(sets.join(able.select("node"), "node", "left_semi").dropDuplicates(["node"]), "join-sets")
    released(rows.sparkSession)
    routes = _routes(sets, rule)
    released(rows.sparkSession)

    # stored, so that Spark can split an element of many nodes
    ends = stored(routes.groupBy("element").agg(F.min("node").alias("b"), F.count("*").alias("n")).filter("n > 1").select("element", "b"), "join-ends")
    roots = components(routes.join(ends, "element").selectExpr("node AS a", "b"))
    placed = routes.select("node").distinct().join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    units = placed.join(sets, "node")
    fits = units.groupBy("root").agg(F.count("*").alias("n"), F.sum("size").alias("all")).filter("n > 1").selectExpr("root", f"n <= {rule.chunk} AND all <= {rule.tokens} AS fits")
    fits = stored(fits, "join-units")
    units = units.join(fits, "root")
    laid = units.filter("fits").selectExpr("root AS unit", "'' AS cells", "0 AS side", "node", "node AS group", "tokens")
    if any_large := not fits.filter("NOT fits").isEmpty():
        large = units.filter("NOT fits")
        keyed = large.select("node", "size", "tokens", F.posexplode("keys").alias("k", "unit"))
        parts = large.select("size", F.posexplode("keys").alias("k", "unit")).groupBy("k", "unit").agg(F.count("*").alias("n"), F.sum("size").alias("all"))
        parts = stored(parts.filter("n > 1").selectExpr("k", "unit", f"CAST(greatest(ceil(n / {rule.chunk}), ceil(all / {rule.tokens})) AS INT) AS parts"), "join-parts")
        laid = laid.unionAll(keyed.join(parts, ["k", "unit"]).selectExpr("unit", "concat(k, ':', pmod(xxhash64(node, k), parts)) AS cells", "0 AS side", "node", "node AS group", "tokens"))
    links = stored(_by_trees(laid, rule), "join-links")
    if any_large:
        inside = placed.join(fits.filter("NOT fits"), "root").select("node", "root")
        own = components(links).withColumnRenamed("root", "group")
        groups = stored(inside.join(own, "node", "left").select("node", "root", F.coalesce("group", "node").alias("group")), "join-groups")
        links = links.unionAll(stored(_large(routes, sets, groups, rule), "join-large-links"))
    links = stored(links, "join-all-links")
    for done in (sets, routes, fits, ends):
        drop_stored(done)
    return links


def groups(docs: DataFrame, rule: Rule = Rule(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, n_shingles, component_id (smallest id reachable by links, its own included).

    Null texts and those without words have no shingle and link with nothing, whatever their id. A null id is never the smallest
    of a group unless all are null. Repeated rows are linked like copies. Other columns are ignored; an empty table gives an empty result.
    """
    rows = docs.selectExpr(f"CAST({id_col} AS BIGINT) doc_id", f"{text_col} text")
    met = stored(arrow_map(rows, functools.partial(_members, rule=rule), "doc_id long, size long, raw long, node long, first array<long>"), "join-met")
    members = stored(met.select("doc_id", "size", "node"), "join-members")
    able = _able(met, rule)
    drop_stored(met)
    released(docs.sparkSession)
    roots = components(_all_links(able, rows, rule))
    drop_stored(able)
    released(docs.sparkSession)
    # the smallest id is found for nodes, then for groups, and told to nodes, so that no copy or member of a group is dealt out by its group
    nodes = members.filter("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("own")).join(roots, "node", "left")
    nodes = stored(nodes.select("node", F.coalesce("root", "node").alias("root"), "own"), "join-nodes")
    least = stored(nodes.groupBy("root").agg(F.min("own").alias("least")), "join-least")
    least = stored(nodes.join(least, "root").select("node", "least"), "join-found")
    drop_stored(nodes)
    return members.join(least, "node", "left").select("doc_id", F.col("size").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, rule: Rule = Rule(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group, all columns: the one with the smallest id. Rows without an id stay, as groups can't refer to them; of rows that share an id one stays."""
    kept = groups(docs.select(id_col, text_col), rule, id_col, text_col).filter("doc_id = component_id").select(F.col("doc_id").alias("__kept")).distinct()
    named = docs.filter(F.col(id_col).isNotNull()).join(kept, F.col(id_col).cast("long") == F.col("__kept"), "left_semi").dropDuplicates([id_col])
    return named.unionAll(docs.filter(F.col(id_col).isNull()))
