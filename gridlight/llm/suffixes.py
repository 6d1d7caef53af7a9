"""Removal of repeated passages by a common-prefix-aware merge sort of suffixes.

A byte goes if it is covered by a SPAN-byte string that also starts earlier. Each task sorts suffixes and front-codes the run
(length of the prefix shared with the line before, then the rest); runs are cut at sampled splitters, and the pieces of a range
meet in a loser tree that compares no byte twice, as it carries the known common prefixes along, and gives out the common prefix
of neighbours. Which strings are equal is read off those prefixes.

Not every suffix is sorted. Every string has an anchor, the position of the smallest hash among its K-byte grams, and equal
strings have equal anchors at the same place. So one suffix per anchor is sorted, the one that starts at its gram, and only
if that gram occurs again. A suffix is cut where the last string of its anchor ends; the bytes before the anchor that its
strings cover follow it, nearest first. A string that starts j bytes before its anchor equals another if the suffixes share
SPAN - j bytes and the j bytes before are the same. Of suffixes that agree in all of that within a run, only the first goes on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlight.llm.common import durable, maybe, scratch
from gridlight.operators.ranking import global_rank

SPAN, K = 100, 32
#: Bytes before an anchor that a string can start at most, and bytes of a line: suffix, bytes before, how many of either count.
LEFT = SPAN - K
LINE = SPAN + LEFT + 2
#: Bytes that are hashed at once; suffixes of a sorted run; suffixes that a merging task gets, about; ranges, at most. One gram in
#: GRAMS is sent along as a sample for the splitters, of which about SAMPLES are used for a range. A gram is crowded from so many
#: occurrences on; strings around a crowded one are taken apart by where they start, STEP places at a time.
CHUNK, RUN, MERGE, RANGES = 1 << 18, 50_000, 50_000, 1 << 16
GRAMS, SAMPLES, CROWD, STEP = 1024, 16, 10_000, 8
_M = 0x9E3779B97F4A7C15
_INV = pow(_M, -1, 1 << 64)
_BYTES = np.random.default_rng(5).integers(0, 1 << 64, 256, dtype=np.uint64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> list[np.ndarray]:
    """The first n powers of the multiplier and of its inverse modulo 2 ** 64."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_M, _INV)):
            x = np.full(n, base, np.uint64)
            x[0] = 1
            _powers[i] = np.multiply.accumulate(x)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    return x


class Anchors:
    """Anchors of the strings of several byte texts laid end to end.

    Per anchor: doc (index of its text), at, and the strings whose anchor it is: low .. high, places in ``data``.
    """

    def __init__(self, texts: list[bytes]):
        self.data = b"".join(texts)
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        self.starts = np.cumsum(sizes) - sizes
        n = len(self.data)
        self.power, self.inverse = powers(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTES[np.frombuffer(self.data, np.uint8)] * self.power[:n], out=self.sums[1:])
        none = np.zeros(0, np.int64)
        self.doc, self.at, self.low, self.high = none, none, none, none
        if n < SPAN:
            return
        key = self.hashes(np.arange(n - K + 1), K)
        key = (key >> np.uint64(32) << np.uint64(32)) | np.arange(len(key), dtype=np.uint64)
        wide, have = SPAN - K + 1, 1
        while have < wide:  # the least key of each ``have`` in a row
            step = min(have, wide - have)
            key = np.minimum(key[:-step], key[step:])
            have += step
        at = (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
        doc = np.repeat(np.arange(len(texts)), np.maximum(sizes - SPAN + 1, 0))
        string = np.arange(len(doc)) - np.repeat(np.cumsum(np.maximum(sizes - SPAN + 1, 0)) - np.maximum(sizes - SPAN + 1, 0), np.maximum(sizes - SPAN + 1, 0)) + self.starts[doc]
        at = at[string]
        if not len(at):
            return
        new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])]))
        last = np.append(new[1:], len(at)) - 1
        self.doc, self.at, self.low, self.high = doc[new], at[new], string[new], string[last]

    def hashes(self, at: np.ndarray, size) -> np.ndarray:
        """Hashes of the ``size`` bytes from each place."""
        return mix((self.sums[at + size] - self.sums[at]) * self.inverse[at])

    def kinds(self) -> np.ndarray:
        return self.hashes(self.at, K)

    def lines(self, rows: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        """LINE bytes per anchor: the suffix from it, the bytes before it from the nearest on, both zero beyond what strings that start up to
        ``before`` bytes before it and end up to ``after`` bytes after it cover, and those two numbers."""
        at = self.at[rows]
        data = np.concatenate([np.zeros(LEFT, np.uint8), np.frombuffer(self.data, np.uint8), np.zeros(SPAN, np.uint8)])
        window = np.lib.stride_tricks.sliding_window_view(data, LEFT + SPAN)[at]
        out = np.empty((len(rows), LINE), np.uint8)
        out[:, :SPAN] = np.where(np.arange(SPAN) < after[:, None], window[:, LEFT:], 0)
        out[:, SPAN : SPAN + LEFT] = np.where(np.arange(LEFT) < before[:, None], window[:, LEFT - 1 :: -1] if LEFT else 0, 0)
        out[:, -2], out[:, -1] = before, after
        return out


def _chunks(batches: Iterator[pa.RecordBatch], size: int):
    """(did, mark, offset, texts) lists of about ``size`` bytes; longer texts come in pieces that no string of SPAN bytes is missed by."""
    for batch in batches:
        rows, total = [], 0
        for i in range(batch.num_rows):
            t = batch.column(2)[i].as_py()
            data = t.encode("utf-8", "surrogatepass") if t else b""
            for at in range(0, max(1, len(data) - SPAN + 1), size):
                rows.append((batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), at, data[at : at + size + SPAN - 1]))
                total += len(rows[-1][3])
                if total >= size:
                    yield list(map(list, zip(*rows, strict=True)))
                    rows, total = [], 0
        if rows:
            yield list(map(list, zip(*rows, strict=True)))


def grams(keyed: DataFrame) -> DataFrame:
    """kind, n, gram: hashes of the grams at anchors, how often a task has them, and of one in GRAMS the bytes."""

    def run(batches):
        for *_, texts in _chunks(batches, CHUNK):
            a = Anchors(texts)
            kinds, first, n = np.unique(a.kinds(), return_index=True, return_counts=True)
            sampled = set(np.flatnonzero(kinds % np.uint64(GRAMS) == 0).tolist())
            at = a.at[first]
            shown = [a.data[at[i] : at[i] + K] if i in sampled else None for i in range(len(kinds))] if sampled else [None] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(kinds.view(np.int64)), pa.array(n.astype(np.int64)), pa.array(shown, pa.binary())], names=["kind", "n", "gram"])

    return keyed.mapInArrow(run, "kind long, n long, gram binary")


def splitters(again: DataFrame, total: int, kinds: int) -> np.ndarray:
    """Grams that part all suffixes into ranges of about MERGE; a gram is never parted. Quantiles of a sample by hash."""
    parts = min(RANGES, -(-total // MERGE))
    every = GRAMS
    while kinds // every > 2 * SAMPLES * parts:
        every *= 2
    sample = again.where(F.col("gram").isNotNull() & (F.pmod("kind", F.lit(every)) == 0)).select("gram", "n").toArrow()  # some SAMPLES * RANGES rows
    order = np.argsort(got := np.array(sample.column("gram").to_pylist(), f"S{K}"), kind="stable")
    if parts < 2 or not len(order):
        return np.zeros(0, f"S{K}")
    upto = np.cumsum(sample.column("n").to_numpy()[order])
    return np.unique(got[order][np.searchsorted(upto, np.arange(1, parts) * upto[-1] / parts)])


def crowded(again: DataFrame, total: int) -> tuple[np.ndarray, int]:
    """Hashes of the grams that too many suffixes start with, at most RANGES of them, and how many suffixes those are."""
    rows = again.where(F.col("n") > max(CROWD, total // RANGES)).select("kind", "n").toArrow()
    return rows.column("kind").to_numpy().view(np.uint64), int(rows.column("n").to_numpy().sum())


def taken_apart(a: Anchors, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, before, after, hash) for each STEP places where strings of these anchors start. All strings of one entry hold the bytes
    that the hash is of, and equal strings have equal hashes; so entries of a crowded gram need not meet in one task."""
    high, low = a.at[rows] - a.low[rows], a.at[rows] - a.high[rows]
    out = []
    for first in range(0, LEFT + 1, STEP):
        last = min(first + STEP - 1, LEFT)
        own = np.flatnonzero((high >= first) & (low <= last))
        out.append((rows[own], np.minimum(high[own], last), SPAN - np.maximum(low[own], first), a.hashes(a.at[rows[own]] - first, first + SPAN - last)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def shared_with_last(lines: np.ndarray) -> np.ndarray:
    """The prefix that each line shares with the one before."""
    differ = lines[1:] != lines[:-1]
    return np.concatenate([[0], np.where(differ.any(1), differ.argmax(1), LINE)])[: len(lines)].astype(np.uint8)


def sort_run(lines: np.ndarray, numbers: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lines, numbers, more) of a run in order, without lines that equal one of an earlier place; and those places' strings, as
    rows of (did, mark, first start, last start)."""
    order = np.lexsort((numbers[:, 2], numbers[:, 1], numbers[:, 0]))
    order = order[np.argsort(np.ascontiguousarray(lines[order]).view(f"S{LINE}").ravel(), kind="stable")]
    lines, numbers, more = lines[order], numbers[order], more[order]
    leads = shared_with_last(lines) < LINE
    leader = np.maximum.accumulate(np.where(leads, np.arange(len(lines)), 0))
    later = np.flatnonzero((numbers != numbers[leader]).any(1))
    gone = np.stack([numbers[later, 0], numbers[later, 1], numbers[later, 2] - lines[later, -2], numbers[later, 2] + lines[later, -1].astype(np.int64) - SPAN], axis=1)
    return lines[leads], numbers[leads], more[leads], gone


def code_run(lines: np.ndarray, numbers: np.ndarray, common: np.ndarray) -> bytes:
    """A front-coded run: how many lines, what each shares with the one before, their numbers, and the rests of the lines."""
    common = common.copy()
    common[:1] = 0
    rests = lines[np.arange(LINE) >= common[:, None]].tobytes()
    return zstandard.ZstdCompressor(level=1).compress(len(lines).to_bytes(4, "little") + common.tobytes() + np.ascontiguousarray(numbers.T).tobytes() + rests)


def shared_prefix(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, given that ``known`` bytes are common; bytes are looked at in halves, in C."""
    low, high = known, min(len(a), len(b))
    if a[low:high] == b[low:high]:
        return high
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def read_run(blob: bytes) -> Iterator[tuple[int, bytes, tuple[int, int, int]]]:
    """(common prefix with the line before, line, numbers) of a front-coded run."""
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int.from_bytes(raw[:4], "little")
    numbers, at = np.frombuffer(raw, np.int64, 3 * n, 4 + n).reshape(3, n).T.tolist(), 4 + 25 * n
    before = b""
    for c, who in zip(raw[4 : 4 + n], map(tuple, numbers), strict=True):
        before = before[:c] + raw[at : at + LINE - c]
        at += LINE - c
        yield c, before, who


class LoserTree:
    """Merges sorted runs. Each loser keeps its common prefix with the line that beat it, so that a line that comes up
    again is compared only from the first byte on that is not yet known."""

    def __init__(self, runs: list[Iterator]):
        self.runs = runs
        self.size = 1
        while self.size < max(1, len(runs)):
            self.size *= 2
        self.heads: list = [next(r, None) for r in runs] + [None] * (self.size - len(runs))
        self.common = [0] * self.size  # with the last line that was given out, or with the one that beat it
        self.lost = [0] * self.size
        self.winner = self._build(1)

    def _build(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        a, b = self._build(2 * node), self._build(2 * node + 1)
        w, self.lost[node] = self._play(a, b)
        return w

    def _play(self, a: int, b: int) -> tuple[int, int]:
        """(winner, loser), both having a known common prefix with the same smaller line."""
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        p, q = self.common[a], self.common[b]
        if p != q:  # the one that shares more with the smaller line is smaller; the loser's known prefix holds
            return (a, b) if p > q else (b, a)
        n = shared_prefix(x[1], y[1], p)
        if n == len(x[1]):
            w, lost = (a, b) if x[2] <= y[2] else (b, a)
        else:
            w, lost = (a, b) if x[1][n] < y[1][n] else (b, a)
        self.common[lost] = n
        return w, lost

    def __iter__(self) -> Iterator[tuple[int, bytes, tuple]]:
        """(common prefix with the line before, line, what goes with it) in order."""
        heads, common, lost, size, play = self.heads, self.common, self.lost, self.size, self._play
        while (head := heads[self.winner]) is not None:
            w = self.winner
            yield common[w], head[1], head[2]
            after = next(self.runs[w], None)
            heads[w] = after
            common[w] = after[0] if after else 0
            node = (w + size) // 2
            while node:
                # losers on this path were beaten by the line just given out, so their prefixes refer to it, too
                w, lost[node] = play(w, lost[node])
                node //= 2
            self.winner = w


def equal_later(common: np.ndarray, lines: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Rows (did, mark, start) of the strings that equal an earlier one, from merged lines: common prefixes with the line before,
    and (did, mark, at). Rows of one place are neither earlier nor later."""
    n = len(common)
    at, high, low = numbers[:, 2], lines[:, -2].astype(np.int64), SPAN - lines[:, -1].astype(np.int64)
    order = np.lexsort((at, numbers[:, 1], numbers[:, 0]))
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(np.concatenate([[False] * bool(n), (numbers[order][1:] != numbers[order][:-1]).any(1)]))
    after = np.append(common[1:], 0)
    before, out = np.zeros(n, np.uint64), []
    for j in range(LEFT + 1):
        if j:
            before = before * np.uint64(_M) + _BYTES[lines[:, SPAN + j - 1]]
        need = SPAN - j
        use = np.flatnonzero((low <= j) & (j <= high) & ((common >= need) | (after >= need)))
        if len(use) < 2:
            continue
        # lines that share ``need`` bytes are neighbours; among them the bytes before tell strings apart
        key = mix(before[use] + np.cumsum(common < need)[use].astype(np.uint64) * np.uint64(_INV))
        order = np.lexsort((rank[use], key))
        same = np.concatenate([[False], key[order[1:]] == key[order[:-1]]])
        first = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
        later = use[order[rank[use][order] > rank[use][order[first]]]]
        out.append(np.stack([numbers[later, 0], numbers[later, 1], at[later] - j], axis=1))
    return np.concatenate(out) if out else np.zeros((0, 3), np.int64)


def covered(x: np.ndarray) -> np.ndarray:
    """did, mark, low, high: the bytes that strings cover, in maximal runs; rows are (did, mark, first start, last start)."""
    x = x[np.lexsort(x.T[::-1])]
    if not len(x):
        return x
    place = np.concatenate([[0], np.cumsum((x[1:, :2] != x[:-1, :2]).any(1))])
    # the furthest end so far, within each text
    wide = int(x[:, 3].max()) + SPAN + 1
    end = np.maximum.accumulate(place * wide + x[:, 3] + SPAN) - place * wide
    new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (x[1:, 2] > end[:-1])]))
    last = np.append(new[1:], len(x)) - 1
    return np.stack([x[new, 0], x[new, 1], x[new, 2], end[last]], axis=1)


_SPANS = ("did", "mark", "low", "high")


def sorted_runs(keyed: DataFrame, wanted, cuts: np.ndarray, hot: np.ndarray, crowds: int) -> DataFrame:
    """part, run, spans: pieces of sorted, front-coded runs, a part having all suffixes between two splitters, or all that a crowded
    gram's hash deals to one of ``crowds`` parts of its own; spans are what a run itself shows to stand earlier, as four longs each."""

    def flush(held: list[tuple[np.ndarray, ...]]):
        *run, dealt = (np.concatenate(x) for x in zip(*held, strict=True))
        lines, numbers, dealt, gone = sort_run(*run, dealt)
        to = np.where(dealt >= 0, -1 - dealt, np.searchsorted(cuts, np.ascontiguousarray(lines[:, :K]).view(f"S{K}").ravel(), side="right"))
        order = np.argsort(to, kind="stable")
        lines, numbers, to = lines[order], numbers[order], to[order]
        common = shared_with_last(lines)
        ends = [0, *(np.flatnonzero(np.diff(to)) + 1).tolist(), len(to)]
        pieces = list(zip(ends, ends[1:], strict=False))
        spans = [covered(gone).tobytes()] + [b""] * (len(pieces) - 1)
        return pa.RecordBatch.from_arrays([pa.array([int(to[i]) for i, _ in pieces], pa.int64()), pa.array([code_run(lines[i:k], numbers[i:k], common[i:k]) for i, k in pieces], pa.binary()), pa.array(spans, pa.binary())], names=["part", "run", "spans"])

    def run(batches):
        held, n = [], 0
        for dids, marks, offsets, texts in _chunks(batches, CHUNK):
            a = Anchors(texts)
            kinds = a.kinds()
            hit = np.flatnonzero(wanted.many(kinds.view(np.int64)))
            many = np.isin(kinds[hit], hot)
            calm = hit[~many]
            apart, before, after, sums = taken_apart(a, hit[many])
            every = np.concatenate([calm, apart])
            before = np.concatenate([a.at[calm] - a.low[calm], before])
            after = np.concatenate([a.high[calm] - a.at[calm] + SPAN, after])
            dealt = np.concatenate([np.full(len(calm), -1, np.int64), (sums % np.uint64(crowds)).astype(np.int64)])
            for at in range(0, len(every), RUN):
                part = slice(at, at + RUN)
                rows = every[part]
                doc = a.doc[rows]
                held.append((a.lines(rows, before[part], after[part]), np.stack([np.array(dids, np.int64)[doc], np.array(marks, np.int64)[doc], a.at[rows] - a.starts[doc] + np.array(offsets, np.int64)[doc]], axis=1), dealt[part]))
                n += len(rows)
                if n >= RUN:
                    yield flush(held)
                    held, n = [], 0
        if held:
            yield flush(held)

    return keyed.mapInArrow(run, "part long, run binary, spans binary")


def merge_runs(runs: DataFrame) -> DataFrame:
    """did, mark, low, high: what strings cover that stand earlier."""

    def run(group: pa.Table) -> pa.Table:
        common, lines, numbers = bytearray(), [], []
        for c, line, who in LoserTree([read_run(b) for b in group.column("run").to_pylist()]):
            common.append(min(c, SPAN))
            lines.append(line)
            numbers.append(who)
        table = np.frombuffer(b"".join(lines), np.uint8).reshape(len(lines), LINE)
        later = equal_later(np.frombuffer(common, np.uint8).astype(np.int64), table, np.array(numbers, np.int64).reshape(-1, 3))
        known = np.frombuffer(b"".join(group.column("spans").to_pylist()), np.int64).reshape(-1, 4)
        spans = np.concatenate([covered(np.concatenate([later, later[:, 2:]], axis=1)), known])
        return pa.table({c: np.ascontiguousarray(spans[:, i]) for i, c in enumerate(_SPANS)})

    return runs.groupBy("part").applyInArrow(run, ", ".join(f"{c} long" for c in _SPANS))


def places(docs: DataFrame) -> DataFrame:
    """docs with did, a number in the order of doc_id (null: the largest long), and mark, a hash of the text."""
    kind = docs.schema["doc_id"].dataType.typeName()
    if kind in ("long", "integer", "short", "byte"):
        numbered = docs.withColumn("did", F.col("doc_id").cast("long"))
    else:
        ids = global_rank(docs.select("doc_id").where("doc_id IS NOT NULL").distinct(), "doc_id", name="did")
        numbered = docs.join(ids, "doc_id", "left")
    return numbered.withColumn("did", F.coalesce("did", F.lit((1 << 63) - 1))).withColumn("mark", F.coalesce(F.xxhash64("text"), F.lit(0)))


def repeats(keyed: DataFrame) -> DataFrame:
    """did, mark, low, high: byte ranges to remove."""
    keyed = keyed.select("did", "mark", F.coalesce("text", F.lit("")).alias("text"))
    again = durable(grams(keyed).groupBy("kind").agg(F.sum("n").alias("n"), F.max("gram").alias("gram")).where("n > 1"), "grams")
    sizes = again.agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).first()
    if not sizes.kinds:
        return keyed.sparkSession.createDataFrame([], ", ".join(f"{c} long" for c in _SPANS))
    hot, held = crowded(again, sizes.n)
    return merge_runs(sorted_runs(keyed, maybe(again, "kind"), splitters(again, sizes.n, sizes.kinds), hot, 1 + held * STEP // MERGE))


def remove(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes).

    Null texts count as empty; texts of under SPAN bytes lose nothing; of rows with one doc_id and one text neither is
    earlier; texts under one doc_id that differ stand in the order of a hash; rows without an id stand last. Ids that are not whole
    numbers are taken in their order. Other columns are ignored; no rows give no rows.
    """
    docs = docs.select("doc_id", "text")
    with scratch(docs.sparkSession):
        spans = durable(repeats(places(docs)).groupBy("did", "mark").agg(F.collect_list(F.struct("low", "high")).alias("spans")), "spans", keep=True)
    joined = places(docs).join(spans, ["did", "mark"], "left").select("doc_id", "text", "spans")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sizes, removed, runs, kept = [], [], [], []
                for t, spans in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    data = t.encode("utf-8", "surrogatepass") if t else b""
                    keep, gone, n, end = [], 0, 0, -1
                    upto = 0
                    for x in sorted((x["low"], x["high"]) for x in spans or ()):
                        if x[0] > end:
                            keep.append(data[upto : x[0]])
                            n += 1
                            gone += x[1] - x[0]
                            end = upto = x[1]
                        elif x[1] > end:
                            gone += x[1] - end
                            end = upto = x[1]
                    sizes.append(len(data))
                    removed.append(gone)
                    runs.append(n)
                    kept.append(b"".join([*keep, data[upto:]]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return joined.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    return remove(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def by_hand(texts: dict[int, str]) -> dict[int, tuple[int, int, int, str]]:
    """The same by a table of all strings, for small inputs."""
    seen: set[bytes] = set()
    out = {}
    for d in sorted(texts):
        data = (texts[d] or "").encode()
        gone = np.zeros(len(data) + 1, bool)
        for s in range(len(data) - SPAN + 1):
            x = data[s : s + SPAN]
            if x in seen:
                gone[s : s + SPAN] = True
            seen.add(x)
        kept = bytes(np.frombuffer(data, np.uint8)[~gone[:-1]])
        out[d] = (len(data), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out
