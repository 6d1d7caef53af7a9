"""Best-fit packing of token sequences with a swap-based local search.

A piece is at most CAPACITY tokens long, so how many pieces there are of each length is all that packing needs: a
histogram of at most CAPACITY numbers, whatever the size of the corpus. Bins with the same contents are one pattern
with a count. Best fit fills patterns longest piece first; local search then moves or exchanges pieces between
patterns (one for none, one for one, two for one) whenever that raises the sum of squared fills, which drains the
emptier bins until they vanish. The patterns' slots are numbered, and the n-th piece of a length takes the n-th slot
for that length, by a rank that is counted in parts.
"""

from __future__ import annotations

import functools
import heapq
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridlight.llm.common import durable, map_rows

CAPACITY = 1024
END = 2
#: Entries of a worker's table of known words, at most; beyond it, words are encoded anew.
KNOWN = 400_000
SPLIT = re.compile(r"  |\s \s")


@functools.lru_cache(maxsize=2)
def encoder(vocabulary: str | None):
    """A function from texts to their ids, each as little-endian unsigned 32-bit bytes without END.

    Byte-level vocabularies part a text at every space that stands before a word, so texts are encoded space by space
    from a table of known words, and all unknown words of a call in one go; texts with runs of white space that such
    a split would part are encoded whole. Special tokens' strings in a text are left to the tokenizer itself.
    """
    import json

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    path = vocabulary or public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
    rough = re.compile("|".join(map(re.escape, special)) or r"(?!)")
    slow = Tokenizer.from_file(path)
    byte = _unicode_bytes()
    ranks = {bytes(byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    fast = tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    spaced = np.zeros(max(ranks.values()) + 1, dtype=bool)
    spaced[[i for b, i in ranks.items() if b[:1] == b" "]] = True
    known: dict[str, bytes] = {}

    def whole(text: str) -> bytes:
        return np.array(fast.encode_ordinary(text), dtype="<u4").tobytes()

    def learn(words: list[str]) -> dict[str, bytes]:
        """The ids of each word with a space before it."""
        plain = [w for w in words if w and not w[0].isspace() and not w[-1].isspace()]
        ids = np.array(fast.encode_ordinary("".join([f" {w}" for w in plain])), dtype="<u4")
        starts = np.flatnonzero(spaced[ids])
        if len(starts) != len(plain):
            return {w: whole(f" {w}") for w in words}
        ends = np.append(starts[1:], len(ids))[: len(starts)]
        raw, out = ids.tobytes(), {w: whole(f" {w}") for w in set(words).difference(plain)}
        out |= {w: raw[4 * a : 4 * b] for w, a, b in zip(plain, starts.tolist(), ends.tolist(), strict=True)}
        return out

    def encode(texts: list[str]) -> list[bytes]:
        hard = {i for i, t in enumerate(texts) if SPLIT.search(t) or rough.search(t)}
        words = {i: t.split(" ") for i, t in enumerate(texts) if i not in hard}
        new = set().union(*(w[1:] for w in words.values())).difference(known) if words else set()
        fresh = learn(list(new)) if new else {}
        if len(known) < KNOWN:
            known.update((w, ids) for w, ids in fresh.items() if len(w) < 40)
        get = lambda w: known.get(w) or fresh[w]
        out = []
        for i, t in enumerate(texts):
            if i in hard:
                out.append(np.array(slow.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() if rough.search(t) else whole(t))
            else:
                first, *rest = words[i]
                out.append(b"".join([whole(first) if first else b"", *map(get, rest)]))
        return out

    return encode


def _unicode_bytes() -> dict[str, int]:
    """The printable character by which byte-level vocabularies write each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {chr(b): b for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in set(plain)):
        out[chr(256 + n)] = b
    return out


def cut_points(n: int, capacity: int = CAPACITY) -> list[int]:
    """Where the pieces of n tokens start: only the first may be shorter than capacity."""
    first = n % capacity
    return [*([0] if first else []), *range(first, n, capacity)]


def pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """key, piece, start, length, ids_crc32 of every piece; texts are encoded whole, null as empty."""

    def make(cols: list[list]) -> list[list]:
        encode, end = encoder(vocabulary), END.to_bytes(4, "little")
        out: list[tuple] = []
        for k, encoded in zip(cols[0], encode([t or "" for t in cols[1]]), strict=True):
            ids = memoryview(encoded + end)
            starts = cut_points(len(ids) // 4, capacity)
            for p, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids) // 4], strict=True)):
                out.append((k, p, a, b - a, zlib.crc32(ids[4 * a : 4 * b])))
        return list(map(list, zip(*out, strict=True))) if out else [[]] * 5

    return map_rows(docs.select(key, text), make, f"`{key}` {docs.schema[key].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


Pattern = tuple[int, ...]


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> Counter[Pattern]:
    """Patterns by best fit, longest pieces first: a piece goes to the fullest bin that still takes it, or else to a new one.

    A bin that takes a piece stays the fullest that fits for as long as it takes another of that length, so bins with the same
    contents are filled alike, and a length adds two patterns or so for each room it meets.
    """
    bins: dict[int, Counter[Pattern]] = {}
    for size in sorted((n for n, c in counts.items() if c > 0), reverse=True):
        left, rooms = counts[size], sorted(r for r in bins if r >= size)
        while left:
            room = rooms[0] if rooms else capacity
            pattern, have = max(bins[room].items()) if rooms else ((), left)
            each = min(room // size, left)
            n = min(have, left // each)
            if rooms:
                bins[room][pattern] -= n
                if not bins[room][pattern]:
                    del bins[room][pattern]
                if not bins[room]:
                    del bins[room]
                    rooms.pop(0)
            after = room - each * size
            bins.setdefault(after, Counter())[(*pattern, *[size] * each)] += n
            if after >= size and after not in rooms:
                rooms.insert(0, after)
            left -= n * each
    return Counter({p: n for group in bins.values() for p, n in group.items()})


class _Search:
    """Underfull bins that may take a piece: per pattern the lengths it can give back, laid end to end."""

    def __init__(self, bins: Counter[Pattern], capacity: int):
        self.capacity = capacity
        self.order: list[Pattern] = []
        self.at: dict[Pattern, int] = {}
        self.room, self.back, self.owner, self.live = (np.zeros(0, np.int64) for _ in range(4))
        self.add([p for p in bins if sum(p) < capacity])

    def add(self, patterns: list[Pattern]) -> None:
        new = [p for p in dict.fromkeys(patterns) if p not in self.at]
        backs = [(0, *dict.fromkeys(p)) for p in new]
        sizes = list(map(len, backs))
        owner = np.repeat(np.arange(len(self.order), len(self.order) + len(new)), sizes)
        self.at |= {p: len(self.order) + k for k, p in enumerate(new)}
        self.order += new
        self.back = np.concatenate([self.back, np.array([x for b in backs for x in b], np.int64)])
        self.room = np.concatenate([self.room, np.repeat(np.array([self.capacity - sum(p) for p in new], np.int64), sizes)])
        self.owner = np.concatenate([self.owner, owner])

    def exchange(self, poor: Pattern, bins: Counter[Pattern]):
        """(rich pattern, pieces given, pieces taken) that fills an underfull bin as much as any, a full bin before all; or None."""
        if len(self.order) > 2 * len(bins) + 64:  # patterns that no bin has any more
            self.__init__(bins, self.capacity)
        have = np.array([bins[p] for p in self.order], np.int64)
        if poor in self.at:
            have[self.at[poor]] -= 1
        rows = np.flatnonzero((have[self.owner] > 0) & (self.room <= self.capacity - sum(poor)))
        if not len(rows):
            return None
        room, back = self.room[rows], self.back[rows]
        gifts: dict[tuple[int, bool], Pattern] = {(a, False): (a,) for a in dict.fromkeys(poor)}
        gifts |= {(a + b, True): (a, b) for i, a in enumerate(poor) for b in dict.fromkeys(poor[i + 1 :])}
        best, found = 0, None
        for (total, two), given in gifts.items():
            more = total - back
            gain = np.where((more > 0) & (more <= room) & ((back > 0) | (not two)), more + (more == room) * self.capacity, 0)
            k = int(gain.argmax())
            if gain[k] > best:
                best, found = int(gain[k]), (self.order[self.owner[rows[k]]], given, (int(back[k]),) if back[k] else ())
            if best > self.capacity:
                break
        return found


def improve(bins: Counter[Pattern], capacity: int = CAPACITY) -> Counter[Pattern]:
    """Local search on patterns: the emptier of two underfull bins gives the fuller one a piece, or one or two pieces for a
    shorter one, whenever that raises the sum of squared fills; emptied bins vanish. Exchanges that fill the fuller
    bin most come first, and bins with the same contents change together. It ends when no pair of bins has such an exchange, or
    when no packing can have fewer bins."""
    bins = Counter({p: n for p, n in bins.items() if n > 0})
    least = -(-sum(sum(p) * n for p, n in bins.items()) // capacity)
    search, total, changed = _Search(bins, capacity), sum(bins.values()), True
    while changed and total > least:
        changed = False
        todo = [(sum(p), p) for p in search.order if bins[p] > 0]
        heapq.heapify(todo)
        while todo and total > least:
            _, poor = heapq.heappop(todo)
            if bins[poor] <= 0 or not (found := search.exchange(poor, bins)):
                continue
            rich, give, take = found
            n = min(bins[poor], bins[rich]) if rich != poor else bins[poor] // 2
            new_rich, new_poor = list(rich), list(poor)
            for x in give:
                new_poor.remove(x)
                new_rich.append(x)
            for x in take:
                new_rich.remove(x)
                new_poor.append(x)
            bins[poor] -= n
            bins[rich] -= n
            made = [tuple(sorted(x, reverse=True)) for x in (new_rich, new_poor) if x]
            for p in made:
                bins[p] += n
            total -= n * (2 - len(made))
            search.add([p for p in made if sum(p) < capacity])
            for p in {poor, *made}:
                if sum(p) < capacity and bins[p] > 0:
                    heapq.heappush(todo, (sum(p), p))
            changed = True
    return Counter({p: n for p, n in bins.items() if n > 0})


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[Pattern, int]]:
    """Patterns and how many bins have each, in a fixed order."""
    return sorted(improve(best_fit(counts, capacity), capacity).items(), reverse=True)


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32, sequence_id and offset, the place in its sequence.

    Null and empty texts are one piece of END alone; repeated rows are packed each; no rows give no rows; other columns
    are ignored. ``vocabulary`` is the path of a byte-level BPE file in the tokenizers format on every node.
    """
    spark = docs.sparkSession
    cut = durable(pieces(docs, key, text, capacity, vocabulary), "pieces")
    counts = {r.length: r["count"] for r in cut.groupBy("length").count().collect()}  # at most capacity rows
    slots, first, taken = [], 0, Counter()
    for pattern, n in plan(counts, capacity):
        offset = 0
        for size, same in Counter(pattern).items():
            # pieces number taken .. taken + n * same of this length fill these n bins, same in each
            slots.append((size, taken[size], taken[size] + n * same, same, first, offset))
            taken[size] += n * same
            offset += size * same
        first += n
    table = spark.createDataFrame(slots, "length long, lo long, hi long, same long, first long, base long")  # bounded by capacity, not by documents
    part = F.spark_partition_id()
    ranked = durable(cut.withColumn("part", part).withColumn("in_part", F.row_number().over(Window.partitionBy("part", "length").orderBy(key, "piece", "ids_crc32")) - 1), "ranked")
    sums = ranked.groupBy("length", "part").count()
    before = sums.select("length", "part", (F.sum("count").over(Window.partitionBy("length").orderBy("part")) - F.col("count")).alias("before"))
    placed = ranked.join(before, ["length", "part"]).withColumn("rank", F.col("in_part") + F.col("before"))
    spans = placed.join(table, "length").where("rank >= lo AND rank < hi")
    within = F.col("rank") - F.col("lo")
    return spans.select(
        key, "piece", "start", "length", "ids_crc32",
        (F.col("first") + F.floor(within / F.col("same"))).cast("long").alias("sequence_id"),
        (F.col("base") + (within % F.col("same")) * F.col("length")).cast("long").alias("offset"),
    )
