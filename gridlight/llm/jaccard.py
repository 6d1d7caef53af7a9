"""N-gram Jaccard join with signature trees.

A document is the set of hashes of its word shingles. Tree nodes hold the bitmaps of the sets below them, combined by
OR, and their range of sizes; a pair of nodes is followed only if the largest overlap that both allow can reach the
threshold. Two levels of the join are distributed:

- Sets with the same smallest hash meet in blocks of bounded size; a tree over each block finds their links, passing
  over nodes that are already connected, and leaves one component per family of near copies.
- Every set is also listed under the first hashes of its prefix, of which two similar sets share some, with its size and how many
  hashes it has left there. Each set is first tried with one hub per hash and size, so that families that a crowd hides become
  one component. Then, under each hash, sets of different components meet through cells that hold ranges of both numbers.
  Pairs that meet often enough are taken to nodes with combined bitmaps, and pairs of nodes that survive the bound are followed
  to their sets. Sets that survive it again are compared hash by hash.

Prefixes put hashes that very many documents share last, so that a common passage brings no crowd together: where two sets share
a passage and little else, their first common hash leaves too few behind it. That order is read off a table of fixed size; any
order gives the same links.
"""

from __future__ import annotations

import functools
import math
import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from gridlight.llm.common import durable, release, scratch
from gridlight.llm.links import components

SHINGLE = 5
#: Links need 100 * overlap >= 75 * union, that is 7 * overlap >= 3 * (size + size).
NUM, DEN = 3, 7
#: Bitmaps have 64 * LONGS bits. Counters of the table of common hashes. Members of a block, of a leaf, children of a node.
LONGS, COUNTERS, BLOCK, LEAF, FAN = 32, 1 << 20, 512, 8, 8
#: Cells that sizes which can be linked are divided into. One hash in so many is counted to tell pairs that meet often.
GRID, TIMES = 4, 20
#: A hash counts as common from so many documents on, and from one in so many. Set ids that a task remembers so as not to send
#: a set twice.
COMMON, SHARE, KEPT = 64, 100_000, 300_000
_M = np.uint64(0x9E3779B97F4A7C15)


def slice_sets(texts: list[str | None], size: int = SHINGLE) -> list[np.ndarray]:
    """Per text its distinct shingle hashes, ascending; A-Z are lowered, words parted at ASCII white space."""
    words = [t.encode("utf-8", "surrogatepass").lower().split() if t else [] for t in texts]
    h = np.fromiter((xxhash.xxh3_64_intdigest(w) for ws in words for w in ws), np.uint64, sum(map(len, words)))
    n = max(0, len(h) - size + 1)
    mixed = h[:n].copy()
    for k in range(1, size):
        mixed = mixed * _M + h[k : n + k]
    mixed ^= mixed >> np.uint64(32)
    mixed *= _M
    mixed ^= mixed >> np.uint64(29)
    out, at = [], 0
    for ws in words:
        if len(ws) >= size:
            out.append(np.unique(mixed[at : at + len(ws) - size + 1]))
        else:
            out.append(np.array([xxhash.xxh3_64_intdigest(b" ".join(ws), seed=len(ws))] if ws else [], dtype=np.uint64))
        at += len(ws)
    return out


def set_id(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def prefix_length(n: int) -> int:
    return n - -(-3 * n // 4) + 1


def bitmap(s: np.ndarray) -> np.ndarray:
    bits = np.zeros(64 * LONGS, dtype=np.uint8)
    bits[(s >> np.uint64(40)) % np.uint64(64 * LONGS)] = 1
    return np.packbits(bits).view(np.uint64)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    if NUM * (len(a) + len(b)) > DEN * min(len(a), len(b)):
        return False
    return DEN * len(np.intersect1d(a, b, assume_unique=True)) >= NUM * (len(a) + len(b))


class _Node:
    __slots__ = ("bits", "children", "high", "low", "members", "one", "slack")

    def __init__(self, members: list[int], children: list[_Node], bits: np.ndarray, low: int, high: int, slack: int):
        self.members, self.children, self.bits, self.low, self.high, self.slack = members, children, bits, low, high, slack
        self.one = len(members) == 1


class SignatureTree:
    """A tree over sets in the order of their sizes; links() joins it with itself."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        order = sorted(range(len(sets)), key=lambda i: (len(sets[i]), sets[i][:1].tolist()))
        level = []
        for i in order:
            bits = bitmap(sets[i])
            level.append(_Node([i], [], bits, len(sets[i]), len(sets[i]), len(sets[i]) - int(np.bitwise_count(bits).sum())))
        fan = LEAF
        while len(level) > 1:
            level = [self._join(level[k : k + fan]) for k in range(0, len(level), fan)]
            fan = FAN
        self.root = level[0] if level else None
        self.parent = list(range(len(sets)))

    @staticmethod
    def _join(nodes: list[_Node]) -> _Node:
        if len(nodes) == 1:
            return nodes[0]
        bits = functools.reduce(operator.or_, (x.bits for x in nodes))
        return _Node([m for x in nodes for m in x.members], nodes, bits, min(x.low for x in nodes), max(x.high for x in nodes), max(x.slack for x in nodes))

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def _connected(self, node: _Node) -> bool:
        if not node.one:
            root = self.find(node.members[0])
            node.one = all(self.find(m) == root for m in node.members)
        return node.one

    @staticmethod
    def may_link(x: _Node, y: _Node) -> bool:
        """Whether the largest overlap of a set in x with one in y can reach the threshold: an overlapping hash sets a bit
        in both bitmaps, and a set has as many more hashes than bits as its slack says."""
        if 4 * min(x.high, y.high) < 3 * max(x.low, y.low):
            return False
        most = min(int(np.bitwise_count(x.bits & y.bits).sum()) + min(x.slack, y.slack), x.high, y.high)
        return DEN * most >= NUM * (x.low + y.low)

    def links(self) -> list[int]:
        """Per set the first set of its component."""
        stack = [(self.root, self.root)] if self.root else []
        while stack:
            x, y = stack.pop()
            if x is y:
                kids = x.children
                stack += [(a, b) for k, a in enumerate(kids) for b in kids[k + 1 :]]
                stack += [(a, a) for a in kids if a.children]  # popped first: what is connected within is passed over across
                continue
            if self._connected(x) and self._connected(y) and self.find(x.members[0]) == self.find(y.members[0]):
                continue
            if not self.may_link(x, y):
                continue
            if not x.children and not y.children:
                if linked(self.sets[x.members[0]], self.sets[y.members[0]]):
                    self.parent[self.find(x.members[0])] = self.find(y.members[0])
            elif not y.children or x.children and len(x.members) >= len(y.members):
                stack += [(a, y) for a in x.children]
            else:
                stack += [(x, b) for b in y.children]
        return [self.find(i) for i in range(len(self.sets))]


def _texts(batches: Iterator[pa.RecordBatch], rows: int = 256):
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            yield part.column(0), slice_sets(part.column(1).to_pylist())


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, arrays)])
    values = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values.view(np.int64)))


def survey(docs: DataFrame) -> DataFrame:
    """Per document doc_id, n, sid (id of its set) and least (its smallest hash), and rows with only counter and seen:
    how many documents of a task have a hash under that counter, where that is clearly more than chance."""
    kind, arrow = docs.schema["doc_id"].dataType.simpleString(), to_arrow_type(docs.schema["doc_id"].dataType)

    def run(batches):
        counts = np.zeros(COUNTERS, np.int64)
        for ids, sets in _texts(batches):
            if sets:
                at, c = np.unique(np.concatenate(sets) & np.uint64(COUNTERS - 1), return_counts=True)
                counts[at.astype(np.int64)] += c
            n = len(sets)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([len(s) for s in sets], pa.int64()), pa.array([set_id(s) if len(s) else None for s in sets], pa.int64()), pa.array([int(s[0].view(np.int64)) if len(s) else None for s in sets], pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())],
                names=["doc_id", "n", "sid", "least", "counter", "seen"],
            )
        mean = counts.mean()
        at = np.flatnonzero(counts >= 3 + mean + 4 * np.sqrt(mean))
        none = pa.nulls(len(at), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.nulls(len(at), arrow), none, none, none, pa.array(at, pa.int64()), pa.array(counts[at], pa.int64())], names=["doc_id", "n", "sid", "least", "counter", "seen"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n long, sid long, least long, counter long, seen long")


S = [f"s{k}" for k in range(LONGS)]


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int, np.ndarray]]]:
    """(sid, set) of texts that have shingles; of the sets that a task remembers, each once."""
    seen: set[int] = set()
    for _, sets in _texts(batches):
        new = []
        for s in sets:
            sid = set_id(s)
            if len(s) and sid not in seen:
                new.append((sid, s))
                if len(seen) < KEPT:
                    seen.add(sid)
        yield new


def signatures(docs: DataFrame, common: np.ndarray) -> DataFrame:
    """Per set (once per task): sid, n, slack, prefix, early (how many hashes of the prefix are not common), s0.. (its bitmap)."""

    def run(batches):
        for new in _once(batches):
            prefixes, early, maps = [], [], []
            for _, s in new:
                late = common[(s & np.uint64(COUNTERS - 1)).astype(np.int64)]
                p = prefix_length(len(s))
                prefixes.append(s[:p] if not late[:p].any() else np.concatenate([s[~late], s[late]])[:p])
                early.append(min(p, len(s) - int(late.sum())))
                maps.append(bitmap(s))
            grid = np.array(maps, np.uint64).reshape(len(new), LONGS).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([x for x, _ in new], pa.int64()), pa.array([len(s) for _, s in new], pa.int64()), pa.array([len(s) - int(np.bitwise_count(m).sum()) for (_, s), m in zip(new, maps, strict=True)], pa.int64()),
                 _lists(prefixes), pa.array(early, pa.int32()), *[pa.array(np.ascontiguousarray(grid[:, k])) for k in range(LONGS)]],
                names=["sid", "n", "slack", "prefix", "early", *S],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "sid long, n long, slack long, prefix array<long>, early int" + "".join(f", {c} long" for c in S))


def whole_sets(docs: DataFrame, rows: DataFrame, needed: DataFrame) -> DataFrame:
    """sid, whole: all hashes of the sets in needed (sid), made again from the texts of one document per set; rows has doc_id and
    sid. A set may come more than once where documents share an id."""
    keys = rows.join(needed, "sid", "left_semi").groupBy("sid").agg(F.min(F.xxhash64("doc_id")).alias("key")).select("key").distinct()

    def run(batches):
        for _, sets in _texts(batches):
            full = [s for s in sets if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([set_id(s) for s in full], pa.int64()), _lists(full)], names=["sid", "whole"])

    texts = docs.select(F.xxhash64("doc_id").alias("key"), "text").join(keys, "key", "left_semi")
    return texts.select("key", "text").mapInArrow(run, "sid long, whole array<long>")


def families(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """a, b per set of a family: linked sets of one block have the same b."""
    sets = rows.where("sid IS NOT NULL").select("sid", "least").distinct()
    family = sets.groupBy("least").agg(F.count("*").alias("n")).where("n > 1")
    member = durable(sets.join(family, "least").select("sid", F.ceil(F.col("n") / BLOCK).alias("parts")), "family")
    whole = whole_sets(docs, rows, member.select("sid")).join(member, "sid")
    dealt = whole.select(F.element_at("whole", 1).alias("least"), F.pmod(F.xxhash64("sid"), "parts").alias("salt"), "sid", "whole")

    def run(group: pa.Table) -> pa.Table:
        ids, first = np.unique(group.column("sid").to_numpy(), return_index=True)
        lists = group.column("whole").combine_chunks()
        sets = [lists[int(i)].values.to_numpy().view(np.uint64) for i in first]
        roots = SignatureTree(sets).links()
        least: dict[int, int] = {}
        for i, r in zip(ids.tolist(), roots, strict=True):
            least[r] = min(i, least.get(r, i))
        return pa.table({"a": pa.array(ids, pa.int64()), "b": pa.array([least[r] for r in roots], pa.int64())})

    return dealt.groupBy("least", "salt").applyInArrow(run, "a long, b long")


def verify(pairs: DataFrame, docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs (x, y) of set ids that are linked, by all their hashes."""
    if pairs.isEmpty():
        return pairs
    needed = pairs.select(F.col("x").alias("sid")).union(pairs.select("y")).distinct()
    sets = durable(whole_sets(docs, rows, needed).join(needed, "sid", "left_semi").dropDuplicates(["sid"]), "sets")
    both = pairs.join(sets.select(F.col("sid").alias("x"), F.col("whole").alias("p")), "x").join(sets.select(F.col("sid").alias("y"), F.col("whole").alias("q")), "y")
    return both.where(DEN * F.size(F.array_intersect("p", "q")) >= NUM * (F.size("p") + F.size("q"))).select("x", "y")


def bound(x: str, y: str) -> Column:
    """May the sets or nodes in struct columns x and y have linked sets? As SignatureTree.may_link."""
    shared = functools.reduce(operator.add, (F.bit_count(F.col(f"{x}.{c}").bitwiseAND(F.col(f"{y}.{c}"))) for c in S))
    low, high = (lambda s: F.col(f"{s}.low")), (lambda s: F.col(f"{s}.high"))
    most = F.least(shared + F.least(F.col(f"{x}.slack"), F.col(f"{y}.slack")), high(x), high(y))
    return (4 * F.least(high(x), high(y)) >= 3 * F.greatest(low(x), low(y))) & (DEN * most >= NUM * (low(x) + low(y)))


def allowed(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (x, y) of nodes that pass the bound; nodes has node, low, high, slack and the bitmap."""
    full = lambda c: nodes.select(F.col("node").alias(c), F.struct("low", "high", "slack", *S).alias(f"node_{c}"))
    return pairs.join(full("x"), "x").join(full("y"), "y").where(bound("node_x", "node_y")).drop("node_x", "node_y")


def listing(sigs: DataFrame) -> DataFrame:
    """h, sid, n, rest of prefix hashes that more than one set has; of common hashes all, as they are known to be shared. rest
    counts a set's hashes from this one on, in the common order: two sets share no more from there on than the smaller rest."""
    rest = (F.col("n") - F.col("pos")).alias("rest")
    rare = sigs.select("sid", "n", F.posexplode(F.slice("prefix", F.lit(1), F.col("early"))).alias("pos", "h"))
    by = Window.partitionBy("h")
    rare = rare.select("h", "sid", "n", rest).withColumn("p", F.min("sid").over(by)).withColumn("q", F.max("sid").over(by)).where("p < q").drop("p", "q").distinct()
    late = sigs.where("early < size(prefix)").select("sid", "n", "early", F.posexplode(F.slice("prefix", F.col("early") + 1, F.size("prefix"))).alias("at", "h"))
    return rare.union(late.withColumn("pos", F.col("at") + F.col("early")).select("h", "sid", "n", rest).distinct())


def _placed(listed: DataFrame, roots: DataFrame) -> DataFrame:
    """listed with comp, the component that a set is in so far."""
    return listed.join(roots.select(F.col("node").alias("sid"), F.col("root").alias("comp")), "sid", "left").withColumn("comp", F.coalesce("comp", "sid"))


def band(n: str) -> Column:
    """Sets that can be linked are of one band or of neighbouring ones."""
    return F.floor(F.log(F.col(n)) / math.log(4 / 3)).cast("int")


#: With a = ceil(3 / 7 of both sizes), linked sets share a hashes or more. The k-th of them leaves a - k + 1 or more behind it in
#: both sets, itself included. So the first MOST of them stand in both prefixes, and MOST hashes of both leave a - MOST + 1.
MOST = f"least(floor(least(n_x, n_y) / {TIMES}) + 1, ceil({NUM} * (n_x + n_y) / {DEN}) - ceil(3 * greatest(n_x, n_y) / 4) + 1)"
MEETS = f"{DEN} * least(rest_x, rest_y) >= {NUM} * (n_x + n_y) - {DEN} * ({MOST} - 1)"
FIRST = f"{DEN} * least(rest_x, rest_y) >= {NUM} * (n_x + n_y)"


def _counted(met: DataFrame) -> DataFrame:
    """x, y, comp_x, comp_y, hits of the pairs that meet often enough to be linked; met has a row per pair and hash."""
    pairs = met.groupBy("x", "y", "comp_x", "comp_y").agg(F.count("*").alias("hits"), F.max(F.expr(FIRST)).alias("first"), F.first(F.expr(MOST)).alias("most"))
    return pairs.where("first AND hits >= most").drop("first", "most")


def _side(placed: DataFrame, c: str, *more: str) -> DataFrame:
    return placed.select("h", *more, F.col("sid").alias(c), *[F.col(k).alias(f"{k}_{c}") for k in ("n", "rest", "comp")])


def hubs(placed: DataFrame) -> DataFrame:
    """Pairs (x, y) to try first: under each hash, every set with the one of its size, and of the next smaller sizes, that
    has most left; of two components the pair that meets most often. Fewer than twice the places."""
    held = placed.withColumn("band", band("n"))
    best = held.groupBy("h", "band").agg(F.max(F.struct(F.col("rest") / F.col("n"), "sid", "n", "rest", "comp")).alias("hub")).select("h", "band", "hub.*")
    both = held.withColumn("band", F.explode(F.array("band", F.col("band") - 1)))
    met = _side(both, "x", "band").join(_side(best, "y", "band"), ["h", "band"]).where(f"comp_x <> comp_y AND {MEETS}")
    pairs = _counted(met).groupBy(F.least("comp_x", "comp_y").alias("p"), F.greatest("comp_x", "comp_y").alias("q"))
    return pairs.agg(F.max(F.struct("hits", "x", "y")).alias("e")).select("e.x", "e.y")


def meetings(placed: DataFrame) -> DataFrame:
    """All pairs (x, y) of sets of different components that meet under enough hashes for their sizes.

    Under a hash, sets stand in cells of similar size and rest. Cells are nodes that hold ranges of both, and pairs of cells that
    the ranges rule out are never opened; there are at most some hundred cells to a hash, however many sets it has.
    """
    fine = math.log(4 / 3) / GRID
    held = placed.withColumn("cell", F.struct(F.floor(F.log("n") / fine).alias("n"), F.floor(F.log("rest") / fine).alias("rest")))
    cells = held.groupBy("h", "cell").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max("rest").alias("rest"), F.min("comp").alias("p"), F.max("comp").alias("q"))
    crossed = cells.groupBy("h").agg(F.min("p").alias("p"), F.max("q").alias("q")).where("p < q").select("h")
    cells = cells.join(crossed, "h", "left_semi")
    side = lambda c: cells.select("h", *[F.col(k).alias(f"{k}_{c}") for k in ("cell", "low", "high", "rest", "p", "q")])
    may = f"{DEN} * least(rest_x, rest_y) + {DEN} * least(high_x, high_y) / {TIMES} >= {NUM} * (low_x + low_y) AND 4 * high_x >= 3 * low_y AND 4 * high_y >= 3 * low_x"
    open_ = side("x").join(side("y"), "h").where(f"cell_x <= cell_y AND NOT (p_x = q_y AND q_x = p_y) AND {may}").select("h", "cell_x", "cell_y")
    one = lambda c: _side(held.withColumnRenamed("cell", f"cell_{c}"), c, f"cell_{c}")
    both = open_.join(one("x"), ["h", "cell_x"]).join(one("y"), ["h", "cell_y"]).where(f"(cell_x < cell_y OR x < y) AND comp_x <> comp_y AND {MEETS}")
    swap = F.col("x") > F.col("y")
    two = lambda k: [F.when(swap, F.col(f"{k}y")).otherwise(F.col(f"{k}x")).alias(f"{k}x"), F.when(swap, F.col(f"{k}x")).otherwise(F.col(f"{k}y")).alias(f"{k}y")]
    return _counted(both.select(*two(""), *two("comp_"), *two("n_"), *two("rest_"))).select("x", "y")


def nodes_of(pairs: DataFrame, sets: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sid, node) of the sets in pairs, and the nodes above them: sets of one component and of similar size, FAN * 2 or so."""
    used = sets.join(pairs.select(F.col("x").alias("node")).union(pairs.select("y")).distinct(), "node", "left_semi").withColumnRenamed("node", "sid")
    member = used.join(roots.select(F.col("node").alias("sid"), "root"), "sid", "left").withColumn("comp", F.coalesce("root", "sid")).withColumn("band", band("low"))
    crowded = member.groupBy("comp", "band").agg(F.ceil(F.count("*") / (2 * FAN)).alias("parts"))
    member = member.join(crowded, ["comp", "band"]).withColumn("part", F.pmod(F.xxhash64("sid"), "parts"))
    nodes = durable(member.groupBy("comp", "band", "part").agg(F.min("sid").alias("node"), F.min("low").alias("low"), F.max("high").alias("high"), F.max("slack").alias("slack"), *[F.expr(f"bit_or({c})").alias(c) for c in S]), "nodes")
    return durable(member.select("sid", "comp", "band", "part").join(nodes.select("comp", "band", "part", "node"), ["comp", "band", "part"]).select("sid", "node"), "members"), nodes


def crossings(placed: DataFrame, sets: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs (x, y) of meetings() that bitmaps allow: pairs of nodes first, then the pairs of sets below those that remain."""
    met = durable(meetings(placed), "met")
    if met.isEmpty():
        return met
    members, nodes = nodes_of(met, sets, roots)
    above = met.join(members.select(F.col("sid").alias("x"), F.col("node").alias("p")), "x").join(members.select(F.col("sid").alias("y"), F.col("node").alias("q")), "y")
    above = durable(above, "above")
    good = allowed(above.select(F.col("p").alias("x"), F.col("q").alias("y")).distinct(), nodes)
    below = above.join(good.select(F.col("x").alias("p"), F.col("y").alias("q")), ["p", "q"], "left_semi").select("x", "y")
    return allowed(below, sets)


def join(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (the smallest doc_id that links reach).

    Null and empty texts have no shingles and no links: their component is their own id. Rows with equal sets are linked;
    rows without an id link others, but give no component its id. Other columns are ignored; no rows give no rows.
    Sets are told apart, and shingles compared, by 64-bit hashes.
    """
    with scratch(docs.sparkSession):
        return durable(_join(docs.select("doc_id", "text")), "components", keep=True)


def common_counters(seen: DataFrame) -> np.ndarray:
    """Counters of hashes that very many documents have: at least COMMON, and one in SHARE documents. A counter also counts what
    tasks find by chance, which that share keeps out however many tasks there are."""
    common = np.zeros(COUNTERS, bool)
    least = max(COMMON, seen.where("n IS NOT NULL").count() // SHARE)
    for r in seen.where("n IS NULL").groupBy("counter").agg(F.sum("seen").alias("seen")).where(F.col("seen") >= least).toLocalIterator():
        common[r.counter] = True  # at most COUNTERS rows
    return common


def _join(docs: DataFrame) -> DataFrame:
    seen = durable(survey(docs), "survey")
    rows = seen.where("n IS NOT NULL").select("doc_id", "n", "sid", "least")
    edges = lambda t, a, b: t.select(F.col(a).alias("x"), F.col(b).alias("y"))
    home = durable(families(docs, rows), "families")
    sigs = durable(signatures(docs, common_counters(seen)), "signatures")
    listed = durable(listing(sigs), "listed")
    sets = durable(sigs.select(F.col("sid").alias("node"), F.col("n").alias("low"), F.col("n").alias("high"), "slack", *S).dropDuplicates(["node"]), "bitmaps")
    release(sigs)
    first = durable(_placed(listed, home.select(F.col("a").alias("node"), F.col("b").alias("root"))), "placed")
    near = verify(durable(allowed(hubs(first), sets), "near"), docs, rows)
    roots = components(edges(home, "a", "b").union(near), "x", "y")
    placed = durable(_placed(listed, roots), "placed")
    release(first, listed)
    far = verify(durable(crossings(placed, sets, roots), "far"), docs, rows)
    if not far.isEmpty():
        roots = components(edges(roots, "node", "root").union(far), "x", "y")
    known = rows.join(roots, rows.sid == roots.node, "left").select("doc_id", "n", F.coalesce("root", "sid").alias("root"))
    least = known.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return known.join(least, "root", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
