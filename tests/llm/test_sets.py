"""Operators that compare documents with one another."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlight.llm import jaccard, links, mixing, neighbours, packing, suffixes
from tests.llm.test_maps import ODD, docs

SF = "/root/testdata/sf0.01"


def near_copies(seed, n=60, words=60):
    """Families of edited copies, texts with shared passages, short and odd texts."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [rng.choices(vocabulary, k=words) for _ in range(6)]
    passage = rng.choices(vocabulary, k=12)
    out = []
    for _ in range(n):
        w = list(rng.choice(base)) if rng.random() < 0.7 else rng.choices(vocabulary, k=rng.randint(1, words))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        if rng.random() < 0.4:
            w += passage
        out.append(" ".join(w) if rng.random() < 0.8 else "  ".join(w).upper())
    return out + ["one two", "ONE\ttwo", "three", *ODD]


def plain_components(texts):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(sets)))
    for _ in range(len(sets)):
        before = list(root)
        for i, a in enumerate(sets):
            for j in range(i):
                o = len(a & sets[j])
                if a and sets[j] and 100 * o >= 75 * (len(a) + len(sets[j]) - o):
                    root[i] = root[j] = min(root[i], root[j])
        if root == before:
            break
    return [(len(s), r) for s, r in zip(sets, root)]


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_against_all_pairs(spark, seed):
    texts = near_copies(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(docs(spark, texts).repartition(5)).collect()}
    assert [got[i] for i in range(len(texts))] == plain_components(texts)


def test_jaccard_odd_tables(spark):
    assert jaccard.join(docs(spark, [])).count() == 0
    a = "a b c d e f g h i j"
    rows = jaccard.join(docs(spark, [a, a, a, None, "z"], [7, 7, None, 3, None])).collect()
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in rows) == [(-1, 1, -1), (-1, 6, 7), (3, 0, 3), (7, 6, 7), (7, 6, 7)]


def test_signature_tree_against_all_pairs():
    rng = np.random.default_rng(0)
    for _ in range(20):
        base = [rng.integers(0, 1 << 63, 80).astype(np.uint64) for _ in range(4)]
        sets = []
        for _ in range(40):
            s = base[rng.integers(4)].copy()
            s[: rng.integers(0, 25)] = rng.integers(0, 1 << 63, 1)
            sets.append(np.unique(s))
        root = list(range(40))
        for _ in range(40):
            for i in range(40):
                for j in range(i):
                    if jaccard.linked(sets[i], sets[j]):
                        root[i] = root[j] = min(root[i], root[j])
        groups = lambda r: sorted(sorted(i for i in range(40) if r[i] == x) for x in set(r))
        assert groups(jaccard.SignatureTree(sets).links()) == groups(root)


def test_bound_never_drops_a_link():
    rng = np.random.default_rng(1)
    for _ in range(300):
        n = int(rng.integers(1, 3000))
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[int(len(a) * rng.random() * 0.3) :], rng.integers(0, 1 << 63, int(n * rng.random() * 0.3)).astype(np.uint64)]))
        if jaccard.linked(a, b):
            x, y = (jaccard.SignatureTree([s]).root for s in (a, b))
            assert jaccard.SignatureTree.may_link(x, y)
            shared = len(np.intersect1d(a[: jaccard.prefix_length(len(a))], b[: jaccard.prefix_length(len(b))]))
            assert shared and 7 * (shared + math.ceil(0.75 * max(len(a), len(b))) - 1) >= 3 * (len(a) + len(b))


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 130)] + [(200, 200)]
    rows = links.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.root for r in rows} == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)}


def passages(seed, n=25):
    rng = random.Random(seed)
    parts = ["".join(rng.choices("abcdé \n", k=rng.choice([30, 99, 100, 101, 180, 400]))) for _ in range(9)]
    out = ["".join(rng.choices(parts, k=rng.randint(1, 6))) for _ in range(n)]
    return out + [out[0], out[3], "ab" * 200, "x" * 350, "x" * 99, "x" * 100, None, "", "word " * 300]


@pytest.mark.parametrize("seed", range(3))
def test_suffix_removal_against_all_strings(spark, seed):
    texts = dict(enumerate(passages(seed)))
    want = suffixes.by_hand(texts)
    got = {r.doc_id: tuple(r)[1:] for r in suffixes.digest(docs(spark, list(texts.values())).repartition(6)).collect()}
    assert got == want


def test_suffix_removal_odd_tables(spark):
    assert suffixes.remove(docs(spark, [])).count() == 0
    t = "".join(random.Random(1).choices("abcdefgh ", k=300))
    rows = suffixes.remove(docs(spark, [t, t, t, t], [5, 5, None, 9])).collect()
    assert sorted((r.doc_id or -1, r.n_removed, r.n_spans) for r in rows) == [(-1, 300, 1), (5, 0, 0), (5, 0, 0), (9, 300, 1)]


@pytest.mark.parametrize("crowd", [1, 12, 10_000])
def test_suffix_removal_in_many_parts(spark, monkeypatch, crowd):
    """Short runs, many ranges and chunks that cut texts give the same; a passage that half of the texts share is among them, and
    its grams are crowded."""
    for name, value in (("RUN", 40), ("MERGE", 30), ("GRAMS", 1), ("CHUNK", 150), ("CROWD", crowd)):
        monkeypatch.setattr(suffixes, name, value)
    line = "this line stands in very many of the documents of the corpus, in the middle of other words and at their ends, as licenses do"
    texts = [*passages(5, 30), *[f"{i} {line} {i * 7} {line[:105]}" if i % 2 else f"{line}{i}" for i in range(30)]]
    keyed = suffixes.places(docs(spark, texts).repartition(4)).select("did", "mark", F.coalesce("text", F.lit("")).alias("text"))
    again = suffixes.grams(keyed).groupBy("kind").agg(F.sum("n").alias("n"), F.max("gram").alias("gram")).where("n > 1")
    sizes = again.agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).first()
    assert len(suffixes.splitters(again, sizes.n, sizes.kinds)) > 5
    hot, held = suffixes.crowded(again, sizes.n)
    assert (len(hot) > 0) == (held > 0) == (crowd < 100)
    got = {r.doc_id: tuple(r)[1:] for r in suffixes.digest(docs(spark, texts).repartition(4)).collect()}
    assert got == suffixes.by_hand(dict(enumerate(texts)))


def test_suffix_removal_of_repeated_rows_beside_others(spark):
    rng = random.Random(3)
    shared = "".join(rng.choices("abcdefgh ", k=160))
    a, b = shared + "".join(rng.choices("xyz ", k=150)), "".join(rng.choices("uvw ", k=150)) + shared
    rows = suffixes.remove(docs(spark, [a, a, b, b], [1, 1, 2, 2])).collect()
    assert sorted((r.doc_id, r.n_removed) for r in rows) == [(1, 0), (1, 0), (2, 160), (2, 160)]
    named = spark.createDataFrame([("a", a), ("b", b), ("c", a), (None, a)], "doc_id string, text string")
    assert sorted((r.doc_id or "", r.n_removed) for r in suffixes.remove(named).collect()) == [("", len(a)), ("a", 0), ("b", 160), ("c", len(a))]


def test_loser_tree_merges_and_counts_prefixes():
    rng = random.Random(0)
    for k in (1, 2, 3, 5, 8):
        runs, everything, removed = [], [], 0
        for r in range(k):
            n = rng.randint(1, 30)
            lines = np.frombuffer("".join(rng.choices("ab", weights=[9, 1], k=suffixes.LINE * n)).encode(), np.uint8).reshape(n, suffixes.LINE).copy()
            lines[n // 2] = lines[0]
            numbers = np.array([[rng.randint(0, 9), r, 100 + i] for i in range(n)], np.int64)
            kept, whose, more, gone = suffixes.sort_run(lines, numbers, numbers[:, 2])
            assert (more == whose[:, 2]).all()
            common = suffixes.shared_with_last(kept)
            assert len(kept) + len(gone) == n and len(gone) == (n > 1)
            assert {x.tobytes() for x in kept} == {x.tobytes() for x in lines}
            blob = suffixes.code_run(kept, whose, common)
            got = [(s, x) for _, s, x in suffixes.read_run(blob)]
            assert got == [(a.tobytes(), tuple(b.tolist())) for a, b in zip(kept, whose)]
            everything += got
            runs.append(suffixes.read_run(blob))
        merged = list(suffixes.LoserTree(runs))
        everything.sort()
        assert [(s, x) for _, s, x in merged] == everything
        common = [suffixes.shared_prefix(a[0], b[0], 0) for a, b in zip(everything, everything[1:])]
        assert [c for c, _, _ in merged][1:] == common


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def plain_search(rows, k=20):
    ok = [(i, np.array(v, np.float32).astype(float)) for i, v, _ in rows if i is not None and v is not None and None not in v and len(v) == 8 and np.isfinite(np.array(v, float)).all() and any(v)]
    out = {}
    for i, v in ok:
        if i % 20 == 0:
            out[i] = sorted(((-float((w * v).sum()), j) for j, w in ok if j != i))[:k]
    return out


def test_neighbours_recall_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(size=8) * rng.choice([0.5, 1, 3])], 0) for i in range(600)]
    rows[40] = (40, [9.0] * 8, 0)
    rows += [(1000 + i, rows[40][1], 0) for i in range(60)]
    rows += [(2000, None, 0), (2020, [0.0] * 8, 0), (2040, [float("nan")] * 8, 0), (2060, [1.0, None] * 4, 0), (2080, [1.0] * 3, 0), (None, rows[0][1], 0), (2100, [float("inf")] + [0.0] * 7, 0)]
    want = plain_search(rows)
    got = {}
    for r in neighbours.search(vectors(spark, rows).repartition(4), F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert got.keys() == want.keys()
    hits = sum(len({v for _, v, _ in got[q]} & {j for _, j in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    by_id = {i: np.array(v, np.float32).astype(float) for i, v, _ in rows if v and len(v) == 8 and None not in v}
    for q, found in got.items():
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 21)) and all(math.isclose(s, float(by_id[q] @ by_id[v])) for _, v, s in found)
        assert [(-s, v) for _, v, s in found] == sorted((-s, v) for _, v, s in found)
    assert [v for _, v, _ in got[40]] == list(range(1000, 1020))


def test_neighbours_small_and_empty(spark):
    assert neighbours.search(vectors(spark, []), F.col("vec_id") % 20 == 0).count() == 0
    assert neighbours.search(vectors(spark, [(0, [1.0, 2.0], 0)]), F.col("vec_id") % 20 == 0).count() == 0
    rows = neighbours.search(vectors(spark, [(0, [1.0, 2.0], 0), (1, [1.0, 0.0], 0), (2, [0.0, 1.0], 0)]), F.col("vec_id") % 20 == 0).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in rows] == [(2, 2.0), (1, 1.0)]


def test_heap_goes_through_all_cells_in_order():
    rng = np.random.default_rng(0)
    index = neighbours.Index(rng.normal(size=(6, 2)), rng.normal(size=(5, 2)), 1.0)
    a, b = rng.normal(size=6), rng.normal(size=5)
    cells = index.traverse(a, b, np.ones(30, int), 30)
    sums = [a[c // 5] + b[c % 5] for c in cells]
    assert sorted(cells) == list(range(30)) and sums == sorted(sums)


def tokens(text):
    from tokenizers import Tokenizer

    import public_tokenizers

    if not hasattr(tokens, "t"):
        tokens.t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [*tokens.t.encode(text or "", add_special_tokens=False).ids, 2]


def check_bins(rows):
    by_bin = {}
    for r in rows:
        by_bin.setdefault(r.sequence_id, []).append(r)
    for own in by_bin.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024


def check_packing(rows, texts):
    by_doc, by_bin = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_bin.setdefault(r.sequence_id, []).append(r)
    for d, t in texts.items():
        ids, own = tokens(t), sorted(by_doc[d], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and sum(r.length for r in own) == len(ids)
        assert all(r.length == 1024 for r in own[1:]) and (len(ids) > 1024) == (len(own) > 1)
        at = 0
        for r in own:
            raw = np.array(ids[at : at + r.length], "<u4").tobytes()
            assert r.start == at and zlib.crc32(raw) == r.ids_crc32
            at += r.length
    for own in by_bin.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    return len(by_bin), math.ceil(sum(len(tokens(t)) for t in texts.values()) / 1024)


def test_packing_round_trip(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").where("doc_id < 500")
    texts = {r.doc_id: r.text for r in df.collect()}
    bins, least = check_packing(packing.pack(df).collect(), texts)
    assert bins <= least * 1.01 + 1


def test_packing_odd_texts(spark):
    odd = [*ODD, "<|endoftext|> a <|endoftext|>", "  two  spaces \n \n x", "trail "]
    check_packing(packing.pack(docs(spark, odd)).collect(), dict(enumerate(odd)))
    assert packing.pack(docs(spark, [])).count() == 0
    assert packing.pack(docs(spark, ["a", "a"], [1, 1])).count() == 2


def test_local_search_empties_bins():
    # best fit leaves 6,3 | 5,4 | 2 of capacity 10; an exchange makes room for the 2
    bins = Counter({(6, 2): 1, (5, 4): 1, (3,): 1})
    done = packing.improve(bins, 10)
    assert sum(done.values()) == 2 and Counter(x for p, n in done.items() for x in p * n) == Counter([6, 2, 5, 4, 3])
    rng = random.Random(5)
    for _ in range(20):
        counts = Counter(rng.randint(1, 64) for _ in range(rng.randint(1, 300)))
        first = packing.best_fit(counts, 64)
        last = packing.improve(first, 64)
        assert sum(last.values()) <= sum(first.values()) and all(sum(p) <= 64 for p in last)
        assert Counter({x: c for x, c in counts.items()}) == sum((Counter({x: k * n for x, k in Counter(p).items()}) for p, n in last.items()), Counter())


def plain_targets(sizes, weights=(5, 2, 1)):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-8")) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    stopped: set = set()
    while True:
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in stopped)
        free = [s for s in names if s not in stopped]
        target = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if target[s] > 3 * sizes[s]}
        if not over:
            return {s: float(3 * sizes[s]) if s in stopped else target[s] for s in names}
        stopped |= over


def mixable(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 5, 40, 900])), rng.choice(["b", "a", "a", "a", "a", "é", "z", None, "tiny"][: 8]), 1) for i in range(300)]
    rows += [(400, "one two three", "tiny", 1), (401, None, "empty", 1), (402, "", "empty", 1), (7, "dup row", "a", 1), (7, "dup row", "a", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, target int")


@pytest.mark.parametrize("block", [2, mixing.BLOCK])
def test_mix_targets_and_limits(spark, block):
    df = mixable(spark)
    rows = mixing.take(df, block=block).collect()
    assert len(rows) == 305
    sizes, taken, target = Counter(), Counter(), {}
    for r in rows:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 3 * r.size
    want = plain_targets({s: sizes[s] for s in target})
    assert all(math.isclose(target[s], want[s], abs_tol=1e-6) and want[s] - 3 * block <= taken[s] <= want[s] + 1 for s in want)
    assert all(r.source_size == sizes[r.source] for r in rows)
    again = mixing.take(df.repartition(7), block=block).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))
    assert mixing.take(df.where("false")).count() == 0


def test_schedule_decides_the_mix(spark):
    """Slots in another order, and slots that leave a source out, give another result."""
    df = mixable(spark)
    rows = {(r.doc_id, r.source): (r.taken, r.first_slot) for r in mixing.take(df).collect()}
    taken = Counter()
    for (_, s), (n, slot) in rows.items():
        taken[s] += n
        assert (n > 0) == (slot is not None)
    reverse = lambda shares, block: mixing.schedule(shares, block).withColumn("slot", -F.col("slot"))
    assert {(r.doc_id, r.source): r.first_slot for r in mixing.take(df, schedule=reverse).collect()} == {k: slot if slot is None else -slot for k, (_, slot) in rows.items()}
    half = lambda shares, block: mixing.schedule(shares, block).where("source <> 'a' OR rank % 2 = 0")
    less = Counter()
    for r in mixing.take(df, schedule=half).collect():
        less[r.source] += r.taken
    assert 0.3 * taken["a"] < less["a"] < 0.7 * taken["a"] and less["b"] == taken["b"]
    slots = mixing.schedule(mixing.targets(df.groupBy("source").agg(F.count("*").alias("source_size"))).withColumn("quota", F.col("target").cast("long")), 2).collect()
    assert sorted(r.slot for r in slots) == list(range(len(slots)))
    first = [r.first_slot for r in mixing.take(df).orderBy("first_slot").where("first_slot IS NOT NULL").collect()]
    assert [r.first_slot for r in mixing.take(df).collect() if r.taken] and first == sorted(first)


def test_mix_makes_the_words_it_takes(spark):
    df = mixable(spark)
    out = mixing.mixed(df)
    assert out.columns == df.columns
    made = Counter()
    for r in out.collect():
        made[r.doc_id, r.source] += len((r.text or "").split())
    want = Counter()
    for r in mixing.take(df).collect():
        want[r.doc_id, r.source] += r.taken
    assert +made == +want


def test_schedule_stays_close_to_the_shares(spark):
    need = {"a": 500, "b": 200, "c": 100, None: 1}
    shares = spark.createDataFrame([(s, 10 * n) for s, n in need.items()], "source string, quota long")
    rows = mixing.schedule(shares, 10).orderBy("slot").collect()
    assert [r.slot for r in rows] == list(range(801))
    got = Counter(r.source for r in rows)
    assert all(abs(got[s] - n) <= 3 for s, n in need.items())
    for s in need:
        assert [r["rank"] for r in rows if r.source == s] == list(range(got[s]))
    seen = Counter()
    for k, r in enumerate(rows):
        seen[r.source] += 1
        assert all(abs(seen[s] - (k + 1) * need[s] / 801) < 4 for s in need)
        point = (r.slot * mixing.PHI) % 1 * 8010
        assert (point < 5000) == (r.source == "a") and (point >= 8000) == (r.source is None)
    assert abs(spark.range(1).select(mixing.golden(F.lit(10**10)).alias("p")).first().p - (10**10 * (5**0.5 - 1) / 2) % 1) < 1e-4


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as cp

    df = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 300")
    extra = spark.createDataFrame([(900, None, "en", "s", 0), (901, "", None, None, None)], df.schema)
    stage = dict(cp.STAGES)
    cur, seen = df.union(extra), {}
    for name, f in cp.STAGES[:-1]:
        out = f(spark, cur, SF)
        assert out.columns == df.columns
        out.write.parquet(str(tmp_path / name.replace(" ", "_")))
        cur = spark.read.parquet(str(tmp_path / name.replace(" ", "_")))
        seen[name] = cur.collect()
    texts = {r.doc_id: r.text for r in seen["quality ranking"]}
    comp = plain_components([texts[k] for k in sorted(texts)])
    ids = sorted(texts)
    assert sorted(r.doc_id for r in seen["near duplicates"]) == [ids[i] for i, (_, c) in enumerate(comp) if ids[c] == ids[i]]
    from gridlight.llm.secrets import base_spans

    assert len(seen["secrets"]) == len(seen["near duplicates"]) and not any(base_spans(r.text or "") for r in seen["secrets"])
    packed = stage["packing"](spark, cur, SF).collect()
    assert sum(r.length for r in packed) == sum(len(tokens(r.text)) for r in seen["source mix"])
    folder = tmp_path / "whole"
    cur = df.union(extra)
    cur.write.parquet(str(folder / "documents.parquet"))
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(str(folder / "labels.parquet"))
    whole = cp.run(spark, str(folder)).collect()
    key = lambda r: (r.doc_id or -1, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, whole)) == sorted(map(key, packed))
    check_bins(whole)


def test_pipeline_on_an_empty_table(spark):
    import corpus_pipeline as cp

    df = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, f in cp.STAGES:
        out = f(spark, df, SF)
        assert out.count() == 0
