"""Corpus operators against plain versions of their methods, with limits lowered so that every path runs."""

import itertools
import math
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlight.llm import dom, extract, jaccard, neighbours, packing, quality, secrets
from tests.llm.test_maps import docs
from tests.llm.test_sets import near_copies, plain_components, vectors


def test_jaccard_with_small_blocks_and_many_common_hashes(spark, monkeypatch):
    """Families that are dealt over blocks, hashes of which all count as common, and one large family of near copies."""
    for name, value in (("BLOCK", 3), ("COMMON", 2), ("FAN", 2)):
        monkeypatch.setattr(jaccard, name, value)
    rng = random.Random(3)
    long = [f"v{rng.randrange(300)}" for _ in range(70)]
    crowd = []
    for _ in range(30):
        w = list(long)
        w[rng.randrange(70)] = "x"
        crowd.append(" ".join(w + [f"u{rng.randrange(10**6)}" for _ in range(rng.choice([0, 3, 8, 14]))]))
    texts = near_copies(3, 30) + crowd
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(docs(spark, texts).repartition(4)).collect()}
    assert [got[i] for i in range(len(texts))] == plain_components(texts)


def test_first_hashes_that_linked_sets_share():
    """What MOST and MEETS promise, for random orders of hashes: so many common hashes in both prefixes, with enough left."""
    rng = np.random.default_rng(5)
    seen = 0
    for _ in range(2000):
        n = int(rng.integers(1, 400))
        a = rng.permutation(2000)[:n]
        b = np.concatenate([a[int(n * rng.random() * 0.3) :], 2000 + np.arange(int(n * rng.random() * 0.3))])
        a, b = np.unique(a), np.unique(b)
        o = len(np.intersect1d(a, b))
        if not len(b) or 7 * o < 3 * (len(a) + len(b)):
            continue
        seen += 1
        most = min(min(len(a), len(b)) // jaccard.TIMES + 1, math.ceil(3 * (len(a) + len(b)) / 7) - math.ceil(3 * max(len(a), len(b)) / 4) + 1)
        order = rng.permutation(4000)
        by = lambda s: sorted(s.tolist(), key=lambda v: order[v])  # noqa: E731, B023
        x, y = by(a), by(b)
        places = {v: len(y) - i for i, v in enumerate(y[: jaccard.prefix_length(len(y))])}
        both = [(len(x) - i, places[v]) for i, v in enumerate(x[: jaccard.prefix_length(len(x))]) if v in places]
        hits = [min(r) for r in both if 7 * min(r) >= 3 * (len(a) + len(b)) - 7 * (most - 1)]
        assert len(hits) >= most and 7 * max(hits) >= 3 * (len(a) + len(b))
    assert seen > 200


def clustered(n=1500, dim=12, groups=30, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dim)) * 4
    x = centres[rng.integers(groups, size=n)] + rng.normal(size=(n, dim)) * 0.3
    x[100:400] = x[100]  # a crowded cell
    return [(i, [float(v) for v in row], 0) for i, row in enumerate(x.astype(np.float32))]


def test_neighbours_of_clusters_visit_few_cells(spark, monkeypatch):
    """Small blocks and groups, so that a crowded cell has several blocks and queries several groups."""
    monkeypatch.setattr(neighbours, "BLOCK", 100)
    monkeypatch.setattr(neighbours, "GROUP", 10)
    rows = clustered()
    x = np.array([v for _, v, _ in rows])
    index = neighbours.fit(x, len(x))
    assert index.budget < 0.5
    first, parts = neighbours.deal(np.bincount(index.cells(x), minlength=len(index.first) * len(index.second)), 100)
    assert parts.max() >= 3 and first.max() >= 10
    got = {}
    for r in neighbours.search(vectors(spark, rows).repartition(4), F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = 0
    for q in range(0, len(rows), 20):
        s = x @ x[q]
        s[q] = -np.inf
        want = np.lexsort((np.arange(len(x)), -s))[:20]
        found = [v for _, v, _ in sorted(got[q])]
        assert len(found) == 20 and q not in found
        # among equal scores other ids are as good
        hits += sum(s[v] >= s[want[-1]] - 1e-9 for v in found)
    assert hits >= 0.9 * 20 * len(got)


def test_only_visited_cells_are_scored():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 6))
    index = neighbours.Index(x[:7, :3], x[:6, 3:], 0.3)
    cell = index.cells(x)
    counts = np.bincount(cell, minlength=42)
    da, db = index.distances(x[:20])
    cells = [index.traverse(da[i], db[i], counts, 90) for i in range(20)]
    reach = np.array([max(da[i][c // 6] + db[i][c % 6] for c in own) for i, own in enumerate(cells)])
    found = neighbours.best_of_block(index, x, np.arange(300), cell, x[:20], np.arange(20), reach, 5)
    for i, (ids, scores) in enumerate(found):
        allowed = [v for v in range(300) if cell[v] in cells[i] and v != i]
        want = sorted(allowed, key=lambda v: (-float(x[v] @ x[i]), v))[:5]
        assert ids.tolist() == want and np.allclose(scores, x[want] @ x[i])


def tokens_of():
    enc = secrets.encoding(None)
    return lambda run: len(enc.encode_ordinary(run))


def test_long_runs_of_letters_are_measured():
    cost = tokens_of()
    spans = lambda t: [(a, b) for a, _, b in secrets.random_spans(t, secrets.base_spans(t), cost)]
    for secret in ("kQzVbXwPqLmZrTyHnGfDsJx", "KQZVBXWPQLMZRTYHNGFDSJXA", "kqzvbxwpqlmzrtyhngfdsjx"):
        assert spans(f"see {secret} now") == [(4, 4 + len(secret))]
        assert secrets.redact_text(f"see {secret} now", cost) == "see <SECRET> now"
    for known in ("internationalization", "getElementsByTagNameAndClass", "src/components/application/main", "12345678901234567890", "123e4567-e89b-12d3-a456-426614174000", "INTERNATIONAL_BUSINESS_MACHINES"):
        assert not spans(f"see {known} now")


def test_random_spans_against_runs_of_one_character_class():
    """A plain statement of the rule for runs without separators and without base spans: known ones stay, the rest goes by ratio."""
    cost, rng = tokens_of(), random.Random(6)
    kinds = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHJKLMNPQRSTUVWXYZ0123456789", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJ0123456789", "0123456789"]
    for _ in range(300):
        run = "".join(rng.choices(rng.choice(kinds), k=rng.randint(14, 45)))
        if secrets.base_spans(run):
            continue
        words = len(run) < 20 or run.isdigit()
        digest = bool(re.fullmatch(r"[0-9a-fA-F]+", run)) and len(run) in secrets.DIGESTS
        want = [] if words or digest or len(run) >= 2 * cost(run) else [(2, 2 + len(run))]
        got = [(a, b) for a, _, b in secrets.random_spans(f". {run} .", [], cost)]
        assert got == want, run


def plain_best_fit(items, capacity):
    bins = []
    for x in sorted(items, reverse=True):
        fits = [b for b in bins if capacity - sum(b) >= x]
        if fits:
            min(fits, key=lambda b: capacity - sum(b)).append(x)
        else:
            bins.append([x])
    return sorted(map(sum, bins))


def improvable(bins, capacity):
    """Whether one bin can give another, as full or fuller, one piece or one or two for a shorter one."""
    for poor, rich in itertools.permutations(bins, 2):
        if sum(rich) < sum(poor):
            continue
        gifts = [(x,) for x in poor] + list(itertools.combinations(poor, 2))
        for gift in gifts:
            for back in [(), *((x,) for x in rich)]:
                if (len(gift) == 1 or back) and 0 < sum(gift) - sum(back) <= capacity - sum(rich):
                    return True
    return False


def test_packing_search_against_plain_ones():
    rng = random.Random(7)
    for _ in range(150):
        capacity = rng.choice([10, 30, 100])
        items = [rng.randint(1, capacity) for _ in range(rng.randint(1, 60))]
        first = packing.best_fit(Counter(items), capacity)
        assert sorted(sum(p) for p, n in first.items() for _ in range(n)) == plain_best_fit(items, capacity)
        last = packing.improve(first, capacity)
        bins = [p for p, n in last.items() for _ in range(n)]
        assert Counter(x for p in bins for x in p) == Counter(items) and all(sum(p) <= capacity for p in bins)
        assert len(bins) <= sum(first.values())
        assert len(bins) == -(-sum(items) // capacity) or not improvable(bins, capacity)


def test_packing_search_goes_past_many_patterns():
    """More underfull patterns than any round used to look at."""
    rng = random.Random(8)
    counts = Counter(rng.choice([rng.randint(513, 1000), rng.randint(100, 340)]) for _ in range(700))
    last = packing.improve(packing.best_fit(counts))
    under = [p for p in last if sum(p) < packing.CAPACITY]
    assert len(under) > 60
    search = packing._Search(last, packing.CAPACITY)
    assert not any(search.exchange(p, last) for p in under)


def test_markup_is_read_in_one_pass():
    page = lambda html: [t for t in dom.Page(html).text if t]
    assert page("<p title=it's>Odd quote paragraph</p><p>next one's</p>") == ["Odd quote paragraph", "next one's"]
    assert page('<p title="a > b" lang=en>one</p><p data-x=\'<b>\'>two<br>three</p>') == ["one", "two three"]
    assert page("<article><p>one</p><video-player src=x></video-player><p>two</p></article>") == ["one", "two"]
    assert page('<p>a</p><svg class="i"/><p>b</p><svg><text>no</text></svg><p>c') == ["a", "b", "c"]
    assert page("<p>a<script>x = '</p>'</script>b</p><SCRIPT>no</SCRIPT ><title>no</title>c<style>no") == ["ab", "c"]
    assert page("<p>a</p><object data=x><p>b</p>") == ["a", "b"]  # never closed
    assert page("1 < 2 and 3 > 2 <!-- no --> <!doctype x> yes <? no ?>") == ["1 < 2 and 3 > 2 yes"]
    assert page("<p>a</p><p class=\"never closed>b</p><p>c</p>") == ["a", "b", "c"]
    assert page("") == [] and page("<") == ["<"] and page("<p") == ["<p"]
    for hard in ('<a href="x ', '<a =">', "<b>", "</x>", "<div>", "<!", "<svg>", "<p class='", "<li><ul>", "<!--", "<a x=", "<select>"):
        began = time.perf_counter()
        dom.Page(hard * 100_000)
        assert time.perf_counter() - began < 12, hard  # a second or so each; quadratic time would be an hour


def test_extraction_leaves_no_markup():
    got = extract.main_text(["<html><body><nav><a href=/>Home</a></nav><article>" + "".join(f"<p title=it's{i}>Paragraph {i} of a longer story, with some words in it.</p>" for i in range(8)) + "</article></body></html>"], extract.model())
    assert got[0].count("\n") == 7 and "<" not in got[0] and "Home" not in got[0]


def plain_features(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    n = len(words)
    if not n:
        return [1.0] + [0.0] * 14
    size = sum(len(w.encode()) for w in words)
    windows = [tuple(words[i : i + 3]) for i in range(n - 2)]
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    upper = sum("A" <= c <= "Z" or "À" <= c <= "Þ" for c in text)
    lower = sum("a" <= c <= "z" or "ß" <= c <= "ÿ" for c in text)
    signs = sum(not (c.isalnum() or c == "_" or c.isspace() or c in ".,;:'\"()?-") for c in text)
    marked = sum(w[-1] in "*#$%&!|<>=_~^@+" for w in words)
    return [
        0.0, math.log(1 + n) / 8, float(n < 20), min(size / n, 30) / 10, min(signs / n, 3), min(marked / n, 1), upper / max(1, upper + lower), float(lower < upper),
        min(sum(c in "0123456789" for c in text) / size, 1), len(set(words)) / n, 1 - len(set(windows)) / len(windows) if windows else 0.0, 1 - len(set(lines)) / len(lines),
        min(n / len(lines), 100) / 100, min(sum(c in ".?" for c in text) / n, 1), max(map(words.count, set(words))) / n,
    ]


def texts_to_rate(seed=9, n=60):
    rng = random.Random(seed)
    good = lambda: " ".join(rng.choices("the cat sat on a mat and then it went home to eat Some fish .".split(), k=rng.randint(5, 60))) + ".\nEnd of it."
    bad = lambda: "\n".join(["BUY NOW!!! $$$ 99 %% #1"] * rng.randint(1, 6)) + " " + " ".join(rng.choices(["###", "CLICK", "wow!", "é**"], k=rng.randint(1, 30)))
    return [(bad if i % 2 else good)() for i in range(n)] + [None, "", " \n", "one", "é É ß"]


def test_features_against_plain_ones():
    for t in texts_to_rate():
        assert np.allclose(quality.features(t), plain_features(t), atol=1e-12), t


def test_ranking_against_its_definition():
    """Weights at which the loss of the pairs, added up by loops, is stationary; the cut that no other quantile beats."""
    texts = texts_to_rate()[:60]
    rng = random.Random(1)
    y = np.array([(i % 2 == 0) ^ (rng.random() < 0.1) for i in range(60)]).astype(int)
    x = np.array([plain_features(t) for t in texts])
    model = quality.fit_pairs(x, y, pairs=300, penalty=1e-2)
    wide = []
    for row in x:
        line = list(row)
        for i, knots in enumerate(model.knots):
            line += [max(row[i] - k, 0.0) for k in knots]
        wide.append([(v - m) / s for v, m, s in zip(line, model.mean, model.scale, strict=True)])
    for i, knots in enumerate(model.knots):
        assert set(knots) == {float(np.quantile(x[:, i], q)) for q in quality.KNOTS}
    draw = np.random.default_rng(7)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    pairs = list(zip(draw.choice(good, 300).tolist(), draw.choice(bad, 300).tolist(), strict=True))
    slope = [1e-2 * w for w in model.weights]
    for g, b in pairs:
        gap = sum(w * (p - q) for w, p, q in zip(model.weights, wide[g], wide[b], strict=True))
        wrong = 1 / (1 + math.exp(min(max(gap, -40), 40)))
        for k in range(len(slope)):
            slope[k] -= wrong * (wide[g][k] - wide[b][k]) / 300
    assert max(map(abs, slope)) < 1e-6
    raw = [sum(w * v for w, v in zip(model.weights, row, strict=True)) for row in wide]
    right = lambda t: sum(raw[i] >= t for i in good) / len(good) + sum(raw[i] < t for i in bad) / len(bad)
    assert right(model.cut) >= max(right(t) for t in raw) - 0.05
    scores = model.score(x)
    for s, r in zip(scores, raw, strict=True):
        assert math.isclose(s, 1 / (1 + math.exp(-(model.slope * (r - model.cut) + math.log(0.7 / 0.3)))), abs_tol=1e-9)
        assert (s >= 0.7) == (r >= model.cut) or abs(r - model.cut) < 1e-9


def test_quality_query_against_plain_scores(spark):
    """Training rows, held-out rows, repeated and missing ids, by the whole chain."""
    import zlib

    texts = texts_to_rate()
    rows = docs(spark, texts, [*range(len(texts) - 1), None])
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(60)] + [(3, 0), (None, 1), (999, 1)], "doc_id long, quality int")
    model = quality.fit(rows, labels)
    learned = [i for i in range(60) if zlib.crc32(str(i).encode()) % 4 != 2]
    x = [plain_features(texts[i]) for i in learned] + [plain_features(texts[3])] * (3 in learned)
    y = [int(i % 2 == 0) for i in learned] + [0] * (3 in learned)
    order = np.lexsort(np.array(x).T[::-1])
    want = quality.fit_pairs(np.array(x)[order], np.array(y)[order])
    assert np.allclose(model.weights, want.weights, atol=1e-6) and math.isclose(model.cut, want.cut, abs_tol=1e-6)
    got = quality.classify(rows, model).select("doc_id", "text", "score", "predicted", quality.held_out(F.col("doc_id")).alias("held")).collect()
    assert len(got) == len(texts)
    for r in got:
        assert math.isclose(r.score, float(want.score(np.array([plain_features(r.text)]))[0]), abs_tol=1e-5)
        assert r.predicted == int(r.score >= 0.7) and r.held == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


@pytest.mark.parametrize("ids", [[None, 1, 1, 2], [None, None, None, None]])
def test_null_and_repeated_ids(spark, ids):
    from gridlight.llm import rules, tokencount

    df = docs(spark, ["a b c", None, "a b c", ""], ids)
    want = sorted(map(str, ids))
    assert sorted(str(r.doc_id) for r in packing.pack(df).collect()) == want
    assert sorted(str(r.doc_id) for r in rules.digest(rules.apply_policy(rules.ledger(df))).collect()) == want
    assert sorted(str(r.doc_id) for r in tokencount.recount(df, tokencount.sample_edits()).collect()) == want
    assert sorted(str(r.doc_id) for r in secrets.scan(df).collect()) == want
