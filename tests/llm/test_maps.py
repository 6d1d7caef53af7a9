"""Operators that work on one document at a time."""

import hashlib
import random
import re
import string
import zlib

import numpy as np
import pytest

from gridlight.llm import boosting, dom, extract, packing, quality, rules, secrets, tokencount
from gridlight.llm.queries import ORACLES, QUERIES
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "\n\n", "a", "x" * 50_000, "word " * 20_000, "é漢字   ſecret: ABCDEFGHIJKLMNOP"]


def docs(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, "s", -1, "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size int, score string")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, name):
    compare(spark, connect(SF), SF, QUERIES[name], ORACLES[name])


def plain_spans(text):
    """The three patterns, scanned with loops."""
    out = []
    word = re.compile("password|passwd|secret|token|api_key|apikey")
    lower = "".join(c.lower() if c in string.ascii_uppercase else c for c in text)
    value = set(string.ascii_letters + string.digits + "+/_.=-")
    at = 0
    while m := word.search(lower, at):
        i = m.end()
        i += text[i : i + 1] in ('"', "'") and text[i : i + 1] != ""
        while text[i : i + 1] == " ":
            i += 1
        if text[i : i + 1] not in (":", "="):
            at = m.start() + 1
            continue
        i += 1
        while text[i : i + 1] == " ":
            i += 1
        i += text[i : i + 1] in ('"', "'") and text[i : i + 1] != ""
        e = i
        while e < len(text) and text[e] in value:
            e += 1
        if e == i:
            at = m.start() + 1
            continue
        if e - i >= 12:
            out.append((m.start(), 0, e))
        at = e
    for kind, start, chars, least in ((1, "AKIA", set(string.ascii_uppercase + string.digits), 18), (2, "", set("0123456789abcdef"), 16)):
        at = 0
        while at < len(text):
            e = at + len(start) if text.startswith(start, at) else -1
            while e >= 0 and e < len(text) and text[e] in chars:
                e += 1
            if e > at + len(start):
                if e - at >= least:
                    out.append((at, kind, e))
                at = e
            else:
                at += 1
    return sorted(out)


def test_base_spans_against_loops():
    rng = random.Random(4)
    parts = ["token", "SECRET", "api_key", "ApiKey", "password", '"', "'", " ", "  ", "=", ":", "AKIA", "AKIAABCDEFGHIJKLMN", "deadbeef", "0123456789abcdef", "x", ".", "Zz9", "ſecret", "\n"]
    for _ in range(3000):
        t = "".join(rng.choices(parts, k=rng.randint(0, 14)))
        assert secrets.base_spans(t) == plain_spans(t), t


def test_secret_scan(spark):
    rng = random.Random(1)
    key = "".join(rng.choices(string.ascii_letters + string.digits, k=40)) + "9z"
    texts = [f"see {key} there", "commit 123e4567-e89b-12d3-a456-426614174000 and " + "AB12" * 8, "the internationalisation_of_words is long", f"Token = {key}", *ODD, f"Token = {key}"]
    rows = secrets.scan(docs(spark, texts)).orderBy("doc_id").collect()
    assert len(rows) == len(texts) and rows[0].spans == f"random:4:{4 + len(key)}" and rows[0].base == ""
    assert rows[1].spans == rows[2].spans == "" and rows[3].spans == rows[3].base == rows[-1].spans == f"assign:0:{8 + len(key)}"
    d = secrets.digest(secrets.scan(docs(spark, texts))).orderBy("doc_id").collect()
    assert d[4].base_sha256 == hashlib.sha256(b"").hexdigest() and [x.n_assign for x in d[:4]] == [0, 0, 0, 1]
    clean = secrets.redact(docs(spark, texts)).orderBy("doc_id").collect()
    assert clean[0].text == "see <SECRET> there" and clean[3].text == "<SECRET>" and clean[4].text is None and clean[1].score == "clash"
    assert secrets.scan(docs(spark, [])).count() == 0


def counter():
    enc = secrets.encoding(None)
    return lambda run: len(enc.encode_ordinary(run))


def test_keys_behind_paths_and_names():
    rng, cost = random.Random(8), counter()
    for before in ("https://hooks.example.com/services/internal/notifications/production/", "https://example.com/account/reset/confirm/", "the_internationalisation_of_long_names-"):
        for n in (20, 24, 32, 40):
            for _ in range(40):
                key = "".join(rng.choices(string.ascii_letters, k=n - 2)) + "7x"
                text = f"see {before}{key}/information there"
                clean = secrets.redact_text(text, cost)
                assert key not in clean and key[-8:] not in clean and clean.endswith(" there"), text
    missed = 0
    for _ in range(200):
        key = "".join(rng.choices(string.ascii_letters + string.digits + "+/", k=39)) + "7"
        missed += secrets.redact_text(f"https://hooks.example.com/services/internal/notifications/production/{key}", cost).count(key[10:30])
    assert not missed
    for plain in (
        "https://example.com/users/123E4567-E89B-12D3-A456-426614174000/information/settings", "https://example.com/account/2024/05/12/1234567890123/confirmation",
        "usr/share/documentation/x86_64-linux-gnu/libraries/utf8/encoding", "https://example.com/archive/commit/" + "AB12" * 10 + "/information/of/the/changes",
    ):
        assert secrets.random_spans(plain, [], cost) == [], plain


def test_keys_beside_base_spans():
    rng, cost = random.Random(9), counter()
    for before, after in (("1234567890123456789-", ""), ("AKIA" + "ABCDEFGHIJKLMNOP" + "/", ""), ("", "-1234567890123456789"), ("1234567890123456-", "/1234567890123456")):
        key = "x7" + "".join(rng.choices(string.ascii_letters + string.digits, k=36)) + "Zq"
        text = f"see {before}{key}{after} there"
        base = secrets.base_spans(text)
        more = secrets.random_spans(text, base, cost)
        assert base and any(a <= text.index(key) and text.index(key) + len(key) <= b for a, _, b in more), text
        assert not any(s < b and a < e for s, _, e in base for a, _, b in more) and key[-8:] not in secrets.redact_text(text, cost)
    plain = "see 1234567890123456789-information_of_the_changes there"
    assert secrets.random_spans(plain, secrets.base_spans(plain), cost) == []
    assert secrets.stretches(2, 9, [(0, 2, 1), (1, 2, 3), (4, 0, 6), (5, 2, 6), (12, 2, 30)]) == [(3, 4), (6, 9)]


def test_rules_policies_and_ablation(spark):
    good = "It was a quiet evening by the river and the old boat drifted slowly past. " * 1
    words = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(80)]
    texts = [" ".join(words), " ".join(w + "###" for w in words), " ".join(words).upper(), " ".join(w + "!!" for w in words), "a b c " * 60, good, *ODD]
    led = rules.ledger(docs(spark, texts))
    kept = [r.kept for r in rules.apply_policy(led).orderBy("doc_id").collect()]
    assert kept[:6] == [True, False, False, False, False, False] and not any(kept[6:])
    rows = led.orderBy("doc_id").collect()
    assert rows[4].n_repeat_words == 180 and rows[6].n_words == 0 and rows[6].failure_bits & rules.BIT["few_words"]
    bits = [r.failure_bits for r in rows]
    for version, mask in rules.POLICIES.items():
        for r in rules.ablation(led, version).collect():
            assert r.n_failed == sum(bool(b & r.bit) for b in bits) and r.n_only == sum(b & mask == r.bit for b in bits)
            assert r.n_kept_without == sum(b & mask & ~r.bit == 0 for b in bits)
    assert rules.ledger(docs(spark, [])).count() == 0


def test_quality_ranking(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    model = quality.fit(d, labels)
    assert model == quality.fit(d.repartition(7), labels.repartition(3))
    rows = quality.classify(d, model).join(labels, "doc_id").select("doc_id", "score", "predicted", "quality").collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(held) > 60 and np.mean([r.predicted == r.quality for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    odd = quality.classify(docs(spark, ODD), model).collect()
    assert len(odd) == len(ODD) and all(0 <= r.score <= 1 for r in odd)
    assert quality.classify(docs(spark, []), model).count() == 0
    assert quality.classify(docs(spark, ["x"]), quality.fit(d, labels.where("false"))).first().score == 0.5


def test_pairs_find_the_direction():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    y = (x @ [2, -1, 0] > 0).astype(int)
    m = quality.fit_pairs(x, y)
    assert ((m.score(x) >= 0.7) == y).mean() > 0.97 and m.weights[0] > 0 > m.weights[1]


def test_token_tree_against_encoding_anew():
    rng = random.Random(2)
    encode = packing.encoder(None)
    count = lambda ts: [len(x) // 4 for x in encode(ts)]
    bits = [" ", "  ", "\n", "a", "é", "'s", "it's", "9", ". ", "foo bar", "\t", "-", "x" * 30, " \n "]
    base = " ".join(random.Random(3).choices(["alpha", "be,", "it's", "x9", "\n", "long-word", "é"], k=900))
    for text in (base, base[:300], "", " ", "\n \n a b"):
        parts = tokencount.leaves(text)
        assert "".join(parts) == text
        tree = tokencount.TokenTree(parts, count(parts) if parts else [], count)
        for _ in range(60):
            a = rng.randint(0, len(text))
            b = min(len(text), a + rng.choice([0, 0, 1, 5, 700]))
            new = "".join(rng.choices(bits, k=rng.choice([0, 1, 4, 80])))
            tree.edit(a, b, new)
            text = text[:a] + new + text[b:]
            assert tree.text() == text and tree.length == len(text) and tree.total == count([text])[0]


def test_recount(spark):
    from tokenizers import Tokenizer

    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    df = spark.read.parquet(f"{SF}/documents.parquet").limit(60).union(spark.createDataFrame([(900 + i, x, "en", "s", 0) for i, x in enumerate(ODD)], "doc_id long, text string, lang string, source string, n_chars long"))
    edited = df.select("doc_id", "text", tokencount.sample_edits().alias("e")).collect()
    got = {r.doc_id: r for r in tokencount.recount(df, tokencount.sample_edits()).collect()}
    for r in edited:
        text = r.text or ""
        n = len(t.encode(text, add_special_tokens=False).ids)
        for e in r.e:
            a = min(e.start, len(text))
            text = text[:a] + e.new + text[max(a, min(e.end, len(text))) :]
        x = got[r.doc_id]
        assert (x.n_tokens, x.n_tokens_after, x.n_chars_after) == (n, len(t.encode(text, add_special_tokens=False).ids), len(text))
        assert x.text_crc32 == zlib.crc32(text.encode())
    long = [r for r in got.values() if r.n_chars_after > 8000 and r.doc_id < 900]
    assert all(r.n_encoded < 0.6 * r.n_chars_after for r in long)


def article(source):
    """The article of a test page, block by block."""
    import html

    m = re.search(r"<article>(.*?)</article>", source, re.S)
    parts = re.split(r"</?(?:p|h1)>", m[1]) if m else []
    blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]+>", " ", re.sub(r"</?b>", "", b)))).strip() for b in parts]
    return "\n".join(b for b in blocks if b)


def test_extraction_of_test_pages(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r.page_id: article(r.html) for r in df.collect()}
    rows = extract.extract(df).collect()
    assert len(rows) == len(want) and all(r.text == want[r.page_id] and r.n_chars == len(r.text) for r in rows)


def test_extraction_of_made_up_pages():
    maker, forest, wrong, total = extract._Maker(77), extract.model(), 0, 0
    for _ in range(60):
        page = dom.Page(maker.page())
        gold = {i for i, t in enumerate(page.text) if t and maker.MARK in t}
        page.text = [t and t.replace(maker.MARK, "") for t in page.text]
        kept = set(page.decode(forest.margin(page.features())))
        wrong, total = wrong + len(gold ^ kept), total + len(gold | kept)
    assert wrong < 0.03 * total


def test_extraction_of_odd_pages(spark):
    page = (
        "<body><div class=cookie-notice>We use cookies to improve this site.<button>Ok</button></div><nav><ul><li><a href=/>Home</a><li><a href=/b>News</a></ul></nav>"
        "<article><h1>A title &amp; more</h1><p>First   paragraph with\n several words, and more of them to read.<p>Second one, which is long enough to be a paragraph of text.</article>"
        "<aside class=sidebar><h3>Related</h3><ul><li><a href=x>Other story</a></ul></aside><form><label>Mail</label><input></form>"
        "<section id=comments><h3>Comments</h3><div class=comment><b>Bo</b><p>Nice text, thank you for it.</p></div></section><footer>&copy; 2020 A paper</footer>"
    )
    rows = [(0, "u", None), (1, "u", ""), (2, None, "just text without any markup at all"), (3, "u", "<p>unclosed <b>bold <!-- never ends"), (4, "u", "<" * 5000), (5, "u", page), (5, "u", page), (None, "u", "<div>" * 3000 + "deep")]
    out = extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(out) == len(rows) and out[0].text == out[1].text == ""
    want = "A title & more\nFirst paragraph with several words, and more of them to read.\nSecond one, which is long enough to be a paragraph of text."
    assert [r.text for r in out if r.page_id == 5] == [want, want]


def test_text_after_odd_tags_stays():
    def blocks(source):
        return [t for t in dom.Page(source).text if t]

    for name in ("video-player", "title-bar", "audio-player", "svg-icon", "object_x", "select:x"):
        assert blocks(f"<article><p>one</p><{name} src=x></{name}><p>two</p><p>three</p></article>") == ["one", "two", "three"]
    for tag in ('<svg class="i"/>', "<svg/>", "<math />", "<svg aria-label='a > b'\n/>", "<SVG width=1 />"):
        assert blocks(f"<p>a</p>{tag}<p>b</p>") == ["a", "b"]
    for tag in ("<p title=Tom's>", "<p don't>", '<p title="x"">', "<p a=b='c>", "<p title = 'x > y' id=q>"):
        assert blocks(f"<p>a</p>{tag}b</p><p>it's \"c\"</p>") == ["a", "b", "it's \"c\""]
    assert blocks('<p>a</p><svg class="i"><text>x</text></svg><video src=x>y</video><title>z</title><script>"<p>q</p>"</script><p>b</p>') == ["a", "b"]


def test_boosting_learns():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 5))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    assert ((boosting.fit(x[:1500], y[:1500]).margin(x[1500:]) > 0) == y[1500:]).mean() > 0.97


def test_decoding_is_consistent():
    """Against all labellings of small trees."""
    import itertools

    rng = random.Random(0)
    for _ in range(200):
        page = dom.Page("<div>" + "".join(rng.choice(["<p>a</p>", "<div><p>b</p><p>c</p></div>"]) for _ in range(rng.randint(1, 3))) + "</div>")
        n = len(page.parent)
        if n > 13:
            continue
        m = np.array([0] + [rng.uniform(-2, 2) for _ in range(n - 1)])
        best = 0.0
        for keep in itertools.product((0, 1), repeat=n - 1):
            k = (1, *keep)
            if all(not k[i] or k[page.parent[i]] for i in range(1, n)) and all(not k[i] or page.text[i] is not None or any(k[j] for j in range(1, n) if page.parent[j] == i) for i in range(1, n)):
                best = max(best, sum(m[i] for i in range(1, n) if k[i]))
        kept = set(page.decode(m))
        nodes = set(kept)
        for i in kept:
            while page.parent[i] > 0:
                i = page.parent[i]
                nodes.add(i)
        assert abs(sum(m[i] for i in nodes) - best) < 1e-9
