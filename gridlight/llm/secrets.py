"""Secret scan: fixed patterns, plus runs that a tokenizer vocabulary compresses badly.

A random string costs about one token for every 1.2 to 1.7 characters under a byte-pair vocabulary, since its
pairs were never merged; words and identifiers take one for three or more. Runs that are known not to be
secrets (digests of usual lengths, UUIDs, numbers, names made of words) are left out before the ratio is taken.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlight.llm.common import map_rows

#: Kinds in the order in which spans with one start are listed.
KINDS = ("assign", "access", "hex", "random")
_ANY = "".join
_WORD = _ANY(f"[{c.upper()}{c}]" if c.isalpha() else c for c in "password|passwd|secret|token|api_?key")
ASSIGN = re.compile(rf"({_WORD})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Runs that are not secrets: digests by length, UUIDs, names of words joined by - or _ with at most a short number.
DIGESTS = frozenset((32, 40, 56, 64, 96, 128))
ALL_HEX = re.compile(r"[0-9a-fA-F]+")
UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
_NAME_WORD = r"(?:[A-Z]?[a-z]{1,19}|[A-Z]{1,19}|[0-9]{1,8})(?![A-Za-z0-9])"
NAME = re.compile(rf"[/_=+-]*{_NAME_WORD}(?:[/_=+-]+{_NAME_WORD})*[/_=+-]*")
#: Parts of a run between separators; a UUID is one part.
PART = re.compile(rf"{UUID.pattern}(?![A-Za-z0-9])|[A-Za-z0-9]+")
#: Below so many characters a token, a run of at least 20 characters counts as random.
RATIO = 2.0
#: Least length of a run or random stretch, and of a part that such a stretch is grown from.
LEAST, CORE = 20, 8


@functools.lru_cache(maxsize=2)
def encoding(path: str | None):
    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the three fixed patterns: leftmost, non-overlapping within a kind, too short ones dropped."""
    found = [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)] if "AKIA" in text else []
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    return sorted(found)


def is_known(run: str) -> bool:
    """Whether a run is a digest of a usual length, a UUID, a number or a name made of words of under 20 letters."""
    if not any(map(str.isalpha, run)):
        return True
    if ALL_HEX.fullmatch(run):
        return len(run) in DIGESTS
    return bool(UUID.fullmatch(run) or NAME.fullmatch(run))


def random_parts(run: str, tokens: Callable[[str], int], ratio: float = RATIO) -> list[tuple[int, int]]:
    """Stretches of 20 or more characters of neighbouring parts below the ratio, each with a part that can't be a word.

    So a random string is found behind a path or a long name, with which the whole run passes the ratio.
    """
    out, first, last, core = [], 0, 0, False
    for m in [*PART.finditer(run), None]:
        joins = is_core = False
        if m:
            part = m[0]
            cost = ratio * tokens(part)
            is_core = len(part) >= CORE and not is_known(part) and len(part) < cost
            # short neighbours may be pieces of a key with separators in it; digits are dates and ids
            joins = is_core or len(part) < LEAST and len(part) <= cost and not part.isdigit()
        if joins:
            first = first if last else m.start()
            last, core = m.end(), core or is_core
            continue
        if core and last - first >= LEAST:
            out.append((first, last))
        first, last, core = 0, 0, False
    return out


def stretches(a: int, b: int, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """What base spans, sorted by start, leave of a..b."""
    out = []
    for s, _, e in base:
        if s >= b:
            break
        if e > a:
            if s > a:
                out.append((a, s))
            a = e
    return [*out, (a, b)] if a < b else out


def random_spans(text: str, base: list[tuple[int, int, int]], tokens: Callable[[str], int], ratio: float = RATIO) -> list[tuple[int, int, int]]:
    """What is left of runs without base spans, in stretches of 20 or more characters with fewer than ``ratio`` characters a
    token, or else their parts with fewer."""
    out = []
    for m in RUN.finditer(text):
        for a, b in stretches(*m.span(), base):
            run = text[a:b]
            if b - a < LEAST or is_known(run):
                continue
            if len(run) < ratio * tokens(run):
                out.append((a, 3, b))
            else:
                out += [(a + s, 3, a + e) for s, e in random_parts(run, tokens, ratio)]
    return out


def render(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), vocabulary: str | None = None, ratio: float = RATIO) -> DataFrame:
    """One row per input row: ``keep`` columns, n_assign, n_access, n_hex, n_random, base and spans (kind:start:end lists).

    Null and empty texts have no spans; texts of any length are scanned whole; repeated rows give repeated results;
    other columns are ignored. ``vocabulary`` is the path of a tiktoken rank file on every node.
    """
    from pyspark.sql.types import StructType

    kept = StructType([df.schema[c] for c in keep])

    def make(cols: list[list]) -> list[list]:
        enc = encoding(vocabulary)
        cost = lambda run: len(enc.encode_ordinary(run))
        counts, bases, spans = [[] for _ in KINDS], [], []
        for t in cols[-1]:
            base = base_spans(t) if t else []
            more = random_spans(t, base, cost, ratio) if t else []
            for k, into in enumerate(counts):
                into.append(sum(s[1] == k for s in base) if k < 3 else len(more))
            bases.append(render(base))
            spans.append(render(sorted(base + more)))
        return [*cols[:-1], *counts, bases, spans]

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + "".join(f", n_{k} long" for k in KINDS) + ", base string, spans string"
    return map_rows(df.select(*keep, text), make, ddl)


def redact_text(text: str | None, tokens: Callable[[str], int], mark: str = "<SECRET>", ratio: float = RATIO) -> str | None:
    """The text with every span, overlapping ones as one, replaced by ``mark``."""
    if not text:
        return text
    base = base_spans(text)
    out, at = [], 0
    for a, _, b in sorted(base + random_spans(text, base, tokens, ratio)):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]]) if out else text


def redact(df: DataFrame, text: str = "text", vocabulary: str | None = None, mark: str = "<SECRET>") -> DataFrame:
    """df with every secret in ``text`` replaced by ``mark``; all columns stay, n_chars (if any) follows the new text."""
    from pyspark.sql.types import StringType

    @F.pandas_udf(StringType())
    def clean(texts):
        enc = encoding(vocabulary)
        return texts.map(lambda t: redact_text(t, lambda run: len(enc.encode_ordinary(run)), mark), na_action="ignore")

    out = df.withColumn(text, clean(F.col(text)))
    return out.withColumn("n_chars", F.length(text).cast(df.schema["n_chars"].dataType)) if "n_chars" in df.columns else out


def digest(df: DataFrame) -> DataFrame:
    """The contract's columns from scan()'s rows."""
    return df.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "n_random")
