"""Edit-aware token counts: a segment tree per document over pre-token segments.

A leaf is a stretch of text that starts at a safe cut, a single space between two other characters that are not white space: there
byte-level vocabularies always start a new pre-token, whatever stands around. So a text's ids are those of its
leaves, one after the other, and after an edit only the leaves that it touches are encoded again, with a neighbour
where the edit reaches the cut between them. Sums of characters and tokens are updated on the way to the root.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlight.llm.common import map_rows
from gridlight.llm.packing import encoder

#: Characters of a leaf, about; a tree is built anew when a leaf has grown to GROWN times as much.
LEAF, GROWN = 256, 8
CUT = re.compile(r"(?<=\S) (?=\S)")


def leaves(text: str, size: int = LEAF) -> list[str]:
    """The text in stretches of ``size`` characters or more, parted at safe cuts."""
    out, at = [], 0
    while len(text) - at > size and (m := CUT.search(text, at + size)):
        out.append(text[at : m.start()])
        at = m.start()
    return [*out, text[at:]] if at < len(text) else out


class TokenTree:
    """Leaves with sums of characters and tokens; ``count`` gives the tokens of each of a list of texts."""

    def __init__(self, parts: list[str], tokens: list[int], count: Callable[[list[str]], list[int]]):
        self.count, self.encoded = count, 0
        self._fill(parts, tokens)

    def _fill(self, parts: list[str], tokens: list[int]) -> None:
        self.size = 1
        while self.size < len(parts):
            self.size *= 2
        self.parts = parts + [""] * (self.size - len(parts))
        self.chars = [0] * self.size + list(map(len, self.parts))
        self.tokens = [0] * self.size + tokens + [0] * (self.size - len(tokens))
        for i in range(self.size - 1, 0, -1):
            self._sum(i)

    def _sum(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    @property
    def length(self) -> int:
        return self.chars[1]

    def text(self) -> str:
        return "".join(self.parts)

    def _leaf(self, at: int) -> tuple[int, int]:
        """The leaf that holds character ``at`` (the last leaf with text, if it is the end), and where the leaf starts."""
        i, start = 1, 0
        while i < self.size:
            i *= 2
            if at >= start + self.chars[i] and self.chars[i + 1]:
                start += self.chars[i]
                i += 1
        return i - self.size, start

    def edit(self, start: int, end: int, new: str) -> None:
        """Replaces characters start .. end; both are cut to the text."""
        start = max(0, min(start, self.length))
        end = max(start, min(end, self.length))
        # two characters on either side decide whether a cut next to the edit is safe still
        first, base = self._leaf(max(0, start - 2))
        last, _ = self._leaf(min(self.length, end + 2))
        held = "".join(self.parts[first : last + 1])
        held = held[: start - base] + new + held[end - base :]
        parts = leaves(held)
        self.encoded += len(held)
        tokens = self.count(parts) if parts else []
        room = last - first + 1
        if len(parts) > room:  # more stretches than leaves: the last leaf takes the rest, all of them cut safely
            parts, tokens = [*parts[: room - 1], "".join(parts[room - 1 :])], [*tokens[: room - 1], sum(tokens[room - 1 :])]
        for k in range(room):
            i = first + k
            self.parts[i] = parts[k] if k < len(parts) else ""
            self.chars[self.size + i], self.tokens[self.size + i] = len(self.parts[i]), tokens[k] if k < len(parts) else 0
        touched = {(self.size + i) // 2 for i in range(first, last + 1)}
        while touched and touched != {0}:
            for i in touched:
                self._sum(i)
            touched = {i // 2 for i in touched if i > 1}
        if max(map(len, self.parts[first : last + 1])) > GROWN * LEAF:
            self._rebuild()

    def _rebuild(self) -> None:
        """New leaves where one has grown; leaves that stay as they are keep their counts."""
        parts, tokens = [], []
        for p, t in zip(self.parts, self.tokens[self.size :], strict=True):
            if len(p) > GROWN * LEAF and len(cut := leaves(p)) > 1:
                parts += cut
                tokens += self.count(cut)
            elif p:
                parts.append(p)
                tokens.append(t)
        self._fill(parts, tokens)


def recount(docs: DataFrame, edits: Column, vocabulary: str | None = None) -> DataFrame:
    """One row per input row: doc_id, n_tokens, n_tokens_after, n_chars_after, n_edits, n_encoded (characters encoded again), text_crc32.

    ``edits`` is an array of structs (start, end, new), applied in turn, in code points of the text as it is by then. Null
    and empty texts count 0 tokens and can be edited; a null array is no edit, a null in an edit counts as 0 or as no
    text; repeated rows are counted each; no rows give no rows.
    """

    def make(cols: list[list]) -> list[list]:
        encode = encoder(vocabulary)
        count = lambda texts: [len(x) // 4 for x in encode(texts)]
        parts = [leaves(t or "") for t in cols[1]]
        flat = count([p for ps in parts for p in ps])
        out, at = [[] for _ in range(6)], 0
        for ps, changes in zip(parts, cols[2], strict=True):
            tree = TokenTree(ps, flat[at : at + len(ps)], count)
            at += len(ps)
            before = tree.total
            for x in changes or ():
                tree.edit(x["start"] or 0, x["end"] or 0, x["new"] or "")
            for into, v in zip(out, (before, tree.total, tree.length, len(changes or ()), tree.encoded, zlib.crc32(tree.text().encode("utf-8", "surrogatepass"))), strict=True):
                into.append(v)
        return [cols[0], *out]

    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ("n_tokens", "n_tokens_after", "n_chars_after", "n_edits", "n_encoded", "text_crc32")
    return map_rows(docs.select("doc_id", "text", edits.alias("edits")), make, f"doc_id {kind}" + "".join(f", {n} long" for n in names))


def sample_edits() -> Column:
    """Three edits for each document, at places that its text and id decide: a cut, a stamp and a replacement."""
    n = F.coalesce(F.length("text"), F.lit(0))
    place = lambda salt: F.pmod(F.xxhash64(F.lit(salt), "doc_id"), n + 1).cast("long")
    edit = lambda a, b, new: F.struct(a.alias("start"), b.cast("long").alias("end"), new.alias("new"))
    return F.array(edit(place(1), place(1) + 40, F.lit("")), edit(place(2), place(2), F.concat(F.lit(" [rev "), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("] "))), edit(place(3), place(3) + 7, F.lit("it's  so")))
