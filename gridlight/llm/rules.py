"""Quality rules as a bitmask ledger.

Every rule is evaluated once. The ledger keeps its measurements and one long whose bit b says that rule b failed;
policies are named masks over those bits, and what a policy or an ablation of it keeps follows from the bits alone.
"""

from __future__ import annotations

import functools
import operator
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlight.llm.common import map_rows

SYMBOLS = "#*$%&|<>"
_SPACE = " \t\n\x0b\x0c\r"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_bangs", "n_digits")
#: Bit b is rule b: (name, fails if), over the measurements and in whole numbers. Appended to, never reordered.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "100 * n_symbols > 15 * n_words"),
    ("long_words", "word_chars > 14 * n_words"),
    ("short_words", "word_chars < 2 * n_words"),
    ("dup_lines", "100 * n_dup_lines > 40 * n_lines"),
    ("upper_case", "100 * n_upper > 40 * n_letters"),
    ("exclamations", "100 * n_bangs > 20 * n_words"),
    ("digits", "100 * n_digits > 30 * word_chars"),
    ("no_letters", "100 * n_letters < 50 * word_chars"),
)
BIT = {name: 1 << b for b, (name, _) in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_words"]
#: A version, once used, stays as it is.
POLICIES: dict[str, int] = {
    "base": BASE,
    "v1": BASE | BIT["symbols"] | BIT["upper_case"] | BIT["exclamations"],
    "v2": functools.reduce(operator.or_, BIT.values()),
}
CURRENT = "v2"


def measure(text: str | None) -> tuple[int, ...]:
    """The measurements of one whole text, in the order of MEASURES; null counts as empty."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    lines = [x for x in text.split("\n") if x.strip(_SPACE)]
    windows = list(zip(words, words[1:], words[2:]))  # noqa: B905
    repeated = 0
    if len(set(windows)) < len(windows):
        seen, until = Counter(windows), 0
        for i, x in enumerate(windows):
            if seen[x] > 1:
                repeated += i + 3 - max(i, until)
                until = i + 3
    chars = len(text) - sum(map(text.count, _SPACE))
    letters = sum(map(len, _LETTERS.findall(text)))
    capital = sum(map(len, _UPPER.findall(text)))
    return n, chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated, len(lines), capital, letters, text.count("!"), sum(map(text.count, "0123456789"))


# fixed sets: ASCII letters and the letters of Latin-1 and Latin Extended-A
_LETTERS, _UPPER = re.compile(r"[A-Za-zÀ-ſ]+"), re.compile(r"[A-ZÀ-Þ]+")


def failure_bits() -> Column:
    return functools.reduce(lambda a, b: a.bitwiseOR(b), (F.when(F.expr(rule), F.lit(1 << b)).otherwise(F.lit(0)).cast("long") for b, (_, rule) in enumerate(RULES)))


def ledger(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, the measurements and failure_bits.

    Null and empty texts measure 0 throughout (and so fail few_words); texts are measured whole; repeated rows
    give repeated rows; other columns are ignored.
    """
    kind = df.schema[key].dataType.simpleString()
    ddl = f"`{key}` {kind}" + "".join(f", {m} long" for m in MEASURES)
    measured = map_rows(df.select(key, text), lambda c: [c[0], *map(list, zip(*map(measure, c[1]), strict=True))], ddl)
    return measured.withColumn("failure_bits", failure_bits())


def apply_policy(led: DataFrame, version: str = CURRENT) -> DataFrame:
    """The ledger with kept: no rule of the policy failed."""
    return led.withColumn("kept", F.col("failure_bits").bitwiseAND(F.lit(POLICIES[version])) == 0)


def ablation(led: DataFrame, version: str = CURRENT) -> DataFrame:
    """Per rule of the policy: rows that fail it, that fail nothing else, and rows kept if it were left out.

    Works on counts by failure_bits, of which there are at most 2 ** len(RULES), whatever the number of rows.
    """
    mask = POLICIES[version]
    by = led.groupBy(F.col("failure_bits").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(bit).cast("long").alias("bit")) for name, bit in BIT.items() if bit & mask])).alias("x")
    hit = F.col("bits").bitwiseAND(F.col("bit")) != 0
    alone = F.col("bits") == F.col("bit")
    return (
        by.select("bits", "n", rules)
        .select("bits", "n", "x.*")
        .groupBy("rule", "bit")
        .agg(
            F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias("n_failed"),
            F.coalesce(F.sum(F.when(alone, F.col("n"))), F.lit(0)).alias("n_only"),
            F.coalesce(F.sum(F.when(alone | (F.col("bits") == 0), F.col("n"))), F.lit(0)).alias("n_kept_without"),
        )
    )


def digest(df: DataFrame) -> DataFrame:
    """The contract's columns from a ledger with kept."""
    return df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (F.col("failure_bits").bitwiseAND(F.lit(BASE)) != 0).alias("base_failed"), "kept", "failure_bits")


#: Words need a list per text, windows a list per text too; all of it is plain list work in DuckDB.
ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents),
s AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
g AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k FROM s, unnest(range(1, len(w) - 1)) AS u(i) WHERE len(w) >= 3),
d AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS c FROM g) WHERE c > 1),
p AS (SELECT r, count(DISTINCT i + j) AS n FROM d, (VALUES (0), (1), (2)) AS v(j) GROUP BY r),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
        coalesce(p.n, 0)::BIGINT AS n_repeat_words, len(l)::BIGINT AS n_lines,
        length(regexp_replace(text, '[^A-Z\x{00C0}-\x{00DE}]+', '', 'g')) AS n_upper, length(regexp_replace(text, '[^A-Za-z\x{00C0}-\x{017F}]+', '', 'g')) AS n_letters,
        length(regexp_replace(text, '[^!]+', '', 'g')) AS n_bangs, length(regexp_replace(text, '[^0-9]+', '', 'g')) AS n_digits FROM s LEFT JOIN p USING (r)),
b AS (SELECT *, """ + " + ".join(f"CASE WHEN {rule} THEN {1 << b} ELSE 0 END" for b, (_, rule) in enumerate(RULES)) + f""" AS bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (bits & {BASE}) != 0 AS base_failed,
  (bits & {POLICIES[CURRENT]}) = 0 AS kept, bits::BIGINT AS failure_bits FROM b
"""
