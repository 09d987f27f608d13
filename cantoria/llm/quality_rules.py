"""Quality rules: one threshold table compiled into one Spark projection, built-in functions only.

``measure`` adds the counts, ``verdict`` compiles the rules over them. Every expression works in the document's row:
no shuffle, no explode, no user function, so the cost is one scan whatever the skew of sources or copies.

Defined results: a null or empty text has no words, lines or symbols and is rejected (fewer than 50 words); a text
without line breaks is one line; repeated rows are judged alike, each on its own; other columns are passed through,
but one named like an added column (``COUNTS``, base_failed, failed_rules, kept) is replaced by it; ``keep`` returns
the input's columns as they were; an empty table gives an
empty result. Word windows are compared by a 64-bit hash inside one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cantoria.llm.common import SPACES, packed, unpacked

SYMBOLS = "#*$%&|<>"
#: fixed values: common function words of the four languages of the corpus
STOP_WORDS = (
    "a an and are as at be by for from he in is it of on or that the this to was were with "
    "au aux ce dans de des du en est et il la le les ne pas pour qui que se sur un une "
    "al con del el es las lo los no por su una y para "
    "als auf auch das dem den der die ein eine für im ist mit nicht sich und von zu").split()
CAPITALS = "".join(chr(c) for c in [*range(0x41, 0x5B), *range(0xC0, 0xDF)] if chr(c).isupper())

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop", "n_capitals", "n_bangs"]

#: name, numerator, denominator, lowest and highest allowed ratio (None: open). A rule without words or lines holds.
RULES = [
    ("word_length", "word_chars", "n_words", 2.0, 15.0),
    ("symbols", "n_symbols", "n_words", None, 0.2),
    ("bangs", "n_bangs", "n_words", None, 0.2),
    ("capitals", "n_capitals", "word_chars", None, 0.5),
    ("stop_words", "n_stop", "n_words", 0.02, None),
    ("dup_lines", "n_dup_lines", "n_lines", None, 0.5),
]


def _count_of(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the columns COUNTS (long)."""
    t = F.coalesce(F.col("_doc")[text], F.lit(""))
    has_word = lambda line: F.length(F.trim(F.translate(line, SPACES[1:], " " * (len(SPACES) - 1)))) > 0
    bound = packed(docs).withColumns({
        "_words": F.array_remove(F.split(F.translate(t, SPACES[1:], " " * (len(SPACES) - 1)), " ", -1), ""),
        "_lines": F.filter(F.split(t, "\n", -1), has_word)})
    n = F.size("_words")
    words = F.col("_words")
    bound = bound.withColumn("_tri", F.when(n >= 3, F.transform(
        F.slice(words, 1, F.greatest(n - 2, F.lit(0))),
        lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))).otherwise(F.array().cast("array<bigint>")))
    # windows that occur once are the common case: only texts with a repeat pay for the sort
    bound = bound.withColumn("_sorted", F.when(
        F.size(F.array_distinct("_tri")) < F.size("_tri"),
        F.sort_array(F.transform("_tri", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    rows = F.col("_sorted")
    same = lambda x, j: F.coalesce(F.get(rows, j)["h"] == x["h"], F.lit(False))
    bound = bound.withColumn("_starts", F.sort_array(F.transform(
        F.filter(rows, lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["i"])))
    # words covered by [i, i + 2] for the sorted starts i: each start adds its distance to the next, 3 at most
    covered = F.aggregate("_starts", F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
                          lambda acc, i: F.struct((acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n"), i.alias("last")))
    counts = {
        "n_words": n,
        "word_chars": F.length(F.translate(t, SPACES, "")),
        "n_symbols": _count_of(t, SYMBOLS),
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
        "n_repeat_words": F.coalesce(covered["n"], F.lit(0)),
        "n_lines": F.size("_lines"),
        "n_stop": F.size(F.filter(words, lambda w: F.lower(w).isin(STOP_WORDS))),
        "n_capitals": _count_of(t, CAPITALS),
        "n_bangs": _count_of(t, "!"),
    }
    return unpacked(bound.withColumns({k: v.cast("bigint") for k, v in counts.items()}), docs.columns, COUNTS)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def rule_fails(rule) -> Column:
    """True if the ratio is outside its bounds; compared without division: low * denominator <= numerator <= high * ..."""
    _, num, den, low, high = rule
    num, den = F.col(num).cast("double"), F.col(den).cast("double")
    outside = F.lit(False)
    if low is not None:
        outside = outside | (num < F.lit(float(low)) * den)
    if high is not None:
        outside = outside | (num > F.lit(float(high)) * den)
    return outside


def verdict(measured: DataFrame, rules=RULES) -> DataFrame:
    """Adds base_failed, failed_rules (names, comma-joined, empty if none) and kept."""
    names = F.concat_ws(",", *[F.when(rule_fails(r), F.lit(r[0])) for r in rules])
    return (measured.withColumns({"base_failed": base_failed(), "failed_rules": names})
            .withColumn("kept", ~F.col("base_failed") & (F.col("failed_rules") == "")))


def quality_rules(docs: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """The documents with their counts and verdict."""
    return verdict(measure(docs, text), rules)


def keep(docs: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """The documents that no rule rejects, with their own columns.

    A plain filter on the verdict would be pushed below the projections and repeat their expressions many times over;
    a row number, which is not deterministic, keeps it above them."""
    judged = quality_rules(packed(docs).select("_doc", F.col("_doc")[text].alias("text")), "text", rules)
    judged = judged.withColumn("_row", F.monotonically_increasing_id()).filter(F.col("kept") & (F.col("_row") >= 0))
    return unpacked(judged, docs.columns, [])


def sql() -> str:
    """DuckDB SQL for op3 over the view documents."""
    def ratio(rule):
        name, num, den, low, high = rule
        parts = [f"{num}::DOUBLE < {float(low)!r}::DOUBLE * {den}::DOUBLE"] if low is not None else []
        parts += [f"{num}::DOUBLE > {float(high)!r}::DOUBLE * {den}::DOUBLE"] if high is not None else []
        return f"CASE WHEN {' OR '.join(parts)} THEN '{name}' END"

    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    spaces = r"\x20\x09-\x0D"
    return rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS rid FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^{spaces}]+') AS words,
             list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^{spaces}]')) AS lines FROM t),
pos AS (SELECT rid, words, unnest(range(1, len(words) + 1)) AS i FROM w),
tri AS (SELECT rid, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c FROM pos WHERE i <= len(words) - 2),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM tri) WHERE n >= 2),
cov AS (SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, i + k AS j FROM twice, (SELECT unnest([0, 1, 2]) AS k)) GROUP BY rid),
m AS (SELECT doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[{spaces}]', '', 'g'))::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
             len(lines)::BIGINT AS n_lines, len(list_filter(words, lambda x: lower(x) IN ({stop})))::BIGINT AS n_stop,
             length(regexp_replace(text, '[^{CAPITALS}]', '', 'g'))::BIGINT AS n_capitals,
             length(regexp_replace(text, '[^!]', '', 'g'))::BIGINT AS n_bangs
      FROM w LEFT JOIN cov USING (rid)),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
             concat_ws(',', {', '.join(ratio(r) for r in RULES)}) AS failed_rules FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND failed_rules = '' AS kept, n_lines, n_stop, n_capitals, n_bangs, failed_rules FROM v"""
