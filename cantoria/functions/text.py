"""Scalar text functions as Spark Column expressions (JVM-side; only ``nfkc`` needs Python).

Regex patterns are exposed as module constants so the DuckDB oracle can use the very same character classes.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters Python's str.strip() treats as whitespace (so strip semantics match the study's pandas code; Spark's
# trim() only removes spaces).
PY_WS = (r"[\t\n\x{0B}\f\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
         r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")
STRIP_RE = rf"\A{PY_WS}+|{PY_WS}+\z"
WORD_RUN_RE = r"[\p{L}\p{N}_]+"            # a maximal run of Unicode word characters (Python's \w)
WORD_CLASS_RE = r"[a-záéíóúñü]+"           # P7 token class
# P7 in one pass: a class run with no word character on either side is exactly a maximal \w run made only of
# class letters (so 'mère' yields nothing, not 'm' or 're').
WORD_TOKEN_RE = r"(?<![\p{L}\p{N}_])[a-záéíóúñü]+(?![\p{L}\p{N}_])"
CODE_TOKEN_RE = r"(?U)\b[a-záéíóúñü0-9-]+\b"  # P8 token rule


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


# The characters Python's str.isspace() accepts, built by rule (so ``py_strip`` is exactly str.strip()).
PY_WS_CHARS = "".join(ch for ch in map(chr, range(0x3001)) if ch.isspace())


def py_strip(col) -> Column:
    """Python ``str.strip()``: Spark's trim with an explicit character set (touches only the two ends, unlike a
    regex that would scan the whole text)."""
    return F.trim(_c(col), F.lit(PY_WS_CHARS))


def collapse_ws(col, lower: bool = True) -> Column:
    """Strip, collapse whitespace runs to one space, optionally lower-case."""
    out = F.regexp_replace(py_strip(col), f"{PY_WS}+", " ")
    return F.lower(out) if lower else out


def _nfkc_one(t):
    if t is None or (isinstance(t, float) and t != t):
        return ""
    t = str(t).encode("utf-8", "ignore").decode("utf-8")
    if not unicodedata.is_normalized("NFKC", t):
        t = unicodedata.normalize("NFKC", t)
    return t


def _nfkc_arrow(arr):
    """NFKC over an Arrow string batch. ASCII strings are NFKC-stable, so only the non-ASCII ones (found with
    a vectorised test) are converted to Python and normalised; the batch is rebuilt only if one changed."""
    import pyarrow as pa
    import pyarrow.compute as pc
    arr = pc.fill_null(arr, "")
    non_ascii = pc.indices_nonzero(pc.invert(pc.string_is_ascii(arr)))
    places, values = [], []
    for start in range(0, len(non_ascii), 64):        # few texts at a time are Python strings
        some = non_ascii.slice(start, 64)
        for i, v in zip(some.to_pylist(), arr.take(some).to_pylist()):
            nv = _nfkc_one(v)
            if nv != v:
                places.append(i)
                values.append(nv)
    if not places:
        return arr
    changed = np.zeros(len(arr), dtype=bool)
    changed[places] = True
    return pc.replace_with_mask(arr, pa.array(changed), pa.array(values, type=arr.type))


if hasattr(F, "arrow_udf"):
    # Arrow-native: the batch stays an Arrow string array end to end (no pandas objects).
    _nfkc_udf = F.arrow_udf(T.StringType())(_nfkc_arrow)
else:  # pragma: no cover - older Spark
    @F.pandas_udf(T.StringType())
    def _nfkc_udf(s: pd.Series) -> pd.Series:
        return s.map(_nfkc_one)


def normalize_text(col) -> Column:
    """NFKC, strip; null -> ''. (Spark strings are valid UTF-8, so there is nothing unencodable to drop.)

    NFKC has no SQL built-in, so it runs as an Arrow UDF over whole batches (pyarrow's utf8_normalize) — the
    only Python step of the text path."""
    return py_strip(_nfkc_udf(_c(col)))


def _accent_map() -> tuple[str, str]:
    """Precomposed Latin letters -> base letter, built by rule (NFD minus combining marks)."""
    src, dst = [], []
    for cp in list(range(0xC0, 0x250)) + list(range(0x1E00, 0x1F00)):
        ch = chr(cp)
        base = "".join(c for c in unicodedata.normalize("NFD", ch) if unicodedata.category(c) != "Mn")
        if base != ch and len(base) == 1:
            src.append(ch)
            dst.append(base)
    return "".join(src), "".join(dst)


ACCENT_SRC, ACCENT_DST = _accent_map()


def strip_accents(col) -> Column:
    return F.translate(_c(col), ACCENT_SRC, ACCENT_DST)


def fingerprint(artist, song) -> Column:
    """lower(artist || song), accents removed, keep [a-z0-9]; null parts count as ''."""
    joined = F.lower(F.concat(F.coalesce(_c(artist), F.lit("")), F.coalesce(_c(song), F.lit(""))))
    return F.regexp_replace(strip_accents(joined), "[^a-z0-9]", "")


def word_runs(col) -> Column:
    """Maximal runs of Unicode word characters of the lower-cased text (``\\w+`` tokens)."""
    return F.regexp_extract_all(F.lower(_c(col)), F.lit(WORD_RUN_RE), 0)


def tokens(col, mode: str = "word") -> Column:
    """P7 (``mode='word'``): whole tokens of ``[a-záéíóúñü]+``; a token touching a digit or another letter is
    dropped, not cut. P8 (``mode='code'``): the same class plus digits and '-'."""
    if mode == "word":
        return F.regexp_extract_all(F.lower(_c(col)), F.lit(WORD_TOKEN_RE), 0)
    if mode == "code":
        return F.regexp_extract_all(F.lower(_c(col)), F.lit(CODE_TOKEN_RE), 0)
    if mode == "runs":
        return word_runs(col)
    raise ValueError(mode)


def remove_stopwords(col, stopwords: list[str], mode: str = "word") -> Column:
    """Tokens not in the stop list, joined by one space; null -> ''."""
    stop = sorted(set(stopwords))
    kept = F.filter(tokens(col, mode), lambda t: ~t.isin(stop))
    return F.coalesce(F.array_join(kept, " "), F.lit(""))


def parse_release_title(col) -> tuple[Column, Column]:
    """P4: 'Artist - Album' -> (artist without '*' and '(n)', album or 'Single/Album'). The album is the second of the
    parts between separators, as it stands; further parts are not part of it."""
    parts = F.split(_c(col), " - ")
    artist = F.trim(F.regexp_replace(F.regexp_replace(parts.getItem(0), r"\*", ""), r"\(\d+\)", ""))
    album = F.when(F.size(parts) > 1, parts.getItem(1)).otherwise(F.lit("Single/Album"))
    return artist, album


def year_num(col, default=None) -> Column:
    """P10: numeric year or null (text 'nan' counts as null); optional default."""
    y = _c(col).try_cast("double")
    y = F.when(F.isnan(y), F.lit(None).cast("double")).otherwise(y)
    return F.coalesce(y, F.lit(float(default))) if default is not None else y


def bucket(year_col, width: int) -> Column:
    """floor(year / width) * width as int (decade: 10, lustrum: 5)."""
    return (F.floor(_c(year_col) / width) * width).cast("int")


def label_int(col) -> Column:
    """Non-numeric or blank label -> 0, else int (via double, so '2.0' -> 2)."""
    v = _c(col).cast("string").try_cast("double")
    return F.coalesce(F.when(~F.isnan(v), v).cast("int"), F.lit(0))
