"""Choice of a text encoding, and decoding that drops malformed bytes.

Counts and flags are native expressions; codecs beyond UTF-8 exist only in Python, so the choice itself
and decoding are Arrow-batched UDFs.
"""

from __future__ import annotations

import codecs
import re

import pandas as pd
from pyspark.sql import Column, functions as F

# ---- fixed values: the marks that are counted, the ranges that count as CJK, and the decision limits
PUNCTUATION = "，。！？、：；“”‘’（）《》【】…—"
CJK = "[\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\u3000-\u303f\uff00-\uffef]"
STAGES = (8 * 1024, 64 * 1024, 512 * 1024)
LEAST_DENSITY, LEAD = 0.0005, 3
CERTAIN, CHOSEN, GUESSED = 1.0, 0.9, 0.5
MANUAL = ("utf-8", "utf-16", "gb2312", "gbk", "gb18030", "big5", "shift_jis")

_CJK = re.compile(CJK)
_SCHEMA = "encoding string, confidence double"


def has_cjk(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(CJK)


def punct_density(text: Column, marks: str = PUNCTUATION) -> Column:
    n = F.length(text)
    return (n - F.length(F.translate(text, marks, ""))) / F.greatest(F.lit(1), n)


def utf8_clean(content: Column) -> Column:
    """Valid UTF-8, or valid but for a character cut off at the end."""
    cut = [F.is_valid_utf8(F.substring(content, F.lit(1), F.greatest(F.lit(0), F.octet_length(content) - k)).cast("string")) & F.hex(F.substring(content, -k, 1)).rlike(lead) for k, lead in ((1, "^[C-F]"), (2, "^[EF]"), (3, "^F"))]
    ok = F.is_valid_utf8(content.cast("string"))
    for c in cut:
        ok = ok | c
    return ok


def _clean(raw: bytes) -> bool:
    try:
        codecs.getincrementaldecoder("utf-8")().decode(raw)
        return True
    except UnicodeDecodeError:
        return False


def _density(raw: bytes, name: str) -> float:
    text = raw.decode(name, errors="replace")
    return sum(map(text.count, PUNCTUATION)) / max(1, len(text))


def _evidence(raw: bytes) -> tuple[str, float] | None:
    """What a sample proves; None if it holds no sign of Chinese text."""
    if raw.startswith(codecs.BOM_UTF8):
        return "utf-8-sig", CERTAIN
    if _clean(raw):
        return ("utf-8", CERTAIN) if _CJK.search(raw.decode("utf-8", errors="ignore")) else None
    ranked = sorted(((_density(raw, n), -i, n) for i, n in enumerate(("utf-8", "gb18030", "big5"))), reverse=True)
    (best, _, name), (second, _, _) = ranked[:2]
    return (name, CHOSEN) if best >= LEAST_DENSITY and best >= LEAD * second else None


def detect_bytes(raw: bytes) -> tuple[str, float]:
    return _evidence(raw) or ("utf-8" if _clean(raw) else "gb18030", GUESSED)


def detect_staged(raw: bytes, limit: int = STAGES[-1]) -> tuple[str, float]:
    """Growing samples until one proves something."""
    if not raw:
        return "gb18030", GUESSED
    sample = b""
    for size in STAGES:
        sample = raw[: min(size, limit)]
        found = _evidence(sample)
        if found:
            return found
        if size >= limit:
            break
    return "utf-8" if _clean(sample) else "gb18030", GUESSED


def detect(content: Column, staged: bool = True, limit: int = STAGES[-1]) -> Column:
    """struct<encoding, confidence> of binary content; only the longest sample crosses to Python."""

    @F.pandas_udf(_SCHEMA)
    def run(raw: pd.Series) -> pd.DataFrame:
        pick = (lambda b: detect_staged(b, limit)) if staged else detect_bytes
        return pd.DataFrame([pick(bytes(b or b"")) for b in raw], columns=["encoding", "confidence"])

    return run(F.substring(content, 1, limit) if staged else content)


def strict_ladder(content: Column, names: tuple[str, ...] = ("utf-8", "gb18030", "big5")) -> Column:
    """The first encoding that decodes all bytes, else 'unknown'."""

    @F.pandas_udf("string")
    def run(raw: pd.Series) -> pd.Series:
        def first(b: bytes) -> str:
            for n in names:
                try:
                    b.decode(n)
                    return n
                except UnicodeDecodeError:
                    continue
            return "unknown"

        return raw.map(lambda b: first(bytes(b or b"")))

    return run(content)


def profile(content: Column, limit: int = 200_000) -> Column:
    """The quick choice: utf-8 if the first ``limit`` bytes are, else gb18030.  Without Python."""
    return F.when(F.is_valid_utf8(F.substring(content, 1, limit).cast("string")), "utf-8").otherwise("gb18030")


def is_codec(name: Column) -> Column:
    """Whether Python has a codec of that name (those of ``MANUAL``, and many more)."""

    @F.pandas_udf("boolean")
    def run(names: pd.Series) -> pd.Series:
        def has(n) -> bool:
            try:
                return bool(codecs.lookup(n))
            except (LookupError, TypeError, ValueError):
                return False

        return names.map(has)

    return F.when(name.isin(*MANUAL, "utf-8-sig"), F.lit(True)).otherwise(run(name))


def decode(content: Column, encoding: Column) -> Column:
    """Text without the bytes that are malformed."""

    @F.pandas_udf("string")
    def run(raw: pd.Series, name: pd.Series) -> pd.Series:
        return pd.Series([None if b is None else bytes(b).decode(n or "utf-8", errors="ignore") for b, n in zip(raw, name)])

    return run(content, encoding)
