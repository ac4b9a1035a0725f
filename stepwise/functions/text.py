"""Text normalisation and pre-tokenisation (F1-F4): Spark's functions, and F2 on whole Arrow columns inside tasks.

Java's ``\\s`` is ASCII-only while the specified behaviour strips and splits on Python's
Unicode whitespace, so the class is spelled out.  The same patterns run on
RE2 (the SQL oracle), which accepts the ``\\x{...}`` escapes too.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python treats as whitespace (str.isspace):
# U+0009-000D, U+001C-001F, U+0020, U+0085, U+00A0, U+1680, U+2000-200A,
# U+2028, U+2029, U+202F, U+205F, U+3000.
WS_CLASS = (r"\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
            r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}")

# The single punctuation characters that split words (each is
# kept as a word of its own); '@' is deliberately not among them.
PUNCT_CHARS = ",.'\"!#$%^&*(){}[];:<>/?\\|`~-_=+"

_PUNCT_CLASS = "".join("\\" + c if c in "[]\\-^&" else c for c in PUNCT_CHARS)
DELIM_CLASS = f"[{_PUNCT_CLASS}{WS_CLASS}]"
WORD_PATTERN = f"{DELIM_CLASS}|[^{_PUNCT_CLASS}{WS_CLASS}]+"
#: The characters of ``WS_CLASS``.
WHITESPACE = "".join(chr(c) for low, high in re.findall(r"\\x\{(\w+)\}(?:-\\x\{(\w+)\})?", WS_CLASS) for c in range(int(low, 16), int(high or low, 16) + 1))

_ASCII_DELIM = np.zeros(256, bool)
_ASCII_DELIM[[ord(c) for c in PUNCT_CHARS + WHITESPACE if ord(c) < 128]] = True
_WIDE = [np.array([ord(c) for c in WHITESPACE if len(c.encode()) == n]) for n in (2, 3)]


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_text(c) -> Column:
    """strip Unicode whitespace at both ends."""
    return F.btrim(_c(c), F.lit(WHITESPACE))


def pre_tokenize(c) -> Column:
    """split into words and single delimiter characters (all kept, no empties)."""
    return F.regexp_extract_all(_c(c), F.lit(WORD_PATTERN), 0)


def word_lists(texts: pa.Array) -> pa.ListArray:
    """F2 of a whole Arrow column: the words as slices of its bytes, the same as ``pre_tokenize``; none of a null text."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    n, buf = len(texts), texts.buffers()
    off = np.frombuffer(buf[1], np.int32)[texts.offset:texts.offset + n + 1] if n else np.zeros(1, np.int32)
    data = np.frombuffer(buf[2], np.uint8)[off[0]:off[-1]] if buf[2] is not None else np.zeros(0, np.uint8)
    bounds = off - off[0]
    begin = np.append(_ASCII_DELIM[data], False)
    begin[1:] |= begin[:-1]  # a word starts at a delimiter and behind it
    for size, low, high in ((2, 0xC2, 0xDF), (3, 0xE0, 0xEF)):
        lead = np.flatnonzero((data >= low) & (data <= high))
        lead = lead[lead + size <= len(data)]
        code = data[lead].astype(np.int64) & (0x1F if size == 2 else 0x0F)
        for i in range(1, size):
            code = code << 6 | data[lead + i] & 0x3F
        lead = lead[np.isin(code, _WIDE[size - 2])]
        begin[lead] = begin[lead + size] = True
    begin[bounds[:-1]] = True
    begin[-1] = False
    starts = np.flatnonzero(begin).astype(np.int32)
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, np.int32(len(data)))), pa.py_buffer(data))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(starts, bounds), pa.int32()), words)


def to_chars(c) -> Column:
    """a word as its code points."""
    return F.split(_c(c), "")


def join_tokens(c) -> Column:
    """F4."""
    return F.array_join(_c(c), "")
