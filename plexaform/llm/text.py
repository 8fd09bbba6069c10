"""Text repair shared by the operators on documents."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd

#: Letters of other scripts that look like Latin ones (NFKC leaves them as they are).
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x",
    "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ѡ": "w", "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H",
    "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "Α": "A", "Β": "B", "Ε": "E", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Χ": "X",
}
_LOOKS = str.maketrans(LOOKALIKES)
_MIXED = re.compile(r"[a-zA-Z]")
_HIDDEN = dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0x180E])
_BYTES = re.compile("[Â-ô][\u0080-¿]{1,3}")
_TAG = re.compile(r"</?[a-zA-Z][a-zA-Z0-9]{0,9}(?:\s[^<>]{0,200})?/?>")


def _decoded(m: re.Match) -> str:
    try:
        return m.group(0).encode("latin-1").decode("utf-8")
    except UnicodeError:
        return m.group(0)


def repaired(text: str) -> str:
    """The text as meant: entities and tags resolved, UTF-8 read as Latin-1 decoded again, hidden characters gone,
    compatibility forms folded, look-alike letters put back. ASCII without '&' and '<' is returned as it is."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if text.isascii():
        return text
    text = _BYTES.sub(_decoded, text).translate(_HIDDEN)
    text = unicodedata.normalize("NFKC", text)
    return text if text.isascii() else text.translate(_LOOKS)


def chunks(batch: pd.DataFrame, column: str = "text", limit: int = 4_000_000) -> Iterator[pd.DataFrame]:
    """The rows of a batch in parts of about ``limit`` characters (one longer text is a part of its own), so that long
    texts in one batch don't add up in a worker's memory."""
    at = (batch[column].str.len().fillna(0).cumsum() // limit).astype("int64").to_numpy()
    for k in sorted(set(at.tolist())):
        yield batch[at == k]
