"""Words and word shingles of a text, as bytes."""

from __future__ import annotations

import numpy as np

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def shingles(text: str | None, size: int) -> tuple[bytes, list[tuple[int, int]]]:
    """The lower-cased words joined by spaces, and each shingle's bounds in it (fewer words: one shingle of all)."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return b"", []
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    if len(words) < size:
        return b" ".join(words), [(0, int(ends[-1]))]
    starts = np.concatenate(([0], ends[:-1] + 1))
    return b" ".join(words), list(zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True))
