"""Letters of Arrow string columns, on the buffer of a batch as a whole."""
from __future__ import annotations

import numpy as np

from helixframe.kernels.arrow import buffer_of, row_of

__all__ = ["BASE", "buffer_of", "letters_only", "row_of"]

#: byte -> upper-case ASCII letter, 0 for everything else
_UPPER = np.zeros(256, np.uint8)
for _c in range(26):
    _UPPER[65 + _c] = _UPPER[97 + _c] = 65 + _c
#: byte -> 0..3 for A, C, G, T in either case, 4 for any other letter
BASE = np.full(256, 4, np.uint8)
for _k, _c in enumerate("ACGT"):
    BASE[ord(_c)] = BASE[ord(_c.lower())] = _k


def letters_only(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keep the ASCII letters, upper-cased; give the new buffer and offsets."""
    up = _UPPER[data]
    keep = up != 0
    kept = np.concatenate([[0], np.cumsum(keep)])
    return up[keep], kept[offsets]

