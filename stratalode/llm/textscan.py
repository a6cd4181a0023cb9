"""Vectorised text scanning shared by the corpus operators.

Two scanners work on whole batches of texts held in one NumPy array:

* :func:`pretokens` cuts texts the way the byte-level BPE vocabularies do
  (contractions, optional leading blank, letters, digits, other, white space);
* :func:`words` cuts at the ASCII blanks ``[\\x20\\x09-\\x0D]`` only.

Both give every piece a 64-bit hash, computed with prefix sums, so no Python
object is made for a piece unless a caller asks for it.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

SPACE, LETTER, DIGIT, OTHER, END = range(5)
_END = 0x110000
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser for 64-bit hashes."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_PRIME = np.uint64((1 << 61) - 1)
_LOW = np.uint64(0xFFFFFFFF)


def _multipliers(n: int, salt: int) -> np.ndarray:
    """Odd pseudo-random multipliers of the first n places of a piece."""
    size = max(64, 1 << (n - 1).bit_length())
    held = _held.get(salt)
    if held is None or len(held) < n:
        held = _held[salt] = mix64(np.arange(1, size + 1, dtype=np.uint64) * _STEP + np.uint64(salt)) | np.uint64(1)
    return held[:n]


_held: dict[int, np.ndarray] = {}


def piece_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
    """Hashes of ``values[start:end]`` (values: mixed uint64) of pieces that lie in order and don't overlap.

    Each value is multiplied by a pseudo-random number of its place in the
    piece, so no pattern of places and letters cancels out; another salt gives
    hashes that don't depend on the first ones.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    began = np.zeros(len(values), np.int64)
    began[starts] = starts
    place = np.arange(len(values)) - np.maximum.accumulate(began)
    place[: starts[0]] = 0
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _multipliers(int(place.max()) + 1, salt)[place], out=total[1:])
    return mix64(total[ends] - total[starts] + (ends - starts).astype(np.uint64) * _STEP)


def _fold(x: np.ndarray) -> np.ndarray:
    x = (x & _PRIME) + (x >> np.uint64(61))
    return np.where(x >= _PRIME, x - _PRIME, x)


def mulmod(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo 2**61 - 1 of numbers below it."""
    a1, a0, b1, b0 = a >> np.uint64(32), a & _LOW, b >> np.uint64(32), b & _LOW
    middle, low = a1 * b0 + a0 * b1, a0 * b0
    high = (a1 * b1) << np.uint64(3)
    middle = (middle >> np.uint64(29)) + ((middle & np.uint64((1 << 29) - 1)) << np.uint64(32))
    return _fold(high + middle + (low & _PRIME) + (low >> np.uint64(61)))


_BASE = 0x13B2A4D5C6E7F809 % ((1 << 61) - 1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _base_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the base and of its inverse."""
    prime = int(_PRIME)
    for k, base in enumerate((_BASE, pow(_BASE, -1, prime))):
        while len(_powers[k]) < n:
            _powers[k] = np.concatenate([_powers[k], mulmod(_powers[k], np.uint64(pow(base, len(_powers[k]), prime)))])
    return _powers[0][:n], _powers[1][:n]


def stretch_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of ``values[start:end]`` of any stretches: polynomials modulo the prime 2**61 - 1."""
    up, down = _base_powers(len(values) + 1)
    terms = mulmod(_fold(values), up[: len(values)])
    low, high = np.zeros(len(values) + 1, np.uint64), np.zeros(len(values) + 1, np.uint64)
    np.cumsum(terms & _LOW, out=low[1:])
    np.cumsum(terms >> np.uint64(32), out=high[1:])
    total = _fold(_fold(low) + mulmod(_fold(high), np.uint64(1 << 32)))
    h = mulmod(_fold(total[ends] + (_PRIME - total[starts])), down[starts])
    return mix64(h + (ends - starts).astype(np.uint64) * _STEP)


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of each code point, as the vocabularies' library sees it.

    Python, the regex module and the library know different versions of
    Unicode; the library itself is asked where the first two differ.
    """
    from unicodedata import category

    import regex
    from tokenizers.pre_tokenizers import ByteLevel

    table = np.full(_END + 1, OTHER, np.uint8)
    kinds = {"L": LETTER, "N": DIGIT, "Z": SPACE}
    patterns = [(LETTER, regex.compile(r"\p{L}")), (DIGIT, regex.compile(r"\p{N}"))]
    newer = table.copy()
    for first in range(0, _END, 0x8000):  # some at a time: the table is made in every worker
        some = "".join(chr(c) for c in range(first, min(first + 0x8000, _END)) if not 0xD800 <= c < 0xE000)
        for kind, pattern in patterns:
            found = "".join(pattern.findall(some))
            newer[np.frombuffer(found.encode("utf-32-le"), "<u4")] = kind
        for c in some:
            if (k := kinds.get(category(c)[0])) is not None:
                table[ord(c)] = k
    cut = ByteLevel(add_prefix_space=False).pre_tokenize_str
    for c in np.flatnonzero((newer != table) & (table != SPACE)).tolist():
        table[c] = next((k for k, before in ((LETTER, "a"), (DIGIT, "1")) if len(cut(before + chr(c))) == 1), OTHER)
    table[[*range(0x09, 0x0E), 0x85]] = SPACE
    table[_END] = END
    return table


def segments(texts: list[str], special: dict[str, int]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Texts cut at special strings, leftmost first and then longest: pieces, the text of each, the ids between pieces, specials in each text."""
    cut = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
    pieces: list[str] = []
    owner: list[int] = []
    between: list[int] = []
    count = np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        at = 0
        if cut is not None:
            for m in cut.finditer(t):
                pieces.append(t[at : m.start()])
                between.append(special[m[0]])
                at = m.end()
                count[i] += 1
        pieces.append(t[at:])
        owner += [i] * (int(count[i]) + 1)
    return pieces, np.array(owner, np.int64), np.array(between, np.int64), count


class Pieces:
    """Pieces of a batch: start and end in ``cp``, the text each is of, and two independent hashes."""

    def __init__(self, cp, starts, ends, owner, hashes, checks):
        self.cp, self.starts, self.ends, self.owner, self.hashes, self.checks = cp, starts, ends, owner, hashes, checks

    def strings(self, which: np.ndarray) -> list[str]:
        raw = self.cp.tobytes() if len(which) > 1000 else None
        out = []
        for s, e in zip(self.starts[which].tolist(), self.ends[which].tolist(), strict=True):
            out.append((raw[4 * s : 4 * e] if raw is not None else self.cp[s:e].tobytes()).decode("utf-32-le"))
        return out


def pretokens(texts: list[str]) -> Pieces:
    """Pre-tokens of texts that hold no special string (:func:`segments` cuts those out)."""
    end = b"\x00\x00\x11\x00"
    cp = np.frombuffer(b"".join([t.encode("utf-32-le") + end for t in texts]), "<u4")
    n = len(cp)
    if not n:
        none = np.zeros(0, np.int64)
        return Pieces(cp, none, none, none, np.zeros(0, np.uint64), np.zeros(0, np.uint64))
    kind = _classes()[cp]
    starts = np.empty(n, bool)
    starts[0] = True
    np.not_equal(kind[1:], kind[:-1], out=starts[1:])
    starts |= kind == END
    run = np.flatnonzero(starts)
    stop = np.append(run[1:], n)
    what = kind[run]
    after = np.append(what[1:], END)
    # White space before something: its last character stands alone, or leads if it's a blank.
    led = (what == SPACE) & (after != END)
    last = stop[led] - 1
    starts[last] = True
    blank = last[cp[last] == 0x20]
    starts[blank + 1] = False
    # Contractions: one apostrophe that leads, then letters.
    q = np.flatnonzero((what == OTHER) & (stop - run == 1) & (after == LETTER))
    q = q[(cp[run[q]] == 0x27) & starts[run[q]]]
    if len(q):
        at, room = run[q], stop[q + 1] - stop[q]
        one = cp[at + 1]
        two = np.where(room > 1, cp[np.minimum(at + 2, n - 1)], 0)
        size = np.where(np.isin(one, [ord(c) for c in "stmd"]), 1, 0)
        for a, b in ("re", "ve", "ll"):
            size = np.where((one == ord(a)) & (two == ord(b)), 2, size)
        hit = size > 0
        starts[at[hit] + 1] = False
        rest = hit & (size < room)
        starts[at[rest] + 1 + size[rest]] = True
    bounds = np.flatnonzero(starts)
    ends = np.append(bounds[1:], n)
    real = kind[bounds] != END
    bounds, ends = bounds[real], ends[real]
    owner = np.searchsorted(np.flatnonzero(kind == END), bounds)
    values = mix64(cp.astype(np.uint64) + np.uint64(1))
    return Pieces(cp, bounds, ends, owner, piece_hashes(values, bounds, ends), piece_hashes(values, bounds, ends, 1))


_BYTES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Words:
    """Words of a batch of UTF-8 texts: byte spans in ``data``, owner text and hash."""

    def __init__(self, data, starts, ends, owner, hashes, n_texts):
        self.data, self.starts, self.ends, self.owner, self.hashes = data, starts, ends, owner, hashes
        counts = np.bincount(owner, minlength=n_texts) if n_texts else np.zeros(0, np.int64)
        #: words of text i are first[i]:first[i + 1]
        self.first = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def words(texts: list[bytes], lower: bool = False, salt: int = 0) -> Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of UTF-8 texts; lower: A-Z count as a-z in the hashes; salt: see :func:`piece_hashes`."""
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    blank = _BLANK[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]]).view(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    offsets = np.cumsum([len(t) + 1 for t in texts]) if texts else np.zeros(0, np.int64)
    owner = np.searchsorted(offsets, starts, side="right")
    values = _BYTES[_LOWER[data] if lower else data]
    return Words(data, starts, ends, owner, piece_hashes(values, starts, ends, salt), len(texts))


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each window of ``size`` values, by doubling; result i covers values i..i+size-1."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, done, block, width, left = None, 0, hashes, 1, size
    while left:
        if left & 1:
            part = block[done:]
            out = part.copy() if out is None else mix64(out[: len(part)] * np.uint64(0xA24BAED4963EE407) + part[: len(out)])
            done += width
        left >>= 1
        if left:
            block = mix64(block[:-width] * np.uint64(0x9FB21C651E98DF25) + block[width:])
            width *= 2
    return out[:n]
