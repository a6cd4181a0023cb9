"""Byte-level BPE on batches of pre-tokens, by two methods.

* :class:`RankMerger` (rank-synchronous array merging) holds the pre-tokens of
  a batch as one ragged array; each round applies every sequence's lowest-rank
  pair, at all its places, to all sequences at once.
* :class:`PrefixEncoder` (per-prefix dynamic programming) stores the one token
  that ends the encoding of each prefix; see there.

:class:`Memo` keeps what a worker has found for pre-tokens, up to a bound.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np

from . import textscan

NONE = np.int32(2**31 - 1)
BITS = 31  # of an id in the key of a pair


@lru_cache(maxsize=4)
def load(path: str) -> Vocabulary:
    return Vocabulary(path)


class Vocabulary:
    """Tokens as bytes, byte ids, and merges as arrays sorted by pair."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = {b: chr(b) for b in plain}
        shown |= {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in shown)}
        back = {c: b for b, c in shown.items()}
        vocab = spec["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        if any(x.get(flag) for x in spec["added_tokens"] for flag in ("single_word", "lstrip", "rstrip")):
            raise ValueError(f"{path}: added tokens that depend on their neighbours aren't known")
        size = 1 + max([*vocab.values(), *self.special.values()])
        self.id_type = np.uint16 if size <= 1 << 16 else np.uint32
        self.tokens: list[bytes] = [b""] * size
        for t, i in vocab.items():
            self.tokens[i] = bytes(back[c] for c in t)
        for t, i in self.special.items():
            self.tokens[i] = t.encode()
        self.byte_ids = np.array([vocab[shown[b]] for b in range(256)], np.int32)
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        pairs = np.array([(vocab[a] << BITS) | vocab[b] for a, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int32)
        # The first rank of a pair counts.
        pairs, rank = np.unique(pairs, return_index=True)
        self.pairs, self.rank, self.made_by_rank = pairs, rank.astype(np.int32), made
        self._slots()
        self.ranks = dict(zip(pairs.tolist(), rank.tolist(), strict=True))
        self.by_bytes = {t: i for i, t in enumerate(self.tokens) if t and i not in self.special.values()}

    def _slots(self) -> None:
        """An open-addressing table of the pairs, as two arrays."""
        self.bits = max(8, (8 * len(self.pairs)).bit_length())
        self.slot_pair = np.full(1 << self.bits, -1, np.int64)
        self.slot_rank = np.full(1 << self.bits, NONE, np.int32)
        slot = self._slot(self.pairs)
        left = np.arange(len(self.pairs))
        while len(left):
            free = self.slot_pair[slot[left]] < 0
            _, one = np.unique(slot[left], return_index=True)
            put = left[one[free[one]]]
            self.slot_pair[slot[put]], self.slot_rank[slot[put]] = self.pairs[put], self.rank[put]
            left = np.setdiff1d(left, put)
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left.astype(np.int64) << BITS) | right
        slot = self._slot(key)
        got = self.slot_pair[slot]
        rank = np.where(got == key, self.slot_rank[slot], NONE)
        open_ = np.flatnonzero((got != key) & (got >= 0))
        while len(open_):  # the next slot, till the pair or a free slot is met
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            got = self.slot_pair[slot[open_]]
            hit = got == key[open_]
            rank[open_[hit]] = self.slot_rank[slot[open_[hit]]]
            open_ = open_[~hit & (got >= 0)]
        return rank

    def decode(self, ids: list[int]) -> str:
        """Text of ids; bytes that aren't UTF-8 become U+FFFD."""
        return b"".join(map(self.tokens.__getitem__, ids)).decode("utf-8", "replace")


class RankMerger:
    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and how many each word has."""
        raw = [w.encode() for w in words]
        size = np.array([len(r) for r in raw], np.int64)
        symbols = self.v.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        word = np.repeat(np.arange(len(raw)), size)
        kept_s, kept_w = [], []
        rank = self._ranks(symbols, word)
        while len(symbols):
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            lowest = np.minimum.reduceat(rank, first)
            length = np.diff(np.append(first, len(word)))
            best = np.repeat(lowest, length)
            live = best != NONE
            if not live.all():
                kept_s.append(symbols[~live])
                kept_w.append(word[~live])
                symbols, word, rank, best = symbols[live], word[live], rank[live], best[live]
                if not len(symbols):
                    break
            hit = rank == best
            at = np.arange(len(hit))
            begins = hit & ~np.concatenate([[False], hit[:-1]])
            since = at - np.maximum.accumulate(np.where(begins, at, 0))
            hit &= since % 2 == 0  # in a run of one symbol, every other pair
            where = np.flatnonzero(hit)
            symbols[where] = self.v.made_by_rank[best[where]]
            keep = np.ones(len(symbols), bool)
            keep[where + 1] = False
            symbols, word, rank = symbols[keep], word[keep], rank[keep]
            where -= np.arange(len(where))
            # Only pairs beside a merge change.
            near = np.concatenate([where, where[where > 0] - 1])
            rank[near] = self._ranks_at(symbols, word, near)
        s = np.concatenate(kept_s) if kept_s else np.zeros(0, np.int32)
        w = np.concatenate(kept_w) if kept_w else np.zeros(0, np.int64)
        order = np.argsort(w, kind="stable")
        return s[order], np.bincount(w, minlength=len(words)).astype(np.int64)

    def _ranks(self, symbols, word):
        rank = np.full(len(symbols), NONE, np.int32)
        if len(symbols) > 1:
            same = word[1:] == word[:-1]
            rank[:-1][same] = self.v.rank_of(symbols[:-1][same], symbols[1:][same])
        return rank

    def _ranks_at(self, symbols, word, at):
        rank = np.full(len(at), NONE, np.int32)
        inside = at + 1 < len(symbols)
        inside[inside] = word[at[inside] + 1] == word[at[inside]]
        here = at[inside]
        rank[inside] = self.v.rank_of(symbols[here], symbols[here + 1])
        return rank


class PrefixEncoder:
    """Exact BPE by dynamic programming over prefixes.

    For every prefix of a pre-token the last token of its encoding is unique.
    A token that ends at a place is that last token if it may follow the last
    token of the prefix before it: two neighbours are compatible when encoding
    their joined bytes gives back just the two. Tokens that end at a place come
    from the suffix links of an automaton over the vocabulary (each state links
    to the longest token that is a proper suffix of its string); the ids are
    read off by following the back-pointers from the end.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self._build()
        self._fits: dict[int, bool] = {}
        split = np.full((len(vocabulary.tokens), 2), -1, np.int64)
        order = np.argsort(vocabulary.rank, kind="stable")[::-1]
        made = vocabulary.made_by_rank[vocabulary.rank[order]]
        split[made, 0], split[made, 1] = vocabulary.pairs[order] >> BITS, vocabulary.pairs[order] & ((1 << BITS) - 1)
        self.split = split.tolist()
        self.made_rank = [-1] * len(vocabulary.tokens)
        for m, k in zip(made.tolist(), vocabulary.rank[order].tolist(), strict=True):
            self.made_rank[m] = k

    def _build(self) -> None:
        go: list[dict[int, int]] = [{}]
        token = [-1]
        for t, i in self.v.by_bytes.items():
            s = 0
            for b in t:
                nxt = go[s].get(b)
                if nxt is None:
                    nxt = go[s][b] = len(go)
                    go.append({})
                    token.append(-1)
                s = nxt
            token[s] = i
        fail = [0] * len(go)
        ends: list[tuple[tuple[int, int], ...]] = [()] * len(go)
        depth = [0] * len(go)
        queue = [0]
        for s in queue:
            for b, n in go[s].items():
                depth[n] = depth[s] + 1
                f = fail[s]
                while s and f and b not in go[f]:
                    f = fail[f]
                fail[n] = go[f].get(b, 0) if s else 0
                own = ((token[n], depth[n]),) if token[n] >= 0 else ()
                ends[n] = own + ends[fail[n]]
                queue.append(n)
        self.go, self.fail, self.ends = go, fail, ends

    def fits(self, left: int, right: int) -> bool:
        """Whether the encoding of the two tokens' joined bytes is just the two."""
        key = (left << BITS) | right
        got = self._fits.get(key)
        if got is None:
            if len(self._fits) > 2_000_000:
                self._fits.clear()
            got = self._fits[key] = self._compatible(left, right)
        return got

    def _compatible(self, a: int, b: int) -> bool:
        # Undo the later of the two last merges step by step; at each level no
        # pair across the border may have a rank that would have come first.
        ranks, rank_of, split = self.v.ranks, self.made_rank, self.split
        limit = 1 << 30
        while True:
            cross = ranks.get((a << BITS) | b)
            if cross is not None and cross < limit:
                return False
            if rank_of[a] > rank_of[b]:
                limit = rank_of[a]
                a = split[a][1]
            else:
                if rank_of[b] < 0:
                    return True
                limit = rank_of[b]
                b = split[b][0]
                limit += 1  # at equal rank the pair across the border is further left

    def encode(self, word: str) -> list[int]:
        data = word.encode()
        go, fail, ends, known, fits = self.go, self.fail, self.ends, self._fits, self.fits
        last: list[int] = [-1] * (len(data) + 1)
        size: list[int] = [0] * (len(data) + 1)
        state = 0
        for i, b in enumerate(data, 1):
            nxt = go[state].get(b)
            while nxt is None and state:
                state = fail[state]
                nxt = go[state].get(b)
            state = nxt or 0
            for token, n in ends[state]:
                before = i - n
                if not before:
                    last[i], size[i] = token, n
                    break
                left = last[before]
                ok = known.get((left << BITS) | token)
                if ok is None:
                    ok = fits(left, token)
                if ok:
                    last[i], size[i] = token, n
                    break
        out = []
        i = len(data)
        while i:
            out.append(last[i])
            i -= size[i]
        out.reverse()
        return out


class Memo:
    """Ids of pre-tokens, at most ``bound`` of them; beyond it all are forgotten and found again.

    A pre-token is known by two independent 64-bit hashes. One whose first hash
    is another's is encoded for itself.
    """

    def __init__(self, encode, bound: int = 700_000, id_type=np.uint16):
        self.encode, self.bound, self.id_type = encode, bound, id_type
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.checks = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.ids = np.zeros(0, self.id_type)

    def look_up(self, pieces: textscan.Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each piece: where its ids begin in ``ids``, and how many; then ``ids``."""
        keys, first, inverse = np.unique(pieces.hashes, return_index=True, return_inverse=True)
        if len(self.keys) > self.bound:
            self._forget()
        where = np.searchsorted(self.keys, keys)
        there = np.zeros(len(keys), bool)
        inside = where < len(self.keys)
        there[inside] = self.keys[where[inside]] == keys[inside]
        fresh = np.flatnonzero(~there)
        if len(fresh):
            ids, size = self.encode(pieces.strings(first[fresh]))
            at = len(self.ids) + np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)
            self.ids = np.concatenate([self.ids, ids.astype(self.id_type)])
            put = where[fresh]
            self.keys = np.insert(self.keys, put, keys[fresh])
            self.checks = np.insert(self.checks, put, pieces.checks[first[fresh]])
            self.at = np.insert(self.at, put, at)
            self.size = np.insert(self.size, put, size)
            where = np.searchsorted(self.keys, keys)
        where = where[inverse]
        at, size, out = self.at[where], self.size[where], self.ids
        odd = np.flatnonzero(self.checks[where] != pieces.checks)
        if len(odd):
            ids, own = self.encode(pieces.strings(odd))
            at[odd], size[odd] = len(out) + np.cumsum(own) - own, own
            out = np.concatenate([out, ids.astype(self.id_type)])
        return at, size, out


_memos: dict[tuple[str, str], Memo] = {}


def memo(path: str, method: str) -> Memo:
    """The worker's memo for a vocabulary and method: merge or prefix."""
    if (path, method) not in _memos:
        if method == "merge":
            encode = RankMerger(load(path)).encode
        elif method == "prefix":
            one = PrefixEncoder(load(path)).encode

            def encode(words):
                got = [one(w) for w in words]
                return np.array([i for ids in got for i in ids], np.int32), np.array([len(x) for x in got], np.int64)
        else:
            raise ValueError(f"unknown method {method!r}")
        _memos[path, method] = Memo(encode, id_type=load(path).id_type)
    return _memos[path, method]


def chunks(texts: list[str], most: int = 500_000):
    """(first, texts) of runs of texts of about ``most`` characters; a longer text stands alone."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield first, texts[first:i]
            first, size = i, 0
        size += len(t)
    if first < len(texts):
        yield first, texts[first:]


def count(texts: list[str], path: str, method: str = "merge") -> np.ndarray:
    """Tokens of each text."""
    parts, owner, _, special = textscan.segments(texts, load(path).special)
    pieces = textscan.pretokens(parts)
    _, size, _ = memo(path, method).look_up(pieces)
    return special + np.bincount(owner[pieces.owner], weights=size, minlength=len(texts)).astype(np.int64)


def encode(texts: list[str], path: str, method: str = "merge") -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in a row, and how many each text has."""
    parts, owner, between, special = textscan.segments(texts, load(path).special)
    pieces = textscan.pretokens(parts)
    at, size, ids = memo(path, method).look_up(pieces)
    total = int(size.sum())
    begin = np.cumsum(size) - size
    out = ids[np.arange(total) + np.repeat(at - begin, size)] if total else np.zeros(0, ids.dtype)
    if len(between):  # one special id between the parts of a text
        per_part = np.bincount(pieces.owner, weights=size, minlength=len(parts)).astype(np.int64)
        stop = np.cumsum(per_part)
        inner = np.flatnonzero(np.append(owner[1:] == owner[:-1], False))
        out = np.insert(out, stop[inner], between)
    n = special + np.bincount(owner[pieces.owner], weights=size, minlength=len(texts)).astype(np.int64)
    return out, n
