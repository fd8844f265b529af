"""Token ids of whole texts by the tokenizers library, memoised by the stretch that its byte-level cut gives.

A byte-level BPE cuts a text into stretches before it merges anything: runs of letters, of digits, or of marks, each with
the one space before it, and runs of white space. A stretch has the same ids in every text, so each one is encoded by
the library once per worker and looked up by a 64-bit hash after that, for a megabyte of text at a time. Where the cut
depends on more than the kinds of bytes (apostrophes, characters beyond the alphabets below), everything between two
white spaces is one stretch, cut by the library itself. Texts that hold an added token's content or white space
beyond ASCII are encoded whole.
"""

from __future__ import annotations

import json
import os
import threading
import time
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

from .textarrays import VALUE, give_back, mix64, pieces, powers

#: Stretches that a worker remembers, and bytes of the longest one; beyond, the memory starts anew.
REMEMBERED, LONGEST = 900_000, 200
#: Stretches that the library is given in one text.
TOGETHER = 100
#: Seconds without a text after which a worker, which lives on for other work, gives its memory back.
IDLE = 3.0
_WHITE, _LETTER, _DIGIT, _MARK, _OTHER = 0, 2, 3, 4, 5
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[[0x20, *range(0x09, 0x0E)]] = _WHITE
_KIND[33:127] = _MARK
_KIND[ord("'")] = _OTHER
_KIND[[*range(65, 91), *range(97, 123)]] = _LETTER
_KIND[48:58] = _DIGIT
#: First bytes of the alphabets of two bytes a letter: Latin and Cyrillic. Two signs among them are no letters.
_LEADS = np.zeros(256, bool)
_LEADS[[*range(0xC3, 0xCA), 0xD0, 0xD1]] = True
#: First bytes of white space beyond ASCII, and control characters that some count as white space.
_WIDE = np.zeros(256, bool)
_WIDE[[0xC2, 0xE1, 0xE2, 0xE3, *range(0x1C, 0x20)]] = True
_WIDE_SPACES = tuple(c.encode() for c in map(chr, (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, *range(0x1C, 0x20))))
_SLOTS = 1 << 21
_ENCODERS: dict[str, Encoder] = {}


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """The place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def cut(body: np.ndarray, off: np.ndarray, added: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the stretches of all rows, and each one's kind, that of its last byte; ``_OTHER`` also for whole texts."""
    n = len(body)
    kind = _KIND[body]
    begins = np.zeros(n + 1, bool)
    begins[off] = True
    lead = np.flatnonzero(_LEADS[body])
    if len(lead):
        after = body[lead + 1]
        lead = lead[(body[lead] != 0xC3) | (after != 0x97) & (after != 0xB7)]
        kind[lead] = kind[lead + 1] = _LETTER
    white = kind == _WHITE
    other = np.flatnonzero(kind == _OTHER)
    if len(other):
        edge = white.copy()
        edge[1:] |= white[:-1]
        edge |= begins[:-1]
        starts = np.flatnonzero(edge & ~white)
        spans = np.append(np.flatnonzero(edge), n)
        ends = spans[np.searchsorted(spans, starts, "right")]
        k = np.unique(np.searchsorted(starts, other, "right") - 1)
        kind[_ranges(starts[k], ends[k])] = _OTHER
    first = begins[:-1].copy()
    first[1:] |= kind[1:] != kind[:-1]
    # Of a run of white space before something else, the last character stands alone; a space goes to what follows it.
    last = np.flatnonzero(white[:-1] & ~white[1:] & ~begins[1:-1])
    first[last] = True
    first[last[body[last] == 0x20] + 1] = False
    whole = _odd_rows(body, off, added)
    if len(whole):
        inside = _ranges(off[whole], off[whole + 1])
        first[inside] = False
        kind[inside] = _OTHER
        first[off[whole]] = True
    starts = np.flatnonzero(first)
    return starts, kind[np.append(starts[1:], n) - 1]


def _ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after the other."""
    sizes = ends - starts
    return np.repeat(ends - np.cumsum(sizes), sizes) + np.arange(int(sizes.sum()))


def _odd_rows(body: np.ndarray, off: np.ndarray, added: list[bytes]) -> np.ndarray:
    """The rows, not empty, that must be encoded whole."""
    raw, at = body.tobytes(), []
    sought = (*added, *_WIDE_SPACES) if _WIDE[body].any() else added
    for mark in sought:
        k = raw.find(mark)
        while k >= 0:
            row = int(np.searchsorted(off, k, "right")) - 1
            if k + len(mark) <= off[row + 1]:
                at.append(row)
                k = raw.find(mark, int(off[row + 1]))
            else:
                k = raw.find(mark, k + 1)
    return np.unique(np.array(at, np.int64))


class Encoder:
    """``ids`` gives the ids of a text column."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        #: Added tokens are cut out of a text before it falls into stretches.
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        made = json.loads(self.tokenizer.to_str())
        pre = made["pre_tokenizer"] or {}
        #: Whether the vocabulary cuts as described above; others encode every text whole.
        self.cuts = pre.get("type") == "ByteLevel" and pre.get("use_regex") is True and pre.get("add_prefix_space") is False and made["normalizer"] is None and made["model"]["type"] == "BPE"
        # Stretches that need no cutting are given to the library by lines, which it takes apart before it encodes them.
        self.by_line = Tokenizer.from_file(path)
        self.by_line.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.CharDelimiterSplit("\n"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.bytes_of = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, np.int64)
        for token, k in self.tokenizer.get_vocab().items():
            self.bytes_of[k] = len(token)
        self.held = threading.Lock()
        self.used = time.monotonic()
        self.watch: threading.Thread | None = None
        self.clear()

    def clear(self) -> None:
        """Forget all stretches."""
        self.keys: np.ndarray | None = None
        self.pool = np.zeros(0, self.dtype)
        self.filled = self.known = 0

    def forget(self) -> None:
        while True:
            time.sleep(IDLE / 2)
            with self.held:
                if time.monotonic() - self.used > IDLE:
                    self.clear()
                    self.watch = None
                    break
        give_back()

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: Iterable[bytes]) -> list[bytes]:
        """Each text's ids as little-endian bytes."""
        texts = pa.array([t.decode() for t in texts], pa.string())
        out: list[bytes] = []
        for _, ids, off in self.ids(texts):
            out += [ids[a:z].tobytes() for a, z in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
        return out

    def ids(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids, where each row's begin and the last one's end) for about a megabyte of text at a time; null
        counts as empty."""
        for row, _, body, off in pieces(column, 1 << 20):
            with self.held:
                if self.watch is None:
                    self.watch = threading.Thread(target=self.forget, daemon=True)
                    self.watch.start()
                try:
                    ids, ends = self._ids(body, off)
                finally:
                    self.used = time.monotonic()
            yield row, ids, ends

    def _ids(self, body: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(body):
            return np.zeros(0, self.dtype), np.zeros(len(off), np.int64)
        if not self.cuts:
            raw = body.tobytes()
            each = self.whole([raw[a:z].decode() for a, z in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)])
            return np.concatenate(each), np.concatenate([[0], np.cumsum([len(x) for x in each])])
        starts, kinds = cut(body, off, self.added)
        sizes = np.diff(np.append(starts, len(body)))
        forward, back = powers(len(body))
        hashes = mix64(np.add.reduceat(VALUE[body] * forward[: len(body)], starts) * back[starts] + sizes.astype(np.uint64))
        hashes[hashes == 0] = 1
        if self.keys is None or self.known > REMEMBERED:
            self.clear()
            self.keys, self.at, self.count = np.zeros(_SLOTS, np.uint64), np.zeros(_SLOTS, np.int64), np.zeros(_SLOTS, np.int64)
        kept = self.filled
        place = self._look_up(hashes)
        new = np.flatnonzero(place < 0)
        at, count = self.at[place], self.count[place]
        if len(new):
            _, k, inverse = np.unique(hashes[new], return_index=True, return_inverse=True)
            fresh = new[k]
            own_at, own_count = self._learn(body, starts[fresh], sizes[fresh], kinds[fresh])
            at[new], count[new] = own_at[inverse], own_count[inverse]
            short = sizes[fresh] <= LONGEST
            kept = self._keep(hashes[fresh][short], own_at[short], own_count[short], kept)
        ends = np.cumsum(count)
        ids = self.pool[np.repeat(at - (ends - count), count) + np.arange(int(ends[-1]))]
        if kept < self.filled:
            self.filled = kept  # long stretches are forgotten
        before = np.concatenate([[0], ends])
        return ids, before[np.searchsorted(starts, off)]

    def _look_up(self, hashes: np.ndarray) -> np.ndarray:
        """The slot of each hash, -1 where it isn't known."""
        mask = np.int64(_SLOTS - 1)
        slot = (hashes & np.uint64(_SLOTS - 1)).astype(np.int64)
        there = self.keys[slot]
        out = np.where(there == hashes, slot, -1)
        left = np.flatnonzero((there != hashes) & (there != 0))
        while len(left):
            slot[left] = (slot[left] + 1) & mask
            there = self.keys[slot[left]]
            hit = there == hashes[left]
            out[left[hit]] = slot[left[hit]]
            left = left[~hit & (there != 0)]
        return out

    def _keep(self, hashes: np.ndarray, at: np.ndarray, count: np.ndarray, kept: int) -> int:
        """Enter distinct new hashes; returns the end of the ids that stay. What is learnt comes short stretches first."""
        self.known += len(hashes)
        if self.known > _SLOTS * 3 // 4:  # a piece with more new stretches than fit is looked up, not remembered
            return kept
        mask = np.int64(_SLOTS - 1)
        slot = (hashes & np.uint64(_SLOTS - 1)).astype(np.int64)
        left = np.arange(len(hashes))
        while len(left):
            free = left[self.keys[slot[left]] == 0]
            _, one = np.unique(slot[free], return_index=True)
            put = free[one]
            self.keys[slot[put]], self.at[slot[put]], self.count[slot[put]] = hashes[put], at[put], count[put]
            left = left[self.keys[slot[left]] != hashes[left]]
            slot[left] = (slot[left] + 1) & mask
        return max(kept, int((at + count).max(initial=kept)))

    def _learn(self, body: np.ndarray, starts: np.ndarray, sizes: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Encode stretches; where their ids stand in the pool, and how many there are. Short ones come first."""
        order = np.lexsort((kinds, sizes > LONGEST))
        at, count = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        for group in (order[sizes[order] <= LONGEST], order[sizes[order] > LONGEST]):
            plain = group[(kinds[group] != _OTHER) & (kinds[group] != _WHITE)]
            rest = group[(kinds[group] == _OTHER) | (kinds[group] == _WHITE)]
            if len(plain):
                ids, n = self._lines(body, starts[plain], sizes[plain])
                at[plain], count[plain] = self._put(ids) + np.cumsum(n) - n, n
            if len(rest):
                each = self.whole([body[a : a + s].tobytes().decode() for a, s in zip(starts[rest].tolist(), sizes[rest].tolist(), strict=True)])
                n = np.array([len(x) for x in each])
                at[rest], count[rest] = self._put(np.concatenate(each)) + np.cumsum(n) - n, n
        return at, count

    def _lines(self, body: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of stretches that the library needn't cut, and how many each has: a token's bytes are those it stands for."""
        ends = np.cumsum(sizes + 1)
        raw = body[np.minimum(np.repeat(starts - (ends - sizes - 1), sizes + 1) + np.arange(int(ends[-1])), len(body) - 1)]
        raw[ends - 1] = 10
        text, cuts = raw.tobytes(), [0, *ends[TOGETHER - 1 :: TOGETHER].tolist()]
        if cuts[-1] != len(text):
            cuts.append(len(text))
        found = self.by_line.encode_batch_fast([text[a : z - 1].decode() for a, z in zip(cuts[:-1], cuts[1:], strict=True)], add_special_tokens=False)
        ids = np.concatenate([np.array(e.ids, self.dtype) for e in found])
        until = np.searchsorted(np.cumsum(self.bytes_of[ids]), np.cumsum(sizes)) + 1
        n = np.diff(until, prepend=0)
        if until[-1] != len(ids) or (np.add.reduceat(self.bytes_of[ids], until - n) != sizes).any():
            raise ValueError("the vocabulary's tokens don't spell the text's bytes")
        return ids, n

    def _put(self, ids: np.ndarray) -> int:
        """Append to the pool."""
        at = self.filled
        if at + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool[:at], np.zeros(len(ids) + max(1 << 20, at // 2), self.dtype)])
        self.pool[at : at + len(ids)] = ids
        self.filled = at + len(ids)
        return at


def encoder(path: str) -> Encoder:
    """This worker's encoder of a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
