"""Exact encoding with the tokenizers library, by a table of space-delimited pieces.

Null texts are empty texts, which have no ids; equal texts have equal ids. Very long texts are encoded whole. The table is bounded: it is
begun anew once it holds LIMIT pieces. It reads no tables and no columns; those who call it say what becomes of them.
"""

from __future__ import annotations

import os
import re

import numpy as np

#: Bytes of the pieces that the table holds by their own bytes; what masks a word to so many bytes.
SHORT = 23
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], "<u8")
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], "<u8")


def _grown(x: np.ndarray, size: int) -> np.ndarray:
    """At least that long, with room to grow."""
    if size <= len(x):
        return x
    out = np.zeros((max(size, len(x) * 3 // 2), *x.shape[1:]), x.dtype)
    out[: len(x)] = x
    return out


class _Table:
    """Pieces and their ids, which lie end to end. Short pieces are found by their very bytes, a whole array at a time."""

    def __init__(self):
        self.count, self.used = 0, 0
        self.slots = np.full(1 << 16, -1, np.int32)
        self.keys, self.doubtful = np.zeros((1 << 12, 3), "<u8"), np.zeros(1 << 12, bool)
        self.flat, self.ends = np.zeros(1 << 14, "<u4"), np.zeros(1 << 12, np.int64)
        self.long: dict[str, int] = {}

    @staticmethod
    def _hash(keys: np.ndarray) -> np.ndarray:
        x = keys[:, 0] * _ODD[0] ^ (keys[:, 1] + keys[:, 2] * _ODD[1]) * _ODD[2]
        x ^= x >> np.uint64(31)
        x *= _ODD[1]
        return (x >> np.uint64(20)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 where it is new."""
        out = np.full(len(keys), -1, np.int64)
        mask = len(self.slots) - 1
        slot, left = self._hash(keys) & mask, np.arange(len(keys))
        while left.size:
            at = self.slots[slot]
            there = at >= 0
            left, slot, at = left[there], slot[there], at[there]
            same = (self.keys[at] == keys[left]).all(axis=1)
            out[left[same]] = at[same]
            left, slot = left[~same], slot[~same] + 1 & mask
        return out

    def _place(self, keys: np.ndarray, at: np.ndarray) -> None:
        mask = len(self.slots) - 1
        slot = self._hash(keys) & mask
        while at.size:
            free = np.flatnonzero(self.slots[slot] < 0)
            won = free[np.unique(slot[free], return_index=True)[1]]
            self.slots[slot[won]] = at[won]
            rest = np.ones(len(at), bool)
            rest[won] = False
            at, slot = at[rest], slot[rest] + 1 & mask

    def add(self, ids: np.ndarray, ends: np.ndarray, doubtful: np.ndarray, keys: np.ndarray | None) -> np.ndarray:
        """Places of new pieces; keys: of short ones, which are found from now on."""
        n = len(ends)
        at = np.arange(self.count, self.count + n)
        self.flat, self.ends = _grown(self.flat, self.used + len(ids)), _grown(self.ends, self.count + n)
        self.keys, self.doubtful = _grown(self.keys, self.count + n), _grown(self.doubtful, self.count + n)
        self.flat[self.used : self.used + len(ids)] = ids
        self.ends[at], self.doubtful[at] = self.used + ends, doubtful
        self.count, self.used = self.count + n, self.used + len(ids)
        if keys is not None:
            self.keys[at] = keys
            if 2 * self.count > len(self.slots):
                old = self.slots[self.slots >= 0].astype(np.int64)
                self.slots = np.full(4 * len(self.slots), -1, np.int32)
                self._place(self.keys[old], old)
            self._place(keys, at)
        return at

    def ids_of(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pieces at these places, end to end, and where each ends."""
        begin = np.where(at > 0, self.ends[at - 1], 0)
        size = self.ends[at] - begin
        ends = np.cumsum(size)
        return self.flat[np.repeat(begin - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)], ends


def _keys(raw: np.ndarray, start: np.ndarray, size: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Three words for each short piece: its bytes, its size and whether it leads a text. raw: bytes with room for a word after the last."""
    words = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
    out = np.empty((len(start), 3), "<u8")
    for k in range(3):
        out[:, k] = words[start + 8 * k] & _MASKS[np.clip(size - 8 * k, 0, 8)]
    out[:, 2] |= (size + 32 * first).astype("<u8") << np.uint64(56)
    return out


class Encoder:
    """Ids of whole texts, the same as encode_batch(texts, add_special_tokens=False) gives.

    A byte-level pattern never joins characters across a space but for the space itself, which leads the piece after
    it; only a space between white space, or at the end after white space, is grouped with what stands before. Texts
    without that are cut before every space, and each different piece is encoded by the library once while the table
    holds it. Other texts, and texts that hold an added token's literal, go to the library whole. A tokenizer that drops
    white space is cut at every space. Any other tokenizer encodes whole texts.
    """

    ODD = re.compile(r"\s (?:\s|\Z)")
    SAFE = re.compile(r"[\t\n\r\x20-\x5e\x60-\x7e\xa0-\u012f\u0131-\u024f]*\Z")
    #: Pieces after which the table is begun anew (about 60 bytes a piece); texts with longer pieces go whole.
    LIMIT, LONGEST = 1_000_000, 4096
    #: Parts the texts of a buffer, and leads the key of a text's first piece, which no space leads.
    FIRST = "\0"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        pre = self.library.pre_tokenizer
        #: Added tokens are cut out of a text before anything else: texts that hold one go to the library whole.
        self.added = [x.content for x in self.library.get_added_tokens_decoder().values()]
        self.folded = [x.content.lower() for x in self.library.get_added_tokens_decoder().values() if x.normalized]
        ids = lambda text: self.library.encode(text, add_special_tokens=False).ids
        self.drops_space = ids("a b\tc") == ids("a") + ids("b") + ids("c") and ids(" ") == []
        self.lowers = self.drops_space and ids("A É a, B.\nb!! x's.") == ids("a é") + ids("a") + ids(",") + ids("b") + ids(".") + ids("b") + ids("!!") + ids("x's") + ids(".")
        self.byte_level = isinstance(pre, pre_tokenizers.ByteLevel) and not pre.add_prefix_space and self.library.normalizer is None
        # signs after a letter are tokens of their own, whatever comes next
        self.parts = self.byte_level and ids("ab, É.\nx1!' y?") == ids("ab") + ids(",") + ids(" É") + ids(".\nx1") + ids("!'") + ids(" y") + ids("?")
        #: Tokens that begin (byte level) or end (with a suffix) a piece of letters.
        self.edge = np.zeros(self.library.get_vocab_size(), bool)
        for token, at in self.library.get_vocab().items():
            self.edge[at] = token.endswith("</w>") if self.drops_space else token.startswith("Ġ")
        self.clear()

    def clear(self) -> None:
        self.table = _Table()

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, "<u4") for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _raw(self, key: str) -> str:
        return key if self.drops_space else key[1:] if key.startswith(self.FIRST) else " " + key

    def _learn(self, buffer: bytes, start: np.ndarray, stop: np.ndarray, first: np.ndarray, plain: np.ndarray, keys: np.ndarray | None) -> np.ndarray:
        """Places of new pieces of the buffer, which the library encodes: plain ones, which can't change in company, together."""
        a, b = start.tolist(), stop.tolist()
        own, rest = np.flatnonzero(plain & ~first), np.flatnonzero(~plain | first).tolist()
        order, ids, sizes = [np.zeros(0, np.int64)], [np.zeros(0, "<u4")], [np.zeros(0, np.int64)]
        for at in range(0, len(own), 1000):
            part = own[at : at + 1000]
            words = b" ".join([buffer[a[n] : b[n]] for n in part.tolist()]).decode()
            found = np.array(self.library.encode_batch_fast([words if self.drops_space else " " + words], add_special_tokens=False)[0].ids, "<u4")
            edges = np.flatnonzero(self.edge[found])
            if len(edges) == len(part):
                order.append(part), ids.append(found)
                sizes.append(np.diff(edges + 1 if self.drops_space else np.append(edges[1:], len(found)), prepend=0))
            else:
                rest += part.tolist()
        doubtful = np.zeros(len(start), bool)
        for at in range(0, len(rest), 1000):
            part = rest[at : at + 1000]
            words = [buffer[a[n] : b[n]].decode("utf-8", "surrogatepass") for n in part]
            if not self.drops_space:  # the space before an empty piece, or one that begins with white space, may be an odd one
                doubtful[part] = [not x or x[0].isspace() and not (x == "\n" and first[n]) for x, n in zip(words, part)]
                words = [x if first[n] else " " + x for n, x in zip(part, words)]
            found = self.whole(words)
            order.append(np.array(part)), sizes.append(np.array([len(x) for x in found]))
            ids += found
        at = np.concatenate(order)
        places = np.empty(len(start), np.int64)
        places[at] = self.table.add(np.concatenate(ids), np.cumsum(np.concatenate(sizes)), doubtful[at], None if keys is None else keys[at])
        return places

    def _places(self, texts: list[str], ends: np.ndarray, tails: bool) -> tuple[np.ndarray, np.ndarray]:
        """The table's places of the texts' pieces, and how many pieces each text has; -1: a text with a piece that is too long.

        ends: by byte, whether it ends a piece. tails: signs after a letter or digit at a piece's end are a piece of their own.
        """
        buffer = self.FIRST.join(texts).encode("utf-8", "surrogatepass")
        raw = np.frombuffer(buffer + bytes(32), np.uint8)
        space = np.flatnonzero(ends[raw[: len(buffer)]]) + 1
        alone = space[:0]
        if tails and not self.drops_space:  # a line end between two visible characters is a token by itself
            alone = np.flatnonzero(raw[1 : len(buffer) - 1] == 10) + 1 if len(buffer) > 2 else alone
            alone = alone[_SEEN[raw[alone - 1]] & _SEEN[raw[alone + 1]]]
        start = np.concatenate([[0], space, alone, alone + 1])
        order = np.argsort(start, kind="stable")
        start, led = start[order], np.concatenate([[False], np.ones(len(space), bool), np.zeros(2 * len(alone), bool)])[order]
        stop = np.append(start[1:] - led[1:], len(buffer))
        text = np.append(True, led[1:] & (raw[start[1:] - 1] == 0))
        first, row, size = text | ~led, np.cumsum(text) - 1, stop - start
        counts = np.full(len(texts), -1, np.int64)
        good = np.maximum.reduceat(size, np.flatnonzero(text)) <= self.LONGEST
        kept = good[row] & (size > 0) if self.drops_space else good[row]
        start, stop, row, first = start[kept], stop[kept], row[kept], first[kept] & (not self.drops_space)
        if tails:
            other = np.where(_SIGN[raw], 0, np.arange(1, len(raw) + 1))
            cut = np.maximum.accumulate(other)[stop - 1]  # where the last signs begin
            letter = raw[cut - 1]
            two = (letter >= 0x80) & (raw[cut - 2] >= 0xC3) & (raw[cut - 2] <= 0xC9) & ~((raw[cut - 2] == 0xC3) & ((letter == 0x97) | (letter == 0xB7)))
            parted = np.flatnonzero((cut > start) & (cut < stop) & (_WORD[letter] | two))
            start, stop, row = (np.insert(x, parted + 1, y) for x, y in ((start, cut[parted]), (stop, stop[parted]), (row, row[parted])))
            stop[parted + np.arange(len(parted))] = cut[parted]
            # no space leads such signs, as none leads a text's first piece
            first = np.insert(first, parted + 1, not self.drops_space)
        size = stop - start
        counts[good] = np.bincount(row, minlength=len(texts))[good]
        at = np.full(len(start), -1, np.int64)
        short = np.flatnonzero(size <= SHORT)
        keys = _keys(raw, start[short], size[short], first[short])
        own = self.table.find(keys)
        if (new := np.flatnonzero(own < 0)).size:
            each = new[np.unique(keys[new].view("V24").ravel(), return_index=True)[1]]
            n = short[each]
            self._learn(buffer, start[n], stop[n], first[n], self._plain(raw, start[n], stop[n]), keys[each])
            own[new] = self.table.find(keys[new])
        at[short] = own
        wide = np.flatnonzero(size > SHORT).tolist()
        names = [buffer[start[n] : stop[n]] + (b"\x01" if first[n] else b"\x00") for n in wide]
        if lost := list({x: n for x, n in zip(names, wide) if x not in self.table.long}.items()):
            n = np.array([x[1] for x in lost])
            found = self._learn(buffer, start[n], stop[n], first[n], self._plain(raw, start[n], stop[n]), None)
            self.table.long |= zip([x[0] for x in lost], found.tolist())
        at[wide] = [self.table.long[x] for x in names]
        return at, counts

    def _plain(self, raw: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Pieces that can stand in a text of such pieces, their tokens told by their edges.

        Letters alone where white space is dropped, else any that neither begin nor end with white space.
        """
        if self.drops_space:
            size = stop - start
            odd = np.append(0, np.cumsum(_UNLIKE[raw[np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())]]))
            edges = np.append(0, np.cumsum(size))
            return (odd[edges[1:]] == odd[edges[:-1]]) & (size > 0)
        head, last, before = raw[start], raw[stop - 1], raw[stop - 2]
        blank = (head <= 0x20) | (head == 0xC2) | ((head >= 0xE1) & (head <= 0xE3))
        blank |= (last <= 0x20) | (last >= 0x80) & ((before == 0xC2) | (before == 0x80) | (before == 0x81) | (before == 0x9A))
        return ~blank & (stop > start)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """One array of ids for each text; a null is an empty text."""
        texts = [x or "" for x in texts]
        out: list[np.ndarray | None] = [None] * len(texts)
        lowered: list[tuple[int, str]] = []
        spaced: list[tuple[int, str]] = []
        for row, text in enumerate(texts):
            if any(x in text for x in self.added) or self.folded and any(x in text.lower() for x in self.folded) or self.FIRST in text:
                continue
            if self.lowers and self.SAFE.match(text):
                lowered.append((row, text.lower().replace("\xa0", " ")))
            elif self.drops_space or self.byte_level:
                spaced.append((row, text))
        if self.table.count > self.LIMIT:
            self.clear()
        for chosen, ends, tails in ((lowered, _SPACES, True), (spaced, _SPACE, self.parts)):
            if not chosen:
                continue
            at, counts = self._places([x for _, x in chosen], ends, tails)
            ids, last = self.table.ids_of(at)
            pieces = np.append(0, np.cumsum(np.maximum(counts, 0)))
            edges = np.append(0, last)[pieces]
            doubt = np.append(0, np.cumsum(self.table.doubtful[at]))[pieces]
            for n, (row, text) in enumerate(chosen):
                if counts[n] >= 0 and (doubt[n] == doubt[n + 1] or not self.ODD.search(text)):
                    out[row] = ids[edges[n] : edges[n + 1]]
        if others := [n for n, x in enumerate(out) if x is None]:
            for n, x in zip(others, self.whole([texts[n] for n in others])):
                out[n] = x
        return out


#: By byte: a space or a text's end; any white space that SAFE has; signs but for the underscore; letters and digits of lower case.
_SPACE, _SPACES, _SIGN, _WORD = (np.zeros(256, bool) for _ in range(4))
_SPACE[[0, 32]] = _SPACES[[0, 9, 10, 13, 32]] = True
_SIGN[[c for c in range(33, 127) if not chr(c).isalnum() and c != 95]] = True
#: ASCII signs, letters and digits, and every byte of letters from U+00C0 to U+024F.
_SEEN = np.zeros(256, bool)
_WORD[[c for c in range(128) if chr(c).isalnum()]] = True
_SEEN[[*range(33, 127), *range(0xC3, 0xCA)]] = True
#: Bytes that no word of letters up to U+024F has in lower case; U+00D7 and U+00F7 are told by a byte that some letters share.
_UNLIKE = np.ones(256, bool)
_UNLIKE[[*range(97, 123), *(c for c in range(0x80, 0xC0) if c not in (0x97, 0xB7)), *range(0xC3, 0xCA)]] = False

_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's own encoder of that file."""
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
