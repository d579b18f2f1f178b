"""Byte-level BPE through the tokenizers library, with remembered pieces.

A text is cut at places where the cut cannot change the result.  Pieces are
looked up by a 64-bit hash in a numpy table; only pieces new to the worker are
turned into strings and given to the library, in batches.  A tokenizer whose
rules do not allow the cut is given whole texts.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Sequence

import numpy as np

from .textkit import hash_words, kept

#: Pieces remembered by a worker; beyond that it starts afresh.  About 45 bytes each.
REMEMBERED = 1_000_000

# A space is a safe place to cut unless white space stands on both its sides: a
# run of white space is then never divided.  Bytes that may end, or begin, a
# white space character are taken as white space: cutting less is always safe.
_ENDS_SPACE = np.zeros(256, dtype=bool)
_ENDS_SPACE[[*range(0x09, 0x0E), *range(0x1C, 0x21), *range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] = True
_BEGINS_SPACE = np.zeros(256, dtype=bool)
_BEGINS_SPACE[[*range(0x09, 0x0E), *range(0x1C, 0x21), 0xC2, 0xE1, 0xE2, 0xE3]] = True
# No pre-token goes on from a letter to a sign: a sign after an ASCII letter is a
# safe place, too (an apostrophe opens a pre-token of its own).
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_SIGN = np.zeros(256, dtype=bool)
_SIGN[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True


def cuts_safely(spec: dict) -> bool:
    """Whether the pieces described above are encoded independently."""
    pre = spec.get("pre_tokenizer") or {}
    model = spec.get("model") or {}
    return (
        pre.get("type") == "ByteLevel"
        and pre.get("use_regex", True)
        and not pre.get("add_prefix_space", True)
        and spec.get("normalizer") is None
        and model.get("type") == "BPE"
        and not model.get("dropout")
        and not spec.get("truncation")
        and not spec.get("padding")
        and all(not (t.get("lstrip") or t.get("rstrip") or t.get("single_word") or re.search(r"\s", t["content"])) for t in spec.get("added_tokens", []))
    )


def piece_starts(buf: np.ndarray, offs: np.ndarray, special: list[bytes] = ()) -> np.ndarray:
    """Where pieces begin: at each row's first byte and at each safe place.

    A row's end counts as white space: white space before it is one run.
    Special strings are not divided.
    """
    start = buf == 0x20
    if len(buf) > 1:
        after = np.ones(len(buf), dtype=bool)
        after[:-1] = _BEGINS_SPACE[buf[1:]]
        after[offs[1:][offs[1:] > 0] - 1] = True
        start[1:] &= ~(_ENDS_SPACE[buf[:-1]] & after[1:])
    start[1:] |= _LETTER[buf[:-1]] & _SIGN[buf[1:]]
    if special:
        raw = buf.tobytes()
        for s in special:
            at = raw.find(s)
            while at >= 0:
                start[at + 1 : at + len(s)] = False
                at = raw.find(s, at + 1)
    start[offs[:-1][offs[:-1] < offs[1:]]] = True
    return np.flatnonzero(start)


class Remembered:
    """Hash -> entry number, with linear probing over numpy arrays."""

    def __init__(self, limit: int = REMEMBERED):
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.count = 0
        self._size(1 << 16)

    def _size(self, slots: int) -> None:
        self._mask = np.uint64(slots - 1)
        self._keys = np.zeros(slots, np.uint64)
        self._entry = np.full(slots, -1, np.int32)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The entry of each hash, -1 where there is none."""
        slot = hashes & self._mask
        entry = self._entry[slot]
        open_ = np.flatnonzero((entry >= 0) & (self._keys[slot] != hashes))
        while len(open_):
            slot[open_] = (slot[open_] + np.uint64(1)) & self._mask
            entry[open_] = self._entry[slot[open_]]
            open_ = open_[(entry[open_] >= 0) & (self._keys[slot[open_]] != hashes[open_])]
        return entry

    def add(self, hashes: np.ndarray) -> None:
        """Number distinct new hashes on from ``count``."""
        slots = len(self._keys)
        while 2 * (self.count + len(hashes)) > slots:
            slots *= 2
        if slots > len(self._keys):
            used = self._entry >= 0
            keys, entry = self._keys[used], self._entry[used]
            self._size(slots)
            self._place(keys, entry)
        self._place(hashes, np.arange(self.count, self.count + len(hashes), dtype=np.int32))
        self.count += len(hashes)

    def _place(self, hashes: np.ndarray, entry: np.ndarray) -> None:
        slot = hashes & self._mask
        while len(hashes):
            free = np.flatnonzero(self._entry[slot] < 0)
            own, first = np.unique(slot[free], return_index=True)
            won = free[first]
            self._keys[own], self._entry[own] = hashes[won], entry[won]
            lost = np.ones(len(hashes), dtype=bool)
            lost[won] = False
            hashes, entry, slot = hashes[lost], entry[lost], (slot[lost] + np.uint64(1)) & self._mask


class PieceValues:
    """Arrays of numbers remembered for pieces."""

    def __init__(self, compute: Callable[[list[str]], list[list[int]]], special: list[str], limit: int = REMEMBERED, kind: type = np.uint32, known: dict[str, list[int]] | None = None):
        self._compute, self._kind, self._special = compute, kind, [s.encode() for s in special]
        self._known = Remembered(limit)
        self._first = known or {}
        self._reset()

    def _reset(self) -> None:
        self._known.clear()
        self._at = np.zeros(1, np.int64)
        self._values = np.zeros(0, self._kind)
        self._n = 0
        if self._first:  # what is known beforehand is never forgotten
            pieces = [x.encode() for x in self._first]
            ends = np.cumsum([len(x) for x in pieces])
            hashes = hash_words(np.frombuffer(b"".join(pieces), np.uint8), ends - [len(x) for x in pieces], ends, fold=False)
            self._append(list(self._first.values()))
            self._known.add(hashes)

    def _append(self, lists: list[list[int]]) -> None:
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.array([x for v in lists for x in v], self._kind)
        if self._n + len(flat) > len(self._values):
            self._values = np.concatenate([self._values[: self._n], np.zeros(max(len(flat), self._n // 2), self._kind)])
        self._values[self._n : self._n + len(flat)] = flat
        known = self._known.count
        if known + len(lists) + 1 > len(self._at):
            self._at = np.concatenate([self._at[: known + 1], np.zeros(max(len(lists), known // 2), np.int64)])
        self._at[known + 1 : known + 1 + len(lists)] = self._n + np.cumsum(sizes)
        self._n += len(flat)

    def look_up(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values of all pieces in order, number of values of each row)."""
        if self._known.count > self._known.limit:
            self._reset()
        starts = piece_starts(buf, offs, self._special)
        ends = np.append(starts[1:], len(buf))
        hashes = hash_words(buf, starts, ends, fold=False)
        entry = self._known.find(hashes)
        new = np.flatnonzero(entry < 0)
        if len(new):
            keys, first = np.unique(hashes[new], return_index=True)
            raw, at = buf.tobytes(), new[first]
            self._append(self._compute([raw[a:b].decode("utf-8") for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]))
            self._known.add(keys)
            entry[new] = self._known.find(hashes[new])
        begin = self._at[entry]
        sizes = self._at[entry + 1] - begin
        done = np.zeros(len(sizes) + 1, np.int64)
        np.cumsum(sizes, out=done[1:])
        values = self._values[np.repeat(begin - done[:-1], sizes) + np.arange(done[-1])]
        return values, np.diff(done[np.searchsorted(starts, offs)])


class Encoder:
    """Ids, or counts of ids, of whole texts.

    ``whole``: vocabulary strings proven to encode alone as one token; they are
    proven here if not given.
    """

    def __init__(self, spec_json: str, whole: frozenset[str] | None = None):
        from tokenizers import Tokenizer

        spec = json.loads(spec_json)
        self.tokenizer = Tokenizer.from_str(spec_json)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.cut = cuts_safely(spec)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self._whole = whole
        self._ids = PieceValues(self._encode, self.special, kind=np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32)
        self._counts: PieceValues | None = None

    def _encode(self, texts: Sequence[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(list(texts), add_special_tokens=False)]

    def ids(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(all ids in order, number of ids of each row)."""
        if self.cut:
            ids, sizes = self._ids.look_up(buf, offs)
            return ids.astype(np.uint32), sizes
        found = self._encode(_texts(buf, offs))
        return np.array([x for ids in found for x in ids], np.uint32), np.array([len(ids) for ids in found], np.int64)

    def counts(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Number of ids of each row."""
        if not self.cut:
            return np.array([len(ids) for ids in self._encode(_texts(buf, offs))], np.int64)
        if self._counts is None:
            self._counts = PieceValues(lambda pieces: [[n] for n in self.count_pieces(pieces)], self.special, known=dict.fromkeys(sorted(self.whole), [1]))
        values, sizes = self._counts.look_up(buf, offs)
        done = np.zeros(len(values) + 1, np.int64)
        np.cumsum(values, out=done[1:])
        at = np.concatenate([[0], np.cumsum(sizes)])
        return np.diff(done[at])

    @property
    def whole(self) -> frozenset[str]:
        """Vocabulary strings proven to encode alone as one token.

        A string qualifies if the pre-tokenizer leaves it in one piece and the
        library encodes it as exactly the token it came from.
        """
        if self._whole is None:
            chars = _byte_chars()
            found: list[tuple[str, int]] = []
            for token, number in self.tokenizer.get_vocab(with_added_tokens=False).items():
                try:
                    found.append((bytes(chars[c] for c in token).decode("utf-8"), number))
                except (KeyError, UnicodeDecodeError):
                    continue
            pre = self.tokenizer.pre_tokenizer
            self._whole = frozenset(
                s for (s, number), ids in zip(found, self._encode([s for s, _ in found]), strict=True) if ids == [number] and len(pre.pre_tokenize_str(s)) == 1
            )
        return self._whole

    def count_pieces(self, pieces: list[str]) -> list[int]:
        """Tokens of each piece: 1 per proven pre-token, merges only for the rest."""
        whole, pre = self.whole, self.tokenizer.pre_tokenizer
        out, rest, wanted = [], [], set()
        for k in pieces:
            if k in whole:
                out.append(1)
                rest.append(None)
            elif any(s in k for s in self.special):
                out.append(0)
                rest.append([k])
                wanted.add(k)
            else:
                spans = [k[a:b] for _, (a, b) in pre.pre_tokenize_str(k)]
                left = [s for s in spans if s not in whole]
                out.append(len(spans) - len(left))
                rest.append(left)
                wanted.update(left)
        asked = list(wanted)
        merged = dict(zip(asked, map(len, self._encode(asked)), strict=True))
        return [n + sum(map(merged.__getitem__, r)) if r else n for n, r in zip(out, rest, strict=True)]


def _texts(buf: np.ndarray, offs: np.ndarray) -> list[str]:
    raw = buf.tobytes()
    return [raw[a:b].decode("utf-8") for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]


def _byte_chars() -> dict[str, int]:
    """Printable stand-ins of the byte-level alphabet, back to bytes.

    Printable Latin-1 bytes stand for themselves; the others take the code
    points from 256 on, in ascending order.
    """
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(other)}


def encoder(spec_json: str, whole: frozenset[str] | None = None) -> Encoder:
    """One encoder per process and tokenizer."""
    own = kept.setdefault("tokens", {})
    key = hashlib.sha256(spec_json.encode()).hexdigest()
    if key not in own:
        own.clear()
        own[key] = Encoder(spec_json, whole)
    return own[key]
