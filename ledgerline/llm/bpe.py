"""Byte-pair encoding of whole batches: each distinct pre-token is encoded once.

A batch's bytes are split into pre-tokens with numpy; only pre-tokens that were
not met before go to the tokenizers library, and a batch's ids are gathered from
those results. Of a row with characters outside ``PLAIN``, or with a marker that could
be a special token, only the stretches between white space that hold them go to the
library as they are; so the ids are the library's own for every text.
"""

from __future__ import annotations

import os
from collections.abc import Callable

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
os.environ.setdefault("RAYON_NUM_THREADS", "1")

import numpy as np
import regex
from tokenizers import Tokenizer

from .ragged import blocks, gather, prefix_hash, span_hash

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 4
#: Code points that are split here: all Unicode versions agree on their classes and case.
PLAIN = [
    (0x09, 0x0D), (0x20, 0x7E), (0xA0, 0x12F), (0x131, 0x239), (0x23B, 0x23D), (0x23F, 0x24F),
    (0x388, 0x38A), (0x38C, 0x38C), (0x38E, 0x3A1), (0x3A3, 0x3CE), (0x400, 0x45F), (0x490, 0x4BF), (0x5D0, 0x5EA), (0x621, 0x63A), (0x641, 0x64A), (0x660, 0x669),
    (0x2010, 0x2027), (0x202F, 0x205E), (0x20A0, 0x20BF), (0x2122, 0x2122), (0x2190, 0x2328), (0x2500, 0x27BF),
    (0x3000, 0x3003), (0x3008, 0x3011), (0x3041, 0x3094), (0x30A1, 0x30FA), (0x30FC, 0x30FE), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3),
    (0xFE0F, 0xFE0F), (0x1F300, 0x1FAFF),
]
#: Pre-tokens that a worker remembers before it starts afresh.
REMEMBERED = 1_000_000
#: Pre-tokens that the library gets as one text where nothing can join them.
JOINED = 50
BLOCK_BYTES = 2_000_000


def _tables() -> tuple[np.ndarray, np.ndarray]:
    kind, lower = np.zeros(0x20000, np.uint8), np.arange(0x800, dtype=np.uint16)
    for first, last in PLAIN:
        for cp in range(first, last + 1):
            c = chr(cp)
            kind[cp] = SPACE if c.isspace() else LETTER if regex.match(r"\p{L}", c) else NUMBER if regex.match(r"\p{N}", c) else OTHER
            if cp < 0x800:
                lower[cp] = ord(c.lower())
    return kind, lower


_KIND, _LOWER = _tables()
_SHORT = {ord(c): 1 for c in "stmd"}
_PAIRS = {(ord(a), ord(b)) for a, b in ("re", "ve", "ll")}


def classes(data: np.ndarray) -> np.ndarray:
    """The class of the character that each byte belongs to; 0 where it is not in ``PLAIN``."""
    kind = np.where(data < 0x80, _KIND[data], 0).astype(np.uint8)
    n = len(data)
    if (high := np.flatnonzero(data >= 0xC0)).size:
        wide = data.astype(np.uint32) & 0x3F
        two = high[(data[high] < 0xE0) & (high + 1 < n)]
        cp = ((data[two] & 0x1F).astype(np.uint32) << 6) | wide[two + 1]
        kind[two] = kind[two + 1] = _KIND[cp]
        three = high[(data[high] >= 0xE0) & (data[high] < 0xF0) & (high + 2 < n)]
        cp = ((data[three] & 0x0F).astype(np.uint32) << 12) | (wide[three + 1] << 6) | wide[three + 2]
        kind[three] = kind[three + 1] = kind[three + 2] = _KIND[cp]
        four = high[(data[high] >= 0xF0) & (high + 3 < n)]
        cp = ((data[four] & 0x07).astype(np.uint32) << 18) | (wide[four + 1] << 12) | (wide[four + 2] << 6) | wide[four + 3]
        kind[four] = kind[four + 1] = kind[four + 2] = kind[four + 3] = np.where(cp < len(_KIND), _KIND[np.minimum(cp, len(_KIND) - 1)], 0)
    return kind


def lowered(data: np.ndarray) -> np.ndarray:
    """Lower case of bytes whose characters are all in ``PLAIN``; lengths don't change."""
    out = data.copy()
    upper = (data >= 65) & (data <= 90)
    out[upper] += 32
    two = np.flatnonzero((data >= 0xC2) & (data < 0xE0))
    if two.size:
        cp = _LOWER[((data[two] & 0x1F).astype(np.uint32) << 6) | (data[two + 1] & 0x3F)]
        out[two] = 0xC0 | (cp >> 6)
        out[two + 1] = 0x80 | (cp & 0x3F)
    return out


def pretokens(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray, style: str) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pre-tokens of rows that are all plain.

    ``byte``: a space joins what follows it, other white space stands alone.
    ``word``: white space is dropped and numbers are split into digits. In both,
    an apostrophe that opens a run takes one of the seven English endings along.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    row_start = first[:n].copy()
    start = row_start.copy()
    start[1:] |= kind[1:] != kind[:-1]
    space = kind == SPACE
    lead = (data & 0xC0) != 0x80
    if style == "word":
        start |= (kind == NUMBER) & lead
    quote = np.flatnonzero((data == 39) & start)
    quote = quote[(quote + 1 < n)]
    quote = quote[(kind[quote + 1] == LETTER) & ~row_start[quote + 1]]
    if style == "byte":
        quote = quote[row_start[quote] | (data[quote - 1] != 32)]
        last = np.flatnonzero(space[:-1] & ~space[1:] & ~first[1:n])  # last white space before something else
        start[np.maximum.accumulate(np.where(lead, np.arange(n), 0))[last]] = True
        start[last[data[last] == 32] + 1] = False
    if quote.size:
        one, two = data[quote + 1], np.minimum(quote + 2, n - 1)
        single = np.isin(one, list(_SHORT))
        inside = (quote + 2 < n) & ~first[np.minimum(quote + 2, n)]
        double = np.zeros(len(quote), bool)
        for a, b in _PAIRS:
            double |= (one == a) & (data[two] == b) & inside
        taken = single | double
        start[quote[taken] + 1] = False
        after = (quote + np.where(single, 2, 3))[taken]
        after = after[after < n]
        start[after] = True
    begin = np.flatnonzero(start)
    end = np.append(begin[1:], n)
    if style == "word":
        keep = ~space[begin]
        begin, end = begin[keep], end[keep]
    return begin, end


class Encoder:
    """Ids of a tokenizers file for batches of texts, without added special tokens."""

    def __init__(self, path: str, style: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        special = self.tokenizer.get_added_tokens_decoder().values()
        if any(not t.content.startswith("<|") or t.content.split() != [t.content] or t.lstrip or t.rstrip or t.single_word for t in special):
            raise ValueError(f"{path}: special tokens other than <|word|>")
        self.style = style
        self.forget()

    def forget(self) -> None:
        # in order of the hashes; a dict takes about 100 bytes more for each
        self.known, self.row = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.ids = np.zeros(1 << 16, np.uint32)
        self.used = 0
        self.start = np.zeros(1 << 14, np.int64)
        self.count = np.zeros(1 << 14, np.int32)

    def _alone(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts one after the other, and how many each has."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter((i for x in found for i in x), np.uint32), np.fromiter(map(len, found), np.int64, len(found))

    def _joined(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for pre-tokens that stay apart when they follow each other; many in one text cost the library less."""
        glue = "" if self.style == "byte" else " "
        parts = [texts[k : k + JOINED] for k in range(0, len(texts), JOINED)]
        ids, counts = [], []
        for part, e in zip(parts, self.tokenizer.encode_batch([glue.join(p) for p in parts], add_special_tokens=False), strict=True):
            word = np.array(e.word_ids, np.int64)
            if len(word) and word[-1] == len(part) - 1:
                ids.append(np.array(e.ids, np.uint32))
                counts.append(np.bincount(word, minlength=len(part)))
            else:
                for found, into in zip(self._alone(part), (ids, counts), strict=True):
                    into.append(found)
        return np.concatenate(ids), np.concatenate(counts)

    def _learn(self, hashes: np.ndarray, texts: list[bytes]) -> None:
        """Take over the ids of new pre-tokens, whose hashes ascend."""
        shown = [t.decode() for t in texts]
        # a change to white space ends every pre-token (see chunked_bpe), so those that begin with a space stay apart
        apart = [self.style == "word" or (len(t) > 1 and t[0] == " " and not t[1].isspace()) for t in shown]
        order = [k for k, x in enumerate(apart) if x] + [k for k, x in enumerate(apart) if not x]
        n = sum(apart)
        parts = [f([shown[k] for k in o]) for f, o in ((self._joined, order[:n]), (self._alone, order[n:])) if o]
        flat, counts = (np.concatenate([p[c] for p in parts]) for c in (0, 1))
        rows = len(self.known)
        while len(self.start) < rows + len(texts):
            self.start, self.count = np.concatenate([self.start, np.zeros_like(self.start)]), np.concatenate([self.count, np.zeros_like(self.count)])
        while len(self.ids) < self.used + len(flat):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(flat)] = flat
        self.count[rows : rows + len(texts)] = counts
        self.start[rows : rows + len(texts)] = self.used + np.cumsum(counts) - counts
        self.used += len(flat)
        row = np.empty(len(texts), np.int32)
        row[order] = np.arange(rows, rows + len(texts))
        at = np.searchsorted(self.known, hashes)
        self.known, self.row = np.insert(self.known, at, hashes), np.insert(self.row, at, row)

    def _plain(self, data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.style == "word":
            data = lowered(data)
        begin, end = pretokens(data, offsets, kind, self.style)
        if not len(begin):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        distinct, where, inverse = np.unique(span_hash(prefix_hash(data), begin, end), return_index=True, return_inverse=True)
        if len(self.known) + len(distinct) > REMEMBERED:
            self.forget()
        at = np.searchsorted(self.known, distinct)
        new = np.flatnonzero(self.known[np.minimum(at, len(self.known) - 1)] != distinct) if len(self.known) else np.arange(len(distinct))
        if len(new):
            raw = data.tobytes()
            first = where[new]
            self._learn(distinct[new], [raw[a:b] for a, b in zip(begin[first].tolist(), end[first].tolist(), strict=True)])
            at = np.searchsorted(self.known, distinct)
        rows = self.row[at][inverse]
        ids, at = gather(self.ids, self.start[rows], self.count[rows])
        return ids, at[np.searchsorted(begin, offsets)]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the offsets of each row's ids."""
        out, sizes = [], []
        for i, j in blocks(offsets, BLOCK_BYTES):
            a, b = offsets[i], offsets[j]
            ids, at = self._block(data[a:b], offsets[i : j + 1] - a)
            out.append(ids)
            sizes.append(np.diff(at))
        total = np.zeros(len(offsets), np.int64)
        if out:
            np.cumsum(np.concatenate(sizes), out=total[1:])
        return (np.concatenate(out) if out else np.zeros(0, np.uint32)), total

    def whole(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The library's ids of texts one after the other, and how many each has."""
        return self._alone([t.decode() for t in texts])

    def _block(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return in_parts(data, offsets, self._plain, self.whole)


def in_parts(data: np.ndarray, offsets: np.ndarray, plain: Callable, other: Callable) -> tuple[np.ndarray, np.ndarray]:
    """What ``plain(data, offsets, kind)`` gives for rows, as values and offsets; for stretches that are not plain, what ``other(texts)`` gives.

    Stretches end where a space follows a plain character that is none: every
    splitter here cuts there, no normaliser joins over it, no special token spans it.
    """
    kind = classes(data)
    bad = kind == 0
    if len(data) > 1:
        bad[:-1] |= (data[:-1] == 60) & (data[1:] == 124)
    at = np.flatnonzero(bad)
    if not len(at):
        return plain(data, offsets, kind)
    places = np.union1d(offsets, np.flatnonzero((data[1:] == 32) & (kind[:-1] != SPACE) & (kind[:-1] != 0)) + 1)
    after = np.searchsorted(places, at, "right")
    cuts = np.unique(np.concatenate([offsets, places[after - 1], places[after]]))
    easy = np.ones(len(cuts) - 1, bool)
    easy[np.searchsorted(cuts, at, "right") - 1] = False
    begin, size = cuts[:-1], np.diff(cuts)
    rest, rest_at = gather(data, begin[easy], size[easy])
    values, ends = plain(rest, rest_at, gather(kind, begin[easy], size[easy])[0])
    more, many = other([data[a : a + n].tobytes() for a, n in zip(begin[~easy].tolist(), size[~easy].tolist(), strict=True)])
    start, count = np.zeros(len(easy), np.int64), np.zeros(len(easy), np.int64)
    start[easy], count[easy] = ends[:-1], np.diff(ends)
    start[~easy], count[~easy] = len(values) + np.cumsum(many) - many, many
    out, ends = gather(np.concatenate([values, more]), start, count)
    return out, ends[np.searchsorted(cuts, offsets)]


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, style: str) -> Encoder:
    """This worker's encoder of a file."""
    if (path, style) not in _encoders:
        _encoders[path, style] = Encoder(path, style)
    return _encoders[path, style]
