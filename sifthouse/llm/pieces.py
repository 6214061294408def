"""Cutting texts into pieces that a tokenizer treats alone, and remembering the ids of pieces.

A pre-tokenizer cuts at white space, so the ids of a text are the ids of its pieces in order.
Two rules are used: ``words`` drops the blanks (for vocabularies that drop white space), and
``leads`` keeps a blank at the head of the piece that follows it (for byte-level vocabularies).
A text with white space beyond blank, tab and line ends goes to the tokenizer whole, so the
result is the tokenizer's own for every text.

Most pieces are Latin letters with some marks behind them, which are parted. Letters are merged here,
many words at once in numpy, by the vocabulary's own merge ranks; any other piece goes to the
tokenizer.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

from .shared import SALTS, span_hashes

#: White space of any kind but blank, tab and line ends, and format characters: such texts are not cut.
_RARE = [*range(0x0B, 0x0D), *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x2010), *range(0x2028, 0x2030), *range(0x205F, 0x2065), 0x3000, 0xFEFF]
_RARE_SPACE = re.compile("[" + "".join(map(chr, _RARE)) + "]")
_LONE_BLANKS = re.compile("[ \n\t\r][ \n\t\r]|[\t\r\x01]")
_LEADS = re.compile("[ \n\t\r]*[^ \n\t\r]+|[ \n\t\r]+")
#: Letters of ASCII and Latin-1, perhaps after a blank, and a run of punctuation.
_PLAIN = re.compile("( ?[A-Za-zÀ-ÖØ-öø-ÿ]{1,40})([!#$%&()*+,./:;=?@^_~-]*)")
_NONE = np.int32(2**31 - 1)


def words(text: str) -> list[str] | None:
    """The runs between blanks, or None where the text must stay whole."""
    return None if _RARE_SPACE.search(text) else text.split()


def leads(text: str) -> list[str] | None:
    """Runs with the blanks before them, or None where the text must stay whole.

    Between two runs parted by one blank or one line end the cut is found by replacing; longer
    gaps are cut by a pattern.
    """
    if _RARE_SPACE.search(text):
        return None
    if _LONE_BLANKS.search(text):
        return _LEADS.findall(text)
    return text.replace(" ", "\x01 ").replace("\n", "\x01\n\x01").split("\x01")


def vocabulary_path(name: str) -> str:
    """A path as it is, or the place of an installed public vocabulary of that name."""
    if os.path.exists(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def open_tokenizer(name: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary_path(name))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def byte_symbols() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself if printable, else one from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Merger:
    """Byte-pair merges of many words together: each round every word merges its best-ranked pair, the leftmost first."""

    def __init__(self, path: str):
        with open(path, encoding="utf8") as f:
            model = json.load(f)["model"]
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.int64)
        self.final = np.array([vocab[s + suffix] for s in symbols], np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b if not suffix else a + b] for a, b in pairs], np.int64)
        self.bits = max(int(len(keys) * 8).bit_length(), 4)
        self.keys = np.full((1 << self.bits) + 64, -1, np.int64)
        self.ranks = np.full(len(self.keys), _NONE, np.int32)
        self.made = np.zeros(len(self.keys), np.int64)
        slots = self._slot(keys)
        for rank, (key, slot, token) in enumerate(zip(keys.tolist(), slots.tolist(), made.tolist(), strict=True)):
            while self.keys[slot] not in (-1, key):
                slot += 1
            if self.keys[slot] == -1:
                self.keys[slot], self.ranks[slot], self.made[slot] = key, rank, token

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, or -1."""
        slot = self._slot(keys)
        there = self.keys[slot]
        out = np.where(there == keys, slot, -1)
        open_ = np.flatnonzero((there != keys) & (there != -1))
        while len(open_):
            slot[open_] += 1
            there = self.keys[slot[open_]]
            hit = there == keys[open_]
            out[open_[hit]] = slot[open_[hit]]
            open_ = open_[~hit & (there != -1)]
        return out

    def __call__(self, raw: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, whose bytes stand in ``raw`` one after another, and how many each has."""
        if not size.sum():
            return np.zeros(0, np.int32), np.zeros(len(size), np.int64)
        last = np.cumsum(size) - 1
        token = self.inner[raw]
        token[last[size > 0]] = self.final[raw[last[size > 0]]]
        word = np.repeat(np.arange(len(size)), size)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(token):
            head = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            slot = np.full(len(token), -1, np.int64)
            slot[:-1] = self._find(token[:-1] << 20 | token[1:])
            slot[np.r_[head[1:] - 1, len(token) - 1]] = -1
            rank = np.where(slot >= 0, self.ranks[slot], _NONE)
            best = np.repeat(np.minimum.reduceat(rank, head), np.diff(np.r_[head, len(token)]))
            open_ = best < _NONE
            if not open_.all():
                done.append((word[~open_], token[~open_]))
            at = np.flatnonzero(open_ & (rank == best))
            at = at[np.r_[True, word[at[1:]] != word[at[:-1]]]] if len(at) else at
            token[at] = self.made[slot[at]]
            stay = open_
            stay[at + 1] = False
            token, word = token[stay], word[stay]
        word = np.concatenate([w for w, _ in done])
        order = np.argsort(word, kind="stable")
        return np.concatenate([t for _, t in done])[order].astype(np.int32), np.bincount(word, minlength=len(size))

    def words(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece, as little-endian 32-bit numbers."""
        flat, counts = self(np.frombuffer(b"".join(pieces), np.uint8), np.array([len(p) for p in pieces], np.int64))
        ends = np.cumsum(counts) * 4
        data = flat.astype("<i4").tobytes()
        return [data[x:y] for x, y in zip([0, *ends[:-1].tolist()], ends.tolist())]


class PieceEncoder:
    """Ids of texts as little-endian 32-bit numbers, with a bounded memory of pieces that lasts as long as the Python worker.

    ``lookup`` may answer plain words from a lexicon (None for unknown words) before they are merged.
    """

    def __init__(self, name: str, cut, lower: bool = False, lookup=None, keep: int = 500_000):
        path = vocabulary_path(name)
        self.tokenizer, self.merge = open_tokenizer(path), Merger(path)
        self.cut, self.lower, self.lookup, self.keep = cut, lower, lookup, keep
        self.known: dict[str, bytes] = {"": b""}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<i4").tobytes()

    def _plain(self, stems: list[str]) -> None:
        if self.lookup is not None:
            found = self.lookup(stems)
            self.known.update((s, f) for s, f in zip(stems, found, strict=True) if f is not None)
            stems = [s for s, f in zip(stems, found, strict=True) if f is None]
        self.known.update(zip(stems, self.merge.words([s.encode() for s in stems]), strict=True))

    def learn(self, new: list[str]) -> None:
        if len(self.known) + len(new) > self.keep:
            self.known = {"": b""}
        known, plain, odd = self.known, [], []
        for piece in new:
            match = _PLAIN.fullmatch(piece)
            if match is None:
                odd.append(piece)
            else:
                stem, tail = match.groups()
                plain.append((piece, stem.lower() if self.lower else stem, tail))
        self._plain(list({s for _, s, _ in plain if s not in known}))
        odd += list({t for _, _, t in plain if t not in known})
        for at in range(0, len(odd), 1024):
            part = odd[at : at + 1024]
            encoded = self.tokenizer.encode_batch_fast(part, add_special_tokens=False)
            known.update((p, np.array(e.ids, "<i4").tobytes()) for p, e in zip(part, encoded, strict=True))
        for piece, stem, tail in plain:
            known[piece] = known[stem] + known[tail]

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for at in range(0, len(pieces), self.keep // 2):
            part = pieces[at : at + self.keep // 2]
            self.learn([p for p in part if p not in self.known])
            if any(p not in self.known for p in part):  # the memory was begun anew
                self.learn([p for p in part if p not in self.known])
            out.extend(map(self.known.__getitem__, part))
        return out

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; the pieces that are new to all of them are learnt together."""
        out: list[bytes] = []
        at, stop, size = 0, 0, 0
        while at < len(texts):  # a few MB of text at once
            while stop < len(texts) and (stop == at or size + len(texts[stop]) < 4_000_000):
                size += len(texts[stop])
                stop += 1
            cuts = [self.cut(t) for t in texts[at:stop]]
            new: set[str] = set()
            for parts in cuts:
                new.update(parts or ())
            new.difference_update(self.known)
            if new:
                fresh = list(new)
                self.learn(fresh)
            get = self.known.__getitem__
            for text, parts in zip(texts[at:stop], cuts, strict=True):
                if parts is None:
                    out.append(self.whole(text))
                    continue
                try:
                    out.append(b"".join(map(get, parts)))
                except KeyError:  # the memory was begun anew
                    self.learn(list({p for p in parts if p not in self.known}))
                    get = self.known.__getitem__
                    out.append(b"".join(get(p) if p in self.known else self.whole(p) for p in parts))
            at, size = stop, 0
        return out


class PieceTable:
    """Numbers distinct pieces by two hashes of their bytes, in numpy; begun anew beyond ``keep`` pieces."""

    def __init__(self, keep: int = 600_000):
        self.keep = keep
        self.clear()

    def clear(self) -> None:
        self.size, self.bits = 0, 18
        self._room()

    def _room(self) -> None:
        self.key = np.zeros((1 << self.bits) + 256, np.uint64)
        self.check = np.zeros(len(self.key), np.uint64)
        self.number = np.full(len(self.key), -1, np.int32)

    def find(self, key: np.ndarray, check: np.ndarray) -> np.ndarray:
        """The number of each piece, or -1."""
        slot = (key >> np.uint64(64 - self.bits)).astype(np.int64)
        number = self.number[slot]
        same = (self.key[slot] == key) & (self.check[slot] == check)
        out = np.where(same & (number >= 0), number, -1)
        open_ = np.flatnonzero(~same & (number >= 0))
        while len(open_):
            slot[open_] += 1
            at = slot[open_]
            number = self.number[at]
            same = (self.key[at] == key[open_]) & (self.check[at] == check[open_]) & (number >= 0)
            out[open_[same]] = number[same]
            open_ = open_[~same & (number >= 0)]
        return out

    def add(self, key: np.ndarray, check: np.ndarray) -> np.ndarray:
        """Numbers for distinct pieces that ``find`` doesn't know."""
        while (self.size + len(key)) * 2 > 1 << self.bits:
            old = self.number >= 0
            keys, checks, numbers = self.key[old], self.check[old], self.number[old]
            self.bits += 1
            self._room()
            self._put(keys, checks, numbers)
        numbers = np.arange(self.size, self.size + len(key), dtype=np.int32)
        self._put(key, check, numbers)
        self.size += len(key)
        return numbers

    def _put(self, key: np.ndarray, check: np.ndarray, number: np.ndarray) -> None:
        slot = (key >> np.uint64(64 - self.bits)).astype(np.int64)
        todo = np.arange(len(key))
        while len(todo):
            free = todo[self.number[slot[todo]] < 0]
            _, winner = np.unique(slot[free], return_index=True)
            won = free[winner]
            self.key[slot[won]], self.check[slot[won]], self.number[slot[won]] = key[won], check[won], number[won]
            lost = np.ones(len(key), bool)
            lost[won] = False
            todo = todo[lost[todo]]
            slot[todo] += 1


def gather(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices of the ranges ``start`` to ``start + size``, one range after another."""
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


_LETTER = np.array([c < 128 and chr(c).isalpha() for c in range(256)])
_MARK = np.isin(np.arange(256), list(b"!#$%&()*+,./:;=?@^_~-"))


def lowered(raw: np.ndarray) -> np.ndarray:
    """Bytes of ASCII and Latin-1 letters in lower case."""
    out = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)
    out[1:] += ((raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)).astype(np.uint8) * 32
    return out


class Pieces:
    """Spans and hashes of the pieces of a few texts.

    ``plain`` marks pieces of ASCII and Latin-1 letters, perhaps after a blank, of which the
    marks behind them are parted; ``odd`` marks the texts that must be cut by the slower rules.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, keep_blanks: bool):
        base = int(offsets[0])
        b = data[base : int(offsets[-1])]
        edges = offsets - base
        after = np.append(b[1:], 0)
        third = np.append(b[2:], [0, 0])[: len(b)]
        bad = ((b < 0x20) & (b != 10)) | ((b == 0xC2) & ((after == 0x85) | (after == 0xA0))) | (b == 0xE1) & (after < 0xA1) | (b == 0xEF) & (after == 0xBB)
        bad |= (b == 0xE2) & (((after == 0x80) & ((third < 0x90) | (third > 0xA7))) | (after == 0x81)) | (b == 0xE3) & (after == 0x80) & (third == 0x80)
        space = (b == 32) | (b == 10)
        if keep_blanks:
            starts = space.copy()
            starts[1:] |= b[:-1] == 10
            bad[1:] |= space[1:] & space[:-1]
            inside = np.ones(len(b), bool)
        else:
            inside = ~space
            starts = inside.copy()
            starts[1:] &= space[:-1]
        heads = edges[:-1][edges[:-1] < len(b)]
        starts[heads] = inside[heads]
        tally = np.concatenate([[0], np.cumsum(bad)])
        self.odd = tally[edges[1:]] > tally[edges[:-1]]
        if self.odd.any():
            drop = np.repeat(self.odd, np.diff(edges))
            inside, starts = inside & ~drop, starts & ~drop
        self.start = np.flatnonzero(starts)
        self.first = np.searchsorted(self.start, edges)
        count = np.concatenate([[0], np.cumsum(inside)])
        packed_first = count[self.start]
        self.size = np.diff(np.append(packed_first, count[-1]))
        self.bytes = b
        self._part_marks(edges)
        self.key, self.check = span_hashes(b, self.start, self.size, SALTS)

    def _part_marks(self, edges: np.ndarray) -> None:
        b = self.bytes
        letter = _LETTER[b]
        two = (b[:-1] == 0xC3) & (b[1:] >= 0x80) & (b[1:] <= 0xBF) & (b[1:] != 0x97) & (b[1:] != 0xB7)
        letter[:-1] |= two
        letter[1:] |= two
        letters, marks = (np.concatenate([[0], np.cumsum(x, dtype=np.int32)]) for x in (letter, _MARK[b]))
        begin, end = self.start, self.start + self.size
        first = begin + (b[begin] == 32) if len(begin) else begin
        stem = first + letters[end] - letters[first]  # where the letters end if they all come first
        self.plain = (stem > first) & (letters[stem] - letters[first] == stem - first) & (marks[end] - marks[stem] == end - stem) & (stem - begin <= 41)
        cut = np.flatnonzero(self.plain & (stem < end))
        if len(cut):
            tail, rest = stem[cut], (end - stem)[cut]
            self.size[cut] -= rest
            self.start = np.insert(self.start, cut + 1, tail)
            self.size = np.insert(self.size, cut + 1, rest)
            self.plain = np.insert(self.plain, cut + 1, False)
            self.first = np.searchsorted(self.start, edges)

    def raw(self, at: np.ndarray) -> np.ndarray:
        """The bytes of the pieces at ``at``, one after another."""
        return self.bytes[gather(self.start[at], self.size[at])]

    def text(self, i: int) -> str:
        return self.bytes[self.start[i] : self.start[i] + self.size[i]].tobytes().decode()

    def distinct(self, among: np.ndarray) -> np.ndarray:
        """One position for each distinct piece at the positions ``among``."""
        order = among[np.lexsort((self.check[among], self.key[among]))]
        if not len(order):
            return order
        new = (self.key[order[1:]] != self.key[order[:-1]]) | (self.check[order[1:]] != self.check[order[:-1]])
        return order[np.r_[True, new]]


class BatchEncoder:
    """Ids of whole Arrow columns: pieces are numbered by hash, and each distinct piece is encoded once per worker."""

    def __init__(self, name: str, keep_blanks: bool, lower: bool, lookup=None):
        self.keep_blanks, self.lower, self.lookup = keep_blanks, lower, lookup
        self.plain = PieceEncoder(name, leads if keep_blanks else words, lower, lookup, keep=50_000)
        self.table = PieceTable()
        self._reset()

    def _reset(self) -> None:
        self.table.clear()
        self.ids, self.used = np.zeros(1 << 18, np.int32), 0
        self.begin, self.size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)

    def _learn(self, pieces: Pieces, at: np.ndarray) -> None:
        if self.table.size + len(at) > self.table.keep:
            self._reset()
        plain, odd = at[pieces.plain[at]], at[~pieces.plain[at]]
        self._put(pieces, plain, *self._plain_ids(pieces.raw(plain), pieces.size[plain]))
        got = self.plain.encode_pieces([pieces.text(i) for i in odd.tolist()])
        self._put(pieces, odd, np.frombuffer(b"".join(got), "<i4"), np.array([len(g) // 4 for g in got], np.int64))

    def _plain_ids(self, raw: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain pieces: those of the lexicon's words, and merged ones of all others."""
        raw = lowered(raw) if self.lower else raw
        if self.lookup is None or not len(size):
            return self.plain.merge(raw, size)
        found = self.lookup.numbers(raw, size)
        known = found >= 0
        new, counts = self.plain.merge(raw[~np.repeat(known, size)], size[~known])
        begin = self.lookup.begin.astype(np.int64)
        counted = np.zeros(len(size), np.int64)
        counted[known], counted[~known] = (begin[1:] - begin[:-1])[found[known]], counts
        out = np.zeros(int(counted.sum()), np.int32)
        mine = np.repeat(known, counted)
        out[mine], out[~mine] = self.lookup.ids[gather(begin[found[known]], counted[known])], new
        return out, counted

    def _put(self, pieces: Pieces, at: np.ndarray, flat: np.ndarray, size: np.ndarray) -> None:
        if not len(at):
            return
        number = self.table.add(pieces.key[at], pieces.check[at])
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), np.int32)])
        while self.table.size > len(self.begin):
            self.begin = np.concatenate([self.begin, np.zeros(len(self.begin), np.int64)])
            self.size = np.concatenate([self.size, np.zeros(len(self.size), np.int32)])
        self.ids[self.used : self.used + len(flat)] = flat
        self.begin[number] = self.used + np.cumsum(size) - size
        self.size[number] = size
        self.used += len(flat)

    def _chunk(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pieces = Pieces(data, offsets, self.keep_blanks)
        number = self.table.find(pieces.key, pieces.check)
        missing = np.flatnonzero(number < 0)
        if len(missing):
            before = self.table.size
            self._learn(pieces, pieces.distinct(missing))
            again = missing if self.table.size > before else np.arange(len(number))
            number[again] = self.table.find(pieces.key[again], pieces.check[again])
            if (number < 0).any():  # the table was begun anew
                at = np.flatnonzero(number < 0)
                self._learn(pieces, pieces.distinct(at))
                number = self.table.find(pieces.key, pieces.check)
        size = self.size[number].astype(np.int64)
        ids = self.ids[gather(self.begin[number], size)]
        ends = np.concatenate([[0], np.cumsum(size)])[pieces.first]
        counts = np.diff(ends)
        if not pieces.odd.any():
            return ids, counts
        texts = [data[offsets[i] : offsets[i + 1]].tobytes().decode() for i in np.flatnonzero(pieces.odd)]
        own = dict(zip(np.flatnonzero(pieces.odd).tolist(), (np.frombuffer(x, "<i4") for x in self.plain(texts)), strict=True))
        parts = [own[i] if i in own else ids[ends[i] : ends[i + 1]] for i in range(len(counts))]
        return np.concatenate(parts), np.array([len(x) for x in parts], np.int64)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a few texts, and where each text's ids begin (with their total at the end)."""
        ids, counts = self._chunk(data, offsets)
        return ids, np.concatenate([[0], np.cumsum(counts)])


_ENCODERS: dict[tuple, BatchEncoder] = {}


def encoder(key: tuple, make) -> BatchEncoder:
    """The worker's encoder for ``key``; another key replaces it, so a worker holds one."""
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = make()
    return _ENCODERS[key]
