"""Tokenizing whole texts by their distinct pieces, cut where no token can cross.

A chunk begins where ASCII white space follows a byte that isn't white space, and where an ideograph or a kana
follows an East Asian comma or full stop. Both pre-tokenizers used here start a new pre-token there whatever
stands before, and neither NFC nor the special strings reach across. A stretch without any such place (Thai, an
endless word) is one chunk and goes through the library whole, so memory grows with the longest one.
So the tokens of a text are those of its chunks in order, and a text of any length is worked off in parts.
Chunks of plain Latin text are cut further, into their pre-tokens, in numpy; any other chunk ("hard": other
scripts, apostrophes, what may begin a special string) goes through the library whole. Each distinct piece
is encoded once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np

from logloom.llm import textbatch as tb

#: Bytes that the pieces one Python worker remembers may take, about, with their tokens; longer pieces than LONG are not remembered.
REMEMBERED, LONG = 96 << 20, 1 << 10
#: What a remembered piece takes besides its bytes and ids: the object, its place in the table, three numbers.
_EACH = 120
#: Letters that Unicode had from the start: ideographs of U+5000 to U+8FFF by their first byte, kana by their second.
_IDEOGRAPH = np.isin(np.arange(256), np.arange(0xE5, 0xE9))
#: Ideographic comma and full stop; full-width comma, exclamation and question mark.
_STOPS = ((0xE3, 0x80, (0x81, 0x82)), (0xEF, 0xBC, (0x81, 0x8C, 0x9F)))

_SPACE, _LETTER, _DIGIT, _OTHER = range(4)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[tb.SPACES] = _SPACE
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = _LETTER
_CLASS[0x30:0x3A] = _DIGIT


def chunk_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """First bytes of the chunks of all rows, in order."""
    space = tb.SPACES[data]
    first = np.zeros(len(data), bool)
    first[1:] = space[1:] & ~space[:-1]
    # What precedes may be a Unicode space (or a control that some engines count as one): no cut there.
    first[1:] &= ~((data[:-1] >= 0x1C) & (data[:-1] <= 0x1F))
    first[2:] &= ~((data[1:-1] >= 0x80) & (data[:-2] == 0xC2))
    first[3:] &= ~((data[2:-1] >= 0x80) & (data[:-3] >= 0xE1) & (data[:-3] <= 0xE3))
    first[3:] |= _after_stop(data)
    first[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    return np.flatnonzero(first)


def _after_stop(data: np.ndarray) -> np.ndarray:
    """For every byte from the fourth on, whether it begins an ideograph or a kana that follows an East Asian stop.

    No mark stands between, so NFC changes neither side's class."""
    a, b, c = data[:-3], data[1:-2], data[2:-1]
    stop = np.zeros(max(0, len(data) - 3), bool)
    for x, y, ends in _STOPS:
        stop |= (a == x) & (b == y) & np.isin(c, ends)
    padded = np.append(data, (0, 0)).astype(np.uint8)
    return stop & (_IDEOGRAPH[data[3:]] | (data[3:] == 0xE3) & (padded[4:-1] == 0x81) & (padded[5:] >= 0x81))


def _hard_bytes(data: np.ndarray) -> np.ndarray:
    """Bytes that make a chunk hard: all but ASCII and the letters of U+00C0 to U+00FF, and some of ASCII."""
    after = np.append(data[1:], 0)
    lead = (data == 0xC3) & (after >= 0x80) & (after != 0x97) & (after != 0xB7)
    hard = data >= 0x80
    hard &= ~lead
    hard[1:] &= ~lead[:-1]
    hard |= (data == 0x27) | ((data >= 0x1C) & (data <= 0x1F)) | ((data == 0x3C) & (after == 0x7C))
    return hard


def pieces(data: np.ndarray, offsets: np.ndarray, spaced: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and end of every pre-token or hard chunk, and which are hard.

    spaced: a single space belongs to what follows it, other white space gives tokens, and digits go
    together; else white space gives none, and each digit stands alone.
    """
    chunks = chunk_starts(data, offsets)
    lengths = np.diff(np.append(chunks, len(data)))
    hard_chunk = np.add.reduceat(_hard_bytes(data), chunks, dtype=np.int64) > 0
    kind = _CLASS[data]
    start = np.ones(len(data), bool)
    start[1:] = kind[1:] != kind[:-1]
    row_start = np.zeros(len(data) + 1, bool)
    row_start[offsets] = True
    if spaced:
        last = np.flatnonzero((kind[:-1] == _SPACE) & (kind[1:] != _SPACE) & ~row_start[1:-1])
        start[last] = True
        start[last[data[last] == 0x20] + 1] = False
    else:
        start |= kind == _DIGIT
    start |= row_start[:-1]
    start &= ~np.repeat(hard_chunk, lengths)
    start[chunks[hard_chunk]] = True
    at = np.flatnonzero(start)
    ends = np.append(at[1:], len(data))
    is_hard = np.zeros(len(data), bool)
    is_hard[chunks[hard_chunk]] = True
    is_hard = is_hard[at]
    if not spaced:
        keep = is_hard | (kind[at] != _SPACE)
        at, ends, is_hard = at[keep], ends[keep], is_hard[keep]
    return at, ends, is_hard


def parts(data: np.ndarray, offsets: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes, offsets and row numbers of texts: all at once, or of a long text in parts that end at chunks."""
    if len(data) <= most:
        yield data, offsets, np.arange(len(offsets) - 1)
        return
    ends = np.append(chunk_starts(data, offsets)[1:], len(data))
    at = 0
    while at < len(data):
        k = int(np.searchsorted(ends, at + most, side="right")) - 1
        to = int(ends[k]) if k >= 0 and ends[k] > at else int(ends[np.searchsorted(ends, at, side="right")])
        yield data[at:to], np.array([0, to - at]), np.zeros(1, np.int64)
        at = to


class Pieces:
    """Remembers the tokens of pieces; forgets all when they take more than REMEMBERED bytes. Those longer than
    LONG bytes have a slot until the next call only.

    encoder(pieces, hard) gives the ids of each piece, or with ids=False their number.
    """

    def __init__(self, encoder: "PlainEncoder", ids: bool = True):
        self.encoder, self.keeps_ids = encoder, ids
        self.forget()

    def forget(self) -> None:
        self.slot: dict[bytes, int] = {}
        self.ids = np.zeros(1 << 16, np.int32)
        self.start = np.zeros(1 << 12, np.int64)
        self.length = np.zeros(1 << 12, np.int64)
        self.count = self.used = self.held = 0
        self.lasting = (0, 0)

    def _add(self, keys: list[bytes], encoded: list) -> range:
        """New slots for keys, which the caller enters in the table or not."""
        lengths = np.fromiter(map(len, encoded) if self.keeps_ids else encoded, np.int64, len(encoded))
        had, self.count = self.count, self.count + len(keys)
        if self.count > len(self.start):
            grow = np.zeros(2 * self.count - had, np.int64)
            self.start, self.length = np.concatenate((self.start[:had], grow)), np.concatenate((self.length[:had], grow))
        if self.keeps_ids:
            new = self.used + int(lengths.sum())
            if new > len(self.ids):
                self.ids = np.concatenate((self.ids[: self.used], np.zeros(2 * new - self.used, np.int32)))
            self.ids[self.used : new] = np.fromiter(chain.from_iterable(encoded), np.int32, new - self.used)
            self.start[had : self.count] = self.used + np.cumsum(lengths) - lengths
            self.used = new
        self.length[had : self.count] = lengths
        return range(had, self.count)

    def slots(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The slot and first byte of each piece; its ids are self.ids[start[slot] : start[slot] + length[slot]]."""
        if len(data) == 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        starts, ends, hard = pieces(data, offsets, self.encoder.spaced)
        at, of = distinct(data, starts, ends)
        raw = data.tobytes()
        # Whether a piece is hard is told by its bytes.
        known = [raw[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
        self.count, self.used = self.lasting
        if self.held + 4 * len(self.ids) > REMEMBERED:
            self.forget()
        slots = np.fromiter(map(self.slot.get, known, repeat(-1)), np.int64, len(known))
        missing = np.flatnonzero(slots < 0)
        if len(missing):
            new = dict(zip((known[i] for i in missing.tolist()), hard[at[missing]].tolist()))
            short, long = ({k: h for k, h in new.items() if (len(k) > LONG) == x} for x in (False, True))
            self.slot.update(zip(short, self._add(list(short), self.encoder(list(short), list(short.values()), self.keeps_ids)), strict=True))
            self.held += sum(map(len, short)) + _EACH * len(short)
            self.lasting = (self.count, self.used)
            passing = dict(zip(long, self._add(list(long), self.encoder(list(long), list(long.values()), self.keeps_ids)), strict=True))
            slots[missing] = np.fromiter((self.slot[known[i]] if known[i] in self.slot else passing[known[i]] for i in missing.tolist()), np.int64, len(missing))
        return slots[of], starts


def distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place for each distinct span, and for every span which of those it equals. Spans of one hash are
    compared byte by byte; what differs from the first of its hash stands for itself."""
    _, at, of = np.unique(tb.word_hashes(data, starts, ends), return_index=True, return_inverse=True)
    length, first = ends - starts, at[of]
    same = length == length[first]
    some = np.flatnonzero(same & (first != np.arange(len(starts))) & (length > 8))  # up to 8 bytes a hash tells all
    n = length[some]
    equal = data[tb.ragged(starts[some], n)] == data[tb.ragged(starts[first[some]], n)]
    if len(some):
        same[some] = np.logical_and.reduceat(equal, np.cumsum(n) - n)
    odd = np.flatnonzero(~same)
    if len(odd):
        of = of.copy()
        of[odd] = len(at) + np.arange(len(odd))
        at = np.concatenate((at, odd))
    return at, of


class PlainEncoder:
    """A tokenizers JSON file, without added tokens, truncation or padding.

    spaced: it has GPT-2's pre-tokenizer; else the one that drops white space and lower-cases.
    """

    #: Longest pre-token for which the model is called at once.
    leaf = 1 << 30

    def __init__(self, path: str, spaced: bool):
        from tokenizers import Tokenizer

        self.spaced = spaced
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.characters = str.maketrans(dict(enumerate(byte_characters())))

    def __call__(self, chunks: list[bytes], hard: list[bool], ids: bool) -> list:
        out: list = [None] * len(chunks)
        whole = [i for i, h in enumerate(hard) if h and len(chunks[i]) <= self.leaf]
        texts = [chunks[i].decode("utf-8", "replace") for i in whole]
        for i, e in zip(whole, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            out[i] = e.ids if ids else len(e.ids)
        tokenize, characters = self.model.tokenize, self.characters
        for i, c in enumerate(chunks):
            if out[i] is None:
                if len(c) > self.leaf:
                    found = self.long(c, hard[i])
                else:
                    if not self.spaced:
                        c = c.decode().lower().encode()
                    found = [t.id for t in tokenize(c.decode("latin-1").translate(characters))]
                out[i] = found if ids else len(found)
        return out

    def long(self, chunk: bytes, hard: bool) -> list[int]:
        raise NotImplementedError


def byte_characters() -> list[str]:
    """The printable characters for which byte-level vocabularies write the 256 bytes: printable Latin-1
    stands for itself, the other bytes in order for U+0100 and up."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    other = iter(range(0x100, 0x200))
    return [chr(b if b in printable else next(other)) for b in range(256)]


class TreeEncoder(PlainEncoder):
    """Byte-level BPE that encodes long pre-tokens by tree concatenation.

    A pre-token of more than `leaf` bytes is cut into pieces that are encoded in parallel and joined in
    pairs, level by level, all joins of a level in parallel: in batches for the library's own threads, as
    Python's would wait for each other, or one after the other with one worker. At a join, a window of tokens on both sides is encoded anew and grows until its
    first and last tokens are those that the two sides have there. A sequence is the BPE encoding of its
    bytes exactly if every two neighbours are the encoding of their own bytes, so then the join is exact.
    """

    def __init__(self, path: str, leaf: int = 2048, workers: int = 1):
        """workers: the cores that a task has; with more than one, the library's own threads encode leaves and joins."""
        from tokenizers import Tokenizer

        super().__init__(path, spaced=True)
        self.leaf, self.workers = leaf, workers
        self.bare = Tokenizer(self.model)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = {t: self.tokenizer.token_to_id(t) for t in special}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None

    def long(self, chunk: bytes, hard: bool) -> list[int]:
        if not hard:
            return self.tree(chunk.decode("latin-1").translate(self.characters))
        text = chunk.decode("utf-8", "replace")
        ids: list[int] = []
        for piece in self.split.split(text) if self.split else [text]:
            if piece in self.special:
                ids.append(self.special[piece])
            elif piece:
                for word, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(piece):
                    ids += self.tree(word)
        return ids

    def leaves(self, words: list[str]) -> list[list[int]]:
        if self.workers > 1 and len(words) > 1:
            return [e.ids for e in self.bare.encode_batch_fast(words, add_special_tokens=False)]
        return [[t.id for t in self.model.tokenize(w)] for w in words]

    def tree(self, word: str) -> list[int]:
        level = self.leaves([word[i : i + self.leaf] for i in range(0, len(word), self.leaf)])
        while len(level) > 1:
            joined = self.join(list(zip(level[0::2], level[1::2])))
            level = joined + level[len(level) - len(level) % 2 :]
        return level[0]

    def join(self, pairs: list[tuple[list[int], list[int]]]) -> list[list[int]]:
        out: list[list[int]] = [[]] * len(pairs)
        reach, still = 4, list(range(len(pairs)))
        while still:
            near = [(pairs[i][0][-reach:], pairs[i][1][:reach]) for i in still]
            windows = self.leaves(["".join(map(self.model.id_to_token, before + after)) for before, after in near])
            more = []
            for i, (before, after), window in zip(still, near, windows, strict=True):
                left, right = pairs[i]
                if window and (reach >= len(left) or window[0] == before[0]) and (reach >= len(right) or window[-1] == after[-1]):
                    out[i] = left[: max(0, len(left) - reach)] + window + right[reach:]
                else:
                    more.append(i)
            reach, still = 2 * reach, more
        return out


def byte_table(path: str) -> list[bytes]:
    """The bytes of every id: byte-level vocabularies write bytes as printable characters, special strings as they are."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    byte = {c: b for b, c in enumerate(byte_characters())}
    vocabulary = tokenizer.get_vocab(with_added_tokens=True)
    table = [b""] * (max(vocabulary.values()) + 1)
    for token, i in vocabulary.items():
        table[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
    return table
