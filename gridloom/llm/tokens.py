"""Token ids of whole texts, by a public tokenizer file, with a cache of pieces of texts.

A byte-level BPE first cuts a text into pre-tokens, and some of its cuts show in two neighbouring bytes: before white space
that follows what is none, before the last of white space that precedes what is none (a space goes with what follows, any
other is a pre-token of its own), and between a letter and a stop. The ids of a text are those of its pieces, cut at all of
these, one after the other. Pieces are cut and numbered as arrays, and only those not met before are encoded: many in one
long string, where what a piece begins with marks its first id.

White space beyond ASCII is not cut at, and a piece with any is encoded by itself. A token added to the vocabulary ends what
stands before it: a text with one is encoded as it is. Very long texts are encoded in parts, which begin at a space between letters.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa

#: Pieces kept, the longest piece kept in bytes, characters that are cut into pieces at a time, and pieces that are encoded in one string.
KEPT = 600_000
KEPT_BYTES = 64
AT_ONCE = 4_000_000
JOINED = 2000
BETWEEN_WORDS = re.compile("(?<=[A-Za-z]) (?=[A-Za-z])")
#: Kinds of bytes: space, other white space, letters, stops, what may be or begin a sign of white space that ASCII doesn't have, and what is one.
OTHER, SPACE, WHITE, LETTER, STOP, RARE, ODD = range(7)


def _kinds() -> np.ndarray:
    out = np.full(256, OTHER, np.uint8)
    for kind, chars in ((SPACE, b" "), (WHITE, b"\t\n\v\f\r"), (STOP, b".,;:!?*#%&$"), (RARE, b"\x1c\x1d\x1e\x1f\xc2\xe1\xe2\xe3")):
        out[list(chars)] = kind
    for first in b"aA":
        out[first : first + 26] = LETTER
    return out


def _pairs(cut: set[tuple[int, int]]) -> np.ndarray:
    """Whether a pair of kinds, 8 times the first and the second, is in `cut`."""
    return np.array([(k // 8, k % 8) in cut for k in range(64)])


KINDS = _kinds()
SOLID = (OTHER, LETTER, STOP, RARE)
#: Pairs of kinds with a cut in between, and with one before the first.
BETWEEN = _pairs({(a, b) for a in SOLID for b in (SPACE, WHITE)} | {(WHITE, b) for b in SOLID} | {(LETTER, STOP)})
BEFORE = _pairs({(a, b) for a in (SPACE, WHITE) for b in SOLID})


def _kinds_of(data: np.ndarray) -> np.ndarray:
    """The kind of each byte of texts in UTF-8; all bytes of white space beyond ASCII, and of some signs that are near to it, are ODD."""
    kind = KINDS[data]
    at = np.flatnonzero(kind == RARE)
    a, b, c = (data[np.minimum(at + k, len(data) - 1)] for k in range(3))
    mark = (b == 0x80) & ((c < 0x90) | (c > 0xA7)) | (b == 0x81)  # not quotes and dashes
    odd = (a < 0x20) | (a == 0xC2) & ((b == 0x85) | (b == 0xA0)) | (a == 0xE1) & ((b == 0x9A) | (b == 0xA0)) | (a == 0xE2) & mark | (a == 0xE3) & (b == 0x80) & (c == 0x80)
    for k, lead in enumerate((0, 0xC2, 0xE1)):
        kind[at[odd & (a >= lead)] + k] = ODD
    return kind


def _parts(text: str) -> Iterator[str]:
    """A text in parts of AT_ONCE characters, or more up to the next space between letters."""
    at = 0
    while at < len(text):
        found = BETWEEN_WORDS.search(text, at + AT_ONCE)
        end = found.start() if found else len(text)
        yield text[at:end]
        at = end


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids."""

    def __init__(self, path: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path or default_path())
        self.words = Tokenizer(self.tokenizer.model)  # of pre-tokens, in the signs that the vocabulary has for bytes, with spaces in between
        self.words.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        self.added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        names = self.tokenizer.get_vocab()
        self.spaced, self.line_end = np.zeros((2, max(names.values()) + 1), bool)  # whether an id begins with a space, or is a line end
        for name, i in names.items():
            self.spaced[i], self.line_end[i] = name.startswith("\u0120"), name == "\u010a"
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}  # numbers of pieces
        self.first, self.size = np.zeros((2, 0), np.int64)  # by number: where a piece's ids begin, and how many they are
        self.ids = np.zeros(0, "<u4")

    def encode(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        group: list[str] = []
        chars = 0
        for text in texts:
            group.append(text or "")
            chars += len(text or "")
            if len(group[-1]) > 2 * AT_ONCE:
                long = group.pop()
                yield from self._group(group)
                yield b"".join(x for part in _parts(long) for x in self._group([part]))
                group, chars = [], 0
            elif chars >= AT_ONCE:
                yield from self._group(group)
                group, chars = [], 0
        yield from self._group(group)

    def _alone(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _group(self, texts: list[str]) -> Iterator[bytes]:
        if not texts:
            return
        # ids of texts that aren't cut
        whole = {i: self._alone(x).tobytes() for i, x in enumerate(texts) if any(map(x.__contains__, self.added))}
        raw = [b"" if i in whole else x.encode() for i, x in enumerate(texts)]
        data = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)  # a line end closes each text
        ends = np.cumsum([len(x) + 1 for x in raw]) - 1
        kind = _kinds_of(data)
        pair = kind[:-1] << 3 | kind[1:]
        cut = np.zeros(len(data), bool)
        cut[1:] = BETWEEN[pair]
        cut[:-1] |= BEFORE[pair]
        cut[0] = cut[ends] = cut[ends[:-1] + 1] = True
        at = np.flatnonzero(cut)
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(np.append(at, len(data))), pa.py_buffer(data)])
        coded = pieces.dictionary_encode()
        number, which = self._numbers(coded.dictionary.to_pylist()), coded.indices.to_numpy()
        size = self.size[number][which]
        last = np.searchsorted(at, ends)
        size[last] = 0
        stop = np.cumsum(size)
        ids = self.ids[np.repeat(self.first[number][which] - stop + size, size) + np.arange(stop[-1])].tobytes()
        stops = (4 * stop[last]).tolist()
        for i, (a, b) in enumerate(zip([0, *stops], stops, strict=False)):
            yield whole.get(i) or ids[a:b]

    def _numbers(self, pieces: list[bytes]) -> np.ndarray:
        """The numbers of different pieces; those not met before are encoded."""
        if len(self.known) > KEPT or len(self.ids) > 8 * KEPT:
            self._forget()
        out = np.fromiter(map(self.known.get, pieces, repeat(-1)), np.int64, len(pieces))
        at = np.flatnonzero(out < 0)
        if len(at):
            new = [pieces[i] for i in at.tolist()]
            out[at] = np.arange(len(self.size), len(self.size) + len(new))
            self._learn(new)
            self.known.update((p, n) for p, n in zip(new, out[at].tolist(), strict=True) if len(p) <= KEPT_BYTES)
        return out

    def _learn(self, new: list[bytes]) -> None:
        """Encode pieces and give them the next numbers: words of ASCII letters as pre-tokens, others as they are, both with or without a space before them."""
        data = np.frombuffer(b"".join(new), np.uint8)
        begins = np.cumsum([0, *map(len, new)])[:-1]
        kind = _kinds_of(data)
        others = np.add.reduceat((kind != LETTER).astype(np.int64), begins)
        alone = np.isin(kind[np.append(begins[1:], len(data)) - 1], (SPACE, WHITE)) | (np.add.reduceat((kind == ODD).astype(np.int64), begins) > 0)
        spaced = ~alone & (kind[begins] == SPACE)
        first, size = np.zeros((2, len(new)), np.int64)
        found, total = [self.ids], len(self.ids)

        def keep(at: list[int], ids: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> None:
            nonlocal total
            if len(starts) != len(at):
                raise ValueError("the tokenizer doesn't begin a token at each mark")
            first[at], size[at] = total + starts, stops - starts
            found.append(ids)
            total += len(ids)

        for tokenizer, plain in ((self.words, others == spaced), (self.tokenizer, others != spaced)):
            for mark, places in (("\u0120", plain & spaced), ("\u010a", plain & ~spaced & ~alone)):
                places = np.flatnonzero(places).tolist()
                for k in range(0, len(places), JOINED):
                    some = places[k : k + JOINED]
                    if mark == "\u0120":
                        text = b"".join([new[i] for i in some]).decode()
                        text = text.replace(" ", " \u0120")[1:] if tokenizer is self.words else text
                    else:
                        text = "\n" + b"\n".join([new[i] for i in some]).decode()
                        text = text.replace("\n", " \u010a ")[1:] if tokenizer is self.words else text
                    ids = np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
                    marks = np.flatnonzero((self.spaced if mark == "\u0120" else self.line_end)[ids])
                    keep(some, ids, marks + (mark == "\u010a"), np.append(marks[1:], len(ids)))
        places = np.flatnonzero(alone).tolist()
        for k in range(0, len(places), JOINED):
            some = places[k : k + JOINED]
            each = [x.ids for x in self.tokenizer.encode_batch_fast([new[i].decode() for i in some], add_special_tokens=False)]
            stops = np.cumsum([len(x) for x in each])
            keep(some, np.array([i for x in each for i in x], "<u4"), np.append(0, stops[:-1]), stops)
        self.ids = np.concatenate(found)
        self.first, self.size = np.append(self.first, first), np.append(self.size, size)


@lru_cache(maxsize=1)
def encoder(path: str | None = None) -> Encoder:
    """The encoder of this process: tasks that follow one another share what it has met."""
    return Encoder(path)


def let_go() -> None:
    """Free the encoder that earlier tasks left in this process. Tasks of other stages, which have no use for it, call this first."""
    encoder.cache_clear()
    pa.default_memory_pool().release_unused()
