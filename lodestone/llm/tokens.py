"""Exact batch encoding with a public tokenizer, one model call for each distinct piece.

A text is cut where the tokenizer's own pre-tokenizer certainly cuts (changes between letters,
numbers, other characters and white space); pieces repeat a lot, so each distinct piece is
encoded once by the tokenizers library and texts are put together by array lookups. A text with
characters for which the cuts aren't certain goes to the library whole. What is known of pieces
takes about `cache_bytes` in a worker at most (one batch's pieces more), and goes when a task ends.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa

from .common import CACHES

UNSURE, LETTER, NUMBER, OTHER, WHITE = range(5)


def _class_of(cp: int) -> int:
    if cp == 0x20 or 9 <= cp <= 13:
        return WHITE
    if cp == 0xA0 or unicodedata.category(chr(cp)) == "Cc":
        return UNSURE
    return {"L": LETTER, "N": NUMBER}.get(unicodedata.category(chr(cp))[0], OTHER)


def byte_alphabet() -> list[str]:
    """The printable stand-in that byte-level BPE uses for each byte value."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return [chr(b) if b in set(shown) else chr(256 + hidden.index(b)) for b in range(256)]


def runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of each run, one run after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


class Encoder:
    """`encode(array)` gives the ids of all texts as one array and the number of each text's ids.

    Null texts count as empty. Specials in a text are read as the library reads them.
    """

    #: Characters up to here have stable classes, compose with nothing and lower-case to one character.
    LAST_SURE = 0x12F
    #: Bytes of text that are worked on at once.
    PART = 2_000_000

    def __init__(self, path: str, cache_bytes: int = 96_000_000):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.model = self.tok.model
        #: Byte-level with spaces kept in front of words, or words in lower case without white space.
        self.spaced = self.tok.normalizer is None
        self.specials = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.cache_bytes = cache_bytes
        self.to_shown = {b: ord(c) for b, c in enumerate(byte_alphabet())}
        self.classes = np.array([_class_of(c) for c in range(self.LAST_SURE + 1)], np.uint8)
        self._reset()

    def _reset(self) -> None:
        self.known: dict[str, int] = {}
        self.size = 0
        self.ids = np.empty(1 << 16, np.uint32)
        self.at = np.zeros(1 << 14, np.int64)  # piece k has ids[at[k]:at[k + 1]]

    def _piece_ids(self, piece: str) -> list[int]:
        if "'" in piece:  # may hold a contraction, which the pre-tokenizer cuts
            return self.tok.encode(piece, add_special_tokens=False).ids
        if not self.spaced:
            piece = piece.lower()
        shown = piece.encode().decode("latin-1").translate(self.to_shown)
        return [t.id for t in self.model.tokenize(shown)]

    def _learn(self, pieces: np.ndarray) -> np.ndarray:
        """Numbers of the pieces, new ones encoded first."""
        if self.size > self.cache_bytes:
            self._reset()
        known = self.known
        new = [p for p in pieces if p not in known]
        if new:
            # a dictionary entry with its number, and the text as Python holds it
            self.size += 200 * len(new) + sum(map(len, new))
            got = [self._piece_ids(p) for p in new]
            n, k = int(self.at[len(known)]), len(known)
            lengths = np.fromiter(map(len, got), np.int64, len(got))
            total = int(lengths.sum())
            if n + total > len(self.ids):
                self.ids = np.concatenate([self.ids[:n], np.empty(max(n, total) + 1024, np.uint32)])
            if k + len(new) + 1 > len(self.at):
                self.at = np.concatenate([self.at[: k + 1], np.zeros(max(k, len(new)) + 1024, np.int64)])
            self.ids[n : n + total] = np.fromiter((i for x in got for i in x), np.uint32, total)
            self.at[k + 1 : k + 1 + len(new)] = n + np.cumsum(lengths)
            known.update(zip(new, range(k, k + len(new)), strict=True))
        return np.fromiter(map(known.__getitem__, pieces), np.int64, len(pieces))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        got = list(self.encode_parts(texts))
        if not got:
            return np.empty(0, np.uint32), np.zeros(0, np.int64)
        return np.concatenate([x for x, _ in got]), np.concatenate([n for _, n in got])

    def encode_parts(self, texts: pa.Array):
        """As encode(), for one run of rows of about PART bytes after the other: memory stays bounded."""
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        if texts.null_count:
            texts = texts.fill_null("")
        texts = texts.cast(pa.large_string())
        n = len(texts)
        if not n:
            return
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
        part = (offsets[:-1] - offsets[0]) // self.PART
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1), n]
        for a, b in zip(edges, edges[1:], strict=False):
            yield self._encode(texts.slice(a, b - a))

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        n = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
        size = int(offsets[-1] - offsets[0])
        if not size:
            return np.empty(0, np.uint32), np.zeros(n, np.int64)
        data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        bounds = offsets - offsets[0]
        cls, whole = self._classes(data)
        odd = np.zeros(n, bool)  # texts that go to the library whole
        if len(whole):
            odd[np.searchsorted(bounds, whole, "right") - 1] = True
        raw = data.tobytes()
        for s in self.specials:
            mark, at = s.encode(), -1
            while (at := raw.find(mark, at + 1)) >= 0:
                odd[np.searchsorted(bounds, at, "right") - 1] = True
        starts = self._starts(data, cls, bounds)
        kinds = cls[starts]
        lengths = np.diff(np.append(starts, size))
        doc = np.searchsorted(bounds, starts, "right") - 1
        sure = ~odd[doc]
        if not self.spaced:
            sure &= kinds != WHITE
        starts, lengths, doc = starts[sure], lengths[sure], doc[sure]
        counts = np.zeros(n, np.int64)
        ids = np.empty(0, np.uint32)
        if len(starts):
            # a dictionary of the batch's pieces, made by Arrow over the text's own bytes
            edges = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
            flat = data if len(data) == edges[-1] else data[runs(starts, lengths)]
            pieces = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(flat)))
            coded = pieces.dictionary_encode()
            number = self._learn(coded.dictionary.to_numpy(zero_copy_only=False))[coded.indices.to_numpy()]
            first, m = self.at[number], self.at[number + 1] - self.at[number]
            ids = self.ids[runs(first, m)]
            counts = np.bincount(doc, m, n).astype(np.int64)
        if odd.any():
            ids, counts = self._with_whole(texts, odd, ids, counts)
        return ids, counts

    def _with_whole(self, texts, odd, ids, counts):
        ends = np.cumsum(counts)
        parts = []
        for i in range(len(texts)):
            if odd[i]:
                own = np.array(self.tok.encode(texts[i].as_py(), add_special_tokens=False).ids, np.uint32)
                counts[i] = len(own)
                parts.append(own)
            else:
                parts.append(ids[ends[i] - counts[i] : ends[i]])
        return np.concatenate(parts), counts

    def _classes(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The class of each byte's character (following bytes: as the first), and where unsure ones are."""
        high = np.flatnonzero(data >= 0x80)
        cls = self.classes[data]
        if len(high):
            lead = high[(data[high] & 0xC0) != 0x80]
            b, after = data[lead].astype(np.int32), data[np.minimum(lead + 1, len(data) - 1)]
            cp = np.where((b >> 5) == 6, ((b & 0x1F) << 6) | (after & 0x3F), self.LAST_SURE + 1)
            kind = np.where(cp > self.LAST_SURE, UNSURE, self.classes[np.minimum(cp, self.LAST_SURE)])
            cls[high] = UNSURE
            cls[lead] = kind
            cls[lead[kind != UNSURE] + 1] = kind[kind != UNSURE]
        return cls, np.flatnonzero(cls == UNSURE)

    def _starts(self, data: np.ndarray, cls: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        n = len(data)
        head = np.zeros(n, bool)  # a text starts here
        head[bounds[:-1][bounds[:-1] < n]] = True
        before, now = cls[:-1], cls[1:]
        inside = (data[1:] & 0xC0) == 0x80
        white = now == WHITE
        cut = np.empty(n, bool)
        cut[0] = True
        c = before != now
        if self.spaced:
            tail = np.empty(n, bool)  # the next character is in the same text and not white
            tail[:-1] = ~white & ~head[1:]
            tail[-1] = False
            c = np.where(white, (before != WHITE) | tail[1:], np.where(before == WHITE, data[:-1] != 0x20, c))
        else:
            c |= (now == NUMBER) & (before == NUMBER)
        c &= ~((data[:-1] == 0x27) & ~white) & ~inside
        cut[1:] = c
        return np.flatnonzero(cut | head)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder for a vocabulary, as long as a task lasts."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


CACHES.append(_encoders)


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with end_id behind each text's, and the counts with it."""
    out = np.full(len(ids) + len(counts), end_id, np.uint32)
    out[np.arange(len(ids)) + np.repeat(np.arange(len(counts)), counts)] = ids
    return out, counts + 1


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
