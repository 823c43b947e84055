"""Tokenizer files of the installed libraries: ids of many texts, and the bytes that each id stands for.

A text is cut into units where no token of either tokenizer can reach across: before each run of white space. Units seen before come from
a cache; new ones are encoded as one joined text and cut again by the byte lengths of their tokens.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import sentencepiece
from tokenizers import Tokenizer

from ledgerloom.llm.common import utf8
from ledgerloom.llm.tokens import range_hashes

JOINED_UNITS = 2048  # units that a library encodes as one text
CACHED_UNITS = 600_000  # units of one cache generation; two are kept
SPACE = "▁"

# Bytes that texts of plain Latin characters and spaces do not have; those of two bytes begin with 0xC2 (from U+00A1 on) to 0xC9 (to U+024F).
_ODD = np.ones(256, bool)
_ODD[[0x0A, 0x20]] = False
_ODD[0x21:0x7F] = _ODD[0x80:0xC0] = _ODD[0xC2:0xCA] = False


def _byte_of_symbol() -> dict[str, int]:
    """Byte-level vocabularies write printable Latin-1 bytes as themselves, the others as U+0100 and following."""
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class ByteLevel:
    """A byte-level file of the tokenizers library; the names of special tokens in a text are plain text."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.encode_special_tokens = True
        byte_of = _byte_of_symbol()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.token_bytes = [b""] * (max(self.tokenizer.get_vocab().values()) + 1)
        for token, i in vocabulary.items():
            self.token_bytes[i] = bytes(byte_of[c] for c in token)
        self.sizes = np.array([len(t) for t in self.token_bytes], np.int64)
        self.cuttable = True

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of a space and each text."""
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]


class SentencePiece:
    """A file of the sentencepiece library that puts a space before each text."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        pieces = self.model.id_to_piece(list(range(n)))
        self.token_bytes = [b"" if self.model.is_control(i) or self.model.is_unknown(i) else
                            bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(SPACE, " ").encode()
                            for i, p in enumerate(pieces)]
        self.sizes = np.array([len(t) for t in self.token_bytes], np.int64)
        # No piece goes on behind a letter with a space or a line feed, so none reaches across a cut.
        self.cuttable = not any(SPACE in p.lstrip(SPACE) or "\n" in p for p in pieces)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, with the space that the library puts before it."""
        return [np.array(ids, "<u4") for ids in self.model.encode(texts, num_threads=1)]


def open_tokenizer(path: str) -> ByteLevel | SentencePiece:
    return SentencePiece(path) if path.endswith(".model") else ByteLevel(path)


class Generation:
    """Ids of units, by the hash of each: sorted hashes, and per tokenizer where the ids lie in its pool."""

    def __init__(self, tokenizers: int = 1):
        self.keys = np.zeros(0, np.uint64)
        self.begin, self.size = np.zeros((tokenizers, 0), np.int64), np.zeros((tokenizers, 0), np.int64)
        self.pools, self.used = [np.zeros(1 << 16, "<u4") for _ in range(tokenizers)], [0] * tokenizers

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.keys):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return at, self.keys[at] == hashes

    def put(self, k: int, ids: np.ndarray) -> int:
        """Where the pool of a tokenizer now has these ids."""
        pool, used = self.pools[k], self.used[k]
        if used + len(ids) > len(pool):
            self.pools[k] = pool = np.concatenate([pool[:used], np.zeros(max(len(pool), len(ids)), "<u4")])
        pool[used:used + len(ids)] = ids
        self.used[k] += len(ids)
        return used

    def add(self, hashes: np.ndarray, begin: np.ndarray, size: np.ndarray) -> None:
        """Hashes that it does not have yet, in any order."""
        order = np.argsort(hashes)
        at = np.searchsorted(self.keys, hashes[order])
        self.keys = np.insert(self.keys, at, hashes[order])
        self.begin, self.size = (np.insert(x, at, y[:, order], axis=1) for x, y in ((self.begin, begin), (self.size, size)))

    def copied(self, other: "Generation", at: np.ndarray, hashes: np.ndarray) -> None:
        """Take over units of another generation."""
        begin, size = other.begin[:, at].copy(), other.size[:, at]
        for k in range(len(self.pools)):
            n = np.maximum(size[k], 0)
            begin[k] = self.put(k, other.pools[k][ranges(begin[k], n)]) + np.cumsum(n) - n
        self.add(hashes, begin, size)


def ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... of each range, one range behind the other."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


_opened: dict[tuple, "Encoders"] = {}


class Encoders:
    """Several tokenizers over the same texts: the ids that each gives for a space and the text.

    Units are told apart by 64-bit hashes: two of ten million are mistaken for each other in one of 400,000 runs.
    """

    def __init__(self, *paths: str):
        self.codecs = [open_tokenizer(p) for p in paths]
        self.cuttable = all(c.cuttable for c in self.codecs)
        self.young, self.old = Generation(len(paths)), Generation(len(paths))

    @classmethod
    def shared(cls, *paths: str) -> "Encoders":
        """The worker's encoders, with what earlier tasks of the worker have put in their cache."""
        if paths not in _opened:
            _opened[paths] = cls(*paths)
        return _opened[paths]

    def _exact(self, codec, ids: np.ndarray, text: bytes) -> bool:
        return b"".join([codec.token_bytes[i] for i in ids.tolist()]) == text

    def _learn(self, units: list[bytes], hashes: np.ndarray) -> None:
        """Ids of units by each tokenizer; size -1 where the tokens of one do not spell the unit."""
        tails = np.array([u[-1] in b" \n" for u in units], bool)
        parts = [[int(k)] for k in np.flatnonzero(tails)]  # white space at the end of a text would run into the next unit
        words = np.flatnonzero(~tails).tolist()
        parts += [words[k:k + JOINED_UNITS] for k in range(0, len(words), JOINED_UNITS)]
        begin, size = np.zeros((len(self.codecs), len(units)), np.int64), np.zeros((len(self.codecs), len(units)), np.int64)
        while parts:
            part = parts.pop()
            joined = b" a" + b"".join([units[k] for k in part])
            ids = [codec.encode([joined[1:].decode()])[0] for codec in self.codecs]
            if all(self._exact(codec, x, joined) for codec, x in zip(self.codecs, ids)):
                ends = np.cumsum([2, *(len(units[k]) for k in part)])
                for c, (codec, x) in enumerate(zip(self.codecs, ids)):
                    cuts = np.searchsorted(np.cumsum(codec.sizes[x]), ends) + 1
                    begin[c, part], size[c, part] = self.young.put(c, x) + cuts[:-1], np.diff(cuts)
            elif len(part) == 1:
                size[:, part] = -1
            else:  # find the units that are not spelt exactly
                parts += [part[:len(part) // 2], part[len(part) // 2:]]
        self.young.add(hashes, begin, size)

    def _know(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> None:
        """Have distinct units in the younger generation; the older one is what was in use before it was full."""
        missing = np.flatnonzero(~self.young.find(hashes)[1])
        if len(missing) and len(self.young.keys) + len(missing) > CACHED_UNITS:
            self.old, self.young, missing = self.young, Generation(len(self.codecs)), np.arange(len(hashes))
        at, kept = self.old.find(hashes[missing])
        if kept.any():
            self.young.copied(self.old, at[kept], hashes[missing[kept]])
        missing = missing[~kept]
        if len(missing):
            raw = data.tobytes()
            self._learn([raw[a:b] for a, b in zip(begin[missing].tolist(), end[missing].tolist())], hashes[missing])

    def encode_column(self, column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per tokenizer the ids of all texts one behind the other, and how many each has.

        None for empty texts, and for those whose bytes the tokens of any tokenizer do not spell.
        """
        raw, cuts = utf8(column)
        n = len(cuts) - 1
        data = np.full(len(raw) + n, 32, np.uint8)  # a space before each text
        first, last = cuts[:-1] + np.arange(n), cuts[1:] + np.arange(1, n + 1)
        data[np.arange(len(raw)) + np.repeat(np.arange(1, n + 1), np.diff(cuts))] = raw
        empty = np.diff(cuts) == 0
        after = np.append(data[1:], np.uint8(0))
        odd = _ODD[data] | ((data == 0xC2) & (after < 0xA1)) | ((data == 0xC9) & (after > 0x8F))
        counts = np.concatenate([[0], np.cumsum(odd)])
        whole = (counts[last] > counts[first]) | (not self.cuttable)
        blank = (data == 32) | (data == 10)
        starts = np.zeros(len(data), bool)
        starts[1:] = blank[1:] & ~blank[:-1]
        starts[first] = True
        begin = np.flatnonzero(starts)
        text_of = np.searchsorted(last, begin, side="right")
        end = np.append(begin[1:], len(data))
        plain = ~(whole | empty)[text_of]
        begin, end, text_of = begin[plain], end[plain], text_of[plain]
        hashes = range_hashes(data, begin, end)
        distinct, where, unit = np.unique(hashes, return_index=True, return_inverse=True)
        self._know(data, begin[where], end[where], distinct)
        slot = self.young.find(distinct)[0]
        wrong = empty.copy()
        wrong[text_of[self.young.size[0][slot][unit] < 0]] = True
        lone, found = np.flatnonzero(whole & ~empty), []
        for k in lone.tolist():
            text = data[first[k]:last[k]].tobytes()
            ids = [codec.encode([text[1:].decode()])[0] for codec in self.codecs]
            wrong[k] = not all(self._exact(codec, x, text) for codec, x in zip(self.codecs, ids))
            found.append(ids)
        out = []
        kept = ~wrong[text_of]
        for c in range(len(self.codecs)):
            at, size = self.young.begin[c][slot][unit][kept], self.young.size[c][slot][unit][kept]
            lengths = np.bincount(text_of[kept], weights=size, minlength=n).astype(np.int64)
            ids = self.young.pools[c][ranges(at, size)]
            extra = [(k, x[c]) for k, x in zip(lone.tolist(), found) if not wrong[k]]
            if extra:  # texts that were encoded as a whole stand between the others
                places = np.concatenate([[0], np.cumsum(lengths)])[[k for k, _ in extra]]
                ids = np.insert(ids, np.repeat(places, [len(x) for _, x in extra]), np.concatenate([x for _, x in extra]))
                lengths[[k for k, _ in extra]] = [len(x) for _, x in extra]
            out.append((ids, lengths))
        return out
