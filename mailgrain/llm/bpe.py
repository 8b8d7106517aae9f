"""Byte-level BPE encoding in Arrow batches with the tokenizers library.

Random prose repeats its words, so each worker keeps the ids of the pieces it has met. A text is cut at the blanks and line
ends where the pre-tokeniser always cuts; only the tokens of pieces not met before reach the library's model, in one call
a chunk of texts. Texts with other characters than those below, with blanks next to each other, or with an added token of the
vocabulary (as ``<|endoftext|>``, which the library reads as that token) go to the library whole.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer, pre_tokenizers

from .common import keep_only

#: Fixed value: the published pre-tokeniser pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters whose classes are the same in every Unicode version.
UNUSUAL = re.compile("[^\n\x20-\x7e\xa1-ɏ]")
#: A blank next to another: there the pre-tokeniser looks further than one piece.
RUNS = ("  ", " \n", "\n ", "\n\n")
MARKS = ".,;:!?"
HEAD = "\x01"  # marks a text's first piece, which has no blank before it; such a character is unusual in a text
CHUNK_CHARS = 4_000_000


def usual(text: str) -> bool:
    """No character of ``UNUSUAL``; the first look is cheap and enough for most texts."""
    bare = text.replace("\n", "")
    if bare.isprintable():
        if bare.isascii():
            return True
        try:
            bare.encode("latin-1")
            return True
        except UnicodeEncodeError:
            pass
    return not UNUSUAL.search(text)


def byte_alphabet() -> dict[int, int]:
    """Byte to printable character, by the published rule: printable Latin-1 stays, the others follow from U+0100."""
    kept = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in kept]
    return {b: b for b in kept} | {b: 256 + i for i, b in enumerate(others)}


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes, the same as ``Tokenizer.encode(text, add_special_tokens=False)``."""

    def __init__(self, path: str, max_bytes: int = 192 << 20):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = Tokenizer(self.tokenizer.model)
        self.alphabet, self.pattern = byte_alphabet(), regex.compile(PATTERN)
        self.max_bytes, self.held = max_bytes, 0
        self.pieces: dict[str, bytes] = {}
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        pre = self.tokenizer.pre_tokenizer
        self.plain = self.tokenizer.normalizer is None and isinstance(pre, pre_tokenizers.ByteLevel) and not pre.add_prefix_space

    def clear(self) -> None:
        self.pieces.clear()
        self.held = 0

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def cuts(self, text: str) -> bool:
        """Whether a text may be cut at its blanks and line ends."""
        return self.plain and text[0] not in " \n" and text[-1] not in " \n" and not any(r in text for r in RUNS) and usual(text) and not any(a in text for a in self.added)

    def split(self, piece: str) -> list[str]:
        """The pre-tokeniser's tokens of a piece, which begins with a line end, with ``HEAD``, or follows a blank."""
        found = self.pattern.findall(piece[1:] if piece[0] in "\n" + HEAD else " " + piece)
        return ["\n", *found] if piece[0] == "\n" else found

    def ids_of(self, tokens: list[str]) -> list[bytes]:
        """Ids of the pre-tokeniser's tokens by the library's model, in one call."""
        if not tokens:
            return []
        mapped = [x if x.isascii() and x.isprintable() else x.encode().decode("latin-1").translate(self.alphabet) for x in tokens]
        got = self.model.encode([x.replace(" ", "Ġ") for x in mapped], is_pretokenized=True, add_special_tokens=False)
        at = np.searchsorted(np.array(got.word_ids, np.int64), np.arange(len(tokens) + 1)).tolist()
        raw = np.array(got.ids, "<u4").tobytes()
        return [raw[4 * a : 4 * b] for a, b in zip(at[:-1], at[1:], strict=True)]

    def learn(self, new: list[str]) -> None:
        """Ids of pieces not met before. A word is a token with its blank; a mark after it is a token of its own."""
        words = [w for w in new if w.isalpha()]
        ended = [w for w in new if w[-1:] in MARKS and w[:-1].isalpha()]
        words += {w[:-1] for w in ended}.difference(words, self.pieces)
        self.pieces.update(zip(words, self.ids_of([" " + w for w in words]), strict=True))
        pieces, marks = self.pieces, dict(zip(MARKS, self.ids_of(list(MARKS)), strict=True))
        self.pieces.update([(w, pieces[w[:-1]] + marks[w[-1]]) for w in ended])
        others = [w for w in new if w not in pieces]
        cut = [self.split(w) for w in others]
        tokens = list(set(chain.from_iterable(cut)))
        known = dict(zip(tokens, self.ids_of(tokens), strict=True))
        pieces.update((w, b"".join([known[x] for x in c])) for w, c in zip(others, cut, strict=True))
        self.held += 4 * sum(map(len, new)) + 200 * len(new)

    def _chunk(self, texts: list[str]) -> list[bytes]:
        out, at = [b""] * len(texts), []
        for i, t in enumerate(texts):
            if t and self.cuts(t):
                at.append(i)
            elif t:
                out[i] = self.whole(t)
        if not at:
            return out
        if self.held > self.max_bytes:
            self.clear()
        words = pc.split_pattern(pa.array([HEAD + texts[i].replace("\n", " \n") for i in at], pa.large_string()), " ")
        coded = words.values.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        try:
            known = list(map(self.pieces.__getitem__, distinct))
        except KeyError:
            self.learn([w for w in distinct if w not in self.pieces])
            known = list(map(self.pieces.__getitem__, distinct))
        # Each word's ids are copied from those of its distinct word.
        flat, sizes = np.frombuffer(b"".join(known), "<u4"), np.fromiter(map(len, known), np.int64, len(known)) // 4
        index = coded.indices.to_numpy()
        n = sizes[index]
        ends = np.cumsum(n)
        ids = flat[np.repeat((np.cumsum(sizes) - sizes)[index] - (ends - n), n) + np.arange(ends[-1])]
        bounds = np.concatenate([[0], ends])[words.offsets.to_numpy()].tolist()
        for i, a, b in zip(at, bounds[:-1], bounds[1:], strict=True):
            out[i] = ids[a:b].tobytes()
        return out

    def encode_batch(self, texts) -> list[bytes]:
        """In chunks of about ``CHUNK_CHARS``, so that a batch's pieces are never held at once."""
        out: list[bytes] = []
        held, size = [], 0
        for t in texts:
            held.append(t or "")
            size += len(held[-1])
            if size > CHUNK_CHARS:
                out += self._chunk(held)
                held, size = [], 0
        return out + self._chunk(held) if held else out

    def encode(self, text: str) -> bytes:
        return self.encode_batch([text])[0]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of this worker process; its pieces serve all its tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    keep_only(_encoders[path])
    return _encoders[path]
