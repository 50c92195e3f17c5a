"""Token ids of whole texts with a public tokenizer, inside Arrow tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from binloom.llm.words import _LOWER, SPACE, Words, _buffer, hash_spans

CACHED_WORDS = 750_000
ENCODED_AT_ONCE = 8192
# kinds of bytes: white space 0, letters and digits of ASCII 2, marks that no special token holds 3, all others 1
_KIND = np.where(SPACE, 1, 0).astype(np.uint8)
_KIND[[*b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = 2
_KIND[[*b'.,;:!?&%$*#"']] = 3
_encoders: dict[tuple[str, bool], "Encoder"] = {}


class Encoder:
    """Encodes batches of texts.

    ``by_word`` says that the tokenizer lower-cases, drops white space, and never joins across it or across a change between
    ASCII letters or digits and marks.  A text's ids are then those of such parts, one after the other; each distinct part is
    encoded once and kept, up to ``CACHED_WORDS``.  Otherwise whole texts are encoded.
    """

    def __init__(self, path: str, by_word: bool = True):
        self.tokenizer, self.by_word = Tokenizer.from_file(path), by_word
        self.tokenizer.no_truncation()
        self._clear()

    @classmethod
    def get(cls, path: str, by_word: bool = True) -> "Encoder":
        """One for each Python worker, so what it has seen serves later tasks, too."""
        if (path, by_word) not in _encoders:
            _encoders[path, by_word] = cls(path, by_word)
        return _encoders[path, by_word]

    @property
    def dtype(self) -> np.dtype:
        return np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")

    def _clear(self) -> None:
        self.known, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, self.dtype)

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        flat, size = [np.zeros(0, self.dtype)], [np.zeros(0, np.int64)]
        for i in range(0, len(texts), ENCODED_AT_ONCE):      # encodings are large objects
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts[i:i + ENCODED_AT_ONCE], add_special_tokens=False)]
            size.append(np.fromiter(map(len, ids), np.int64, len(ids)))
            flat.append(np.fromiter((j for x in ids for j in x), self.dtype, int(size[-1].sum())))
        return np.concatenate(flat), np.concatenate(size)

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids of an Arrow string array, and where each text's begin; a null text has none."""
        if not self.by_word:
            flat, size = self._encode([t or "" for t in texts.to_pylist()])
            return flat, np.concatenate([[0], np.cumsum(size)])
        w = _parts(texts)
        where = self._places(w)
        size = self.size[where]
        ends = np.concatenate([[0], np.cumsum(size)])
        flat = self.flat[np.repeat(self.at[where] - ends[:-1], size) + np.arange(ends[-1])]
        return flat, ends[w.first]

    def _places(self, w: Words) -> np.ndarray:
        unique, index, inverse = np.unique(w.hash, return_index=True, return_inverse=True)
        if len(self.known) + len(unique) > CACHED_WORDS:
            self._clear()
        at = np.searchsorted(self.known, unique)
        have = np.zeros(len(unique), bool)
        inside = at < len(self.known)
        have[inside] = self.known[at[inside]] == unique[inside]
        if not have.all():
            flat, size = self._encode([s.decode() for s in w.strings(index[~have])])
            begin = len(self.flat) + np.cumsum(size) - size
            known = np.concatenate([self.known, unique[~have]])
            order = np.argsort(known, kind="stable")
            self.known = known[order]
            self.at, self.size = np.concatenate([self.at, begin])[order], np.concatenate([self.size, size])[order]
            self.flat = np.concatenate([self.flat, flat])
            at = np.searchsorted(self.known, unique)
        return at[inverse.reshape(-1)]


def _parts(texts) -> Words:
    data, bounds = _buffer(texts)
    if b"<|" not in data.tobytes():      # else capitals could make a special token
        data = _LOWER[data]
    kind = _KIND[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    change = (kind[1:] * kind[:-1] == 6) | (kind[1:] == 0) | (kind[:-1] == 0) | edge[1:-1]
    opens, closes = kind > 0, kind > 0
    opens[1:] &= change
    closes[:-1] &= change
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return Words(data, bounds, start, end, hash_spans(data, start, end), np.searchsorted(start, bounds).astype(np.int64))


def lengths(texts: pa.Array, path: str, by_word: bool = True) -> np.ndarray:
    return np.diff(Encoder.get(path, by_word).encode(texts)[1])
