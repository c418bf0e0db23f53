"""Token ids of whole texts with a given tokenizer file, word by word.

The tokenizer drops white space and never joins words across it, so a text's ids are those of its
words in order. A slice's distinct words are encoded once and put together again with
arrays. Words of Latin letters go straight to the tokenizer's model; for these its
normalizer only lowers case and its splitter keeps them whole. All others take the whole way.
"""

from __future__ import annotations

import functools
import os
from array import array

import numpy as np
import pyarrow as pa

from ixlake.llm.common import coded, split_words

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
SLICE_BYTES = 8 << 20
# Words remembered between slices; beyond that the memory starts anew.
REMEMBERED = 400_000
_LATIN = "ɐ"  # letters below it have no composed forms apart from themselves
_PLAIN_ENDS = ".,;:!?"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return name if os.path.isabs(name) else public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """The printable stand-ins of a byte-level vocabulary for all bytes."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + n) for n, b in enumerate(others)}


def _packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


class Encoder:
    def __init__(self, path: str, end_id: int = END_ID):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.end_id = end_id
        self.letters = _byte_letters()
        self.ends = {c: _packed(self.whole.encode(c, add_special_tokens=False).ids) for c in _PLAIN_ENDS}
        # Bytes, not lists: hundreds of thousands of them cost the garbage collector nothing.
        self.known: dict[bytes, bytes] = {}

    def _word(self, raw: bytes) -> bytes:
        word = raw.decode()
        core, end = (word[:-1], word[-1]) if word[-1] in _PLAIN_ENDS else (word, "")
        if core.isalpha() and len(core) < 512:
            if core.isascii():
                return _packed([t.id for t in self.model.tokenize(core.lower())]) + self.ends.get(end, b"")
            if max(core) < _LATIN and len(lower := core.lower()) == len(core):
                plain = lower if lower.isascii() else lower.encode().decode("latin-1").translate(self.letters)
                return _packed([t.id for t in self.model.tokenize(plain)]) + self.ends.get(end, b"")
        return _packed(self.whole.encode(word, add_special_tokens=False).ids)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Where each text's ids begin, with the end as last entry, and all ids.

        Each text's ids are followed by the end id. A null or empty text has that only.
        """
        starts, flat = split_words(texts)
        codes, distinct = coded(flat)
        known = self.known
        if len(known) >= REMEMBERED:
            known.clear()
        listed = []
        for raw in distinct:
            ids = known.get(raw)
            if ids is None:
                ids = self._word(raw)
                if len(raw) <= 64 and len(known) < REMEMBERED:
                    known[raw] = ids
            listed.append(ids)
        sizes = np.fromiter(map(len, listed), np.int64, len(listed)) // 4
        pool = np.frombuffer(b"".join(listed), np.uint32)
        pool_at = np.cumsum(sizes) - sizes
        # One more "word" a text, the end id, behind its words.
        n = len(starts) - 1
        counts = sizes[codes]
        word_at = np.zeros(len(codes) + 1, np.int64)
        np.cumsum(counts, out=word_at[1:])
        owner = np.repeat(np.arange(n), np.diff(starts))
        out_starts = word_at[starts] + np.arange(n + 1)
        out = np.full(int(out_starts[-1]), self.end_id, np.uint32)
        total = int(word_at[-1])
        if total:
            source = np.arange(total) + np.repeat(pool_at[codes] - word_at[:-1], counts)
            target = np.arange(total) + np.repeat(owner, counts)
            out[target] = pool[source]
        return out_starts, out


@functools.lru_cache(maxsize=2)
def encoder(name: str = TOKENIZER, end_id: int = END_ID) -> Encoder:
    """The encoder of this worker, kept from task to task."""
    return Encoder(tokenizer_path(name), end_id)
