"""Token ids of whole texts with the word-level BPE of a public vocabulary file.

The tokenizer never joins across white space, so a text's ids are those of its chunks between
ASCII white space, one after another. Plain texts are cut into pre-tokens here, whose ids from the
BPE model are remembered (a bounded number of them); all else goes to the tokenizer itself.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from pitchside.llm.common import chunks

#: The byte alphabet of byte-level BPE by its rule: printable bytes stand for themselves, the
#: others for the code points from 256 on, in order.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
ALPHABET = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in set(_PLAIN))}
END_ID = 2
#: Letters from U+00C0 to U+024F whose lower case is one letter of that range; that of Ə or Ɣ, say, is not.
_LETTERS = "".join(c for c in map(chr, range(0xC0, 0x250)) if c not in "×÷ŉ" and len(c.lower()) == 1 and "À" <= c.lower() <= "ɏ")
#: Texts that need no normalisation but lower-casing character by character: those letters, digits,
#: ASCII signs without the apostrophe (contractions).
PLAIN = re.compile(f"[\t-\r !-&(-~{_LETTERS}]*")
#: Their pre-tokens: runs of letters, single digits, runs of signs.
RUNS = re.compile("[a-zÀ-ÖØ-öø-ɏ]+|[0-9]|[^a-zÀ-ÖØ-öø-ɏ0-9\t-\r ]+")


class Encoder:
    def __init__(self, path: str, remember: int = 200_000, longest: int = 64):
        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.remember, self.longest = self.tokenizer.model, remember, longest
        self.known: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _miss(self, run: str) -> bytes:
        mapped = run if run.isascii() else run.encode().decode("latin-1").translate(ALPHABET)
        out = array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()
        if len(run) <= self.longest:
            if len(self.known) >= self.remember:
                self.known.clear()
            self.known[run] = out
        return out

    def _plain(self, text: str) -> bytes:
        get = self.known.get
        return b"".join([get(r) or self._miss(r) for r in RUNS.findall(text.lower())])

    def chunk(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of a text without white space."""
        return self._plain(text) if PLAIN.fullmatch(text) and "<|" not in text else self._whole(text)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and where each text's ids start (one more entry: the end).

        Chunks are numbered by Arrow, so each distinct one is looked at once in a call.
        """
        index, words, starts = chunks(texts)
        ids = [self.chunk(w) for w in words]
        flat = np.frombuffer(b"".join(ids), dtype="<u4")
        length = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
        first = np.cumsum(length) - length
        each = length[index]
        end = np.concatenate([[0], np.cumsum(each)])
        return flat[np.repeat(first[index] - end[:-1], each) + np.arange(end[-1])], end[starts]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per Python worker, which keeps what it has learnt from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
