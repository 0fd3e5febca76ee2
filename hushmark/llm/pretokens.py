"""Pre-tokens of a byte-level BPE vocabulary, found in numpy for many texts at once.

The rule is the published one of byte-level BPE (contractions; letters, numbers or other signs, each with one space before; white
space, which leaves its last character to what follows). Which code points are letters, numbers or white space is asked of
the library itself, once per code point and worker, so its Unicode version decides. Added tokens of the vocabulary are pre-tokens of their own.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

from hushmark.llm.common import CHUNK_BYTES, binary

_UNKNOWN, _SPACE, _LETTER, _NUMBER, _OTHER = range(5)
#: A letter before a single space and a letter: the space starts a pre-token whatever stands around.
_SAFE_CUT = re.compile(rb"[A-Za-z](?= [A-Za-z])")
#: Bytes of a pre-token that fit its packed key.
KEY_BYTES = 16
_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)


class Vocabulary:
    """A byte-level BPE tokenizer file: its pre-tokens, and the ids of a pre-token."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            rules = json.load(file)
        pre, added = rules["pre_tokenizer"] or {}, rules["added_tokens"]
        plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not rules["normalizer"]
        if not plain or rules.get("truncation") or rules.get("padding") or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError(f"{path} is not a plain byte-level vocabulary")
        self.library = Tokenizer.from_file(path)
        self.special = {t["content"].encode(): t["id"] for t in added}
        self._special = re.compile(b"|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or rb"(?!)")
        self._classes = np.full(0x110000, _UNKNOWN, np.uint8)

        # Byte-level BPE writes bytes as signs: Latin-1 signs that can be seen as themselves, the others from 256 on.
        seen = {*range(33, 127), *range(161, 173), *range(174, 256)}
        hidden = iter(range(256, 512))
        self._signs = {b: b if b in seen else next(hidden) for b in range(256)}

    def ids(self, pretoken: bytes) -> list[int]:
        """The ids that the library gives to a pre-token, wherever it stands."""
        if pretoken in self.special:
            return [self.special[pretoken]]
        return [t.id for t in self.library.model.tokenize(pretoken.decode("latin-1").translate(self._signs))]

    def _classes_of(self, points: np.ndarray) -> np.ndarray:
        found = self._classes[points]
        if not found.all():
            for point in np.unique(points[found == _UNKNOWN]).tolist():
                kinds = [k for k, sign in ((_LETTER, "a"), (_NUMBER, "1"), (_OTHER, "!"))
                         if len(self.library.pre_tokenizer.pre_tokenize_str(sign + chr(point))) == 1]
                self._classes[point] = kinds[0] if kinds else _SPACE
            found = self._classes[points]
        return found

    def starts(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Byte offsets at which pre-tokens start; ``data`` is valid UTF-8, ``at`` the offsets of its texts, ends included."""
        if not len(data):
            return np.zeros(0, np.int64)
        special = [m.span() for m in self._special.finditer(data.tobytes())]
        special = [(a, b) for a, b in special if np.searchsorted(at, a, "right") == np.searchsorted(at, b, "left")]
        apart = np.concatenate([at, np.array(special, np.int64).ravel()])
        if data.max() < 128:
            lead, points = None, data
        else:
            lead = np.flatnonzero((data & 0xC0) != 0x80)
            b = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int32)
            b0, b1, b2, b3 = (b[lead + k] for k in range(4))
            points = np.where(b0 < 0x80, b0, np.where(b0 < 0xE0, (b0 & 0x1F) << 6 | b1 & 0x3F, np.where(
                b0 < 0xF0, (b0 & 0x0F) << 12 | (b1 & 0x3F) << 6 | b2 & 0x3F, (b0 & 0x07) << 18 | (b1 & 0x3F) << 12 | (b2 & 0x3F) << 6 | b3 & 0x3F)))
            apart = np.searchsorted(lead, apart)
        n, kinds = len(points), self._classes_of(points)
        fresh = np.zeros(n, bool)  # a text, or a stretch between added tokens, starts here
        fresh[apart[apart < n]] = True
        run = np.ones(n, bool)
        run[1:] = kinds[1:] != kinds[:-1]
        run |= fresh
        start = run.copy()
        after = np.flatnonzero(run & (kinds != _SPACE) & ~fresh)
        after = after[kinds[after - 1] == _SPACE]
        start[after - 1] = True
        start[after[points[after - 1] == 32]] = False
        self._contractions(points, kinds, run, fresh, start)
        for a, b in special:
            a, b = (a, b) if lead is None else np.searchsorted(lead, (a, b))
            start[a + 1 : b] = False
        found = np.flatnonzero(start)
        return found if lead is None else lead[found]

    @staticmethod
    def _contractions(points, kinds, run, fresh, start) -> None:
        n = len(points)
        at = np.flatnonzero((points[:-1] == 39) & run[:-1] & (kinds[1:] == _LETTER) & ~fresh[1:])
        at = at[fresh[at] | (points[at - 1] != 32)]
        if not len(at):
            return
        one = points[at + 1]
        has_two = at + 2 < n
        beyond = np.minimum(at + 2, n - 1)
        two = np.where(has_two & ~fresh[beyond], points[beyond], 0)
        single = np.isin(one, [ord(c) for c in "stmd"])
        double = np.zeros(len(at), bool)
        for a, b in ("re", "ve", "ll"):
            double |= (one == ord(a)) & (two == ord(b))
        at, size = at[single | double], np.where(single, 1, 2)[single | double]
        start[at + 1] = False
        ends = at + 1 + size
        start[ends[ends < n]] = True


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def stretches(column: pa.Array, limit: int = CHUNK_BYTES, safe: re.Pattern = _SAFE_CUT) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of each text, bytes, offsets): rows together up to the limit; a longer text in parts, cut after hits of ``safe`` only."""
    column = binary(column)
    rows, parts, held = [], [], 0
    for row in range(len(column)):
        text = column[row].as_buffer().to_pybytes()
        if not text.isascii():
            text = text.decode("utf-8", "replace").encode()
        first = 0
        while True:
            cut = safe.search(text, first + limit) if len(text) - first > limit else None
            last = cut.end() if cut else len(text)
            if held and held + last - first > limit:
                yield _joined(rows, parts)
                rows, parts, held = [], [], 0
            rows.append(row)
            parts.append(text[first:last] if cut or first else text)
            held += last - first
            if not cut:
                break
            first = last
    if rows:
        yield _joined(rows, parts)


def _joined(rows: list[int], parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.array(rows), np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


def packed(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first 16 bytes of each pre-token as two numbers; with its length, the whole pre-token if it is no longer."""
    room = np.concatenate([data, np.zeros(KEY_BYTES, np.uint8)])
    words = np.ndarray((len(data) + 9,), "<u8", room, strides=(1,))
    return words[starts] & _MASKS[np.minimum(lengths, 8)], words[starts + 8 if len(starts) else starts] & _MASKS[np.clip(lengths - 8, 0, 8)]


def mixed(low: np.ndarray, high: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A hash of packed keys."""
    h = (low * np.uint64(0x9E3779B97F4A7C15)) ^ (high * np.uint64(0xC2B2AE3D27D4EB4F)) ^ lengths.astype(np.uint64)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def unpacked(low: int, high: int, length: int) -> bytes:
    return (int(low).to_bytes(8, "little") + int(high).to_bytes(8, "little"))[:length]
