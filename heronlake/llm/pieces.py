"""SentencePiece BPE: exact encoding by backtracking, and decoding.

Merging by score gives one sequence of pieces, and it is the only one whose neighbours all fit: two pieces fit if merging
their joined text gives them again. (Merges in one part of a text don't depend on other parts until one crosses between
them, and the first that would cross a border does so with the two pieces beside it alone.) So a text is encoded from left
to right: an Aho-Corasick automaton names the longest piece that begins at each place; a piece that doesn't fit the one
before it is exchanged for the next shorter one, and where none fits, the place is marked as failed in a bit field and the
piece before is taken back. Characters without a piece become bytes, and nothing merges across them.
"""

from __future__ import annotations

import codecs
import re
import struct
from array import array
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronlake.llm.bpe import Memory, load
from heronlake.llm.common import ddl, map_rows

#: The sign that stands for a space; kinds of pieces in a model file.
SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
#: Characters for which matches are held at once; fitting pairs that a task remembers; the longest run that is cached.
WINDOW, PAIRS, LONG = 1 << 16, 1 << 20, 64
#: Parts of runs that a task remembers.
PARTS = 1 << 18


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The (number, value) fields of a protocol buffer message."""
    i = 0

    def varint() -> int:
        nonlocal i
        value = shift = 0
        while True:
            byte = raw[i]
            i += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while i < len(raw):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, raw[i : i + size]
            i += size


class Pieces:
    """The encoder that a model file describes: BPE with byte fallback, no normalisation but a space before the text."""

    def __init__(self, raw: bytes) -> None:
        spec: dict[int, list] = {}
        for number, value in _fields(raw):
            spec.setdefault(number, []).append(value)
        trainer, normalizer = dict(_fields(spec[2][0])), dict(_fields(spec[3][0]))
        # model type, byte fallback; rules of characters, a space before, extra spaces, spaces as signs, a space behind
        plain = trainer.get(3) == 2 and trainer.get(35) == 1 and not trainer.get(24)
        plain = plain and not normalizer.get(2) and normalizer.get(3, 1) and not normalizer.get(4, 1) and normalizer.get(5, 1)
        self.names, kinds, scores = [], [], []
        for piece in map(dict, map(_fields, spec[1])):
            self.names.append(piece[1].decode())
            kinds.append(piece.get(3, NORMAL))
            scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
        if not plain or not set(kinds) <= {NORMAL, UNKNOWN, CONTROL, BYTE} or kinds.count(BYTE) != 256 or self.names[kinds.index(BYTE)] != "<0x00>":
            raise ValueError("this model file has parts that Pieces doesn't know")
        self.end = trainer.get(42, 2)
        self.ids = {n: i for i, n in enumerate(self.names) if kinds[i] == NORMAL}
        self.scores = {n: scores[i] for n, i in self.ids.items()}
        self.first_byte = kinds.index(BYTE)
        shown = {UNKNOWN: " ⁇ ".encode(), CONTROL: b""}
        spaced = [n.replace(SPACE, " ").encode() for n in self.names]
        self.texts = [bytes([i - self.first_byte]) if k == BYTE else shown.get(k, spaced[i]) for i, k in enumerate(kinds)]
        single = {n for n in self.ids if len(n) == 1}
        if any(SPACE in n.lstrip(SPACE) or not single.issuperset(n) for n in self.ids):
            raise ValueError("a piece holds a space after other characters, or a character that isn't a piece")
        self.longest = max(map(len, self.ids))
        #: How many characters a piece has before its last one.
        self.before = [len(n) - 1 for n in self.names]
        self.automaton = ahocorasick.Automaton()
        #: The next shorter piece that a piece begins with; pieces that merging never makes are left out.
        self.shorter: dict[int, int] = {}
        usable = {n for n in self.ids if len(n) == 1 or self.merged(n) == [n]}
        for n in usable:
            self.automaton.add_word(n, self.ids[n])
            self.shorter[self.ids[n]] = next((self.ids[n[:k]] for k in range(len(n) - 1, 0, -1) if n[:k] in usable), -1)
        self.automaton.make_automaton()
        #: Two characters that no piece holds side by side: nothing merges across them.
        self.inside = {n[i : i + 2] for n in self.ids for i in range(len(n) - 1)}
        known = re.escape("".join(sorted(single - {SPACE})))
        #: Nothing merges between another character and a following space, nor across a character that isn't a piece.
        self.runs = re.compile(f"{SPACE}*[{known}]+|{SPACE}+|[^{known}{SPACE}]+")
        self.words, self.others = Memory(), Memory()
        self.parts: dict[str, bytes] = {}
        self.fits: dict[int, bool] = {}

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text by merging: the best score first, then the leftmost."""
        parts, get = list(text), self.scores.get
        while True:
            best = max(((s, -i) for i in range(len(parts) - 1) if (s := get(parts[i] + parts[i + 1])) is not None), default=None)
            if best is None:
                return parts
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def fit(self, a: int, b: int) -> bool:
        """Whether two pieces stay as they are when their joined text is merged."""
        key = a << 32 | b
        if (known := self.fits.get(key)) is None:
            if len(self.fits) >= PAIRS:
                self.fits.clear()
            x, y = self.names[a], self.names[b]
            known = self.fits[key] = self.merged(x + y) == [x, y]
        return known

    def matches(self, text: str, first: int = 0, size: int = WINDOW) -> list[int]:
        """The longest piece that begins at each place of a window of a run, and at some places behind it."""
        found, before = [0] * (min(size, len(text) - first) + self.longest), self.before
        for last, piece in self.automaton.iter(text, first, min(len(text), first + size + self.longest - 1)):
            found[last - first - before[piece]] = piece  # a later match from the same place is longer
        return found

    def run(self, text: str) -> array:
        """The ids of a run of known characters of any length."""
        if (whole := self.ids.get(text)) is not None and whole in self.shorter:
            return array("i", [whole])
        n, before, fits, fit, shorter = len(text), self.before, self.fits, self.fit, self.shorter
        longest = self.matches(text) if n <= WINDOW else _Windows(self, text)
        failed, out, at, prev = bytearray(n // 8 + 1), array("i"), 0, -1
        while at < n:
            piece = longest[at]
            while True:
                while piece >= 0:
                    to = at + before[piece] + 1
                    if failed[to >> 3] >> (to & 7) & 1:
                        piece = shorter[piece]
                        continue
                    if prev < 0 or (fits[prev << 32 | piece] if prev << 32 | piece in fits else fit(prev, piece)):
                        break
                    piece = shorter[piece]
                if piece >= 0:
                    out.append(piece)
                    at, prev = to, piece
                    break
                # the pieces up to here are the only ones that fit, so no other way leads on from this place
                failed[at >> 3] |= 1 << (at & 7)
                last = out.pop()
                at -= before[last] + 1
                prev = out[-1] if out else -1
                piece = shorter[last]
        return out

    def _ids_of(self, run: str) -> bytes:
        if run[0] == SPACE or run[0] in self.ids:
            if len(run) > LONG:
                return self.run(run).tobytes()
            inside, parts, first = self.inside, [], 0
            for i in range(1, len(run)):
                if run[i - 1 : i + 1] not in inside:
                    parts.append(run[first:i])
                    first = i
            parts.append(run[first:])
            found, out = self.parts.get, b""
            for x in parts:
                if (known := found(x)) is None:
                    if len(self.parts) >= PARTS:
                        self.parts.clear()
                    known = self.parts[x] = self.run(x).tobytes()
                out += known
            return out
        return np.add(np.frombuffer(run.encode(), np.uint8), self.first_byte, dtype=np.int32).tobytes()

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of a text, with the end id."""
        return self.encode_many([text])[0]

    def encode_many(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of some texts, each with the end id; a word that several of them hold is encoded once.

        A text whose spaces stand alone is cut at them, any other where its runs meet; both cuts are never merged across.
        """
        out: list[np.ndarray] = []
        split = []
        for t in texts:
            words = t.split(" ") if t else []
            single = "" not in words and SPACE not in (t or "")
            split.append((single, words if single else self.runs.findall(SPACE + t.replace(" ", SPACE))))
        for single, memory in ((True, self.words), (False, self.others)):
            for x in memory.missing({x for kind, parts in split if kind == single for x in parts}):
                if len(x) <= LONG:
                    memory.new[x] = self._word(x) if single else self._ids_of(x)
        for single, parts in split:
            known, slow = (self.words.new, self._word) if single else (self.others.new, self._ids_of)
            raw = b"".join([known[x] if x in known else slow(x) for x in parts])
            out.append(np.frombuffer(raw + self.end.to_bytes(4, "little"), np.int32))
        return out

    def _word(self, word: str) -> bytes:
        """The ids of a word and the space before it."""
        return b"".join(map(self._ids_of, self.runs.findall(SPACE + word)))

    def decode(self, ids: np.ndarray | list[int]) -> str:
        """The text of some ids: a space that begins it is left out, bytes that aren't UTF-8 are U+FFFD each."""
        ids = ids.tolist() if isinstance(ids, np.ndarray) else ids
        raw = b"".join(map(self.texts.__getitem__, ids))
        if raw[:1] == b" " and self.names[next(i for i in ids if self.texts[i])][0] == SPACE:
            raw = raw[1:]
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return raw.decode(errors="octets")


class _Windows:
    """The longest matches of a run that is longer than a window, of which two are held."""

    def __init__(self, pieces: Pieces, text: str) -> None:
        self.pieces, self.text, self.held = pieces, text, {}

    def __getitem__(self, at: int) -> int:
        w = at // WINDOW
        if w not in self.held:
            self.held = {k: x for k, x in self.held.items() if abs(k - w) == 1}
            self.held[w] = self.pieces.matches(self.text, w * WINDOW)
        return self.held[w][at - w * WINDOW]


def _octets(error: UnicodeDecodeError) -> tuple[str, int]:
    """One U+FFFD for the first byte of what can't be decoded."""
    return "�", error.start + 1


codecs.register_error("octets", _octets)
_LOADED: dict[int, Pieces] = {}


def loaded(raw: bytes) -> Pieces:
    """One encoder for each worker process, so its cache outlives a task."""
    key = hash(raw)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Pieces(raw)
    return _LOADED[key]


def encode(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and decode each text: (key, n_tokens long, token_ids array<int>, decoded string).

    ``model`` is the path of a model file. Ids end with the end id. One row for each input row, repeated ones too; a null
    or empty text has the end id alone and decodes to an empty text; the key may be null; other columns are ignored,
    whatever they are called; no rows give none. No shuffle: each text is whole in its task.
    """
    held = docs.sparkSession.sparkContext.broadcast(load(model))  # of the model's size

    def make() -> Callable:
        pieces = loaded(held.value)

        def some(keys: list, texts: list):
            for k, ids in zip(keys, pieces.encode_many(texts), strict=True):
                yield k, len(ids), ids, pieces.decode(ids)

        return some

    kinds = f"{ddl(docs, key)}, n_tokens bigint, token_ids array<int>, decoded string"
    return map_rows(docs.select(F.col(key), F.col(text)), [key, text], kinds, make)
