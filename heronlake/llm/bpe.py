"""BPE encoding and decoding with a contiguous rank array per word.

A word is a row of parts and, beside it, a row with the ranks of adjacent pairs. The lowest rank is found by a scan, its
boundary is deleted and the two ranks next to it are looked up again. The rows of many words that weren't seen before
lie in one numpy array and go through these steps together. Words over :data:`LONG` parts, for which repeated scans
would take time with the square of their length, use a heap over a linked list instead; both give the same parts.
"""

from __future__ import annotations

import heapq
import json
import re
import sys
import unicodedata
from collections import defaultdict
from collections.abc import Callable
from functools import cache
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronlake.llm.common import ddl, map_rows, release

LONG = 200
#: Chunks (words between white space), and pieces of them, that each of two generations of the caches holds, about.
CACHE = 250_000
#: Chunks whose ids are held in one table, where only ids are needed.
TABLE = 1_100_000
#: Cells of the rank arrays that are merged together.
CELLS = 400_000
SHIFT = 20
NONE = 2**31 - 1
#: Unicode's White_Space; str.split() also takes U+001C to U+001F.
SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")
ODD_SPACE = "\x1c\x1d\x1e\x1f"
#: Upper-case letters that the library's lower-casing knows and Unicode 15.1 doesn't, as (first, last, first
#: lower-case letter).
LATER_CASE = (
    (0x1C89, 0x1C89, 0x1C8A), (0xA7CB, 0xA7CB, 0x0264), (0xA7CC, 0xA7CC, 0xA7CD), (0xA7CE, 0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2, 0xA7D3),
    (0xA7D4, 0xA7D4, 0xA7D5), (0xA7DA, 0xA7DA, 0xA7DB), (0xA7DC, 0xA7DC, 0x019B), (0x10D50, 0x10D65, 0x10D70), (0x16EA0, 0x16EB8, 0x16EBB),
)
#: Code points that normalise by Unicode 15.1, and not by the older tables of the library: marks that it takes
#: for characters without a combining class, and the second half of a pair that it doesn't compose.
LATER_MARKS = (
    (0x07FD, 0x07FD), (0x0898, 0x089F), (0x08CA, 0x08D3), (0x0C3C, 0x0C3C), (0x0D3B, 0x0D3C), (0x0EBA, 0x0EBA), (0x1715, 0x1715),
    (0x1ABF, 0x1ACE), (0x1DF6, 0x1DFA), (0xA82C, 0xA82C), (0x10EAB, 0x10EAC), (0x10EFD, 0x10EFF), (0x10F46, 0x10F50), (0x10F82, 0x10F85),
    (0x11070, 0x11070), (0x1133B, 0x1133B), (0x1145E, 0x1145E), (0x11839, 0x1183A), (0x11930, 0x11930), (0x1193D, 0x1193E), (0x11943, 0x11943),
    (0x119E0, 0x119E0), (0x11A34, 0x11A34), (0x11A47, 0x11A47), (0x11A99, 0x11A99), (0x11D42, 0x11D42), (0x11D44, 0x11D45),
    (0x11D97, 0x11D97), (0x11F41, 0x11F42), (0x16FF0, 0x16FF1), (0x1E08F, 0x1E08F), (0x1E130, 0x1E136), (0x1E2AE, 0x1E2AE), (0x1E2EC, 0x1E2EF), (0x1E4EC, 0x1E4EF),
)
#: Letters and numbers of Unicode 16, which the library's split knows, beside those of 15.1.
LATER = {
    "L": (
        (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
        (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1),
        (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF),
        (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
    ),
    "N": ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)),
}
_LATER_MARK = re.compile("([" + "".join(f"{chr(a)}-{chr(b)}" for a, b in LATER_MARKS) + "])")
_LATER_CASE = {a + i: to + i for a, b, to in LATER_CASE for i in range(b - a + 1)}
_NEEDS_CASE = re.compile("[" + "".join(map(chr, _LATER_CASE)) + "]")


@cache
def ranges(major: str) -> str:
    """The code points of a major category in Unicode 16, whose classes the library's split has, as a character class."""
    inside = np.zeros(sys.maxunicode + 3, np.int8)
    inside[1:-1] = [unicodedata.category(chr(c))[0] == major for c in range(sys.maxunicode + 1)]
    for a, b in LATER[major]:
        inside[a + 1 : b + 2] = 1
    edges = np.flatnonzero(np.diff(inside)).reshape(-1, 2).tolist()
    return "".join(f"{chr(a)}-{chr(b - 1)}" for a, b in edges)


def byte_glyphs() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    extra = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(extra)) for b in range(256)]


class Memory:
    """A cache of two generations: when the young one is full it becomes the old one, so memory is bounded."""

    def __init__(self) -> None:
        self.new: dict = {}
        self.old: dict = {}

    def missing(self, keys: set[str]) -> list[str]:
        """The keys that aren't known; the others are in the young generation from now on."""
        if len(self.new) > CACHE:
            self.old, self.new = self.new, {}
        new, old, out = self.new, self.old, []
        for k in keys:
            if k not in new:
                if (value := old.get(k)) is not None:
                    new[k] = value
                else:
                    out.append(k)
        return out


class WordBpe:
    """The tokenizer that a ``tokenizers`` JSON file of this kind describes.

    It covers files with NFC, white space and lower-case normalisers, a split pattern, byte-level pieces, word-end
    suffixes and no decoder; anything else is refused. The library uses three versions of Unicode: 16 for the split, an older
    one for NFC and a later one for lower case. What they have beside Python's own (15.1) are the tables above.
    """

    def __init__(self, text: str | bytes, plain: bool = False) -> None:
        """plain: names of special tokens inside a text are ordinary text, and decoded texts aren't needed."""
        spec = json.loads(text)
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if kinds != ["NFC", "Replace", "Lowercase"] or spec.get("decoder") or spec["model"]["type"] != "BPE":
            raise ValueError("this tokenizer file has parts that WordBpe doesn't know")
        model = spec["model"]
        suffix = model["end_of_word_suffix"] or ""
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        # chunks hold no white space, but a line feed between two of them
        for name, members in ((r"\p{L}", ranges("L")), (r"\p{N}", ranges("N")), (r"\s", r"\n")):
            pattern = pattern.replace(name, members)
        self.pieces = re.compile(pattern + r"|\n")
        vocab = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = [""] * (1 + max([*vocab.values(), *self.special.values()]))
        for name, i in (*vocab.items(), *self.special.items()):
            self.names[i] = name
        glyphs = byte_glyphs()
        self.first = np.array([vocab[g] for g in glyphs])
        self.last = np.array([vocab[g + suffix] for g in glyphs])
        ranks: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            x, y = pair if isinstance(pair, list) else pair.split(" ")
            ranks.setdefault(vocab[x] << SHIFT | vocab[y], (rank, vocab[x + y]))
        self.rank_of = {k: r for k, (r, _) in ranks.items()}
        self.made = np.zeros(len(model["merges"]), np.int64)
        for r, i in ranks.values():
            self.made[r] = i
        self.pairs = np.array(sorted(ranks), np.int64)
        self.pair_ranks = np.array([self.rank_of[k] for k in self.pairs.tolist()], np.int32)
        self.plain = plain
        self.end = max(self.special.values(), default=len(self.names) - 1)
        self.stops = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or "(?!)")
        self.chunks, self.words = Memory(), Memory()
        self._new_table()

    def _new_table(self) -> None:
        self.numbers: defaultdict[str, int] = defaultdict()
        self.numbers.default_factory = self.numbers.__len__
        self.table, self.bounds = np.zeros(0, "<u4"), np.zeros(1, np.int32)

    def _ranks(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The rank of each pair; NONE where the pair can't merge or an end is padding (below 0)."""
        key = x << SHIFT | y
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where((self.pairs[at] == key) & (x >= 0) & (y >= 0), self.pair_ranks[at], NONE)

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each word. Words of like length go through the rank arrays together, a row for each word."""
        out: list[np.ndarray] = [np.zeros(0, "<u4")] * len(words)
        sizes = np.array([len(w) for w in words])
        order = np.argsort(sizes, kind="stable")
        at = int(np.searchsorted(sizes[order], 1))
        while at < len(order):
            longest = sizes[order[at]]
            if longest > LONG:
                for k in order[at:]:
                    out[k] = self._merge_long(words[k])
                break
            most = max(1, CELLS // max(int(longest) + 2, 1))
            end = min(at + most, int(np.searchsorted(sizes[order], longest + 2, side="right")))
            end = min(end, int(np.searchsorted(sizes[order], LONG, side="right")))
            self._merge_rows(words, order[at:end], sizes, out)
            at = end
        return out

    def _merge_rows(self, words: list[bytes], rows: np.ndarray, sizes: np.ndarray, out: list[np.ndarray]) -> None:
        n, width = sizes[rows], int(sizes[rows].max())
        raw = np.frombuffer(b"".join(words[k].ljust(width, b"\0") for k in rows), np.uint8).reshape(len(rows), width)
        col = np.arange(width)
        parts = np.where(col < n[:, None], self.first[raw], -1)
        parts[np.arange(len(rows)), n - 1] = self.last[raw[np.arange(len(rows)), n - 1]]
        ranks = np.full((len(rows), width), NONE, np.int32)  # the last column has no right neighbour
        ranks[:, :-1] = self._ranks(parts[:, :-1], parts[:, 1:])
        while True:
            low = ranks.argmin(axis=1)
            best = ranks[np.arange(len(rows)), low]
            if (done := best == NONE).any():
                whole = parts[done]
                mask = whole >= 0
                ids, ends = whole[mask].astype("<u4"), mask.sum(axis=1).cumsum().tolist()
                for k, x, y in zip(rows[done].tolist(), [0, *ends], ends, strict=False):
                    out[k] = ids[x:y]
                if done.all():
                    return
                rows, parts, ranks, low, best = (x[~done] for x in (rows, parts, ranks, low, best))
            each = np.arange(len(rows))
            parts[each, low] = self.made[best]
            col = np.arange(parts.shape[1] - 1)
            parts = np.take_along_axis(parts, col + (col > low[:, None]), 1)
            ranks = np.take_along_axis(ranks, col + (col >= low[:, None]), 1)
            mid = parts[each, low]
            right = np.where(low + 1 < parts.shape[1], parts[each, np.minimum(low + 1, parts.shape[1] - 1)], -1)
            ranks[each, low] = self._ranks(mid, right)
            left = np.flatnonzero(low > 0)
            ranks[left, low[left] - 1] = self._ranks(parts[left, low[left] - 1], mid[left])

    def _merge_long(self, word: bytes) -> np.ndarray:
        parts = [*self.first[list(word[:-1])].tolist(), int(self.last[word[-1]])]
        n, get = len(parts), self.rank_of.get
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i) for i in range(n - 1) if (r := get(parts[i] << SHIFT | parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or get(parts[i] << SHIFT | parts[j]) != rank:
                continue
            parts[i], alive[j], after[i] = int(self.made[rank]), False, after[j]
            if after[j] < n:
                before[after[j]] = i
            for x in (before[i], i):
                if x >= 0 and (y := after[x]) < n and (r := get(parts[x] << SHIFT | parts[y])) is not None:
                    heapq.heappush(heap, (r, x))
        return np.array([p for p, a in zip(parts, alive, strict=True) if a], "<u4")

    def _pieces(self, chunks: list[str]) -> dict[str, list[str]]:
        """The pieces of chunks; those of letters alone are one piece and left out."""
        several = [c for c in chunks if not (c.isascii() and c.isalpha())]
        split: dict[str, list[str]] = {}
        if several:
            parts: list[str] = []
            at = iter(several)
            for piece in self.pieces.findall("\n".join(several)):
                if piece == "\n":
                    split[next(at)] = parts
                    parts = []
                else:
                    parts.append(piece)
            split[next(at)] = parts
        words = {w for x in split.values() for w in x}
        words.update(c for c in chunks if c not in split)
        if unknown := self.words.missing(words):
            merged, names = self.merge([w.encode() for w in unknown]), self.names
            if self.plain:
                self.words.new.update(zip(unknown, [i.tobytes() for i in merged], strict=True))
            else:
                values = [(i.tobytes(), " ".join([names[k] for k in i.tolist()])) for i in merged]
                self.words.new.update(zip(unknown, values, strict=True))
        return split

    def learn(self, chunks: set[str]) -> None:
        """Put the ids and the decoded text of words between white space in the cache."""
        new = self.chunks.missing(chunks)
        split, known, values = self._pieces(new) if new else {}, self.chunks.new, self.words.new
        for c in new:
            x = split.get(c)
            if x is None or len(x) == 1:
                known[c] = values[x[0] if x else c]
            else:
                known[c] = b"".join([values[w][0] for w in x]), " ".join([values[w][1] for w in x])

    def encode_flat(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each has; special tokens aren't looked for. With plain=True.

        Chunks are numbered; a table holds the ids of each, which are gathered for all texts at once.
        """
        if len(self.numbers) > TABLE:
            self._new_table()
        known, get, parts, sizes = len(self.numbers), self.numbers.__getitem__, [], []
        for t in texts:
            chunks = self._chunks(t) if t else []
            parts.append(np.fromiter(map(get, chunks), np.int32, len(chunks)))
            sizes.append(len(chunks))
        if len(self.numbers) > known:
            new = list(islice(self.numbers, known, None))
            split, values = self._pieces(new), self.words.new
            found = [values[c] if (x := split.get(c)) is None else values[x[0]] if len(x) == 1 else b"".join([values[w] for w in x]) for c in new]
            self.table = np.concatenate([self.table, np.frombuffer(b"".join(found), "<u4")])
            ends = np.cumsum([len(x) // 4 for x in found], dtype=np.int32)
            self.bounds = np.concatenate([self.bounds, self.bounds[-1] + ends])
        of = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        first, many = self.bounds[of], self.bounds[of + 1] - self.bounds[of]
        before = np.zeros(len(of) + 1, np.int64)
        np.cumsum(many, out=before[1:])
        kind = np.int32 if before[-1] < 1 << 31 else np.int64  # half as much to move
        ids = self.table[np.repeat((first - before[:-1]).astype(kind), many) + np.arange(before[-1], dtype=kind)]
        cuts = before[np.concatenate([[0], np.cumsum(np.array(sizes, np.int64))])]
        return ids, np.diff(cuts)

    def encode_many(self, texts: list[str | None]) -> list[tuple[bytes, str]]:
        """Of each text its ids as little-endian unsigned 32-bit integers and its decoded text: the tokens' names, by spaces."""
        cut: list[list[list[str] | str]] = []
        for t in texts:
            parts: list[list[str] | str] = []
            at = 0
            if t and "<|" in t:
                for m in self.stops.finditer(t):
                    parts += [self._chunks(t[at : m.start()]), m[0]]
                    at = m.end()
            if t:
                parts.append(self._chunks(t[at:]))
            cut.append(parts)
        seen: set[str] = set()
        for parts in cut:
            for p in parts:
                if not isinstance(p, str):
                    seen.update(p)
        self.learn(seen)
        out = []
        for parts in cut:
            found: list[tuple[bytes, str]] = []
            for p in parts:
                if isinstance(p, str):
                    found.append((self.special[p].to_bytes(4, "little"), p))
                else:
                    found += map(self.chunks.new.__getitem__, p)
            out.append((b"".join([x for x, _ in found]), " ".join([y for x, y in found if x])))
        return out

    def encode_ids(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers; see :meth:`encode_flat`."""
        ids, sizes = self.encode_flat(texts)
        ends = np.cumsum(sizes).tolist()
        return [ids[a:b].tobytes() for a, b in zip([0, *ends], ends, strict=False)]

    def _chunks(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")  # such a text is in NFC, and nothing in it is special
            text = text.lower()
        except UnicodeEncodeError:
            text = lower(nfc(text))
        return [c for c in SPACE.split(text) if c] if any(c in text for c in ODD_SPACE) else text.split()

    def encode(self, text: str | None) -> tuple[bytes, str]:
        return self.encode_many([text])[0]

    def ids(self, text: str | None) -> np.ndarray:
        return np.frombuffer(self.encode(text)[0], "<u4")

    def decode(self, ids: list[int] | np.ndarray) -> str:
        return " ".join([self.names[i] for i in ids])


def lower(text: str) -> str:
    """Lower case character by character: a final sigma isn't told apart."""
    text = text.replace("Σ", "σ") if "Σ" in text else text
    return (text.translate(_LATER_CASE) if _NEEDS_CASE.search(text) else text).lower()


def nfc(text: str) -> str:
    """NFC by the library's tables: nothing is reordered or composed across what they don't know."""
    if _LATER_MARK.search(text):
        return "".join([unicodedata.normalize("NFC", x) if i % 2 == 0 else x for i, x in enumerate(_LATER_MARK.split(text))])
    return text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)


def load(path: str) -> bytes:
    """The vocabulary file, for a broadcast: its size is that of the vocabulary, not of the data."""
    with open(path, "rb") as f:
        return f.read()


_LOADED: dict[tuple[int, bool], WordBpe] = {}


def loaded(raw: bytes, plain: bool = False) -> WordBpe:
    """One tokenizer for each worker process, so its cache outlives a task."""
    key = hash(raw), plain
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = WordBpe(raw, plain)
    return _LOADED[key]


def forget() -> None:
    """Drop a worker's tokenizer and its caches, where no later task needs them."""
    _LOADED.clear()
    release()


def encode(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and decode each text: (key, n_tokens long, token_ids binary, decoded string).

    ``vocabulary`` is the path of a tokenizer file. token_ids holds little-endian unsigned 32-bit integers. One row for
    each input row, repeated ones too; a null or empty text has no tokens and decodes to an empty text; the key may be
    null; other columns are ignored, whatever they are called. No shuffle: each text is whole in its task.
    """
    held = docs.sparkSession.sparkContext.broadcast(load(vocabulary))

    def make() -> Callable:
        bpe = loaded(held.value)

        def some(keys: list, texts: list):
            for k, (ids, decoded) in zip(keys, bpe.encode_many(texts), strict=True):
                yield k, len(ids) // 4, ids, decoded

        return some

    return map_rows(
        docs.select(F.col(key), F.col(text)),
        [key, text],
        f"{ddl(docs, key)}, n_tokens bigint, token_ids binary, decoded string",
        make,
    )
