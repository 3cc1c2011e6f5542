"""Secret scans: patterns, and a battery of randomness tests with length-aware control of false discoveries.

A candidate is a run of 20 or more characters of the base-64 alphabets. Its encoding is the smallest alphabet that holds
it. A chi-squared test of the alphabet's uniformity, a runs test around the alphabet's middle and a serial-correlation test
are combined by Fisher's method. How unlike text a run is, is told by the logarithm of the likelihood ratio of its encoding
against a letter model of text, less the battery's statistic; the distribution of that difference over text, by length, is
simulated from the letter model, with words in one case and in mixed case, and gives the run's probability. A run that the
battery tells not to be random is text, whatever its letters (a pattern, an alphabet, one letter many times). Over all
documents, and within classes of length, the Benjamini-Hochberg rule then picks the probabilities that keep the share of
false discoveries below a level. The rule needs only a histogram of fixed size.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronlake.llm.common import ddl, map_rows, stored

KINDS = ("assign", "access", "hex", "random")


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(map(_either, ("password", "passwd", "secret", "token"))) + f"|{_either('api')}_?{_either('key')}"
ASSIGN = re.compile(rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")  # a shorter match holds no longer one
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST = 20
RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}")
#: Length classes by their least length, the level of false discoveries, and the least combined p-value of randomness.
CLASSES, LEVEL, LEAST_RANDOM = (20, 32, 64), 0.01, 1e-3
#: Lengths at which the battery is simulated over text, and how often.
LENGTHS, SIMULATED = (20, 26, 32, 44, 64, 96, 160), 400
#: The histogram's bins: quarters of a power of ten.
BINS = 400

LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Alphabets, smallest first.
ENCODINGS = {
    "hex": DIGITS + "abcdef",
    "hex_upper": DIGITS + "ABCDEF",
    "lower": LOWER,
    "upper": UPPER,
    "base32": UPPER + "234567",
    "base36": DIGITS + LOWER,
    "base36_upper": DIGITS + UPPER,
    "letters": LOWER + UPPER,
    "base62": DIGITS + LOWER + UPPER,
    "base64": UPPER + LOWER + DIGITS + "+/",
    "base64url": UPPER + LOWER + DIGITS + "-_",
    "any": UPPER + LOWER + DIGITS + "+/-_",
}
#: Letters of text in thousandths.
LETTERS = dict(
    zip(
        LOWER,
        (82, 17, 30, 40, 130, 21, 20, 50, 72, 3, 8, 42, 25, 68, 72, 19, 3, 62, 65, 90, 32, 12, 18, 4, 18, 3),
        strict=True,
    )
)
_TEXT = {c: 0.93 * n / sum(LETTERS.values()) for c, n in LETTERS.items()}
_TEXT |= {c.upper(): 0.03 * n / sum(LETTERS.values()) for c, n in LETTERS.items()}
_TEXT |= dict.fromkeys(DIGITS, 0.002) | dict.fromkeys("+/-_", 0.005)


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the pattern matches, in that order."""
    if not text:
        return []
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def battery(run: str, left_out: int | None = None) -> tuple[str, float, float]:
    """The encoding, Fisher's statistic of the tests (without the one that is left out), and the logarithm of the likelihood
    ratio of the encoding against text."""
    body = run.rstrip("=")
    chars = set(body)
    name = next((k for k, a in ENCODINGS.items() if chars <= set(a)), "any")
    alphabet = ENCODINGS[name]
    n, m = len(body), len(alphabet)
    codes = np.array([alphabet.index(c) for c in body])
    counts = np.bincount(codes, minlength=m)
    x = float(((counts - n / m) ** 2).sum() * m / n)
    # the statistic's own mean and variance, as counts are small; its tail by Wilson and Hilferty
    mean, var = m - 1, 2 * (m - 1) * (n - 1) / n
    scale, free = var / (2 * mean), 2 * mean * mean / var
    p1 = _normal_tail(((x / scale / free) ** (1 / 3) - (1 - 2 / (9 * free))) / math.sqrt(2 / (9 * free)))
    high = codes >= m / 2
    a, b = int(high.sum()), int(n - high.sum())
    runs = 1 + int((high[1:] != high[:-1]).sum())
    p2 = 1e-6
    if a and b:
        mean = 2 * a * b / n + 1
        var = (mean - 1) * (mean - 2) / max(n - 1, 1)
        p2 = 2 * _normal_tail(max(0.0, abs(runs - mean) - 0.5) / math.sqrt(max(var, 1e-9)))
    d = codes - codes.mean()
    r = float((d[1:] * d[:-1]).sum() / max((d * d).sum(), 1e-9))
    p3 = 2 * _normal_tail(abs(r + 1 / n) * math.sqrt(n))
    half = -sum(math.log(min(1.0, max(p, 1e-12))) for i, p in enumerate((p1, p2, p3)) if i != left_out)
    return name, half, sum(-math.log(m) - math.log(_TEXT[c]) for c in body)


def unlikeness(run: str, left_out: int | None = None) -> float:
    _, half, ratio = battery(run, left_out)
    return ratio - half


@cache
def text_statistics(left_out: int | None = None, seed: int = 17) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of :func:`unlikeness` over runs of text of :data:`LENGTHS`."""
    rng = np.random.default_rng(seed)
    chars, p = np.array(list(_TEXT)), np.array(list(_TEXT.values()))
    found = []
    for n in LENGTHS:
        runs = ["".join(x) for x in rng.choice(chars, (SIMULATED, n), p=p / p.sum())]
        low = [r.lower() for r in runs[: SIMULATED // 2]]
        found.append([unlikeness(r, left_out) for r in low + runs[SIMULATED // 2 :]])
    x = np.array(found)
    return x.mean(1), x.std(1)


def text_probability(run: str, left_out: int | None = None) -> float:
    """Minus the decimal logarithm of the probability that a run is text, times the number of encodings tried."""
    n = len(run.rstrip("="))
    _, half, ratio = battery(run, left_out)
    random = math.exp(-half) * sum(half**i / math.factorial(i) for i in range(3 if left_out is None else 2))
    if random < LEAST_RANDOM:  # by the chi-squared distribution with two degrees of freedom for each test
        return 0.0
    mean, deviation = text_statistics(left_out)
    far = (ratio - half - np.interp(n, LENGTHS, mean)) / np.interp(n, LENGTHS, deviation)
    return max(0.0, -math.log10(max(_normal_tail(float(far)), 1e-300)) - math.log10(len(ENCODINGS)))


def candidates(text: str | None) -> Iterator[tuple[int, int, int, int]]:
    """(start, end, length class, bin of the probability of text) of the runs.

    Runs of digits alone, as numbers are, aren't candidates.
    """
    if not text or len(text) < LEAST or max(map(len, text.split()), default=0) < LEAST:
        return
    for m in RUN.finditer(text):
        if not m[0].rstrip("=").isdigit():
            kind = sum(len(m[0]) >= c for c in CLASSES) - 1
            yield m.start(), m.end(), kind, min(BINS - 1, int(text_probability(m[0]) * 4))


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def thresholds(histogram: dict[tuple[int, int], int]) -> list[int]:
    """For each length class the lowest bin that the Benjamini-Hochberg rule picks; BINS if none.

    A bin counts with the largest p-value that it holds.
    """
    out = []
    for kind in range(len(CLASSES)):
        counts = np.array([histogram.get((kind, b), 0) for b in range(BINS)], float)
        total, above = counts.sum(), counts[::-1].cumsum()[::-1]
        largest = 10.0 ** (-np.arange(BINS) / 4)
        picked = np.flatnonzero((above > 0) & (largest * total <= LEVEL * above))
        out.append(int(picked[0]) if len(picked) else BINS)
    return out


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_assign, n_access, n_hex, base, spans): one row for each input row, over its whole text.

    ``base`` and ``spans`` are kind:start:end in code points, ends exclusive, by start and kind, joined by commas;
    ``spans`` adds the kind random, for runs that no base span overlaps. Null and empty texts have no spans, the key may
    be null, repeated rows stay, other columns are ignored. No shuffle of texts; the driver gets a histogram of at most
    1,200 cells.
    """

    def make() -> Callable:
        def some(keys: list, texts: list):
            for k, t in zip(keys, texts, strict=True):
                base = base_spans(t)
                n = [sum(x[1] == i for x in base) for i in range(3)]
                more = [
                    {"s": a, "e": b, "c": c, "b": p}
                    for a, b, c, p in candidates(t)
                    if not any(a < y and x < b for x, _, y in base)
                ]
                yield (k, *n, joined(base), [{"s": a, "k": i, "e": b} for a, i, b in base], more)

        return some

    found = stored(
        map_rows(
            docs,
            [key, text],
            f"{ddl(docs, key)}, n_assign bigint, n_access bigint, n_hex bigint, base string, "
            "known array<struct<s:int,k:int,e:int>>, runs array<struct<s:int,e:int,c:int,b:int>>",
            make,
        ),
        "secrets",
    )
    cells = found.select(F.explode("runs").alias("r")).groupBy("r.c", "r.b").count().collect()
    cut = thresholds({(r["c"], r["b"]): r["count"] for r in cells})
    least = F.array(*(F.lit(c) for c in cut))
    picked = F.transform(
        F.filter("runs", lambda r: r["b"] >= F.element_at(least, r["c"] + 1)),
        lambda r: F.struct(r["s"].alias("s"), F.lit(3).alias("k"), r["e"].alias("e")),
    )
    names = F.array(*(F.lit(k) for k in KINDS))
    spans = F.transform(
        F.array_sort(F.concat("known", picked)),
        lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string")),
    )
    return found.select(key, "n_assign", "n_access", "n_hex", "base", F.concat_ws(",", spans).alias("spans"))


