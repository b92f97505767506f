"""Secret scan: fixed credential patterns, and character Markov models of random strings against ordinary ones.

Base kinds (leftmost, not overlapping within a kind; what is too short is dropped and not retried): assign, access, hex.

The method's kind is random. Candidates are maximal runs of 16 or more of ``ALPHABET``. For each kind of random string (base64, base62,
letters, base36, ...) a first-order model is trained, and one of second order for ordinary strings: identifiers, paths, dates, numbers, words of a dozen
languages, genes, and strings that follow a rule (runs of a character, rows of the keyboard). Both from ``secret_samples.tsv``, labelled samples, and both drawn to the lower order where they saw little. A character's score is the logarithm of
the ratio of the two likelihoods. Within a candidate the segments of the highest sum count (a segment ends where the sum falls ``DROP`` below its best), so a
name before ``=`` or a path before a key cannot hide it; a segment with a sum of ``THRESHOLD`` nats, for any random kind, is a secret. Its span is widened to the
next ``=`` or ``/`` on either side, and counts from 16 characters on. Nothing but the ratio decides: numbers are no kind of random
string, as those of dates, books and accounts are no less even, so digits alone are not found by it (the base kind hex has them).

Defined cases: a null text counts as empty and has no spans; spans are whole matches in code points, end exclusive. Repeated rows give
repeated results; very long texts and runs are scanned whole.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import re
from importlib import resources

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from curata.llm import _base

# The base kinds in their order, their patterns and lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex")

SHORTEST = 16
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
THRESHOLD = 17.0
DROP = 6.0
#: Observations that weigh as much as the lower order's estimate.
TRUST = 100.0
N = len(ALPHABET)
CODE = {c: i for i, c in enumerate(ALPHABET)}


@functools.lru_cache(maxsize=1)
def labelled_samples() -> dict[str, dict[str, list[str]]]:
    """label -> kind -> strings, from the file beside this module; characters outside the alphabet end a string."""
    out: dict[str, dict[str, list[str]]] = {}
    for line in (resources.files("curata.llm") / "secret_samples.tsv").read_text(encoding="utf-8").splitlines():
        if not line.startswith("#"):
            label, kind, text = line.split("\t")
            out.setdefault(label, {}).setdefault(kind, []).extend(p for w in text.split() for p in re.findall(r"[A-Za-z0-9+/_=-]+", w))
    return out


#: Lists of words in the file, and rows that are typed or counted along.
WORDS = ("words", "english", "german", "french", "spanish", "polish", "dutch", "welsh", "italian", "portuguese", "swedish", "turkish", "hungarian")
ROWS = ("abcdefghijklmnopqrstuvwxyz", "0123456789", "qwertyuiop", "asdfghjkl", "zxcvbnm", "qwertzuiop", "azertyuiop", "0123456789abcdef")


def patterned() -> list[str]:
    """Ordinary strings that follow a rule: runs of one character, short runs, two characters in turn, genes, rows of the keyboard and the alphabet, both ways."""
    letters = [c for c in ALPHABET if c.isalnum()]
    out = [c * 40 for c in ALPHABET] + [(c + c.swapcase()) * 12 for c in letters if c.isalpha()]
    out += ["".join(x) * 4 for bases in ("ACGT", "acgt") for x in itertools.permutations(map("".join, itertools.product(bases, repeat=2)), 2)]
    for step in (1, 3, 5, 7, 11, 17):  # the neighbours of a run change
        turned = [letters[i * step % len(letters)] for i in range(len(letters))]
        out += [mark.join(c * n for c in turned) for n in (2, 3, 4, 5) for mark in ("", "/", "_", "-")]
        out += [(a + b) * 12 for a, b in zip(turned, turned[1:], strict=False)]
    return out + [x * 3 for row in ROWS for r in (row, row.upper()) for x in (r, r[::-1])] * 12


def spellings(kinds: dict[str, list[str]]) -> list[str]:
    """Ordinary strings as they are, and words joined by the usual ways of writing names, so that each joint is seen: each word before three others of its list."""
    out = [s for strings in kinds.values() for s in strings] + patterned()
    for kind in WORDS:
        words = kinds[kind]
        out += words + [w.lower() for w in words] + [w.upper() for w in words]
        for i, (a, b) in enumerate((w, words[(j + step) % len(words)]) for step in (1, 7, 31) for j, w in enumerate(words)):
            a, b = a.lower(), b.lower()
            out += [f"{a}_{b}", f"{a}-{b}", a + b, a + b.capitalize(), a.capitalize() + b.capitalize(), f"{a.upper()}_{b.upper()}", f"{a}/{b}", f"{a}={b}", f"{a}{i}", f"{a}_{i}/{b}-{1900 + i}"]
    return out


def chain(samples: list[str], order: int) -> np.ndarray:
    """log P(character | up to two before): N + 1 by N + 1 by N, index N the start; each order drawn to the one below by TRUST."""
    seen = np.zeros((N + 1, N + 1, N))
    for s in samples:
        a = b = N
        for c in map(CODE.__getitem__, s):
            seen[a, b, c] += 1
            a, b = b, c
    level = (seen.sum(axis=(0, 1)) + 0.05) / (seen.sum() + 0.05 * N)
    level = np.broadcast_to(level, seen.shape)
    for counts in [seen.sum(axis=0, keepdims=True), seen][:order]:
        level = (counts + TRUST * level) / (counts.sum(axis=2, keepdims=True) + TRUST)
    return np.log(level)


def ratio_tables() -> dict[str, np.ndarray]:
    """For each random kind log P(random) - log P(ordinary) by the two characters before and the character."""
    samples = labelled_samples()
    ordinary = chain(spellings(samples["ordinary"]), 2)
    return {kind: (chain(strings, 1) - ordinary).astype(np.float32) for kind, strings in samples["random"].items()}


class Scanner:
    def __init__(self, tables: dict[str, np.ndarray], threshold: float = THRESHOLD) -> None:
        self.tables, self.threshold = [t.reshape(-1, N) for t in tables.values()], threshold

    def segments(self, scores: list[float]) -> list[tuple[float, int, int]]:
        """(sum, start, end) of the segments that reach the threshold."""
        out, total, start, best, end = [], 0.0, 0, 0.0, 0
        for i, x in enumerate([*scores, float("-inf")]):
            total += x
            if total <= 0 or total < best - DROP:
                if best >= self.threshold:
                    out.append((best, start, end))
                total, start, best, end = 0.0, i + 1, 0.0, i + 1
            elif total > best:
                best, end = total, i + 1
        return out

    def random_parts(self, token: str) -> list[tuple[int, int]]:
        """Spans of a candidate that look random, widened, in order, not overlapping: the higher sum first."""
        codes = np.fromiter(map(CODE.__getitem__, token), np.int64, len(token))
        one = np.concatenate([[N], codes[:-1]])
        two = np.concatenate([[N], one[:-1]])
        found = [s for t in self.tables for s in self.segments(t[two * (N + 1) + one, codes].tolist())]
        out: list[tuple[int, int]] = []
        for _, a, b in sorted(found, key=lambda s: (-s[0], s[1])):
            while a and token[a - 1] not in "=/":
                a -= 1
            while b < len(token) and token[b] not in "=/":
                b += 1
            while a < b and token[a] in "=/":
                a += 1
            while a < b and token[b - 1] in "=/":
                b -= 1
            if b - a >= SHORTEST and all(b <= x or y <= a for x, y in out):
                out.append((a, b))
        return sorted(out)

    def base_spans(self, t: str) -> list[tuple[int, int, str]]:
        out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(t) if m.end(2) - m.start(2) >= 12] if (":" in t or "=" in t) else []
        if "AKIA" in t:
            out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(t) if m.end() - m.start() >= 18]
        out += [(m.start(), m.end(), "hex") for m in HEX.finditer(t)]
        return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))

    def random_spans(self, t: str) -> list[tuple[int, int, str]]:
        return [(m.start() + a, m.start() + b, "random") for m in CANDIDATE.finditer(t) for a, b in self.random_parts(m.group())]

    def __call__(self, text: str | None) -> tuple:
        t = text or ""
        base = self.base_spans(t)
        every = sorted(base + self.random_spans(t), key=lambda s: (s[0], (*KINDS, "random").index(s[2])))
        join = lambda xs: ",".join(f"{k}:{a}:{b}" for a, b, k in xs)
        return (*(sum(s[2] == k for s in base) for k in KINDS), hashlib.sha256(join(base).encode()).hexdigest(), join(every))


SCHEMA = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row for each document, with counts, a digest of the base spans and all spans. One pass, no shuffle; the trained tables (some 10 MB, of a fixed size) travel with the task."""
    tables = ratio_tables()
    return _base.map_texts(docs, lambda: Scanner(tables, threshold), SCHEMA, [id_col], [text_col])


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(_base.read(spark, sf_dir, "documents"))
