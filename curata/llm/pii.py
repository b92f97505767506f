"""Personal data by anchor expansion: Aho-Corasick finds anchors, local parsers expand and validate each to its boundaries.

Anchors are at-signs, schemes, a plus before a digit, digit-separator-digit triples and identifier cues; the parsers walk left
and right from an anchor over the characters their kind allows. Nothing else in a text is looked at twice.

Base kinds (leftmost, not overlapping within a kind; what fails its test is dropped and not retried): email, ip, card, phone.
The method's own kinds: url (scheme to the last URL character, closing punctuation off), account (an identifier cue, then a
number of 6 to 34 characters holding 4 digits), street (a house number beside a street word) and card_part (within a run of digit
groups that is no card as a whole: one group of 16 to 19 digits, or four of 4, that passes Luhn's test).

Defined cases: a null text counts as empty and has no spans; offsets are code points, end exclusive. Repeated rows give
repeated results; very long texts are scanned whole.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curata.llm import _base

# The base kinds in their order and what they allow.
BASE_KINDS = ("email", "ip", "card", "phone")
DIGITS = frozenset("0123456789")
ALNUM = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
LOCAL = ALNUM | frozenset("._%+-")
LABEL = ALNUM | frozenset("-")
PHONE = DIGITS | frozenset(" ().-")

EXTRA_KINDS = ("account", "card_part", "street", "url")
SCHEMES = ("http://", "https://", "ftp://", "mailto:")
CUES = ("account number", "account no", "acct", "iban", "routing number", "sort code", "passport no", "passport number", "ssn", "tax id", "customer id", "policy number")
STREETS = (" Street", " Avenue", " Road", " Lane", " Boulevard", "straße ", "strasse ", "rue ", "calle ")
URL_STOP = frozenset(" \t\n\r\x0b\x0c\"'<>`{}|\\^")
ACCOUNT = ALNUM | frozenset(" -")

LOCAL_RUN = re.compile(r"[A-Za-z0-9._%+-]*")
DIGIT_RUN = re.compile(r"[0-9]+")
HOUSE_NUMBER = re.compile(r"(?:[^\W\d_]+ ){0,4}?(\d{1,4})\b")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")


def automaton() -> ahocorasick.Automaton:
    """Anchor string -> kind letter: @ email, i ip, c card, + phone, u url, a account, s street."""
    a = ahocorasick.Automaton()
    kinds: dict[str, str] = {"@": "@"}
    for x in "0123456789":
        kinds["+" + x] = "+"
        for y in "0123456789":
            kinds[x + "." + y] = "i"
            for sep in ("", " ", "-"):
                kinds[x + sep + y] = "c"
    kinds |= dict.fromkeys(SCHEMES, "u")
    for cue in CUES:
        kinds |= dict.fromkeys((cue, cue.capitalize(), cue.upper(), cue.title()), "a")
    kinds |= dict.fromkeys(STREETS, "s")
    for key, kind in kinds.items():
        a.add_word(key, (kind, len(key)))
    a.make_automaton()
    return a


def luhn(digits: list[int]) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


class Finder:
    def __init__(self) -> None:
        self.anchors = automaton()

    def email(self, t: str, at: int, least: int) -> tuple[int, int, bool] | None:
        a = at
        while a > least and t[a - 1] in LOCAL:
            a -= 1
        m = DOMAIN.match(t, at + 1) if a < at else None
        return (a, m.end(), True) if m else None

    def ip(self, t: str, at: int, least: int) -> tuple[int, int, bool] | None:
        """at: a dot between digits. Four dotted numbers, from the leftmost number of the run that has three after it."""
        a, n = at, len(t)
        while a > least and t[a - 1] in DIGITS:
            a -= 1
        parts, b = [], a
        for k in range(4):
            c = b
            while c < n and t[c] in DIGITS:
                c += 1
            if c == b:
                return None
            parts.append(t[b:c])
            if k == 3:
                return (a, c, all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts))
            if c >= n or t[c] != ".":
                return None
            b = c + 1
        return None

    def card(self, t: str, at: int, least: int) -> tuple[int, int, bool] | None:
        """at: the first digit of the run (hits come in order, so the first hit of a run is at its start)."""
        b, n, digits = at + 1, len(t), [int(t[at])]
        while b < n:
            if t[b] in DIGITS:
                digits.append(int(t[b]))
                b += 1
            elif t[b] in " -" and b + 1 < n and t[b + 1] in DIGITS:
                digits.append(int(t[b + 1]))
                b += 2
            else:
                break
        return (at, b, 16 <= len(digits) <= 19 and luhn(digits))

    def card_parts(self, t: str, a: int, b: int) -> list[tuple[int, int]]:
        """Cards among the digit groups of t[a:b], left to right, not overlapping."""
        groups = [(m.start(), m.end()) for m in DIGIT_RUN.finditer(t, a, b)]
        out, i = [], 0
        while i < len(groups):
            sizes = [y - x for x, y in groups[i : i + 4]]
            n = 4 if sizes == [4] * 4 else 1 if 16 <= sizes[0] <= 19 else 0
            start, end = groups[i][0], groups[i + n - 1][1]
            if n and luhn([int(ch) for ch in t[start:end] if ch in DIGITS]):
                out.append((start, end))
                i += n
            else:
                i += 1
        return out

    def phone(self, t: str, at: int, least: int) -> tuple[int, int, bool] | None:
        b, n, last, digits = at + 2, len(t), -1, 1
        run = 1
        while b < n and t[b] in PHONE:
            if t[b] in DIGITS:
                run += 1
                if b > at + 2:
                    last, digits = b, run
            b += 1
        return (at, last + 1, 8 <= digits <= 15) if last > 0 else None

    def url(self, t: str, at: int, least: int) -> tuple[int, int, bool] | None:
        b, n = at, len(t)
        while b < n and t[b] not in URL_STOP:
            b += 1
        while b > at and t[b - 1] in ".,;:!?)]":
            b -= 1
        rest = t[at:b].partition(":")[2].lstrip("/")
        return (at, b, len(rest) >= 3)

    def account(self, t: str, at: int, least: int) -> tuple[int, int, bool] | None:
        """at: the end of the cue. Skips up to three of ' :#.=' and reads letters, digits, single spaces and hyphens."""
        n, a = len(t), at
        while a < n and a < at + 3 and t[a] in " :#.=":
            a += 1
        b = a
        while b < n and b - a < 40 and t[b] in ACCOUNT and not (t[b] == " " and (b + 1 >= n or t[b + 1] not in DIGITS)):
            b += 1
        while b > a and t[b - 1] in " -":
            b -= 1
        found = t[a:b]
        return (a, b, 6 <= len(found) <= 34 and sum(c in DIGITS for c in found) >= 4) if b > a else None

    def street(self, t: str, a: int, b: int) -> tuple[int, int, bool] | None:
        """a, b: the street word. '12 Oak Street' has its number up to three words before; 'rue X 12' or 'Xstraße 12' after."""
        if t[a] == " ":
            start, words = a, 0
            while start > 0 and words < 4 and a - start < 60:
                p = start
                while p > 0 and t[p - 1].isalnum():
                    p -= 1
                if p == start:
                    return None
                word, start = t[p:start], p
                if word.isdecimal() and len(word) <= 5:
                    return (p, b, words > 0)
                if not word[0].isupper() or p == 0 or t[p - 1] != " ":
                    return None
                words, start = words + 1, p - 1
            return None
        m = HOUSE_NUMBER.match(t, b)
        start = a
        while start > 0 and t[start - 1].isalnum():
            start -= 1
        return (start, m.end(), True) if m else None

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        """All spans: the base kinds as listed, then the method's kinds by name, each by start."""
        found: dict[str, list[tuple[int, int]]] = {k: [] for k in (*BASE_KINDS, *EXTRA_KINDS)}
        ends = dict.fromkeys(found, 0)
        for last, (letter, size) in self.anchors.iter(text):
            a = last + 1 - size
            if letter == "@":
                kind, hit = "email", self.email(text, a, ends["email"]) if a >= ends["email"] else None
            elif letter == "i":
                # within a match, or a number that the failed part of an earlier run has used up, there is nothing to find
                kind, hit = "ip", self.ip(text, a + 1, ends["ip"]) if a >= ends["ip"] else None
            elif letter == "c":
                kind, hit = "card", self.card(text, a, ends["card"]) if a >= ends["card"] else None
            elif letter == "+":
                kind, hit = "phone", self.phone(text, a, ends["phone"]) if a >= ends["phone"] else None
            elif letter == "u":
                kind, hit = "url", self.url(text, a, ends["url"]) if a >= ends["url"] else None
            elif letter == "a":
                kind, hit = "account", self.account(text, last + 1, ends["account"]) if last + 1 >= ends["account"] else None
            else:
                kind, hit = "street", self.street(text, a, last + 1) if a >= ends["street"] else None
            if hit:
                start, end, good = hit
                if good and start >= ends[kind]:
                    found[kind].append((start, end))
                elif kind == "card" and not good:
                    found["card_part"] += self.card_parts(text, start, end)
                if good or kind in BASE_KINDS:
                    ends[kind] = max(ends[kind], end)
        return [(k, a, b) for k, v in found.items() for a, b in v]

    def __call__(self, text: str | None) -> tuple:
        spans = self.spans(text or "")
        base = [s for s in spans if s[0] in BASE_KINDS]
        join = lambda xs: ",".join(f"{k}:{a}:{b}" for k, a, b in xs)
        return (*(sum(s[0] == k for s in base) for k in BASE_KINDS), hashlib.sha256(join(base).encode()).hexdigest(), join(spans))


class Redactor:
    """A text with every span replaced by its kind in angle brackets; of overlapping spans the earlier start, then the longer, counts."""

    def __init__(self) -> None:
        self.finder = Finder()

    def __call__(self, text: str | None) -> tuple:
        if text is None:
            return (None, None)
        out, at = [], 0
        for kind, a, b in sorted(self.finder.spans(text), key=lambda s: (s[1], -s[2])):
            if a >= at:
                out += [text[at:a], f"<{kind.removesuffix('_part').upper()}>"]
                at = b
            elif b > at:  # the rest of a span that overlaps the one before
                at = b
        redacted = "".join([*out, text[at:]])
        return (redacted, len(redacted))


SCHEMA = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document, with counts, a digest of the base spans and all spans. One pass, no shuffle."""
    return _base.map_texts(docs, Finder, SCHEMA, [id_col], [text_col])


def redact_pii(docs: DataFrame, text_col: str = "text", n_chars_col: str = "n_chars") -> DataFrame:
    """docs with the same columns in the same order, the text redacted and its length in code points set anew (null for a null text)."""
    others = [c for c in docs.columns if c not in (text_col, n_chars_col)]
    out = _base.map_texts(docs, Redactor, f"`{text_col}` string, `{n_chars_col}` long", others, [text_col])
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(_base.read(spark, sf_dir, "documents"))
