"""Licence scan: ordered signature rules behind a keyword prefilter.

A rule is a regex with a label, a priority and a confidence. Most are written by hand, one for each clause or name, in ``license_signatures.tsv``; the others are
versioned names, tags and addresses from the tables below. A text is lower-cased (A-Z) once; a rule's regex runs only if the words of
one of its keywords occur (one of four bytes or fewer at the start of a word, as in gplv2; every match of every rule holds a keyword of its own so). Overlapping detections are resolved: one that lies within a detection of higher priority (or of
equal priority that is longer, or as long and earlier in rule order) is suppressed. A gap in a signature is 1 to ``GAP`` bytes between words. The base phrases are reported at every place, and their labels are never
suppressed.

Defined cases: a null or empty text has 0 words, no places, empty labels and score 0. Repeated rows give repeated results.
Very long texts are scanned whole.
"""

from __future__ import annotations

import bisect
import functools
import re
from dataclasses import dataclass
from importlib import resources

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame, SparkSession

from curata.llm import _base

# The base phrases and their labels.
BASE = [
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
]

#: Separators between words, and the test that a word ends or starts, over UTF-8 bytes with A-Z lower-cased.
SEP = rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]+"
LEFT, RIGHT = rb"(?<![0-9a-z\x80-\xff])", rb"(?![0-9a-z\x80-\xff])"

# Licence families: label, name as words (regex, spaces stand for separators), versions, keyword.
FAMILIES = [
    ("gpl", "gnu general public licen[cs]e|gnu gpl|gpl", ("1", "2", "3"), ("gpl", "general public")),
    ("lgpl", "gnu lesser general public licen[cs]e|gnu library general public licen[cs]e|lgpl", ("2", "2.1", "3"), ("lgpl", "lesser general", "library general")),
    ("agpl", "gnu affero general public licen[cs]e|affero gpl|agpl", ("1", "3"), ("agpl", "affero")),
    ("gfdl", "gnu free documentation licen[cs]e|gfdl", ("1.1", "1.2", "1.3"), ("gfdl", "free documentation")),
    ("apache", "apache software licen[cs]e|apache licen[cs]e|apache", ("1.0", "1.1", "2", "2.0"), ("apache",)),
    ("mpl", "mozilla public licen[cs]e|mpl", ("1.0", "1.1", "2.0"), ("mozilla", "mpl")),
    ("epl", "eclipse public licen[cs]e|epl", ("1.0", "2.0"), ("eclipse", "epl")),
    ("cddl", "common development and distribution licen[cs]e|cddl", ("1.0", "1.1"), ("cddl", "common development")),
    ("cpl", "common public licen[cs]e", ("1.0",), ("common public",)),
    ("eupl", "european union public licen[cs]e|eupl", ("1.0", "1.1", "1.2"), ("eupl", "european union public")),
    ("osl", "open software licen[cs]e", ("1.0", "2.0", "2.1", "3.0"), ("open software",)),
    ("afl", "academic free licen[cs]e", ("1.1", "1.2", "2.0", "2.1", "3.0"), ("academic free",)),
    ("artistic", "artistic licen[cs]e|perl artistic licen[cs]e", ("1.0", "2.0"), ("artistic",)),
    ("boost", "boost software licen[cs]e", ("1.0",), ("boost",)),
    ("busl", "business source licen[cs]e|busl", ("1.0", "1.1"), ("business source", "busl")),
    ("zpl", "zope public licen[cs]e", ("1.1", "2.0", "2.1"), ("zope",)),
    ("python", "python software foundation licen[cs]e|psf licen[cs]e", ("2",), ("python", "psf")),
    ("php", "php licen[cs]e", ("3.0", "3.01"), ("php",)),
    ("lppl", "latex project public licen[cs]e|lppl", ("1.0", "1.1", "1.2", "1.3c"), ("latex", "lppl")),
    ("ofl", "sil open font licen[cs]e|open font licen[cs]e", ("1.0", "1.1"), ("open font",)),
    ("odbl", "open database licen[cs]e|odbl", ("1.0",), ("open database", "odbl")),
    ("odc-by", "open data commons attribution licen[cs]e", ("1.0",), ("open data commons",)),
    ("cecill", "cecill", ("1.0", "1.1", "2.0", "2.1"), ("cecill",)),
    ("ms-pl", "microsoft public licen[cs]e|ms pl", (), ("microsoft public", "ms-pl")),
    ("ms-rl", "microsoft reciprocal licen[cs]e|ms rl", (), ("microsoft reciprocal", "ms-rl")),
    ("mit", "mit licen[cs]e|expat licen[cs]e", (), ("mit", "expat")),
    ("isc", "isc licen[cs]e", (), ("isc",)),
    ("zlib", "zlib licen[cs]e|zlib libpng licen[cs]e", (), ("zlib",)),
    ("unlicense", "the unlicense", (), ("unlicense",)),
    ("wtfpl", "wtfpl|do what the fuck you want to public licen[cs]e", ("1", "2"), ("wtfpl", "do what the fuck")),
    ("bsd", "bsd licen[cs]e|bsd style licen[cs]e|berkeley software distribution licen[cs]e", (), ("bsd", "berkeley")),
    ("bsd-2", "simplified bsd licen[cs]e|freebsd licen[cs]e|2 clause bsd licen[cs]e|two clause bsd licen[cs]e|bsd 2 clause", (), ("bsd", "freebsd")),
    ("bsd-3", "new bsd licen[cs]e|modified bsd licen[cs]e|revised bsd licen[cs]e|3 clause bsd licen[cs]e|three clause bsd licen[cs]e|bsd 3 clause", (), ("bsd",)),
    ("bsd-4", "original bsd licen[cs]e|4 clause bsd licen[cs]e|bsd 4 clause", (), ("bsd",)),
    ("qpl", "q public licen[cs]e", ("1.0",), ("q public",)),
    ("ipl", "ibm public licen[cs]e", ("1.0",), ("ibm public",)),
    ("upl", "universal permissive licen[cs]e", ("1.0",), ("universal permissive",)),
    ("ncsa", "university of illinois open source licen[cs]e|ncsa open source licen[cs]e", (), ("illinois", "ncsa")),
    ("blue-oak", "blue oak model licen[cs]e", ("1.0.0",), ("blue oak",)),
    ("mulan", "mulan permissive software licen[cs]e|mulan psl", ("1", "2"), ("mulan",)),
    ("openssl", "openssl licen[cs]e", (), ("openssl",)),
    ("w3c", "w3c software notice and licen[cs]e|w3c licen[cs]e", (), ("w3c",)),
    ("rail", "open rail m|openrail|creativeml open rail m|responsible ai licen[cs]e", (), ("rail", "openrail", "responsible ai")),
]

# Creative Commons parts: label suffix, spelled-out name.
CC_PARTS = [
    ("by", "attribution"),
    ("by-sa", "attribution share ?alike"),
    ("by-nd", "attribution no ?deriv(?:ative)?s?(?: works)?"),
    ("by-nc", "attribution non ?commercial"),
    ("by-nc-sa", "attribution non ?commercial share ?alike"),
    ("by-nc-nd", "attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?"),
]
CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")

# Families whose short names say too little alone: the names that count without a version or "licensed under".
LONG_NAMES = {"apache": "", "gpl": "gnu general public licen[cs]e|gnu gpl", "lgpl": "gnu lesser general public licen[cs]e|gnu library general public licen[cs]e"}

# SPDX identifiers that are not a label with a version: label, identifier as words.
TAGS = [
    ("boost-1", "bsl 1.0"), ("busl-1.1", "bsl 1.1"), ("0bsd", "0bsd"), ("mit-0", "mit 0"), ("bsd-1", "bsd 1 clause"), ("bsd-2", "bsd 2 clause"), ("bsd-3", "bsd 3 clause"), ("bsd-4", "bsd 4 clause"), ("cc0", "cc0 1.0"),
    ("python-2", "psf 2.0"), ("ncsa", "ncsa"), ("x11", "x11"), ("postgresql", "postgresql"), ("elastic-2", "elastic 2.0"), ("sspl-1", "sspl 1.0"), ("hpnd", "hpnd"), ("ftl", "ftl"), ("vim", "vim"), ("curl", "curl"),
]

GAP = 80
#: Priority and confidence of a signature by its weight.
WEIGHTS = {"clause": (65, 0.8), "name": (55, 0.8), "weak": (30, 0.8)}


@functools.lru_cache(maxsize=1)
def signatures() -> list[tuple[str, str, str, str]]:
    """(label, keyword, weight, phrase) of each line of the file beside this module."""
    lines = (resources.files("curata.llm") / "license_signatures.tsv").read_text(encoding="utf-8").splitlines()
    return [tuple(x.split("\t")) for x in lines if not x.startswith("#")]


@dataclass(frozen=True)
class Rule:
    label: str
    pattern: re.Pattern[bytes]
    keywords: tuple[bytes, ...]
    priority: int
    confidence: float


def _words(phrase: str) -> bytes:
    parts = re.split(r"( \?| \* | )", phrase)
    return b"".join({" ?": SEP.replace(b"]+", b"]*"), " * ": RIGHT + b".{1,%d}?" % GAP + LEFT, " ": SEP}.get(x, x.encode()) for x in parts)


def _rule(label: str, phrase: bytes, keywords: tuple[str, ...], priority: int, confidence: float) -> Rule:
    return Rule(label, re.compile(LEFT + b"(?:" + phrase + b")" + RIGHT, re.DOTALL), tuple(k.encode() for k in keywords), priority, confidence)


def rules(written: list[tuple[str, str, str, str]]) -> list[Rule]:
    """The ordered rules: SPDX tags, versioned and bare names, Creative Commons parts and addresses, signatures."""
    out: list[Rule] = []
    version = lambda v: rb"(?:" + SEP + rb"(?:version|v))?" + SEP.replace(b"]+", b"]*") + rb"v?" + re.escape(v.encode()) + rb"(?:\.0)?"
    spdx = rb"spdx" + SEP + rb"licen[cs]e" + SEP + rb"identifier" + SEP
    field = rb"licen[cs]e[\x20\"']*[:=][\x20\"']*"
    exact = lambda tag: _words(tag.replace(".", r"\."))
    for label, tag in TAGS:
        out.append(_rule(label, spdx + exact(tag), ("spdx",), 100, 1.0))
        out.append(_rule(label, field + exact(tag), (tag.split()[0],), 85, 0.9))
    for label, names, versions, keys in FAMILIES:
        name, tag = b"(?:" + b"|".join(_words(n) for n in names.split("|")) + b")", _words(label.replace("-", " "))
        for v in sorted(versions, key=len, reverse=True):
            short = f"{label}-{v.removesuffix('.0')}"
            later = re.escape(v.encode()) + rb"(?:\.0)?" + rb"(?:" + SEP + rb"(?:only|or" + SEP + rb"later))?"
            out.append(_rule(short, spdx + tag + SEP + later, ("spdx",), 100, 1.0))
            out.append(_rule(short, field + tag + SEP + later, (label.split("-")[0],), 85, 0.9))
            out.append(_rule(short, name + version(v), keys, 80, 0.95))
        if label != "boost":  # its identifier, bsl, is another's without the version
            out.append(_rule(label, spdx + tag, ("spdx",), 90, 1.0))
        out.append(_rule(label, field + tag, (label.split("-")[0],), 70, 0.9))
        out.append(_rule(label, rb"(?:licen[cs]ed|released|distributed|available|provided)" + SEP + rb"under" + SEP + rb"(?:(?:the|an?)" + SEP + rb")?" + name, keys, 60, 0.9))
        bare = LONG_NAMES.get(label, names)
        if bare:
            out.append(_rule(label, b"|".join(_words(n) for n in bare.split("|")), keys, 40, 0.6))
    for suffix, spelled in CC_PARTS:
        for v in CC_VERSIONS:
            out.append(_rule(f"cc-{suffix}-{v}", b"(?:cc|creative" + SEP + b"commons)" + SEP + _words(suffix.replace("-", " ")) + SEP + re.escape(v.encode()), ("cc", "creative"), 85, 0.95))
            out.append(_rule(f"cc-{suffix}-{v}", b"creative" + SEP + b"commons" + SEP + _words(spelled) + b"(?:" + SEP + b"(?:international|unported|generic|public" + SEP + b"licen[cs]e|licen[cs]e))*" + SEP + re.escape(v.encode()), ("creative",), 85, 0.95))
            out.append(_rule(f"cc-{suffix}-{v}", _words(spelled) + SEP + re.escape(v.encode()) + SEP + b"(?:international|unported|generic)", ("attribution",), 84, 0.9))
        out.append(_rule(f"cc-{suffix}", b"creative" + SEP + b"commons" + SEP + _words(spelled), ("creative",), 70, 0.85))
        out.append(_rule(f"cc-{suffix}", b"creativecommons\\.org/licenses/" + suffix.encode(), ("creativecommons",), 75, 0.95))
        out.append(_rule(f"cc-{suffix}", b"cc" + SEP + _words(suffix.replace("-", " ")), ("cc",), 50, 0.7))
    for label, key, weight, phrase in written:
        out.append(_rule(label, _words(phrase), (key,), *WEIGHTS[weight]))
    return out


class Scanner:
    def __init__(self, written: list[tuple[str, str, str, str]] | None = None) -> None:
        self.rules = rules(signatures() if written is None else written)
        self.keywords = sorted({k for r in self.rules for k in r.keywords})
        words = {k: k.replace(b"-", b" ").split() for k in self.keywords}
        self.starts = {w: re.compile(LEFT + re.escape(w)).search for ws in words.values() for w in ws if len(w) <= 4}
        # one pass finds the longest word of each keyword; the keyword's other words are looked up only then
        self.longest: dict[str, list[tuple[bytes, list[bytes]]]] = {}
        for k, ws in words.items():
            self.longest.setdefault(max(ws, key=len).decode("latin-1"), []).append((k, ws))
        self.anchors = ahocorasick.Automaton()
        for w in self.longest:
            self.anchors.add_word(w, w)
        self.anchors.make_automaton()
        self.by_keyword = {k: [i for i, r in enumerate(self.rules) if k in r.keywords] for k in self.keywords}
        self.base = [(re.compile(LEFT + _words(p) + RIGHT), tuple(w.encode() for w in p.split()), label) for p, label in BASE]
        table = bytearray(b"\x01" * 256)
        for lo, hi in ((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)):
            table[lo : hi + 1] = bytes(hi + 1 - lo)
        self.word_bytes = bytes(table)

    def present(self, text: bytes) -> list[bytes]:
        """The keywords that a lower-cased text holds."""
        seen = {w for _, w in self.anchors.iter(text.decode("latin-1"))}
        return sorted(k for w in seen for k, ws in self.longest[w] if all(x in text and (x not in self.starts or self.starts[x](text)) for x in ws))

    def detections(self, text: bytes) -> list[tuple[int, int, Rule]]:
        """What the rules find in a lower-cased text, overlaps resolved, by start."""
        ran, found = set(), []
        for key in self.present(text):
            for i in self.by_keyword[key]:
                if i not in ran:
                    ran.add(i)
                    found += [(m.start(), m.end(), i) for m in self.rules[i].pattern.finditer(text)]
        found.sort(key=lambda d: (-self.rules[d[2]].priority, d[0] - d[1], d[2], d[0]))
        kept: list[tuple[int, int, int]] = []
        starts = sorted({d[0] for d in found})
        reach = [0] * (len(starts) + 1)  # a Fenwick tree: the furthest end of what is kept, by start
        for d in found:
            at = i = bisect.bisect_right(starts, d[0])
            furthest = 0
            while i:
                furthest = max(furthest, reach[i])
                i &= i - 1
            if furthest < d[1]:
                kept.append(d)
                while at <= len(starts):
                    reach[at] = max(reach[at], d[1])
                    at += at & -at
        return [(a, b, self.rules[i]) for a, b, i in sorted(kept)]

    def __call__(self, text: str | None) -> tuple:
        raw = (text or "").encode("utf-8", "replace").lower()
        is_word = np.frombuffer(raw.translate(self.word_bytes), dtype=np.uint8)
        starts = is_word.copy()
        starts[1:] &= is_word[:-1] ^ 1
        n_words = int(starts.sum())
        places, labels = [], set()
        for pattern, words, label in self.base:
            if all(w in raw for w in words) and (hits := [m.start() for m in pattern.finditer(raw)]):
                places += hits
                labels.add(label)
        found = self.detections(raw)
        rank = lambda at: int(starts[:at].sum())
        every = sorted(labels | {r.label for _, _, r in found})
        score = max([0.9 * bool(labels), *(r.confidence for _, _, r in found)])
        return (n_words, len(places), rank(min(places)) if places else None, rank(max(places)) if places else None, ",".join(sorted(labels)), ",".join(every), float(score))


SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: word count, base places, labels and the confidence of the surest detection. One pass, no shuffle; the driver reads the signatures, which travel with the task."""
    written = signatures()
    return _base.map_texts(docs, lambda: Scanner(written), SCHEMA, [id_col], [text_col])


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_base.read(spark, sf_dir, "documents"))
