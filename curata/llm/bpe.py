"""BPE encoding as a bounded-lookahead streaming transducer, and decoding as an incremental byte-to-text state machine.

The vocabulary file is in the public tokenizers JSON format: added special tokens cut from the raw text first; then, piece by
piece, NFC, white-space runs to one space, lower case character by character; a split into words; bytes as printable
characters; merges by rank with an end-of-word mark. Its path is a parameter and every executor must have the file.

**Lookahead.** Take two words with a common prefix of symbols, and apply the merges rank by rank. The part of the prefix cut
alike in both shrinks only where a merge (a, b) takes its last token a in one of them; then what starts at the new edge is a or
ab, and the next merge to take a token across that edge has as right operand a token grown from a or ab by merges on its right.
``lookahead`` is the longest such chain, in symbols, over the merge list: D(a, b) = |a| + max D(i) over earlier merges i whose left
operand or product lies on the left spine of b. Tokens that end at least that far before the end of what has been read are
stable. A boundary that no merge crosses separates the two sides, so what follows is encoded afresh from there.

**Reach on what has been read.** D is a worst case (667 symbols here); what may really still change is far less. Where every product has one merge, of higher rank than those of its operands, merges happen in
the order of their ranks, so a rank serves as a time. Compare the run on what has been read with that on any continuation: up to an edge, at first the end, they agree. The edge e can only be crossed by a merge (a, b),
a being the token that ends at e at that time (known: the left side is the same in both), in the run on what has been read (known), or in the other by a token b that starts at e: one that agrees with
what has been read to its own end f or beyond the last symbol. Where the edge once lay behind f and f had been merged away by then, b cannot be. ``Vocabulary.edge`` takes the lowest such rank not below the present one, moves the edge to the
start of a, and goes on until no rank is left: whatever follows, the tokens before the last edge stay. A transducer does this each time that ``WINDOW`` symbols wait; D bounds what can ever wait.

**Streaming.** A text is read in parts of ``PART`` characters, cut after white space, or, in a run of text without any, where no
normalisation and no special token crosses the cut; a word that such a cut leaves open goes on in the next part. Every word, of any length, goes through one
``Transducer``; a table in front of it holds what it gave for words seen before. Ids go to the digest and the decoder part by part. Memory, besides the text as
it came: one part, one window of symbols and two tables of ``TABLE_BYTES``. (A run of combining marks alone has no place to cut and is held whole.)

**Decoding.** Tokens go to their bytes, with a space between two (the format without a decoder), through a UTF-8 state machine
that holds at most three bytes between chunks of ids.

Defined cases: null and empty texts give no ids and the empty string's digests.
"""

from __future__ import annotations

import array
import bisect
import codecs
import functools
import hashlib
import heapq
import itertools
import json
import sys
import unicodedata
from collections.abc import Iterable, Iterator

import regex
from pyspark.sql import DataFrame, SparkSession

from curata.llm import _base

# The word split of this vocabulary format.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|{letter}+|{number}|[^\s{other}]+"

#: Characters of a text that are normalised and split at a time.
PART = 1 << 15
#: Bytes, by estimate, of each of the two tables of words and of white-space-separated tokens already encoded; a full one is emptied.
TABLE_BYTES = 64 << 20
#: Characters behind a cut that must be known to tell 're from a quote before a word.
BEHIND = 3
#: Ids fit in so many bits.
BITS = 24
MASK = (1 << BITS) - 1
NONE = 1 << 62
#: Symbols among which a search is faster than a heap.
FEW = 24
#: Symbols of an open word after which its stable tokens are looked for.
WINDOW = 12
#: Places in a window fit in so many bits.
PLACES = 32
# Letters and numbers that Unicode 16 added, and the lower case of capitals that it and Unicode 17 added.
UNICODE_16 = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D40, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x113B7), (0x113D1, 0x113D3), (0x116D0, 0x116E3), (0x11BC0, 0x11BE0), (0x11BF0, 0x11BF9), (0x13460, 0x143FA), (0x16100, 0x1611D),
    (0x16130, 0x16139), (0x16D40, 0x16D6C), (0x16D70, 0x16D79), (0x18CFF, 0x18CFF), (0x1CCF0, 0x1CCF9), (0x1E5D0, 0x1E5F0), (0x1E5F1, 0x1E5FA),
)
LATE_CAPITALS = {0x1C89: 0x1C8A, 0xA7CB: 0x0264, 0xA7CC: 0xA7CD, 0xA7DA: 0xA7DB, 0xA7DC: 0x019B, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5} | {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
#: White space to str.split() that is none to the format.
SEPARATORS = ("\x1c", "\x1d", "\x1e", "\x1f")


@functools.lru_cache(maxsize=1)
def splitters() -> tuple:
    """The split for Latin-1 texts, that for all, and what goes on with a word of letters or of other characters. Letters and numbers are those of Python's own Unicode tables: the regex library knows letters assigned later."""
    plain = regex.compile(SPLIT.format(letter=r"\p{L}", number=r"\p{N}", other=r"\p{L}\p{N}"), regex.V1)
    is_new = regex.compile(r"[\p{L}\p{N}]").match
    new = [c for c in map(chr, range(0x250, sys.maxunicode + 1)) if unicodedata.category(c) == "Cn" and is_new(c)]
    runs: list[list[int]] = []
    taken = {c for a, b in UNICODE_16 for c in range(a, b + 1)}
    for o in (o for o in map(ord, new) if o not in taken):
        if runs and runs[-1][1] == o - 1:
            runs[-1][1] = o
        else:
            runs.append([o, o])
    late = "[" + "".join(f"\\U{x:08X}-\\U{y:08X}" for x, y in runs) + "]" if runs else "[^\\s\\S]"
    letter, number, other = rf"[\p{{L}}--{late}]", rf"[\p{{N}}--{late}]", rf"(?:[^\s\p{{L}}\p{{N}}]|{late})"
    every = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|{letter}+|{number}|{other}+", regex.V1)
    return plain, every, regex.compile(f"{letter}*", regex.V1), regex.compile(f"{other}*", regex.V1)


def byte_alphabet() -> list[str]:
    """Byte -> printable character: printable Latin-1 bytes as they are, the others counted up from 256."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    extra = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(extra)) for b in range(256)]


class Vocabulary:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            doc = json.load(f)
        model = doc["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.special = {t["content"]: t["id"] for t in doc.get("added_tokens", [])}
        self.surface = {i: s for s, i in self.ids.items()} | {i: s for s, i in self.special.items()}
        # left id and right id in one integer -> rank and product id in one
        self.merge: dict[int, int] = {}
        for rank, (a, b) in enumerate(merges):
            self.merge.setdefault(self.ids[a] << BITS | self.ids[b], rank << BITS | self.ids[a + b])
        self.lookahead = self._lookahead(merges)
        alphabet = byte_alphabet()
        self.inner = [self.ids.get(c) for c in alphabet]
        self.final = [self.ids.get(c + self.suffix) for c in alphabet]
        self.length = {i: len(s.removesuffix(self.suffix)) if self.suffix and s != self.suffix else len(s) for s, i in self.ids.items()}

        self.symbol = {i: s for s, i in self.ids.items() if len(s) == 1}
        made = {f & MASK: f >> BITS for f in self.merge.values()}
        self.in_order = len(made) == len(self.merge) and all(max(made.get(p >> BITS, -1), made.get(p & MASK, -1)) < f >> BITS for p, f in self.merge.items())
        self.right: dict[int, list[tuple[int, int]]] = {}
        for pair, f in self.merge.items():
            self.right.setdefault(pair >> BITS, []).append((f >> BITS, pair & MASK))
        self.begun: dict[int, tuple[int, dict[str, list[int]]]] = {}

    def onward(self, a: int) -> tuple[int, dict[str, list[int]]]:
        """Of the right operands of a's merges: the most symbols, and, for each proper beginning of some, the ranks of those merges, rising."""
        if a not in self.begun:
            most, begun = 0, {}
            for rank, b in sorted(self.right.get(a, ())):
                most = max(most, n := self.length[b])
                name = self.surface[b]
                for i in range(n):
                    begun.setdefault(name[:i], []).append(rank)
            self.begun[a] = most, begun
        return self.begun[a]

    def crossing(self, a: int, text: str, e: int, now: int, gone: list[int], passed: list[int]) -> int:
        """The lowest rank, ``now`` or higher, of a merge of a with what may start at e in some continuation; NONE if there is none."""
        most, begun = self.onward(a)
        n, best = len(text), NONE
        for f in range(e + 1, min(e + most, n) + 1):
            if f == n or gone[f] >= passed[f]:
                b = self.ids.get(text[e:f])
                if b is not None and now <= (rank := self.merge.get(a << BITS | b, NONE) >> BITS) < best:
                    best = rank
        if n - e < most and (ranks := begun.get(text[e:])) and (i := bisect.bisect_left(ranks, now)) < len(ranks):
            best = min(best, ranks[i])
        return best

    def edge(self, text: str, gone: list[int]) -> int:
        """How far the tokens of ``text``, the symbols of an open word, are those of any continuation. gone: the rank that merged each boundary away, or NONE."""
        e, now, passed = len(text), -1, [-1] * (len(text) + 1)
        while e:
            s = e - 1
            while s and gone[s] <= now:
                s -= 1
            until = gone[s] if s else NONE  # the rank that takes the token text[s:e]
            rank = self.crossing(self.ids[text[s:e]], text, e, now, gone, passed)
            if e < len(text):
                rank = min(rank, gone[e])
            if rank < until:
                passed[s:e] = [rank] * (e - s)
                e, now = s, rank
            elif until < NONE:
                now = until
            else:
                break
        return e

    def _lookahead(self, merges: list[tuple[str, ...]]) -> int:
        """The longest chain D over the merges, in symbols; see the module's text."""
        size = lambda t: len(t.removesuffix(self.suffix)) if self.suffix else len(t)
        left: dict[str, str] = {}
        by_left: dict[str, int] = {}
        by_product: dict[str, int] = {}
        longest = 1
        for a, b in merges:
            reach, token = 0, b
            while token is not None:
                reach = max(reach, by_left.get(token, 0), by_product.get(token, 0))
                token = left.get(token)
            d = size(a) + reach
            by_left[a] = max(by_left.get(a, 0), d)
            by_product[a + b] = max(by_product.get(a + b, 0), d)
            left.setdefault(a + b, a)
            longest = max(longest, d)
        return longest


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """One copy for each worker process and file."""
    return Vocabulary(path)


def little_endian(ids: array.array) -> bytes:
    if sys.byteorder == "big":
        ids.byteswap()
    return ids.tobytes()


def from_little_endian(raw: bytes) -> array.array:
    ids = array.array("I", raw)
    if sys.byteorder == "big":
        ids.byteswap()
    return ids


def merge_window(symbols: list[int], merge: dict[int, int]) -> list[int]:
    """All merges on a window of symbols, lowest rank first, leftmost among equals: a heap of merges with their places over a linked list, n log n; a list of few is searched for its lowest."""
    n, get = len(symbols), merge.get
    found = [get(a << BITS | b, NONE) for a, b in zip(symbols, symbols[1:])]  # noqa: B905
    if n <= FEW:
        while found and (best := min(found)) != NONE:
            at = found.index(best)
            product = symbols[at] = best & MASK
            del symbols[at + 1], found[at]
            if at:
                found[at - 1] = get(symbols[at - 1] << BITS | product, NONE)
            if at < len(found):
                found[at] = get(product << BITS | symbols[at + 1], NONE)
        return symbols
    heap = [f << PLACES | i for i, f in enumerate(found) if f != NONE]
    if not heap:
        return symbols
    heapq.heapify(heap)
    found.append(NONE)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while heap:
        best = heapq.heappop(heap)
        i, best = best & (1 << PLACES) - 1, best >> PLACES
        if found[i] != best:
            continue
        gone, left = after[i], before[i]
        right = after[i] = after[gone]
        symbols[i], symbols[gone], found[gone], found[i] = (product := best & MASK), -1, NONE, NONE
        if right < n:
            before[right] = i
            if (f := get(product << BITS | symbols[right])) is not None:
                found[i] = f
                heapq.heappush(heap, f << PLACES | i)
        if left >= 0:
            found[left] = f = get(symbols[left] << BITS | product, NONE)
            if f != NONE:
                heapq.heappush(heap, f << PLACES | left)
    return [s for s in symbols if s >= 0]


def merge_with_ranks(symbols: list[int], v: Vocabulary) -> tuple[list[int], list[int]]:
    """What merge_window gives of a few symbols, and for each place between two of them, by the symbols before it, the rank of the merge that took it away (NONE: it stands)."""
    get, gone, starts = v.merge.get, [NONE] * (len(symbols) + 1), list(range(len(symbols)))
    found = [get(a << BITS | b, NONE) for a, b in itertools.pairwise(symbols)]
    while found and (best := min(found)) != NONE:
        at = found.index(best)
        product = symbols[at] = best & MASK
        gone[starts[at + 1]] = best >> BITS
        del symbols[at + 1], found[at], starts[at + 1]
        if at:
            found[at - 1] = get(symbols[at - 1] << BITS | product, NONE)
        if at < len(found):
            found[at] = get(product << BITS | symbols[at + 1], NONE)
    return symbols, gone


class Transducer:
    """Bytes of one word in, its ids out once they are stable. Holds few symbols, D and a window at most, and the last byte, as the word's last symbol differs."""

    def __init__(self, v: Vocabulary, window: int = WINDOW, limit: int | None = None) -> None:
        self.v, self.window, self.due = v, window, window
        self.limit = limit or max(1024, 8 * v.lookahead)
        self.held: list[int] = []
        self.pending = b""
        self.early = 0  # ids given while their word was open

    def feed(self, data: bytes) -> list[int]:
        data = self.pending + data
        data, self.pending = data[:-1], data[-1:]
        out: list[int] = []
        inner, at = self.v.inner, 0
        while at < len(data):
            end = at + max(1, self.due - len(self.held))
            self.held += [i for b in data[at:end] if (i := inner[b]) is not None]
            at = end
            if len(self.held) >= self.due:
                given = self.stable()
                # what waits is looked at again when half a window has come, or, of a window that gave nothing, when it has doubled
                self.due = max(self.window, len(self.held) + self.window // 2) if given else min(self.limit, 2 * len(self.held))
                out += given
        self.early += len(out)
        return out

    def stable(self) -> list[int]:
        """The tokens that nothing to come can change; their symbols leave the window."""
        v, at, out, last = self.v, 0, [], len(self.held) - self.v.lookahead
        if v.in_order and last < v.lookahead:
            tokens, gone = merge_with_ranks(self.held[:], v)
            last = max(last, v.edge("".join(map(v.symbol.__getitem__, self.held)), gone))
        else:
            tokens = merge_window(self.held[:], v.merge)
        for t in tokens:
            if at + v.length[t] > last:
                break
            at += v.length[t]
            out.append(t)
        del self.held[:at]
        return out

    def end(self) -> list[int]:
        """The rest of the word; the next one may follow."""
        if self.pending and (i := self.v.final[self.pending[0]]) is not None:
            self.held.append(i)
        out = merge_window(self.held, self.v.merge)
        self.held, self.pending, self.due = [], b"", self.window
        return out


class Table(dict):
    """Ids by word, emptied when it is full."""

    def __init__(self, room: int = TABLE_BYTES) -> None:
        self.size, self.room = 0, room

    def add(self, key: str, ids: bytes) -> bytes:
        self.size += 200 + 4 * len(key) + len(ids)
        if self.size > self.room:
            self.clear()
            self.size = 200 + 4 * len(key) + len(ids)
        self[key] = ids
        return ids


@functools.lru_cache(maxsize=1)
def joining() -> frozenset[str]:
    """Characters that may compose with one before them, though they are no combining marks."""
    seconds = (unicodedata.decomposition(chr(c)).split() for c in range(sys.maxunicode + 1))
    found = {chr(int(d[1], 16)) for d in seconds if len(d) == 2 and not d[0].startswith("<")}
    return frozenset(found | set(map(chr, (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)))))


class Encoder:
    def __init__(self, path: str, window: int | None = None, part: int = PART) -> None:
        self.v = vocabulary(path)
        self.part = part
        self.words, self.tokens = Table(), Table()
        self.transducer = Transducer(self.v, window or WINDOW)
        self.plain, self.every, *self.onward = splitters()
        self.is_letter = self.onward[0].match
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.v.special, key=len, reverse=True))) + ")").split if self.v.special else lambda t: [t]
        self.rest, self.open = "", None  # of a word cut between parts: what is undecided, or the pattern of what goes on with it

    def normalise(self, piece: str) -> str:
        """NFC and lower case; white space need not be made one space, as no word holds any."""
        # lower() maps a final capital sigma by its place; the format maps each character by itself
        if not piece.isascii() and any(chr(c) in piece for c in LATE_CAPITALS):
            piece = piece.translate(LATE_CAPITALS)
        return unicodedata.normalize("NFC", piece).replace("\u03a3", "\u03c3").lower()

    def word(self, w: str) -> bytes:
        """Ids of one word as little-endian unsigned 32-bit integers."""
        ids = self.transducer.feed(w.encode("utf-8", "replace"))
        return self.words.add(w, little_endian(array.array("I", ids + self.transducer.end())))

    def token(self, t: str) -> bytes:
        """Ids of whole words, as what stands between two white spaces."""
        known, word = self.words.get, self.word
        return b"".join([known(w) or word(w) for w in (self.every if max(t, default="") > "\xff" else self.plain).findall(t)])

    def whole(self, piece: str) -> bytes:
        """Ids of a piece that starts and ends with whole words."""
        known, keep, token = self.tokens.get, self.tokens.add, self.token
        if any(c in piece for c in SEPARATORS):
            return token(self.normalise(piece))
        return b"".join([known(t) or keep(t, token(t)) for t in self.normalise(piece).split()])

    def onwards(self, piece: str, last: bool) -> Iterator[bytes]:
        """The same if its first word may have begun in the part before, or (not last) its last one may go on in the next."""
        t = self.normalise(piece)
        if self.open:
            end = self.open.match(t).end()
            ids = self.transducer.feed(t[:end].encode("utf-8", "replace"))
            if last or end < len(t):
                ids, self.open = ids + self.transducer.end(), None
            yield little_endian(array.array("I", ids))
            t = t[end:]
        t, self.rest = self.rest + t, ""
        for m in self.every.finditer(t):
            a, b = m.span()
            if last or b <= len(t) - BEHIND or b < len(t) and b - a > 1:
                yield self.words.get(m.group()) or self.word(m.group())
            elif b - a > BEHIND:
                self.open = self.onward[0] if self.is_letter(m.group()).end() else self.onward[1]
                yield little_endian(array.array("I", self.transducer.feed(m.group().encode("utf-8", "replace"))))
                return
            else:
                self.rest = t[a:]
                return

    def pieces(self, text: str, last: bool) -> Iterator[bytes]:
        """Ids of a part, piece by piece between special tokens. last: white space or the end follows it."""
        parts = self.cut(text) if any(s in text for s in self.v.special) else [text]
        for i, piece in enumerate(parts):
            if piece in self.v.special:
                yield self.v.special[piece].to_bytes(4, "little")
            elif (done := last or i + 1 < len(parts)) and not self.rest and not self.open:
                yield self.whole(piece)
            else:
                yield from self.onwards(piece, done)

    def edge(self, text: str, a: int, b: int) -> tuple[int, bool]:
        """Where to cut text[a:b]: behind white space (True), or else where no composition and no special token crosses."""
        if b >= len(text):
            return len(text), True
        at = max(text.rfind(" ", a, b), text.rfind("\n", a, b), text.rfind("\t", a, b))
        if at > a:
            return at + 1, True
        at = b
        while at < len(text):
            c = text[at]
            if c.isascii() or not unicodedata.combining(c) and c not in joining():
                if not any(text.startswith(s, i) for s in self.v.special for i in range(max(a, at - len(s) + 1), at)):
                    return at, False
            at += 1
        return at, True

    def encode_parts(self, text: str | None) -> Iterator[bytes]:
        """The text's ids, in order, as little-endian unsigned 32-bit integers; each part is made when it is asked for."""
        text, at = text or "", 0
        self.rest, self.open = "", None
        while at < len(text):
            end, last = self.edge(text, at, at + self.part)
            yield b"".join(self.pieces(text[at:end], last))
            at = end

    def encode(self, text: str | None) -> bytes:
        """All ids in one."""
        return b"".join(self.encode_parts(text))


class Decoder:
    """Byte-to-text state machine: ids in, text out as soon as its characters are whole."""

    def __init__(self, path: str) -> None:
        v = vocabulary(path)
        self.bytes = {i: b" " + s.encode() for i, s in v.surface.items()}
        self.reset()

    def reset(self) -> None:
        self.first, self.utf8 = True, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        data = b"".join(map(self.bytes.__getitem__, ids))
        if self.first and data:
            data, self.first = data[1:], False
        return self.utf8.decode(data)

    def end(self) -> str:
        out = self.utf8.decode(b"", final=True)
        self.reset()
        return out

    def decode(self, ids: Iterable[int], step: int = 4096) -> Iterator[str]:
        self.reset()
        for at in range(0, len(ids), step):
            yield self.feed(ids[at : at + step])
        yield self.end()


class RoundTrip:
    """Encodes a text part by part; each part's ids go to their digest and through the decoder before the next is made."""

    def __init__(self, path: str, with_ids: bool) -> None:
        self.encoder, self.decoder, self.with_ids = Encoder(path), Decoder(path), with_ids

    def __call__(self, text: str | None) -> tuple:
        n, ids_digest, text_digest, kept = 0, hashlib.sha256(), hashlib.sha256(), []
        self.decoder.reset()
        for raw in self.encoder.encode_parts(text):
            n += len(raw) // 4
            ids_digest.update(raw)
            text_digest.update(self.decoder.feed(from_little_endian(raw)).encode())
            if self.with_ids:
                kept.append(raw)
        text_digest.update(self.decoder.end().encode())
        out = (n, ids_digest.hexdigest(), text_digest.hexdigest())
        return (*out, b"".join(kept)) if self.with_ids else out


SCHEMA = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row for each document: number of ids, their digest, that of the decoded text and, if asked for, the ids as little-endian unsigned 32-bit integers."""
    return _base.map_texts(docs, lambda: RoundTrip(path, with_ids), SCHEMA + (", ids binary" if with_ids else ""), [id_col], [text_col])


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(_base.read(spark, sf_dir, "documents"), default_path())
