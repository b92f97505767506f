"""The encoder and decoder against the library's."""

import hashlib
import itertools
import json
import random
import tracemalloc

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from curata.llm import bpe

PATH = bpe.default_path()


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


ENCODER = bpe.Encoder(PATH)
NARROW = bpe.Encoder(PATH, window=ENCODER.v.lookahead + 8)


CUT = [bpe.Encoder(PATH, window=ENCODER.v.lookahead + 8, part=n) for n in (1, 2, 3, 7, 29)]


def ids(encoder, text):
    return list(bpe.from_little_endian(encoder.encode(text)))


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=60), st.lists(st.sampled_from(["the", "'s", "'LL ", "<|endoftext|>", "<|startoftext|>", " ", "Σας", "İ", "\x1c", "\x85", "é", "中", "123", "!!", "\U0001f600", "ǅ"]), max_size=20).map("".join)))
def test_same_ids_and_text(library, text):
    want = library.encode(text, add_special_tokens=False).ids
    got = ids(ENCODER, text)
    assert got == want
    for encoder in CUT:
        assert ids(encoder, text) == want
    assert "".join(bpe.Decoder(PATH).decode(got, step=3)) == library.decode(want, skip_special_tokens=False)


def test_long_words_stream_through_a_window(library):
    r = random.Random(5)
    for n in (39, 40, 41, 700, 5000):
        for alphabet in ("ab", "a", "theing", "abcdefghilmnoprstuv", "!-=", "é中"):
            w = "".join(r.choices(alphabet, k=n))
            want = library.encode(w, add_special_tokens=False).ids
            assert ids(ENCODER, w) == want == ids(NARROW, w)


def test_every_letter_and_number_is_split_alike(library):
    points = [c for c in range(0x20, 0x30000, 1) if not 0xD800 <= c < 0xE000]
    texts = [f"a{chr(c)}b {chr(c)}1{chr(c)}" for c in points]
    for at in range(0, len(texts), 20000):
        for t, x in zip(texts[at : at + 20000], library.encode_batch(texts[at : at + 20000], add_special_tokens=False), strict=True):
            assert ids(ENCODER, t) == x.ids, t


def test_query_on_documents(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in bpe.encode_texts(docs, PATH, with_ids=True).collect():
        want = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        raw = b"".join(i.to_bytes(4, "little") for i in want)
        assert (r.n_tokens, r.ids_sha256, bytes(r.ids)) == (len(want), hashlib.sha256(raw).hexdigest(), raw)
        assert r.decoded_sha256 == hashlib.sha256(library.decode(want, skip_special_tokens=False).encode()).hexdigest()


def test_awkward_rows(awkward, nothing):
    out = bpe.encode_texts(awkward, PATH).collect()
    assert len(out) == 9 and bpe.encode_texts(nothing, PATH).count() == 0
    empty = hashlib.sha256(b"").hexdigest()
    assert [tuple(r)[1:] for r in out if r.doc_id in (1, 2, 4)] == [(0, empty, empty)] * 3


def plain_merges(symbols, ranks):
    """Merges by rank over the whole word, all places of a pair from the left before the next pair."""
    while True:
        pairs = [p for p in itertools.pairwise(symbols) if p in ranks]
        if not pairs:
            return symbols
        best, out, i = min(pairs, key=ranks.__getitem__), [], 0
        while i < len(symbols):
            if tuple(symbols[i : i + 2]) == best:
                out.append("".join(best))
                i += 2
            else:
                out.append(symbols[i])
                i += 1
        symbols = out


def test_lookahead_on_random_merge_lists(tmp_path):
    """Random merge lists and words through the narrowest window that the lookahead allows, against merging whole words."""
    r = random.Random(11)
    for trial in range(60):
        letters = "abc"[: r.choice((1, 2, 3))]
        tokens, merges = [*letters, *(c + "</w>" for c in letters)], []
        while len(merges) < r.choice((3, 8, 20)):
            a, b = r.choice([t for t in tokens if not t.endswith("</w>")]), r.choice(tokens)
            if len(a + b) > 14 or (a, b) in merges:
                break
            merges.append((a, b))
            tokens += [a + b] if a + b not in tokens else []
        path = tmp_path / f"{trial}.json"
        path.write_text(json.dumps({"model": {"vocab": {t: i for i, t in enumerate(tokens)}, "merges": [list(m) for m in merges], "end_of_word_suffix": "</w>"}, "added_tokens": []}))
        v = bpe.vocabulary(str(path))
        names, ranks = {i: t for t, i in v.ids.items()}, {m: i for i, m in reversed(list(enumerate(merges)))}
        for _ in range(150):
            w = "".join(r.choices(letters, k=r.randint(1, 60)))
            t = bpe.Transducer(v, v.lookahead + 1)
            cut = r.randint(0, len(w))
            got = t.feed(w[:cut].encode()) + t.feed(w[cut:].encode()) + t.end()
            assert [names[i] for i in got] == plain_merges([*w[:-1], w[-1] + "</w>"], ranks), (merges, w)


def test_boundaries_that_stand_on_random_merge_lists(tmp_path):
    """Lists in which every product has one merge, after those of its operands: the narrowest windows, cut anywhere, give the ids of whole words, many of them early."""
    r, early, all_ids = random.Random(12), 0, 0
    for trial in range(150):
        letters = "abcd"[: r.choice((1, 2, 3, 4))]
        tokens, merges = [*letters, *(c + "</w>" for c in letters)], []
        for _ in range(r.choice((5, 20, 60))):
            a, b = r.choice([t for t in tokens if not t.endswith("</w>")]), r.choice(tokens)
            if len(a + b) <= 14 and a + b not in tokens:
                merges.append((a, b))
                tokens.append(a + b)
        path = tmp_path / f"{trial}.json"
        path.write_text(json.dumps({"model": {"vocab": {t: i for i, t in enumerate(tokens)}, "merges": [list(m) for m in merges], "end_of_word_suffix": "</w>"}, "added_tokens": []}))
        v = bpe.vocabulary(str(path))
        assert v.in_order
        names, ranks = {i: t for t, i in v.ids.items()}, {m: i for i, m in enumerate(merges)}
        for _ in range(150):
            w = "".join(r.choices(letters, k=r.randint(1, 60)))
            t = bpe.Transducer(v, r.choice((1, 2, 3, 8)), limit=r.choice((None, v.lookahead + 1)))
            cut = r.randint(0, len(w))
            got = t.feed(w[:cut].encode()) + t.feed(w[cut:].encode()) + t.end()
            assert [names[i] for i in got] == plain_merges([*w[:-1], w[-1] + "</w>"], ranks), (merges, w)
            early, all_ids = early + t.early, all_ids + len(got)
    assert early > all_ids / 2


def test_ids_of_documents_come_before_their_words_end(spark, monkeypatch):
    """Of the words longer than a window two in five give ids while they are open (the others may still become other tokens), and at most a few symbols wait."""
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    encoder, feed, gave, most = bpe.Encoder(PATH), bpe.Transducer.feed, [], 0

    def counted(self, data):
        nonlocal most
        out = feed(self, data)
        gave.append((len(data), len(out)))
        most = max(most, len(self.held))
        return out

    monkeypatch.setattr(bpe.Transducer, "feed", counted)
    for t in texts:
        encoder.encode(t)
    long = [n for size, n in gave if size > bpe.WINDOW]
    assert len(long) > 1000 and sum(n > 0 for n in long) > 0.35 * len(long) and most < 4 * bpe.WINDOW
    assert encoder.transducer.early == sum(long)


def test_ids_given_early_stand_whatever_follows():
    """Against continuations of two letters and by the vocabulary's own words."""
    v, r = ENCODER.v, random.Random(4)
    tails = ["", *map("".join, itertools.product("aeiorstnlh", repeat=2)), *r.sample([s.removesuffix("</w>") for s in v.ids if s.isascii() and s.removesuffix("</w>").isalpha()], 300)]
    early = 0
    for _ in range(60):
        word = "".join(r.choice(["th", "er", "mix", "ture", "in", "g", "po", "st", "qu", "al", "ity", "re", "z", "con", "sti"]) for _ in range(6))
        given = bpe.Transducer(v).feed(word.encode() + b"a")  # the last byte waits
        early += len(given)
        assert {tuple(ids(ENCODER, word + x))[: len(given)] for x in tails} == {tuple(given)}
    assert early > 40


def test_every_id_comes_out_of_the_transducer(monkeypatch):
    encoder, seen = bpe.Encoder(PATH), []
    feed, end = bpe.Transducer.feed, bpe.Transducer.end
    monkeypatch.setattr(bpe.Transducer, "feed", lambda self, data: seen.append(x := feed(self, data)) or x)
    monkeypatch.setattr(bpe.Transducer, "end", lambda self: seen.append(x := end(self)) or x)
    words = [f"{a}{b}" for a in ("the", "mixture", "q", "zebra") for b in ("", "s", "ness", "x" * 70)]
    out = ids(encoder, " ".join(words))
    assert [i for x in seen for i in x] == out  # distinct words: each once through it
    seen.clear()
    assert ids(encoder, " ".join(words)) == out and not seen  # the table gives what it gave


def test_memory_does_not_grow_with_the_text():
    """One run of letters without white space, and one of words, of 64 and of 320 thousand characters."""
    r = random.Random(2)
    for piece in ("abcdefgh" * 4_000, " ".join("".join(r.choices("abcdefgh", k=4)) for _ in range(6_400))):
        peaks = []
        for times in (2, 10):
            text, encoder = piece * times, bpe.Encoder(PATH)
            tracemalloc.start()
            for _ in encoder.encode_parts(text):
                pass
            peaks.append(tracemalloc.get_traced_memory()[1])
            tracemalloc.stop()
        assert peaks[1] < 1.3 * peaks[0] + 200_000
