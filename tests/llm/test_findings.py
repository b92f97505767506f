"""One test for each gap closed in the corpus operators."""

import random
import re
from collections import Counter
from pathlib import Path

import pytest

from curata.llm import licenses, mixing, pii, quality, secrets

CARD = "4111111111111111"


@pytest.mark.parametrize("before", ["", "5 ", "12-"])
@pytest.mark.parametrize("after", ["", " 5", " 12/27", "-123", " 12 27"])
def test_a_card_beside_a_short_number_is_found(before, after):
    t = f"{before}{CARD}{after}"
    whole = [s for s in pii.Finder().spans(t) if s[0] == "card"]
    parts = [s for s in pii.Finder().spans(t) if s[0] == "card_part"]
    assert whole or parts == [("card_part", len(before), len(before) + 16)]
    assert CARD not in pii.Redactor()(t)[0]


def test_a_failed_run_without_a_card_has_no_part():
    assert not [s for s in pii.Finder().spans("4111111111111112 5 and 4111111111111112 and 12 34") if s[0] in ("card", "card_part")]


@pytest.mark.parametrize(("text", "label"), [
    ("Creative Commons Zero", "cc0"), ("creative-commons zero", "cc0"), ("CC0", "cc0"), ("the GNU General Public License", "gpl"), ("see the GNU GPL", "gpl"),
    ("GNU Lesser General Public Licence", "lgpl"), ("a GNU Library General Public License text", "lgpl"),
    ("GNU General Public License version 3", "gpl-3"), ("gpl", ""),
])
def test_a_licence_by_name_alone(text, label):
    assert licenses.Scanner()(text)[5] == label


@pytest.mark.parametrize(("text", "labels"), [
    ("GNU General Public License as published", "gpl"), ("the Business Source License 1.1", "busl,busl-1.1"), ("SPDX-License-Identifier: BSL-1.1", "busl-1.1"), ("SPDX-License-Identifier: BSL-1.0", "boost-1"),
    ("SPDX-License-Identifier: BUSL-1.1", "busl-1.1"), ("SPDX-License-Identifier: 0BSD", "0bsd"), ("SPDX-License-Identifier: MS-PL", "ms-pl"), ("license: bsd", "bsd"), ('"license": "MIT"', "mit"), ("License: GPL-3.0-or-later", "gpl-3"),
    ("Boost Software License, Version 1.0", "boost-1"), ("my account has a trail of accesses", ""), ("The Software shall be used for Good, not Evil.", "json"), ("Alle Rechte vorbehalten", "all-rights-reserved"),
    ("distributed under the Boost Software License - Version 1.0", "boost,boost-1"),
])
def test_licence_labels(text, labels):
    got = set(licenses.Scanner()(text)[5].split(","))
    assert got <= set(labels.split(",")) and (got or not labels) and labels.split(",")[-1] in got


def test_each_rule_has_a_keyword_that_its_matches_hold():
    """Each signature's keyword stands in its phrase; a family's alternatives hold one of its keywords."""
    kept = lambda name, keys: any(all(w in name.replace("licen[cs]e", "license") for w in k.replace("-", " ").split()) for k in keys)
    for _, names, _, keys in licenses.FAMILIES:
        assert all(kept(n, keys) for n in names.split("|"))
    seen = licenses.signatures()
    assert len(seen) >= 250 and len({x[3] for x in seen}) > 0.98 * len(seen)
    for label, key, _, phrase in seen:
        sure = re.sub(r"\([^)]*\)\??", " ", phrase).replace("licen[cs]e", "license").replace("[sz]", "s").replace("?", "")  # what no alternative leaves out
        groups = [body.split("|") for body, optional in re.findall(r"\(([^)]*)\)(\??)", phrase) if not optional]
        assert all(w in sure or w == "licen" or any(all(w in x for x in g) for g in groups) for w in key.split()), (label, key, phrase)


def spelling(parsed, r):
    """A random string of bytes that a parsed pattern matches; tests of what stands around it are left to the caller."""
    out = b""
    for op, arg in parsed:
        op = str(op)
        if op == "LITERAL":
            out += bytes([arg])
        elif op == "ANY":
            out += r.choice([b"x", b" ", b"7"])
        elif op == "IN":
            lo, hi = r.choice([a if str(o) == "RANGE" else (a, a) for o, a in arg])
            out += bytes([r.choice([c for c in (*b" -/.,:_\n", lo, hi) if lo <= c <= hi])])
        elif op in ("MAX_REPEAT", "MIN_REPEAT"):
            least, most, body = arg
            out += b"".join(spelling(body, r) for _ in range(r.choice([least, least, min(most, least + 1), min(most, least + 3)])))
        elif op == "BRANCH":
            out += spelling(r.choice(arg[1]), r)
        elif op == "SUBPATTERN":
            out += spelling(arg[3], r)
        else:
            assert op in ("ASSERT", "ASSERT_NOT"), op
    return out


def test_the_keywords_lose_no_match_of_any_rule():
    """Some sixty random spellings of each rule: no separator before a version, v and digit, hyphen, slash."""
    scanner, r = licenses.Scanner(), random.Random(8)
    for rule in scanner.rules:
        parsed, tried = re._parser.parse(rule.pattern.pattern, re.DOTALL), 0
        for _ in range(60):
            text = spelling(parsed, r)
            if rule.pattern.search(text):  # what stands around it holds too
                tried += 1
                assert set(scanner.present(text)) & set(rule.keywords), (rule.label, rule.keywords, text)
        assert tried, rule


@pytest.mark.parametrize(("text", "label"), [
    ("GPLv2 or later", "gpl-2"), ("gplv3", "gpl-3"), ("lgplv3", "lgpl-3"), ("Licensed under AGPLv3", "agpl-3"), ("eupl1.2", "eupl-1.2"), ("MIT/X11", "mit-x11"), ("Attribution-ShareAlike 4.0 International", "cc-by-sa-4.0"),
    ("X11 License", "x11"), ("Attribution-NonCommercial-NoDerivs 3.0 Unported", "cc-by-nc-nd-3.0"),
])
def test_names_joined_to_their_versions(text, label):
    assert label in licenses.Scanner()(text)[5].split(",")


def test_labels_on_documents_are_those_of_all_rules(spark):
    """Without keywords, each rule run over each text, overlaps resolved pair by pair."""
    scanner = licenses.Scanner()
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    extra = ["Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "MIT License. Permission is hereby granted, free of charge, to any person obtaining a copy", "cc by-nc-sa 4.0 all rights reserved gpl-3", "GPLv2, lgplv3 and AGPLv3, eupl1.2, mplv2 CC-BY-SA-3.0 mit/x11"]
    for t in [*(r.text for r in rows), *extra]:
        raw = (t or "").encode().lower()
        found = [(m.start(), m.end(), i) for i, rule in enumerate(scanner.rules) for m in rule.pattern.finditer(raw)]
        better = lambda d, k: (scanner.rules[k[2]].priority, k[1] - k[0], -k[2], -k[0]) > (scanner.rules[d[2]].priority, d[1] - d[0], -d[2], -d[0])
        kept = [d for d in found if not any(k[0] <= d[0] and d[1] <= k[1] and better(d, k) for k in found if k != d)]
        base = {label for p, label in (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")) if re.search(r"(?<![0-9a-z\x80-\U0010ffff])" + p.replace(" ", r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+") + r"(?![0-9a-z\x80-\U0010ffff])", (t or "").lower())}
        assert set(filter(None, scanner(t)[5].split(","))) == base | {scanner.rules[i].label for _, _, i in kept}, t[:200]


def test_random_letters_without_a_digit_are_found():
    scanner, r = secrets.Scanner(secrets.ratio_tables()), random.Random(11)
    for alphabet in (secrets.ALPHABET[:52], secrets.ALPHABET[26:52]):
        for size, least in ((16, 0.96), (20, 0.97), (32, 0.98)):
            tokens = ["".join(r.choices(alphabet, k=size)) for _ in range(500)]
            assert sum(bool(scanner.random_spans(t)) for t in tokens) > least * 500
    words = "account button canvas decode editor folder gateway handle invoice journal kernel ledger monitor notify orders printer quota router sensor ticket".split()
    joins = (lambda w: "_".join(w), lambda w: "".join(x.capitalize() for x in w), lambda w: "-".join(w), lambda w: "_".join(w).upper())
    names = [r.choice(joins)(r.choices(words, k=r.randint(3, 5))) for _ in range(2000)]
    assert sum(bool(scanner.random_spans(s)) for s in names) < 0.01 * len(names)  # words that the trainer never saw
    words = "Kraftfahrzeughaftpflichtversicherung Donaudampfschifffahrtsgesellschaft anticonstitutionnellement desafortunadamente XMLHttpRequestFactory"
    assert scanner.random_spans(f"{words} {'a' * 30} {'-' * 40} {'=' * 40} {'1' * 20}") == []


def test_what_follows_a_rule_is_no_secret():
    """Runs, genes, rows, words of more languages and names with acronyms, beside keys of as many characters that are."""
    scanner, r = secrets.Scanner(secrets.ratio_tables()), random.Random(12)
    odd = [c * 16 for c in secrets.ALPHABET] + [c * 33 for c in secrets.ALPHABET]
    odd += ["GGGGTTTTCCCCAAAAGGGG", "www/xxx/yyy/zzz/qqq/jjj", "jjj_qqq_www_zzz_kkk_vvv", "xXxXxXxXxXxXxXxX", "abcdefghijklmnopqrstuvwxyz", "zyxwvutsrqponmlkjihgfedcba", "qwertyuiopasdfghjklzxcvbnm", "00112233445566778899AABBCCDDEEFF"]
    odd += ["przedsiebiorczosciowy", "najszczesliwszego", "Llanfairpwllgwyngyllgogerych", "rhyngwladoldeb-cymdeithasol", "arbeidsongeschiktheidsverzekering", "parseXMLSchemaNode", "gsl_multifit_linear", "loadXSLTStylesheetURL"]
    assert [x for x in odd if scanner.random_spans(x)] == []
    genes = ["".join(r.choices(a, k=n)) for a in ("ACGT", "acgt") for n in (16, 24, 60) for _ in range(100)]
    assert sum(bool(scanner.random_spans(x)) for x in genes) < 0.01 * len(genes)
    for alphabet, least in ((secrets.ALPHABET[:62], 0.97), ("abcdefghijklmnopqrstuvwxyz0123456789", 0.96), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 0.88), ("0123456789ABCDEF", 0.85)):
        assert sum(bool(scanner.random_spans("".join(r.choices(alphabet, k=16)))) for _ in range(500)) > least * 500


def test_labels_of_many_absent_documents_do_not_crowd_out_the_sample(spark):
    docs = spark.range(0, 60).selectExpr("id AS doc_id", "concat('text of ', id) AS text")
    labels = spark.range(0, 4000).selectExpr("id AS doc_id", "CAST(id % 2 AS INT) AS quality")
    sample = quality.training_sample(docs, labels, max_per_class=20)
    held = sum(r["held"] for r in docs.select(quality.is_held_out(docs["doc_id"]).alias("held")).collect())
    assert len(sample.rows) == min(60 - held, 40) and {y for y, _ in sample.rows} == {0, 1}


def test_words_are_counted_without_an_array_of_them(make_docs, capsys):
    r = random.Random(3)
    texts = [None, "", " ", "a", " a ", "\t\n\x0b\x0c\r a\x0bb\x0c", "\x1c\x1d \x85\xa0 \u2003", "\U0001f600 \U0001f600\n\U0001f600", "\0 \0", "$1 \\1 x", "w" * 100_000 + " " * 100_000 + "w"]
    texts += ["".join(r.choices("ab \t\n\x0b\x0c\r\xa0\u3000\U0001f600", k=r.randint(1, 40))) for _ in range(500)]
    docs = make_docs(list(enumerate(texts)))
    out = docs.select("doc_id", mixing.sizes(docs).alias("size"))
    assert [x.size for x in out.orderBy("doc_id").collect()] == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]
    out.explain()
    assert "extract_all" not in capsys.readouterr().out


def test_a_mix_of_few_sources_writes_few_files(spark, make_docs):
    made = spark.sparkContext.__dict__.setdefault("_curata_folders", [])
    before = len(made)
    docs = make_docs([(i, "a b c", f"s{i % 5}") for i in range(100)])
    assert mixing.apply_mix(docs).count() <= 100
    files, tables = Counter(), Counter()
    for folder in made[before:]:
        tag = Path(folder).name.rsplit("-", 1)[0]
        tables[tag] += 1
        files[tag] += len(list(Path(folder.removeprefix("file://")).glob("part-*")))
    assert files["sources"] == files["levels"] == files["targets"] == 1
    assert tables["ranges"] == 4 and files["ranges"] <= 2 * 1 + 2 * 4  # those of sources, those of documents and sendings
    assert tables["rows"] == 1 and "sizes" not in tables
