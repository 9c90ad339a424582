import random
import re

import pytest

from hirelake.llm import licenses
from hirelake.llm.license_rules import LINES, Rule, rules
from hirelake.llm.registry import LLM_QUERIES

SCANNER = licenses.Scanner(rules())


def labels(text):
    return {d["label"] for d in licenses.scan(text.encode(), SCANNER)[2]}


def brute_base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    found = []
    for phrase, label in licenses.BASE.items():
        parts = phrase.split()
        found += [(i, label) for i in range(len(words)) if words[i:i + len(parts)] == parts]
    return len(words), sorted(found)


def test_base_equals_brute_force():
    draw = random.Random(1)
    parts = ["mit", "License", "APACHE", "general", "public", "é", "ß1", "licenses", "xmit", "the"]
    for _ in range(300):
        text = "".join(draw.choice(parts) + draw.choice([" ", "-", ",\n", " ", "", "…"]) for _ in range(30))
        n, base, _ = licenses.scan(text.encode(), SCANNER)
        assert (n, [(b["start"], b["label"]) for b in base]) == brute_base(text)


@pytest.mark.parametrize(("text", "wanted"), [
    ("SPDX-License-Identifier: Apache-2.0", {"apache-2.0"}),
    ("SPDX-License-Identifier: Foo-1", {"other"}),
    ("Licensed under the Apache License, Version 2.0 (the \"License\")", {"apache-2.0"}),
    ("see http://www.apache.org/licenses/LICENSE-2.0.html", {"apache-2.0"}),
    ("The MIT License (MIT)", {"mit"}),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy", {"mit-text"}),
    ("GNU General Public License, version 3", {"gpl-3.0"}),
    ("GNU Lesser General Public License v2.1", {"lgpl-2.1"}),
    ("Creative Commons Attribution-ShareAlike 4.0 International License", {"cc-by-sa"}),
    ("Creative Commons Attribution 4.0 International License", {"cc-by"}),
    ("Mozilla Public License, v. 2.0", {"mpl-2.0"}),
    ("This work is released into the public domain.", {"public-domain"}),
    ("permit licenses of commit license", set()),
    ("the public license of general use", set()),
])
def test_rules(text, wanted):
    assert labels(text) == wanted


def test_hundreds_of_rules_and_gate_loses_nothing():
    assert len(rules()) > 300
    draw = random.Random(2)
    # Texts made of the rules' own words.
    words = re.findall(r"[a-z]+|[0-9]", LINES)
    lost = set()
    for rule in rules():
        inner = rule.pattern.pattern.decode()[8:-6].replace("[cs]", "c").replace("{0,", " ")
        # Each alternative of a group is taken once or left out, at random.
        while "(?:" in inner:
            inner = re.sub(r"\(\?:([^()]*)\)(\?)?", lambda m: draw.choice(
                [*m[1].split("|"), *([""] if m[2] else [])]), inner)
        inner = re.sub(r"(.)\?", lambda m: draw.choice([m[1], ""]), re.sub(r"\[[^]]*\][^ ]*", "", inner))
        line = " ".join(draw.choices(words, k=5)) + " " + inner + " " + draw.choice(words)
        line = " ".join(re.findall(r"[0-9a-z]+", line)).encode()
        lost |= {(m[2].label, m[2].kind) for m in SCANNER.matches(line, gated=False)} - {
            (m[2].label, m[2].kind) for m in SCANNER.matches(line)}
    assert not lost


def brute_settle(found):
    accepted = []
    for d in sorted(found, key=lambda d: (-d[2].priority, d[0] - d[1], d[2].order, d[0])):
        if not any(a[0] <= d[0] and d[1] <= a[1] for a in accepted):
            accepted.append(d)
    return sorted(accepted, key=lambda d: (d[0], d[1], d[2].order))


def test_suppression_equals_brute_force():
    draw = random.Random(3)
    kinds = ["tag", "title", "address", "notice", "generic"]
    for _ in range(300):
        found = []
        for order in range(draw.randrange(25)):
            start = draw.randrange(30)
            rule = Rule(order, f"l{order}", draw.choice(kinds), "", re.compile(b""))
            found.append((start, start + draw.randrange(1, 15), rule))
        assert licenses.settle(found) == brute_settle(found)


def test_nulls_long_texts_ties_and_other_columns(spark):
    rows = [(1, None, "x"), (2, "", "x"), (None, "MIT license", "x"), (4, "mit license " * 30_000, None),
            (4, "mit license " * 30_000, None)]
    found = licenses.find_licenses(spark.createDataFrame(rows, "doc_id long, text string, base string")).collect()
    assert [(r["id"], r["n_words"], len(r["base"])) for r in found] == [
        (1, 0, 0), (2, 0, 0), (None, 2, 1), (4, 60_000, 30_000), (4, 60_000, 30_000)]
    assert licenses.find_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_on_given_tables(spark):
    folder = "/root/testdata/sf0.001"
    texts = dict(map(tuple, spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()))
    found = LLM_QUERIES["op8_licenses"](spark, folder).collect()
    assert len(found) == len(texts)
    for r in found:
        n, base = brute_base(texts[r["doc_id"]])
        starts = [s for s, _ in base] or [None]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (
            n, len(base), starts[0], starts[-1], ",".join(sorted({x for _, x in base})))
        own = set(filter(None, r["labels"].split(",")))
        assert own >= {x for _, x in base} and r["labels"] == ",".join(sorted(own))
        assert (r["score"] > 0) == bool(own) and 0 <= r["score"] <= 1
