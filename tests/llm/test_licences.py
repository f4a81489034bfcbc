import random
import re
import time

import pytest

from gridloom.llm import licences as L
from tests.llm.helpers import awkward, low

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def truth(text):
    w = WORDS.findall(low(text or ""))
    at = sorted((i, label) for p, label in L.BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
    return len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted({x for _, x in at}))


TEXTS = [None, "", "...", "Licensed under the MIT License.", "under the\nMIT--license under the mit license CC BY-NC 4.0 x", "Apache License, Version 2.0", "xunder the mit license", "underé the mit license under the mit licensee", "cc by nc cc by nc",
         "a " * 50_000 + "Apache License Version 2", "SPDX-License-Identifier: (MIT OR GPL-2.0-only) AND Apache-2.0\nmore", "// SPDX-License-Identifier: GPL-2.0 WITH Classpath-exception-2.0 */", "SPDX-License-Identifier: AND", "GNU General Public License. All rights reserved"]


def test_places_are_those_of_brute_force(spark):
    docs = awkward(spark, list(enumerate(TEXTS)) + [(3, TEXTS[3]), (None, TEXTS[3])])
    rows = docs.select("doc_id", L.licence_column().alias("l")).select("doc_id", "l.*").collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        text = TEXTS[3 if r.doc_id is None else r.doc_id]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == truth(text)
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    by = {r.doc_id: r for r in rows}
    assert by[10].labels == "apache-2,gpl,mit" and by[10].score == 1.0 and by[11].score == 0.5 and by[12].labels == "unparsed" and by[13].score == 0.0
    assert docs.limit(0).select(L.licence_column()).count() == 0


@pytest.mark.parametrize("text,wanted", [("MIT OR GPL-3.0 AND MPL-2.0", 1.0), ("(MIT OR GPL-3.0) AND MPL-2.0", 0.7), ("GPL-2.0+ WITH x OR CC-BY-NC-4.0", 0.5), ("LGPL-2.1 and gpl-2.0", 0.5), ("Unknown-1.0", 0.0)])
def test_expressions(text, wanted):
    assert L.evaluate(L.expression_tokens(text))[1] == wanted


def test_postfix_order():
    assert L.postfix("a or b and c with d".split()) == ["a", "b", "c", "d", "with", "and", "or"]
    for bad in ("a b", "( a", "a )", "and a", "a or", "( )"):
        with pytest.raises(ValueError):
            L.postfix(bad.split())


@pytest.mark.parametrize("identifier,label", [("MIT", "mit"), ("MITRE-thing", "other"), ("BSL-1.0", "bsl"), ("Zlib", "zlib"), ("Artistic-2.0", "artistic"), ("GPL-2.0-or-later", "gpl"), ("GPL-2.0+", "gpl"), ("gplx", "other"), ("CC-BY-NC-SA-4.0", "cc-by-nc"), ("CC-BY-4.0", "cc-by"), ("CC-BY-SA-3.0-DE", "cc-by-sa"), ("BSD-3-Clause-Clear", "bsd"), ("Apache-2.0", "apache-2"), ("LGPL-2.1-only", "lgpl"), ("LicenseRef-mit", "other")])
def test_identifiers_count_as_a_whole(identifier, label):
    assert L.identifier_label(identifier) == label and all(x in L.FREEDOM for x in L.IDENTIFIERS)


def labels_by_hand(text):
    """Labels and score without an automaton: every phrase at every word, every tag by a search of words."""
    w, ends = [], []
    for m in WORDS.finditer(low(text)):
        w.append(m[0])
        ends.append(m.end())
    labels, freedom = set(), []
    for phrase, label in [*L.BASE.items(), *L.NOTICES.items()]:
        p = phrase.split()
        for i in range(len(w)):
            if w[i : i + len(p)] == p:
                labels.add(label)
                freedom.append(L.FREEDOM[label])
    for i in range(len(w)):
        if w[i : i + 3] == L.TAG.split():
            try:
                got = L.evaluate(L.expression_tokens(re.split(r"[\r\n]", text[ends[i + 2] :].lstrip().removeprefix(":").lstrip(" \t"))[0]))
            except ValueError:
                got = {"unparsed"}, 0.0
            labels |= got[0]
            freedom.append(got[1])
    return ",".join(sorted(labels)), min(freedom, default=0.0)


def test_labels_are_those_of_brute_force():
    rng = random.Random(4)
    pieces = [*L.BASE, *L.NOTICES, "SPDX-License-Identifier: MIT OR GPL-2.0", "spdx_license identifier (BSD-3-Clause AND CC0-1.0)\n", "SPDX License-Identifier: ) x", "\u00e9", "MIT", "license", "under", "the", "\n", "gnu lesser", "spdx license"]
    scanner = L.Scanner()
    for _ in range(400):
        text = rng.choice([" ", "-", ". "]).join(rng.choice(pieces) for _ in range(rng.randint(0, 12)))
        got = scanner.scan(text)
        assert (",".join(sorted(got.labels)), min(got.freedom, default=0.0)) == labels_by_hand(text)


def test_many_places_take_linear_time():
    start = time.process_time()
    assert L.Scanner().scan("cc by nc " * 200_000).n_base == 200_000
    assert time.process_time() - start < 10
