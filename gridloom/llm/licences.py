"""Licence scan: an Aho-Corasick automaton finds notice phrases and identifier tags, a shunting-yard parser reads the expression of a tag.

A text's words are its runs of ASCII letters and digits and of characters beyond ASCII, with A-Z lower-cased. All phrases are looked for in one
pass over the words. Where the automaton meets the words of the identifier tag, the rest of that line is taken from the
text itself, turned into postfix order and evaluated: ``and`` needs all, ``or`` offers the best, ``with`` binds an exception to the identifier before it.

The score says how freely the text may be used as far as its licences tell, from 0 (no licence found, or only unknown ones) to 1
(permissive): the least free of its notices and expressions counts.

Defined results: null, empty and wordless texts have no words, no labels and score 0; whole texts of any length are scanned, in time in proportion to them;
each place of a phrase counts, those that overlap too; an identifier is known as a whole or is "other", with freedom 0; an
expression that cannot be parsed gives the label "unparsed" and score 0; repeated rows give the same result each; an empty table gives none; other columns,
whatever their names, aren't touched.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The base phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Notice phrases of common licences, as words, and labels.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "mit license": "mit",
    "apache license 2 0": "apache-2",
    "apache 2 0 license": "apache-2",
    "redistribution and use in source and binary forms": "bsd",
    "bsd 2 clause": "bsd",
    "bsd 3 clause": "bsd",
    "isc license": "isc",
    "zlib license": "zlib",
    "boost software license": "bsl",
    "artistic license": "artistic",
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "common development and distribution license": "cddl",
    "european union public licence": "eupl",
    "sil open font license": "ofl",
    "open database license": "odbl",
    "python software foundation license": "psf",
    "server side public license": "sspl",
    "business source license": "busl",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution non commercial": "cc-by-nc",
    "creative commons attribution noderivatives": "cc-by-nd",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution share alike": "cc-by-sa",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc by 4 0": "cc-by",
    "cc by 3 0": "cc-by",
    "cc0 1 0": "public-domain",
    "public domain": "public-domain",
    "all rights reserved": "all-rights-reserved",
}

#: Labels of whole identifiers in expressions, as patterns; a version may be followed by "-only", "-or-later" or "+".
IDENTIFIERS = {
    "mit": r"mit(-0|-advertising|-cmu|-enna|-feh|-festival|-modern-variant|-open-group|-wu)?|mitnfa|x11|x11-.+|expat",
    "apache-2": r"apache-2(\.0)?",
    "apache-1": r"apache-1\.[01]",
    "bsd": r"0bsd|bsd|bsd-[1-4]-clause(-.+)?|bsd-protection|bsd-source-code|ncsa",
    "isc": r"isc(-veillard)?",
    "zlib": r"zlib(-acknowledgement)?|libpng(-2\.0)?",
    "bsl": r"bsl-1\.0",
    "artistic": r"artistic-(1\.0(-cl8|-perl)?|2\.0)",
    "psf": r"psf-2\.0|python-2\.0(\.1)?",
    "postgresql": r"postgresql",
    "ms-pl": r"ms-(pl|rl)",
    "wtfpl": r"wtfpl",
    "upl": r"upl-1\.0",
    "gpl": r"gpl(-[123](\.0)?)?",
    "lgpl": r"lgpl(-(2|2\.0|2\.1|3|3\.0))?|lgpllr",
    "agpl": r"agpl(-[13](\.0)?)?",
    "mpl": r"mpl(-(1\.0|1\.1|2\.0(-no-copyleft-exception)?))?",
    "epl": r"epl(-[12]\.0)?",
    "cddl": r"cddl-1\.[01]",
    "eupl": r"eupl-1\.[0-2]",
    "ofl": r"ofl-1\.[01](-no-rfn|-rfn)?",
    "odbl": r"odbl-1\.0",
    "sspl": r"sspl-1\.0",
    "busl": r"busl-1\.1",
    "elastic": r"elastic-2\.0",
    "public-domain": r"cc0-1\.0|cc0|unlicense|pddl-1\.0|cc-pddc",
    "cc-by-nc": r"cc-by-nc(-(sa|nd))?(-[1-4]\.[05](-.+)?)?",
    "cc-by-nd": r"cc-by-nd(-[1-4]\.[05](-.+)?)?",
    "cc-by-sa": r"cc-by-sa(-[1-4]\.[05](-.+)?)?",
    "cc-by": r"cc-by(-[1-4]\.[05](-[a-z]{2,4})?)?",
}
_IDENTIFIERS = {label: re.compile(rf"(?:{pattern})(?:-only|-or-later|\+)?") for label, pattern in IDENTIFIERS.items()}

#: How free a label is.
FREEDOM = {
    "public-domain": 1.0, "mit": 1.0, "bsd": 1.0, "isc": 1.0, "zlib": 1.0, "bsl": 1.0, "wtfpl": 1.0, "upl": 1.0, "postgresql": 1.0, "psf": 1.0, "apache-2": 1.0, "apache-1": 1.0,
    "artistic": 0.9, "cc-by": 0.9, "ms-pl": 0.8, "ofl": 0.8, "mpl": 0.7, "epl": 0.7, "cddl": 0.7, "lgpl": 0.6, "eupl": 0.6, "odbl": 0.5, "gpl": 0.5,
    "cc-by-sa": 0.5, "agpl": 0.4, "cc-by-nd": 0.3, "sspl": 0.2, "busl": 0.2, "elastic": 0.2, "cc-by-nc": 0.2, "all-rights-reserved": 0.0,
}

TAG = "spdx license identifier"
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_BEHIND_TAG = re.compile(r"\s*:?[ \t]*([^\r\n]*)")
_TOKEN = re.compile(r"\s*([()]|[A-Za-z0-9][A-Za-z0-9.+\-]*)")
_RANK = {"or": 1, "and": 2, "with": 3}
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def postfix(tokens: list[str]) -> list[str]:
    """Shunting yard: operators and, or, with (binding tighter in this order from or to with) and parentheses."""
    out, held, operand_next = [], [], True
    for t in tokens:
        low = t.lower()
        if t == "(":
            if not operand_next:
                raise ValueError("an operator is missing")
            held.append(t)
        elif t == ")":
            while held and held[-1] != "(":
                out.append(held.pop())
            if not held or operand_next:
                raise ValueError("a parenthesis has no partner or an operand is missing")
            held.pop()
        elif low in _RANK:
            if operand_next:
                raise ValueError("an operand is missing")
            while held and held[-1] != "(" and _RANK[held[-1]] >= _RANK[low]:
                out.append(held.pop())
            held.append(low)
            operand_next = True
        else:
            if not operand_next:
                raise ValueError("an operator is missing")
            out.append(t)
            operand_next = False
    if operand_next or "(" in held:
        raise ValueError("the expression is not complete")
    return out + held[::-1]


def identifier_label(identifier: str) -> str:
    """The label whose pattern the whole identifier matches, or "other"."""
    low = identifier.lower()
    return next((label for label, pattern in _IDENTIFIERS.items() if pattern.fullmatch(low)), "other")


def evaluate(tokens: list[str]) -> tuple[set[str], float]:
    """Labels named in an expression, and how free its best choice is."""
    stack: list[tuple[set[str], float]] = []
    for t in postfix(tokens):
        if t in _RANK:
            (b, y), (a, x) = stack.pop(), stack.pop()
            stack.append((a, x) if t == "with" else (a | b, max(x, y) if t == "or" else min(x, y)))
        else:
            label = identifier_label(t)
            stack.append(({label}, FREEDOM.get(label, 0.0)))
    return stack[0]


def expression_tokens(text: str) -> list[str]:
    """Tokens from the start of a text as far as they form an expression: an operand that follows an operand ends it."""
    out: list[str] = []
    at, depth, operand_next = 0, 0, True
    while m := _TOKEN.match(text, at):
        t = m[1]
        if not operand_next and t not in ("(", ")") and t.lower() not in _RANK or t == ")" and not depth:
            break
        if t.endswith(".") and t.lower() not in _RANK:
            t = t.rstrip(".")
        out.append(t)
        depth += (t == "(") - (t == ")")
        operand_next = t == "(" or t.lower() in _RANK
        at = m.end()
    return out


@dataclass
class Found:
    n_words: int = 0
    n_base: int = 0
    first: int | None = None
    last: int | None = None
    base: set[str] = field(default_factory=set)
    labels: set[str] = field(default_factory=set)
    freedom: list[float] = field(default_factory=list)


class Scanner:
    def __init__(self) -> None:
        self.automaton = ahocorasick.Automaton()
        for phrase, label in NOTICES.items():
            self.automaton.add_word(f" {phrase} ", ("notice", label, len(phrase)))
        for phrase, label in BASE.items():
            self.automaton.add_word(f" {phrase} ", ("base", label, len(phrase)))
        self.automaton.add_word(f" {TAG} ", ("tag", "", len(TAG)))
        self.automaton.make_automaton()

    def scan(self, text: str) -> Found:
        words = text.encode().translate(_WORD_BYTES).split()
        found = Found(len(words))
        line = " " + b" ".join(words).decode() + " "
        met = list(self.automaton.iter(line))
        if not met:
            return found
        # The word at which a match begins: the spaces before it, counted once for the text.
        spaces = np.flatnonzero(np.frombuffer(line.encode("utf-32-le"), np.uint32) == 32)
        starts = np.searchsorted(spaces, [end - size - 1 for end, (_, _, size) in met]).tolist()
        ends: list[int] = []
        for at, (_, (kind, label, size)) in zip(starts, met, strict=True):
            if kind == "tag":
                ends = ends or [m.end() for m in _WORD.finditer(text)]
                try:
                    labels, freedom = evaluate(expression_tokens(_BEHIND_TAG.match(text, ends[at + 2])[1]))
                except ValueError:
                    labels, freedom = {"unparsed"}, 0.0
                found.labels |= labels
                found.freedom.append(freedom)
                continue
            found.labels.add(label)
            found.freedom.append(FREEDOM[label])
            if kind == "base":
                found.n_base += 1
                found.base.add(label)
                found.first = at if found.first is None else min(found.first, at)
                found.last = at if found.last is None else max(found.last, at)
        return found


FIELDS = {"n_words": "bigint", "n_base": "bigint", "first_word": "bigint", "last_word": "bigint", "base_labels": "string", "labels": "string", "score": "double"}


def licence_column(text: str = "text") -> Column:
    """A struct of n_words, n_base, first_word, last_word, base_labels, labels, score for each text."""
    kinds = {"bigint": pa.int64(), "string": pa.string(), "double": pa.float64()}

    @F.arrow_udf("struct<" + ",".join(f"{k}:{v}" for k, v in FIELDS.items()) + ">")
    def licences(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scanner = Scanner()
        for x in batches:
            rows = [scanner.scan(t.as_py() or "") for t in x]
            columns = [[r.n_words for r in rows], [r.n_base for r in rows], [r.first for r in rows], [r.last for r in rows], [",".join(sorted(r.base)) for r in rows], [",".join(sorted(r.labels)) for r in rows], [min(r.freedom, default=0.0) for r in rows]]
            yield pa.StructArray.from_arrays([pa.array(c, kinds[k]) for c, k in zip(columns, FIELDS.values(), strict=True)], list(FIELDS))

    return licences(F.col(text).cast("string"))
