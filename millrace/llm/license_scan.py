"""License scans: Aho-Corasick over whole texts, and a shunting-yard evaluator of license expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices, texts

# The base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Further notice phrases and their labels.
NOTICES = {
    "apache license version 2 0": "apache-2.0",
    "boost software license": "bsl-1.0",
    "artistic license": "artistic",
    "bsd 2 clause license": "bsd-2-clause",
    "bsd 3 clause license": "bsd-3-clause",
    "bsd license": "bsd",
    "cc0 1 0 universal": "cc0",
    "common development and distribution license": "cddl",
    "creative commons zero": "cc0",
    "creative commons attribution": "cc-by",
    "eclipse public license": "epl",
    "gnu affero general public license": "agpl",
    "european union public licence": "eupl",
    "gnu free documentation license": "gfdl",
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "isc license": "isc",
    "licensed under the apache": "apache",
    "licensed under the mit": "mit",
    "microsoft public license": "ms-pl",
    "mozilla public license": "mpl",
    "permission is hereby granted free of charge": "mit",
    "permission to use copy modify and or distribute this software": "isc",
    "public domain": "public-domain",
    "python software foundation license": "psf",
    "redistribution and use in source and binary forms": "bsd",
    "sil open font license": "ofl",
    "the unlicense": "unlicense",
    "zlib license": "zlib",
}
#: The identifier tag as words, and as it stands in a text before its expression.
TAG = "spdx license identifier"
_TAG = re.compile(r"spdx[^0-9a-z]+license[^0-9a-z]+identifier[ \t]*[:=]?[ \t]*([^\n\r*#<\"]*)", re.IGNORECASE)
_TOKEN = re.compile(r"[()/]|[A-Za-z0-9][A-Za-z0-9.+:-]*")
# License identifiers of the public SPDX list that a tag may name, in lower case.
IDENTIFIERS = set(
    """0bsd afl-3.0 agpl-1.0 agpl-3.0 apache-1.0 apache-1.1 apache-2.0 apsl-2.0 artistic-1.0 artistic-2.0 blueoak-1.0.0 bsd-1-clause
    bsd-2-clause bsd-2-clause-patent bsd-3-clause bsd-3-clause-clear bsd-4-clause bsl-1.0 busl-1.1 bzip2-1.0.6 cc-by-3.0 cc-by-4.0 cc-by-nc-4.0
    cc-by-nc-nd-4.0 cc-by-nc-sa-4.0 cc-by-nd-4.0 cc-by-sa-3.0 cc-by-sa-4.0 cc0-1.0 cddl-1.0 cddl-1.1 cecill-2.1 cecill-b cecill-c cpl-1.0 curl ecl-2.0
    efl-2.0 epl-1.0 epl-2.0 eupl-1.1 eupl-1.2 ftl gfdl-1.1 gfdl-1.2 gfdl-1.3 gpl-1.0 gpl-2.0 gpl-3.0 hpnd icu ijg ipl-1.0 isc lgpl-2.0 lgpl-2.1 lgpl-3.0
    libpng libpng-2.0 libtiff lppl-1.3c mit mit-0 mpl-1.0 mpl-1.1 mpl-2.0 mpl-2.0-no-copyleft-exception ms-pl ms-rl mulanpsl-2.0 ncsa nist-pd odbl-1.0 oclc-2.0
    ofl-1.1 openssl osl-3.0 php-3.01 postgresql psf-2.0 python-2.0 ql-1.0 qpl-1.0 ruby sleepycat sspl-1.0 unicode-3.0 unicode-dfs-2016 unlicense upl-1.0
    vim w3c wtfpl x11 xnet zlib zpl-2.1""".split()
)
# Identifiers of exceptions of the same list.
EXCEPTIONS = set(
    """autoconf-exception-2.0 autoconf-exception-3.0 bison-exception-2.2 bootloader-exception classpath-exception-2.0 font-exception-2.0 gcc-exception-2.0
    gcc-exception-3.1 libtool-exception linux-syscall-note llvm-exception ocaml-lgpl-linking-exception openjdk-assembly-exception-1.0 openssl-exception
    qt-gpl-exception-1.0 swift-exception u-boot-exception-2.0 universal-foss-exception-1.0 wxwindows-exception-3.1""".split()
)
_OWN = re.compile(r"(documentref-[a-z0-9.-]+:)?licenseref-[a-z0-9.-]+")
#: Versions of these families may be followed by -only or -or-later.
_GNU = re.compile(r"(?:agpl|gfdl|gpl|lgpl)-[0-9.]+(-only|-or-later)")
#: How surely a kind of evidence tells a license; a text's score joins all that it holds.
WEIGHTS = {"base": 0.7, "notice": 0.6, "tag": 0.9}
#: Operators of license expressions and how tightly they bind.
PRECEDENCE = {"or": 1, "and": 2, "with": 3}

#: ASCII letters to lower case, digits and bytes from 0x80 as they are, all else to a blank.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: str) -> list[bytes]:
    """The words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text with A-Z lower-cased, as UTF-8."""
    return text.encode("utf-8", "replace").translate(_FOLD).split()


def is_license(name: str) -> bool:
    """Whether a lower-case name is a known identifier, one with a trailing +, or a reference of the document's own."""
    plain = name.removesuffix("+")
    if told := _GNU.fullmatch(plain):
        plain = plain.removesuffix(told[1])
    return plain in IDENTIFIERS or bool(_OWN.fullmatch(name))


def beginning(expression: str) -> list[str]:
    """The tokens of the longest valid beginning of an expression, in lower case; `/` counts as `or`.

    A tag's line may go on with other text, so the first token that cannot follow ends it: a name
    that is no known license, an operator without a name before it, a bracket too many.
    """
    taken: list[str] = []
    depth = good = 0
    ready = False  # whether an operand has just ended
    for token in _TOKEN.findall(expression):
        low = "or" if token == "/" else token.lower().rstrip(".:-")
        last = taken[-1] if taken else ""
        if low in PRECEDENCE:
            if not ready or (low == "with" and (last == ")" or taken[-2:-1] == ["with"])):
                break
            ready = False
        elif low == "(":
            if ready or last == "with":
                break
            depth += 1
        elif low == ")":
            if not ready or not depth:
                break
            depth -= 1
        else:
            if ready or not (low in EXCEPTIONS if last == "with" else is_license(low)):
                break
            ready = True
        taken.append(low)
        if ready and not depth:
            good = len(taken)
    return taken[:good]


def evaluate(expression: str) -> tuple[set[str], int] | None:
    """The licenses that the longest valid beginning of an expression names, and in how many ways it can be met; None if it names none.

    Shunting-yard: `with` binds tighter than `and`, that tighter than `or`. A value is the set of
    names and the number of alternatives: `or` adds them and `and` multiplies them, so no
    expression is too long. A number beyond 64 bits counts as the greatest one.
    """
    values: list[tuple[frozenset, int]] = []
    waiting: list[str] = []

    def reduce() -> None:
        op, (names_b, b), (names_a, a) = waiting.pop(), values.pop(), values.pop()
        if op == "with":
            values.append((frozenset(f"{x} with {y}" for x in names_a for y in names_b), a))
        else:
            values.append((names_a | names_b, a + b if op == "or" else a * b))

    for token in beginning(expression):
        if token in PRECEDENCE:
            while waiting and waiting[-1] != "(" and PRECEDENCE[waiting[-1]] >= PRECEDENCE[token]:
                reduce()
            waiting.append(token)
        elif token == "(":
            waiting.append(token)
        elif token == ")":
            while waiting[-1] != "(":
                reduce()
            waiting.pop()
        else:
            values.append((frozenset([token]), 1))
    while waiting:
        reduce()
    return (set(values[0][0]), min(values[0][1], (1 << 63) - 1)) if values else None


class Scanner:
    """Finds all phrases in one pass over a text's folded words."""

    def __init__(self) -> None:
        self.automaton = ahocorasick.Automaton()
        for phrase in {**BASE, **NOTICES, TAG: ""}:
            self.automaton.add_word(f" {phrase} ", (phrase, phrase.count(" ") + 1))
        self.automaton.make_automaton()

    def scan(self, text: str) -> dict:
        """The text's words, phrase places by word, and labels with their evidence."""
        found = words(text)
        line = b" %b " % b" ".join(found)
        flat = line.decode("latin-1")
        base, evidence, tags = [], {}, False
        at = seen = 0
        for end, (phrase, n) in self.automaton.iter(flat):
            seen += line.count(b" ", at, end)
            at = end
            start = seen - n  # the blank before the phrase's first word is the start-th
            if phrase == TAG:
                tags = True
                continue
            if phrase in BASE:
                base.append((start, BASE[phrase]))
            kind = "base" if phrase in BASE else "notice"
            label = BASE.get(phrase) or NOTICES[phrase]
            evidence.setdefault(label, set()).add(kind)
        ways = 0
        if tags:
            for expression in _TAG.findall(text):
                if told := evaluate(expression):
                    ways = max(ways, told[1])
                    for name in told[0]:
                        evidence.setdefault(name, set()).add("tag")
        miss = 1.0
        for kinds in evidence.values():
            for kind in kinds:
                miss *= 1 - WEIGHTS[kind]
        starts = [s for s, _ in base]
        return {
            "n_words": len(found), "n_base": len(base), "first_word": min(starts, default=None), "last_word": max(starts, default=None),
            "base_labels": ",".join(sorted({x for _, x in base})), "labels": ",".join(sorted(evidence)), "score": 1 - miss, "alternatives": ways,
        }


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, alternatives long"


def scan_licenses(docs: DataFrame) -> DataFrame:
    """A row for every document: its words, base phrase places, labels, and how sure they are (0 if none).

    A null text counts as empty: no words, no places, null first_word and last_word, empty labels.
    A phrase's words stand consecutively whatever lies between them that is no word. A tag gives the
    licenses of its expression's longest valid beginning. Repeated rows each give a row; a null
    doc_id stays null; other columns are not read. An empty table gives no row.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.int64()]
        for batch in slices(batches, 1, 2000, 1 << 22):
            rows = [scanner.scan(t) for t in batch.column(1).to_pylist()]
            names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "alternatives"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[n] for r in rows], t) for n, t in zip(names, types, strict=True))], names=["doc_id", *names])

    return texts(docs).mapInArrow(scan, SCHEMA)
