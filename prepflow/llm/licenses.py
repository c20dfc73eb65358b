"""Licence scans: an Aho-Corasick automaton finds notices and identifier tags, a shunting-yard parser
evaluates the licence expressions behind the tags.

A text is cut into words once and joined by single spaces; the automaton holds every phrase with
a space on both sides, so one pass finds all phrases at word borders, overlapping ones too.
Tags are phrases like any other. Behind a tag the rest of its line is read as an expression of
licence ids, ``and``, ``or``, ``with`` and parentheses.

Every licence has a restriction between 0 (free for any use) and 1 (no use granted). An expression
has the least restriction of its alternatives (``or``), the greatest of its parts (``and``), and
half of it where an exception relaxes it (``with``). A document's score is that of its most
restrictive statement: 0 without any.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from prepflow.llm.arrow import raw, slices, texts

BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
# Notices of the method itself, in words as the scan cuts them: phrase and label.
NOTICES = (
    ("permission is hereby granted free of charge to any person", "mit"),
    ("apache license version 2 0", "apache-2.0"),
    ("general public license version 2", "gpl-2.0"),
    ("general public license version 3", "gpl-3.0"),
    ("lesser general public license", "lgpl"),
    ("affero general public license", "agpl"),
    ("redistribution and use in source and binary forms", "bsd"),
    ("bsd license", "bsd"),
    ("mozilla public license", "mpl"),
    ("eclipse public license", "epl"),
    ("isc license", "isc"),
    ("boost software license", "bsl-1.0"),
    ("zlib license", "zlib"),
    ("free and unencumbered software released into the public domain", "unlicense"),
    ("creative commons attribution", "cc-by"),
    ("creative commons attribution sharealike", "cc-by-sa"),
    ("creative commons attribution noncommercial", "cc-by-nc"),
    ("cc0 1 0 universal", "cc0-1.0"),
    ("cc by 4 0", "cc-by-4.0"),
    ("cc by sa 4 0", "cc-by-sa-4.0"),
    ("cc by nc 4 0", "cc-by-nc-4.0"),
    ("cc by nd 4 0", "cc-by-nd-4.0"),
    ("all rights reserved", "all-rights-reserved"),
)
# Words of a tag; whether the id behind it must be known to count.
TAGS = (("spdx license identifier", False), ("license expression", True), ("license", True), ("licence", True))
# Restriction by the first part of a label or id that fits; anything else has UNKNOWN.
RESTRICTION = (
    ("cc0", 0.0), ("unlicense", 0.0), ("0bsd", 0.0), ("public-domain", 0.0),
    ("mit", 0.1), ("isc", 0.1), ("bsd", 0.1), ("bsl-1.0", 0.1), ("zlib", 0.1), ("apache", 0.1),
    ("cc-by-nc", 0.9), ("cc-by-nd", 0.9), ("cc-by-sa", 0.5), ("cc-by", 0.2),
    ("agpl", 0.7), ("lgpl", 0.4), ("gpl", 0.6), ("mpl", 0.4), ("epl", 0.4), ("cddl", 0.4),
    ("all-rights-reserved", 1.0), ("proprietary", 1.0),
)
UNKNOWN = 0.5
STRENGTH = {"or": 1, "and": 2, "with": 3}

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TO_SPACES = bytes(i if 48 <= i <= 57 or 97 <= i <= 122 or i > 127 else 32 for i in range(256))
TOKEN = re.compile(rb"[a-z0-9][a-z0-9.+:-]*|[()]")
COLON = re.compile(rb"[\"']?[ \t]*:")
SCHEMA = (
    "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, "
    "labels string, score double, expressions array<string>"
)


def restriction(label: str) -> float:
    for start, value in RESTRICTION:
        if label == start or label.startswith((start + "-", start + "+")):
            return value
    return UNKNOWN


def known(label: str) -> bool:
    return any(label == s or label.startswith((s + "-", s + "+")) for s, _ in RESTRICTION)


class Licence:
    """A parsed expression. Parts stay linked until ``written`` walks them once, so long ones cost their length."""

    def __init__(self, op: str, parts: tuple, value: float):
        self.op, self.parts, self.value = op, parts, value

    def written(self) -> tuple[str, list[str]]:
        """Canonical text, with the parentheses that are needed only, and the licence ids named."""
        out, ids, todo = [], [], [(self, 0, True)]
        while todo:
            part, outer, is_licence = todo.pop()
            if isinstance(part, str):
                out.append(part)
            elif part.op == "id":
                out.append(part.parts[0])
                if is_licence:
                    ids.append(part.parts[0])
            else:
                mine = STRENGTH[part.op]
                a, b = part.parts
                more = [(a, mine, is_licence), (f" {part.op} ", 0, False), (b, mine, is_licence and part.op != "with")]
                todo += (more if mine >= outer else [("(", 0, False), *more, (")", 0, False)])[::-1]
        return "".join(out), ids


def _combine(op: str, a: Licence, b: Licence) -> Licence:
    if op == "with":  # b names an exception, not a licence
        return Licence(op, (a, b), a.value / 2)
    return Licence(op, (a, b), min(a.value, b.value) if op == "or" else max(a.value, b.value))


def parse(tokens: Iterable[str]) -> tuple[Licence | None, int]:
    """The longest start of ``tokens`` that is an expression, by the shunting-yard algorithm, and how many it took.

    What comes after an operand that no operator joins is not part of it. A trailing operator and a
    parenthesis that is not opened end it, one that is not closed closes at the end; None without an id.
    """
    operands: list[Licence] = []
    operators: list[str] = []
    opened = taken = 0

    def reduce() -> None:
        op = operators.pop()
        b, a = operands.pop(), operands.pop()
        operands.append(_combine(op, a, b))

    wants_operand = True
    for token in tokens:
        if wants_operand:
            if token == "(":
                operators.append(token)
                opened += 1
            elif token == ")" or token in STRENGTH:
                break
            else:
                name = token.rstrip(".:-")
                operands.append(Licence("id", (name,), restriction(name)))
                wants_operand = False
        elif token in STRENGTH:
            while operators and operators[-1] != "(" and STRENGTH[operators[-1]] >= STRENGTH[token]:
                reduce()
            operators.append(token)
            wants_operand = True
        elif token == ")" and opened:
            while operators[-1] != "(":
                reduce()
            operators.pop()
            opened -= 1
        else:
            break
        taken += 1
    if wants_operand:  # drop the parentheses, then the operator, that nothing followed
        while operators and operators[-1] == "(":
            operators.pop()
        if operators:
            operators.pop()
    while operators:
        if operators[-1] == "(":
            operators.pop()
        else:
            reduce()
    return (operands[-1] if operands else None), taken


@lru_cache(maxsize=4)
def automaton(base: tuple, notices: tuple, tags: tuple):
    """Aho-Corasick over the bytes of spaced phrases. A phrase may be both a base phrase and a notice."""
    import ahocorasick

    entries: dict[str, list] = {}
    for kind, pairs in (("base", base), ("notice", notices), ("tag", tags)):
        for phrase, value in pairs:
            entries.setdefault(f" {phrase} ", []).append((kind, value, len(phrase.split())))
    found = ahocorasick.Automaton()
    for phrase, what in entries.items():
        found.add_word(phrase.encode().decode("latin-1"), what)
    found.make_automaton()
    return found


def scan(data: bytes, base: tuple = BASE, notices: tuple = NOTICES, tags: tuple = TAGS) -> tuple:
    """The row of one text: see ``scan_licenses``."""
    lowered = data.lower()
    words = lowered.translate(TO_SPACES).split(b" ")
    words = [w for w in words if w]
    line = f" {b' '.join(words).decode('latin-1')} "
    places: list[int] = []
    base_labels, labels, tagged, worst = set(), set(), [], 0.0
    at, word = 0, 0
    for end, what in automaton(base, notices, tags).iter(line):
        word += line.count(" ", at, end)  # words that end before this phrase does, so far
        at = end
        for kind, value, n in what:
            if kind == "tag":
                tagged.append((word - 1, value))
                continue
            labels.add(value)
            worst = max(worst, restriction(value))
            if kind == "base":
                places.append(word - n)
                base_labels.add(value)
    expressions = []
    read = 0  # a tag inside an expression that has been read is a part of it
    starts = _behind(lowered, [k for k, _ in tagged])
    for (_, must_be_known), start in zip(tagged, starts):
        if start is None or start < read:
            continue
        stop = lowered.find(b"\n", start)
        matches = TOKEN.finditer(lowered, start, len(lowered) if stop < 0 else stop)
        seen: list[int] = []
        found, taken = parse(seen.append(m.end()) or m[0].decode() for m in matches)
        if found is None:
            continue
        text, ids = found.written()
        read = seen[taken - 1]
        if must_be_known and not all(map(known, ids)):
            continue
        expressions.append(text)
        labels.update(ids)
        worst = max(worst, found.value)
    return (
        len(words),
        len(places),
        min(places, default=None),
        max(places, default=None),
        ",".join(sorted(base_labels)),
        ",".join(sorted(labels)),
        worst,
        expressions,
    )


def _behind(lowered: bytes, wanted: list[int]) -> Iterator[int | None]:
    """Where an expression starts behind each of the words ``wanted`` (ascending): behind a colon, else None."""
    at = 0
    for k, m in enumerate(WORD.finditer(lowered)):
        while at < len(wanted) and wanted[at] == k:
            colon = COLON.match(lowered, m.end())
            yield colon.end() if colon else None
            at += 1
        if at == len(wanted):
            return


def _scans(base: tuple, notices: tuple, tags: tuple):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            data, offsets = raw(part["text"])
            data = data.tobytes()
            rows = [scan(data[s:e], base, notices, tags) for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            columns = list(zip(*rows))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.string())]
            names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "expressions"]
            yield pa.RecordBatch.from_arrays(
                [part["doc_id"], *[pa.array(c, k) for c, k in zip(columns, kinds)]], names=["doc_id", *names]
            )

    return run


def scan_licenses(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    base: tuple = BASE,
    notices: tuple = NOTICES,
    tags: tuple = TAGS,
) -> DataFrame:
    """The licence statements of every row: one row each, in no exchange.

    A-Z are lower-cased and words are runs of digits, letters a-z and bytes beyond ASCII. Returns doc_id,
    n_words, n_base (places of the phrases ``base``, overlapping ones included), first_word and
    last_word (their smallest and largest start, from 0; null if none), base_labels, labels (also
    those of ``notices`` and of the expressions behind ``tags``; distinct, sorted, joined by commas),
    score (0 to 1) and expressions (in canonical form, in text order).

    A tag counts with a colon behind it on the same line; ``license:`` only before ids whose
    restriction is known. A null or empty text has no words, no labels and score 0. Rows that repeat an id each
    get a row, a null id stays null; other columns are ignored. An empty table gives an empty result.
    """
    return texts(df, id_col, text_col).mapInArrow(_scans(base, notices, tags), SCHEMA)
