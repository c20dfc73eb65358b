import re
import time

import pytest
from conftest import EDGES
from hypothesis import given, settings
from hypothesis import strategies as st

from prepflow.llm import licenses
from prepflow.llm.licenses import parse, scan

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _phrases(text, pairs):
    """Places and labels by comparing words at every place."""
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = WORD.findall(lowered)
    found = []
    for phrase, label in pairs:
        want = phrase.split()
        found += [(i, label) for i in range(len(words)) if words[i : i + len(want)] == want]
    return len(words), found


def _same(row, text):
    n, base = _phrases(text, licenses.BASE)
    _, more = _phrases(text, licenses.NOTICES)
    places = [p for p, _ in base]
    assert row[:4] == (n, len(places), min(places, default=None), max(places, default=None))
    assert row[4] == ",".join(sorted({x for _, x in base}))
    by_phrase = {x for _, x in base + more}
    assert by_phrase <= set(row[5].split(",")) | {""} and sorted(row[5].split(",")) == row[5].split(",")
    if not row[7]:
        assert set(filter(None, row[5].split(","))) == by_phrase
    assert 0 <= row[6] <= 1 and (row[6] > 0 or not row[5])


PIECES = ["mit", "MIT", "license", "Licenſe", "apache", "general", "public", "gnu", "affero", "version", "3", "2", "0", " ", "\n", ".", ", ", ": ", "é", "\x00", "(", ")", " or ", " AND "]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=40).map(lambda p: " ".join(p)) | st.lists(st.sampled_from(PIECES), max_size=40).map("".join) | st.text(max_size=40))
def test_phrases_against_brute_force(text):
    _same(scan(text.encode()), text)


def test_base_places():
    assert scan(b"the MIT license, mit-license; General Public License license")[:5] == (9, 3, 1, 5, "gpl,mit")
    assert scan(b"mitlicense mit licenses")[1] == 0
    assert scan("émit license".encode())[1] == 0  # a word with another letter in it


def _parsed(text):
    found, taken = parse(t.decode() for t in licenses.TOKEN.findall(text.lower().encode()))
    return (*found.written(), found.value, taken) if found else None


@pytest.mark.parametrize(
    "text, canonical, ids, value, taken",
    [
        ("MIT", "mit", ["mit"], 0.1, 1),
        ("MIT OR GPL-3.0-only AND Apache-2.0", "mit or gpl-3.0-only and apache-2.0", ["mit", "gpl-3.0-only", "apache-2.0"], 0.1, 5),
        ("(MIT OR GPL-3.0-only) AND Apache-2.0", "(mit or gpl-3.0-only) and apache-2.0", ["mit", "gpl-3.0-only", "apache-2.0"], 0.1, 7),
        ("GPL-2.0-only WITH Classpath-exception-2.0", "gpl-2.0-only with classpath-exception-2.0", ["gpl-2.0-only"], 0.3, 3),
        ("CC-BY-NC-4.0 and mit", "cc-by-nc-4.0 and mit", ["cc-by-nc-4.0", "mit"], 0.9, 3),
        ("((MIT))", "mit", ["mit"], 0.1, 5),
        ("MIT Apache-2.0", "mit", ["mit"], 0.1, 1),
        ("MIT and", "mit", ["mit"], 0.1, 2),
        ("(MIT and (", "mit", ["mit"], 0.1, 4),
        ("mit) or x", "mit", ["mit"], 0.1, 1),
    ],
)
def test_expressions(text, canonical, ids, value, taken):
    assert _parsed(text) == (canonical, ids, value, taken)


def test_no_expression():
    assert _parsed("") is None and _parsed("and mit") is None and _parsed("( (") is None


expressions = st.recursive(
    st.sampled_from(["mit", "gpl-3.0", "apache-2.0", "x", "cc-by-nc-4.0"]),
    lambda e: st.tuples(e, st.sampled_from(["and", "or"]), e).map(lambda t: f"({t[0]} {t[1]} {t[2]})"),
    max_leaves=12,
)


@settings(max_examples=100, deadline=None)
@given(expressions)
def test_evaluation_against_python(text):
    """With min for or, max for and, Python's own parser gives the value; the canonical text means the same."""
    class Value(float):
        __and__ = lambda a, b: Value(max(a, b))
        __or__ = lambda a, b: Value(min(a, b))

    def meaning(t):
        ids = sorted({w for w in licenses.TOKEN.findall(t.encode()) if w not in (b"and", b"or", b"(", b")")})
        names = {i.decode(): f"v{k}" for k, i in enumerate(ids)}
        code = " ".join({"and": "&", "or": "|"}.get(w.decode(), names.get(w.decode(), w.decode())) for w in licenses.TOKEN.findall(t.encode()))
        return float(eval(code, {v: Value(licenses.restriction(k)) for k, v in names.items()}))

    canonical, _, value, _ = _parsed(text)
    assert value == meaning(text) == meaning(canonical)


def test_tags():
    row = scan(b"// SPDX-License-Identifier: (MIT OR Apache-2.0) AND Zlib */\nrest")
    assert row[5] == "apache-2.0,mit,zlib" and row[7] == ["(mit or apache-2.0) and zlib"] and row[1] == 0
    assert scan(b"License: see below")[5] == "" and scan(b"License: MIT")[5] == "mit"
    assert scan(b'"license": "BSD-3-Clause"')[5] == "bsd-3-clause"
    assert scan(b"License\nMIT: yes")[7] == []
    assert scan(b"SPDX-License-Identifier:\nMIT")[7] == []  # nothing on its line


@pytest.mark.parametrize("piece", ["license: a or ", "license:mit or ", "license: (", "license: ", "(" , "mit or "])
def test_long_lines_take_linear_time(piece):
    start = time.perf_counter()
    scan(b"license: " + piece.encode() * (1_000_000 // len(piece)))
    assert time.perf_counter() - start < 20


def test_rows(spark, clash):
    rows = [*EDGES, (5, "Released under the MIT License.\nSPDX-License-Identifier: GPL-2.0-only")]
    found = licenses.scan_licenses(clash(rows)).collect()
    assert len(found) == len(rows)
    want = {(i, _phrases(t, licenses.BASE)[0]) for i, t in rows}
    assert {(r["doc_id"], r["n_words"]) for r in found} == want
    for r in found:
        if r["n_words"] == 0:
            assert tuple(r)[1:] == (0, 0, None, None, "", "", 0.0, [])
    last = next(r for r in found if r["n_base"])
    assert tuple(last)[1:8] == (12, 1, 3, 3, "mit", "gpl-2.0-only,mit", 0.6)
    assert licenses.scan_licenses(clash([])).collect() == []
