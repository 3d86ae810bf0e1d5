import re

import pytest

from answerscope.llm import license_scan as L

SCHEMA = "doc_id bigint, text string, labels string"


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    places = [(i, label) for phrase, label in L.BASE.items() for i in range(len(words)) if words[i:i + len(phrase.split())] == phrase.split()]
    notices = {label for phrase, label in L.NOTICES.items() if f" {phrase} " in f" {' '.join(words)} "}
    starts = [i for i, _ in places]
    base = {label for _, label in places}
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), base | notices


TEXTS = [
    ("Released UNDER the MIT License. Apache License, Version 2.0 under the mit license", []),
    ("cc by cc by-nc-sa 4.0; CC BY NC", []), ("apache license version 20 underthe mit license", []), ("", []), (None, []), ("ÀÉ under the mit licensé", []),
    ("# SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0 */", ["mit", "apache-2", "gpl-2"]),
    ("license-expression : Foo-1.0 and", ["foo-1.0"]), ("spdx license identifier mit", []), ("SPDX-License-Identifier: )", []), ("SPDX-License-Identifier:\nMIT", []),
    ("SPDX-License-Identifier: MIT and (ISC or", ["mit"]), ("all rights reserved " * 20_000 + "SPDX-License-Identifier: " + "(" * 5_000 + "mit" + ")" * 5_000, ["mit"]),
    ("x" * 300_000 + " cc by nc", []),
]


def test_cases(spark):
    rows = [(k if k != 3 else None, t, "clash") for k, (t, _) in enumerate(TEXTS)] + [(0, TEXTS[0][0], None)]
    got = L.licenses(spark.createDataFrame(rows, SCHEMA).repartition(2)).collect()
    assert len(got) == len(rows)
    by_text = {k if k != 3 else None: (t, more) for k, (t, more) in enumerate(TEXTS)}
    for r in got:
        text, more = by_text[r.doc_id]
        *want, labels = brute(text)
        assert list(r)[1:6] == want and r.labels == ",".join(sorted(labels | set(more))) and 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)
    assert L.licenses(spark.createDataFrame([], SCHEMA)).count() == 0


def test_given_table(spark, folder):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = L.op11_license_scan(spark, folder).collect()
    assert len(got) == len(texts) and sum(r.n_base for r in got) > 0
    for r in got:
        *want, labels = brute(texts[r.doc_id])
        assert list(r)[1:6] == want and r.labels == ",".join(sorted(labels))


@pytest.mark.parametrize(("text", "postfix", "freedom"), [
    (b"mit", "mit", 0.9), (b"mit or gpl-3.0 and isc", "mit gpl-3.0 isc and or", 0.9), (b"(mit or gpl-3.0) and agpl-3.0", "mit gpl-3.0 or agpl-3.0 and", 0.3),
    (b"gpl-2.0 with classpath-exception-2.0 and mit", "gpl-2.0 classpath-exception-2.0 with mit and", 0.6), (b"mit isc", "mit", 0.9), (b"mit or", "mit", 0.9),
    (b"mit and nothing-known", "mit nothing-known and", 0.0), (b"((isc))", "isc", 0.9)])
def test_expressions(text, postfix, freedom):
    assert b" ".join(L.parsed(text)).decode() == postfix and L.evaluated(L.parsed(text)) == freedom


def test_no_expression():
    assert all(L.parsed(t) == [] for t in (b"", b"and mit", b"(mit", b")", b"\nmit", b"()"))


def test_overlapping_phrases():
    automaton = L.Automaton(["a b c", "b c", "c", "b c d", "a a"])
    hashes, _ = L.word_hashes([b"a a a b c d x b c"], L.SEPARATOR)
    assert sorted(automaton.found(hashes)) == [(0, 2), (1, 3), (1, 7), (2, 4), (2, 8), (3, 3), (4, 0), (4, 1)]
