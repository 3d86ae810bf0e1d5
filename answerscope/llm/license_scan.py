"""License scan: notice phrases and identifier tags by Aho-Corasick, licence expressions by shunting yard.

Texts are lower-cased (A-Z) and cut into words, runs of ASCII letters, digits and anything beyond
ASCII. Words that no phrase holds reset the automaton; the others drive it over its transition
table, so all phrases and tags are found in one pass, overlapping ones too.

Behind a tag (``SPDX-License-Identifier:``, ``License-Expression:``) stands an expression of licence
ids, ``and``, ``or``, ``with`` and parentheses. ``parsed`` reads its longest valid start on the line and brings
it into postfix order (``with`` binds tightest, then ``and``, then ``or``); ``evaluated`` reduces the
postfix to how freely the text may be used, 1 for public domain to 0 for unknown or all rights
reserved: ``and`` takes the least, ``or`` the best, ``with`` the better of the licence and the exception.
A tag without a valid start adds nothing.

Labels are those of all phrases and of the ids in expressions; an id that ``LICENCES`` lacks is its
own label. ``score`` is the confidence that the text carries a licence: one less the product of
the doubts of its distinct labels. ``freedom`` is the least over notices and expressions, null
without any.

Scanning is row by row, so nothing is shuffled. Nulls and empties: a null text is empty and has
no words; a null doc_id is kept. Repeated rows get equal results. Further columns are not looked
at. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from answerscope.llm.common import LOWER, SEPARATOR, byte_slices, table, word_hashes

BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
NOTICES = {
    "gnu general public license version 2": "gpl-2",
    "gnu general public license version 3": "gpl-3",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "boost software license": "bsl",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "creative commons attribution": "cc-by",
    "dedicated to the public domain": "public-domain",
    "all rights reserved": "all-rights-reserved",
}
TAGS = ("spdx license identifier", "license expression")
# id in an expression: its label
LICENCES = {
    "mit": "mit", "apache-2.0": "apache-2", "gpl-2.0": "gpl-2", "gpl-2.0-only": "gpl-2", "gpl-2.0-or-later": "gpl-2", "gpl-3.0": "gpl-3", "gpl-3.0-only": "gpl-3",
    "gpl-3.0-or-later": "gpl-3", "lgpl-2.1": "lgpl", "lgpl-3.0": "lgpl", "agpl-3.0": "agpl", "mpl-2.0": "mpl", "epl-2.0": "epl", "bsd-2-clause": "bsd", "bsd-3-clause": "bsd",
    "bsl-1.0": "bsl", "isc": "isc", "cc0-1.0": "public-domain", "unlicense": "public-domain", "cc-by-4.0": "cc-by", "cc-by-sa-4.0": "cc-by-sa", "cc-by-nd-4.0": "cc-by-nd",
    "cc-by-nc-4.0": "cc-by-nc", "cc-by-nc-sa-4.0": "cc-by-nc-sa", "cc-by-nc-nd-4.0": "cc-by-nc-nd",
}
FREEDOM = {"public-domain": 1.0, "mit": 0.9, "apache-2": 0.9, "bsd": 0.9, "bsl": 0.9, "isc": 0.9, "cc-by": 0.8, "mpl": 0.6, "epl": 0.6, "lgpl": 0.6, "cc-by-sa": 0.5,
           "gpl-2": 0.4, "gpl-3": 0.4, "agpl": 0.3, "cc-by-nd": 0.3, "cc-by-nc": 0.2, "cc-by-nc-sa": 0.2, "cc-by-nc-nd": 0.1, "all-rights-reserved": 0.0}
EXCEPTIONS = {"classpath-exception-2.0": 0.6, "gcc-exception-3.1": 0.6, "llvm-exception": 0.9}
_DOUBT = {"base": 0.1, "notice": 0.2, "tag": 0.05}

_RANK = {b"or": 1, b"and": 2, b"with": 3}
_TOKEN = re.compile(rb"[ \t]*(?:([()])|([a-z0-9][a-z0-9.+-]*))")
_TAG_END = re.compile(rb"[ \t]*:")


# ---- expressions

def parsed(text: bytes, at: int = 0) -> list[bytes]:
    """The longest valid expression that starts at ``at`` on its line, in postfix order; empty if there is none."""
    tokens: list[bytes] = []
    depth, operand, valid = 0, True, 0  # valid: tokens read when the expression was last complete
    while True:
        m = _TOKEN.match(text, at)
        if not m:
            break
        token = m.group(1) or m.group(2)
        if operand:
            if token == b"(":
                depth += 1
            elif token == b")" or token in _RANK:
                break
            else:
                operand = False
        elif token in _RANK:
            operand = True
        elif token == b")" and depth:
            depth -= 1
        else:
            break
        tokens.append(token)
        if not operand and not depth:
            valid = len(tokens)
        at = m.end()
    out: list[bytes] = []
    stack: list[bytes] = []
    for token in tokens[:valid]:
        if token == b"(":
            stack.append(token)
        elif token == b")":
            while stack[-1] != b"(":
                out.append(stack.pop())
            stack.pop()
        elif token in _RANK:
            while stack and _RANK.get(stack[-1], 0) >= _RANK[token]:
                out.append(stack.pop())
            stack.append(token)
        else:
            out.append(token)
    return out + stack[::-1]


def evaluated(postfix: list[bytes]) -> float:
    """How freely a text under the expression may be used."""
    stack: list[float] = []
    for token in postfix:
        if token in _RANK:
            right, left = stack.pop(), stack.pop()
            stack.append(min(left, right) if token == b"and" else max(left, right))
        else:
            name = token.decode()
            stack.append(EXCEPTIONS.get(name, FREEDOM.get(LICENCES.get(name, ""), 0.0)))
    return stack[0]


def ids_of(postfix: list[bytes]) -> list[str]:
    """The labels of the licences of an expression, exceptions left out."""
    stack: list[list[str]] = []
    for token in postfix:
        if token in _RANK:
            right, left = stack.pop(), stack.pop()
            stack.append(left if token == b"with" else left + right)
        else:
            name = token.decode()
            stack.append([LICENCES.get(name, name)])
    return stack[0]


# ---- automaton

class Automaton:
    """Aho-Corasick over words: a dense transition table, and the phrases that end in each state."""

    def __init__(self, phrases: list[str]):
        words = sorted({w for p in phrases for w in p.split()})
        number = {w: k for k, w in enumerate(words)}
        self.lengths = [len(p.split()) for p in phrases]
        goto: list[dict[int, int]] = [{}]
        ends: list[list[int]] = [[]]
        for k, phrase in enumerate(phrases):
            state = 0
            for w in phrase.split():
                if number[w] not in goto[state]:
                    goto[state][number[w]] = len(goto)
                    goto.append({})
                    ends.append([])
                state = goto[state][number[w]]
            ends[state].append(k)
        self.step = [[0] * len(words) for _ in goto]
        fail, queue = [0] * len(goto), deque([0])
        while queue:
            state = queue.popleft()
            for w in range(len(words)):
                back = self.step[fail[state]][w] if state else 0
                after = goto[state].get(w)
                self.step[state][w] = back if after is None else after
                if after is not None:
                    fail[after] = back
                    ends[after] = ends[after] + ends[back]
                    queue.append(after)
        self.ends = ends
        hashes, _ = word_hashes([" ".join(words).encode()], SEPARATOR)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]

    def found(self, words: np.ndarray) -> list[tuple[int, int]]:
        """(phrase, number of its first word) of every place in the word hashes, overlapping ones too."""
        slot = np.minimum(np.searchsorted(self.hashes, words), len(self.hashes) - 1)
        known = np.flatnonzero(self.hashes[slot] == words)
        out, state, before = [], 0, -2
        for at, w in zip(known.tolist(), self.order[slot[known]].tolist(), strict=True):
            state = self.step[state if at == before + 1 else 0][w]
            before = at
            for k in self.ends[state]:
                out.append((k, at + 1 - self.lengths[k]))
        return out


PHRASES = [*BASE, *NOTICES, *TAGS]
LABELS = [*BASE.values(), *NOTICES.values()]


def word_ends(text: bytes, words: list[int]) -> list[int]:
    """Where the given words of a text end, in bytes."""
    blank = SEPARATOR[np.frombuffer(text + b" ", dtype=np.uint8)]
    ends = np.flatnonzero(blank[1:] & ~blank[:-1]) + 1
    return ends[words].tolist()


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()),
                     ("labels", pa.string()), ("score", pa.float64()), ("freedom", pa.float64()), ("expressions", pa.list_(pa.string()))])
_DDL = ("doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, freedom double, "
        "expressions array<string>")


def scan(text: bytes, words: np.ndarray, automaton: Automaton) -> dict:
    """What one text holds; ``expressions`` are in postfix order."""
    places = automaton.found(words)
    base = [(k, at) for k, at in places if k < len(BASE)]
    doubts: dict[str, float] = {}
    freedom: list[float] = []
    expressions: list[str] = []
    for k in {k for k, _ in places if k < len(LABELS)}:
        kind = "base" if k < len(BASE) else "notice"
        doubts[LABELS[k]] = min(doubts.get(LABELS[k], 1.0), _DOUBT[kind])
        freedom.append(FREEDOM[LABELS[k]])
    tags = [at + automaton.lengths[k] - 1 for k, at in places if k >= len(LABELS)]
    if tags:
        low = LOWER[np.frombuffer(text, dtype=np.uint8)].tobytes()
        for end in word_ends(low, tags):
            colon = _TAG_END.match(low, end)
            postfix = parsed(low, colon.end()) if colon else []
            if postfix:
                expressions.append(b" ".join(postfix).decode())
                freedom.append(evaluated(postfix))
                for label in ids_of(postfix):
                    doubts[label] = min(doubts.get(label, 1.0), _DOUBT["tag"])
    starts = [at for _, at in base]
    score = 1.0
    for label in sorted(doubts):
        score *= doubts[label]
    return {"n_words": len(words), "n_base": len(base), "first_word": min(starts, default=None), "last_word": max(starts, default=None),
            "base_labels": ",".join(sorted({LABELS[k] for k, _ in base})), "labels": ",".join(sorted(doubts)), "score": 1.0 - score,
            "freedom": min(freedom, default=None), "expressions": expressions}


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    automaton = Automaton(PHRASES)
    for batch in batches:
        for first, end, values in byte_slices(batch.column("text")):
            hashes, starts = word_hashes(values, SEPARATOR)
            ids = batch.column("doc_id").slice(first, end - first).to_pylist()
            rows = [{"doc_id": k, **scan(v, hashes[a:b], automaton)} for k, v, a, b in zip(ids, values, starts[:-1], starts[1:], strict=True)]
            yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)


def licenses(docs: DataFrame) -> DataFrame:
    """(doc_id, word count, base places, labels, score, freedom, expressions) of every row of ``docs`` (doc_id, text)."""
    return docs.select("doc_id", "text").mapInArrow(_rows, _DDL)


def op11_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses(table(spark, folder, "documents", "doc_id", "text"))


QUERIES = {"op11_license_scan": op11_license_scan}
ORACLES: dict[str, str] = {}
