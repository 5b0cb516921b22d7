"""License scan: Aho-Corasick over words, licence expressions by a shunting-yard parser.

A text is lower-cased (A-Z) and taken as words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``. One automaton finds
all notice phrases and identifier tags in a single pass over the words joined
by blanks, so a phrase matches wherever its words stand consecutively. Behind
an identifier tag the rest of the raw line, of any length, is read as a licence expression
(``or`` < ``and`` < ``with``, brackets, either case). The expression gives its
identifiers as labels and an openness between 0 and 1.

Defined cases: null text counts as empty and has no word; a text without
findings has empty labels and openness 1; an expression that does not parse
gives only its known identifiers and openness 0; overlapping and repeated
phrases count each time.
"""
from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigspark.llm.text import column_buffer, lower_ascii, slices, word_spans

#: Phrase of words -> label.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
NOTICES = {
    "gnu general public license": "gpl",
    "gnu general public license version 2": "gpl-2",
    "gnu general public license version 3": "gpl-3",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "cc by sa": "cc-by-sa",
    "cc by 4 0": "cc-by",
    "cc0 1 0 universal": "cc0",
    "permission is hereby granted free of charge to any person": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "all rights reserved": "proprietary",
}
TAGS = ("spdx license identifier", "license expression")

#: Identifiers of expressions whose label differs from their lower case.
ALIASES = {"apache-2.0": "apache-2", "cc-by-nc-4.0": "cc-by-nc", "gpl-3.0-only": "gpl-3", "gpl-3.0-or-later": "gpl-3",
           "gpl-3.0": "gpl-3", "gpl-2.0": "gpl-2", "gpl-2.0-only": "gpl-2", "gpl-2.0-or-later": "gpl-2",
           "cc0-1.0": "cc0", "bsd-3-clause": "bsd", "bsd-2-clause": "bsd", "mpl-2.0": "mpl", "epl-2.0": "epl"}
#: How freely text under a label may be reused.
OPENNESS = {"mit": 1.0, "apache-2": 1.0, "bsd": 1.0, "cc0": 1.0, "cc-by": 0.9, "isc": 1.0, "unlicense": 1.0,
            "mpl": 0.6, "epl": 0.6, "lgpl": 0.6, "cc-by-sa": 0.5, "gpl": 0.4, "gpl-2": 0.4, "gpl-3": 0.4, "agpl": 0.3,
            "cc-by-nc": 0.1, "proprietary": 0.0}
UNKNOWN_OPENNESS = 0.2
#: What an exception adds to the openness of its licence.
EXCEPTION_BONUS = 0.2

_TOKEN = re.compile(r"\s*(?:([()])|([A-Za-z0-9][A-Za-z0-9.+:-]*))")
_BINDS = {"or": 1, "and": 2, "with": 3}


def label_of(identifier: str) -> str:
    name = identifier.lower().rstrip("+")
    return ALIASES.get(name, name)


def tokens(line: str) -> Iterator[str]:
    """Brackets, operators and identifiers up to the first other character."""
    at = 0
    while m := _TOKEN.match(line, at):
        if token := m[1] or m[2].rstrip(".:-"):
            yield token
        at = m.end()


def leading_expression(parts: Iterable[str]) -> list[str]:
    """The longest start of the tokens that may be one expression: prose behind it ends it and is not read."""
    depth, operand, end = 0, True, 0
    taken: list[str] = []
    for i, t in enumerate(parts):
        taken.append(t)
        word = t.lower()
        if operand and t == "(":
            depth += 1
        elif operand and word not in _BINDS and t != ")":
            operand = False
        elif not operand and t == ")" and depth:
            depth -= 1
        elif not operand and word in _BINDS:
            operand = True
        else:
            break
        if not operand and not depth:
            end = i + 1
    return taken[:end]


def to_postfix(parts: list[str]) -> list[str] | None:
    """Shunting-yard: tokens to postfix order; None for an ill-formed expression."""
    out: list[str] = []
    held: list[str] = []
    operand = True
    for t in parts:
        word = t.lower()
        if t == "(":
            if not operand:
                return None
            held.append(t)
        elif t == ")":
            if operand:
                return None
            while held and held[-1] != "(":
                out.append(held.pop())
            if not held:
                return None
            held.pop()
        elif word in _BINDS:
            if operand:
                return None
            while held and held[-1] != "(" and _BINDS[held[-1]] >= _BINDS[word]:
                out.append(held.pop())
            held.append(word)
            operand = True
        else:
            if not operand:
                return None
            out.append(t)
            operand = False
    if operand or "(" in held:
        return None
    return out + held[::-1]


def evaluate(postfix: list[str]) -> tuple[set[str], float]:
    """(labels, openness): ``or`` takes the freer side, ``and`` the stricter, ``with`` frees its licence."""
    stack: list[tuple[set[str], float, str]] = []
    for t in postfix:
        if t in _BINDS:
            b, a = stack.pop(), stack.pop()
            if t == "or":
                stack.append((a[0] | b[0], max(a[1], b[1]), ""))
            elif t == "and":
                stack.append((a[0] | b[0], min(a[1], b[1]), ""))
            else:
                stack.append((a[0], min(1.0, a[1] + EXCEPTION_BONUS), ""))
        else:
            label = label_of(t)
            stack.append(({label}, OPENNESS.get(label, UNKNOWN_OPENNESS), t))
    labels, openness, _ = stack[0]
    return labels, openness


def read_expression(line: str) -> tuple[set[str], float]:
    """Labels and openness of the expression at the start of a line."""
    postfix = to_postfix(leading_expression(tokens(line)))
    if postfix:
        return evaluate(postfix)
    known = {label_of(t) for t in tokens(line)} & set(OPENNESS)
    return known, 0.0


def automaton(base: dict[str, str], notices: dict[str, str], tags: tuple[str, ...]):
    import ahocorasick
    machine = ahocorasick.Automaton()
    entries: dict[str, list] = {}
    for kind, items in (("base", base.items()), ("notice", notices.items()), ("tag", ((t, "") for t in tags))):
        for phrase, label in items:
            entries.setdefault(f" {phrase} ", []).append((kind, label, phrase.count(" ") + 1))
    for key, value in entries.items():
        machine.add_word(key, (len(key), value))
    machine.make_automaton()
    return machine


def scan(docs: DataFrame, base: dict[str, str] | None = None, notices: dict[str, str] | None = None,
         tags: tuple[str, ...] = TAGS, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc, n_words, findings (label, kind, word), expressions (word, labels, openness) and openness of every text."""
    base = BASE_PHRASES if base is None else base
    notices = NOTICES if notices is None else notices
    kind = docs.schema[doc_col].dataType.simpleString()
    finding = pa.list_(pa.struct([("label", pa.string()), ("kind", pa.string()), ("word", pa.int64())]))
    expression = pa.list_(pa.struct([("word", pa.int64()), ("labels", pa.list_(pa.string())), ("openness", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(base, notices, tags)
        for whole in batches:
            for batch in slices(whole, "text"):
                yield scan_batch(machine, batch)

    def scan_batch(machine, batch: pa.RecordBatch) -> pa.RecordBatch:
        buf, off = column_buffer(batch.column(1))
        content = buf.tobytes()
        low = lower_ascii(buf)
        starts, ends, rows = word_spans(low, off)
        n = batch.num_rows
        n_words = np.bincount(rows, minlength=n).astype(np.int64)
        first = np.concatenate([[0], np.cumsum(n_words)])
        # all words of the batch, one blank before and after each; a line break parts the rows
        lengths = ends - starts
        place = np.cumsum(lengths + 1) - lengths + 2 * rows      # row r has two bytes more before it for each row above
        size = int(len(low) + len(starts) + 2 * n + 4)
        line = np.full(size, 32, np.uint8)
        if len(starts):
            word = np.repeat(place - starts, lengths)
            inside = np.zeros(len(low) + 1, np.int8)
            np.add.at(inside, starts, 1)
            np.add.at(inside, ends, -1)
            at = np.flatnonzero(np.cumsum(inside[:-1]))
            line[at + word] = low[at]
        closing = np.cumsum(np.bincount(rows, weights=lengths + 1, minlength=n)).astype(np.int64) + 2 * np.arange(n) + 1
        line[closing] = 10
        joined = line[: int(closing[-1]) + 1].tobytes().decode("latin-1") if n else ""
        findings: list[list] = [[] for _ in range(n)]
        expressions: list[list] = [[] for _ in range(n)]
        openness = np.ones(n)
        for end, (width, entries) in machine.iter(joined):
            begin = end - width + 2                              # the first word's place
            w = int(np.searchsorted(place, begin))
            r = int(rows[w])
            word_no = w - int(first[r])
            for what, label, count in entries:
                if what != "tag":
                    findings[r].append({"label": label, "kind": what, "word": word_no})
                    openness[r] = min(openness[r], OPENNESS.get(label, UNKNOWN_OPENNESS))
                    continue
                a = int(ends[w + count - 1])
                stop = int(off[r + 1])
                newline = content.find(b"\n", a, stop)
                raw = content[a: stop if newline < 0 else newline].decode("utf-8", "ignore")
                labels, value = read_expression(raw.lstrip(" \t:=\"'"))
                expressions[r].append({"word": word_no, "labels": sorted(labels), "openness": value})
                openness[r] = min(openness[r], value)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n_words), pa.array(findings, finding), pa.array(expressions, expression),
             pa.array(openness)], names=["doc", "n_words", "findings", "expressions", "openness"])

    return docs.select(F.col(doc_col).alias("doc"), F.col(text_col).alias("text")).mapInArrow(
        run, f"doc {kind}, n_words long, findings array<struct<label:string,kind:string,word:bigint>>, "
             "expressions array<struct<word:bigint,labels:array<string>,openness:double>>, openness double")


def summary(scanned: DataFrame) -> DataFrame:
    """One short row per document: counts, first and last base place, base and all labels, openness as score."""
    base = F.filter("findings", lambda f: f["kind"] == "base")
    words = F.transform(base, lambda f: f["word"])
    names = F.transform(base, lambda f: f["label"])
    every = F.concat(F.transform("findings", lambda f: f["label"]), F.flatten(F.transform("expressions", lambda e: e["labels"])))
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return scanned.select(
        "doc", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(words).alias("first_word"),
        F.array_max(words).alias("last_word"), joined(names).alias("base_labels"), joined(every).alias("labels"),
        F.col("openness").alias("score"))
