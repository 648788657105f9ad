"""License scan: exact phrases over words, and short notices with a bounded number of edits.

A notice of length m that stands in a text with at most e edits leaves at least one of e + 1 disjoint
pieces of it untouched (pigeonhole). One Aho-Corasick pass finds all such pieces; around each, the regex
library's bounded-error matching verifies the whole notice, counts the edits and gives the span.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from quarry.llm.common import Words, map_text, text_slices

#: Phrases of the base scan: consecutive words and the label they give. Fixed values.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Short notices as words and the label they give; the fuzzy scan allows one edit in NOTICE_STEP characters.
NOTICES = (
    ("general public license", "gpl"),
    ("all rights reserved", "reserved"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("licensed under the mit license", "mit"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("licensed under the gnu general public license version 3", "gpl-3.0"),
    ("licensed under the gnu general public license version 2", "gpl-2.0"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("mozilla public license", "mpl"),
    ("eclipse public license", "epl"),
    ("redistribution and use in source and binary forms", "bsd"),
    ("licensed under cc by 4 0", "cc-by-4.0"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("creative commons attribution", "cc-by"),
    ("creative commons zero", "cc0"),
    ("spdx license identifier", "spdx"),
    ("boost software license", "bsl-1.0"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
)
NOTICE_STEP = 9


@dataclass(frozen=True)
class Hit:
    """One notice found: span in words, label, edits, and 1 - edits / length of the notice."""

    first: int
    last: int
    label: str
    edits: int
    score: float


def edits_of(notice: str) -> int:
    """Edits that a notice may have."""
    return len(notice) // NOTICE_STEP


def pieces(notice: str) -> list[tuple[int, str]]:
    """The notice in edits + 1 disjoint parts, with their places."""
    n = edits_of(notice) + 1
    cuts = [len(notice) * i // n for i in range(n + 1)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Scanner:
    """Compiled once for each worker process."""

    def __init__(self) -> None:
        self.base = [(re.compile(p + "(?=[ \n])"), label) for p, label in BASE]
        self.fuzzy = [regex.compile(rf"(?b)(?:{regex.escape(text, literal_spaces=True)}){{e<={edits_of(text)}}}") for text, _ in NOTICES]
        seeds: dict[str, list[tuple[int, int]]] = {}
        for k, (text, _) in enumerate(NOTICES):
            for at, piece in pieces(text):
                seeds.setdefault(piece, []).append((k, at))
        self.seeds = ahocorasick.Automaton()
        for piece, places in seeds.items():
            self.seeds.add_word(piece, (len(piece), places))
        self.seeds.make_automaton()

    @staticmethod
    def joined(w: Words) -> tuple[str, np.ndarray]:
        """The words of a slice joined by single spaces, a line end after each text; and where each word starts."""
        length = w.end - w.start
        place = np.zeros(len(length) + 1, np.int64)
        np.cumsum(length + 1, out=place[1:])
        if not len(length):
            return "", place
        inside = np.repeat(w.start - place[:-1], length + 1) + np.arange(place[-1])
        out = w.text[np.minimum(inside, len(w.text) - 1)]
        out[place[1:] - 1] = 32
        last = w.first[1:][w.counts() > 0] - 1
        out[place[last + 1] - 1] = 10
        return out.tobytes().decode("latin-1"), place

    def exact(self, w: Words, text: str, place: np.ndarray) -> list[tuple[int, int, str]]:
        """(text, first word, label) of every place of a base phrase."""
        out = []
        for pattern, label in self.base:
            for m in pattern.finditer(text):
                at = int(np.searchsorted(place, m.start()))
                if place[at] == m.start():  # not inside a word
                    d = int(np.searchsorted(w.first, at, "right")) - 1
                    out.append((d, at - int(w.first[d]), label))
        return out

    def notices(self, w: Words, text: str, place: np.ndarray) -> list[tuple[int, Hit]]:
        """(text, hit) of every notice within its bound of edits; overlapping finds of one notice count once."""
        out: list[tuple[int, Hit]] = []
        done: dict[int, int] = {}
        for end, (size, places) in self.seeds.iter(text):
            for k, at in places:
                notice, label = NOTICES[k]
                e = edits_of(notice)
                a = end + 1 - size - at
                last = done.get(k, 0)
                if end + 1 - size < last:  # within the last match; matches never run over a text's end
                    continue
                low, high = max(last, a - e), a + len(notice) + e
                low = max(low, text.rfind("\n", low, end + 1 - size) + 1)
                stop = text.find("\n", end, high)
                m = self.fuzzy[k].search(text, low, high if stop < 0 else stop)
                if m is None:
                    continue
                done[k] = m.end()
                first = int(np.searchsorted(place, m.start() + (text[m.start()] == " "), "right")) - 1
                final = int(np.searchsorted(place, m.end() - 1, "right")) - 1
                d = int(np.searchsorted(w.first, first, "right")) - 1
                edits = sum(m.fuzzy_counts)
                out.append((d, Hit(first - int(w.first[d]), final - int(w.first[d]), label, edits, 1 - edits / len(notice))))
        return out


def scan_text(scanner: Scanner, text: str) -> tuple[int, list[tuple[int, str]], list[Hit]]:
    """Words, base places and notices of one text."""
    raw = np.frombuffer(text.encode(), np.uint8)
    offsets = np.array([0, len(raw)])
    w = Words(offsets, raw)
    joined = scanner.joined(w)
    return len(w.start), sorted((a, x) for _, a, x in scanner.exact(w, *joined)), [h for _, h in scanner.notices(w, *joined)]


def scan(docs: DataFrame) -> DataFrame:
    """Licenses of every document.

    Returns doc_id, n_words, n_base (all places of base phrases), first_word and last_word (least and
    greatest first word of them, else null), base_labels, labels (base and fuzzy; both distinct, sorted,
    comma-joined), score (1 for a base phrase or an exact notice, else 1 - edits / length of the best
    notice, 0 without one) and notices (array of first word, last word, label, edits). Null texts count as
    empty; each row is scanned by itself and whole, so repeated ids and extra columns make no difference, and an
    empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("label", pa.string()), ("edits", pa.int64())]))
        for b in batches:
            n = b.num_rows
            words = np.zeros(n, np.int64)
            base: list[list[tuple[int, str]]] = [[] for _ in range(n)]
            fuzzy: list[list[Hit]] = [[] for _ in range(n)]
            for first, end, offsets, raw in text_slices(b.column(1)):
                w = Words(offsets, raw)
                words[first:end] = w.counts()
                joined = scanner.joined(w)
                for d, at, label in scanner.exact(w, *joined):
                    base[first + d].append((at, label))
                for d, hit in scanner.notices(w, *joined):
                    fuzzy[first + d].append(hit)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array(words),
                    pa.array([len(x) for x in base], pa.int64()),
                    pa.array([min(x)[0] if x else None for x in base], pa.int64()),
                    pa.array([max(x)[0] if x else None for x in base], pa.int64()),
                    pa.array([",".join(sorted({y for _, y in x})) for x in base]),
                    pa.array([",".join(sorted({y for _, y in x} | {h.label for h in f})) for x, f in zip(base, fuzzy, strict=True)]),
                    pa.array([1.0 if x else max((h.score for h in f), default=0.0) for x, f in zip(base, fuzzy, strict=True)]),
                    pa.array([[{"first": h.first, "last": h.last, "label": h.label, "edits": h.edits} for h in f] for f in fuzzy], kind),
                ],
                names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "notices"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_text(
        docs.select("doc_id", "text"), run, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, notices array<struct<first:long,last:long,label:string,edits:long>>"
    )
