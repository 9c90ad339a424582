"""Licence mentions by ordered signature rules.

Every whole text is cut into words. An Aho-Corasick automaton over the rules' keywords tells which of the rules can match at
all; only their patterns run. Overlapping detections are settled by priority (machine-readable tags before titles before
addresses before notices): a detection that lies inside an accepted one of higher rank is dropped. Rank is priority, then
length, then the order of the rules.

Base phrases are looked for apart from the rules and never dropped.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelake.llm.license_rules import Rule, rules
from hirelake.llm.words import letter_words

# Phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
BASE_CONFIDENCE = 0.6

SCHEMA = ("id long, n_words long, base array<struct<start:long,label:string>>, "
          "detections array<struct<start:long,end:long,label:string,kind:string,confidence:double>>")

_READY: list = []


class Scanner:
    """Rules behind their keyword automaton."""

    def __init__(self, ordered: list[Rule]):
        self.rules = ordered
        self.automaton = ahocorasick.Automaton()
        by_keyword: dict[str, list[int]] = {}
        for i, rule in enumerate(ordered):
            by_keyword.setdefault(rule.keyword, []).append(i)
        for keyword, numbers in by_keyword.items():
            self.automaton.add_word(keyword, tuple(numbers))
        self.automaton.make_automaton()

    def matches(self, line: bytes, gated: bool = True) -> list[tuple[int, int, Rule]]:
        """``(first byte, end byte, rule)`` of all matches in words joined by blanks."""
        if gated:
            found = {numbers for _, numbers in self.automaton.iter(line.decode("latin-1"))}
            chosen = sorted(i for numbers in found for i in numbers)
        else:
            chosen = range(len(self.rules))
        return [(m.start(), m.end(), self.rules[i]) for i in chosen for m in self.rules[i].pattern.finditer(line)]


def settle(found: list[tuple[int, int, Rule]]) -> list[tuple[int, int, Rule]]:
    """Detections that lie inside no accepted detection of higher rank, by start."""
    ranked = sorted(found, key=lambda d: (-d[2].priority, d[0] - d[1], d[2].order, d[0]))
    # Accepted intervals that are inside no other: starts and ends both rise, so a search finds the only candidate.
    starts: list[int] = []
    ends: list[int] = []
    accepted = []
    for start, end, rule in ranked:
        before = bisect_right(starts, start)
        if before and ends[before - 1] >= end:
            continue
        accepted.append((start, end, rule))
        low, high = bisect_left(starts, start), bisect_right(ends, end)  # those inside the new one
        starts[low:max(low, high)] = [start]
        ends[low:max(low, high)] = [end]
    return sorted(accepted, key=lambda d: (d[0], d[1], d[2].order))


def base_places(line: bytes) -> list[tuple[int, str]]:
    """Word number and label of every place of a base phrase."""
    padded = b" " + line + b" "
    found = []
    for phrase, label in BASE.items():
        needle = f" {phrase} ".encode()
        at = padded.find(needle)
        words, counted = 0, 0
        while at >= 0:
            words += padded.count(b" ", counted, at)
            counted = at
            found.append((words, label))
            at = padded.find(needle, at + 1)
    return sorted(found)


def scan(text: bytes | None, scanner: Scanner) -> tuple[int, list[dict], list[dict]]:
    """Number of words, base places and detections; ``start`` and ``end`` count words from 0, ``end`` is not included."""
    words = letter_words(text or b"")
    line = b" ".join(words)
    base = [{"start": at, "label": label} for at, label in base_places(line)]
    told, number, counted = [], 0, 0
    for start, end, rule in settle(scanner.matches(line)):
        number += line.count(b" ", counted, start)
        counted = start
        told.append({"start": number, "end": number + line.count(b" ", start, end) + 1, "label": rule.label,
                     "kind": rule.kind, "confidence": rule.confidence})
    return len(words), base, told


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    if not _READY:
        _READY.append(Scanner(rules()))
    place = pa.struct([("start", pa.int64()), ("label", pa.string())])
    detection = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("kind", pa.string()),
                           ("confidence", pa.float64())])
    schema = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("base", pa.list_(place)),
                        ("detections", pa.list_(detection))])
    for batch in batches:
        counts, bases, found = [], [], []
        for text in batch.column(1):
            n, base, told = scan(text.as_py(), _READY[0])
            counts.append(n)
            bases.append(base)
            found.append(told)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(counts, pa.int64()), pa.array(bases, schema.field(2).type),
             pa.array(found, schema.field(3).type)], schema=schema)


def find_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_words, base, detections``: one row per input row, in one pass without a shuffle.

    Words are runs of digits, ASCII letters (lower-cased) and characters beyond ASCII. ``base`` lists the places of base
    phrases, ``detections`` what the rules found after suppression. A null or empty text has no words and empty lists.
    Repeated rows are told as often; an empty table gives no rows; other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(_scan, SCHEMA)
