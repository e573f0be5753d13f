"""Operator 10: license scans by ordered signature rules.

A text passes three gates. Words that every rule needs one of are looked up in
the whole Arrow batch; an Aho-Corasick automaton then finds which keywords
occur in the texts that are left; only rules whose keywords all occur run their
pattern over the text. The gates never change the result, since a rule's
keywords are part of all that its pattern matches.

Overlaps are resolved in the order of priority, length, position and rule: a
detection goes if it lies within one that stands, or overlaps one that stands
with a higher priority.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import picked, tune
from inkwell.llm.license_rules import RULES, Rule


@cache
def _compiled() -> tuple[re.Pattern, ...]:
    # ASCII only, so that a pattern can't match what the lower-casing of the gates doesn't
    return tuple(re.compile(r.pattern, re.IGNORECASE | re.ASCII) for r in RULES)


@cache
def _roots() -> tuple[str, ...]:
    """Few keywords of which every rule has one, found greedily."""
    left, roots = list(RULES), []
    while left:
        words = [k for r in left for k in r.keywords]
        best = max(sorted(set(words)), key=words.count)
        roots.append(best)
        left = [r for r in left if best not in r.keywords]
    return tuple(r for r in roots if not any(o != r and o in r for o in roots))


@cache
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for k in sorted({k for r in RULES for k in r.keywords}):
        found.add_word(k, k)
    found.make_automaton()
    return found


def _ascii_lower(text: str) -> str:
    return text.lower() if text.isascii() else text.translate(_ASCII)


_ASCII = {c: c + 32 for c in range(65, 91)}


def candidates(text: str) -> list[Rule]:
    """The rules whose keywords all occur in ``text``."""
    have = {k for _, k in _automaton().iter(_ascii_lower(text))}
    return [r for r in RULES if have.issuperset(r.keywords)]


def resolved(found: list[tuple[int, int, Rule]]) -> list[tuple[int, int, Rule]]:
    """The detections (start, end, rule) that stand, by position."""
    stand: list[tuple[int, int, Rule]] = []
    for a, b, rule in sorted(found, key=lambda d: (-d[2].priority, d[0] - d[1], d[0], d[2].number)):
        clash = any((x <= a and b <= y) or (a < y and x < b and r.priority > rule.priority) for x, y, r in stand)
        if not clash:
            stand.append((a, b, rule))
    return sorted(stand, key=lambda d: (d[0], d[1], d[2].number))


def scan(text: str) -> list[tuple[int, int, Rule]]:
    """The detections of a whole text: (start, end, rule) in characters."""
    patterns = _compiled()
    found = [(m.start(), m.end(), r) for r in candidates(text) for m in patterns[r.number].finditer(text) if m.end() > m.start()]
    return _by_clusters(found)


def _by_clusters(found: list[tuple[int, int, Rule]]) -> list[tuple[int, int, Rule]]:
    """Resolve each run of overlapping detections on its own; runs don't touch each other."""
    out: list[tuple[int, int, Rule]] = []
    run: list[tuple[int, int, Rule]] = []
    reach = -1
    for d in sorted(found, key=lambda d: (d[0], d[1], d[2].number)):
        if run and d[0] >= reach:
            out += resolved(run)
            run = []
        reach = max(reach, d[1]) if run else d[1]
        run.append(d)
    return out + (resolved(run) if run else [])


def scan_licenses(docs: DataFrame) -> DataFrame:
    """(doc_id, license, rule, priority, start, end, matched): one row for each detection.

    ``rule`` is the rule's number in the table, ``start`` and ``end`` are
    character positions in the text and ``matched`` is what stands there.

    Null and empty texts have no detections, and so give no rows. Very long texts
    are scanned whole. Rows that
    repeat an id give their rows each. Null ids are kept. An empty table gives
    no rows. Other columns are ignored, whatever their names.
    """
    tune(docs.sparkSession)
    kind = pa.list_(pa.struct([("license", pa.string()), ("rule", pa.int32()), ("priority", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("matched", pa.string())]))

    gate = "|".join(re.escape(r) for r in _roots())

    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            texts = pc.fill_null(batch.cast(pa.large_string()), "")
            maybe = pc.match_substring_regex(texts, gate, ignore_case=True)
            out: list[list[dict]] = [[] for _ in range(len(texts))]
            for i in pc.indices_nonzero(maybe).to_pylist():
                t = texts[i].as_py()
                out[i] = [{"license": r.license, "rule": r.number, "priority": r.priority, "start": a, "end": b, "matched": t[a:b]} for a, b, r in scan(t)]
            yield pa.array(out, kind)

    typed = "array<struct<license:string,rule:int,priority:int,start:int,end:int,matched:string>>"
    found = picked(docs, doc_id="doc_id", text="text").select("doc_id", F.arrow_udf(find, typed).asNondeterministic()("text").alias("found"))
    return found.select("doc_id", F.explode("found").alias("d")).select("doc_id", "d.*")
