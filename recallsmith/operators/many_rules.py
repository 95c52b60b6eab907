"""Thousands of rules over files: one automaton finds the literals that rules need, only then their patterns are tried.

Rules are a table (rule_id, glob, pattern, severity, message), so the plan is of one size however many there are. From each
pattern the words are taken of which every match has one (required()); an Aho-Corasick automaton over the words of all rules
reads each file once, and the patterns of the rules whose words are there are searched. Rules whose patterns need no word are
tried on every file that their glob fits.

Patterns are Python's, with ASCII classes and folding. Cases: a null path or content has no findings; a null severity or message stays null; a rule
whose id, glob or pattern is null fits nothing; rules of one id each count; a pattern that can't be read, or of over MOST_PATTERN characters, is an error before any file is read;
repeated files are told each; an empty table on either side gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallsmith.operators.rules import glob_regex

#: Rules of at most this many bytes in all go to every task; larger tables are dealt into parts of this size, each a scan of the files.
PART_BYTES = 8 << 20
MOST_PATTERN = 1024
#: Shorter words tell too little.
LEAST_WORD = 3


def required(pattern: str) -> frozenset[str]:
    """Lower-cased words of which any match of the pattern has one; empty if none can be told."""
    from re import _constants as c
    from re import _parser

    def best(found: list[frozenset[str]]) -> frozenset[str]:
        told = [x for x in found if x and min(map(len, x)) >= LEAST_WORD]
        return max(told, key=lambda x: (min(map(len, x)), -len(x)), default=frozenset())

    def of(nodes) -> frozenset[str]:
        found, run = [], ""
        for op, arg in nodes:
            if op is c.LITERAL and arg < 128:
                run += chr(arg).lower()
                continue
            if op is not c.AT:  # a place between characters ends no word
                found.append(frozenset([run] if run else []))
                run = ""
            if op is c.SUBPATTERN:
                found.append(of(arg[-1]))
            elif op is c.BRANCH:
                ways = [of(x) for x in arg[1]]
                found.append(frozenset().union(*ways) if all(ways) else frozenset())
            elif op in (c.MAX_REPEAT, c.MIN_REPEAT) and arg[0] > 0:
                found.append(of(arg[2]))
        return best([*found, frozenset([run] if run else [])])

    return of(_parser.parse(pattern, re.ASCII))


class Rules:
    """Rules as an automaton of words and the patterns behind them."""

    def __init__(self, rows: list[tuple], override: str) -> None:
        self.rows, self.override = [r for r in rows if None not in r[:3]], override
        self.words: dict[str, list[int]] = {}
        self.always = []
        for k, (rule_id, _, pattern, *_) in enumerate(self.rows):
            if len(pattern) > MOST_PATTERN:
                raise ValueError(f"pattern of {rule_id} is too long")
            try:
                re.compile(pattern, re.ASCII)
            except re.error as e:
                raise ValueError(f"pattern of {rule_id}: {e}") from e
            need = required(pattern)
            for w in need:
                self.words.setdefault(w, []).append(k)
            if not need:
                self.always.append(k)

    def searcher(self):
        """A function from path and content to the numbers of the rules that find something; made once in each task."""
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for w, ks in self.words.items():
            automaton.add_word(w, ks)
        if self.words:
            automaton.make_automaton()
        compiled: dict[int, re.Pattern] = {}
        fits = lru_cache(1 << 16)(lambda glob, path: re.match(glob_regex(glob), path, re.DOTALL) is not None)

        def search(path: str | None, content: str | None) -> list[int]:
            if path is None or content is None:
                return []
            low = content.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # folds ASCII letters only
            some = set(self.always)
            for _, ks in automaton.iter(low) if self.words else ():
                some.update(ks)
            out = []
            for k in sorted(some):
                rule_id, glob, pattern = self.rows[k][:3]
                if k not in compiled:
                    compiled[k] = re.compile(pattern, re.ASCII)
                if fits(glob, path) and compiled[k].search(content) and f"{self.override} {rule_id}" not in content:
                    out.append(k)
            return out

        return search


def violations(files: DataFrame, rules: DataFrame, override: str = "rule:allow") -> DataFrame:
    """(path, rule_id, severity, message) of files (path, content) that a rule of the table finds something in, unless the file allows it."""
    rows = rules.select(*(F.col(c).cast("string") for c in ("rule_id", "glob", "pattern", "severity", "message")))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("pattern") + F.octet_length("rule_id") + F.coalesce(F.octet_length("message"), F.lit(0))), F.lit(0))).first()[0]
    parts, out = -(-int(size) // PART_BYTES) or 1, None
    for n in range(parts):
        mine = rows.where(F.pmod(F.xxhash64("rule_id", "pattern"), F.lit(parts)) == n) if parts > 1 else rows
        some = Rules(sorted(map(tuple, mine.collect()), key=lambda r: [x or "" for x in r]), override)

        def run(it: Iterator[pa.RecordBatch], some: Rules = some) -> Iterator[pa.RecordBatch]:
            search = some.searcher()
            for b in it:
                got = [(p, some.rows[k]) for p, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for k in search(p, t)]
                cols = [[p for p, _ in got], *([r[i] for _, r in got] for i in (0, 3, 4))]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in cols], ["path", "rule_id", "severity", "message"])

        found = files.select(F.col("path").cast("string"), F.col("content").cast("string")).mapInArrow(lambda it, run=run: run(it), "path string, rule_id string, severity string, message string")
        out = found if out is None else out.unionByName(found)
    return out
