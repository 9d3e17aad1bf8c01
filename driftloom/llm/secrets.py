"""Secret scan: all rules in one automaton, one pass over a text's bytes.

Where the combined automaton accepts the shortest form of a rule, that rule's backward automaton finds the leftmost start (not before
the end of the rule's last match) and its forward automaton the longest end. Both run only at matches. The spans of a
rule so are its leftmost, longest, non-overlapping matches; a rule's ``least`` drops those whose last group is short,
after they have used up their text.

Defined results: a null text is an empty one and has no spans; rows that repeat are scanned alike; texts of any
length are scanned whole; an empty table gives an empty table; other columns stay, clashing ones are replaced.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftloom.llm.automaton import Dfa, Parser, reverse
from driftloom.llm.common import in_batches, map_rows, small_batches, without


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    ignore_case: bool = False
    #: The least length of a match, or of its end in ``tail``, where that is set.
    least: int = 0
    #: The characters of the match's last group.
    tail: str = ""


VALUE = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
#: The base rules, in the order in which kinds that start together are listed.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=\-]+""", True, 6, VALUE),
    Rule("access", "AKIA[A-Z0-9]+", least=20),
    Rule("hex", "[0-9a-f]{24,}"),
)
#: Rules of published credential formats.
MORE = (
    Rule("github", "gh[pousr]_[A-Za-z0-9]+", least=40),
    Rule("slack", r"xox[abprs]\-[A-Za-z0-9\-]+", least=15),
    Rule("google", r"AIza[A-Za-z0-9_\-]+", least=39),
    Rule("stripe", "(sk|rk)_live_[A-Za-z0-9]+", least=32),
    Rule("jwt", r"eyJ[A-Za-z0-9_\-]+\.eyJ[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+", least=40),
    Rule("pem", r"\-\-\-\-\-BEGIN ([A-Z]+ )*PRIVATE KEY\-\-\-\-\-"),
    Rule("temporary", "ASIA[A-Z0-9]+", least=20),
)


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = BASE + MORE):
        trees = [Parser(r.pattern, r.ignore_case).parse() for r in rules]
        self.rules = rules
        self.all = Dfa(trees, anywhere=True)
        self.forward = [Dfa([t], anywhere=False) for t in trees]
        self.backward = [Dfa([reverse(t)], anywhere=False) for t in trees]

    def start(self, k: int, data: bytes, end: int, least: int) -> int:
        """The leftmost start, from least on, of a match of rule k that ends at end; -1 if there is none."""
        dfa, state, found = self.backward[k], 0, -1
        for i in range(end - 1, least - 1, -1):
            state = dfa.next[state][data[i]]
            if state == dfa.dead:
                break
            if dfa.accepts[state]:
                found = i
        return found

    def end(self, k: int, data: bytes, start: int) -> int:
        dfa, state, found = self.forward[k], 0, start
        for i in range(start, len(data)):
            state = dfa.next[state][data[i]]
            if state == dfa.dead:
                break
            if dfa.accepts[state]:
                found = i + 1
        return found

    def passes(self, k: int, match: bytes) -> bool:
        rule = self.rules[k]
        if not rule.tail:
            return len(match) >= rule.least
        # the last group: what follows the first separator, its blanks and its quote
        text = match.decode()
        at = next(i for i, c in enumerate(text) if c in ":=") + 1
        return len(text[at:].lstrip(" ").lstrip("\"'")) >= rule.least

    def matches(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, rule, end) in bytes, sorted."""
        found: list[tuple[int, int, int]] = []
        rows, first, accepts = self.all.next, self.all.first_accept, self.all.accepts
        used = [0] * len(self.rules)
        row, state = rows[0], 0
        for i, b in enumerate(data):
            state = row[b]
            row = rows[state]
            if state >= first:
                for k in accepts[state]:
                    if i + 1 > used[k] and (s := self.start(k, data, i + 1, used[k])) >= 0:
                        used[k] = e = self.end(k, data, s)
                        if self.passes(k, data[s:e]):
                            found.append((s, k, e))
        found.sort()
        return found

    def spans(self, text: str | None) -> list[tuple[int, int, int]]:
        """(start, rule, end) in code points."""
        if not text:
            return []
        data = text.encode()
        found = self.matches(data)
        if not found or len(data) == len(text):
            return found
        at, points, place = 0, 0, {}
        for p in sorted({p for s, _, e in found for p in (s, e)}):
            points += len(data[at:p].decode())
            at = place[p] = p
            place[p] = points
        return [(place[s], k, place[e]) for s, k, e in found]


@lru_cache(maxsize=2)
def scanner(rules: tuple[Rule, ...]) -> Scanner:
    """Compiled once for each Python worker."""
    return Scanner(rules)


def scan(df: DataFrame, text: str = "text", out: str = "secrets", rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """df with an array of (kind, start, end), in code points, end exclusive."""
    small_batches(df.sparkSession)
    df = without(df, out)
    place = df.columns.index(text)
    one = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        own = scanner(rules)
        for b in batches:
            made = [[{"kind": rules[k].kind, "start": s, "end": e} for s, k, e in own.spans(t)] for t in b.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, arrow)], names=[*b.schema.names, out])

    return in_batches(df, run, T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(one))]))


def digest(df: DataFrame) -> DataFrame:
    """The columns of op1, made from the spans."""
    rules = BASE + MORE

    def run(batches):
        own = scanner(rules)
        for keys, texts in batches:
            out = [keys, [], [], [], [], []]
            for t in texts:
                spans = own.spans(t)
                for k in range(3):
                    out[1 + k].append(sum(x[1] == k for x in spans))
                shown = [(k, f"{rules[k].kind}:{s}:{e}") for s, k, e in spans]
                out[4].append(hashlib.sha256(",".join(x for k, x in shown if k < 3).encode()).hexdigest())
                out[5].append(",".join(x for _, x in shown))
            yield out

    return map_rows(df, [F.col("doc_id"), F.col("text")], run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
