"""Regular expressions over bytes, compiled together into one deterministic automaton.

The dialect: literals, classes ``[...]`` with ranges and ``^``, escapes, groups, ``|`` and the quantifiers ``? * +``,
``{n}``, ``{n,}`` and ``{n,m}``. A rule list is parsed into a Thompson automaton, made deterministic by subset
construction and minimised by partition refinement; what is left are transition arrays over byte classes.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable

#: Byte escapes with a fixed meaning.
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "f": "\x0c", "v": "\x0b"}


class Parser:
    """A pattern as nested tuples: ("set", bytes), ("cat", parts), ("alt", parts), ("rep", part, least, most)."""

    def __init__(self, pattern: str, ignore_case: bool = False):
        self.p, self.i, self.fold = pattern, 0, ignore_case

    def parse(self):
        tree = self.alternatives()
        if self.i < len(self.p):
            raise ValueError(f"{self.p!r}: unexpected {self.p[self.i]!r}")
        return tree

    def peek(self) -> str:
        return self.p[self.i] if self.i < len(self.p) else ""

    def take(self) -> str:
        self.i += 1
        return self.p[self.i - 1]

    def alternatives(self):
        parts = [self.sequence()]
        while self.peek() == "|":
            self.take()
            parts.append(self.sequence())
        return parts[0] if len(parts) == 1 else ("alt", parts)

    def sequence(self):
        parts = []
        while self.peek() not in ("", "|", ")"):
            parts.append(self.repeated(self.atom()))
        return ("cat", parts)

    def repeated(self, tree):
        while (c := self.peek()) and c in "?*+{":
            self.take()
            if c == "{":
                spec = ""
                while self.peek() != "}":
                    spec += self.take()
                self.take()
                low, comma, high = spec.partition(",")
                tree = ("rep", tree, int(low), int(high) if high else None if comma else int(low))
            else:
                tree = ("rep", tree, int(c == "+"), 1 if c == "?" else None)
        return tree

    def char(self) -> int:
        c = self.take()
        if c == "\\":
            c = self.take()
            if c == "x":
                return int(self.take() + self.take(), 16)
            c = ESCAPES.get(c, c)
        if ord(c) > 127:
            raise ValueError("patterns are over ASCII")
        return ord(c)

    def cased(self, s: set[int]):
        if self.fold:
            s = s | {b ^ 32 for b in s if 65 <= b & ~32 <= 90 and b < 128}
        return ("set", frozenset(s))

    def atom(self):
        c = self.peek()
        if c == "(":
            self.take()
            tree = self.alternatives()
            if self.take() != ")":
                raise ValueError(f"{self.p!r}: unclosed group")
            return tree
        if c == ".":
            self.take()
            return ("set", frozenset(range(256)) - {10})
        if c != "[":
            return self.cased({self.char()})
        self.take()
        negative = self.peek() == "^"
        if negative:
            self.take()
        own: set[int] = set()
        while self.peek() != "]":
            low = self.char()
            if self.peek() == "-" and self.p[self.i + 1 : self.i + 2] != "]":
                self.take()
                own |= set(range(low, self.char() + 1))
            else:
                own.add(low)
        self.take()
        kind, own = self.cased(own)
        return (kind, frozenset(range(256)) - own) if negative else (kind, own)


def reverse(tree):
    """The pattern of the same strings, backwards."""
    kind = tree[0]
    if kind == "cat":
        return ("cat", [reverse(x) for x in reversed(tree[1])])
    if kind == "alt":
        return ("alt", [reverse(x) for x in tree[1]])
    return ("rep", reverse(tree[1]), *tree[2:]) if kind == "rep" else tree


class Nfa:
    def __init__(self):
        self.empty: list[list[int]] = []
        self.steps: list[list[tuple[frozenset[int], int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.steps.append([])
        return len(self.empty) - 1

    def add(self, tree, start: int) -> int:
        """Builds tree from start on; its end."""
        kind = tree[0]
        if kind == "set":
            end = self.state()
            self.steps[start].append((tree[1], end))
            return end
        if kind == "cat":
            for x in tree[1]:
                start = self.add(x, start)
            return start
        if kind == "alt":
            end = self.state()
            for x in tree[1]:
                first = self.state()
                self.empty[start].append(first)
                self.empty[self.add(x, first)].append(end)
            return end
        _, part, least, most = tree
        for _ in range(least):
            start = self.add(part, start)
        if most is None:
            first = self.state()
            self.empty[start].append(first)
            self.empty[self.add(part, first)].append(first)
            return first
        end = self.state()
        for _ in range(most - least):
            self.empty[start].append(end)
            start = self.add(part, start)
        self.empty[start].append(end)
        return end

    def closure(self, states: Iterable[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for t in self.empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)


class Dfa:
    """Transition rows ``next[state][byte]``; ``accepts[state]`` are the rules whose match may end there. State 0 starts."""

    def __init__(self, trees: list, anywhere: bool):
        """anywhere: a match may start at any byte, and its shortest form is told, which keeps open-ended rules from
        multiplying each other's states; else a match starts at the first byte (``dead``: none can follow)."""
        nfa = Nfa()
        root = nfa.state()
        ends = {nfa.add(t, self.linked(nfa, root)): k for k, t in enumerate(trees)}
        if anywhere:
            for s in ends:
                nfa.steps[s], nfa.empty[s] = [], []
        classes = self.byte_classes(nfa)
        start = nfa.closure([root])
        number, rows, accepts, todo = {start: 0}, [], [], [start]
        for states in todo:
            accepts.append(frozenset(ends[s] for s in states if s in ends))
            row = []
            for c in classes:
                to = {t for s in states for own, t in nfa.steps[s] if c[0] in own}
                to = nfa.closure(to | {root} if anywhere else to)
                if to not in number:
                    number[to] = len(number)
                    todo.append(to)
                row.append(number[to])
            rows.append(row)
        rows, accepts = self.minimised(rows, accepts)
        of = {b: k for k, c in enumerate(classes) for b in c}
        # states that accept come last, so that one comparison tells them
        order = sorted(range(len(rows)), key=lambda s: (s != 0 and bool(accepts[s]), s))
        new = {s: k for k, s in enumerate(order)}
        self.next = [[new[rows[s][of[b]]] for b in range(256)] for s in order]
        self.accepts = [accepts[s] for s in order]
        self.first_accept = next((k for k, a in enumerate(self.accepts) if a), len(order))
        self.dead = next((k for k, row in enumerate(self.next) if not self.accepts[k] and all(t == k for t in row)), -1)

    @staticmethod
    def linked(nfa: Nfa, root: int) -> int:
        s = nfa.state()
        nfa.empty[root].append(s)
        return s

    @staticmethod
    def byte_classes(nfa: Nfa) -> list[list[int]]:
        """Bytes that no transition tells apart."""
        sets = sorted({own for steps in nfa.steps for own, _ in steps}, key=sorted)
        groups = defaultdict(list)
        for b in range(256):
            groups[tuple(b in s for s in sets)].append(b)
        return list(groups.values())

    @staticmethod
    def minimised(rows: list[list[int]], accepts: list[frozenset[int]]):
        kinds = {a: k for k, a in enumerate(dict.fromkeys(accepts))}
        block, n = [kinds[a] for a in accepts], 0
        while True:
            seen: dict = {}
            new = [seen.setdefault((block[s], *[block[t] for t in rows[s]]), len(seen)) for s in range(len(rows))]
            if len(seen) == n:
                break
            block, n = new, len(seen)
        first = {}
        for s, b in enumerate(block):
            first.setdefault(b, s)
        return [[block[t] for t in rows[first[b]]] for b in range(n)], [accepts[first[b]] for b in range(n)]
