"""Regular expressions over bytes, compiled together into one minimal deterministic automaton.

The syntax is literals, escapes, classes, groups, alternation and the quantifiers
? * + {m} {m,} {m,n}. All rules become one nondeterministic automaton that may start at any
byte; subset construction and partition refinement give the transition array.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_NAMED = {"d": b"0123456789", "w": b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_", "s": b" \t\n\r\f\v"}
_CONTROL = {"n": 10, "t": 9, "r": 13}


def _bits(values) -> int:
    out = 0
    for v in values:
        out |= 1 << v
    return out


_ALL = (1 << 256) - 1


class _Parser:
    def __init__(self, source: str):
        self.raw, self.at = source.encode(), 0

    def peek(self) -> str:
        return chr(self.raw[self.at]) if self.at < len(self.raw) else ""

    def next(self) -> str:
        c = self.peek()
        if not c:
            raise ValueError(f"the expression ends too early: {self.raw.decode()}")
        self.at += 1
        return c

    def alternatives(self):
        options = [self.sequence()]
        while self.peek() == "|":
            self.next()
            options.append(self.sequence())
        return ("alt", options) if len(options) > 1 else options[0]

    def sequence(self):
        parts = []
        while self.peek() not in ("", "|", ")"):
            parts.append(self.repeated(self.atom()))
        return ("cat", parts)

    def repeated(self, node):
        while (c := self.peek()) in ("?", "*", "+", "{") and c:
            self.next()
            if c == "{":
                body = ""
                while (d := self.next()) != "}":
                    body += d
                low, comma, high = body.partition(",")
                node = ("rep", node, int(low), (int(high) if high else None) if comma else int(low))
            else:
                node = ("rep", node, *{"?": (0, 1), "*": (0, None), "+": (1, None)}[c])
        return node

    def escape(self) -> int:
        c = self.next()
        if c in _NAMED:
            return _bits(_NAMED[c])
        if c in "DWS":
            return _ALL & ~_bits(_NAMED[c.lower()])
        if c == "x":
            return 1 << int(self.next() + self.next(), 16)
        return 1 << _CONTROL.get(c, ord(c))

    def atom(self):
        c = self.next()
        if c == "(":
            if self.raw[self.at : self.at + 2] == b"?:":
                self.at += 2
            inner = self.alternatives()
            if self.next() != ")":
                raise ValueError("a group isn't closed")
            return inner
        if c == "[":
            return ("set", self.members())
        if c == ".":
            return ("set", _ALL & ~(1 << 10))
        if c == "\\":
            return ("set", self.escape())
        if c in "*+?{":
            raise ValueError(f"nothing to repeat: {self.raw.decode()}")
        return ("set", 1 << ord(c))

    def members(self) -> int:
        negate = self.peek() == "^"
        if negate:
            self.next()
        out, first = 0, True
        while (c := self.next()) != "]" or first:
            first = False
            one = self.escape() if c == "\\" else 1 << ord(c)
            if self.peek() == "-" and self.raw[self.at + 1 : self.at + 2] != b"]" and one & (one - 1) == 0:
                self.next()
                last = self.next()
                top = (self.escape() if last == "\\" else 1 << ord(last)).bit_length() - 1
                one = _bits(range(one.bit_length() - 1, top + 1))
            out |= one
        return _ALL & ~out if negate else out


def parse(source: str):
    p = _Parser(source)
    node = p.alternatives()
    if p.peek():
        raise ValueError(f"unbalanced ): {source}")
    return node


def longest(node) -> int | None:
    """Bytes of the longest match; None if there is no bound."""
    kind = node[0]
    if kind == "set":
        return 1
    if kind == "rep":
        inner = longest(node[1])
        return None if node[3] is None or inner is None else inner * node[3]
    sizes = [longest(x) for x in node[1]]
    return None if None in sizes else (sum(sizes) if kind == "cat" else max(sizes))


def reverse(node):
    kind = node[0]
    if kind == "set":
        return node
    if kind == "rep":
        return (kind, reverse(node[1]), *node[2:])
    return (kind, [reverse(x) for x in (node[1][::-1] if kind == "cat" else node[1])])


class _Nfa:
    def __init__(self):
        self.empty: list[list[int]] = []
        self.moves: list[list[tuple[int, int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.moves.append([])
        return len(self.empty) - 1

    def add(self, node, start: int) -> int:
        """Adds the node's automaton from `start`; its end state."""
        kind = node[0]
        if kind == "set":
            end = self.state()
            self.moves[start].append((node[1], end))
            return end
        if kind == "cat":
            for x in node[1]:
                start = self.add(x, start)
            return start
        if kind == "alt":
            end = self.state()
            for x in node[1]:
                s = self.state()
                self.empty[start].append(s)
                self.empty[self.add(x, s)].append(end)
            return end
        _, inner, low, high = node
        for _ in range(low):
            start = self.add(inner, start)
        if high is None:
            loop = self.state()
            self.empty[start].append(loop)
            self.empty[self.add(inner, loop)].append(loop)
            return loop
        end = self.state()
        for _ in range(high - low):
            self.empty[start].append(end)
            start = self.add(inner, start)
        self.empty[start].append(end)
        return end


@dataclass(frozen=True)
class Automaton:
    """States are numbered so that the accepting ones come last, from `accept_from` on;
    `table` holds states already multiplied by the number of byte classes."""

    classes: np.ndarray  # byte -> class
    table: np.ndarray  # flat: state * n_classes + class -> next state * n_classes
    start: int
    accept_from: int
    rules: np.ndarray  # of each state, the bit set of the rules that end in it

    @property
    def n_classes(self) -> int:
        return int(self.classes.max()) + 1

    def rules_at(self, state: int) -> int:
        return int(self.rules[state // self.n_classes])

    def dead(self) -> int:
        """The state from which nothing is accepted any more, -1 if there is none."""
        rows = self.table.reshape(-1, self.n_classes)
        own = np.arange(len(rows), dtype=rows.dtype)[:, None] * self.n_classes
        found = np.flatnonzero((rows == own).all(1) & (own[:, 0] < self.accept_from))
        return int(found[0]) * self.n_classes if len(found) else -1


def compile_rules(nodes: list, anywhere: bool = True) -> Automaton:
    """One automaton for all the rules; with `anywhere` a match may start at any byte."""
    nfa = _Nfa()
    root = nfa.state()
    ends: dict[int, int] = {}
    for k, node in enumerate(nodes):
        s = nfa.state()
        nfa.empty[root].append(s)
        e = nfa.add(node, s)
        ends[e] = ends.get(e, 0) | 1 << k
    n = len(nfa.empty)

    sets = sorted({m for moves in nfa.moves for m, _ in moves})
    kinds: dict[tuple, int] = {}
    classes = np.array([kinds.setdefault(tuple(m >> b & 1 for m in sets), len(kinds)) for b in range(256)], np.uint8)
    width = len(kinds)
    byte_of = [int(np.flatnonzero(classes == c)[0]) for c in range(width)]

    closure = [0] * n
    for s in range(n):
        seen, stack = 1 << s, [s]
        while stack:
            for t in nfa.empty[stack.pop()]:
                if not seen >> t & 1:
                    seen |= 1 << t
                    stack.append(t)
        closure[s] = seen
    targets = [[0] * width for _ in range(n)]
    for s in range(n):
        for m, t in nfa.moves[s]:
            for c in range(width):
                if m >> byte_of[c] & 1:
                    targets[s][c] |= closure[t]
    live = _bits(s for s in range(n) if nfa.moves[s] or s in ends)  # the rest only pass on

    begin = closure[root] & live
    number, order, rows = {begin: 0}, [begin], []
    for current in order:  # grows while it is walked
        members, rest = [], current
        while rest:
            low = rest & -rest
            members.append(low.bit_length() - 1)
            rest ^= low
        row = []
        for c in range(width):
            nxt = begin if anywhere else 0
            for s in members:
                nxt |= targets[s][c]
            nxt &= live
            if nxt not in number:
                number[nxt] = len(order)
                order.append(nxt)
            row.append(number[nxt])
        rows.append(row)
    table = np.array(rows, np.int64)
    accepts = np.array([_or(ends[s] for s in ends if states >> s & 1) for states in order], object)

    _, label = np.unique(np.array([str(a) for a in accepts]), return_inverse=True)
    while True:
        _, finer = np.unique(np.column_stack([label, label[table]]), axis=0, return_inverse=True)
        finer = finer.ravel()
        if finer.max() == label.max():
            break
        label = finer
    count = int(label.max()) + 1
    first = np.array([int(np.flatnonzero(label == k)[0]) for k in range(count)])
    by_accept = sorted(range(count), key=lambda k: (accepts[first[k]] != 0, k))
    place = np.empty(count, np.int64)
    place[by_accept] = np.arange(count)
    small = np.empty((count, width), np.int64)
    small[place] = place[label[table[first]]]
    rules = np.empty(count, object)
    rules[place] = accepts[first]
    plain = sum(r == 0 for r in rules)
    return Automaton(classes, (small * width).astype(np.int32).ravel(), int(place[label[0]]) * width, plain * width, rules)


def _or(values) -> int:
    out = 0
    for v in values:
        out |= v
    return out
