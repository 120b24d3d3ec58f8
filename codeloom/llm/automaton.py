"""Regular expressions to one minimal deterministic automaton over bytes.

compile_rules() parses each rule (literals, escapes, classes, groups, `|`, `?`,
`*`, `+`, `{m,n}`), builds a nondeterministic automaton, makes it deterministic
by subset construction over byte classes, minimises it by partition refinement,
and returns transition arrays. Accepting states carry the set of rules as bits.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

MANY = -1


class _Parser:
    """Syntax trees: ("set", bytes), ("cat", [..]), ("alt", [..]), ("rep", tree, low, high)."""

    def __init__(self, pattern: str, either_case: bool):
        self.text, self.at, self.either = pattern, 0, either_case

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def take(self) -> str:
        self.at += 1
        return self.text[self.at - 1]

    def whole(self):
        tree = self.alternatives()
        if self.at != len(self.text):
            raise ValueError(f"unexpected {self.peek()!r} at {self.at} of {self.text!r}")
        return tree

    def alternatives(self):
        found = [self.sequence()]
        while self.peek() == "|":
            self.take()
            found.append(self.sequence())
        return found[0] if len(found) == 1 else ("alt", found)

    def sequence(self):
        found = []
        while self.peek() and self.peek() not in "|)":
            found.append(self.repeated(self.atom()))
        return ("cat", found)

    def repeated(self, tree):
        while self.peek() and self.peek() in "?*+{":
            kind = self.take()
            if kind == "{":
                end = self.text.index("}", self.at)
                low, comma, high = self.text[self.at : end].partition(",")
                self.at = end + 1
                tree = ("rep", tree, int(low), int(high) if high else (MANY if comma else int(low)))
            else:
                tree = ("rep", tree, int(kind == "+"), 1 if kind == "?" else MANY)
        return tree

    def atom(self):
        c = self.take()
        if c == "(":
            if self.text.startswith("?:", self.at):
                self.at += 2
            tree = self.alternatives()
            if self.take() != ")":
                raise ValueError(f"no end of group in {self.text!r}")
            return tree
        if c == "[":
            return self.members()
        if c == ".":
            return ("set", frozenset(range(256)) - {10})
        return ("set", self.cased(self.escaped() if c == "\\" else ord(c)))

    def escaped(self) -> int:
        c = self.take()
        if c == "x":
            self.at += 2
            return int(self.text[self.at - 2 : self.at], 16)
        return {"n": 10, "t": 9, "r": 13}.get(c, ord(c))

    def cased(self, byte: int) -> frozenset[int]:
        if byte > 127:
            raise ValueError("rules are of ASCII characters")
        return frozenset({byte, ord(chr(byte).swapcase())}) if self.either and chr(byte).isalpha() else frozenset({byte})

    def members(self):
        negated = self.peek() == "^"
        self.at += negated
        found: set[int] = set()
        while self.peek() != "]":
            c = self.take()
            low = self.escaped() if c == "\\" else ord(c)
            high = low
            if self.peek() == "-" and self.text[self.at + 1 : self.at + 2] != "]":
                self.take()
                c = self.take()
                high = self.escaped() if c == "\\" else ord(c)
            for b in range(low, high + 1):
                found |= self.cased(b)
        self.take()
        return ("set", frozenset(range(256)) - found if negated else frozenset(found))


def shortest(tree):
    """A tree whose matches end where a shortest match of the given one does: all that a search must see."""
    if tree[0] == "cat" and tree[1]:
        *before, last = tree[1]
        last = shortest(last)
        return shortest(("cat", before)) if last == ("cat", []) else ("cat", [*before, last])
    if tree[0] == "alt":
        return ("alt", [shortest(x) for x in tree[1]])
    if tree[0] == "rep":
        return ("cat", [tree[1]] * (tree[2] - 1) + [shortest(tree[1])]) if tree[2] else ("cat", [])
    return tree


class _States:
    """A nondeterministic automaton: free moves, and moves by sets of bytes."""

    def __init__(self):
        self.free: list[list[int]] = []
        self.moves: list[list[tuple[frozenset[int], int]]] = []

    def new(self) -> int:
        self.free.append([])
        self.moves.append([])
        return len(self.free) - 1

    def add(self, tree, start: int) -> int:
        """The state reached from start over what the tree matches."""
        if tree[0] == "set":
            end = self.new()
            self.moves[start].append((tree[1], end))
            return end
        if tree[0] == "cat":
            for part in tree[1]:
                start = self.add(part, start)
            return start
        if tree[0] == "alt":
            end = self.new()
            for part in tree[1]:
                first = self.new()
                self.free[start].append(first)
                self.free[self.add(part, first)].append(end)
            return end
        _, part, low, high = tree
        for _ in range(low):
            start = self.add(part, start)
        end = self.new()
        if high == MANY:
            first = self.new()
            self.free[start].append(first)
            self.free[first].append(end)
            self.free[self.add(part, first)].append(first)
            return end
        self.free[start].append(end)
        for _ in range(high - low):
            first = self.new()
            self.free[start].append(first)
            start = self.add(part, first)
            self.free[start].append(end)
        return end

    def closure(self, states) -> frozenset[int]:
        found, todo = set(states), list(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in found:
                    found.add(s)
                    todo.append(s)
        return frozenset(found)


@dataclass(frozen=True)
class Automaton:
    """next[state * n_classes + byte_class[byte]]; accepting states come last, from first_accept on; rules[state]: bits."""

    next: np.ndarray
    byte_class: np.ndarray
    n_classes: int
    rules: np.ndarray
    first_accept: int
    start: int
    dead: int

    def resets(self) -> np.ndarray:
        """Bytes after which nothing before matters: all states go to the same one, the start."""
        by_class = self.next.reshape(-1, self.n_classes)
        return (by_class == self.start).all(axis=0)[self.byte_class]

    def longest(self, data: bytes, at: int) -> int:
        """End of the longest match of any rule that begins at `at`, or -1. For automata without search."""
        state, end, table, classes, width = self.start, -1, self._table(), self._classes(), self.n_classes
        for i in range(at, len(data)):
            state = table[state * width + classes[data[i]]]
            if state >= self.first_accept:
                end = i + 1
            elif state == self.dead:
                break
        return end

    def _table(self) -> list[int]:
        if "_t" not in self.__dict__:
            object.__setattr__(self, "_t", self.next.tolist())
        return self.__dict__["_t"]

    def _classes(self) -> list[int]:
        if "_c" not in self.__dict__:
            object.__setattr__(self, "_c", self.byte_class.tolist())
        return self.__dict__["_c"]

    def first_bytes(self) -> np.ndarray:
        return (self.next.reshape(-1, self.n_classes)[self.start] != self.dead)[self.byte_class]


def compile_rules(patterns: list[tuple[str, bool]], *, search: bool) -> Automaton:
    """patterns: (expression, letters in either case). search: a match may begin anywhere."""
    states = _States()
    root = states.new()
    ends: dict[int, int] = {}
    for i, (pattern, either) in enumerate(patterns):
        first = states.new()
        states.free[root].append(first)
        tree = _Parser(pattern, either).whole()
        ends[states.add(shortest(tree) if search else tree, first)] = 1 << i
    kinds = {frozenset(x) for moves in states.moves for x, _ in moves}
    member = np.array([[b in k for k in kinds] for b in range(256)])
    _, sample, byte_class = np.unique(member, axis=0, return_index=True, return_inverse=True)
    byte_class, n_classes = byte_class.reshape(-1), len(sample)

    begin = states.closure([root])
    number, rows, accepts, todo = {begin: 0}, [], [], [begin]
    for now in todo:  # grows
        accepts.append(sum({ends[s] for s in now if s in ends}))
        row = []
        for b in sample.tolist():
            to = [t for s in now for x, t in states.moves[s] if b in x]
            after = states.closure([*to, root] if search else to)
            if after not in number:
                number[after] = len(number)
                todo.append(after)
            row.append(number[after])
        rows.append(row)
    table, accept = np.array(rows), np.array(accepts)

    label = np.unique(accept, return_inverse=True)[1].reshape(-1)
    while True:
        _, finer = np.unique(np.column_stack([label, label[table]]), axis=0, return_inverse=True)
        finer = finer.reshape(-1)
        if finer.max() == label.max():
            break
        label = finer
    one = np.unique(label, return_index=True)[1]
    order = np.argsort(accept[one] > 0, kind="stable")
    rank = np.empty(len(one), int)
    rank[order] = np.arange(len(one))
    merged, rules = rank[label[table[one[order]]]], accept[one[order]]
    own = (merged == np.arange(len(merged))[:, None]).all(axis=1) & (rules == 0)
    dead = int(np.flatnonzero(own)[0]) if own.any() and not search else -1
    return Automaton(merged.astype(np.int32).ravel(), byte_class.astype(np.uint8), n_classes, rules.astype(np.int64), int((rules == 0).sum()), int(rank[label[0]]), dead)
