"""Byte automata: a small regex syntax compiled by subset construction and minimised into transition arrays.

Syntax: literals, classes ``[...]``, groups ``(...)``, ``|``, ``?``, ``*``, ``+``, ``{n}``, ``{n,}``, ``\\xHH`` and escaped
literals; ASCII only.  ``ignore_case`` folds letters.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

import numpy as np

#: A byte that no UTF-8 text holds: it stands between texts and takes every state back to the start.
SEPARATOR = 0xFF
LANE = 1024


class _Nfa:
    def __init__(self) -> None:
        self.empty: list[list[int]] = []
        self.edge: list[tuple[frozenset[int], int] | None] = []

    def state(self) -> int:
        self.empty.append([])
        self.edge.append(None)
        return len(self.empty) - 1


class _Parser:
    """Recursive descent over the pattern; each node is a function that adds a fragment (start, end) to an NFA."""

    def __init__(self, pattern: str, ignore_case: bool) -> None:
        self.p, self.i, self.fold = pattern, 0, ignore_case

    def peek(self) -> str:
        return self.p[self.i : self.i + 1]

    def choice(self):
        options = [self.sequence()]
        while self.peek() == "|":
            self.i += 1
            options.append(self.sequence())
        return options[0] if len(options) == 1 else ("or", options)

    def sequence(self):
        items = []
        while self.peek() and self.peek() not in "|)":
            items.append(self.repeated())
        return ("and", items)

    def repeated(self):
        node = self.atom()
        while (c := self.peek()) and c in "?*+{":
            if c == "{":
                end = self.p.index("}", self.i)
                low, comma, high = self.p[self.i + 1 : end].partition(",")
                self.i = end + 1
                most = int(high) if high else None if comma else int(low)
                node = ("repeat", node, int(low), most)
            else:
                self.i += 1
                node = ("repeat", node, int(c == "+"), 1 if c == "?" else None)
        return node

    def atom(self):
        c = self.peek()
        self.i += 1
        if c == "(":
            node = self.choice()
            self.i += 1
            return node
        if c == "[":
            return ("set", self.members())
        return ("set", self.folded({ord(self.escaped() if c == "\\" else c)}))

    def escaped(self) -> str:
        c = self.peek()
        self.i += 1
        if c == "x":
            self.i += 2
            return chr(int(self.p[self.i - 2 : self.i], 16))
        return c

    def member(self) -> str:
        c = self.peek()
        self.i += 1
        return self.escaped() if c == "\\" else c

    def members(self) -> frozenset[int]:
        out: set[int] = set()
        while self.peek() != "]":
            low = high = self.member()
            if self.peek() == "-" and self.p[self.i + 1] != "]":
                self.i += 1
                high = self.member()
            out |= set(range(ord(low), ord(high) + 1))
        self.i += 1
        return self.folded(out)

    def folded(self, values: set[int]) -> frozenset[int]:
        if self.fold:
            values = values | {ord(chr(v).swapcase()) for v in values if chr(v) in string.ascii_letters}
        return frozenset(values)


def _fragment(nfa: _Nfa, node) -> tuple[int, int]:
    start, kind = nfa.state(), node[0]
    at = start
    if kind == "set":
        end = nfa.state()
        nfa.edge[start] = (node[1], end)
        return start, end
    if kind == "and":
        for item in node[1]:
            a, b = _fragment(nfa, item)
            nfa.empty[at].append(a)
            at = b
        return start, at
    if kind == "or":
        end = nfa.state()
        for item in node[1]:
            a, b = _fragment(nfa, item)
            nfa.empty[start].append(a)
            nfa.empty[b].append(end)
        return start, end
    _, item, low, high = node
    for _ in range(low):
        a, b = _fragment(nfa, item)
        nfa.empty[at].append(a)
        at = b
    end = nfa.state()
    nfa.empty[at].append(end)
    if high is None:
        a, b = _fragment(nfa, item)
        nfa.empty[at].append(a)
        nfa.empty[b] += [a, end]
    else:
        for _ in range(high - low):
            a, b = _fragment(nfa, item)
            nfa.empty[at].append(a)
            nfa.empty[b].append(end)
            at = b
    return start, end


@dataclass
class Automaton:
    """``table[state + class_of[byte]]`` is the next state; states are multiples of the number of classes; 0 is the start.
    ``accepts[state // classes]`` has a bit for each rule that ends there."""

    table: np.ndarray
    class_of: np.ndarray
    classes: int
    accepts: np.ndarray

    def states(self, data: np.ndarray) -> np.ndarray:
        """The state after each byte, in one pass: the bytes are cut into lanes that run side by side from the start
        state; a lane whose true first state differs is run again until it meets the states it already has."""
        lanes = max(1, len(data) // LANE)
        depth = -(-len(data) // lanes)
        classes = np.full(lanes * depth, self.class_of[SEPARATOR], np.int32)
        classes[: len(data)] = self.class_of[data]
        classes = np.ascontiguousarray(classes.reshape(lanes, depth).T)
        out = np.empty((depth, lanes), np.int32)
        now = np.zeros(lanes, np.int32)
        for j in range(depth):
            now = self.table[now + classes[j]]
            out[j] = now
        began = np.zeros(lanes, np.int32)
        while True:
            entry = np.concatenate((began[:1], out[-1, :-1]))
            lane = np.flatnonzero(entry != began)
            if not len(lane):
                return out.T.reshape(-1)[: len(data)]
            began[lane] = entry[lane]
            now = entry[lane]
            for j in range(depth):
                now = self.table[now + classes[j, lane]]
                differs = out[j, lane] != now
                out[j, lane] = now
                lane, now = lane[differs], now[differs]
                if not len(lane):
                    break

    def hits(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of bytes at which some rule ends, and the rules' bits."""
        bits = self.accepts[self.states(data) // self.classes]
        at = np.flatnonzero(bits)
        return at, bits[at]

    def longest(self, data: bytes, start: int, rule: int) -> int:
        """End of the longest match of a rule that is known to begin at start, for rules whose matches, once long enough, go on
        byte by byte: it stops at the first byte after which the match no longer ends."""
        state, best, table, class_of, classes, accepts = 0, -1, self._table, self._class_of, self.classes, self._accepts
        for i in range(start, len(data)):
            state = table[state + class_of[data[i]]]
            if accepts[state // classes] >> rule & 1:
                best = i + 1
            elif best > 0:
                break
        return best

    def __post_init__(self) -> None:
        self._table, self._class_of, self._accepts = self.table.tolist(), self.class_of.tolist(), self.accepts.tolist()


def _turned(node):
    """The same expression for the bytes in reverse order."""
    kind = node[0]
    if kind == "and":
        return ("and", [_turned(n) for n in node[1][::-1]])
    if kind == "or":
        return ("or", [_turned(n) for n in node[1]])
    return node if kind == "set" else ("repeat", _turned(node[1]), *node[2:])


def compile_rules(rules: list[tuple[str, bool]], backwards: bool = False) -> Automaton:
    """One automaton that looks for all (pattern, ignore_case) rules from every position; backwards it reads bytes in reverse
    order, so that it accepts where matches begin."""
    nfa = _Nfa()
    root = nfa.state()
    ends: dict[int, int] = {}
    for bit, (pattern, ignore_case) in enumerate(rules):
        node = _Parser(pattern, ignore_case).choice()
        a, b = _fragment(nfa, _turned(node) if backwards else node)
        nfa.empty[root].append(a)
        ends[b] = 1 << bit

    def closure(states: set[int]) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for t in nfa.empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(s for s in seen if nfa.edge[s] is not None or s in ends)

    # Bytes that every edge treats alike form a class; the separator has its own.
    sets = sorted({e[0] for e in nfa.edge if e}, key=sorted)
    signature: dict[tuple, int] = {}
    class_of = np.zeros(256, np.int32)
    for byte in range(256):
        class_of[byte] = signature.setdefault((byte == SEPARATOR, *(byte in s for s in sets)), len(signature))
    sample = {c: b for b, c in enumerate(class_of.tolist())}
    n = len(signature)

    start = closure({root})
    index, rows, todo = {start: 0}, [], [start]
    for current in todo:
        row = []
        for c in range(n):
            byte = sample[c]
            target = start
            if byte != SEPARATOR:
                target = start | closure({e[1] for s in current if (e := nfa.edge[s]) and byte in e[0]})
            if target not in index:
                index[target] = len(index)
                todo.append(target)
            row.append(index[target])
        rows.append(row)
    table = np.array(rows)
    mask = np.array([sum({ends[s] for s in states if s in ends}) for states in index], np.int64)

    # Minimisation: states stay together while they accept alike and move to the same groups.
    group = np.unique(mask, return_inverse=True)[1]
    while True:
        _, finer = np.unique(np.column_stack((group, group[table])), axis=0, return_inverse=True)
        finer = finer.ravel()
        if finer.max() == group.max():
            break
        group = finer
    order = np.full(group.max() + 1, -1)
    order[group[0]] = 0
    k = 1
    for g in group.tolist():
        if order[g] < 0:
            order[g] = k
            k += 1
    group = order[group]
    _, member = np.unique(group, return_index=True)
    small = group[table[member]]
    return Automaton((small * n).astype(np.int32).ravel(), class_of, n, mask[member])
