"""Many regular expressions as one deterministic automaton over bytes, in transition arrays.

The expressions are read into one nondeterministic automaton with a tag for each
expression; subset construction over classes of bytes that no expression tells
apart makes it deterministic, and partition refinement makes it minimal. In a
searching automaton a match may start at every byte, in an anchored one it
starts at the first. Expressions are literals, classes, groups, alternatives and
the repeats ? * + {m} {m,} {m,n}; all are over bytes.

`Automaton.states` runs a searching automaton over many lanes of text at once, each
lane from the state that it would have if nothing were under way before it; lanes
where this guess was wrong are run again from the state that the lane before them
ended in, until all agree. So each byte is looked at once, and few of them again.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

LANE = 256

# Expressions ---------------------------------------------------------------

ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "f": "\f", "v": "\v"}


class Nfa:
    """Nodes with one labelled edge (a set of bytes) or up to any number of free ones."""

    def __init__(self):
        self.label: list[frozenset[int] | None] = []
        self.after: list[list[int]] = []

    def node(self, label: frozenset[int] | None = None, *after: int) -> int:
        self.label.append(label)
        self.after.append(list(after))
        return len(self.label) - 1


class Reader:
    """Adds one expression to an automaton: each part takes the node that follows it and gives the node it starts at."""

    def __init__(self, nfa: Nfa, text: str):
        self.nfa, self.text, self.at = nfa, text, 0

    def peek(self) -> str:
        return self.text[self.at] if self.at < len(self.text) else ""

    def next(self) -> str:
        self.at += 1
        return self.text[self.at - 1]

    def expression(self, accept: int) -> int:
        tree = self.alternatives()
        if self.at < len(self.text):
            raise ValueError(f"unexpected {self.peek()!r} at {self.at} of {self.text!r}")
        return self.build(tree, accept)

    def alternatives(self):
        options = [self.sequence()]
        while self.peek() == "|":
            self.next()
            options.append(self.sequence())
        return options[0] if len(options) == 1 else ("any", options)

    def sequence(self):
        items = []
        while self.peek() not in ("", "|", ")"):
            items.append(self.repeat(self.atom()))
        return ("all", items)

    def repeat(self, item):
        while self.peek() in ("?", "*", "+", "{"):
            c = self.next()
            if c == "{":
                stop = self.text.index("}", self.at)
                least, _, most = self.text[self.at : stop].partition(",")
                bounded = most or "," not in self.text[self.at : stop]
                item = ("times", item, int(least), int(most or least) if bounded else None)
                self.at = stop + 1
            else:
                item = ("times", item, int(c == "+"), 1 if c == "?" else None)
        return item

    def atom(self):
        c = self.next()
        if c == "(":
            if self.text.startswith("?:", self.at):
                self.at += 2
            tree = self.alternatives()
            if self.peek() != ")":
                raise ValueError(f"group without an end in {self.text!r}")
            self.next()
            return tree
        if c == "[":
            return ("byte", self.members())
        if c == ".":
            return ("byte", frozenset(range(256)) - {10})
        if c == "\\":
            return ("byte", frozenset({self.escaped()}))
        octets = c.encode()
        return ("byte", frozenset(octets)) if len(octets) == 1 else ("all", [("byte", frozenset({b})) for b in octets])

    def escaped(self) -> int:
        c = self.next()
        if c == "x":
            self.at += 2
            return int(self.text[self.at - 2 : self.at], 16)
        return ord(ESCAPES.get(c, c))

    def members(self) -> frozenset[int]:
        inverse = self.peek() == "^"
        self.at += inverse
        found: set[int] = set()
        first = True
        while first or self.peek() != "]":
            first = False
            lo = self.member()
            if self.peek() == "-" and self.text[self.at + 1 : self.at + 2] != "]":
                self.next()
                found |= set(range(lo, self.member() + 1))
            else:
                found.add(lo)
        self.next()
        return frozenset(range(256)) - found if inverse else frozenset(found)

    def member(self) -> int:
        c = self.next()
        return self.escaped() if c == "\\" else ord(c)

    def build(self, tree, follow: int) -> int:
        kind = tree[0]
        if kind == "byte":
            return self.nfa.node(tree[1], follow)
        if kind == "all":
            for item in reversed(tree[1]):
                follow = self.build(item, follow)
            return follow
        if kind == "any":
            return self.nfa.node(None, *[self.build(x, follow) for x in tree[1]])
        _, item, least, most = tree
        if most is None:
            loop = self.nfa.node(None, follow)
            self.nfa.after[loop].insert(0, self.build(item, loop))
            follow = loop
        for _ in range((most or least) - least):
            follow = self.nfa.node(None, self.build(item, follow), follow)
        for _ in range(least):
            follow = self.build(item, follow)
        return follow


# Subsets and partitions ----------------------------------------------------


def byte_classes(labels: list[frozenset[int]]) -> tuple[np.ndarray, list[int]]:
    """(class of each byte, one byte of each class): bytes in the same labels are in one class."""
    sets = list(dict.fromkeys(labels))
    keys = [tuple(b in s for s in sets) for b in range(256)]
    number = {k: i for i, k in enumerate(dict.fromkeys(keys))}
    of = np.array([number[k] for k in keys], np.uint8)
    return of, [int(np.flatnonzero(of == i)[0]) for i in range(len(number))]


def subsets(nfa: Nfa, start: frozenset[int], tags: dict[int, int], again: bool, examples: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(transitions by state and class, tags accepted in each state); again: a match may start anywhere."""
    closed: dict[int, frozenset[int]] = {}

    def closure(nodes) -> frozenset[int]:
        seen, todo = set(), list(nodes)
        while todo:
            v = todo.pop()
            if v not in seen:
                seen.add(v)
                if nfa.label[v] is None:
                    todo += nfa.after[v]
        return frozenset(v for v in seen if nfa.label[v] is not None or v in tags)

    def reach(v: int) -> frozenset[int]:
        if v not in closed:
            closed[v] = closure(nfa.after[v])
        return closed[v]

    first = closure(start)
    number, table, queue = {first: 0}, [], [first]
    for state in queue:
        row = []
        for b in examples:
            to: frozenset[int] = first if again else frozenset()
            to = to.union(*[reach(v) for v in state if nfa.label[v] is not None and b in nfa.label[v]])
            if to not in number:
                number[to] = len(number)
                queue.append(to)
            row.append(number[to])
        table.append(row)
    accepts = np.array([sum(1 << tags[v] for v in s if v in tags) for s in queue], np.int64)
    return np.array(table, np.int32), accepts


def minimal(table: np.ndarray, accepts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least automaton with the same answers; state 0 stays the first."""
    block = np.unique(accepts, return_inverse=True)[1].reshape(-1)
    while True:
        signature = np.concatenate([block[:, None], block[table]], axis=1)
        finer = np.unique(signature, axis=0, return_inverse=True)[1].reshape(-1)
        if finer.max() == block.max():
            break
        block = finer
    # number blocks by their first state, so that the start is 0
    _, first = np.unique(block, return_index=True)
    order = np.argsort(first)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return rank[block][table[first[order]]].astype(np.int32), accepts[first[order]]


# The automaton -------------------------------------------------------------


@dataclass(frozen=True)
class Automaton:
    """Transition arrays; a state's row starts at state * width, and states are kept so multiplied."""

    byte_class: np.ndarray
    width: int
    table: np.ndarray
    tags: np.ndarray  # by state
    dead: int  # the state that nothing leaves and nothing accepts, -1 if there is none

    def states(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """The state after each byte of documents laid end to end; 0 is the first."""
        n = len(data)
        out = np.zeros(n, np.int32)
        size = np.diff(off)
        lanes = -(-size // LANE)
        doc = np.repeat(np.arange(len(size)), lanes)
        if not len(doc):
            return out
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        start = off[:-1][doc] + nth * LANE
        length = np.minimum(off[1:][doc] - start, LANE)
        kind = self.byte_class[data]
        entry = np.zeros(len(doc), np.int32)
        run = np.arange(len(doc))
        while len(run):
            run = run[np.argsort(-length[run], kind="stable")]
            at, state = start[run], entry[run]
            left = np.searchsorted(-length[run], -np.arange(1, LANE + 1), "right")
            for t in range(int(length[run[0]])):
                k = int(left[t])
                state = state[:k]
                state = self.table[state + kind[at[:k] + t]]
                out[at[:k] + t] = state
            ended = out[start + length - 1]
            should = np.where(nth > 0, np.concatenate([[0], ended[:-1]]), 0).astype(np.int32)
            run = np.flatnonzero(should != entry)
            entry[run] = should[run]
        return out

    def longest(self, data: bytes, at: int, tag: int) -> tuple[int, int]:
        """(end, tags there) of the longest match of a tag that starts at a byte; (-1, 0) if there is none."""
        state, end, tags = 0, -1, 0
        for i in range(at, len(data)):
            state = int(self.table[state + int(self.byte_class[data[i]])])
            if state == self.dead:
                break
            found = int(self.tags[state // self.width])
            if found >> tag & 1:
                end, tags = i + 1, found
        return end, tags


def compiled(expressions: list[str], searching: bool) -> Automaton:
    """One automaton for all; expression i has tag i."""
    nfa, tags, starts = Nfa(), {}, []
    for i, text in enumerate(expressions):
        accept = nfa.node(None)
        tags[accept] = i
        starts.append(Reader(nfa, text).expression(accept))
    kinds, examples = byte_classes([x for x in nfa.label if x is not None])
    table, accepts = minimal(*subsets(nfa, frozenset(starts), tags, searching, examples))
    width = len(examples)
    stuck = (table == np.arange(len(table))[:, None]).all(axis=1) & (accepts == 0)
    return Automaton(kinds, width, (table * width).reshape(-1), accepts, int(np.flatnonzero(stuck)[0]) * width if stuck.any() else -1)
