"""One deterministic automaton for many regexes, as transition arrays over bytes.

The rules (literals, classes, groups, alternatives, repeats; ASCII) become one
nondeterministic automaton that may start a match at any byte; subset construction
makes it deterministic, partition refinement makes it minimal. A state carries the
set of rules of which a match has just ended there.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

_LANE = 512
_FEW = 48


def _class(items, fold: bool) -> frozenset[int]:
    got: set[int] = set()
    for op, value in items:
        name = str(op)
        if name == "LITERAL":
            got.add(value)
        elif name == "RANGE":
            got.update(range(value[0], value[1] + 1))
        else:
            raise ValueError(f"{name} in a class")
    if max(got) > 127:
        raise ValueError("rules are ASCII")
    if fold:
        got |= {ord(chr(c).swapcase()) for c in got if chr(c).isalpha()}
    return frozenset(got)


class _Nfa:
    def __init__(self):
        self.free: list[list[int]] = []
        self.step: list[tuple[frozenset[int], int] | None] = []

    def state(self) -> int:
        self.free.append([])
        self.step.append(None)
        return len(self.free) - 1

    def add(self, tree, at: int, fold: bool) -> int:
        """Append what ``tree`` matches behind state ``at``; the state at its end."""
        for op, value in tree:
            name = str(op)
            if name in ("LITERAL", "IN"):
                end = self.state()
                self.step[at] = (_class([(op, value)] if name == "LITERAL" else value, fold), end)
                at = end
            elif name == "SUBPATTERN":
                at = self.add(value[3], at, fold)
            elif name == "BRANCH":
                end = self.state()
                for one in value[1]:
                    begin = self.state()
                    self.free[at].append(begin)
                    self.free[self.add(one, begin, fold)].append(end)
                at = end
            elif name == "MAX_REPEAT":
                least, most, inner = value
                for _ in range(least):
                    at = self.add(inner, self._fresh(at), fold)
                if str(most) == "MAXREPEAT":
                    loop = self._fresh(at)
                    begin, end = self.state(), self.state()
                    self.free[loop] += [begin, end]
                    self.free[self.add(inner, begin, fold)].append(loop)
                    at = end
                else:
                    end = self.state()
                    self.free[at].append(end)
                    for _ in range(most - least):
                        at = self.add(inner, self._fresh(at), fold)
                        self.free[at].append(end)
                    at = end
            else:
                raise ValueError(f"{name} in a rule")
        return at

    def _fresh(self, at: int) -> int:
        new = self.state()
        self.free[at].append(new)
        return new

    def closure(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for x in self.free[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(seen)


@dataclass
class Automaton:
    """kind: class of each byte; move: next state by state * n_kinds + kind; ends: bits of the rules that end there."""

    kind: np.ndarray
    move: np.ndarray
    ends: np.ndarray
    start: int
    n_kinds: int
    reset: np.ndarray  # bytes that lead to the start from every state

    @property
    def n_states(self) -> int:
        return len(self.ends)


def compile_rules(rules: list[tuple[str, bool]], anywhere: bool = True) -> Automaton:
    """(regex, whether case counts for nothing) per rule; rule k sets bit k.

    anywhere: a match may begin at any byte; else at the first one only.
    """
    nfa = _Nfa()
    root, last = nfa.state(), {}
    for k, (pattern, fold) in enumerate(rules):
        begin = nfa.state()
        nfa.free[root].append(begin)
        last[nfa.add(re._parser.parse(pattern), begin, fold)] = k
    kinds: dict[tuple, int] = {}
    kind = np.zeros(256, np.int64)
    steps = [x for x in nfa.step if x]
    member = {}
    for b in range(256):
        key = tuple(b in chars for chars, _ in steps)
        kind[b] = kinds.setdefault(key, len(kinds))
        member.setdefault(int(kind[b]), b)
    base = nfa.closure([root])
    states, todo, moves, ends = {base: 0}, [base], [], []
    while todo:
        now = todo.pop(0)
        ends.append(sum(1 << last[s] for s in now if s in last))
        active = [nfa.step[s] for s in now if nfa.step[s]]
        row = []
        for k in range(len(kinds)):
            b = member[k]
            then = nfa.closure([to for chars, to in active if b in chars]) | (base if anywhere else frozenset())
            if then not in states:
                states[then] = len(states)
                todo.append(then)
            row.append(states[then])
        moves.append(row)
    return _minimal(np.array(moves), np.array(ends, np.int64), kind)


def _minimal(move: np.ndarray, ends: np.ndarray, kind: np.ndarray) -> Automaton:
    _, block = np.unique(ends, return_inverse=True)
    while True:
        _, finer = np.unique(np.column_stack([block, block[move]]), axis=0, return_inverse=True)
        finer = finer.reshape(-1)
        if finer.max() == block.max():
            break
        block = finer
    n, n_kinds = int(block.max()) + 1, move.shape[1]
    small, small_ends = np.zeros((n, n_kinds), np.int32), np.zeros(n, np.int64)
    small[block], small_ends[block] = block[move], ends
    start = int(block[0])
    reset = (small == start).all(axis=0)[kind]
    return Automaton(kind.astype(np.uint8), small.reshape(-1), small_ends, start, n_kinds, reset)


class Matcher:
    """Where matches lie, by the automaton of all rules that begin at one byte.

    From a byte it runs on while a rule can still match, and tells where the rule's
    match first may end and where its longest one does.
    """

    def __init__(self, rules: list[tuple[str, bool]]):
        auto = compile_rules(rules, anywhere=False)
        self.kind, self.start, self.ends = auto.kind.tobytes(), auto.start, auto.ends.tolist()
        move = auto.move.reshape(-1, auto.n_kinds)
        self.move = move.tolist()
        #: by state, the rules that can still end from it on
        hope = auto.ends.copy()
        while True:
            more = hope | np.bitwise_or.reduce(hope[move], axis=1)
            if (more == hope).all():
                break
            hope = more
        ahead = np.bitwise_or.reduce(hope[move], axis=1)
        self.ahead = ahead.tolist()
        self.first = [np.array([bool(hope[move[auto.start, k]] >> r & 1) for k in auto.kind.tolist()]) for r in range(len(rules))]

    def longest(self, data: bytes, at: int, rule: int) -> tuple[int, int] | None:
        """(first, last) byte behind which a match of ``rule`` that begins at ``at`` may end."""
        state, bit, first, last = self.start, 1 << rule, 0, 0
        for k in range(at, len(data)):
            state = self.move[state][self.kind[data[k]]]
            if self.ends[state] & bit:
                first, last = first or k + 1, k + 1
            if not self.ahead[state] & bit:
                break
        return (first, last) if last else None

    def find(self, data: bytes, rule: int) -> Iterator[tuple[int, int, int]]:
        """(begin, first end, end) of the leftmost matches of ``rule``, the longest of each, without overlaps."""
        at = 0
        for begin in np.flatnonzero(self.first[rule][np.frombuffer(data, np.uint8)]).tolist():
            if begin >= at and (found := self.longest(data, begin, rule)) is not None:
                yield begin, *found
                at = found[1]


def rules_hit(auto: Automaton, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per row the bits of all rules that match in its bytes: one pass over the bytes.

    Rows are cut after reset bytes into lanes that advance together.
    """
    n_rows = len(offsets) - 1
    out = np.zeros(n_rows, np.int64)
    if not len(buf):
        return out
    kinds = auto.kind[buf]
    resets = np.flatnonzero(auto.reset[buf])
    marks = np.searchsorted(resets, np.arange(_LANE, len(buf), _LANE))
    cuts = resets[marks[marks < len(resets)]] + 1
    begin = np.unique(np.concatenate([offsets[:-1], cuts[cuts < len(buf)]]))
    begin = begin[begin < len(buf)]
    length = np.diff(np.append(begin, len(buf)))
    order = np.argsort(-length, kind="stable")
    lane, length = begin[order], length[order]
    state = np.full(len(lane), auto.start, np.int64)
    seen = np.zeros(len(lane), np.int64)
    alive = np.searchsorted(-length, -np.arange(1, int(length[0]) + 1), "right")
    at = 0
    for n in alive.tolist():
        if n < _FEW:
            break
        state[:n] = auto.move[state[:n] * auto.n_kinds + kinds[lane[:n] + at]]
        seen[:n] |= auto.ends[state[:n]]
        at += 1
    else:
        n = 0
    if n:
        move, ends, width = auto.move.tolist(), auto.ends.tolist(), auto.n_kinds
        for k in range(n):
            now, got = int(state[k]), 0
            for kind in kinds[lane[k] + at : lane[k] + length[k]].tolist():
                now = move[now * width + kind]
                got |= ends[now]
            seen[k] |= got
    row = np.searchsorted(offsets, lane, "right") - 1
    np.bitwise_or.at(out, row, seen)
    return out
