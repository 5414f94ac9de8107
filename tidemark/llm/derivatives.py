"""Memoised parsing with derivatives over token streams.

A language is a set of sequences of grammar nodes. Its derivative by a token is the set of what
may follow that token. Nodes, sequences and sets are interned and each derivative is worked out
once, so that after some text nearly every token costs one lookup. The empty set marks the token
at which a text fails; a text that ends in a set without the empty sequence is cut off.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

_EBNF = re.compile(r"\s*(?:(?P<q>'[^']+')|(?P<name>[A-Za-z_]\w*)|(?P<op>[|()*+?;=]))")


class TooAmbiguous(ValueError):
    """More ways to read a text than are followed at once."""


#: Sequences in one set beyond which a text is read again with shared ends (``Shared``), which is
#: slower by token and bounded by the text; ordinary texts stay below a hundred.
MOST_WAYS = 2_000


class Grammar:
    """Rules in EBNF: lower case names are rules, upper case names and quoted texts are tokens.

    ``special`` gives for a rule name a function from a token to its residual node lists, for
    families of tokens such as the tags of XML. Rules may not be left recursive.
    """

    def __init__(self, rules: str, start: str, special: dict[str, Callable[[Grammar, str], list[tuple[int, ...]]]] | None = None, limit: int = 400_000) -> None:
        self.nodes: list[tuple] = []
        self._ids: dict[tuple, int] = {}
        self.defs: dict[int, int] = {}
        self.special = {self.node(("rule", n)): f for n, f in (special or {}).items()}
        self._read(rules)
        self.start, self.limit = self.node(("rule", start)), limit
        missing = [n[1] for i, n in enumerate(self.nodes) if n[0] == "rule" and i not in self.defs and i not in self.special]
        if missing:
            raise ValueError(f"rules without definition: {missing}")
        self._nullable()
        self._base = len(self.nodes)
        self.clear()

    # -- grammar ---------------------------------------------------------
    def node(self, key: tuple) -> int:
        if key not in self._ids:
            self._ids[key] = len(self.nodes)
            self.nodes.append(key)
        return self._ids[key]

    def token(self, t: str) -> int:
        return self.node(("tok", t))

    def _read(self, text: str) -> None:
        text = re.sub(r"(?m)^\s*%.*$", "", text)
        items = [m.lastgroup and (m.lastgroup, m[m.lastgroup]) for m in _EBNF.finditer(text)]
        if "".join(v for _, v in items) != re.sub(r"\s", "", text):
            raise ValueError("unreadable grammar")
        at = 0

        def alt() -> int:
            nonlocal at
            ways = [seq()]
            while items[at][1] == "|" and items[at][0] == "op":
                at += 1
                ways.append(seq())
            return ways[0] if len(ways) == 1 else self.node(("alt", *ways))

        def seq() -> int:
            nonlocal at
            parts = []
            while not (items[at][0] == "op" and items[at][1] in "|);"):
                kind, v = items[at]
                at += 1
                if kind == "op" and v == "(":
                    n = alt()
                    at += 1
                elif kind == "q":
                    n = self.token(v[1:-1])
                else:
                    n = self.token(v) if v.isupper() else self.node(("rule", v))
                while items[at][0] == "op" and items[at][1] in "*+?":
                    op = items[at][1]
                    at += 1
                    n = self.node(("star", n)) if op == "*" else self.node(("seq", n, self.node(("star", n)))) if op == "+" else self.node(("alt", n, self.node(("seq",))))
                parts.append(n)
            return parts[0] if len(parts) == 1 else self.node(("seq", *parts))

        while at < len(items):
            name = items[at][1]
            at += 2
            self.defs[self.node(("rule", name))] = alt()
            at += 1

    def _nullable(self) -> None:
        self.nullable = [n[0] in ("star",) or n == ("seq",) for n in self.nodes]
        changed = True
        while changed:
            changed = False
            for i, n in enumerate(self.nodes):
                if not self.nullable[i]:
                    v = (n[0] == "seq" and all(self.nullable[x] for x in n[1:]) or n[0] == "alt" and any(self.nullable[x] for x in n[1:])
                         or n[0] == "rule" and i in self.defs and self.nullable[self.defs[i]])
                    if v:
                        self.nullable[i] = changed = True

    def first(self, node: int, t: str) -> frozenset:
        """The derivative of one node: node lists that may follow token ``t`` within it."""
        key = (node, t)
        got = self._first.get(key)
        if got is not None:
            return got
        n = self.nodes[node]
        if node in self.special:
            out = set(self.special[node](self, t))
        elif n[0] == "tok":
            out = {()} if n[1] == t else set()
        elif n[0] == "rule":
            out = self.first(self.defs[node], t)
        elif n[0] == "alt":
            out = set().union(*(self.first(x, t) for x in n[1:]))
        elif n[0] == "star":
            out = {(*r, node) for r in self.first(n[1], t)}
        else:
            out = set()
            for i, x in enumerate(n[1:], 2):
                out |= {(*r, *n[i:]) for r in self.first(x, t)}
                if not self.is_nullable(x):
                    break
        self._first[key] = frozenset(out)
        return self._first[key]

    def is_nullable(self, node: int) -> bool:
        return node < len(self.nullable) and self.nullable[node]

    # -- sequences and sets ----------------------------------------------
    def clear(self) -> None:
        """Forget all derivatives, and the nodes of token families that came with them."""
        for n in self.nodes[self._base :]:
            del self._ids[n]
        del self.nodes[self._base :]
        self._first: dict[tuple[int, str], frozenset] = {}
        self._stacks: list[tuple[int, int]] = [(-1, -1)]  # 0 is the empty sequence
        self._stack_ids: dict[tuple[int, int], int] = {}
        self._stack_step: dict[tuple[int, str], frozenset] = {}
        self._sets: list[frozenset] = []
        self._set_ids: dict[frozenset, int] = {}
        self.step: dict[tuple[int, str], int] = {}
        self.dead = self._set(frozenset())
        self.begin = self._set(frozenset({self._push(self.start, 0)}))

    def _push(self, node: int, rest: int) -> int:
        key = (node, rest)
        if key not in self._stack_ids:
            self._stack_ids[key] = len(self._stacks)
            self._stacks.append(key)
        return self._stack_ids[key]

    def _set(self, s: frozenset) -> int:
        if s not in self._set_ids:
            self._set_ids[s] = len(self._sets)
            self._sets.append(s)
        return self._set_ids[s]

    def _derive_stack(self, stack: int, t: str) -> frozenset:
        key = (stack, t)
        got = self._stack_step.get(key)
        if got is None:
            out = set()
            s = stack
            while s:
                node, rest = self._stacks[s]
                for r in self.first(node, t):
                    top = rest
                    for x in reversed(r):
                        top = self._push(x, top)
                    out.add(top)
                if not self.is_nullable(node):
                    break
                s = rest
            got = self._stack_step[key] = frozenset(out)
        return got

    def derive(self, state: int, t: str) -> int:
        key = (state, t)
        got = self.step.get(key)
        if got is None:
            ways = frozenset().union(*(self._derive_stack(s, t) for s in self._sets[state])) if self._sets[state] else frozenset()
            if len(ways) > MOST_WAYS:
                raise TooAmbiguous(f"{len(ways)} ways")
            got = self.step[key] = self._set(ways)
        return got

    def accepts_end(self, state: int) -> bool:
        for s in self._sets[state]:
            while s and self.is_nullable(self._stacks[s][0]):
                s = self._stacks[s][1]
            if not s:
                return True
        return False

    def failure(self, tokens: Iterable[tuple[str, int]], insert: str | None = None, may_insert: Callable[[int], bool] | None = None) -> tuple[str, int] | None:
        """None for a text of the language, else ("token", place) of the failing token or ("end", -1).

        ``insert``: a token put in before one that fails, where ``may_insert(number)`` allows it.
        A text with more than MOST_WAYS readings at one token is read with shared ends instead,
        to the same result.
        """
        if max(len(self._stacks), len(self.step), len(self.nodes)) > self.limit:
            self.clear()
        tokens = list(tokens)
        try:
            return self._failure(tokens, self, insert, may_insert)
        except TooAmbiguous:
            self.clear()
            return self._failure(tokens, Shared(self), insert, may_insert)

    @staticmethod
    def _failure(tokens: list[tuple[str, int]], sets: Grammar | Shared, insert: str | None, may_insert: Callable[[int], bool] | None) -> tuple[str, int] | None:
        state, step, dead = sets.begin, sets.step, sets.dead
        for i, (t, place) in enumerate(tokens):
            after = step.get((state, t))
            if after is None:
                after = sets.derive(state, t)
            if after == dead:
                if insert is not None and may_insert(i):
                    mid = sets.derive(state, insert)
                    after = sets.derive(mid, t) if mid != dead else dead
                if after == dead:
                    return "token", place
            state = after
        if sets.accepts_end(state):
            return None
        if insert is not None:
            state = sets.derive(state, insert)
            if state != dead and sets.accepts_end(state):
                return None
        return "end", -1


class Shared:
    """Sets of sequences whose ends are shared, for texts with very many readings.

    A cell is a run of grammar nodes and the cells that may follow it, so a set of cells stands
    for every sequence that a path through them spells. Of the cells that one token leaves
    behind, those with the same run are one cell, followed by what follows any of them; a set
    has therefore no more cells than the grammar has residual runs, plus older ones.
    """

    def __init__(self, grammar: Grammar) -> None:
        self.grammar = grammar
        self.runs: list[tuple[int, ...]] = [()]  # cell 0 is the end of every sequence
        self.after: list[set[int]] = [set()]
        self._tails: dict[int, int] = {}
        self.step: dict[tuple[frozenset, str], frozenset] = {}  # nothing is kept by set and token: cells are those of one text
        self.dead: frozenset = frozenset()
        self.begin = frozenset({self._cell((grammar.start,), {0})})

    def _cell(self, run: tuple[int, ...], after: set[int]) -> int:
        self.runs.append(run)
        self.after.append(after)
        return len(self.runs) - 1

    def _rest(self, cell: int) -> set[int]:
        """What stands behind the first node of a cell."""
        run = self.runs[cell]
        if len(run) == 1:
            return self.after[cell]
        if cell not in self._tails:
            self._tails[cell] = self._cell(run[1:], self.after[cell])
        return {self._tails[cell]}

    def derive(self, cells: frozenset, t: str) -> frozenset:
        new: dict[tuple[int, ...], int] = {}
        out: set[int] = set()
        seen, todo = set(cells), list(cells)
        while todo:
            cell = todo.pop()
            if not cell:
                continue
            node = self.runs[cell][0]
            rest = self._rest(cell)
            for r in self.grammar.first(node, t):
                if r:
                    if r in new:
                        self.after[new[r]] |= rest
                    else:
                        new[r] = self._cell(r, set(rest))
                else:
                    out |= rest
            if self.grammar.is_nullable(node):
                todo.extend(rest - seen)
                seen |= rest
        return frozenset(out | set(new.values()))

    def accepts_end(self, cells: frozenset) -> bool:
        seen, todo = set(cells), list(cells)
        while todo:
            cell = todo.pop()
            if not cell:
                return True
            if self.grammar.is_nullable(self.runs[cell][0]):
                more = self._rest(cell) - seen
                seen |= more
                todo.extend(more)
        return False
