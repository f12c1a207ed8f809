"""Packrat parsing-expression grammars over token streams.

A parser takes a position and gives the position after it, or -1. Rules are memoised by position, so
parsing takes time in proportion to the tokens however much is tried again. Semantic actions are
attached to rules and run once the whole parse stands, in source order. A grammar is built once and
then parses one token stream after another.
"""

from __future__ import annotations

from collections.abc import Callable

Parser = Callable[[int], int]


class Peg:
    def __init__(self) -> None:
        self.kinds: list[str] = [""]
        self.memo: dict[tuple[str, int], tuple[int, tuple]] = {}
        #: (rule, start, end) of the rules that stand, in the order in which they ended
        self.nodes: list[tuple[str, int, int]] = []
        self._pairs: dict[tuple[str, str], dict[int, int]] = {}

    def parse(self, start: Parser, kinds: list[str], actions: dict[str, Callable[[str, int, int], None]]) -> int:
        """Parses a token stream, then runs the actions of the rules that stand: by their first token,
        a rule before those inside it, and rules of the same extent in the order of ``actions``. Gives the
        position after the last token taken."""
        self.kinds[:] = [*kinds, ""]
        self.memo.clear()
        self.nodes.clear()
        for (opening, closing), closes in self._pairs.items():
            closes.clear()
            stack: list[int] = []
            for i, k in enumerate(kinds):
                if k == opening:
                    stack.append(i)
                elif k == closing and stack:
                    closes[stack.pop()] = i + 1
        end = start(0)
        order = {rule: n for n, rule in enumerate(actions)}
        for rule, i, j in sorted(set(self.nodes), key=lambda n: (n[1], -n[2], order[n[0]])):
            actions[rule](rule, i, j)
        return end

    def tok(self, *classes: str) -> Parser:
        wanted, kinds = frozenset(classes), self.kinds
        return lambda i: i + 1 if kinds[i] in wanted else -1

    def but(self, *classes: str) -> Parser:
        """Any token (not the end) except these."""
        other, kinds = frozenset((*classes, "")), self.kinds
        return lambda i: i + 1 if kinds[i] not in other else -1

    def seq(self, *parts: Parser) -> Parser:
        nodes = self.nodes

        def run(i: int) -> int:
            mark = len(nodes)
            for p in parts:
                i = p(i)
                if i < 0:
                    del nodes[mark:]
                    return -1
            return i

        return run

    def alt(self, *parts: Parser) -> Parser:
        def run(i: int) -> int:
            for p in parts:
                j = p(i)
                if j >= 0:
                    return j
            return -1

        return run

    def many(self, p: Parser) -> Parser:
        def run(i: int) -> int:
            while (j := p(i)) > i:
                i = j
            return i

        return run

    def opt(self, p: Parser) -> Parser:
        def run(i: int) -> int:
            j = p(i)
            return i if j < 0 else j

        return run

    def ahead(self, p: Parser, wanted: bool = True) -> Parser:
        """Looks ahead without taking anything."""
        nodes = self.nodes

        def run(i: int) -> int:
            mark = len(nodes)
            found = p(i) >= 0
            del nodes[mark:]
            return i if found == wanted else -1

        return run

    def rule(self, name: str, body: Callable[[], Parser], keep: bool = False) -> Parser:
        """A memoised rule, built when first used. With ``keep`` its extent is recorded; what was
        recorded inside is memoised with it."""
        memo, nodes = self.memo, self.nodes
        built: list[Parser] = []

        def run(i: int) -> int:
            key = (name, i)
            hit = memo.get(key)
            if hit is None:
                if not built:
                    built.append(body())
                mark = len(nodes)
                end = built[0](i)
                if end < 0:
                    del nodes[mark:]
                    inner: tuple = ()
                else:
                    if keep:
                        nodes.append((name, i, end))
                    inner = tuple(nodes[mark:])
                memo[key] = (end, inner)
                return end
            nodes.extend(hit[1])
            return hit[0]

        return run

    def balanced(self, opening: str, closing: str) -> Parser:
        """From an opening bracket to the closing one of the same depth."""
        closes = self._pairs.setdefault((opening, closing), {})
        return lambda i: closes.get(i, -1)
