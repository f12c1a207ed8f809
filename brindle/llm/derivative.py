"""Memoised parsing with derivatives over token streams.

A *language* is a hash-consed node built from terminals, sequence, choice, repetition and named
nonterminals. The derivative of a language by a token class is the language of the possible rests.
Nodes are interned, so equal languages are one object, and every node keeps its derivatives in a
dictionary: for a corpus, the reachable part of the grammar turns into a lazily built automaton and
a token costs one dictionary lookup.

To keep the number of distinct states small, the state is always the shortest non-nullable prefix of
the remaining sequence; what follows it lies on an explicit stack and is joined again once needed.
An empty derivative marks the failing token. A language that isn't nullable at the end of the
tokens means that the text was cut off.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable


class Node:
    """A language. ``kind`` is one of empty, eps, tok, cat, alt, star, ref, data."""

    __slots__ = ("kind", "a", "b", "nullable", "uid", "memo", "steps")

    def __init__(self, kind, a=None, b=None, nullable=False):
        self.kind, self.a, self.b, self.nullable = kind, a, b, nullable
        self.uid = 0
        self.memo: dict = {}
        self.steps: dict = {}


class Grammar:
    """Nodes are interned in the grammar that made them."""

    def __init__(self) -> None:
        self._table: dict = {}
        self._count = 0
        self.empty = self._new("empty")
        self.eps = self._new("eps", nullable=True)
        self.rules: dict[str, Node] = {}
        self._joined: dict = {}

    def _new(self, kind, a=None, b=None, nullable=False) -> Node:
        n = Node(kind, a, b, nullable)
        self._count += 1
        n.uid = self._count
        return n

    def _intern(self, key, kind, a=None, b=None, nullable=False) -> Node:
        n = self._table.get(key)
        if n is None:
            n = self._table[key] = self._new(kind, a, b, nullable)
        return n

    @property
    def size(self) -> int:
        """Nodes made so far."""
        return self._count

    # -- constructors, each with its compaction rules --------------------------------------------

    def tok(self, *classes: str) -> Node:
        s = frozenset(classes)
        return self._intern(("tok", s), "tok", s)

    def data(self, cls: str, make: Callable[[str], Node]) -> Node:
        """A token ``cls`` with a value, whose derivative depends on the value (matching XML tags)."""
        return self._intern(("data", cls, id(make)), "data", cls, make)

    def ref(self, name: str) -> Node:
        """A nonterminal; it must not be nullable nor left-recursive."""
        return self._intern(("ref", name), "ref", name)

    def star(self, a: Node) -> Node:
        if a is self.empty or a is self.eps:
            return self.eps
        if a.kind == "star":
            return a
        return self._intern(("star", a.uid), "star", a, nullable=True)

    def cat(self, a: Node, b: Node) -> Node:
        if a is self.empty or b is self.empty:
            return self.empty
        if a is self.eps:
            return b
        if b is self.eps:
            return a
        heads = []
        while a.kind == "cat":
            heads.append(a.a)
            a = a.b
        for x in (a, *reversed(heads)):
            b = self._intern(("cat", x.uid, b.uid), "cat", x, b, x.nullable and b.nullable)
        return b

    def seq(self, *parts: Node | str) -> Node:
        out = self.eps
        for p in reversed(parts):
            out = self.cat(self.tok(p) if isinstance(p, str) else p, out)
        return out

    def alt(self, *parts: Node | str) -> Node:
        flat: dict[int, Node] = {}
        terminals: set[str] = set()
        todo = [self.tok(p) if isinstance(p, str) else p for p in parts]
        while todo:
            p = todo.pop()
            if p is self.empty:
                continue
            if p.kind == "alt":
                todo.extend(p.a)
            elif p.kind == "tok":
                terminals |= p.a
            else:
                flat[p.uid] = p
        if terminals:
            t = self.tok(*terminals)
            flat[t.uid] = t
        if not flat:
            return self.empty
        if len(flat) == 1:
            return next(iter(flat.values()))
        return self._factored([flat[k] for k in sorted(flat)])

    def opt(self, *parts: Node | str) -> Node:
        return self.alt(self.seq(*parts), self.eps)

    def many(self, *parts: Node | str) -> Node:
        return self.star(self.seq(*parts))

    def sep(self, item: Node | str, comma: str = ",") -> Node:
        """One or more items with separators."""
        return self.seq(item, self.many(comma, item))

    def _factored(self, members: list[Node]) -> Node:
        """A choice; a common rest of all members is taken out, so that it can be put aside."""
        tails = []
        for m in members:
            chain, x = [m], m
            while x.kind == "cat":
                x = x.b
                chain.append(x)
            tails.append(chain)
        common = set(map(id, tails[0]))
        for chain in tails[1:]:
            common &= set(map(id, chain))
            if not common:
                break
        if common and (tail := next(x for x in tails[0] if id(x) in common)) is not self.eps:
            heads = []
            for chain in tails:
                h = self.eps
                for x in reversed(chain[: next(i for i, y in enumerate(chain) if y is tail)]):
                    h = self.cat(x.a, h)
                heads.append(h)
            return self.cat(self.alt(*heads), tail)
        # members that begin alike: a·x | a·y = a·(x | y)
        by: dict[int, list[Node]] = {}
        for m in members:
            by.setdefault((m.a if m.kind == "cat" else m).uid, []).append(m)
        if len(by) < len(members):
            out = []
            for group in by.values():
                if len(group) == 1:
                    out.append(group[0])
                else:
                    head = group[0].a if group[0].kind == "cat" else group[0]
                    out.append(self.cat(head, self.alt(*(m.b if m.kind == "cat" and m.a is head else self.eps for m in group))))
            return self.alt(*out)
        key = ("alt", *(m.uid for m in members))
        return self._intern(key, "alt", tuple(members), nullable=any(m.nullable for m in members))

    # -- derivatives ----------------------------------------------------------------------------

    def derive(self, n: Node, t: str) -> Node:
        """The derivative of a language by a token. Without recursion: what a derivative is made of lies
        on a stack until it is there, so languages may be nested as deeply as texts nest."""
        d = n.memo.get(t)
        if d is not None:
            return d
        todo = [n]
        while todo:
            x = todo[-1]
            if t in x.memo:
                todo.pop()
                continue
            need = [y for y in self._made_of(x) if t not in y.memo]
            if need:
                todo += need
                continue
            x.memo[t] = self._derived(x, t)
            todo.pop()
        return n.memo[t]

    def _made_of(self, n: Node) -> tuple[Node, ...]:
        """The nodes whose derivatives make a node's."""
        k = n.kind
        if k == "cat":
            return (n.a, n.b) if n.a.nullable else (n.a,)
        if k == "alt":
            return n.a
        if k == "star":
            return (n.a,)
        return (self.rules[n.a],) if k == "ref" else ()

    def _derived(self, n: Node, t: str) -> Node:
        k = n.kind
        if k == "tok":
            return self.eps if t in n.a else self.empty
        if k == "cat":
            d = self.cat(n.a.memo[t], n.b)
            return self.alt(d, n.b.memo[t]) if n.a.nullable else d
        if k == "alt":
            return self.alt(*(m.memo[t] for m in n.a))
        if k == "star":
            return self.cat(n.a.memo[t], n)
        if k == "ref":
            return self.rules[n.a].memo[t]
        if k == "data":
            cls, _, value = t.partition("\0")
            return n.b(value) if cls == n.a else self.empty
        return self.empty

    def _split(self, n: Node) -> tuple[Node, Node]:
        """The shortest non-nullable prefix of a sequence, or all of it, and the rest."""
        if n.kind != "cat":
            return n, self.eps
        heads, x = [], n
        while x.kind == "cat":
            heads.append(x.a)
            x = x.b
            if not heads[-1].nullable:
                break
        else:
            return n, self.eps
        h = self.eps
        for y in reversed(heads):
            h = self.cat(y, h)
        return h, x

    def run(self, start: Node, tokens: Iterable[str]) -> tuple[str, int]:
        """('ok' | 'token' | 'end', index): accepted, stopped at a token, or cut off at the end."""
        state, rest = self._split(start)
        stack = [rest] if rest is not self.eps else []
        i = -1
        for i, t in enumerate(tokens):
            step = state.steps.get(t)
            if step is None:
                step = state.steps[t] = self._split(self.derive(state, t))
            state, rest = step
            if rest is not self.eps:
                stack.append(rest)
            elif state.nullable:
                while stack and state.nullable:
                    key = (state.uid, stack[-1].uid)
                    joined = self._joined.get(key)
                    if joined is None:
                        joined = self._joined[key] = self._split(self.cat(state, stack[-1]))
                    stack.pop()
                    state, rest = joined
                    if rest is not self.eps:
                        stack.append(rest)
                        break
            elif state is self.empty:
                return "token", i
        return ("ok", i + 1) if state.nullable and all(x.nullable for x in stack) else ("end", i + 1)
