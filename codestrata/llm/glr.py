"""LALR(1) tables from bundled grammars, and a recogniser that follows all their actions.

A grammar is text: ``rule: alternatives`` with ``?``, ``*``, ``+``, groups and ``|``;
terminals are quoted or in capitals. A line that starts with ``@tag`` belongs to the
grammar only if the tag is asked for. Conflicting actions are kept; the recogniser follows
all of them on one graph of stacks, where stacks with the same top share it.
"""

from __future__ import annotations

import re

_TOKEN = re.compile(r"\s*(?:('(?:[^'\\]|\\.)+')|([A-Za-z_]\w*)|([|()?*+]))")


class Grammar:
    """Productions over integers: terminals from 0 (0 is the end), rules after them."""

    def __init__(self, text: str, tags: frozenset[str] = frozenset()):
        rules: dict[str, list] = {}
        order, name = [], None
        for line in text.splitlines():
            line = line.split("##")[0].rstrip()
            if not line.strip():
                continue
            if m := re.match(r"@(\w+)\s+", line):
                if m.group(1) not in tags:
                    continue
                line = line[m.end() :]
            if m := re.match(r"(\w+):", line):
                name, line = m.group(1), line[m.end() :]
                if name not in rules:
                    rules[name] = []
                    order.append(name)
            elif line.lstrip().startswith("|"):
                line = line.lstrip()[1:]
            rules[name].append(line)
        self._aux = 0
        self.bnf: dict[str, list[tuple[str, ...]]] = {}
        for n in order:
            self.bnf.setdefault(n, [])
            for body in rules[n]:
                toks = [m.group(1) or m.group(2) or m.group(3) for m in _TOKEN.finditer(body)]
                for alt in self._alternatives(toks):
                    self._add(n, alt)
        names = list(self.bnf)
        used = {s for alts in self.bnf.values() for a in alts for s in a}
        self.terminals = ["$"] + sorted(s for s in used if s not in self.bnf)
        for t in self.terminals[1:]:
            if t[0] != "'" and not t.isupper():
                raise ValueError(f"undefined rule {t}")
        self.ids = {s.strip("'") if s[0] == "'" else s: i for i, s in enumerate(self.terminals)}
        number = {s: i for i, s in enumerate(self.terminals)}
        self.first_rule = len(self.terminals)
        for n in names:
            number[n] = self.first_rule + names.index(n)
        self.start = self.first_rule + len(names)
        self.rule_names = names
        self.prods: list[tuple[int, tuple[int, ...]]] = [(self.start, (number[order[0]],))]
        for n in names:
            for a in dict.fromkeys(self.bnf[n]):
                self.prods.append((number[n], tuple(number[s] for s in a)))

    def _add(self, rule, alt):
        """``alt``: items (symbol, optional?); optional ones are written out."""
        outs = [()]
        for sym, opt in alt:
            outs = [o + (sym,) for o in outs] + (outs if opt else [])
        self.bnf[rule].extend(outs)

    def _fresh(self, alts):
        self._aux += 1
        name = f"_{self._aux}"
        self.bnf[name] = []
        for a in alts:
            self._add(name, a)
        return name

    def _alternatives(self, toks):
        pos = 0

        def alts():
            nonlocal pos
            out = [seq()]
            while pos < len(toks) and toks[pos] == "|":
                pos += 1
                out.append(seq())
            return out

        def seq():
            nonlocal pos
            items = []
            while pos < len(toks) and toks[pos] not in "|)":
                t = toks[pos]
                pos += 1
                if t == "(":
                    inner = alts()
                    pos += 1
                    sym = self._fresh(inner) if len(inner) > 1 or len(inner[0]) != 1 or inner[0][0][1] else inner[0][0][0]
                else:
                    sym = t
                mark = toks[pos] if pos < len(toks) and toks[pos] in "?*+" else ""
                pos += bool(mark)
                if mark in ("*", "+"):
                    name = self._fresh([])
                    self.bnf[name] = [(sym,), (name, sym)]
                    sym = name
                items.append((sym, mark in ("?", "*")))
            return items

        return alts()


def build_tables(g: Grammar):
    """(action, goto, productions): LALR(1) by DeRemer and Pennello's relations.

    action[state][terminal]: shift to s as s, reduce by p as -p, accept as -1 << 30, or a tuple of these.
    """
    prods, nt = g.prods, g.first_rule
    by_rule: dict[int, list[int]] = {}
    for i, (l, _) in enumerate(prods):
        by_rule.setdefault(l, []).append(i)
    nullable: set[int] = set()
    grown = True
    while grown:
        grown = False
        for l, r in prods:
            if l not in nullable and all(s in nullable for s in r):
                nullable.add(l)
                grown = True
    reach: dict[int, frozenset[int]] = {}

    def opened(rule):
        """Rules whose productions open where ``rule`` may start."""
        if rule not in reach:
            seen, todo = {rule}, [rule]
            while todo:
                for p in by_rule[todo.pop()]:
                    r = prods[p][1]
                    if r and r[0] >= nt and r[0] not in seen:
                        seen.add(r[0])
                        todo.append(r[0])
            reach[rule] = frozenset(seen)
        return reach[rule]

    states: dict[tuple, int] = {}
    kernels: list[tuple] = []
    trans: list[dict[int, int]] = []

    def state(kernel):
        k = tuple(sorted(kernel))
        if k not in states:
            states[k] = len(kernels)
            kernels.append(k)
            trans.append({})
        return states[k]

    state([(0, 0)])
    empty: list[list[int]] = []
    at = 0
    while at < len(kernels):
        nxt: dict[int, set] = {}
        rules: set[int] = set()
        for p, d in kernels[at]:
            r = prods[p][1]
            if d < len(r):
                nxt.setdefault(r[d], set()).add((p, d + 1))
                if r[d] >= nt:
                    rules |= opened(r[d])
        none = []
        for l in rules:
            for p in by_rule[l]:
                r = prods[p][1]
                if r:
                    nxt.setdefault(r[0], set()).add((p, 1))
                else:
                    none.append(p)
        empty.append(none)
        for s, k in nxt.items():
            trans[at][s] = state(k)
        at += 1
    gotos = [(q, s) for q in range(len(kernels)) for s in trans[q] if s >= nt]
    index = {x: i for i, x in enumerate(gotos)}
    reads_of: list[list[int]] = []
    look: list[int] = []
    for q, s in gotos:
        r, bits, rel = trans[q][s], 0, []
        for t in trans[r]:
            if t < nt:
                bits |= 1 << t
            elif t in nullable:
                rel.append(index[r, t])
        if q == 0 and s == prods[0][1][0]:
            bits |= 1
        look.append(bits)
        reads_of.append(rel)

    def digraph(rel, val):
        n, depth, stack = [0] * len(rel), 0, []
        inf = 1 << 60
        for root in range(len(rel)):
            if n[root]:
                continue
            depth_of = len(stack) + 1
            stack.append(root)
            n[root] = depth_of
            work = [(root, 0, depth_of)]
            while work:
                x, i, d = work.pop()
                if i < len(rel[x]):
                    work.append((x, i + 1, d))
                    y = rel[x][i]
                    if not n[y]:
                        stack.append(y)
                        n[y] = len(stack)
                        work.append((y, 0, len(stack)))
                    else:
                        n[x] = min(n[x], n[y])
                        val[x] |= val[y]
                    continue
                if n[x] == d:
                    while True:
                        top = stack.pop()
                        n[top] = inf
                        val[top] = val[x]
                        if top == x:
                            break
                if work:
                    p = work[-1][0]
                    n[p] = min(n[p], n[x])
                    val[p] |= val[x]

    digraph(reads_of, look)
    includes: list[list[int]] = [[] for _ in gotos]
    lookback: dict[tuple[int, int], list[int]] = {}
    for i, (q, a) in enumerate(gotos):
        for p in by_rule[a]:
            r, s = prods[p][1], q
            for k, sym in enumerate(r):
                if sym >= nt and all(x in nullable for x in r[k + 1 :]):
                    includes[index[s, sym]].append(i)
                s = trans[s][sym]
            lookback.setdefault((s, p), []).append(i)
    digraph(includes, look)
    action: list[dict] = []
    goto: list[dict[int, int]] = []
    for q, k in enumerate(kernels):
        row: dict[int, list[int]] = {t: [s] for t, s in trans[q].items() if t < nt}
        for p in [p for p, d in k if d == len(prods[p][1])] + empty[q]:
            if p == 0:
                row.setdefault(0, []).append(-1 << 30)
                continue
            bits = 0
            for i in lookback.get((q, p), ()):
                bits |= look[i]
            while bits:
                low = bits & -bits
                row.setdefault(low.bit_length() - 1, []).append(-p)
                bits ^= low
        action.append({t: a[0] if len(a) == 1 else tuple(a) for t, a in row.items()})
        goto.append({s: x for s, x in trans[q].items() if s >= nt})
    return action, goto, [(l, len(r)) for l, r in prods]


_ACCEPT = -1 << 30
_WIDTH = 1 << 12  # above every terminal
_TRIES = 40


class Parser:
    """Recogniser over the tables. ``semi``: the terminal that may be supplied at a line end (-1: none).

    Stacks share a graph: a node is (state, parent, ...). While one stack is left and its
    actions are single, it is walked as a list, chains of one-symbol reductions in one
    look-up. Elsewhere all stacks advance together and tops with the same state become
    one node with several parents, so work per token is bounded by states and parents.
    """

    def __init__(self, tables, semi: int = -1):
        self.action, self.goto, self.prods = tables
        self.semi = semi
        self._chains: list[dict] = [{} for _ in self.action]

    def _chain(self, below, state, kind):
        """(state, action) after the one-symbol reductions of ``state`` over ``below`` before ``kind``."""
        action, goto, prods = self.action, self.goto, self.prods
        while True:
            a = action[state].get(kind)
            if a is None or type(a) is tuple or a >= 0 or a == _ACCEPT or prods[-a][1] != 1:
                return state, a
            state = goto[below][prods[-a][0]]

    def _step(self, heads, kind):
        """Tops after ``kind``, by state; None where it is accepted as the end."""
        action, goto, prods = self.action, self.goto, self.prods
        level = {h[0]: list(h) for h in heads}  # tops have no children yet, so copies are safe
        todo = [(node, 1) for node in level.values()]
        shifts, inner = [], False
        edges = {(node[0], id(p)) for node in level.values() for p in node[1:]}
        while todo:
            node, first = todo.pop()
            acts = action[node[0]].get(kind)
            if acts is None:
                continue
            for a in acts if type(acts) is tuple else (acts,):
                if a > 0:
                    if first == 1:
                        shifts.append((a, node))
                    continue
                if a == _ACCEPT:
                    return None
                left, n = prods[-a]
                if n == 0:
                    bases, inner = [node], True
                else:
                    bases = node[first:]
                    for _ in range(n - 1):
                        bases = list({id(p): p for b in bases for p in b[1:]}.values())
                for base in bases:
                    state = goto[base[0]][left]
                    if (state, id(base)) in edges:
                        continue
                    edges.add((state, id(base)))
                    known = level.get(state)
                    if known is None:
                        level[state] = known = [state, base]
                        todo.append((known, 1))
                    else:
                        known.append(base)
                        if inner:
                            todo.extend((x, 1) for x in level.values())
                        else:
                            todo.append((known, len(known) - 1))
        out: dict[int, list] = {}
        for a, node in shifts:
            known = out.get(a)
            if known is None:
                out[a] = [a, node]
            elif node not in known[1:]:
                known.append(node)
        return list(out.values())

    def _spread(self, heads, kind):
        """:meth:`_step` for few stacks of one parent each, without the graph's bookkeeping; 0 where that does not do."""
        goto, prods, chains, chain = self.goto, self.prods, self._chains, self._chain
        todo, shifts, left_over = list(heads), [], _TRIES
        while todo:
            node = todo.pop()
            while True:
                left_over -= 1
                if len(node) != 2 or not left_over:
                    return 0
                below = node[1]
                known, key = chains[below[0]], node[0] * _WIDTH + kind
                got = known.get(key)
                if got is None:
                    got = known[key] = chain(below[0], node[0], kind)
                state, acts = got
                if acts is None:
                    break
                if state != node[0]:
                    node = (state, below)
                after = None
                for a in acts if type(acts) is tuple else (acts,):
                    if a > 0:
                        shifts.append((a, node))
                    elif a == _ACCEPT:
                        return None
                    else:
                        rule, n = prods[-a]
                        base = node
                        while n:
                            if len(base) != 2:
                                return 0
                            base = base[1]
                            n -= 1
                        if after is not None:
                            todo.append(after)
                        after = (goto[base[0]][rule], base)
                if after is None:
                    break
                node = after
        if len(shifts) < 2:
            return shifts
        out: dict[int, list] = {}
        for a, node in shifts:
            known = out.setdefault(a, [a])
            for i in range(1, len(known)):
                if known[i][0] == node[0]:
                    if all(p is not node[1] for p in known[i][1:]):
                        known[i] = [*known[i], node[1]]
                    break
            else:
                known.append(node)
        return list(out.values())

    def first_error(self, kinds, breaks=None, closers=()) -> int:
        """Index of the first token that no parse can take; -1 where all is valid. The end has index len(kinds)."""
        goto, prods, chains, chain = self.goto, self.prods, self._chains, self._chain
        node, heads = (0, (-1,)), None
        n = len(kinds)
        i = 0
        while True:
            kind = kinds[i] if i < n else 0
            if heads is None:
                while True:
                    if len(node) != 2:
                        a = ()
                        break
                    below = node[1]
                    known, key = chains[below[0]], node[0] * _WIDTH + kind
                    got = known.get(key)
                    if got is None:
                        got = known[key] = chain(below[0], node[0], kind)
                    state, a = got
                    if a is None or type(a) is tuple:
                        break
                    if state != node[0]:
                        node = (state, below)
                    if a > 0:
                        node = (a, node)
                        break
                    if a == _ACCEPT:
                        return -1
                    left, k = prods[-a]
                    base = node
                    while k and len(base) == 2:
                        base = base[1]
                        k -= 1
                    if k:
                        a = ()
                        break
                    node = (goto[base[0]][left], base)
                if a is not None and type(a) is not tuple:
                    i += 1
                    continue
                before = [node]
                new = [] if a is None else self._spread(before, kind) if a else 0
                if new == 0:
                    new = self._step(before, kind)
            else:
                before = heads
                new = self._spread(heads, kind) if len(heads) < 4 else 0
                if new == 0:
                    new = self._step(heads, kind)
            if new is None:
                return -1
            if not new and self.semi >= 0 and (i >= n or breaks[i] or kind in closers):
                supplied = self._step(before, self.semi)
                if supplied:
                    new = self._step(supplied, kind)
                    if new is None:
                        return -1
            if not new:
                return i
            if len(new) == 1:
                node, heads = new[0], None
            else:
                heads = new
            i += 1
