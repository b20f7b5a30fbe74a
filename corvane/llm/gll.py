"""A small generalised LL recogniser with a graph-structured stack, for ambiguous local grammars."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence

Grammar = dict[str, list[tuple[str, ...]]]


class GLL:
    """Symbols that are keys of the grammar are nonterminals, all others are kinds of tokens."""

    def __init__(self, grammar: Grammar):
        self.grammar = grammar
        self.first = self._firsts()

    def _firsts(self) -> dict[str, tuple[set[str], bool]]:
        """Kinds a nonterminal may start with, and whether it may be empty: descriptors that can't match are never made."""
        kinds = {n: set() for n in self.grammar}
        empty = dict.fromkeys(self.grammar, False)
        changed = True
        while changed:
            changed = False
            for n, alternatives in self.grammar.items():
                for alternative in alternatives:
                    can_be_empty = True
                    for symbol in alternative:
                        new = kinds[symbol] if symbol in self.grammar else {symbol}
                        if not new <= kinds[n]:
                            kinds[n] |= new
                            changed = True
                        if not (symbol in self.grammar and empty[symbol]):
                            can_be_empty = False
                            break
                    if can_be_empty and not empty[n]:
                        empty[n] = changed = True
        return {n: (kinds[n], empty[n]) for n in self.grammar}

    def spans(self, kinds: Sequence[str], start: str, at: int, keep: str) -> tuple[set[int], set[tuple[int, int]]]:
        """Places where `start` may end if it begins at `at`, and the spans of `keep` recognised on the way."""
        grammar, n = self.grammar, len(kinds)
        edges: dict[tuple[str, int], list] = defaultdict(list)  # the stack: a node is a nonterminal and where it began
        popped: dict[tuple[str, int], set[int]] = defaultdict(set)
        seen: set = set()
        work: list = []

        def add(symbols: tuple[str, ...], dot: int, node: tuple[str, int], i: int) -> None:
            d = (symbols, dot, node, i)
            if d not in seen:
                seen.add(d)
                work.append(d)

        def call(name: str, i: int) -> None:
            here = kinds[i] if i < n else ""
            for alternative in grammar[name]:
                if alternative and alternative[0] not in grammar and alternative[0] != here:
                    continue
                if alternative and alternative[0] in grammar:
                    first, empty = self.first[alternative[0]]
                    if not empty and here not in first:
                        continue
                add(alternative, 0, (name, i), i)

        root = (start, at)
        call(start, at)
        while work:
            symbols, dot, node, i = work.pop()
            while dot < len(symbols) and symbols[dot] not in grammar:
                if i >= n or kinds[i] != symbols[dot]:
                    break
                dot += 1
                i += 1
            else:
                if dot == len(symbols):
                    if i not in popped[node]:
                        popped[node].add(i)
                        for caller_symbols, caller_dot, caller in edges[node]:
                            add(caller_symbols, caller_dot, caller, i)
                    continue
                below = (symbols[dot], i)
                edge = (symbols, dot + 1, node)
                if edge not in edges[below]:
                    new = not edges[below]
                    edges[below].append(edge)
                    for end in popped[below]:
                        add(symbols, dot + 1, node, end)
                    if new and below != root:
                        call(symbols[dot], i)
        kept = {(node[1], end) for node, ends in popped.items() if node[0] == keep for end in ends}
        return popped[root], kept
