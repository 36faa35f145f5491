"""Boolean trigram queries of regular expressions.

A query is True (no condition), a trigram, or ("and" | "or", its parts). A text that matches the expression, put
in lower case, satisfies the query. Strings that a part of the expression can match are followed exactly while
they are few; what cannot be followed ends them, and the trigrams within them become conditions.
"""

from __future__ import annotations

import re._constants as C
import re._parser as parser
from itertools import product

FEW = 64


def _all(parts) -> object:
    flat = []
    for p in parts:
        for x in p[1] if isinstance(p, tuple) and p[0] == "and" else [p]:
            if x is not True and x not in flat:
                flat.append(x)
    return True if not flat else flat[0] if len(flat) == 1 else ("and", flat)


def _any(parts) -> object:
    flat = []
    for p in parts:
        if p is True:
            return True
        if p not in flat:
            flat.append(p)
    plain = {i: grams(p) for i, p in enumerate(flat) if isinstance(p, str) or p[0] == "and" and all(isinstance(x, str) for x in p[1])}
    flat = [p for i, p in enumerate(flat) if not any(j != i and plain[j] < plain.get(i, set()) for j in plain)]  # the weaker says it all
    return flat[0] if len(flat) == 1 else ("or", flat)


def _of_strings(strings: set[str]) -> object:
    return _any(_all(s[i : i + 3] for i in range(len(s) - 2)) for s in sorted(strings))


def _chars(node) -> set[str] | None:
    """The characters of a one-character node in lower case, or None if they are many."""
    op, arg = node
    if op is C.LITERAL:
        return {chr(arg).lower()} if arg < 128 else None
    if op is C.IN:
        out: set[str] = set()
        for kind, x in arg:
            if kind is C.LITERAL and x < 128:
                out.add(chr(x).lower())
            elif kind is C.RANGE and x[1] < 128 and x[1] - x[0] < 10:
                out |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
            else:
                return None
        return out if len(out) <= 10 else None
    return None


def _walk(nodes) -> tuple[set[str] | None, object]:
    """(the strings that the nodes match in turn, if few; the query)."""
    whole: set[str] | None = {""}  # exact so far
    run: set[str] = {""}  # exact since the last part that was not
    found = []

    def end() -> None:
        nonlocal run
        found.append(_of_strings(run))
        run = {""}

    def add(strings: set[str]) -> None:
        nonlocal run, whole
        if len(run) * len(strings) > FEW:
            end()
            whole = None
        run = {a + b for a, b in product(run, strings)}
        if whole is not None:
            whole = run

    for op, arg in nodes:
        exact, query = None, True
        if op in (C.LITERAL, C.IN):
            exact = _chars((op, arg))
        elif op is C.SUBPATTERN:
            exact, query = _walk(arg[3])
        elif op is C.BRANCH:
            each = [_walk(x) for x in arg[1]]
            exact = set().union(*(x[0] for x in each)) if all(x[0] is not None for x in each) else None
            query = _any(x[1] for x in each)
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            low, high, body = arg
            inner, inner_query = _walk(body)
            if inner is not None and high <= 3 and (len(inner) + 1) ** int(high) <= FEW:
                exact = {"".join(x) for n in range(low, high + 1) for x in product(inner, repeat=n)}
            elif low:  # at least its first `low` turns
                if inner is not None and len(inner) ** min(low, 3) <= FEW:
                    add({"".join(x) for x in product(inner, repeat=min(low, 3))})
                query = inner_query
        elif op is C.AT or op is C.ASSERT or op is C.ASSERT_NOT:
            continue
        if exact is not None and len(exact) <= FEW:
            add(exact)
        else:
            found.append(query)
            end()
            whole = None
    if whole is None:
        end()
        return None, _all(found)
    return whole, _of_strings(whole)


def trigram_query(pattern: str) -> object:
    return _walk(parser.parse(pattern))[1]


def grams(query: object) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(grams, query[1]))


def holds(query: object, text: str) -> bool:
    """Whether a text satisfies a query; the plan's expression says the same of posting lists."""
    if query is True:
        return True
    if isinstance(query, str):
        return query in text.lower()
    return (all if query[0] == "and" else any)(holds(x, text) for x in query[1])


