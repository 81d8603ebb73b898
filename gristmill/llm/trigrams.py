"""Boolean trigram queries derived from regular expressions.

A query is True (nothing is mandatory), a trigram, or ("and" | "or", parts).
It holds for every text in which the expression matches, so texts for which it
does not hold need not be searched.  Trigrams are lower-case; a case-sensitive
expression is looked up in the same way and only finds more to verify.  A
letter that folds to others beyond ASCII, and any character beyond it, counts
as unknown, so an index may fold A-Z alone.

For each node of the parsed expression two things are kept: the set of all
strings it can match, while that is small, and a query that any match implies.
A concatenation multiplies the sets; when a set grows too large or its next
part is unbounded, its strings are turned into trigrams.
"""

from __future__ import annotations

import re
from itertools import product
from re import _constants as k
from re import _parser as parser

import numpy as np

Query = bool | str | tuple[str, frozenset]

#: Strings of a set, and characters of a class, that are worked out.
MOST = 24
#: Bytes of text that are indexed at once.
_BYTES = 1 << 21


def both(a: Query, b: Query) -> Query:
    return _join("and", [a, b])


def _join(kind: str, parts: list[Query]) -> Query:
    flat: set = set()
    for p in parts:
        if p is True:
            if kind == "or":
                return True
        elif isinstance(p, tuple) and p[0] == kind:
            flat |= p[1]
        else:
            flat.add(p)
    if not flat:
        return True
    return next(iter(flat)) if len(flat) == 1 else (kind, frozenset(flat))


def _of_string(s: str) -> Query:
    return _join("and", [s[i : i + 3] for i in range(len(s) - 2)])


def _of_set(strings: set[str]) -> Query:
    return _join("or", [_of_string(s) for s in strings]) if strings else True


def _known(c: int, folds: bool) -> bool:
    """Whether a character stands for itself and its other case alone."""
    return c < 128 and not (folds and chr(c) in "iksIKS")


def _class(items: list, folds: bool) -> set[str] | None:
    found: set[str] = set()
    for op, value in items:
        if op is k.LITERAL:
            codes = [value]
        elif op is k.RANGE and value[1] - value[0] < MOST:
            codes = list(range(value[0], value[1] + 1))
        else:
            return None
        if not all(_known(c, folds) for c in codes):
            return None
        found |= {chr(c).lower() for c in codes}
    return found


def _walk(nodes, folds: bool) -> tuple[set[str] | None, Query]:
    """The strings (None: not known) and the query of a sequence."""
    whole, query, run = True, True, {""}
    for op, value in nodes:
        strings, implied = _node(op, value, folds)
        query = both(query, implied)
        if strings is not None and len(run) * len(strings) <= MOST:
            run = {a + b for a, b in product(run, strings)}
            continue
        query, whole = both(query, _of_set(run)), False
        run = strings if strings is not None and len(strings) <= MOST else {""}
    if whole:
        return run, query
    return None, both(query, _of_set(run))


def _node(op, value, folds: bool) -> tuple[set[str] | None, Query]:
    if op is k.LITERAL:
        return ({chr(value).lower()} if _known(value, folds) else None), True
    if op is k.IN:
        return _class(value, folds), True
    if op is k.SUBPATTERN:
        return _walk(value[3], folds)
    if op is k.BRANCH:
        parts = [_walk(p, folds) for p in value[1]]
        known = None if any(s is None for s, _ in parts) else set().union(*(s for s, _ in parts))
        if known is not None and len(known) <= MOST:
            return known, _join("or", [q for _, q in parts])
        return None, _join("or", [q if s is None else both(q, _of_set(s)) for s, q in parts])
    if op in (k.MAX_REPEAT, k.MIN_REPEAT, k.POSSESSIVE_REPEAT):
        least, most, inner = value
        strings, query = _walk(inner, folds)
        if least == 0:
            return ({""} | strings if most == 1 and strings is not None else None), True
        if least == most == 1:
            return strings, query
        return None, query if strings is None else both(query, _of_set(strings))
    if op is k.AT:
        return {""}, True
    return None, True


def trigram_query(pattern: str, flags: int = 0) -> Query:
    """The query of an expression; True if no trigram is mandatory."""
    strings, query = _walk(parser.parse(pattern, flags), bool(flags & re.IGNORECASE) and not flags & re.ASCII)
    return query if strings is None else both(query, _of_set(strings))


def trigrams(query: Query) -> set[str]:
    """All trigrams that a query names."""
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(trigrams, query[1]))


class Index:
    """Postings of some trigrams over a block of texts, made in one pass over their bytes.

    ``raw`` holds the texts one after another in UTF-8, ``ends`` where each
    ends.  Only trigrams that queries name are kept; all others are dropped as
    they are met.
    """

    def __init__(self, named: list[str], raw: np.ndarray, ends: np.ndarray) -> None:
        code = {t: (ord(t[0]) << 16) | (ord(t[1]) << 8) | ord(t[2]) for t in named}
        place = np.zeros(1 << 24, np.uint16)
        for i, t in enumerate(named, 1):
            place[code[t]] = i
        found = []
        for lo in range(0, len(raw), _BYTES):
            part = raw[lo : lo + _BYTES + 2].astype(np.uint32)
            part |= ((part >= 65) & (part <= 90)).astype(np.uint32) << 5
            which = place[(part[:-2] << 16) | (part[1:-1] << 8) | part[2:]]
            at = np.flatnonzero(which)
            text = np.searchsorted(ends, lo + at, "right")
            inside = lo + at + 2 < ends[text]
            found.append(np.unique(which[at][inside].astype(np.int64) * len(ends) + text[inside]))
        pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        cuts = np.searchsorted(pairs, np.arange(1, len(named) + 2) * len(ends))
        self.every = np.arange(len(ends))
        self.postings = {t: pairs[a:b] % len(ends) for t, a, b in zip(named, cuts, cuts[1:])} if len(ends) else dict.fromkeys(named, pairs)

    def rows(self, query: Query) -> np.ndarray:
        """The texts for which a query holds, by intersecting and joining postings."""
        if query is True:
            return self.every
        if isinstance(query, str):
            return self.postings[query]
        parts = sorted((self.rows(p) for p in query[1]), key=len)
        if query[0] == "or":
            return np.unique(np.concatenate(parts))
        out = parts[0]
        for p in parts[1:]:
            out = np.intersect1d(out, p, assume_unique=True)
        return out
