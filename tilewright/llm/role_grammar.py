"""Weighted finite-state composition over (cost, label string): which edits make roles fit a grammar.

Three machines are composed lazily, arc by arc, from the states that a search reaches:

* the input acceptor, a line of the rows' symbols;
* the edit transducer, whose states count the insertions since the last row (two in a row are enough:
  a third would come back to a role already reached, at a higher cost);
* the role grammar, an acceptor of (s?(ua)+)? over role initials.

Arcs go forward in rows or in insertions, so the composed states, layer by layer, are in topological
order, and one pass from the end gives every state its cheapest way on. Weights are pairs of cost and
labels, compared in that order. Of two ways through the same rows from one state to another that cost
the same, neither's labels begin the other's, as more labels on the same rows are insertions, which
cost; so ways through a run of rows may be chosen before what follows is known, and a long
conversation's blocks are searched apart (`block_ways`) and joined (`follow`).
"""

from __future__ import annotations

from functools import lru_cache

#: Symbols of rows: a role initial of the grammar or x for any other; in upper case if the text is cut short; D if the row must go.
MUST_GO, OTHER = "D", "x"
#: Role grammar: state -> {role initial: next state}; 0 is the start, 3 stands after "ua".
GRAMMAR = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
ENDS = (0, 3)
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
REROLE_COST, DELETE_COST, INSERT_COST, CUT_COST = 2, 3, 2, 1
MOST_INSERTS = 2
ROLES = {"u": "user", "a": "assistant"}

Weight = tuple[int, str]


def symbol(initial: str, must_go: bool, cut: bool) -> str:
    if must_go:
        return MUST_GO
    known = initial if initial in ("s", "u", "a") else OTHER
    return known.upper() if cut else known


def edits(row: str | None, inserts: int) -> list[tuple[str, int, str | None, bool]]:
    """Arcs of the edit transducer: label, cost, role given (None: none), whether the row is read."""
    arcs = [(INSERT, INSERT_COST, role, False) for role in ROLES] if inserts < MOST_INSERTS else []
    if row is None:
        return arcs
    if row != MUST_GO:
        cut = CUT_COST if row.isupper() else 0
        arcs += [(KEEP, cut, row.lower(), True), *[(REROLE, REROLE_COST + cut, role, True) for role in ROLES]]
    return [*arcs, (DELETE, DELETE_COST, None, True)]


def composed(row: str | None, inserts: int, state: int) -> list[tuple[str, int, int, int, bool]]:
    """Arcs of edits and grammar together: label, cost, next insertions, next grammar state, whether the row is read."""
    arcs = []
    for label, cost, role, read in edits(row, inserts):
        onward = state if role is None else GRAMMAR[state].get(role)
        if onward is not None:
            arcs.append((label, cost, 0 if read else inserts + 1, onward, read))
    return arcs


def cheapest(rows: str, start: int, ends: tuple[int, ...], last: bool) -> dict[int, Weight]:
    """Of each end state that is reached, the cheapest way there from start. Insertions after the rows only if last."""
    layers: list[list[tuple[int, int]]] = []
    reached = {(0, start)}
    for at in range(len(rows) + 1):
        row = rows[at] if at < len(rows) else None
        layer, following = set(reached), set()
        for inserts in range(MOST_INSERTS + 1):
            for _, _, more, onward, read in (arc for s in sorted(layer) if s[0] == inserts for arc in composed(row, *s) if row is not None or last):
                (following if read else layer).add((more, onward))
        layers.append(sorted(layer, reverse=True))  # most insertions first: an insertion only leads there
        reached = following
    ways: dict[int, Weight] = {}
    for end in ends:
        ahead: dict[tuple[int, int], Weight] = {}
        for at in range(len(rows), -1, -1):
            row = rows[at] if at < len(rows) else None
            here: dict[tuple[int, int], Weight] = {}
            for inserts, state in layers[at]:
                found = [(0, "")] if row is None and state == end else []
                for label, cost, more, onward, read in composed(row, inserts, state) if row is not None or last else []:
                    rest = (ahead if read else here).get((more, onward))
                    if rest is not None:
                        found.append((cost + rest[0], label + rest[1]))
                if found:
                    here[inserts, state] = min(found)
            ahead = here
        if (0, start) in ahead:
            ways[end] = ahead[0, start]
    return ways


@lru_cache(maxsize=1 << 16)
def repair(rows: str) -> Weight:
    """Cost and labels of the cheapest edits of a whole conversation."""
    return min(cheapest(rows, 0, ENDS, True).values())


def block_ways(rows: str) -> dict[tuple[int, int], Weight]:
    """The cheapest way through a block of rows for each pair of a state before and a state after it."""
    return {(start, end): way for start in GRAMMAR for end, way in cheapest(rows, start, tuple(GRAMMAR), False).items()}


def follow(blocks: list[dict[tuple[int, int], Weight]]) -> tuple[Weight, list[tuple[int, int]]]:
    """Cost and labels of the cheapest way through all blocks, insertions after them included, and the states before and after each."""
    ahead: dict[int, tuple[Weight, tuple]] = {state: (min(cheapest("", state, ENDS, True).values()), ()) for state in GRAMMAR}
    for block in reversed(blocks):
        here: dict[int, tuple[Weight, tuple]] = {}
        for (start, end), (cost, labels) in block.items():
            if end in ahead:
                (more, rest), path = ahead[end]
                way = ((cost + more, labels + rest), ((start, end), path))
                if start not in here or way[0] < here[start][0]:
                    here[start] = way
        ahead = here
    weight, path = ahead[0]
    states = []
    while path:
        step, path = path
        states.append(step)
    return weight, states


def given(labels: str, initials: list[str], start: int = 0) -> list[tuple[str | None, int | None]]:
    """What each label leaves: the role it writes (None: the row's own) and the row (None: inserted); deleted rows are not in it."""
    left, at, state = [], 0, start
    for label in labels:
        row = None if label == INSERT else at
        at += label != INSERT
        if label == DELETE:
            continue
        role = initials[row] if label == KEEP else next(r for r in GRAMMAR[state] if r in ROLES)
        left.append((None if label == KEEP else ROLES[role], row))
        state = GRAMMAR[state][role]
    return left
