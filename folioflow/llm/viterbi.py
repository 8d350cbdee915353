"""Cheapest edits that give a conversation a lawful order of roles, chunk by chunk.

States say what the last kept row was. Cost vectors run backwards: entry q is the least cost
from state q to the end. A chunk first runs from one speculative vector. Every other vector
that can stand at its end is fixed up: it reruns until it differs from the speculative one
only by a constant, and shares the rest of its run. So each chunk is known by itself, and a
walk over the chunks of a conversation stitches the true vectors and states together.

Rows that must go cost 4 in every state. They change vectors by a constant only and take no
part; their letter is ``D`` at their place.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import cache

START, SYSTEM, USER, ASSISTANT = range(4)
KEEP, REROLE, DELETE, INSERT = "KRDI"
DELETE_COST, REROLE_COST, INSERT_COST, TRUNCATED_COST = 4, 3, 3, 3

Vector = tuple[int, int, int, int]
States = tuple[int, int, int, int]

# The state and role that an inserted or renamed row leads to.
_NEXT = (USER, USER, ASSISTANT, USER)
ROLES = (b"user", b"user", b"assistant", b"user")
# Where a kept row leads to, by its role's initial.
_KEPT = {
    "s": {START: SYSTEM},
    "u": {START: USER, SYSTEM: USER, ASSISTANT: USER},
    "a": {USER: ASSISTANT},
    "-": {},
}
KINDS = "sua-"


def symbol(kind: str, truncated: bool) -> int:
    """A row as a number: its role's initial (``-`` for any other) and whether it is truncated."""
    return 2 * KINDS.index(kind) + truncated


def _inserting(costs: Sequence[int]) -> list[int]:
    """Costs when rows may be inserted first; two are always enough."""
    out = list(costs)
    for _ in range(2):
        out = [min(c, INSERT_COST + out[_NEXT[q]]) for q, c in enumerate(out)]
    return out


@cache
def _raw(after: Vector, sign: int) -> tuple[int, ...]:
    """Costs before a row from those after it."""
    kept, extra = _KEPT[KINDS[sign >> 1]], TRUNCATED_COST * (sign & 1)
    costs = []
    for q in range(4):
        ways = [DELETE_COST + after[q], REROLE_COST + extra + after[_NEXT[q]]]
        if q in kept:
            ways.append(extra + after[kept[q]])
        costs.append(min(ways))
    return tuple(_inserting(costs))


@cache
def step(after: Vector, sign: int) -> tuple[Vector, int]:
    """The vector before a row, its least entry taken out, and that entry."""
    costs = _raw(after, sign)
    least = min(costs)
    return tuple(c - least for c in costs), least


@cache
def edit(after: Vector, sign: int, state: int) -> tuple[str, int]:
    """Letters of the cheapest edits up to a row, least in ASCII, and the state behind it."""
    costs = _raw(after, sign)
    kept, extra = _KEPT[KINDS[sign >> 1]], TRUNCATED_COST * (sign & 1)
    letters, q = "", state
    while True:
        if DELETE_COST + after[q] == costs[q]:
            return letters + DELETE, q
        if INSERT_COST + costs[_NEXT[q]] == costs[q]:
            letters, q = letters + INSERT, _NEXT[q]
        elif q in kept and extra + after[kept[q]] == costs[q]:
            return letters + KEEP, kept[q]
        else:
            return letters + REROLE, _NEXT[q]


# A conversation ends lawfully where it never began or with an assistant.
END: Vector = tuple(_inserting([0, 99, 99, 0]))
# Inserted rows that bring each state to such an end.
CLOSING = ("", INSERT * 2, INSERT, "")


def _vectors() -> list[Vector]:
    found = [END]
    for vector in found:
        for sign in range(2 * len(KINDS)):
            before = step(vector, sign)[0]
            if before not in found:
                found.append(before)
    return found


# All vectors that can occur, constants apart: three dozen at most, whatever the rows are.
VECTORS = _vectors()
NUMBER = {v: i for i, v in enumerate(VECTORS)}


def _then(first: States, second: States) -> States:
    return tuple(second[q] for q in first)


@cache
def _moves(after: Vector, sign: int) -> States:
    return tuple(edit(after, sign, q)[1] for q in range(4))


def backwards(signs: Sequence[int], vector: Vector = END) -> tuple[list[Vector], list[int]]:
    """The vector at each place of a chunk, last place first, and the constants taken out up to there."""
    vectors, constants, total = [vector], [0], 0
    for sign in reversed(signs):
        vector, least = step(vector, sign)
        total += least
        vectors.append(vector)
        constants.append(total)
    return vectors, constants


def summary(signs: Sequence[int]) -> list[tuple[int, int, States]]:
    """For each vector at the chunk's end: the one at its beginning, the constant, the states it leads to."""
    n = len(signs)
    vectors, constants = backwards(signs)
    # States from the chunk's beginning up to each place, in the speculative run.
    upto: list[States] = [(0, 1, 2, 3)]
    for i, sign in enumerate(signs):
        upto.append(_then(upto[-1], _moves(vectors[n - i - 1], sign)))
    out = []
    for vector in VECTORS:
        moves, total, done = (0, 1, 2, 3), 0, 0
        while done < n and vector != vectors[done]:
            sign = signs[n - done - 1]
            moves = _then(_moves(vector, sign), moves)
            vector, least = step(vector, sign)
            total += least
            done += 1
        if vector == vectors[done]:
            total += constants[n] - constants[done]
            vector = vectors[n]
            moves = _then(upto[n - done], moves)
        out.append((NUMBER[vector], total, moves))
    return out


def trace(signs: Sequence[int | None], vector: Vector, state: int) -> Iterator[str]:
    """Letters for each row of a chunk, from its first state and the vector at its end; None: must go."""
    live = [s for s in signs if s is not None]
    vectors, _ = backwards(live, vector)
    at = len(live)
    for sign in signs:
        if sign is None:
            yield DELETE
            continue
        at -= 1
        letters, state = edit(vectors[at], sign, state)
        yield letters
