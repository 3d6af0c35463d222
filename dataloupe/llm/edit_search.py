"""Cheapest edits that give a list of turns the order system?, (user, assistant)+, or nothing.

A turn is a letter (``s``, ``u``, ``a`` or ``x`` for any other role) and a fault (``b`` blank, ``d``
duplicate, ``t`` truncated, ``-`` none). The edits in ASCII order are D(elete) at cost 3, I(nsert) at
2, K(eep) at 0 and R(erole) at 2; blank and duplicate turns must go, and a truncated turn that
stays costs 1 more. As inserted and renamed turns are users or assistants, at most one letter
is possible after each state, so that the edits' letters alone tell the repaired roles.
"""

from __future__ import annotations

from functools import lru_cache

START, SYSTEM, USER, ASSISTANT = range(4)  # what the turn before was
STATES = (START, SYSTEM, USER, ASSISTANT)
STATE_OF = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
FOLLOWS = {START: "su", SYSTEM: "u", USER: "a", ASSISTANT: "u"}
BROUGHT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}  # by I and R
ROLE_OF = {USER: "user", ASSISTANT: "assistant"}
EDITS = "DIKR"
TAIL = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}  # inserts that complete a list
LEGAL = {"su", "ua", "au"}
DELETE_COST, INSERT_COST, REROLE_COST, TRUNCATED_COST = 3, 2, 2, 1


class Search:
    """Iterative-deepening A* over (next turn, state), one cost bound after the other.

    With ``goal`` the edits lead exactly to that state and end with the last turn; without it
    they lead to a complete list, with inserts after the last turn where needed. Depth first
    in ASCII order, so the first path within the least sufficient bound is the answer.

    The lower bound of what is left: 3 for each turn that must go, 1 for each truncated one, and
    1 for each two neighbours, of those that may stay, that cannot follow each other. A run of k
    changed turns costs 2 k at least beyond that and touches k + 1 <= 2 k such places, and
    an insert costs 2 and mends one, so the bound never exceeds the true cost.
    """

    def __init__(self, letters: str, faults: str, goal: int | None = None):
        self.letters, self.faults, self.goal = letters, faults, goal
        self.n = len(letters)
        self.failed: dict[tuple[int, int], int] = {}  # most cost that was tried in vain
        self.ahead = self._ahead()

    def _ends(self, state: int) -> bool:
        return state == self.goal if self.goal is not None else state in (START, ASSISTANT)

    def _ahead(self) -> list[tuple[int, ...]]:
        """The lower bound for each next turn and state."""
        sure, following = 0, None  # cost from the turn on; the next turn that may stay
        rows = [tuple(0 if self._ends(q) else 1 for q in STATES)]
        for letter, fault in zip(reversed(self.letters), reversed(self.faults)):
            if fault in "bd":
                sure += DELETE_COST
            else:
                state = STATE_OF.get(letter)
                if following is None:
                    sure += state is None or not self._ends(state)
                else:
                    sure += state is None or following not in FOLLOWS[state]
                sure += TRUNCATED_COST if fault == "t" else 0
                following = letter
            if following is None:
                rows.append(tuple(sure + (0 if self._ends(q) else 1) for q in STATES))
            else:
                rows.append(tuple(sure + (following not in FOLLOWS[q]) for q in STATES))
        return rows[::-1]

    def _after(self, i: int, state: int, edit: str) -> tuple[int, int, int] | None:
        """Next turn, state and cost after an edit; None if it is not possible."""
        if edit == "I":
            if i == self.n and self.goal is not None:
                return None
            return i, BROUGHT[state], INSERT_COST
        if i == self.n:
            return None
        if edit == "D":
            return i + 1, state, DELETE_COST
        fault = self.faults[i]
        if fault in "bd":
            return None
        extra = TRUNCATED_COST if fault == "t" else 0
        if edit == "R":
            return i + 1, BROUGHT[state], REROLE_COST + extra
        letter = self.letters[i]
        return (i + 1, STATE_OF[letter], extra) if letter in FOLLOWS[state] else None

    def _possible(self, start: int) -> bool:
        if self.goal == START:
            return start == START
        if self.goal == SYSTEM:
            kept = any(c == "s" and f in "-t" for c, f in zip(self.letters, self.faults))
            return start == SYSTEM or start == START and kept
        return self.n > 0 or self.goal is None or start == self.goal

    def cheapest(self, start: int) -> tuple[int, str] | None:
        """The least cost and the ASCII-least edits of that cost from a state, or None. What
        failed on the way to a goal also fails from other first states, so it is kept."""
        if not self._possible(start):
            return None
        # Deleting everything and inserting the missing turns is always possible.
        most = DELETE_COST * self.n + 2 * INSERT_COST
        if self.goal == SYSTEM:
            most += TRUNCATED_COST
        for bound in range(self.ahead[0][start], most + 1):
            edits = self._within(start, bound)
            if edits is not None:
                return bound, edits
        return None

    def _within(self, start: int, bound: int) -> str | None:
        failed, ahead, n = self.failed, self.ahead, self.n
        path: list[str] = []
        frames = [[0, start, bound, 0]]  # next turn, state, cost left, next edit to try
        while frames:
            frame = frames[-1]
            i, state, left, tried = frame
            if tried == 0 and i == n and self._ends(state):
                return "".join(path)
            while tried < len(EDITS):
                edit = EDITS[tried]
                tried += 1
                found = self._after(i, state, edit)
                if found is None:
                    continue
                j, then, cost = found
                rest = left - cost
                if rest >= ahead[j][then] and failed.get((j, then), -1) < rest:
                    frame[3] = tried
                    frames.append([j, then, rest, 0])
                    path.append(edit)
                    break
            else:
                failed[i, state] = max(left, failed.get((i, state), -1))
                frames.pop()
                if path:
                    path.pop()
        return None


@lru_cache(maxsize=4096)
def whole(letters: str, faults: str) -> tuple[int, str]:
    """Cost and edits of a whole list of turns; many lists are alike."""
    return Search(letters, faults).cheapest(START)


def block(letters: str, faults: str) -> list[tuple[int, str] | None]:
    """Cost and edits of a part of a list from each state to each state, row by row."""
    searches = [Search(letters, faults, goal) for goal in STATES]
    return [search.cheapest(start) for start in STATES for search in searches]


def steps(edits: str, letters: str, start: int) -> list[tuple[int, str, str | None]]:
    """For each edit: the number of turns before it, its letter, the role that it brings in."""
    out, at, state = [], 0, start
    for edit in edits:
        role = None
        if edit in "IR":
            state = BROUGHT[state]
            role = ROLE_OF[state]
        elif edit == "K":
            state = STATE_OF[letters[at]]
        out.append((at, edit, role))
        at += edit != "I"
    return out


def illegal(letters: str) -> int:
    return sum(a + b not in LEGAL for a, b in zip(letters, letters[1:]))


# Parts of a list follow each other. Edits of a part end with its last turn, so none is the
# beginning of another one of the same part, and which of two lists of edits is ASCII-least
# is decided by the first part in which they differ: ranks within a part are enough.


def ranks(found: list[tuple[int, str] | None]) -> list[int]:
    """The place of each entry of ``block`` among those with the same first state."""
    out = [0] * len(found)
    for a in STATES:
        present = [i for i in range(4 * a, 4 * a + 4) if found[i] is not None]
        for place, i in enumerate(sorted(present, key=lambda i: found[i][1])):
            out[i] = place
    return out


def _choices(parts: list[tuple[list, list]], goal: int) -> tuple[list, list[list]]:
    """Least cost from each state to ``goal`` over all parts, and the next state to take in
    each part and state."""
    after: list = [0 if q == goal else None for q in STATES]
    taken = []
    for costs, places in reversed(parts):
        now, pick = [None] * 4, [None] * 4
        for a in STATES:
            ways = [
                (costs[4 * a + b] + after[b], places[4 * a + b], b)
                for b in STATES
                if costs[4 * a + b] is not None and after[b] is not None
            ]
            if ways:
                now[a], _, pick[a] = min(ways)
        after = now
        taken.append(pick)
    return after, taken[::-1]


def _walk(taken: list[list], state: int) -> list[int]:
    out = [state]
    for pick in taken:
        out.append(pick[out[-1]])
    return out


def joined(parts: list[tuple[list, list]]) -> tuple[list, list[int]]:
    """Costs and ranks of several parts in a row, each given as (costs, ranks)."""
    costs, walked = [None] * 16, [None] * 16
    for b in STATES:
        least, taken = _choices(parts, b)
        for a in STATES:
            if least[a] is not None:
                way = _walk(taken, a)
                costs[4 * a + b] = least[a]
                walked[4 * a + b] = [p[1][4 * x + y] for p, x, y in zip(parts, way, way[1:])]
    found = [None if c is None else (c, w) for c, w in zip(costs, walked)]
    return costs, ranks(found)


def route(parts: list[tuple[list, list]], start: int, goal: int) -> list[int]:
    """The states between the parts on the best way, the first and the last included."""
    return _walk(_choices(parts, goal)[1], start)


def best_end(costs: list, places: list[int]) -> tuple[int, int]:
    """Cost and last state of a whole list, its completing inserts included."""
    ways = [
        (costs[b] + INSERT_COST * len(TAIL[b]), places[b], b) for b in STATES if costs[b] is not None
    ]
    cost, _, goal = min(ways)
    return cost, goal
