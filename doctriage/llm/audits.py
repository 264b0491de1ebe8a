"""The cheapest edits that make a sequence of roles alternate, with their audit string.

Kept turns must read ``(s?(ua)+)?`` by the initials of their roles.  An automaton of four states
follows what has been put out: nothing, the system turn, a user turn, an assistant turn.  For each
state the program keeps the cheapest edits so far; their letters are a node of a tree that all states
share, so a step costs one node for each state, however long the edits before it are.

Of equally cheap edits the ones whose letters come first win.  Two nodes are compared at the end of
their longest common prefix, which binary lifting over ancestors finds by rolling hashes; a hash
that agrees is verified letter by letter up to the node both share.
"""

from __future__ import annotations

EMPTY, SYSTEM, USER, ASSISTANT = range(4)
STATES = 4
KEEP, REROLE, DELETE, INSERT = "KRDI"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 2, 3, 2, 1
INITIALS = "uasx"  # x: any other
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
PRIME, BASE = (1 << 61) - 1, 0x5DEECE66D


def code(initial: int, fault: int) -> str:
    """A turn as one letter: the place of its initial in ``INITIALS`` and its first fault."""
    return chr(ord("A") + initial + 4 * fault)


def decoded(letter: str) -> tuple[str, int]:
    number = ord(letter) - ord("A")
    return INITIALS[number % 4], number // 4


class Edits:
    """Persistent strings of edit letters; node 0 is the empty one."""

    def __init__(self, hash_of=lambda before, letter: (before * BASE + ord(letter)) % PRIME):
        self.hash_of = hash_of
        self.letters, self.depths, self.hashes = [""], [0], [0]
        self.ancestors: list[list[int]] = [[]]  # 1, 2, 4, ... letters shorter

    def add(self, node: int, letter: str) -> int:
        own = [node]
        while len(self.ancestors[own[-1]]) >= len(own):
            own.append(self.ancestors[own[-1]][len(own) - 1])
        self.letters.append(letter)
        self.depths.append(self.depths[node] + 1)
        self.hashes.append(self.hash_of(self.hashes[node], letter))
        self.ancestors.append(own)
        return len(self.letters) - 1

    def lifted(self, node: int, depth: int) -> int:
        """The beginning of ``node`` of ``depth`` letters."""
        while (over := self.depths[node] - depth) > 0:
            node = self.ancestors[node][over.bit_length() - 1]
        return node

    def equal(self, left: int, right: int) -> bool:
        """Whether strings of equal length are equal: hashes first, then letters while nodes differ."""
        if self.hashes[left] != self.hashes[right]:
            return False
        while left != right:
            if self.letters[left] != self.letters[right]:
                return False
            left, right = self.ancestors[left][0], self.ancestors[right][0]
        return True

    def less(self, left: int, right: int) -> bool:
        """Whether the letters of ``left`` come before those of ``right``."""
        depth = min(self.depths[left], self.depths[right])
        a, b = self.lifted(left, depth), self.lifted(right, depth)
        if self.equal(a, b):
            return self.depths[left] < self.depths[right]
        for step in reversed(range(depth.bit_length())):
            if step < len(self.ancestors[a]):
                up, other = self.ancestors[a][step], self.ancestors[b][step]
                if not self.equal(up, other):
                    a, b = up, other
        return self.letters[a] < self.letters[b]

    def text(self, node: int) -> str:
        out = []
        while node:
            out.append(self.letters[node])
            node = self.ancestors[node][0]
        return "".join(reversed(out))


def _next(state: int) -> int:
    """Where the turn that a state asks for leads: an assistant's after a user's, else a user's."""
    return ASSISTANT if state == USER else USER


def _steps(state: int, initial: str, fault: int):
    """``letter, cost, state`` of every sensible edit of one turn."""
    yield DELETE, DELETE_COST, state
    if fault in (BLANK, DUPLICATE):
        return
    more = TRUNCATED_COST * (fault == TRUNCATED)
    if initial == INITIALS[0 if _next(state) == USER else 1]:
        yield KEEP, more, _next(state)
    else:
        yield REROLE, REROLE_COST + more, _next(state)
        if initial == "s" and state == EMPTY:
            yield KEEP, more, SYSTEM


def transfer(codes: str, starts=range(STATES)) -> list[tuple[int, int, int, str]]:
    """``start, end, cost, audit`` of the best edits of a run of turns between any two states."""
    out = []
    for start in starts:
        edits, best = Edits(), {start: (0, 0)}

        def offer(found: dict, state: int, cost: int, node: int, letter: str) -> bool:
            now = found.get(state)
            if now is not None and now[0] < cost:
                return False
            added = edits.add(node, letter)
            if now is None or cost < now[0] or edits.less(added, now[1]):
                found[state] = (cost, added)
                return True
            return False

        def inserted(found: dict) -> None:
            # A user's turn, then an assistant's; a third would lead back to a user's, only dearer.
            for state in (EMPTY, SYSTEM, ASSISTANT, USER):
                if state in found:
                    offer(found, _next(state), found[state][0] + INSERT_COST, found[state][1], INSERT)

        inserted(best)
        for letter in codes:
            following: dict[int, tuple[int, int]] = {}
            for state, (cost, node) in best.items():
                for edit, more, to in _steps(state, *decoded(letter)):
                    offer(following, to, cost + more, node, edit)
            inserted(following)
            best = following
        out += [(start, end, cost, edits.text(node)) for end, (cost, node) in sorted(best.items())]
    return out


def joined(tables: list[list[tuple[int, int, int, str]]]) -> tuple[int, str, list[tuple[int, str]]]:
    """``cost, audit, parts`` of the best edits over adjoining runs; a part is ``start, audit``."""
    best: dict[int, tuple[int, str, list]] = {EMPTY: (0, "", [])}
    for table in tables:
        following: dict[int, tuple[int, str, list]] = {}
        for start, end, cost, audit in table:
            if start in best:
                before = best[start]
                offer = (before[0] + cost, before[1] + audit)
                if end not in following or offer < following[end][:2]:
                    following[end] = (*offer, [*before[2], (start, audit)])
        best = following
    return min((best[state] for state in (EMPTY, ASSISTANT) if state in best), key=lambda x: x[:2])


def role_after(state: int) -> str:
    return "assistant" if _next(state) == ASSISTANT else "user"


class Replay:
    """Applies the edits of a run to its turns, one after the other."""

    def __init__(self, start: int, audit: str):
        self.state, self.audit, self.at = start, audit, 0

    def inserts(self):
        """``edit, role`` of the turns to put in before the next one."""
        while self.at < len(self.audit) and self.audit[self.at] == INSERT:
            role = role_after(self.state)
            self.state, self.at = _next(self.state), self.at + 1
            yield INSERT, role

    def edit(self, role: str) -> tuple[str, str | None]:
        """``edit, role`` of the next turn; no role if it goes."""
        letter = self.audit[self.at]
        self.at += 1
        if letter == DELETE:
            return letter, None
        if letter == KEEP and role[:1] == "s":
            self.state = SYSTEM
            return letter, role
        new = role if letter == KEEP else role_after(self.state)
        self.state = _next(self.state)
        return letter, new
