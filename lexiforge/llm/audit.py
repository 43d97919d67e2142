"""Cheapest edits that bring a run of turns into the grammar ``(s?(ua)+)?``, ties to the ASCII-least audit.

A dynamic programme over the grammar's four states keeps for each state the cheapest way there and, of
equally cheap ones, the one whose audit (the initials of its edits) is least.  Audits are persistent:
a prefix is a linked node that all of its continuations share.  Each node has its depth, a rolling hash of
its letters and its ancestors 1, 2, 4, ... edges up.  Two audits are compared by a search over those
ancestors for their longest common prefix and then by one letter.  Equal hashes are verified letter by
letter; pairs of nodes that were found equal are united, so that no letter is compared twice.

Long conversations are cut into blocks.  A block is solved from each state it may begin in, inserts
standing before the turns they precede, so that all audits of one beginning take the same turns, none is
another's prefix, and which is less shows within the block.  Its costs and the ranks of its audits, four by
four numbers each, are all that neighbouring blocks need to know (``choices``).
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

#: The grammar's states: at the start, after a system turn, after a user, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
#: What is missing at the end of a conversation in each state.
CLOSING = ("", "II", "I", "")
KEEP_COST, REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 0, 2, 3, 2, 1
_FAR = 1 << 60
_MOD, _BASE = (1 << 61) - 1, 1_000_003


class Audits:
    """Audits as nodes that share their prefixes; node 0 is the empty one."""

    def __init__(self, mod: int = _MOD):
        self.mod = mod
        self.letter, self.depth, self.hash, self.up, self.same = [""], [0], [0], [[]], [0]

    def add(self, parent: int, letter: str) -> int:
        node = len(self.letter)
        above, at, k = [parent], parent, 0
        while k < len(self.up[at]):
            at = self.up[at][k]
            above.append(at)
            k += 1
        self.letter.append(letter)
        self.depth.append(self.depth[parent] + 1)
        self.hash.append((self.hash[parent] * _BASE + ord(letter)) % self.mod)
        self.up.append(above)
        self.same.append(node)
        return node

    def _class(self, node: int) -> int:
        same = self.same
        while same[node] != node:
            same[node] = same[same[node]]
            node = same[node]
        return node

    def _equal(self, a: int, b: int) -> bool:
        """Whether two audits of one length are the same letters."""
        if self.hash[a] != self.hash[b]:
            return False
        walked = []
        while (x := self._class(a)) != (y := self._class(b)):
            if self.letter[a] != self.letter[b]:
                return False
            walked.append((x, y))
            a, b = self.up[a][0], self.up[b][0]
        for x, y in walked:
            self.same[self._class(x)] = self._class(y)
        return True

    def _raised(self, node: int, depth: int) -> int:
        over = self.depth[node] - depth
        k = 0
        while over:
            if over & 1:
                node = self.up[node][k]
            over >>= 1
            k += 1
        return node

    def less(self, a: int, b: int) -> bool:
        """Whether audit a stands before audit b in ASCII order; a prefix stands first."""
        shared = min(self.depth[a], self.depth[b])
        x, y = self._raised(a, shared), self._raised(b, shared)
        if self._equal(x, y):
            return self.depth[a] < self.depth[b]
        # The highest ancestors that still differ are one letter below the longest common prefix.
        for k in range(len(self.up[x]) - 1, -1, -1):
            if k < len(self.up[x]) and not self._equal(self.up[x][k], self.up[y][k]):
                x, y = self.up[x][k], self.up[y][k]
        return self.letter[x] < self.letter[y]

    def text(self, node: int) -> str:
        out = []
        while node:
            out.append(self.letter[node])
            node = self.up[node][0]
        return "".join(reversed(out))


#: (from, to) of an inserted turn, in the order in which two of them can follow each other.
_INSERTS = ((START, USER), (SYSTEM, USER), (ASSISTANT, USER), (USER, ASSISTANT))
#: (from, to, initial) of a turn that stays.
_TURNS = ((START, USER, "u"), (SYSTEM, USER, "u"), (ASSISTANT, USER, "u"), (USER, ASSISTANT, "a"))


class _Best:
    """The cheapest way into each state; each way is a prefix and the letter after it."""

    def __init__(self, audits: Audits):
        self.audits = audits
        self.cost, self.node = [_FAR] * 4, [0] * 4

    def offer(self, state: int, cost: int, parent: int, letter: str) -> None:
        if cost > self.cost[state]:
            return
        node = self.audits.add(parent, letter)
        if cost < self.cost[state] or self.audits.less(node, self.node[state]):
            self.cost[state], self.node[state] = cost, node


def solve(turns: Sequence[tuple[str, bool, bool]], begin: int, audits: Audits) -> tuple[list[int], list[int]]:
    """(cost, audit) of the best way from begin over all turns into each state.  A turn is (role initial,
    must be deleted, truncated)."""
    best = _Best(audits)
    best.cost[begin] = 0
    for initial, doomed, cut in turns:
        for a, b in _INSERTS:
            if best.cost[a] < _FAR:
                best.offer(b, best.cost[a] + INSERT_COST, best.node[a], "I")
        after = _Best(audits)
        cost, node = best.cost, best.node
        for state in range(4):
            if cost[state] < _FAR:
                after.offer(state, cost[state] + DELETE_COST, node[state], "D")
        if not doomed:
            extra = TRUNCATED_COST if cut else 0
            for a, b, wanted in _TURNS:
                if cost[a] < _FAR:
                    if initial == wanted:
                        after.offer(b, cost[a] + KEEP_COST + extra, node[a], "K")
                    else:
                        after.offer(b, cost[a] + REROLE_COST + extra, node[a], "R")
            if initial == "s" and cost[START] < _FAR:
                after.offer(SYSTEM, cost[START] + KEEP_COST + extra, node[START], "K")
        best = after
    return best.cost, best.node


@dataclass
class Block:
    """costs and ranks by beginning and end, four by four in rows."""

    costs: list[int]
    ranks: list[int]


def block(turns: Sequence[tuple[str, bool, bool]]) -> Block:
    costs, ranks = [], []
    for begin in range(4):
        audits = Audits()
        cost, node = solve(turns, begin, audits)
        ends = [s for s in range(4) if cost[s] < _FAR]
        costs += cost
        ranks += [sum(audits.less(node[t], node[s]) for t in ends) if s in ends else 4 for s in range(4)]
    return Block(costs, ranks)


def choices(blocks: Sequence[Block]) -> tuple[int, list[int]]:
    """(cost, states between the blocks) of the best way over all blocks: the state that each block
    begins in and that the last one ends in."""
    ahead = [INSERT_COST * len(c) for c in CLOSING]
    ends: list[list[int]] = []
    for b in reversed(blocks):
        pick, total = [], []
        for begin in range(4):
            row = range(4 * begin, 4 * begin + 4)
            total.append(min(b.costs[k] + ahead[k - 4 * begin] for k in row))
            pick.append(min((b.ranks[k], k - 4 * begin) for k in row if b.costs[k] + ahead[k - 4 * begin] == total[-1])[1])
        ahead = total
        ends.append(pick)
    states = [START]
    for pick in reversed(ends):
        states.append(pick[states[-1]])
    return ahead[START], states


def audit_of(turns: Sequence[tuple[str, bool, bool]], begin: int, end: int, last: bool) -> str:
    """The best audit from begin over the turns to end, with the closing inserts of the last block."""
    audits = Audits()
    _, node = solve(turns, begin, audits)
    return audits.text(node[end]) + (CLOSING[end] if last else "")


def whole(turns: Sequence[tuple[str, bool, bool]]) -> tuple[int, str]:
    """(cost, audit) of a conversation in one piece."""
    audits = Audits()
    cost, node = solve(turns, START, audits)
    nodes = []
    for state, closing in enumerate(CLOSING):
        if cost[state] < _FAR:
            at = node[state]
            for letter in closing:
                at = audits.add(at, letter)
            nodes.append((cost[state] + INSERT_COST * len(closing), at))
    best, at = nodes[0]
    for c, n in nodes[1:]:
        if c < best or (c == best and audits.less(n, at)):
            best, at = c, n
    return best, audits.text(at)


def repaired(audit: str, begin: int, turns: Iterable[tuple[str | None, str | None]]) -> list[str]:
    """The lines ``role:text`` that an audit makes of the turns (role, text) from state begin on."""
    rows, state, out = iter(turns), begin, []
    for edit in audit:
        if edit == "D":
            next(rows)
            continue
        role, text = ("", "") if edit == "I" else next(rows)
        if edit == "K" and state == START and (role or "")[:1] == "s":
            state = SYSTEM
        else:
            state = ASSISTANT if state == USER else USER
            if edit != "K":
                role = "assistant" if state == ASSISTANT else "user"
        out.append(f"{role}:{text}")
    return out
