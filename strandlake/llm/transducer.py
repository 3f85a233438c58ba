"""Byte-pair merges as a lazily determinised finite-state transducer.

A token sequence is a merge result exactly if each token, and each pair of neighbours, is the
merge result of its own symbols. So the prefix of a string that ends at some place has one
tokenization, and what can follow depends on its last token alone. The nondeterministic machine
holds, for every place from which a vocabulary entry may still be growing, that entry's trie node,
the token before it and how many tokens wait to be emitted there. The deterministic machine's states
are sets of these; states and transitions are made when first met and forgotten beyond a bound.

CountTransducer's transitions carry the number of tokens that all live hypotheses share by then.
IdTransducer's transitions carry the token that ends at the place; the tokens that all live
hypotheses go through are certain and leave, so output waits only a little longer than the longest
vocabulary entry.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

import numpy as np

#: Transitions after which a machine forgets its states, which bounds a worker's memory.
MOST_TRANSITIONS = 350_000
#: A hypothesis is one integer: trie node, token before it (plus 1), tokens waiting.
NODE, LAST, WAITING = 26, 8, 255
TOKENS = (1 << NODE - LAST) - 1


class Merges:
    """The merge rules. ``rule(a, b)``: (rank, merged token) or None; ``first``: symbol -> token."""

    def __init__(self, symbols: dict[int, Sequence[int]], first: dict[int, int], rule: Callable[[int, int], tuple[int, int] | None]):
        self.symbols, self.first, self.rule = symbols, first, rule
        self.steps: dict[int, tuple | None] = {}

    def steps_of(self, token: int) -> tuple | None:
        """(ranks of the token's own merges in order, its leftmost and its rightmost part before each and at the end).

        None if merging its symbols doesn't give the token. Always the lowest rank first, the leftmost of equals.
        """
        if token in self.steps:
            return self.steps[token]
        ids = [self.first[s] for s in self.symbols[token]]
        ranks, left, right = [], [ids[0]], [ids[-1]]
        rule = self.rule
        found = [rule(a, b) for a, b in zip(ids, ids[1:])]
        while len(ids) > 1:
            at = min((r[0], i) for i, r in enumerate(found) if r) if any(found) else None
            if at is None:
                break
            rank, i = at
            ids[i : i + 2] = [found[i][1]]
            del found[i]
            if i:
                found[i - 1] = rule(ids[i - 1], ids[i])
            if i < len(found):
                found[i] = rule(ids[i], ids[i + 1])
            ranks.append(rank)
            left.append(ids[0])
            right.append(ids[-1])
        known = self.steps[token] = (ranks, left, right) if ids == [token] else None
        return known

    def neighbours(self, a: int, b: int) -> bool:
        """Whether a and b stay apart when their symbols are merged as one string.

        Both tokens' own merges are played in order of rank (the left one first among equals); a rule
        that joins the two parts at the border before either side's next merge would be used instead.
        """
        x, y = self.steps_of(a), self.steps_of(b)
        if x is None or y is None:
            return False
        (ranks_a, _, ends), (ranks_b, starts, _) = x, y
        i = j = 0
        na, nb = len(ranks_a), len(ranks_b)
        rule, never = self.rule, 1 << 60
        l = r = -1
        found = None
        while True:
            if ends[i] != l or starts[j] != r:
                l, r = ends[i], starts[j]
                found = rule(l, r)
            p = ranks_a[i] if i < na else never
            q = ranks_b[j] if j < nb else never
            if found is not None and found[0] < p and found[0] <= q:
                return False
            if p == q == never:
                return True
            if p <= q:
                i += 1
            else:
                j += 1


class CountTransducer:
    def __init__(self, merges: Merges):
        self.merges = merges
        self.child: dict[int, int] = {}
        self.token: list[int] = [-1]
        self.inner: list[bool] = [False]
        self.depth: list[int] = [0]
        self.width = {t: len(s) for t, s in merges.symbols.items()}
        self.longest = max(self.width.values())
        for t, symbols in merges.symbols.items():
            node = 0
            for s in symbols:
                self.inner[node] = True
                key = node << 9 | s
                to = self.child.get(key)
                if to is None:
                    to = self.child[key] = len(self.token)
                    self.token.append(-1)
                    self.inner.append(False)
                    self.depth.append(self.depth[node] + 1)
                node = to
            self.token[node] = t
        self.pairs: dict[int, bool] = {}
        self.reset()

    def reset(self) -> None:
        self.states: dict[tuple, int] = {}
        self.live: list[tuple] = []
        self.go: dict[int, tuple[int, int]] = {}
        self.start = self._state((0,))

    def trim(self) -> None:
        """Called between strings."""
        if len(self.go) > MOST_TRANSITIONS:
            self.reset()

    def _state(self, live: tuple) -> int:
        n = self.states.get(live)
        if n is None:
            n = self.states[live] = len(self.live)
            self.live.append(live)
        return n

    def _fits(self, last: int, token: int) -> bool:
        """last: the token before, plus 1; 0 at a string's start."""
        key = last << 32 | token
        ok = self.pairs.get(key)
        if ok is None:
            ok = self.merges.neighbours(last - 1, token) if last else self.merges.steps_of(token) is not None
            if len(self.pairs) >= MOST_TRANSITIONS:
                self.pairs.clear()
            self.pairs[key] = ok
        return ok

    def _on(self, state: int, symbol: int) -> tuple[list[int], int, int]:
        """Hypotheses that go on; the token that ends here; how many tokens wait with it."""
        on, end, waiting = [], -1, 0
        child, token, inner = self.child, self.token, self.inner
        for h in self.live[state]:
            to = child.get(h >> NODE << 9 | symbol)
            if to is None:
                continue
            t = token[to]
            if end < 0 <= t and self._fits(h >> LAST & TOKENS, t):
                end, waiting = t, (h & WAITING) + 1
            if inner[to]:
                on.append(to << NODE | h & (1 << NODE) - 1)
        return on, end, waiting

    def _step(self, state: int, symbol: int) -> tuple[int, int]:
        on, end, waiting = self._on(state, symbol)
        if end >= 0:
            on.append((end + 1) << LAST | waiting)  # the hypothesis that starts here is last
        sure = min((h & WAITING for h in on), default=0)
        step = self.go[state << 9 | symbol] = self._state(tuple(h - sure for h in on)), sure
        return step

    def run(self, symbols: Iterable[int], state: int) -> tuple[int, int]:
        """(state after ``symbols``, tokens emitted on the way)."""
        n, go = 0, self.go
        for s in symbols:
            step = go.get(state << 9 | s) or self._step(state, s)
            state = step[0]
            n += step[1]
        return state, n

    def waiting(self, state: int) -> int:
        """Tokens that leave if the string ends in this state."""
        live = self.live[state]
        if not live or live[-1] >> NODE:
            raise ValueError("no vocabulary entry for a symbol")
        return live[-1] & WAITING

    def _node(self, symbols: Sequence[int]) -> int | None:
        node = 0
        for s in symbols:
            node = self.child.get(node << 9 | s)
            if node is None:
                return None
        return node

    def entries(self, before: Sequence[int], whole: bool) -> list[int]:
        """Hypotheses that may be live where a block begins, judged by the symbols before it alone.

        ``before``: all of them (``whole``), or the last ones, twice as many as the longest entry has. An entry may
        be growing since some place; the token before that place is any that ends there.
        """
        out, n = [], len(before)
        for x in range(n, max(-1, n - self.longest - 1), -1):
            node = self._node(before[x:])
            if node is None or node and not self.inner[node]:
                continue
            if x == 0 and whole:
                out.append(node << NODE)
            for y in range(max(0, x - self.longest), x):
                token = self.token[at] if (at := self._node(before[y:x])) is not None else -1
                if token >= 0 and self.merges.steps_of(token) is not None:
                    out.append(node << NODE | (token + 1) << LAST)
        return out

    def block_map(self, block: Sequence[int], entries: Iterable[int]) -> dict[int, dict[int, int]]:
        """entry -> {exit: tokens between}: what is live after ``block`` if a hypothesis is before it. Entries that meet in a state go on together."""
        runs = {self._state((q,)): [(q, 0)] for q in entries}
        go = self.go
        for s in block:
            on: dict[int, list] = {}
            for state, came in runs.items():
                to, n = go.get(state << 9 | s) or self._step(state, s)
                if self.live[to]:
                    on.setdefault(to, []).extend([(q, c + n) for q, c in came] if n else came)
            runs = on
        out: dict[int, dict[int, int]] = {}
        for state, came in runs.items():
            for h in self.live[state]:
                for q, c in came:
                    out.setdefault(q, {})[h & ~WAITING] = c + (h & WAITING)
        return out

    def __call__(self, symbols: Iterable[int]) -> int:
        self.trim()
        state, n = self.run(symbols, self.start)
        return n + self.waiting(state)


class IdTransducer(CountTransducer):
    def _step(self, state: int, symbol: int) -> tuple[int, int]:
        step = self.go[state << 9 | symbol] = self.made(state, symbol)
        return step

    def made(self, state: int, symbol: int) -> tuple[int, int]:
        on, end, _ = self._on(state, symbol)
        if end < 0:
            raise ValueError("no vocabulary entry for a symbol")
        on.append((end + 1) << LAST)
        return self._state(tuple(on)), end

    def sure(self, state: int, ends: list[int]) -> int:
        """The last place that every tokenization still possible goes through."""
        places = {len(ends) - self.depth[h >> NODE] for h in self.live[state]}
        while len(places) > 1:
            last = max(places)
            places.remove(last)
            places.add(last - self.width[ends[last - 1]])
        return places.pop()

    def _back(self, ends: list[int], at: int) -> list[int]:
        out, width = [], self.width
        while at:
            t = ends[at - 1]
            out.append(t)
            at -= width[t]
        return out[::-1]

    def stream(self, symbols: Iterable[int], every: int = 512):
        """Lists of ids; what is certain leaves after each ``every`` symbols."""
        state, go = self.start, self.go
        ends: list[int] = []
        for s in symbols:
            step = go.get(state << 9 | s) or self._step(state, s)
            state = step[0]
            ends.append(step[1])
            if len(ends) >= every:
                sure = self.sure(state, ends)
                if sure > 0:
                    yield self._back(ends, sure)
                    ends = ends[sure:]
        if ends:
            yield self._back(ends, len(ends))

    def __call__(self, symbols: Sequence[int]) -> list[int]:
        self.trim()
        if len(symbols) > 512:
            return [t for part in self.stream(symbols) for t in part]
        state, go = self.start, self.go
        ends = []
        for s in symbols:
            step = go.get(state << 9 | s) or self._step(state, s)
            state = step[0]
            ends.append(step[1])
        return self._back(ends, len(ends))


class Lockstep:
    """Runs many strings through an IdTransducer side by side, a place at a time. Transitions are made when first met, in a table of fixed size."""

    def __init__(self, machine: IdTransducer, size: int = 1 << 21):
        self.machine, self.size = machine, size
        self.width = np.zeros(max(machine.width) + 1, np.int64)
        self.width[list(machine.width)] = list(machine.width.values())
        self.keys, self.to, self.end = np.full(size, -1, np.int64), np.zeros(size, np.int64), np.zeros(size, np.int64)
        self.n = 0

    def reset(self) -> None:
        self.machine.reset()
        self.keys.fill(-1)
        self.n = 0

    def _slots(self, key: np.ndarray) -> np.ndarray:
        """Each key's place in the table; unknown transitions are made."""
        slot = self._slot(key)
        left = np.flatnonzero(self.keys[slot] != key)
        while len(left):
            free = self.keys[slot[left]] == -1
            if free.any():
                for k in set(key[left[free]].tolist()):
                    self._make(k)
            moved = left[~free]
            slot[moved] = (slot[moved] + 1) & self.size - 1
            left = left[self.keys[slot[left]] != key[left]]
        return slot

    def _slot(self, key):
        return (key * 0x9E3779B1 >> 8) & self.size - 1

    def _make(self, key: int) -> None:
        slot = self._slot(key)
        while (k := int(self.keys[slot])) != -1:
            if k == key:
                return
            slot = (slot + 1) & self.size - 1
        self.keys[slot] = key
        self.to[slot], self.end[slot] = self.machine.made(key >> 9, key & 511)
        self.n += 1

    def __call__(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all strings one after the other, how many each has) of non-empty strings whose symbols stand one after the other."""
        if self.n > self.size // 2:
            self.reset()
        order = np.argsort(-sizes, kind="stable")
        start, n = (np.cumsum(sizes) - sizes)[order], sizes[order]
        state = np.full(len(n), self.machine.start)
        ends = np.zeros((len(n), int(n.max(initial=0))), np.int32)
        live = len(n)
        for place in range(ends.shape[1]):
            live = int(np.searchsorted(-n, -place, "left")) if place else live
            slot = self._slots(state[:live] << 9 | symbols[start[:live] + place])
            state[:live] = self.to[slot]
            ends[:live, place] = self.end[slot]
        # From each string's end back along its tokens.
        row, at, back = np.arange(len(n)), n.copy(), []
        while len(row):
            token = ends[row, at - 1]
            back.append((row, token))
            at = at - self.width[token]
            row, at = row[at > 0], at[at > 0]
        many = np.zeros(len(n), np.int64)
        for row, _ in back:
            many[row] += 1
        count = np.empty_like(many)
        count[order] = many
        last = np.cumsum(count)[order] - 1
        out = np.empty(int(count.sum()), np.int64)
        for k, (row, token) in enumerate(back):
            out[last[row] - k] = token
        return out, count
