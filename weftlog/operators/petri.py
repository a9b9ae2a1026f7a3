"""Petri nets by the inductive miner, token replay of variants, and nets compiled to automata.

Mining follows the published inductive miner: exclusive, sequence, parallel and loop cuts, its fall-throughs
where none fits, and a flower at last. A cut is decided on a Summary, counts of activities and pairs of activities;
what the log of a part looks like after a cut is left to the log's own class, so that the same miner
runs over a table of variants in Spark (operators.conformance). Replay is a function of one variant.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from itertools import groupby
from typing import Protocol

Log = dict[tuple[str, ...], int]


@dataclass
class Net:
    """Places are numbers, 0 the source and 1 the sink; a transition is (activity or None, inputs, outputs)."""

    places: int = 2
    transitions: list[tuple[str | None, tuple[int, ...], tuple[int, ...]]] = field(default_factory=list)

    def place(self) -> int:
        self.places += 1
        return self.places - 1

    def add(self, activity: str | None, inputs: Iterable[int], outputs: Iterable[int]) -> None:
        self.transitions.append((activity, tuple(inputs), tuple(outputs)))

    @property
    def arcs(self) -> int:
        return sum(len(i) + len(o) for _, i, o in self.transitions)

    def simplicity(self) -> float:
        """1 / (1 + the mean number of arcs of places and transitions over 2)."""
        n = self.places + len(self.transitions)
        return 1 / (1 + max(0.0, 2 * self.arcs / n - 2))


def _groups(items: Iterable[str], together: Callable[[str, str], bool]) -> list[set[str]]:
    """Classes of items under the closure of a symmetric relation, in order of their first item."""
    out: list[set[str]] = []
    for x in sorted(items):
        mine = [g for g in out if any(together(x, y) for y in g)]
        out = [g for g in out if g not in mine] + [{x}.union(*mine)]
    return sorted(out, key=min)


def _reach(acts: set[str], edges: set[tuple[str, str]]) -> set[tuple[str, str]]:
    after = {a: {b for x, b in edges if x == a} for a in acts}
    out = set()
    for a in acts:
        seen, todo = set(), list(after[a])
        while todo:
            b = todo.pop()
            if b not in seen:
                seen.add(b)
                todo += after[b]
        out |= {(a, b) for b in seen}
    return out


@dataclass(frozen=True)
class Summary:
    """What a cut is decided on: counts of activities, of pairs side by side, of first and last activities; traces
    without activities, with one, and all; in how many traces an activity is exactly once."""

    activities: dict[str, int]
    follows: dict[tuple[str, str], int]
    starts: dict[str, int]
    ends: dict[str, int]
    empty: int
    single: int
    traces: int
    once: dict[str, int] = field(default_factory=dict)

    def without(self, a: str, around: Around) -> Summary:
        """What the log without one activity counts, as far as a cut asks for it."""
        follows = Counter({(x, y): n for (x, y), n in self.follows.items() if a not in (x, y)})
        follows.update({(x, y): n for (b, x, y), n in around.between.items() if b == a})
        starts, ends = (Counter({x: n for x, n in kept.items() if x != a}) for kept in (self.starts, self.ends))
        starts.update({x: n for (b, x), n in around.first.items() if b == a})
        ends.update({x: n for (b, x), n in around.last.items() if b == a})
        return Summary({x: n for x, n in self.activities.items() if x != a}, dict(follows), dict(starts), dict(ends), 0, 0, self.traces)


@dataclass(frozen=True)
class Around:
    """What stands around runs of one activity within a trace: between (activity, before, after), first (activity, after) and
    last (activity, before) for the runs at a trace's start and end."""

    between: dict[tuple[str, str, str], int]
    first: dict[tuple[str, str], int]
    last: dict[tuple[str, str], int]


class Part(Protocol):
    """A log, or what a cut leaves of it for one child."""

    def summary(self) -> Summary: ...

    def without_empty(self) -> Part: ...

    def having(self, group: set[str], mostly: bool) -> Part:
        """Traces with an activity of a group; or mostly of it, and then nothing else of them."""

    def onto(self, group: set[str]) -> Part:
        """All traces, with the activities of a group alone."""

    def around(self) -> Around: ...

    def split(self, before: set[str], after: set[str] | None) -> Part:
        """Traces cut before each activity of a set, where an activity of another (None: any) stands before it."""

    def loop(self, groups: list[set[str]]) -> list[Part]:
        """Stretches of traces within groups, the first the body, one empty body between two others."""


@dataclass(frozen=True)
class Variants:
    """A log in memory: variants and how often each is there."""

    log: Log

    def summary(self) -> Summary:
        activities, follows, starts, ends, once = Counter(), Counter(), Counter(), Counter(), Counter()
        for t, n in self.log.items():
            for a, k in Counter(t).items():
                activities[a] += n * k
                once[a] += n * (k == 1)
            for pair in zip(t, t[1:], strict=False):
                follows[pair] += n
            for counts, end in ((starts, t[:1]), (ends, t[-1:])):
                for a in end:
                    counts[a] += n
        size = lambda k: sum(n for t, n in self.log.items() if len(t) == k)
        return Summary(dict(activities), dict(follows), dict(starts), dict(ends), size(0), size(1), sum(self.log.values()), dict(once))

    def around(self) -> Around:
        between, first, last = Counter(), Counter(), Counter()
        for t, n in self.log.items():
            runs = [a for a, _ in groupby(t)]
            for k, a in enumerate(runs):
                x, y = runs[k - 1] if k else None, runs[k + 1] if k + 1 < len(runs) else None
                if x is not None and y is not None:
                    between[a, x, y] += n
                elif y is not None:
                    first[a, y] += n
                elif x is not None:
                    last[a, x] += n
        return Around(dict(between), dict(first), dict(last))

    def split(self, before: set[str], after: set[str] | None) -> Variants:
        out: Counter = Counter()
        for t, n in self.log.items():
            cuts = [0, *(k for k in range(1, len(t)) if t[k] in before and (after is None or t[k - 1] in after)), len(t)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                out[t[lo:hi]] += n
        return Variants(dict(out))

    def without_empty(self) -> Variants:
        return Variants({t: n for t, n in self.log.items() if t})

    def having(self, group: set[str], mostly: bool) -> Variants:
        if mostly:
            return Variants({t: n for t, n in self.log.items() if 2 * sum(a in group for a in t) >= len(t)}).onto(group)
        return Variants({t: n for t, n in self.log.items() if any(a in group for a in t)})

    def onto(self, group: set[str]) -> Variants:
        out: Counter = Counter()
        for t, n in self.log.items():
            out[tuple(a for a in t if a in group)] += n
        return Variants(dict(out))

    def loop(self, groups: list[set[str]]) -> list[Part]:
        out: list[Counter] = [Counter() for _ in groups]
        place = {a: k for k, g in enumerate(groups) for a in g}
        for t, n in self.log.items():
            runs = [(k, tuple(g)) for k, g in groupby(t, place.get)]
            for k, run in runs:
                out[k][run] += n
            if gaps := empty_bodies([k for k, _ in runs]):
                out[0][()] += n * gaps
        return [Variants(dict(c)) for c in out]


def empty_bodies(order: list[int]) -> int:
    """How often the body of a loop is passed without an activity: before a first, between two and after a last way back."""
    ends = [0 if k else 1 for k in order]
    return (order[:1] != [0]) + (order[-1:] != [0]) + sum(not a and not b for a, b in zip(ends, ends[1:], strict=False)) if order else 0


def _loop_groups(acts: set[str], edges: set[tuple[str, str]], starts: set[str], ends: set[str]) -> list[set[str]]:
    body = starts | ends
    inner = _groups(acts - body, lambda a, b: (a, b) in edges or (b, a) in edges)
    redo = []
    for g in inner:
        into = {a for a, b in edges if b in g and a in body}
        onto = {b for a, b in edges if a in g and b in body}
        entry, leave = {b for a, b in edges if a in body and b in g}, {a for a, b in edges if a in g and b in body}
        whole = all((e, b) in edges for e in ends for b in entry) and all((a, s) in edges for a in leave for s in starts)
        if into <= ends and onto <= starts and whole:
            redo.append(g)
        else:
            body = body | g
    return [body, *redo]


def find_cut(seen: Summary, noise: float = 0.0) -> tuple[str, list[set[str]]] | None:
    """The operator and the groups of activities of the first cut that the counts allow.

    With noise, pairs, first and last activities go that are rarer than that share of the most frequent one: of the
    pairs with the same first activity, of the first, and of the last activities.
    """
    acts, follows, starts, ends = set(seen.activities), seen.follows, set(seen.starts), set(seen.ends)
    if noise:
        most = {a: max(n for (x, _), n in follows.items() if x == a) for a, _ in follows}
        follows = {(a, b): n for (a, b), n in follows.items() if n >= noise * most[a]}
        starts, ends = ({a for a, n in kept.items() if n >= noise * max(kept.values())} for kept in (seen.starts, seen.ends))
    edges = set(follows)
    parts = _groups(acts, lambda a, b: (a, b) in edges or (b, a) in edges)
    if len(parts) > 1:
        return "xor", parts
    reach = _reach(acts, edges)
    parts = _groups(acts, lambda a, b: ((a, b) in reach) == ((b, a) in reach))
    if len(parts) > 1:
        return "seq", sorted(parts, key=lambda g: -len({b for a, b in reach if a in g and b not in g}))
    parts = _groups(acts, lambda a, b: (a, b) not in edges or (b, a) not in edges)
    whole = [g for g in parts if g & starts and g & ends]
    if len(whole) > 1:
        for g in parts:
            if g not in whole:
                whole[0] = whole[0] | g
        return "par", whole
    parts = _loop_groups(acts, edges, starts, ends)
    return ("loop", parts) if len(parts) > 1 else None


def mine_tree(part: Part, noise: float = 0.0) -> tuple:
    """A process tree: ("act", a), ("tau",) or (operator, children), operator one of xor, seq, par, loop.

    Where no cut fits: an activity that is once in every trace goes beside the rest; so does one without which the
    rest has a cut; traces are cut where an end meets a start, or before each start, and the pieces loop; at
    last any activities in any order.
    """
    seen = part.summary()
    acts = set(seen.activities)
    if not acts:
        return ("tau",)
    if seen.empty:
        return ("xor", [("tau",), mine_tree(part.without_empty(), noise)])
    if len(acts) == 1:
        act = ("act", next(iter(acts)))
        return act if seen.single == seen.traces else ("loop", [act, ("tau",)])
    if cut := find_cut(seen, noise):
        kind, groups = cut
        if kind == "xor":
            return (kind, [mine_tree(part.having(g, bool(noise)), noise) for g in groups])
        parts = part.loop(groups) if kind == "loop" else [part.onto(g) for g in groups]
        return (kind, [mine_tree(x, noise) for x in parts])
    beside = next((a for a in sorted(acts) if seen.once.get(a, 0) == seen.traces), None)
    if beside is None:
        around = part.around()
        beside = next((a for a in sorted(acts) if find_cut(seen.without(a, around), noise)), None)
    if beside is not None:
        return ("par", [mine_tree(part.onto({beside}), noise), mine_tree(part.onto(acts - {beside}), noise)])
    starts, ends = set(seen.starts), set(seen.ends)
    for after in (ends, None):
        if any(b in starts and (after is None or a in after) for a, b in seen.follows):
            return ("loop", [mine_tree(part.split(starts, after), noise), ("tau",)])
    return ("loop", [("xor", [("act", a) for a in sorted(acts)]), ("tau",)])


def net_of(tree: tuple) -> Net:
    """The workflow net of a process tree."""
    net = Net()

    def build(node: tuple, source: int, sink: int) -> None:
        kind = node[0]
        if kind == "act":
            net.add(node[1], [source], [sink])
        elif kind == "tau":
            net.add(None, [source], [sink])
        elif kind == "xor":
            for child in node[1]:
                build(child, source, sink)
        elif kind == "seq":
            places = [source, *(net.place() for _ in node[1][1:]), sink]
            for child, a, b in zip(node[1], places, places[1:], strict=False):
                build(child, a, b)
        elif kind == "par":
            a, b = [net.place() for _ in node[1]], [net.place() for _ in node[1]]
            net.add(None, [source], a)
            for child, x, y in zip(node[1], a, b, strict=True):
                build(child, x, y)
            net.add(None, b, [sink])
        else:
            a, b = net.place(), net.place()
            net.add(None, [source], [a])
            build(node[1][0], a, b)
            for child in node[1][1:]:
                build(child, b, a)
            net.add(None, [b], [sink])

    build(tree, 0, 1)
    return net


def mine(variants: Log, noise: float = 0.0) -> Net:
    """The net of a log in memory."""
    return net_of(mine_tree(Variants({t: n for t, n in variants.items() if n}), noise))


@dataclass
class Replay:
    """What a replay counts; fired: transitions in order; choices: visible activities that were enabled before each event."""

    missing: int = 0
    consumed: int = 0
    remaining: int = 0
    produced: int = 1
    is_fit: bool = True
    fired: list[int] = field(default_factory=list)
    choices: list[list[str]] = field(default_factory=list)

    @property
    def fitness(self) -> float:
        return 0.5 * (1 - self.missing / self.consumed) + 0.5 * (1 - self.remaining / self.produced)


class Replayer:
    """Token replay on one net. Silent transitions fire as a shortest path asks for them.

    A search over more than ``most`` markings is an error, never an answer from a part of them.
    """

    def __init__(self, net: Net, most: int = 1_000_000) -> None:
        self.net, self.most = net, most
        self.silent = [k for k, t in enumerate(net.transitions) if t[0] is None]
        self.visible: dict[str, list[int]] = {}
        for k, t in enumerate(net.transitions):
            if t[0] is not None:
                self.visible.setdefault(t[0], []).append(k)

    def _enabled(self, marking: Counter, k: int) -> bool:
        return all(marking[p] > 0 for p in self.net.transitions[k][1])

    def _fire(self, marking: Counter, k: int) -> Counter:
        out = Counter(marking)
        out.subtract(self.net.transitions[k][1])
        out.update(self.net.transitions[k][2])
        return +out

    def _path(self, marking: Counter, done: Callable[[Counter], bool]) -> list[int] | None:
        """Silent transitions to the nearest marking that is done, or None."""
        todo, seen = [(marking, [])], {frozenset(marking.items())}
        for m, path in todo:
            if done(m):
                return path
            for k in self.silent:
                if self._enabled(m, k):
                    n = self._fire(m, k)
                    if (key := frozenset(n.items())) not in seen:
                        if len(seen) >= self.most:
                            raise ValueError(f"silent transitions reach more than {self.most} markings")
                        seen.add(key)
                        todo.append((n, [*path, k]))
        return None

    def choices(self, marking: Counter) -> list[str]:
        """Visible activities that silent steps can enable."""
        out: set[str] = set()

        def look(m: Counter) -> bool:
            out.update(a for a, ts in self.visible.items() if any(self._enabled(m, t) for t in ts))
            return False

        self._path(marking, look)
        return sorted(out)

    def _closed(self, markings: Iterable[Counter]) -> dict[frozenset, tuple[Counter, int, list[int]]]:
        """All markings that silent steps lead to: the marking, which of markings it comes from, and what fires."""
        out = {}
        todo = [(m, k, []) for k, m in enumerate(markings)]
        for m, k, path in todo:
            if (key := frozenset(m.items())) in out:
                continue
            if len(out) >= self.most:
                raise ValueError(f"silent transitions reach more than {self.most} markings")
            out[key] = (m, k, path)
            todo += [(self._fire(m, t), k, [*path, t]) for t in self.silent if self._enabled(m, t)]
        return out

    def possible(self, markings: list[Counter]) -> dict[str, list[tuple[Counter, int, list[int]]]]:
        """For each activity that can come next from some of markings: the markings after it, from which they come, and what fires."""
        out: dict[str, dict] = {}
        for m, k, path in self._closed(markings).values():
            for a, ts in self.visible.items():
                for t in ts:
                    if self._enabled(m, t):
                        after = self._fire(m, t)
                        out.setdefault(a, {}).setdefault(frozenset(after.items()), (after, k, [*path, t]))
        return {a: list(found.values()) for a, found in out.items()}

    def run_of(self, trace: Iterable[str]) -> list[int] | None:
        """What fires in some run of the whole trace from the first to the final marking, or None."""
        layers, markings = [], [Counter({0: 1})]
        for a in trace:
            layers.append(self.possible(markings).get(a, []))
            markings = [m for m, _, _ in layers[-1]]
        last = self._closed(markings).get(frozenset({(1, 1)}))
        if last is None:
            return None
        _, k, path = last
        for layer in reversed(layers):
            _, k, before = layer[k]
            path = [*before, *path]
        return path

    def choices_until_misfit(self, trace: Iterable[str]) -> list[list[str]]:
        """The activities that can come before each of the trace in some run, up to the first that is not one of them."""
        out, markings = [], [Counter({0: 1})]
        for a in trace:
            known = self.possible(markings)
            out.append(sorted(known))
            if a not in known:
                break
            markings = [m for m, _, _ in known[a]]
        return out

    def step(self, marking: Counter, a: str) -> tuple[list[int], Counter] | None:
        """What fires so that an activity happens, no token missing, and the marking after it."""
        ts = self.visible.get(a, [])
        path = self._path(marking, lambda m: any(self._enabled(m, t) for t in ts)) if ts else None
        if path is None:
            return None
        for k in path:
            marking = self._fire(marking, k)
        t = next(t for t in ts if self._enabled(marking, t))
        return [*path, t], self._fire(marking, t)

    def finish(self, marking: Counter) -> tuple[list[int], Counter]:
        """Silent transitions to the final marking, or else to a token in the sink, and the marking then."""
        final = frozenset({(1, 1)})
        path = self._path(marking, lambda m: frozenset(m.items()) == final) or self._path(marking, lambda m: m[1] > 0) or []
        for k in path:
            marking = self._fire(marking, k)
        return path, marking

    def replay(self, trace: Iterable[str], with_choices: bool = True) -> Replay:
        """Replay a trace. Activities that the net lacks are passed over, but the trace is not fit.

        Where the shortest silent paths leave tokens missing or remaining, but some run has the trace, that run counts.
        """
        trace = list(trace)
        out = self._greedy(trace, with_choices)
        if not out.is_fit and all(a in self.visible for a in trace) and (run := self.run_of(trace)) is not None:
            consumed, produced = (sum(len(self.net.transitions[k][side]) for k in run) for side in (1, 2))
            out = Replay(0, consumed + 1, 0, produced + 1, True, run, out.choices)
        return out

    def _greedy(self, trace: list[str], with_choices: bool) -> Replay:
        out, marking = Replay(), Counter({0: 1})

        def fire(k: int) -> None:
            nonlocal marking
            _, inputs, outputs = self.net.transitions[k]
            lacking = [p for p in inputs if marking[p] < 1]
            marking.update(lacking)
            out.missing += len(lacking)
            out.consumed += len(inputs)
            out.produced += len(outputs)
            out.fired.append(k)
            marking = self._fire(marking, k)

        for a in trace:
            if with_choices:
                out.choices.append(self.choices(marking))
            ts = self.visible.get(a, [])
            if not ts:
                out.is_fit = False
                continue
            path = self._path(marking, lambda m: any(self._enabled(m, t) for t in ts))
            for k in path or []:
                fire(k)
            fire(next((t for t in ts if self._enabled(marking, t)), ts[0]))
        if with_choices:
            out.choices.append(self.choices(marking))
        for k in self.finish(marking)[0]:
            fire(k)
        out.consumed += 1
        if marking[1] < 1:
            out.missing += 1
        else:
            marking = +(marking - Counter({1: 1}))
        out.remaining = sum(marking.values())
        out.is_fit = out.is_fit and not out.missing and not out.remaining
        return out


@dataclass(frozen=True)
class Automaton:
    """A net as a table of states from 0 and steps.

    ``after``, ``consumed``, ``produced`` and ``fired`` are at state * len(names) + activity; after is -1 where the
    activity cannot fire. ``ends``: at a state whether a trace fits that ends there, what is consumed and produced then,
    and what fires. ``enabled``: how many activities a state enables.
    """

    names: list[str]
    after: list[int]
    consumed: list[int]
    produced: list[int]
    fired: list[list[int]]
    ends: list[tuple[bool, int, int, list[int]]]
    enabled: list[int]


def compiled(net: Net, most: int = 20_000) -> Automaton | None:
    """The markings that token replay comes to while no token is missing, silent steps folded in as Replayer takes them
    first; None if there are more than ``most`` steps."""
    r = Replayer(net)

    def cost(path: list[int]) -> tuple[int, int]:
        return tuple(sum(len(net.transitions[k][side]) for k in path) for side in (1, 2))

    def step(marking: Counter, a: str) -> tuple[Counter, int, int, list[int]] | None:
        found = r.step(marking, a)
        return found and (found[1], *cost(found[0]), found[0])

    def end(marking: Counter) -> tuple[bool, int, int, list[int]]:
        path, last = r.finish(marking)
        return last == Counter({1: 1}), *cost(path), path

    return _automaton(r, most, Counter({0: 1}), lambda m: frozenset(m.items()), step, end)


def language(net: Net, most: int = 20_000) -> Automaton | None:
    """The sets of markings that any runs of a prefix come to: exact for prefixes and whole traces, without what is
    consumed, produced and fired; None if there are more than ``most`` steps."""
    r = Replayer(net)

    def step(markings: list[Counter], a: str) -> tuple[list[Counter], int, int, list[int]] | None:
        found = r.possible(markings).get(a)
        return found and ([m for m, _, _ in found], 0, 0, [])

    return _automaton(r, most, [Counter({0: 1})], lambda ms: frozenset(frozenset(m.items()) for m in ms), step, lambda ms: (frozenset({(1, 1)}) in r._closed(ms), 0, 0, []))


def _automaton(r: Replayer, most: int, start: object, key: Callable, step: Callable, end: Callable) -> Automaton | None:
    names = sorted(r.visible)
    states, todo = {key(start): 0}, [start]
    out = Automaton(names, [], [], [], [], [], [])
    for state in todo:
        for a in names:
            after, consumed, produced, fired = step(state, a) or (None, 0, 0, [])
            if after is not None and key(after) not in states:
                states[key(after)] = len(states)
                todo.append(after)
            for values, value in zip((out.after, out.consumed, out.produced, out.fired), (-1 if after is None else states[key(after)], consumed, produced, fired), strict=True):
                values.append(value)
        if len(states) * max(len(names), 1) > most:
            return None
        out.ends.append(end(state))
        out.enabled.append(sum(x >= 0 for x in out.after[len(out.after) - len(names) :]))
    return out


def visible_successions(net: Net) -> set[tuple[str, str]]:
    """(a, b): some output place of a leads to b through silent transitions alone; more than causality."""
    out = set()
    for a, _, outputs in net.transitions:
        if a is None:
            continue
        seen, todo = set(), list(outputs)
        while todo:
            p = todo.pop()
            if p in seen:
                continue
            seen.add(p)
            for b, inputs, onto in net.transitions:
                if p in inputs:
                    if b is None:
                        todo += onto
                    else:
                        out.add((a, b))
    return out


def net_report(nets: dict[str, Net]) -> str:
    """A text of the structure of some nets: per object type its activities, and how many places, transitions and arcs it has."""
    lines = []
    for name, net in sorted(nets.items()):
        acts = sorted({a for a, *_ in net.transitions if a is not None})
        silent = sum(a is None for a, *_ in net.transitions)
        lines += [f"TYPE: {name}", f"ACTIVITIES ({len(acts)}): {', '.join(acts)}", f"PLACES: {net.places}", f"TRANSITIONS: {len(net.transitions)}, silent {silent}", f"ARCS: {net.arcs}", f"SIMPLICITY: {net.simplicity():.6f}", ""]
    return "\n".join(lines)


def net_dot(net: Net) -> str:
    """DOT text of a net."""
    lines = ["digraph {", "  rankdir=LR;"]
    lines += [f'  p{k} [shape=circle, label="{"start" if k == 0 else "end" if k == 1 else ""}"];' for k in range(net.places)]
    for k, (a, inputs, outputs) in enumerate(net.transitions):
        lines.append(f'  t{k} [shape=box, label="{a or ""}"];')
        lines += [f"  p{p} -> t{k};" for p in inputs] + [f"  t{k} -> p{p};" for p in outputs]
    return "\n".join([*lines, "}"])
