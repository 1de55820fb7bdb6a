"""Conversations as flow graphs, and the routes through them.

A conversation is compiled once to a table of arcs.  An arc says where it leads,
under which conditions, what it does to the state and what it shows; menus,
branches, hidden text and jumps are all just arcs.  Exploring routes and asking
what every way through does are two walks over the same table.
"""

from __future__ import annotations

import random
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from ..functions.arithmetic import Unsupported
from ..functions.text import fingerprint
from .solver import Predicate, any_of, compare, negate, number
from .state import State
from .world import every, refuse

# Fixed values of the scripts' language: where a conversation can end, and the limits of exploration.
ENDPOINTS = ("accept", "decline", "defer", "launch", "flee", "die", "explode")
MOST_STEPS, MOST_VISITS = 10_000, 2


@dataclass(frozen=True)
class Passage:
    line: int
    text: str
    role: str = "passage"


@dataclass(frozen=True)
class Route:
    """What was shown and chosen before, what is shown now, and where it stops: a menu's line, or an endpoint."""

    prefix: tuple[Passage, ...]
    paragraphs: tuple[Passage, ...]
    state: State
    stop: int | str
    terminal: bool
    choices: tuple[Passage, ...] = ()

    @property
    def text(self) -> str:
        return "\n\n".join(p.text for p in self.paragraphs)


@dataclass(frozen=True)
class Arc:
    """``when``: lists of conditions, of which one must hold in full (none of them may where ``unless``); no lists: always."""

    to: int | str
    when: tuple[tuple, ...] | None = None
    unless: bool = False
    does: tuple[dict, ...] = ()
    shows: Passage | None = None
    answer: Passage | None = None
    pause: bool = False

    def guard(self, told: dict[int, Predicate], state: State) -> Predicate:
        """The condition over ``state``; each list is read once for all arcs of a node, so that its draws are the same."""
        if self.when is None:
            return True
        for conditions in self.when:
            if id(conditions) not in told:
                told[id(conditions)] = state.predicate(conditions)
        p = any_of(told[id(x)] for x in self.when)
        return negate(p) if self.unless else p


def compile_arcs(nodes: Sequence[dict]) -> list[list[Arc] | Exception]:
    """The arcs that leave each node of a conversation's body; a node that is not supported has its error in their place."""
    labels: dict[str, int] = {}
    for i, n in enumerate(nodes):
        if n["tokens"][:1] == ["label"] and len(n["tokens"]) == 2:
            if n["tokens"][1] in labels:
                raise ValueError(f"line {n['line']}: label {n['tokens'][1]!r} is defined twice")
            labels[n["tokens"][1]] = i

    def jump(name: str, line: int, ends: tuple[str, ...] = ()) -> int | str:
        if name in ends:
            return name
        if name not in labels:
            raise ValueError(f"line {line}: there is no label {name!r}")
        return labels[name]

    def after(node: dict, following: int) -> int | str:
        """Where text or an option leads on: its first jump or endpoint, else the next node."""
        for c in node["children"]:
            match c["tokens"]:
                case ["goto", name]:
                    return jump(name, c["line"])
                case [name] if name in ENDPOINTS:
                    return name
                case ["to", "display"]:
                    continue
            raise refuse(c)
        return following

    def shown_if(node: dict) -> tuple:
        return tuple(c for n in node["children"] if n["tokens"] == ["to", "display"] for c in n["children"])

    def conditional(node: dict) -> bool:
        return any(c["tokens"] == ["to", "display"] for c in node["children"])

    def leaving(i: int, n: dict) -> list[Arc]:
        following, line = i + 1, n["line"]
        match n["tokens"]:
            case ["choice"]:
                if bad := [o for o in n["children"] if not o["quoted"]]:
                    raise refuse(bad[0])
                seen = [(o, shown_if(o)) for o in n["children"]]
                lists = tuple(c for _, c in seen)
                arcs = [Arc(line, lists, pause=True)]
                arcs += [Arc(after(o, following), (c,), answer=Passage(o["line"], o["tokens"][0], "option")) for o, c in seen]
                return [*arcs, Arc(following, lists, unless=True)] if all(conditional(o) for o, _ in seen) else arcs
            case ["branch", name, *other] if len(other) < 2:
                told = tuple(n["children"])
                return [Arc(jump(name, line, ENDPOINTS), (told,)), Arc(jump(other[0], line, ENDPOINTS) if other else following, (told,), unless=True)]
            case ["action"]:
                return [Arc(following, does=tuple(n["children"]))]
            case ["label" | "scene", _]:
                return [Arc(following)]
            case ["goto", name]:
                return [Arc(jump(name, line))]
            case [text] if n["quoted"]:
                told = shown_if(n)
                arc = Arc(after(n, following), (told,), shows=Passage(line, text))
                return [arc, Arc(following, (told,), unless=True)] if conditional(n) else [arc]
            case [name] if name in ENDPOINTS:
                return [Arc(name)]
        raise refuse(n)

    out: list[list[Arc] | Exception] = []
    for i, n in enumerate(nodes):
        try:
            out.append(leaving(i, n))
        except (ValueError, Unsupported) as e:
            out.append(e)
    return out


@dataclass(frozen=True)
class Walker:
    """One way that is being explored."""

    at: int | str
    state: State
    prefix: tuple[Passage, ...] = ()
    shown: tuple[Passage, ...] = ()
    menu: tuple[Passage, ...] = ()
    answered: bool = False
    visits: dict = field(default_factory=dict)


class Dialogue:
    """A conversation with its table of arcs."""

    def __init__(self, node: dict):
        self.nodes = node["children"]
        self.arcs = compile_arcs(self.nodes)

    def ends(self, at: int | str) -> str | None:
        """The stop that a place is, if it is none of the nodes."""
        return at if isinstance(at, str) else "end" if at >= len(self.nodes) else None

    def clears(self, name: str) -> bool:
        """Whether every way through ends with the flag cleared: what can be true of it at each node, grown along the arcs until nothing changes."""
        facts: dict[int | str, frozenset[bool]] = {0: frozenset([False])}
        changed = True
        while changed:
            changed = False
            for at, held in list(facts.items()):
                if self.ends(at) is not None:
                    continue
                if isinstance(self.arcs[at], Exception):
                    return False
                for arc in self.arcs[at]:
                    if arc.pause:
                        continue
                    writes = [c["tokens"][0] == "clear" for c in arc.does if c["tokens"] in (["clear", name], ["set", name])]
                    grown = facts.get(arc.to, frozenset()) | (frozenset(writes[-1:]) or held)
                    if grown != facts.get(arc.to):
                        facts[arc.to], changed = grown, True
        exits = [held for at, held in facts.items() if self.ends(at) is not None]
        return bool(exits) and frozenset.union(*exits) == {True}

    def routes(self, state: State | None = None, after_display: Sequence[dict] = (), stops: Sequence[str] | None = None, future: set[str] | None = None, sample: int | str | None = None) -> list[Route]:
        """All satisfiable routes to a menu or an end; each authored stretch comes with one compatible way to it.

        ``after_display`` is done once, before the first answer.  ``sample`` seeds
        the order in which ways are tried and ends with the first route that
        ends, which is then the last of the list.
        """
        state = (state or State()).copy()
        actions = [n for n in after_display if n["tokens"][0] != "require"]
        for n in after_display:
            if n["tokens"][0] == "require":
                state = self.require(state, n)
                if state is None:
                    return []
        names = None if future is None else future | self.mentions(after_display)
        out: list[Route] = []
        explored: set[tuple] = set()
        chance = random.Random(sample)
        ways, steps = [Walker(0, state)], 0
        while ways:
            w = ways.pop()
            steps += 1
            if steps > MOST_STEPS:
                raise ValueError("too many dialogue steps")
            stop = self.ends(w.at)
            if stop is not None:
                if stops is None or stop in stops:
                    out.append(Route(w.prefix, w.shown, w.state if w.answered else w.state.act(actions), stop, True, w.menu))
                    if sample is not None:
                        break
                continue
            key = (w.at, w.state.known_as(names), tuple((p.line, p.role) for p in w.shown), w.answered)
            if key in explored:
                continue
            explored.add(key)
            further = self.expand(self.counted(w), actions, out)
            if sample is not None:
                chance.shuffle(further)
            ways += further
        return out

    @staticmethod
    def require(state: State, node: dict) -> State | None:
        match node["tokens"]:
            case ["require", outfit, *count] if len(count) < 2 and not node["children"] and (not count or int(count[0]) >= 0):
                least = int(count[0]) if count else 1
                return state.assume(compare(state.read("outfit: " + outfit), ">=" if least else "==", number(least)))
        raise refuse(node)

    def mentions(self, more: Sequence[dict]) -> set[str]:
        out: set[str] = set()
        for n, _ in every([*self.nodes, *more]):
            out |= set(n["tokens"])
            if n["tokens"][0] in ("require", "outfit"):
                out |= {"outfit: " + x for x in n["tokens"][1:2]}
        return out

    def counted(self, w: Walker) -> Walker:
        """The walker with its visit of this node in this state counted; too many are an error."""
        here = (w.at, fingerprint({k: v.text() for k, v in w.state.values.items()}))
        seen = w.visits.get(here, 0)
        if seen >= MOST_VISITS:
            raise ValueError(f"line {self.nodes[w.at]['line']}: a dialogue loop needs care of its own")
        return replace(w, visits={**w.visits, here: seen + 1})

    def expand(self, w: Walker, actions: list[dict], out: list[Route]) -> list[Walker]:
        """The walkers one arc further; a pause at a menu is a route of its own."""
        arcs = self.arcs[w.at]
        if isinstance(arcs, Exception):
            raise arcs
        told: dict[int, Predicate] = {}
        open_arcs = [(arc, s) for arc in arcs if (s := w.state.assume(arc.guard(told, w.state))) is not None]
        menu = tuple(arc.answer for arc, _ in open_arcs if arc.answer)
        further = []
        for arc, s in open_arcs:
            if arc.pause:
                if w.shown:
                    out.append(Route(w.prefix, w.shown, s, arc.to, False, w.menu))
            elif arc.answer:
                before = s if w.answered else s.act(actions)
                further.append(Walker(arc.to, before, (*w.prefix, *w.shown, arc.answer), (), menu, True))
            else:
                shown = (*w.shown, arc.shows) if arc.shows else w.shown
                further.append(replace(w, at=arc.to, state=s.act(arc.does) if arc.does else s, shown=shown))
        return further
