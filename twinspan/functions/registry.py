"""Named algorithms: encoders of blocking keys and comparators of record pairs, built in or registered by plugins."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from importlib import import_module
from importlib.metadata import entry_points
from typing import Any

from pyspark.sql import DataFrame

log = logging.getLogger(__name__)

#: Kinds of algorithm: TSF encodes keys; DTR and PRB compare under one linking method; None compares under any.
ENCODER, DETERMINISTIC, PROBABILISTIC = "TSF", "DTR", "PRB"
#: Installed packages that offer algorithms name a module in this group; importing it registers them.
PLUGIN_GROUP = "twinspan.algorithms"


@dataclass(frozen=True)
class Algorithm:
    """fn: column -> column for an encoder, (left, right, **args) -> boolean column for a comparator.

    prepare adds the column that the comparator reads instead of the field: (frame, field, new name, **args) -> frame. It runs
    once per record, before records are paired. costly comparators run after all others of a step. key, for comparators
    that ask for one equal value on both sides (null equal to nothing): (column, **args) -> that value; steps then join
    on it. null_safe: it accepts equal values and two missing ones; steps join on the values where both sides have them of one
    type. band, for comparators of numbers: (**args) -> how far two accepted numbers may be apart, or None where that is
    not known; steps then join on bands of numbers as well. edits, for comparators of texts, a missing one being empty:
    (**args) -> how many edits two accepted texts may be apart, or None; steps then join big blocks on segments of texts.
    of_presence: it asks whether values are there, so a missing one is no missing answer. alone, for comparators that ask the
    same of each side: (column, **args) -> whether a value can be in an accepted pair; two such values always are, and steps
    drop other records before they are paired. decides, for dear comparators: column -> the text, never null, by which alone
    a value compares; steps compare each two texts of a block once, where records repeat them much. symmetric: it gives the same with its sides changed
    over, so de-duplication may take records of equal values together.
    """

    name: str
    title: str
    kind: str | None
    fn: Callable
    args: tuple[str, ...] = ()
    tags: tuple[str, ...] = ()
    prepare: Callable[..., DataFrame] | None = None
    costly: bool = False
    key: Callable | None = None
    null_safe: bool = False
    band: Callable[..., float | None] | None = None
    edits: Callable[..., int | None] | None = None
    of_presence: bool = False
    alone: Callable | None = None
    decides: Callable | None = None
    symmetric: bool = False
    defaults: dict[str, Any] = field(default_factory=dict)

    def checked(self, args: dict[str, Any]) -> dict[str, Any]:
        if unknown := set(args) - set(self.args):
            raise ValueError(f"{self.name} has no argument {', '.join(sorted(unknown))}")
        return self.defaults | args

    def apply(self, *columns, **args):
        return self.fn(*columns, **self.checked(args))


_encoders: dict[str, Algorithm] = {}
_comparators: dict[str, Algorithm] = {}


def _table(kind: str | None) -> dict[str, Algorithm]:
    return _encoders if kind == ENCODER else _comparators


def add(algorithm: Algorithm) -> Algorithm:
    """Register; a later registration of a name replaces the earlier one."""
    _table(algorithm.kind)[algorithm.name] = algorithm
    log.debug("registered %s (%s)", algorithm.name, algorithm.kind)
    return algorithm


@contextmanager
def registered_for(algorithm: Algorithm) -> Iterator[Algorithm]:
    """Registered inside, and not any more behind it; an earlier algorithm of that name is back then."""
    table = _table(algorithm.kind)
    before = table.get(algorithm.name)
    try:
        yield add(algorithm)
    finally:
        del table[algorithm.name]
        if before:
            table[algorithm.name] = before


def register(name: str, title: str, kind: str | None = DETERMINISTIC, **more) -> Callable:
    """Decorator that registers a function as an algorithm."""

    def keep(fn: Callable) -> Callable:
        add(Algorithm(name, title, kind, fn, **more))
        return fn

    return keep


def load_plugins() -> list[str]:
    """Import the modules that installed packages offer; returns their names."""
    return [import_module(p.value).__name__ for p in entry_points(group=PLUGIN_GROUP)]


def encoder(name: str | None) -> Algorithm:
    if (name or "EXACT") not in _encoders:
        raise KeyError(f"unknown transformation {name}")
    return _encoders[name or "EXACT"]


def comparator(name: str | None, method: str | None = None) -> Algorithm:
    """method: DTR or PRB to exclude comparators of the other kind."""
    found = _comparators.get(name or "EXACT")
    if found is None or method and found.kind not in (None, method):
        raise KeyError(f"unknown comparison {name}")
    return found


def algorithms(*kinds: str | None) -> dict[str, Algorithm]:
    """All algorithms of the given kinds, by name."""
    return {k: a for table in (_encoders, _comparators) for k, a in table.items() if a.kind in kinds}
