"""Rule functions turned into column expressions by tracing.

A function is run on a status whose values are symbols. Whenever it needs to know something of them - whether a value
is there, how two compare, whether one is zero - one answer is followed now and the other in a later run, so the runs
make a tree of conditions whose leaves are results, errors or nothing. Functions that do more than compare and compute,
read state of their own, or branch too often keep running as Python.
"""

from __future__ import annotations

import builtins
import dis
import math
import operator
from collections.abc import Callable, Collection
from dataclasses import dataclass
from types import CodeType, FunctionType

from pyspark.sql import Column
from pyspark.sql import functions as F

from gaugeflow.model import Requirement

MOST_LEAVES = 64
MOST_DECISIONS = 48
# Larger whole numbers are not exact as doubles.
WHOLE = 1 << 53

_CALLS = {"abs", "all", "any", "bool", "enumerate", "float", "int", "isinstance", "iter", "len", "max", "min", "next", "range", "reversed", "sorted", "str", "zip"}
# Opcodes of functions that handle exceptions, import, or write anything but local variables.
_REFUSED = {"PUSH_EXC_INFO", "IMPORT_NAME", "STORE_GLOBAL", "DELETE_GLOBAL", "STORE_ATTR", "DELETE_ATTR", "LOAD_BUILD_CLASS", "LOAD_FROM_DICT_OR_GLOBALS"}


class Untraceable(BaseException):
    """The function needs the values themselves. Not an Exception, so that no rule takes it for an error of its own."""


@dataclass(frozen=True)
class Leaf:
    """Where a path ends: a result, an error, or neither (no event)."""

    result: str | None = None
    error: str | None = None


@dataclass(frozen=True, eq=False)
class Branch:
    condition: Column
    yes: Leaf | Branch
    no: Leaf | Branch


def _refuse(*_):
    raise Untraceable


class TracedNumber:
    """A float that is there (neither null nor NaN when read from the status), known by its column only."""

    def __init__(self, path: _Path, column: Column, key: tuple, exact: bool = False) -> None:
        self._path, self._column, self._key, self._exact = path, column, key, exact

    @property
    def __class__(self):  # isinstance(value, float) holds, as for the value itself
        return float

    def _other(self, value) -> TracedNumber | None:
        if type(value) is TracedNumber:
            return value
        if not isinstance(value, (int, float)):
            return None
        if isinstance(value, int) and abs(value) > WHOLE:
            raise Untraceable
        number = float(value)
        return TracedNumber(self._path, F.lit(number), ("number", repr(number)), not math.isnan(number))

    def _compared(self, value, name: str) -> bool:
        other = self._other(value)
        if other is None:
            return NotImplemented
        held = getattr(operator, name)(self._column, other._column)
        for side in (self, other):  # Spark orders NaN above all numbers; Python holds no comparison with it
            if not side._exact:
                held = held & ~F.isnan(side._column)
        return self._path.decide((name, self._key, other._key), held)

    def __lt__(self, value):
        return self._compared(value, "lt")

    def __le__(self, value):
        return self._compared(value, "le")

    def __gt__(self, value):
        return self._compared(value, "gt")

    def __ge__(self, value):
        return self._compared(value, "ge")

    def __eq__(self, value):
        return self._compared(value, "eq")

    def __ne__(self, value):
        same = self._compared(value, "eq")
        return same if same is NotImplemented else not same

    def __bool__(self):
        return self._path.decide(("nonzero", self._key), self._column != 0)

    def _computed(self, value, name: str, swapped: bool = False):
        other = self._other(value)
        if other is None:
            return NotImplemented
        left, right = (other, self) if swapped else (self, other)
        if name == "truediv":
            divisor = float(right._key[1]) if right._key[0] == "number" else None
            if divisor == 0 if divisor is not None else self._path.decide(("zero", right._key), right._column == 0):
                return 1.0 / 0.0  # raises what the function would see
            column = F.try_divide(left._column, right._column)
        else:
            column = getattr(operator, name)(left._column, right._column)
        return TracedNumber(self._path, column, (name, left._key, right._key))

    def __add__(self, value):
        return self._computed(value, "add")

    def __radd__(self, value):
        return self._computed(value, "add", True)

    def __sub__(self, value):
        return self._computed(value, "sub")

    def __rsub__(self, value):
        return self._computed(value, "sub", True)

    def __mul__(self, value):
        return self._computed(value, "mul")

    def __rmul__(self, value):
        return self._computed(value, "mul", True)

    def __truediv__(self, value):
        return self._computed(value, "truediv")

    def __rtruediv__(self, value):
        return self._computed(value, "truediv", True)

    def __neg__(self):
        return TracedNumber(self._path, -self._column, ("neg", self._key), self._exact)

    def __pos__(self):
        return self

    def __abs__(self):
        return TracedNumber(self._path, F.abs(self._column), ("abs", self._key), self._exact)

    # What Spark computes or writes otherwise than Python does.
    __hash__ = __str__ = __repr__ = __format__ = __float__ = __int__ = __index__ = __complex__ = _refuse
    __round__ = __trunc__ = __floor__ = __ceil__ = _refuse
    __mod__ = __rmod__ = __floordiv__ = __rfloordiv__ = __divmod__ = __rdivmod__ = __pow__ = __rpow__ = _refuse


class _Path:
    """One run: decisions as given, then always yes."""

    def __init__(self, given: tuple[bool, ...]) -> None:
        self.given, self.conditions, self.known = given, [], {}

    def decide(self, key: tuple, condition: Column) -> bool:
        if key not in self.known:
            place = len(self.conditions)
            if place >= MOST_DECISIONS:
                raise Untraceable
            self.known[key] = place >= len(self.given) or self.given[place]
            self.conditions.append(condition)
        return self.known[key]


class _TracedStatus:
    def __init__(self, path: _Path, names: Collection[str]) -> None:
        self._path, self._names = path, names

    def get(self, sensor_id: str, time_expression: str, statistic: str | None = None) -> TracedNumber | None:
        if not all(type(x) is str for x in (sensor_id, time_expression)) or not (statistic is None or type(statistic) is str):
            raise Untraceable
        name = Requirement(sensor_id, time_expression, statistic).name
        if name not in self._names:
            return None
        column = F.col(f"`{name}`").cast("double")
        there = self._path.decide(("there", name), column.isNotNull() & ~F.isnan(column))
        return TracedNumber(self._path, column, ("feature", name), True) if there else None


def _constant(value) -> bool:
    return value is None or type(value) in (bool, int, float, str) or (type(value) in (tuple, frozenset) and all(map(_constant, value)))


def _codes(code: CodeType) -> list[CodeType]:
    return [code, *(inner for const in code.co_consts if isinstance(const, CodeType) for inner in _codes(const))]


def _plain(fn: Callable, seen: set[FunctionType]) -> bool:
    """Whether a function depends on its arguments and constants alone: then running it again gives the same."""
    if type(fn) is not FunctionType:
        return False
    if fn in seen:
        return True
    seen.add(fn)

    def allowed(value) -> bool:
        return _constant(value) or _plain(value, seen)

    kept = [*(fn.__defaults__ or ()), *(fn.__kwdefaults__ or {}).values()]
    try:
        kept += [cell.cell_contents for cell in fn.__closure__ or ()]
    except ValueError:  # a name that is not bound yet
        return False
    if not all(map(allowed, kept)):
        return False
    for code in _codes(fn.__code__):
        for step in dis.get_instructions(code):
            if step.opname in _REFUSED or (step.opname in ("STORE_DEREF", "DELETE_DEREF") and step.argval in fn.__code__.co_freevars):
                return False
            if step.opname in ("LOAD_ATTR", "LOAD_METHOD") and step.argval != "get":
                return False
            if step.opname in ("LOAD_GLOBAL", "LOAD_NAME"):
                if step.argval in fn.__globals__:
                    if not allowed(fn.__globals__[step.argval]):
                        return False
                    continue
                known = getattr(builtins, step.argval, None)
                if step.argval not in _CALLS and not (isinstance(known, type) and issubclass(known, Exception)):
                    return False
    return True


def traced(fn: Callable, names: Collection[str]) -> Leaf | Branch | None:
    """The tree of a rule function whose status has the features `names`; None if it has to run as Python.

    Missing and NaN values are None to the function, as when it runs. Anything it returns but None is a result, written
    as a text; what it raises is an error. A function may call others that are as plain as itself. It is run on the
    driver once per path, at most MOST_LEAVES times, each with MOST_DECISIONS decisions at most.
    """
    if not _plain(fn, set()):
        return None
    left = MOST_LEAVES

    def grow(given: tuple[bool, ...]) -> Leaf | Branch:
        nonlocal left
        left -= 1
        if left < 0:
            raise Untraceable
        path = _Path(given)
        try:
            result = fn(_TracedStatus(path, names))
            if type(result) not in (str, int, float, bool, type(None)):
                raise Untraceable
            node: Leaf | Branch = Leaf(None if result is None else str(result))
        except Exception as problem:
            node = Leaf(error=f"{type(problem).__name__}: {problem}".replace(TracedNumber.__name__, "float"))
        for place in reversed(range(len(given), len(path.conditions))):
            other = grow((*given, *(True,) * (place - len(given)), False))
            if node != other:
                node = Branch(path.conditions[place], node, other)
        return node

    try:
        return grow(())
    except (Untraceable, RecursionError):
        return None


def leaves(tree: Leaf | Branch) -> int:
    return 1 if isinstance(tree, Leaf) else leaves(tree.yes) + leaves(tree.no)


def outcome(tree: Leaf | Branch, name: str, description: str) -> Column:
    """A struct of rule_name, result, rule_description and error; null where the rule says nothing."""
    if isinstance(tree, Branch):
        return F.when(tree.condition, outcome(tree.yes, name, description)).otherwise(outcome(tree.no, name, description))
    text = lambda value: F.lit(value).cast("string")
    told = F.struct(
        text(name).alias("rule_name"), text(tree.result).alias("result"), text(description).alias("rule_description"), text(tree.error).alias("error")
    )
    return F.when(F.lit(tree.result is not None or tree.error is not None), told)
