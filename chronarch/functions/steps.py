"""Time types, window arithmetic and names of windowed columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Abbreviations of time types and alignments in names (fixed values).
UNITS = {"day": "d", "week": "w", "integer": ""}
ALIGNS = {"right": "", "center": "c", "left": "l"}


def step(time: Column, time_type: str) -> Column:
    """The whole number of steps that a time stands for."""
    if time_type == "integer":
        return time.cast("long")
    days = F.unix_date(time.cast("date")).cast("long")
    return days if time_type == "day" else F.floor(days / 7)


def shifted(time: Column, n: Column | int, time_type: str) -> Column:
    """The time ``n`` steps later."""
    n = n if isinstance(n, Column) else F.lit(n)
    if time_type == "integer":
        return time + n
    return F.date_add(time, (n * (7 if time_type == "week" else 1)).cast("int"))


def week_end(time: Column, last_day: str = "SAT") -> Column:
    """The last day of the week that holds ``time``."""
    return F.next_day(F.date_sub(time, 1), last_day)


def containing_time(version: Column, time_type: str) -> Column:
    """The time whose period holds a version: weeks are told by their last day."""
    return week_end(version) if time_type == "week" else version


def zero_lag_version(time: Column, time_type: str) -> Column:
    """The version at which a time is reported without lag: the day itself, the last day of a week, the same number."""
    return containing_time(time, time_type)


@dataclass(frozen=True)
class Window:
    """``before`` and ``after`` steps about a time; before None is all that came earlier."""

    before: int | None
    after: int = 0

    @property
    def size(self) -> int | None:
        return None if self.before is None else self.before + self.after + 1


def window(size: float, align: str = "right") -> Window:
    """The window of ``size`` steps: right ends at the time, left begins there, center has it in the middle."""
    if align not in ALIGNS:
        raise ValueError(f"align must be one of {sorted(ALIGNS)}")
    if size == float("inf"):
        if align != "right":
            raise ValueError("a window without end can only be right aligned")
        return Window(None)
    if size != int(size) or size < 1:
        raise ValueError("size must be a whole number, 1 at least")
    before = {"right": int(size) - 1, "center": int(size) // 2, "left": 0}[align]
    return Window(before, int(size) - before - 1)


def slide_names(columns: list[str], existing: list[str], shorts: str | list[str], size: float, align: str, time_type: str, prefix: str | None = None, suffix: str | None = None, new_names: list[str] | None = None) -> list[str]:
    """Names of the results, such as x_7dav; refuses clashes and contradictions.

    ``shorts`` names the function, for all columns or for each.  In a prefix and a suffix, {n}
    stands for the window's size (running without an end), {unit} for the time type, {align}
    for the alignment and {f} for the function, each in its short form.
    """
    if new_names is not None and (prefix is not None or suffix is not None):
        raise ValueError("give new names, or a prefix and suffix, not both")
    if new_names is None:
        running = size == float("inf")
        shorts = [shorts] * len(columns) if isinstance(shorts, str) else shorts
        if prefix is None and suffix is None:
            suffix = "_running_{f}" if running else "_{n}{unit}{align}{f}"
        parts = {"n": "running" if running else str(int(size)), "unit": UNITS[time_type], "align": ALIGNS[align]}
        try:
            new_names = [f"{(prefix or '').format(**parts, f=f)}{c}{(suffix or '').format(**parts, f=f)}" for c, f in zip(columns, shorts)]
        except (KeyError, IndexError) as e:
            raise ValueError(f"a prefix and a suffix know {{n}}, {{unit}}, {{align}} and {{f}}, not {e}") from e
    if len(new_names) != len(columns):
        raise ValueError("one new name for each column")
    if clash := sorted(set(new_names) & set(existing)):
        raise ValueError(f"columns exist already: {clash}")
    if len(set(new_names)) < len(new_names):
        raise ValueError("new names must differ")
    return new_names
