"""Glob patterns as regular expressions, and Columns that match them in full."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ESCAPED = set(".()|[]{}\\^$+")
WILD = {"*": ".*", "?": "."}

#: A glob's characters and its closed groups, which are lists of the same.
Items = list["str | Items"]


def _parse(glob: str) -> Items:
    """The glob as a tree of its groups; a parenthesis without its partner is a character."""
    open_: list[Items] = [[]]
    for c in glob:
        if c == "(":
            open_.append([])
        elif c == ")" and len(open_) > 1:
            group = open_.pop()
            open_[-1].append(group)
        else:
            open_[-1].append(c)
    while len(open_) > 1:
        rest = open_.pop()
        open_[-1] += ["(", *rest]
    return open_[0]


def _has_choice(group: Items) -> bool:
    return any(x == "|" if isinstance(x, str) else _has_choice(x) for x in group)


def _regex(items: Items, choice: bool) -> str:
    """Items as a regex in which inner groups are text, and pipes too unless they part a choice."""
    out = []
    for x in items:
        if not isinstance(x, str):
            out.append(f"\\({_regex(x, choice)}\\)")
        elif x == "|" and choice:
            out.append(x)
        else:
            out.append(WILD.get(x) or ("\\" + x if x in ESCAPED else x))
    return "".join(out)


def glob_to_regex(glob: str) -> str:
    """An unanchored regex for a glob: * is any text, ? any character, (a|b) one of two, all else itself.

    Only an outermost group is a choice, if there is a pipe in it at any depth.
    """
    return "".join(f"({_regex(x, True)})" if not isinstance(x, str) and _has_choice(x) else _regex([x], False) for x in _parse(glob))


def anchored(regex: str) -> str:
    """A regex that rlike, which searches, applies to the whole value. \\z, as $ would allow a line end after it."""
    return f"^(?:{regex})\\z"


def full_match(value: Column, regex: str) -> Column:
    return value.rlike(anchored(regex))


def glob_match(value: Column, glob: str) -> Column:
    """A full match; globs without special characters become comparisons that scans can use."""
    if not set(glob) & set("*?(|)"):
        return value == F.lit(glob)
    if glob and glob.endswith("*") and not set(glob[:-1]) & set("*?(|)"):
        # The scan gets the prefix, the regex keeps line ends apart.
        return value.startswith(glob[:-1]) & full_match(value, glob_to_regex(glob))
    return full_match(value, glob_to_regex(glob))


def erase(name: str) -> str:
    """A name without type parameters."""
    return name.partition("<")[0]


def erased(value: Column) -> Column:
    return F.substring_index(value, "<", 1)


def suffix_match(value: Column, glob: str) -> Column:
    """Whether the value or what stands behind any of its dots matches in full."""
    return value.rlike(f"^(?s:.*\\.)?(?:{glob_to_regex(glob)})\\z")
