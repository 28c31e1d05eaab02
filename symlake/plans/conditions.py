"""YAML conditions and configuration as values."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

import yaml

from symlake.model import Location
from symlake.operators.deps import UNKNOWN_GROUP


class ConditionError(ValueError):
    pass


@dataclass(frozen=True)
class Referenced:
    pattern: str
    location: Location = Location.DEFAULT
    annotation: str | None = None
    elements: Mapping[str, str] = field(default_factory=dict)
    files: tuple[str, ...] | None = None


@dataclass(frozen=True)
class Dependency:
    name: str | None = None
    name_regex: str | None = None
    lower: str | None = None
    upper: str | None = None


class _Text(yaml.SafeLoader):
    """Plain scalars stay text: a bound such as 5.0 keeps its digits."""


_Text.yaml_implicit_resolvers = {}


def _load(text: str) -> Any:
    return yaml.load(text, _Text)  # noqa: S506 a subclass of the safe loader


def _words(value: Any) -> tuple[str, ...] | None:
    """A list's items as they are, a string cut at white space."""
    if value in (None, ""):
        return None
    return tuple(str(v) for v in value) if isinstance(value, list) else tuple(str(value).split())


def parse_referenced(text: str) -> Referenced | None:
    """None if the condition is of another kind; a missing pattern is an error."""
    found = (_load(text) or {}).get("referenced")
    if not isinstance(found, dict):
        return None
    if "pattern" not in found:
        raise ConditionError("a referenced condition needs a pattern")
    annotated = found.get("annotated") or {}
    elements = {str(e["name"]): str(e["value"]) for e in annotated.get("elements") or []}
    return Referenced(str(found["pattern"]), Location.parse(found.get("location")), annotated.get("pattern") or None, elements, _words(found.get("filepaths")))


def parse_dependency(text: str) -> Dependency | None:
    found = (_load(text) or {}).get("dependency")
    if not isinstance(found, dict):
        return None
    return Dependency(*[found.get(k) or None for k in ("name", "name_regex", "lowerbound", "upperbound")])


@dataclass(frozen=True)
class Config:
    location: str
    included_paths: tuple[str, ...] = ()
    dependency_roots: tuple[str, ...] = ()
    label_file: str | None = None
    exclude_packages: tuple[str, ...] = ()
    index_path: str | None = None
    encoding: str = "UTF-8"
    context_lines: int = 10
    label_domain: str = "dependency"
    #: Printed dependency trees of Gradle (files or a directory), which stand for running the tool.
    gradle_trees: str | None = None
    #: The local Maven repository, where artifacts are looked up.
    maven_repository: str | None = None
    unknown_group: str = UNKNOWN_GROUP

    @classmethod
    def parse(cls, location: str, options: Mapping[str, Any]) -> Config:
        """From provider options; values of a wrong type count as absent."""
        text = lambda k: options[k] if isinstance(options.get(k), str) and options[k] else None
        many = lambda k: tuple(str(v) for v in options[k]) if isinstance(options.get(k), list) else ()
        return cls(location, many("includedPaths"), many("dependencyRoots"), text("depOpenSourceLabelsFile"), many("excludePackages"), text("mavenIndexPath"), text("encoding") or "UTF-8", options["contextLines"] if isinstance(options.get("contextLines"), int) else 10, text("labelDomain") or "dependency", text("gradleTrees"), text("mavenCacheDir"), text("unknownGroup") or UNKNOWN_GROUP)
