"""Schemas and closed vocabularies of the two relations."""

from __future__ import annotations

from enum import StrEnum

from pyspark.sql import types as T


class Location(StrEnum):
    """Where in a source a symbol stands; the values partition the symbol table."""

    DEFAULT = "DEFAULT"
    INHERITANCE = "INHERITANCE"
    METHOD_CALL = "METHOD_CALL"
    CONSTRUCTOR_CALL = "CONSTRUCTOR_CALL"
    ANNOTATION = "ANNOTATION"
    IMPLEMENTS_TYPE = "IMPLEMENTS_TYPE"
    ENUM = "ENUM"
    RETURN_TYPE = "RETURN_TYPE"
    IMPORT = "IMPORT"
    VARIABLE_DECLARATION = "VARIABLE_DECLARATION"
    TYPE = "TYPE"
    TYPE_KEYWORD = "TYPE_KEYWORD"
    PACKAGE = "PACKAGE"
    FIELD = "FIELD"
    METHOD = "METHOD"
    CLASS = "CLASS"

    @classmethod
    def parse(cls, text: str | None) -> Location:
        """The location a condition names: empty is DEFAULT, 'type' the keyword form, anything unknown TYPE."""
        word = (text or "").strip().lower()
        if not word:
            return cls.DEFAULT
        if word == "type":
            return cls.TYPE_KEYWORD
        if word == "field_declaration":
            return cls.FIELD
        known = {x.value.lower(): x for x in cls if x not in (cls.DEFAULT, cls.TYPE_KEYWORD)}
        return known.get(word, cls.TYPE)


#: Searched when a condition names no location.
DEFAULT_LOCATIONS = (Location.TYPE, Location.METHOD_CALL, Location.CONSTRUCTOR_CALL, Location.ANNOTATION, Location.IMPORT)
#: Locations whose names are compared without type parameters.
ERASED = (Location.TYPE, Location.CONSTRUCTOR_CALL, Location.FIELD, Location.VARIABLE_DECLARATION, Location.INHERITANCE, Location.IMPLEMENTS_TYPE, Location.IMPORT, Location.ANNOTATION, Location.CLASS)

_s, _i, _b = T.StringType(), T.IntegerType(), T.BooleanType()
ANNOTATIONS = T.ArrayType(T.StructType([T.StructField("qualified_name", _s), T.StructField("elements", T.MapType(_s, _s))]))
SYMBOLS = T.StructType(
    [
        T.StructField("qualified_name", _s),
        T.StructField("name", _s),
        T.StructField("kind", _s),
        T.StructField("location", _s),
        T.StructField("file_uri", _s),
        T.StructField("package_name", _s),
        T.StructField("line", _i),
        T.StructField("start_char", _i),
        T.StructField("end_line", _i),
        T.StructField("end_char", _i),
        T.StructField("annotations", ANNOTATIONS),
        T.StructField("is_dependency", _b),
        T.StructField("seq", T.LongType()),
    ]
)
PARSE_ERRORS = T.StructType([T.StructField("file_uri", _s), T.StructField("error", _s)])
COORDINATES = T.StructType([T.StructField(c, _s) for c in ("group_id", "artifact_id", "version", "pom_path")])
DEPENDENCIES = T.StructType(
    [
        *[T.StructField(c, _s) for c in ("group_id", "artifact_id", "version", "classifier", "scope", "jar_path")],
        T.StructField("has_source_jar", _b),
        T.StructField("indirect", _b),
        T.StructField("pom_path", _s),
        T.StructField("base_dep", COORDINATES),
        T.StructField("ordinal", T.LongType()),
    ]
)
DECLARED = T.StructType([*[T.StructField(c, _s) for c in ("group_id", "artifact_id", "version", "classifier", "scope")], T.StructField("line", _i), T.StructField("file_uri", _s), T.StructField("ordinal", _i)])
EDGES = T.StructType([T.StructField("node_id", _s), T.StructField("parent_id", _s), T.StructField("ordinal", _i), *[T.StructField(c, _s) for c in ("group_id", "artifact_id", "version", "classifier", "scope", "pom_path")]])
