"""Generators of the scope in which association is judged: (segments, annotations, workspace) to the same.

The centered generators keep a track column in the workspace, that of what it is centered on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import algebra
from ..schema import axis

Scope = tuple[DataFrame, DataFrame, DataFrame]
Generator = Callable[[DataFrame, DataFrame, DataFrame], Scope]
WORKSPACES: dict[str, Callable[..., Generator]] = {}


#: Of what a generator's workspace depends on: each track, annotation or pair of them has its own.
CONDITIONS: dict[str, tuple[str, ...]] = {}
#: Of those that depend on any, what finds the workspaces of all names at once: (segments, annotations, workspace) to
#: intervals with the names that have them, as arrays in _track and _annotation.
SPACES: dict[str, Callable[..., Callable[[DataFrame, DataFrame, DataFrame], DataFrame]]] = {}
_SEP = "\x1f"


def register(name: str, *conditions: str, spaces: Callable | None = None):
    if conditions and spaces is None:
        raise ValueError("a generator with conditions needs a function for its spaces")

    def add(f):
        WORKSPACES[name] = f
        CONDITIONS[name] = conditions
        if spaces is not None:
            SPACES[name] = spaces
        return f

    return add


def labelled(spaces: DataFrame, by: tuple[str, ...], own: str = "") -> DataFrame:
    """A row for each track, annotation or pair (by) that has an interval, on axes of their own, so that nothing of one meets another's.

    The names are put before the contig; scope_of() reads them again. own: that of by that the track column tells.
    """
    for c in by:
        spaces = spaces.withColumn("_" + c, F.col("track") if c == own else F.explode("_" + c))
    return spaces.withColumn("contig", F.concat_ws(_SEP, *["_" + c for c in by], "contig")).drop("_track", "_annotation")


def within(df: DataFrame, spaces: DataFrame, by: tuple[str, ...], own: str = "", cut: bool = True) -> DataFrame:
    """Rows of df, cut or (distinct ones) whole, in the workspace of each track, annotation or pair (by) that they touch, as labelled().

    own: what the track column of df is the name of; it then meets workspaces of its own name only. Sides are joined
    as they are, and copied for each name only where a workspace of that name is touched.
    """
    pairs = algebra.overlap_join(df, spaces).withColumnsRenamed({f"_{c}_b": "_" + c for c in by})
    if own in by:
        pairs = pairs.filter(F.array_contains("_" + own, F.col("track")))
    if cut:
        pairs = pairs.withColumns({"start": F.greatest("start", "start_b"), "end": F.least("end", "end_b")})
    rows = labelled(pairs.select(*df.columns, *["_" + c for c in by]), by, own)
    return rows if cut else rows.distinct()


def scope_of(df: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """df of labelled() with the track or annotation (by) whose workspace its rows are in."""
    return df.withColumns({c: F.split_part("contig", F.lit(_SEP), F.lit(i + 1)) for i, c in enumerate(by)})


def filtered(segments: DataFrame, annotations: DataFrame, workspace: DataFrame) -> Scope:
    """Segments and annotations that touch the workspace, whole."""
    return algebra.overlapping(segments, workspace), algebra.overlapping(annotations, workspace), workspace


@register("unconditional")
def unconditional() -> Generator:
    return lambda segments, annotations, workspace: (segments, annotations, workspace)


def _cooccurring() -> Callable:
    def make(segments: DataFrame, annotations: DataFrame, workspace: DataFrame) -> DataFrame:
        own = [*axis(workspace), "start", "end"]
        met = [algebra.overlap_join(workspace, x).select(*own, F.col("track_b").alias("_" + c)) for c, x in (("track", segments), ("annotation", annotations))]
        both = met[0].unionByName(met[1], allowMissingColumns=True).groupBy(*own).agg(*(F.collect_set(c).alias(c) for c in ("_track", "_annotation")))
        return both.filter((F.size("_track") > 0) & (F.size("_annotation") > 0))

    return make


@register("cooccurance", "track", "annotation", spaces=_cooccurring)
def cooccurrence() -> Generator:
    """Only intervals of the workspace that hold both an annotation and a segment."""

    def make(segments: DataFrame, annotations: DataFrame, workspace: DataFrame) -> Scope:
        both = algebra.overlapping(algebra.overlapping(workspace, annotations), segments)
        return filtered(segments, annotations, both)

    return make


def _own(which: int, extension: int | None, expansion: float | None) -> Callable[[DataFrame, DataFrame, DataFrame], DataFrame]:
    if extension is None and expansion is None:
        raise ValueError("give either an extension or an expansion")

    def make(segments: DataFrame, annotations: DataFrame, workspace: DataFrame) -> DataFrame:
        center = (segments, annotations)[which]
        wide = algebra.extend(center, extension) if extension is not None else algebra.expand(center, expansion)
        return algebra.intersect(algebra.normalize(wide), workspace)

    return make


def _centered(which: int, extension: int | None, expansion: float | None) -> Generator:
    own = _own(which, extension, expansion)
    return lambda segments, annotations, workspace: filtered(segments, annotations, own(segments, annotations, workspace))


def _around(which: int, name: str) -> Callable:
    """Spaces of what is centered on segments (0) or annotations (1)."""

    def options(extension: int | None = None, expansion: float | None = None):
        own = _own(which, extension, expansion)
        return lambda *sets: own(*sets).withColumn(name, F.array("track")).drop("track")

    return options


@register("annotation-centered", "annotation", spaces=_around(1, "_annotation"))
def annotation_centered(extension: int | None = None, expansion: float | None = None) -> Generator:
    """What lies around annotations; the workspace keeps their track."""
    return _centered(1, extension, expansion)


@register("segment-centered", "track", spaces=_around(0, "_track"))
def segment_centered(extension: int | None = None, expansion: float | None = None) -> Generator:
    """What lies around segments; the workspace keeps their track."""
    return _centered(0, extension, expansion)


def restricted(workspace: DataFrame, *others: DataFrame) -> DataFrame:
    """Workspace intervals, whole, that touch each of the others."""
    for other in others:
        workspace = algebra.overlapping(workspace, other)
    return workspace


def truncated(workspace: DataFrame, other: DataFrame) -> DataFrame:
    """The workspace cut to what the other's tracks cover together."""
    together = algebra.merge(other.select(*[c for c in ("contig", "isochore") if c in other.columns], "start", "end"), 0)
    return algebra.intersect(workspace, together)

