"""Column roles of datasets, and what ports of operators need of them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.positions import POSITION, with_position

# Header names that a role is known by, compared without case.
ALIASES: dict[str, tuple[str, ...]] = {
    "sctid": ("sctid", "id", "concept_id", "conceptid", "sct_id", "code"),
    "en": ("en", "en_term", "english", "eng", "source_term", "preferred_term", "term"),
    "target": ("target", "target_term", "ko", "kor", "ko_term", "translation", "reference"),
    "candidates": ("candidates",),
}


class FlowError(ValueError):
    """A flow that cannot be compiled."""


def resolve_roles(columns: list[str] | None, declared: dict[str, str] | None = None) -> dict[str, str]:
    """Role -> column: the declared column if the table has it, else the first alias, else absent.

    Without columns (a source that is not built yet) the declaration is trusted.
    """
    declared = declared or {}
    if columns is None:
        return dict(declared)
    by_name = {c.lower(): c for c in reversed(columns)}
    out = {}
    for role, names in ALIASES.items():
        want = declared.get(role)
        if want in columns:
            out[role] = want
        else:
            found = next((by_name[n] for n in names if n in by_name), None)
            if found:
                out[role] = found
    return out


@dataclass
class Dataset:
    """A table with its roles; ``df`` is None until the source is built."""

    df: DataFrame | None
    declared: dict[str, str] = field(default_factory=dict)

    @property
    def roles(self) -> dict[str, str]:
        return resolve_roles(self.df.columns if self.df is not None else None, self.declared)

    def require(self, roles: list[str], port: str) -> None:
        missing = [r for r in roles if r not in self.roles]
        if missing:
            raise FlowError(f"port {port} needs {', '.join(missing)}")

    def select_roles(self, *keep: str) -> DataFrame:
        """The table with role names for role columns, so plans use one set of names."""
        return self.df.select(*[F.col(c).alias(r) for r, c in self.roles.items()], *keep)

    def select_positioned(self) -> DataFrame:
        """Also with the place of each row in its file (or in the table, if it came from no file)."""
        return Dataset(with_position(self.df), self.declared).select_roles(POSITION)
