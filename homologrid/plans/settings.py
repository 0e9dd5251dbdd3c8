"""Settings of a run: defaults, overlay, checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, fields, replace
from enum import Enum

from homologrid.operators.layout import MODES


class Mode(str, Enum):
    SEARCH = "search"
    CLUSTER = "cluster"


class InputError(ValueError):
    """The inputs do not fit the settings."""


# Fewest structures of a cluster run, spellings of "on" for switches.
MIN_STRUCTURES = 10
TRUE_WORDS = ("1", "true", "yes", "on")

# Customary caps, for ``overlaid``.
USUAL_CAPS = {"max_structure_hits": 3000, "max_sequence_hits": 3000, "max_structures": 5000}


@dataclass(frozen=True)
class Settings:
    """Every setting with its default; a cap that is None keeps all rows.

    The caps that an analysis usually names are in ``USUAL_CAPS``.
    """

    mode: Mode = Mode.SEARCH
    analysis_name: str = "example"
    max_structure_hits: int | None = None
    max_sequence_hits: int | None = None
    max_structures: int | None = None
    min_length: int = 0
    max_length: int = 0
    hit_evalue: float = 0.01
    concordance_evalue: float = 0.001
    concordance_min_score: float = 0.0
    key_proteins: tuple[str, ...] = ()
    excluded_proteins: tuple[str, ...] = ()
    plotting_modes: tuple[str, ...] = ("pca_tsne", "pca_umap")
    taxon_focus: str = "euk"
    neighbours: int = 10
    neighbour_share: float = 0.0
    components: int = 30
    seed: int = 123456
    layout_rounds: int | None = None
    allow_empty_search: bool = False

    def overlaid(self, changes: Mapping[str, object]) -> Settings:
        """Settings with some values replaced; unknown names are an error."""
        known = {field.name for field in fields(self)}
        unknown = sorted(set(changes) - known)
        if unknown:
            raise InputError(f"unknown settings: {unknown}")
        cleaned = {
            name: tuple(value) if isinstance(value, list) else value
            for name, value in changes.items()
        }
        if "mode" in cleaned:
            cleaned["mode"] = Mode(cleaned["mode"])
        return replace(self, **cleaned).checked()

    def checked(self) -> Settings:
        if self.min_length > self.max_length and self.max_length != 0:
            raise InputError("the minimum length must not exceed the maximum length")
        wrong = [mode for mode in self.plotting_modes if mode not in MODES]
        if wrong:
            raise InputError(f"unknown plotting modes: {wrong}")
        return self


def is_on(value: str | None) -> bool:
    """Reading of an on/off switch given as text."""
    return (value or "").strip().lower() in TRUE_WORDS


def check_cluster_inputs(n_structures: int, missing_keys: Sequence[str]) -> None:
    """A cluster run needs enough structures, the key proteins among them."""
    if n_structures < MIN_STRUCTURES:
        raise InputError(f"at least {MIN_STRUCTURES} structures are needed, got {n_structures}")
    if missing_keys:
        raise InputError(f"key proteins without a structure: {sorted(missing_keys)}")
