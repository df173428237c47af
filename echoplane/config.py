"""Settings of a recurrence analysis, with their usual defaults."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class RqaConfig:
    """Grids and tolerances of the parameter searches, and how measures are taken.

    ``r*``: false-nearest-neighbour threshold grid, ``delta`` its zero level, ``bound`` the drop
    that selects a dimension; ``reqrr``/``rr_delta``: target recurrence rate and tolerance;
    ``eps*``: radius grid; ``lmin``: shortest line that counts; ``compat``: "current", or "legacy" for
    the older forms of all searches, of normalisation and of the measures."""

    rdiv: int = 451
    rmin: float = 1.0
    rmax: float = 10.0
    delta: float = 0.001
    bound: float = 0.2
    reqrr: float = 0.1
    rr_delta: float = 0.005
    epsmin: float = 0.0
    epsmax: float = 10.0
    epsdiv: int = 1001
    mi_method: str = "histdd"
    tau_method: str = "default"
    lmin: int = 2
    compat: str = "current"

    def __post_init__(self):
        if self.compat not in ("current", "legacy"):
            raise ValueError(f"Unknown form: {self.compat}")

    @property
    def legacy(self) -> bool:
        return self.compat == "legacy"

    def with_(self, **changes) -> RqaConfig:
        return replace(self, **changes)

    @property
    def target_rate(self) -> float:
        return min(0.99, max(0.01, self.reqrr or 0.1))
