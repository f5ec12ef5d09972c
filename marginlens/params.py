"""Analysis parameters: comparison windows, channel names, thresholds and labels.

Operators receive a ``Params`` and bind its values as literals; nothing is spliced into SQL text.
"""

from __future__ import annotations

from dataclasses import dataclass, fields, replace
from datetime import date
from decimal import Decimal

# Names and labels that appear in results and must keep these exact spellings.
B2B_CHANNEL = "Revendeurs"
B2C_CHANNEL = "Internet"
BRIDGE_STEPS = (
    "Marge P0",
    "Volume",
    "Mix produits/canaux",
    "Prix catalogue",
    "Remises",
    "Coût standard",
    "Nouveaux produits",
    "Produits arrêtés",
    "Marge P1",
)
DISCOUNT_POPULATIONS = (
    "1 - la remise crée la perte",
    "2 - déjà à perte avant remise",
    "3 - reste rentable après remise",
)
PERIOD_LABELS = ("12 mois à nov. 2012", "12 mois à nov. 2013")
DEFAULT_WINDOWS = {
    "P0_START": "2011-12-01",
    "P0_END": "2012-11-30",
    "P1_START": "2012-12-01",
    "P1_END": "2013-11-30",
}


@dataclass(frozen=True)
class Params:
    """Everything an analysis needs besides the tables themselves.

    Both windows are inclusive at both ends. ``channels`` are the two values of the ``channel`` column.
    """

    p0_start: date = date.fromisoformat(DEFAULT_WINDOWS["P0_START"])
    p0_end: date = date.fromisoformat(DEFAULT_WINDOWS["P0_END"])
    p1_start: date = date.fromisoformat(DEFAULT_WINDOWS["P1_START"])
    p1_end: date = date.fromisoformat(DEFAULT_WINDOWS["P1_END"])
    p0_label: str = PERIOD_LABELS[0]
    p1_label: str = PERIOD_LABELS[1]

    b2b: str = B2B_CHANNEL
    b2c: str = B2C_CHANNEL
    bridge_steps: tuple[str, ...] = BRIDGE_STEPS
    populations: tuple[str, ...] = DISCOUNT_POPULATIONS

    no_promotion_key: int = 1
    new_product_type: str = "New Product"
    focus_category: str = "Bikes"
    focus_subcategory: str = "Touring Bikes"

    depth_cuts: tuple[Decimal, ...] = (Decimal("0.05"), Decimal("0.10"), Decimal("0.20"))
    class_a_share: Decimal = Decimal("0.80")
    class_b_share: Decimal = Decimal("0.95")
    identity_tolerance: Decimal = Decimal("0.01")
    gate_tolerance: float = 0.005

    price_steps: tuple[float, ...] = (0.03, 0.05, 0.08, 0.10)
    elasticities: tuple[float, ...] = (0.0, -1.0, -2.0, -3.0)
    variable_shares: tuple[float, ...] = (1.0, 0.95, 0.90, 0.80)
    discount_caps: tuple[Decimal, ...] = (Decimal("0.10"), Decimal("0.05"))
    sensitivity: tuple[float, float, float] = (0.05, -3.0, 0.8)

    month_range: tuple[str, str] = ("2011-01", "2013-11")
    margin_floor_pct: float = -15.0

    def __post_init__(self) -> None:
        if self.p0_start > self.p0_end or self.p1_start > self.p1_end:
            raise ValueError("a window must not end before it starts")
        if len(self.bridge_steps) != 9 or len(self.populations) != 3:
            raise ValueError("the bridge has nine steps and there are three discount populations")
        if list(self.depth_cuts) != sorted(set(self.depth_cuts)):
            raise ValueError("depth_cuts must be strictly increasing")

    @property
    def channels(self) -> tuple[str, str]:
        return (self.b2b, self.b2c)

    @classmethod
    def from_windows(cls, windows: dict[str, str], **others) -> "Params":
        """Build from ``{"P0_START": "yyyy-mm-dd", ...}``; missing or unknown names raise ``KeyError``."""
        known = set(DEFAULT_WINDOWS)
        if set(windows) != known:
            raise KeyError(f"window parameters must be exactly {sorted(known)}, got {sorted(windows)}")
        bounds = {name.lower(): date.fromisoformat(value) for name, value in windows.items()}
        return cls(**bounds, **others)

    def with_(self, **changes) -> "Params":
        unknown = set(changes) - {f.name for f in fields(self)}
        if unknown:
            raise KeyError(f"unknown parameters: {sorted(unknown)}")
        return replace(self, **changes)
