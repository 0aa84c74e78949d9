"""All registered queries; importing the modules fills the registry."""

from furrow.plans.registry import physics, products, relational, spatial  # noqa: F401
from furrow.plans.registry.base import ORACLES, QUERIES  # noqa: F401
