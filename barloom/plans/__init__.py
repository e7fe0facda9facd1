"""Query plans by area; importing this package registers them."""

from barloom.plans import base, detect, extra, families, futures, live, policy, prepare, profiles, reports, rules, setups, shadow, storage, surfaces, swings, trade  # noqa: F401
from barloom.plans.registry import QUERIES  # noqa: F401
