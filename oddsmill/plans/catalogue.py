"""Imports every plan module once, which fills the catalogue."""

import importlib
import pkgutil

from oddsmill import plans
from oddsmill.plans.registry import CATALOGUE, runner

for _m in sorted(m.name for m in pkgutil.iter_modules(plans.__path__) if m.name.startswith("q_")):
    importlib.import_module(f"oddsmill.plans.{_m}")

__all__ = ["CATALOGUE", "runner"]
