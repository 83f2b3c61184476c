"""Queries over the driver's tables; importing this registers all of them."""

from . import catalog, resolution, solids, written  # noqa: F401
