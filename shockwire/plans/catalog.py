"""Imports the modules that register queries."""

from shockwire.plans import catalog_events, catalog_text  # noqa: F401
from shockwire.plans import catalog_model  # noqa: F401
from shockwire.plans import catalog_series  # noqa: F401
from shockwire.plans import catalog_charts  # noqa: F401
from shockwire.plans import catalog_files  # noqa: F401
