"""Every registered query: importing this module loads all registries.

The registries import ``catalog`` (not this module), so any of them can be
imported on its own without a cycle.
"""

from tasklane.plans import catalog
from tasklane.plans import registry_io  # noqa: F401
from tasklane.plans import registry_model  # noqa: F401
from tasklane.plans import registry_prep  # noqa: F401

QUERIES = catalog.QUERIES
ORACLES = catalog.ORACLES
