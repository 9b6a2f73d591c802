"""Every operator as a query over the driver tables, with an equivalent SQL statement where SQL can say it.

Which table stands in for what is told in the docstring of each module. All queries read whole tables.
"""

from __future__ import annotations

from leafgraph.registered.base import ORACLES, QUERIES  # noqa: F401
from leafgraph.registered import chunks, context, logs, pages, scalars, search, sites, stores, tables, urls  # noqa: F401,E402
