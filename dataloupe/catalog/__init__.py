"""Every operator as a runnable query on the test tables, with equivalent SQL.

``QUERIES`` maps a name to a function of (spark, folder), ``SQL`` the same name to the
statement that gives the same table. Doubles are rounded to four places on both sides,
because sums over partitions come in another order.
"""

from dataloupe.catalog.registry import QUERIES, SQL
from dataloupe.catalog import (  # noqa: F401  (importing registers)
    charts, cleaning, features, outliers, profiling, repair, sources, trends,
)
