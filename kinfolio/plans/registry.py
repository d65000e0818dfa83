"""All registered queries of the item-graph operators, with the SQL that checks them."""

from kinfolio.plans import browse, cluster, graph, jobs, report, state  # noqa: F401
from kinfolio.plans.base import ORACLE_SQL, QUERIES  # noqa: F401
