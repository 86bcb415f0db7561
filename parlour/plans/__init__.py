"""Query wiring: importing this package registers every query."""

from parlour.plans import queries_changes, queries_live_at, queries_maintained, queries_management, queries_people, queries_quality, queries_staff, queries_stream  # noqa: F401,E501
from parlour.plans.registry import ORACLE, QUERIES  # noqa: F401
