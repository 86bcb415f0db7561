"""parlour: set-based analytics for appointment-based service businesses on PySpark.

Every operator is a pure function ``op(t, as_of, **options) -> DataFrame`` where ``t`` is a
dict of the eleven domain tables (see :mod:`parlour.sources.schemas`) and ``as_of`` is an
explicit point in time (the reference reads the wall clock instead).
"""

from parlour.session import get_session, checkpoint_dir  # noqa: F401

__all__ = ["get_session", "checkpoint_dir"]
