"""tasklane: the data side of multi-task text classification, as Spark plans.

Every operator is a function ``DataFrame -> DataFrame`` (use it with
``df.transform``) or ``Column -> Column``. Nothing row-scale passes through
the driver; Python runs only inside Arrow batches where matrix work needs it.
"""

from tasklane.session import build_session, checkpoint_dir, cut_lineage

__all__ = ["build_session", "checkpoint_dir", "cut_lineage"]
