"""keelson: visual-inspection analytics as Spark DataFrame jobs.

Frames and photos (or tables that describe them) go in; quality flags,
near-duplicate flags, representative subsets, class statistics, risk scores,
mart tables and dashboard panels come out. Every public function takes and
returns DataFrames or Columns; nothing is collected to the driver.
"""

from keelson.session import get_spark, ensure_checkpoint_dir, cut_lineage

__all__ = ["get_spark", "ensure_checkpoint_dir", "cut_lineage"]
