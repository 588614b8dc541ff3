"""termgrid: course-panel analytics as PySpark DataFrame jobs."""

from termgrid.spec import PanelSpec, TrajectorySpec

__all__ = ["PanelSpec", "TrajectorySpec"]
