"""Panel (entity x period) analytics as Spark DataFrame operators."""

from panelloom.spec import PanelSpec

__all__ = ["PanelSpec"]
