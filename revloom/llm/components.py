"""Connected components of a link table."""

from revloom.plans.components import components

__all__ = ["components"]
