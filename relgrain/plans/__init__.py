"""Specs of table graphs, and the planner that turns them into one lazy DataFrame."""

from .planner import Plan, plan
from .spec import Edge, EntityGraph, FeaturePolicy, Hook, LabelSpec, Op, Source, Table, Window

__all__ = ["Edge", "EntityGraph", "FeaturePolicy", "Hook", "LabelSpec", "Op", "Plan", "Source", "Table", "Window", "plan"]
