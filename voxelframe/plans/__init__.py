"""Runnable queries, grouped as in the coverage list."""

import importlib

MODULES = ("q_texture", "q_matrices", "q_shape", "q_voxel", "q_sources", "q_tables", "q_models", "q_extract")


def load_all() -> None:
    for name in MODULES:
        importlib.import_module(f"voxelframe.plans.{name}")
