"""Scalar and vector functions, schedules, kernels and lattice geometry."""
