"""Numerical kernels on one window or one tree, for Arrow functions."""
