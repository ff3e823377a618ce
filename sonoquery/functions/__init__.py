"""Scalar functions: signal, text and token expressions, and the numpy kernels of Arrow functions."""
