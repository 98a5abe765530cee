"""Operators for training text: one module per problem, over shared code-point kernels."""
