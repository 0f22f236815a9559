"""Column expressions: activations, losses, number formats."""

from .columns import cross_entropy_term, format_loss, leaky_relu, normal_or_zero, sigmoid, squared_error, tanh

__all__ = ["cross_entropy_term", "format_loss", "leaky_relu", "normal_or_zero", "sigmoid", "squared_error", "tanh"]
