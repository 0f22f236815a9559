"""Numpy kernels that run inside Arrow workers: layers, losses, optimisers, gradient codecs."""
