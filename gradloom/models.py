"""Ready-made models for 28x28 grey images with ten classes."""

from __future__ import annotations

from .config import Conv2d, Dense, Kaiming, MaxPooling, ReLU, Sequential, Sigmoid, Softmax, Xavier


def nielsen(filters: int = 10, size: int = 28, classes: int = 10) -> Sequential:
    """One convolution, pooling and two dense layers."""
    after = size - 4
    return Sequential(
        [
            Conv2d((1, size, size), (filters, 1, 5), 1, 0, Xavier(), Sigmoid()),
            MaxPooling((filters, after, after), 2, 2),
            Dense(100, Xavier(), Sigmoid()),
            Dense(classes, Xavier(), Softmax()),
        ]
    )


def lenet5(size: int = 28, classes: int = 10) -> Sequential:
    """Two convolutions with pooling and three dense layers."""
    half, second = size // 2, size // 2 - 4
    return Sequential(
        [
            Conv2d((1, size, size), (6, 1, 5), 1, 2, Kaiming(), ReLU()),
            MaxPooling((6, size, size), 2, 2),
            Conv2d((6, half, half), (16, 6, 5), 1, 0, Kaiming(), ReLU()),
            MaxPooling((16, second, second), 2, 2),
            Dense(120, Kaiming(), ReLU()),
            Dense(84, Kaiming(), ReLU()),
            Dense(classes, Xavier(), Softmax()),
        ]
    )


def small_conv(size: int = 8, classes: int = 10) -> Sequential:
    """A little convolutional model for small square images."""
    return Sequential(
        [
            Conv2d((1, size, size), (8, 1, 3), 1, 1, Kaiming(), ReLU()),
            MaxPooling((8, size, size), 2, 2),
            Dense(32, Kaiming(), ReLU()),
            Dense(classes, Xavier(), Softmax()),
        ]
    )
