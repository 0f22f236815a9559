"""Distributed model training and training analytics on Spark."""

from .config import (
    Adam,
    AllReduce,
    BarrierSync,
    BaseSerializer,
    BlockingStore,
    Const,
    Conv2d,
    CrossEntropy,
    DataFrameDataset,
    Dense,
    GradientDescent,
    GradientDescentWithMomentum,
    InlineDataset,
    InlineParams,
    Kaiming,
    Lecun,
    LecunUniform,
    LocalDataset,
    MaxPooling,
    Mse,
    NonBlockingSync,
    Normal,
    ParameterServer,
    ReLU,
    Sequential,
    Sigmoid,
    Softmax,
    SparseSerializer,
    StrategySwitch,
    Tanh,
    TrainingConfig,
    Uniform,
    UniformInclusive,
    WildStore,
    Xavier,
    XavierUniform,
    all_reduce,
    load_model,
    load_training,
    parameter_server,
    strategy_switch,
)
from .session import Session, TrainedModel, orchestrate

__all__ = [n for n in dir() if not n.startswith("_")]
