"""Operators on DataFrames: partitioning, layers in long form, losses, optimiser steps, compression, control, metrics."""
