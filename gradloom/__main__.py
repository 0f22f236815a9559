"""Train from two JSON files and save the model: ``python -m gradloom model.json training.json [--save-dir DIR]``.

A finished model is saved under a name of its own, so that runs never overwrite each other.
"""

from __future__ import annotations

import argparse
import os
import secrets

from pyspark.sql import SparkSession

from . import config as c
from .session import orchestrate, progress


def model_path(folder: str, seed: int, name: str | None = None) -> str:
    """A new file for a model in a folder."""
    return os.path.join(folder, f"{name or 'run'}-seed{seed}-{secrets.token_hex(4)}.safetensors")


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> str:
    """Run and return the path of the saved model."""
    parser = argparse.ArgumentParser(prog="gradloom", description="Train a model and save it.")
    parser.add_argument("model")
    parser.add_argument("training")
    parser.add_argument("--save-dir", default="safetensors")
    parser.add_argument("--name")
    given = parser.parse_args(args)
    spark = spark or SparkSession.builder.appName("gradloom").getOrCreate()
    trained = orchestrate(spark, c.load_model(given.model), c.load_training(given.training), on_epoch=progress).wait()
    os.makedirs(given.save_dir, exist_ok=True)
    path = model_path(given.save_dir, trained.seed, given.name)
    trained.save_safetensors(path)
    print(f"{trained.stop_reason}; saved {path}")
    return path


if __name__ == "__main__":
    main()
