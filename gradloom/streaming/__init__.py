from .control import converged_runs, running_loss

__all__ = ["converged_runs", "running_loss"]
