"""Run records and summary tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: The columns of the published table, in its order.
FIELDS = ("suite", "model", "strategy", "workers", "servers", "batch_size", "offline_epochs", "train_seconds", "epochs_ran", "epochs_per_sec", "samples_per_sec", "final_loss", "loss_per_sec", "accuracy", "accuracy_per_sec", "error")


def append_records(df: DataFrame, folder: str) -> None:
    """Add records to a folder of JSON lines."""
    df.write.mode("append").json(folder)


def write_csv(df: DataFrame, folder: str) -> None:
    """One CSV of the known fields, in the order of suite, model, strategy and workers. Runs are few."""
    known = [f for f in FIELDS if f in df.columns]
    df.select(*known).orderBy(*[f for f in ("suite", "model", "strategy", "workers") if f in known]).coalesce(1).write.mode("overwrite").csv(folder, header=True)


def cell(value, form: str = "{:.4g}", deviation=None) -> str:
    """A value as text, with its deviation if there is one; a dash for none."""
    if value is None:
        return "-"
    text = form.format(value)
    return f"{text} ± {form.format(deviation)}" if deviation else text


#: Columns of each suite's table, as (title, field, form).
TABLES = {
    "convergence": (("Model", "model", "{}"), ("Strategy", "strategy", "{}"), ("Workers", "workers", "{}"), ("Epochs", "epochs_ran", "{}"), ("Final loss", "final_loss", "{:.4g}"), ("Accuracy", "accuracy", "{:.3f}")),
    "execution-speed": (("Model", "model", "{}"), ("Strategy", "strategy", "{}"), ("Offline", "offline_epochs", "{}"), ("Batch", "batch_size", "{}"), ("Samples/sec", "samples_per_sec", "{:.0f}")),
    "convergence-speed": (("Model", "model", "{}"), ("Strategy", "strategy", "{}"), ("Samples/sec", "samples_per_sec", "{:.0f}"), ("Loss/sec", "loss_per_sec", "{:.3g}"), ("Accuracy/sec", "accuracy_per_sec", "{:.3g}")),
    "scalability": (("Model", "model", "{}"), ("Strategy", "strategy", "{}"), ("Workers", "workers", "{}"), ("Samples/sec", "samples_per_sec", "{:.0f}")),
}


def markdown(df: DataFrame) -> str:
    """A table a suite. Collects run summaries, of which there are dozens."""
    rows = sorted((r.asDict() for r in df.collect()), key=lambda r: (r["suite"], r["model"], r["strategy"], r.get("workers") or 0))
    out = []
    for suite, columns in TABLES.items():
        own = [r for r in rows if r["suite"] == suite]
        if own:
            out += [f"## {suite}", "", "| " + " | ".join(t for t, _, _ in columns) + " |", "|" + "---|" * len(columns)]
            out += ["| " + " | ".join(cell(r.get(f), form, r.get(f"{f}_std")) for _, f, form in columns) + " |" for r in own] + [""]
    return "\n".join(out)
