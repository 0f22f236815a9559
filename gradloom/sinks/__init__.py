"""Writers for models, run records and reports."""
