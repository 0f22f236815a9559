from .tables import (
    append,
    count_rows,
    from_dataframe,
    history,
    idx_images,
    idx_labels,
    inline,
    load,
    local,
    packed,
    subset,
    text_table,
)

__all__ = ["append", "count_rows", "from_dataframe", "history", "idx_images", "idx_labels", "inline", "load", "local", "packed", "subset", "text_table"]
