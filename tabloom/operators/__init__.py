"""Table-to-table operators; a fitted step is parameters plus a lazy projection."""
