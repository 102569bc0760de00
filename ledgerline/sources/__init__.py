from ledgerline.sources.readers import (  # noqa: F401
    TEST_TABLES,
    first_rows,
    nan_to_null,
    read_csv,
    read_csv_inferred,
    read_table,
    shape,
    stack_all,
    stack_rows,
)
