from ledgerline.functions import aggs, columns, rows  # noqa: F401
from ledgerline.functions.aggs import Recipe, aggregate_columns, share_columns, upper_name  # noqa: F401
