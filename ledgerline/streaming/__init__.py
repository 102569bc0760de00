from ledgerline.streaming.features import detail_stream, feature_stream, run_updates  # noqa: F401
