"""Sources: log files, streams, raw archive, lake files."""
