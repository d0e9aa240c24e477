"""DataFrame -> DataFrame operators, one module per stage of a log line's way."""
