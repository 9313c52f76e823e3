"""Sources and sinks: source trees, parsers, version control, configuration, providers and the keyed table store."""
