"""Sources and sinks: log envelopes, pushes, samples and exposition text."""
