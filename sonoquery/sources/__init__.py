"""Sources and sinks: audio files, archives, side-car metadata, predictions and caches."""
