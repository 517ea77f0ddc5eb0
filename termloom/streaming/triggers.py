"""When a stream runs: arguments of ``DataStreamWriter.trigger``."""

AVAILABLE_NOW = {"availableNow": True}


def every(interval: str) -> dict:
    """Run until stopped, a batch per interval such as ``10 seconds``."""
    return {"processingTime": interval}
