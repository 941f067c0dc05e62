"""Rule matching over events, Spark-first."""

__version__ = "0.2.0"


def version() -> str:
    return __version__
