"""DataFrame -> DataFrame operators, each usable with ``DataFrame.transform``."""
