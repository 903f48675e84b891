"""Match-event and player-tracking analytics as Spark DataFrame operators."""

__version__ = "0.1.0"
