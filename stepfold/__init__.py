"""Change-event traces on Spark: step functions recorded only when their value changes."""
