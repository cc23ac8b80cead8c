"""Reading, writing and generating traces."""
