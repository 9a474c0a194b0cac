"""The query catalogue and compositions."""
