"""The same queries over a growing log."""
