"""Ready-made queries over the driver tables."""
