"""Named plans over the driver tables."""
