"""Writers for run artifacts."""
