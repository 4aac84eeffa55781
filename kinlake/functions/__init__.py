"""Part of kinlake."""
