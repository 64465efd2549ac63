"""PDF bytes: scanning, resolving, interpreting, writing. No Spark here."""
