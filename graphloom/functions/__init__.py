"""See the package README for the modules here."""
