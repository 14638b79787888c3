"""A PDF reader in plain Python: bytes to pages and painted characters."""
