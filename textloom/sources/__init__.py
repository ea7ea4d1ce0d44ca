"""Text files, profile and policy files."""
