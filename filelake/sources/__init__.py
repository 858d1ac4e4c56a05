"""File-tree listing and file content."""
