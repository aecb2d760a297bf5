"""The same scans over streams."""
