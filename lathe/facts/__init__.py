"""Document facts from container streams."""
