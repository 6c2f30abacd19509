"""Named query plans and their SQL equivalents."""
