"""State machines and structured streaming."""
