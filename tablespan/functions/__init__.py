"""Column-level rules: how cells become text and how needles are normalised."""
