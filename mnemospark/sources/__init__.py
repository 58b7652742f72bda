"""mnemospark sources."""
